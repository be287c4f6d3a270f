"""Encoding against the tokenizers library, and packing."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphmere.llm import forced_bpe, packing, queries

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  ", "a<|endoftext|>b  c", "ΑΣ ΟΔΟΣ x́y  a b c ẛ̣ İstanbul don't I'LL 123 \x1c\x85 é 日本語のテスト 🤣🤣 '''s", "<|startoftext|><|endoftext|>", "áͅb Å ﬁ​‍х", "\x04 a\x00b", "x" * 3000]


def fuzz(n, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x3000, 0x9000), rng.choice([9, 10, 13, 32, 32, 0xA0, 0x2003]), 0x1F600])
    return ["".join(chr(pick()) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_codec_equals_library():
    codec, lib = forced_bpe.ForcedBoundaryCodec(WORDS), Tokenizer.from_file(WORDS)
    for t in ODD + fuzz(1500, 1):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_cuts_are_forced():
    codec = forced_bpe.ForcedBoundaryCodec(WORDS)
    for t in ("hendrixtqzwvx", "qzqzqz", "ab"):
        parts = codec.fragments_of(t)
        assert "".join(parts) == t
        assert all((a[-1], b[0]) not in codec.pairs for a, b in zip(parts, parts[1:]))
        assert not any(any(a[-1] + b[0] in v for v in codec.vocab) for a, b in zip(parts, parts[1:]))


def test_op8_equals_library(spark, sf):
    lib = Tokenizer.from_file(WORDS)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_forced_bpe(spark, sf).collect():
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_quick_ids_equal_library():
    mine, lib = packing.QuickTokenizer(BYTES), Tokenizer.from_file(BYTES)
    for t in ODD + fuzz(1500, 2) + ["a \n\n b\n", "\n\n\nB", "x  y   z ", "don't 'tis"]:
        assert np.frombuffer(mine.ids(t.encode()), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_digest_edges(spark):
    lib = Tokenizer.from_file(WORDS)
    long = "Straße naïve 日本 " * 20_000 + "x" * 5_000
    rows = [(None, "a b", 1), (None, None, 2), (5, "", 3), (5, "Twice", 4), (5, "Twice", 4), (6, long, 5), (7, " \t\n", 6), (8, "[CLS] ## [MASK] é e\u0301 \u0000", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in forced_bpe.digests(df, WORDS).collect()))
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert forced_bpe.digests(df.limit(0), WORDS).count() == 0


def exact_bins(sizes, capacity):
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + sizes[k] <= capacity:
                go(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1 :])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


def test_plans_are_whole_and_small():
    rng = random.Random(0)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        plan = packing.complete_bins(collections.Counter(sizes), capacity)
        assert sorted(s for p, n in plan for s in p * n) == sorted(sizes) and all(sum(p) <= capacity for p, _ in plan)
        fewest = exact_bins(sizes, capacity)
        assert packing.lower_bound(collections.Counter(sizes), capacity) <= fewest
        assert sum(n for _, n in plan) == fewest
    assert packing.complete_bins({}, 10) == []
    big = collections.Counter(rng.randrange(1, 1025) for _ in range(20_000))
    assert sum(n for _, n in packing.complete_bins(big, 1024)) <= packing.lower_bound(big, 1024) * 1.001


def test_exhaustive_search_is_exact():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 20, 37])
        sizes = sorted((rng.randrange(2, capacity // 2 + 3) for _ in range(rng.randrange(1, 11))), reverse=True)
        plan = packing.complete_bins(collections.Counter(sizes), capacity, None, None, None, True)
        assert sorted(s for p, n in plan for s in p * n) == sorted(sizes) and sum(n for _, n in plan) == exact_bins(sizes, capacity)


def test_search_without_undominated_fillings_goes_on():
    counts = collections.Counter(random.Random(2).choices(range(200, 520), k=5_000))
    fewest = [sum(n for _, n in packing.complete_bins(counts, 1024, looks=looks)) for looks in (1, packing.LOOKS)]
    assert max(fewest) <= sum(n for _, n in packing.best_fit(counts, 1024))


def test_fillings_are_undominated():
    for f in packing.fillings({3: 2, 4: 1, 5: 1, 9: 1}, 12, 3):
        left = {3: 2 - f.count(3), 4: 1 - f.count(4), 5: 1 - f.count(5), 9: 1 - f.count(9)}
        room = 12 - sum(f)
        assert not any(n and s <= room for s, n in left.items())


@pytest.mark.parametrize("rows", [None, [(None, None, 1), (5, "a " * 3000, 2), (5, "a " * 3000, 2), (6, "", 3)]])
def test_packing(spark, sf, rows):
    df = spark.read.parquet(f"{sf}/documents.parquet") if rows is None else spark.createDataFrame(rows, "doc_id long, text string, piece int")
    lib = Tokenizer.from_file(BYTES)
    want = collections.Counter()
    for r in df.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, n in enumerate(packing.piece_lengths(len(ids), 1024)):
            want[r.doc_id, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
        assert at == len(ids)
    got = packing.pack(df, BYTES).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 1024) * 1.02 + 1
    (least,) = {r.least_sequences for r in got}
    assert -(-total // 1024) <= least <= len(by)
    assert packing.pack(df.limit(0), BYTES).count() == 0
