"""Lines, near copies and passages against plain evaluations."""

import collections
import random

import numpy as np
import xxhash  # noqa: F401
from pyspark.sql import functions as F

from glyphmere.llm import _common, chosen_path, compact_windows, components, line_suffixes
from glyphmere.llm._shingles import shingle_sets

A, B, C = "A" * 60, "B" * 60, "C" * 60
TEXTS = [(None, f"{A}\n{B}\nq", 1), (None, None, 2), (5, f"z\n{A}\n{B}", 3), (5, "", 4), (7, "q\n" * 300, 5), (7, "q\n" * 300, 5), (8, f"{B}\n{A}\n{C}", 6)]


def plain_runs(docs, min_lines, min_chars):
    """From the definition: (first, end, of, of_line) of the maximal runs that begin at an earlier place too; docs: (id, lines) by id."""
    places = [(i, p) for i, (_, ls) in enumerate(docs) for p in range(len(ls))]
    by_line = collections.defaultdict(list)
    longest = {}
    for i, p in places:
        best = (0, None)
        for j, q in by_line[docs[i][1][p]]:
            n = 0
            while p + n < len(docs[i][1]) and q + n < len(docs[j][1]) and docs[i][1][p + n] == docs[j][1][q + n]:
                n += 1
            best = (n, (docs[j][0], q)) if n > best[0] else best
        longest[i, p] = best
        by_line[docs[i][1][p]].append((i, p))
    out = {}
    for i, (doc, ls) in enumerate(docs):
        maximal = [(p, p + n, *of) for p in range(len(ls)) for n, of in [longest[i, p]] if n and (p == 0 or longest[i, p - 1][0] <= n)]
        out[doc] = [r for r in maximal if r[1] - r[0] >= min_lines and sum(map(len, ls[r[0] : r[1]])) >= min_chars]
    return out


def runs_of(got):
    return {r.doc_id: [(x.first, x.end, x.of, x.of_line) for x in r.runs] for r in got}


def test_runs_are_those_of_the_definition(spark, sf):
    rng = random.Random(3)
    docs = []
    for i in range(60):
        if docs and rng.random() < 0.2:
            docs.append((i, list(rng.choice(docs)[1])))
            continue
        ls = [rng.choice("abcd") * rng.choice([1, 2, 30]) for _ in range(rng.randint(1, 14))]
        if docs and rng.random() < 0.6:
            src = rng.choice(docs)[1]
            a = rng.randrange(len(src))
            ls[rng.randrange(len(ls)) :] = src[a : a + rng.randint(1, 9)] + ls[:3]
        docs.append((i, ls))
    df = spark.createDataFrame([(i, "\n".join(ls)) for i, ls in docs], "doc_id long, text string")
    for m, chars in ((1, 1), (2, 40)):
        assert runs_of(line_suffixes.dedup(df, m, chars).collect()) == plain_runs(docs, m, chars)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = line_suffixes.dedup(df).collect()
    assert runs_of(got) == plain_runs(sorted((r.doc_id, r.text.split("\n")) for r in got), 1, 100)
    for r in got:
        gone = {k for x in r.runs for k in range(x.first, x.end)}
        assert r.rest == "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone) and r.n_cut == len(gone)


def test_runs_of_two_sources_are_not_one(spark):
    a, b, c = "A" * 40, "B" * 40, "C" * 40
    df = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}")], "doc_id long, text string")
    assert not any(r.runs for r in line_suffixes.dedup(df).collect())
    assert runs_of(line_suffixes.dedup(df, min_chars=80).collect())[3] == [(0, 2, 1, 0), (1, 3, 2, 0)]


def test_very_common_lines(spark, monkeypatch):
    rows = [(i, f"common\nline {i % 50}\ncommon") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = runs_of(line_suffixes.dedup(df, min_chars=1).collect())
    monkeypatch.setattr(_common, "OFTEN", 1)  # common lines are joined apart
    assert runs_of(line_suffixes.dedup(df, min_chars=1).collect()) == want == plain_runs([(i, t.split("\n")) for i, t in rows], 1, 1)


def test_line_edges(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, runs int")
    got = line_suffixes.dedup(df).collect()
    assert len(got) == len(TEXTS)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id, r.n_lines].add((r.n_cut, r.rest))
    assert by[None, 3] == {(0, f"{A}\n{B}\nq")} and by[None, 0] == {(0, None)} and by[5, 3] == {(2, "z")}
    assert by[7, 301] == {(299, "q\n")} and by[8, 3] == {(0, f"{B}\n{A}\n{C}")}
    assert line_suffixes.dedup(df.limit(0)).count() == 0
    long = "x" * 3_000_000 + "\n" + "y z " * 500_000
    many = spark.createDataFrame([("a", long), ("b", long), ("c", "q\n" + long)], "doc_id string, text string")
    assert {r.doc_id: r.n_cut for r in line_suffixes.dedup(many).collect()} == {"a": 0, "b": 2, "c": 2}


def test_suffix_array_is_sorted(spark):
    df = spark.createDataFrame([(i, "\n".join("abca"[(i + k * k) % 4] for k in range(n))) for i, n in enumerate((1, 5, 9, 9, 16))] + [(9, "a\na\na\na"), (10, "a\na\na\na")], "doc_id long, text string")
    ids = {r.line: r.h for r in spark.createDataFrame([(c,) for c in "abc"], "line string").select("line", F.xxhash64("line").alias("h")).collect()}
    text = {r.doc_id: [ids[x] for x in r.text.split("\n")] for r in df.collect()}
    rows = sorted(line_suffixes.suffix_array(df).collect(), key=lambda r: r.order)
    keys = [text[r.doc.id][r.pos :] for r in rows]
    assert keys == sorted(keys) and len(keys) == sum(map(len, {tuple(t) for t in text.values()}))


def plain_classes(ids, texts, threshold=0.8):
    sets = [set(s.tolist()) for s in shingle_sets([(t or "").encode() for t in texts])]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (common and common >= threshold * (len(sets[i]) + len(sets[j]) - common)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


def test_classes_are_those_of_all_pairs(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    src = df.toPandas()
    got = {r.doc_id: r.class_id for r in chosen_path.join(df).collect()}
    assert got == plain_classes(src.doc_id.tolist(), src.text.tolist())


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 7)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 3)):
            w[k] = f"v{rng.integers(0, 5)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{i}" for i in range(40))] * 3 + ["one two", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in chosen_path.join(df).collect()}
    assert got == plain_classes(list(range(len(texts))), texts)


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = []
    for v in "wxyz":
        for _ in range((2, 9, 23, 31)["wxyz".index(v)]):
            w = [f"{v}{i}" for i in range(60)]
            for k in rng.integers(0, 60, rng.integers(0, 3)):
                w[k] = f"e{rng.integers(0, 5)}"
            texts.append(" ".join(w))
    texts += texts[-3:]
    sets = [frozenset(s.tolist()) for s in shingle_sets([t.encode() for t in texts])]
    want = {i: sum(len(a & b) >= 0.8 * len(a | b) for b in set(sets) if b != a) for i, a in enumerate(sets)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (2000, 7):
        monkeypatch.setattr(chosen_path, "BLOCK", block)
        got = chosen_path.join(df).collect()
        assert {r.doc_id: r.n_links for r in got} == want and {r.doc_id: r.class_id for r in got} == plain_classes(list(want), texts)
    many = [np.unique(rng.integers(0, 900, 60).astype(np.uint64)) for _ in range(150)]  # rare and frequent shingles
    counts = chosen_path.common_counts(many)
    assert all(counts[i, j] == len(np.intersect1d(many[i], many[j])) for i in range(150) for j in range(i))


def test_join_edges(spark):
    rows = [(None, "a b c d e f g", 1), (None, None, 2), (5, "x y z", 3), (5, "", 4), (7, "short", 5), (8, "short", 5), (8, "short", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = chosen_path.join(df).toPandas()
    assert len(got) == 7 and sorted(got[got.doc_id.isin([7, 8])].n_class) == [3, 3, 3]
    assert chosen_path.deduplicated(df).count() == 4 and chosen_path.deduplicated(df).columns == df.columns
    assert chosen_path.join(df.limit(0)).count() == 0
    assert chosen_path.survival(0.8) > 0.93 and (1 - chosen_path.survival(0.8)) ** chosen_path.runs_needed(0.8, 0.999) < 0.001


def test_buckets_are_compared_or_split(monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    rng = np.random.default_rng(3)
    paths = np.repeat(np.arange(9), [1, 2, 3, 4, 5, 1, 40, 2, 4])
    tokens = rng.integers(0, 1 << 32, (len(paths), 64)).astype(np.uint32)
    tokens[1] = tokens[2]
    tokens[5, :40], tokens[3, :30] = tokens[4, :40], tokens[4, :30]
    keys = np.arange(len(paths))
    for last in (False, True):
        got = [r for b in chosen_path.bucket_rows(paths, keys, tokens, 32, last) for r in b.to_pylist()]
        small = {(r["key"], r["b"]) for r in got if r["b"] is not None and r["path"] not in (4, 6)}
        assert small == {(2, 1), (5, 4)}
        rest = [r for r in got if r["path"] in (4, 6)]
        if last:
            assert {(r["key"], r["b"]) for r in rest} == {(k, 10) for k in range(11, 15)} | {(k, 16) for k in range(17, 56)}
        else:
            assert [r["key"] for r in rest] == [*range(10, 15), *range(16, 56)] and all(r["tokens"] == tokens[r["key"]].tobytes() for r in rest)
    assert chosen_path.least_agreement(0.8) == 32 and chosen_path.least_agreement(0.05) == 1


def test_large_buckets_over_several_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = []
    for v in "wx":
        for _ in range(70):
            w = [f"{v}{i}" for i in range(80)]
            w[int(rng.integers(0, 80))] = f"e{rng.integers(0, 50)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain_classes(list(range(len(texts))), texts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.doc_id: r.class_id for r in chosen_path.join(df).collect()} == want
        monkeypatch.setattr(_common, "OFTEN", 20)  # very large buckets aren't brought together
        assert {r.doc_id: r.class_id for r in chosen_path.join(df).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (7, 7), (None, 1), (20, 21), (21, 22), (22, 20)] + [(100, k) for k in range(101, 140)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20} | {k: 100 for k in range(100, 140)}


def test_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, width = int(rng.integers(1, 90)), int(rng.integers(1, 14))
        h = rng.integers(0 if rng.random() < 0.3 else 1, rng.integers(2, 60), n).astype(np.uint32)
        want = set()

        def tree(lo, hi):
            if lo > hi:
                return
            c = lo + int(h[lo : hi + 1].argmin())
            if h[c] > 0 and hi - lo + 1 >= width:
                want.add((c, lo, hi))
            tree(lo, c - 1)
            tree(c + 1, hi)

        tree(0, n - 1)
        c, lo, hi = compact_windows.window_bounds(h, width)
        assert set(zip(c.tolist(), lo.tolist(), hi.tolist())) == want


def test_repeats_are_found_and_nothing_else(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(5000)]
    word = lambda n: [vocab[i] for i in rng.integers(0, 5000, n)]
    exact, near, short = word(60), word(80), word(40)
    changed = list(near)
    changed[40] = "other"
    docs = [word(30) + exact + word(20), word(90) + near, word(10) + exact + word(50) + exact, changed + word(30), word(25) + short, short + word(60), word(200)]
    df = spark.createDataFrame([(i, " ".join(d), "x") for i, d in enumerate(docs)], "doc_id long, text string, rest string")
    got = {r.doc_id: r for r in compact_windows.find_repeats(df).collect()}
    spans = {i: [(s.first, s.end) for s in r.repeats] for i, r in got.items()}
    assert spans == {0: [], 1: [], 2: [(10, 70), (120, 180)], 3: [(0, 80)], 4: [], 5: [], 6: []}
    assert got[2].rest.split() == docs[2][:10] + docs[2][70:120] and got[6].rest == " ".join(docs[6])


def plain_parts(a, b, chain, least, threshold):
    good = {}
    for i, (x, y, _) in enumerate(chain):
        for j, (u, v, n) in list(enumerate(chain))[i:]:
            s = compact_windows.jaccard(a[x : u + n], b[y : v + n])
            if u + n - x >= least and s >= threshold:
                good[x, u + n] = s
    return [(x, e, s) for (x, e), s in sorted(good.items()) if not any((p, q) != (x, e) and p <= x and e <= q for p, q in good)]


def test_parts_of_a_chain_below_the_threshold(spark):
    vocab = [f"w{i}" for i in range(5000)]
    rng = np.random.default_rng(6)
    word = lambda n: [vocab[i] for i in rng.integers(0, 5000, n)]
    near, phrase = word(80), word(5)
    changed = near[:40] + ["other"] + near[41:]
    docs = [near + word(10) + phrase + word(20), changed + word(10) + phrase + word(30)]
    got = {r.doc_id: r for r in compact_windows.find_repeats(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()}
    assert [(s.first, s.end) for s in got[1].repeats] == [(0, 80)] and got[0].repeats == []
    some = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 32, 300).astype(np.uint32)
        b, at, chain = a.copy(), 0, []
        while at < 270:
            n = int(rng.integers(5, 40))
            chain.append((at, at, min(n, 300 - at)))
            at += n + (gap := int(rng.integers(1, 13)))
            b[at - gap : at] += 1
        if rng.random() < 0.3:  # words that repeat in both
            a[5:25] = b[5:25] = a[60:80]
        got = compact_windows.passages(a, b, 0, chain, 50, 0.8)
        assert [g[:2] for g in got] == [w[:2] for w in plain_parts(a, b, chain, 50, 0.8)]
        assert all(abs(g[2] - compact_windows.jaccard(a[g[0] : g[1]], b[g[0] : g[1]])) < 1e-9 for g in got)
        some += len(got) > 1
    assert some


def test_many_interleaved_diagonals():
    a = np.arange(1000, 1200, dtype=np.uint32)
    b = np.concatenate([a[:30], a[31:60], np.zeros(140, np.uint32)])
    pieces = [(0, b, [(0, 0, 30), (1, 31, 60)])]
    for k in range(6):  # short runs on other diagonals begin between the two halves
        b[100 + 12 * k : 106 + 12 * k] = a[24 + k : 30 + k]
        pieces[0][2].append((24 + k - (100 + 12 * k), 24 + k, 30 + k))
    assert [r[:2] for r in compact_windows.repeats(a, pieces, 50, 0.8, False)] == [(0, 60)]


def test_exact_passages_never_stay_twice(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = compact_windows.find_repeats(df).toPandas().sort_values("doc_id")
    seen, twice = {}, 0
    for i, t in zip(got.doc_id, got.rest):
        w = t.lower().encode().split()
        for k in range(len(w) - 59):
            key = tuple(w[k : k + 60])
            j = seen.setdefault(key, (i, k))
            twice += j[0] != i
    assert twice == 0


def test_passage_edges(spark):
    p = " ".join(f"w{i}" for i in range(70))
    rows = [(None, p, 1), (None, None, 2), (5, "x " * 20 + p + " y z", 3), (5, "", 4), (7, p + " q " + p, 5), (9, "loop it " * 200, 1), (10, "loop it " * 100, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = {(r.doc_id, r.k): r.n_cut for r in compact_windows.find_repeats(df).collect()}
    assert got[None, 1] == 0 and got[None, 2] == 0 and got[5, 3] == 70 and got[7, 5] == 140 and got[10, 1] == 200 and got[5, 4] == 0
    assert compact_windows.find_repeats(df.limit(0)).count() == 0


def stock_passages(rng, n):
    """Passages of 80 words, each another order of 8 of 12 stock sentences of 10 words."""
    sentences = [[f"s{k}w{i}" for i in range(10)] for k in range(12)]
    orders = set()
    while len(orders) < n:
        orders.add(tuple(rng.permutation(12)[:8].tolist()))
    return [[w for k in o for w in sentences[k]] for o in sorted(orders)]


def around(rng, words):
    return [f"v{i}" for i in rng.integers(0, 5000, 30)] + words + [f"v{i}" for i in rng.integers(0, 5000, 30)]


def test_every_repeat_among_stock_sentences_is_cut(spark):
    rng = np.random.default_rng(8)
    passages = stock_passages(rng, 300)
    later = [passages[k] for k in rng.permutation(300)]
    docs = [around(rng, p) for p in passages + later]
    got = compact_windows.find_repeats(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    for r in got:
        cut = {k for s in r.repeats for k in range(s.first, s.end)}
        if r.doc_id >= 300:
            assert set(range(30, 110)) <= cut
    grams = {}  # from the definition: the places that runs of 50 equal words cover, if the run stands earlier
    for r in sorted(got):
        w, must = r.text.split(), set()
        for k in range(len(w) - 49):
            must |= set(range(k, k + 50)) if grams.setdefault(tuple(w[k : k + 50]), (r.doc_id, k)) != (r.doc_id, k) else set()
        assert must <= {k for s in r.repeats for k in range(s.first, s.end)}


def test_recall_of_changed_passages_that_share_phrases(spark):
    rng = np.random.default_rng(9)
    passages = stock_passages(rng, 300)
    changed = []
    for k in rng.permutation(300):
        words = list(passages[k])
        words[rng.integers(5, 75)] = f"x{k}"  # no run of 80 words is left
        if rng.random() < 0.5:
            words[rng.integers(0, 4)] = f"y{k}"
        changed.append(words)
    docs = [around(rng, p) for p in passages + changed]
    got = {r.doc_id: r for r in compact_windows.find_repeats(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()}
    sets = [set(shingle_sets([" ".join(p).encode()])[0].tolist()) for p in passages + changed]
    want = [j for j in range(300, 600) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(300))]
    found = sum(sum(s.end - s.first for s in got[j].repeats) >= 64 for j in want)
    assert len(want) > 200 and found >= 0.95 * len(want)


def test_other_ids_and_columns(spark):
    p = " ".join(f"w{i}" for i in range(70))
    rows = [("b", p, "u", 1), ("a", "x " * 20 + p, "v", 2), (None, p + " z", "w", 3), ("b", "other text " + p, None, 4)]
    got = {(r.doc_id, r.k__2): r for r in compact_windows.find_repeats(spark.createDataFrame(rows, "doc_id string, text string, doc string, k__2 int")).collect()}
    assert {k: r.n_cut for k, r in got.items()} == {(None, 3): 0, ("a", 2): 70, ("b", 1): 70, ("b", 4): 70}
    assert got["a", 2].doc == "v" and got["a", 2].repeats[0].of is None and got["b", 1].repeats[0].of in ("a", None)
    long = " ".join(f"w{i % 40_000}" for i in range(90_000))
    for within in (False, True):
        got = {r.doc_id: r.n_cut for r in compact_windows.find_repeats(spark.createDataFrame([(1, long), (2, "q " + long)], "doc_id int, text string"), within=within).collect()}
        assert got == {1: 50_000 if within else 0, 2: 90_000}


def test_parts_of_large_groups_give_every_equal_run(spark, monkeypatch):
    rng = np.random.default_rng(10)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(60):
        w = list(base)
        for k in rng.integers(0, 400, 9):
            w[k] = f"e{rng.integers(0, 4)}"
        a = int(rng.integers(0, 300))
        docs.append(w[a : a + 100])
    got = sorted(compact_windows.find_repeats(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect())
    seen, some = {}, 0
    for r in got:
        w = r.text.split()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), (r.doc_id, k)) != (r.doc_id, k):
                some += 1
                assert any(s.first <= k and k + 50 <= s.end for s in r.repeats)
    assert some > 100


def test_own_repeats_are_left_unless_asked_for(spark):
    p = " ".join(f"w{i}" for i in range(70))
    df = spark.createDataFrame([(1, p + " q " + p), (2, "other words"), (3, "x " + p)], "doc_id long, text string")
    assert {r.doc_id: r.n_cut for r in compact_windows.find_repeats(df).collect()} == {1: 0, 2: 0, 3: 70}
    assert {r.doc_id: r.n_cut for r in compact_windows.find_repeats(df, within=True).collect()} == {1: 70, 2: 0, 3: 70}


def crowd(rng, n):
    """Documents 0..n-1 and n..2n-1: the second's passage k is the first's with a word changed. Passages are 6 words of their own and 44 that all share."""
    stock = [f"s{i}" for i in range(44)]
    first = [[f"own{k}_{i}" for i in range(6)] + stock for k in range(n)]
    changed = [p[:22] + [f"x{k}"] + p[23:] for k, p in enumerate(first)]
    return [[f"v{i}" for i in rng.integers(0, 5000, 30)] + p + [f"v{i}" for i in rng.integers(0, 5000, 30)] for p in first + changed]


def test_changed_passages_of_large_groups_meet_every_earlier_member(spark, monkeypatch):
    docs = crowd(np.random.default_rng(11), 40)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    want = {40 + k: [(30, 80, k)] for k in range(40)}
    for alone, block in ((2_000, 8_192), (7, 5)):  # groups shared out, members compared in blocks
        monkeypatch.setattr(compact_windows, "ALONE", alone)
        monkeypatch.setattr(compact_windows, "BLOCK", block)
        monkeypatch.setattr(compact_windows, "FIRST_BLOCK", min(block, 64))
        got = {r.doc_id: [(s.first, s.end, s.of) for s in r.repeats] for r in compact_windows.find_repeats(df).collect()}
        assert all(got[k] == [] for k in range(40))
        assert {k: got[k] for k in want} == want


def test_members_of_a_group_against_all_pairs(monkeypatch):
    monkeypatch.setattr(compact_windows, "FIRST_BLOCK", 4)
    rng = np.random.default_rng(12)
    for case in range(30):
        n, m = int(rng.integers(9, 40)), 149
        near = rng.integers(1, 1 << 32, (n, m)).astype("<u4")
        stock = rng.integers(1, 1 << 32, (3, m)).astype("<u4")
        for row in near:
            a, b = np.sort(rng.integers(0, m + 1, 2))
            row[a:b] = stock[rng.integers(0, 3), a:b]
            row[rng.integers(0, m, 4)] = stock[0, :4]
            if case % 3 == 0:  # moved: the same shingles at other places
                row[:] = np.roll(row, int(rng.integers(-1, 2)))
            row[: rng.integers(0, 20)] = 0
        docs = np.sort(rng.integers(0, n, n))
        for within in (False, True):
            got = compact_windows.alike(near, docs, 50, 0.8, within)
            assert sorted(got) == sorted(p for t in range(3) for p in compact_windows.alike(near, docs, 50, 0.8, within, t, 3))
            kept = {}
            for i, j in got:
                kept.setdefault(i, []).append(j)
            for i in range(n):
                mine = set(near[i].tolist()) - {0}
                need = 0.8 * (46 - (np.count_nonzero(near[i]) - len(mine)))
                for j in range(i):
                    if not within and docs[i] == docs[j]:
                        continue
                    both = mine & set(near[j].tolist())
                    if len(both) >= max(need, 1):
                        places = [p for p in range(m) if near[j, p] in both]
                        mine_at = [p for p in range(m) if near[i, p] in both]
                        inside = {p for e in kept.get(i, []) for x, y in compact_windows._level_repeats((near[i] == near[e]) & (near[i] != 0), near[i], near[e], 50, 0.8) for p in range(x, y)}
                        assert set(range(mine_at[0], mine_at[-1] + 1)) <= inside or any((near[e, places] == near[j, places]).all() for e in kept.get(i, []))


def test_changed_copies_of_a_passage_that_its_document_repeats(spark):
    p = [f"w{i}" for i in range(80)]
    changed = p[:40] + ["x"] + p[41:]
    own = [[f"{c}{i}" for i in range(20)] for c in "abc"]
    df = spark.createDataFrame([(1, " ".join(own[0] + changed)), (2, " ".join(p + own[1] + own[2] + own[0][:9] + own[1][:9] + p))], "doc_id long, text string")
    assert {r.doc_id: r.n_cut for r in compact_windows.find_repeats(df).collect()} == {1: 0, 2: 160}


def test_pipeline_cuts_changed_passages_of_large_groups(spark):
    import corpus_pipeline

    docs = crowd(np.random.default_rng(13), 30)
    df = spark.createDataFrame([(i, " ".join(d), len(" ".join(d))) for i, d in enumerate(docs)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.passages(spark, df, "").collect()}
    assert {k: r.text.split() for k, r in got.items()} == {k: d if k < 30 else d[:30] + d[80:] for k, d in enumerate(docs)}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_members_compared_at_once_leave_no_passage_out(monkeypatch):
    """What ``alike`` and the chains of words find for a member lies in passages of the partners that ``like_members`` gives it; partners don't grow with the group."""
    monkeypatch.setattr(compact_windows, "AT_ONCE", 200)
    rng = np.random.default_rng(14)
    for case in range(12):
        base, members = [f"s{i}" for i in range(148)], []
        for k in range(60):
            w = [f"o{k}_{i}" for i in range(148)]
            a, b = int(rng.integers(10, 60)), int(rng.integers(90, 146))
            w[a:b] = base[a:b]
            at = int(rng.integers(a, b))
            if k % 3 == 1:
                w[at] = f"e{k % 4}"
            elif k % 3 == 2:
                w = w[: at + 1] + [f"e{k % 4}"] + w[at + 1 : -1]
            if case % 3 == 0 and k % 5 == 0:
                w[100:] = ["y"] * 48
            members.append(w)
        number = {}
        words = np.array([[number.setdefault(x, len(number)) for x in w] for w in members], np.uint64)
        near = np.array([(compact_windows.shingles(compact_windows.mixed(w))[:144] >> np.uint64(32)).astype("<u4") | np.uint32(1) for w in words])
        docs = np.arange(60)
        got = compact_windows.like_members(near, docs, 50, 0.8)
        assert len(got) == len({tuple(r) for r in got.tolist()}) and len({(i, j) for i, j, _ in got.tolist()}) <= 4 * 60
        both = np.concatenate([compact_windows.like_members(near, docs, 50, 0.8, False, t, 3) for t in range(3)])
        assert {i for i, _, _ in both.tolist()} == {i for i, _, _ in got.tolist()}
        found = [np.zeros(148, bool) for _ in docs]
        for i, j in {(i, j) for i, j, _ in got.tolist()}:
            lines = [(-int(d), 74, 74) for x, y, d in got if (x, y) == (i, j)]
            for x, y, _ in compact_windows.repeats(words[i], [(0, words[j], lines)], 50, 0.8, False):
                found[i][x:y] = True
        for i, j in compact_windows.alike(near, docs, 50, 0.8):
            for x, y, _ in compact_windows.repeats(words[i], [(0, words[j], [(0, 74, 74)])], 50, 0.8, False):
                assert found[i][x:y].all()
