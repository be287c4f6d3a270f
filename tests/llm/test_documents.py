"""Fingerprints, quality rules, license scans, and the pipeline."""

import collections
import hashlib
import math
import re

import numpy as np
from oracle_check import compare
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmere.llm import fingerprints as fp
from glyphmere.llm import chosen_path, host_rules, license_scan, packing, queries
from glyphmere.llm._common import stored

ODD = [(None, "a" * 300, 1), (None, None, 2), (5, "x y z " * 60, 3), (5, "", 4), (7, "short", 5)]
SCHEMA = "doc_id long, text string, score int"


def test_window_entropy():
    data = np.frombuffer(open(fp.__file__, "rb").read(), np.uint8)
    got = fp.window_entropy(data)
    for p in range(0, len(data) - 64, 997):
        h = -sum(v / 64 * math.log2(v / 64) for v in collections.Counter(data[p : p + 64].tolist()).values()) * 1000 / 6
        assert abs(got[p] - h) < 4


def plain_entropies(t):
    """Of each 64-byte window, in thousandths of 6 bits, as whole numbers that may be one off."""
    out, count = [], collections.Counter(t[:64])
    for p in range(len(t) - 63):
        out.append(-sum(v / 64 * math.log2(v / 64) for v in count.values() if v) * 1000 / 6)
        if p + 64 < len(t):
            count[t[p]] -= 1
            count[t[p + 64]] += 1
    return out


def plain_selected(t, ranks):
    """From the definition: places of the windows that are the rarest of 16 runs of 64 windows or more."""
    e = fp.window_entropy(np.frombuffer(t, np.uint8))[: len(t) - 63]
    assert all(abs(x - y) < 4 for x, y in zip(e.tolist(), plain_entropies(t)))
    rank = [int(ranks[x]) for x in e]
    points = collections.Counter()
    for a in range(len(rank)):
        run = rank[a : a + 64]
        if max(run):
            points[a + run.index(max(run))] += 1
    return sorted(p for p, n in points.items() if n >= 16)


def test_selected_features_are_those_of_the_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text.encode() for r in docs.select("text").collect()]
    ranks, counts = fp.rarity(docs), collections.Counter()
    for t in texts:
        if len(t) >= 64:
            counts.update(fp.window_entropy(np.frombuffer(t, np.uint8))[: len(t) - 63].tolist())
    order = sorted(range(fp.ENTROPIES), key=lambda e: (-counts[e], e))
    assert all(ranks[e] == min(k + 1, 1023) for k, e in enumerate(order) if e >= fp.LEAST) and not ranks[: fp.LEAST].any()
    for t in [t for t in texts if 64 <= len(t) < 3000][:40]:
        got = fp.select_features(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), ranks)
        assert got.tolist() == plain_selected(t, ranks)


def test_features_do_not_depend_on_neighbours(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ranks = fp.rarity(docs)
    texts = [t.encode() for (t,) in docs.select("text").limit(60).collect()]
    together = [fp.as_text(f) for f in fp.filters_of(texts, ranks)]
    assert together == [fp.as_text(fp.filters_of([t], ranks)[0]) for t in texts]
    assert all(np.array_equal(fp.from_text(fp.as_text(f)), f) for f in fp.filters_of(texts, ranks))
    rng = np.random.default_rng(0)
    long = bytes(rng.integers(97, 123, 5 << 20, np.uint8))  # over the size that is cut
    once, twice = fp.filters_of([long], ranks)[0], fp.filters_of([long, b"x"], ranks)[0]
    assert np.array_equal(once, twice) and len(once) > 100
    constant = [fp.filters_of([b"a" * n], ranks)[0] for n in (100, 1 << 20, 3 << 20)]
    assert all(len(f) == 1 and np.array_equal(f, constant[0]) for f in constant)
    cut = [b"x" * 70, long[:3_000_000], b"", long[:10]]
    assert fp.entropy_counts(cut).sum() == 7 + 3_000_000 - 63
    assert np.array_equal(fp.entropy_counts([long[:3_000_000]]), np.bincount(fp.window_entropy(np.frombuffer(long[:3_000_000], np.uint8))[:-63], minlength=fp.ENTROPIES))


def test_op3(spark, sf):
    got = queries.op3_fingerprints(spark, sf).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    src = docs.toPandas().sort_values("doc_id")
    texts = src.text.tolist()
    follow = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, follow)]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    assert got.n_chars.tolist() == [len(t) for t in texts]
    own = [fp.as_text(f) for f in fp.filters_of([t.encode() for t in texts], fp.rarity(docs))]
    assert got.fingerprint.tolist() == own
    assert got.near_edited.median() > 0.5 and got.near_next.median() < 0.05


def test_fingerprint_edges(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = fp.with_next(df).collect()
    assert len(got) == 5 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.with_next(df.limit(0)).count() == 0
    assert fp.with_next(df.where("doc_id = 7")).first().near_next == 1.0
    assert {r.fingerprint for r in fp.fingerprints(df.where("text = '' or text is null")).collect()} == {"0:"}


def plain_facts(t):
    words = re.findall("[^\x20\x09-\x0d]+", t)
    n = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), again, len(covered)


def test_facts():
    rng = np.random.default_rng(2)
    for _ in range(300):
        t = "".join(rng.choice(list("ab é \n\t#*$|<"), rng.integers(0, 60)))
        assert host_rules.text_facts(t.encode()) == plain_facts(t)


def test_op4_is_its_sql(spark, sf):
    compare(spark, sf, "op4", queries.op4_host_rules, queries.ORACLE_SQL["op4_host_rules"])


def test_bad_host_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 10 else "few", "clean") for i in range(100)] + [(200 + i, "few" if i % 10 else good, "spam") for i in range(100)] + [(900, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = host_rules.rules(df).collect()
    assert {r.host: r.host_failed for r in got} == {"clean": False, "spam": True, None: False}
    assert sum(r.kept for r in got) == 91
    assert host_rules.rules(spark.createDataFrame(ODD, SCHEMA)).count() == 5
    assert host_rules.rules(df.limit(0)).count() == 0


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(1, "x (Released under the MIT license) y. " + mit.replace("free of charge", "gratis"), 1), (2, "Licensed under the Apache License, Version 2.0.\nfoo bar", 2), (3, "the of and to " * 50, 3), (None, None, 4), (5, "", 5), (6, "word " * 3000 + mit + " word" * 3000 + " " + mit, 6)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, template int")).collect()
    found = {(r.doc_id, r.template, r.first_word): r for r in got}
    assert set(found) == {(1, "MIT-notice", 1), (1, "MIT", 7), (2, "Apache-2.0-notice", 0), (6, "MIT", 3000), (6, "MIT", 6000 + len(mit.split()))}
    assert found[1, "MIT", 7].coverage < 1 and found[6, "MIT", 3000].end_word == 3000 + len(mit.split())
    assert license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, template int").limit(0)).count() == 0


def plain_matches(words, template, least=0.8):
    """Whether a stretch of the words is the template but for few edits: the least edits of the template to any stretch, by the full table."""
    row = [0] * (len(words) + 1)
    for i, t in enumerate(template, 1):
        new = [i]
        for j, w in enumerate(words, 1):
            new.append(min(row[j - 1] + (t != w), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) <= (1 - least) * len(template)


def test_altered_notices_are_found(spark):
    rng = np.random.default_rng(7)
    words = license_scan.TEMPLATES["MIT"].split()
    docs = []
    for k in range(60):
        text = list(words)
        for _ in range(k // 4):  # up to 14 changed, lost or added words
            at = int(rng.integers(0, len(text)))
            text[at : at + int(rng.integers(0, 2))] = [f"x{at}"] if rng.random() < 0.7 else []
        docs.append(["before"] * int(rng.integers(0, 30)) + text + ["after"] * int(rng.integers(0, 30)))
    docs += [[f"y{i}" for i in rng.integers(0, 300, 200)] for _ in range(10)]
    got = {(r.doc_id, r.template): r.coverage for r in license_scan.scan(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()}
    like = [i for i, d in enumerate(docs) if plain_matches([w.lower() for w in d], [w.lower() for w in words])]
    assert len(like) >= 55 and all((i, "MIT") in got for i in like)
    assert not any(i >= 60 for i, _ in got)


def test_adjacent_notices_are_all_found(spark):
    names = ("MIT-notice", "Apache-2.0-notice", "CC-BY-NC-4.0-notice")
    rows, want = [], set()
    for k, (name, n) in enumerate([(x, n) for x in names for n in (1, 2, 3, 4, 7, 1000)]):
        size = len(license_scan.TEMPLATES[name].split())
        rows.append((k, "\n".join(["some words before"] + [license_scan.TEMPLATES[name]] * n)))
        want |= {(k, name, 3 + size * i, 3 + size * (i + 1)) for i in range(n)}
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.template, r.first_word, r.end_word) for r in got) == sorted(want)


def test_every_notice_is_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.template) for r in queries.op5_license_scan(spark, sf).collect()}
    for r in docs.collect():
        for name, text in license_scan.TEMPLATES.items():
            assert text not in r.text or (r.doc_id, name) in got


def test_language_stage_keeps_mixed_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = {}
    for r in docs.where("lang is not null and n_chars > 1000").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(" ".join(r.text.split()[:60]))
    two, three = (" ".join(by[x][0] for x in sorted(by)[:n]) for n in (2, 3))
    new = spark.createDataFrame([(-1, two, None, "s", len(two)), (-2, three, None, "s", len(three)), (-3, "12 34 " * 30, None, "s", 180)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(new), sf).where("doc_id < 0").collect()}
    assert kept == {-1, -2}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, bare, sf).count() == docs.count()


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "passages", "packing"]
    docs = source = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == source.columns
        sizes.append(docs.count())
        assert docs.where("n_chars <> length(text)").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.8 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "thing the and " * 40, "en", "s", 560), (2, "thing the and " * 40, "en", "s", 560), (3, "12 34", None, None, 5), (4, "das und nicht " * 40, "de", "s", 560), (5, "x" * 200_000 + " the and" * 30_000, "en", "s", 440_000)], source.schema)
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        assert got.columns == source.columns and got.schema == source.schema
        counts[name] = got.count()
        assert stage(spark, odd.limit(0), sf).count() == 0
    assert counts == {"language": 4, "lines": 7, "near_copies": 5, "passages": 7}
    packed = corpus_pipeline.packed(spark, odd, sf)
    assert packed.select("doc_id", "piece").where("piece = 0").count() == 7 and corpus_pipeline.packed(spark, odd.limit(0), sf).count() == 0


def test_stages_pass_on_other_columns(spark, sf):
    names = ["k__", "runs", "rest", "doc", "n_cut", "repeats", "lang_pred", "word_score", "row"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").drop("n_chars")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and got.count() > 100
        assert got.where(" or ".join(f"{x} <> concat('{x}', doc_id)" for x in names)).count() == 0
    assert corpus_pipeline.packed(spark, docs, sf).count() >= docs.count()


def test_copies_that_differ_in_other_columns(spark):
    rows = [(1, "a b c d e f g", x) for x in "zyx"] + [(2, "a b c d e f g", "w")]
    first = {tuple(chosen_path.deduplicated(spark.createDataFrame(part, "doc_id long, text string, lang string")).collect()) for part in (rows, rows[::-1])}
    assert len(first) == 1 and len(first.pop()) == 1


def test_very_long_texts(spark):
    words = " ".join(f"w{i % 7919}" for i in range(400_000))
    df = spark.createDataFrame([(1, words, "s"), (2, words + " end", "s"), (3, "", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in fp.with_next(df).collect()}
    assert got[1].n_chars == len(words) and got[1].near_next > 0.9
    facts = {r.doc_id: r for r in host_rules.rules(df).collect()}
    assert facts[1].n_words == 400_000 and facts[1].n_repeat_words == 400_000
    assert {r.doc_id: r.class_id for r in chosen_path.join(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert packing.pack(df.select("doc_id", "text"), queries.tokenizer_file("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).where("n > 400000").count() == 2
