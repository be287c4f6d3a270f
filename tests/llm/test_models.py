"""Language model and language labels."""

import collections
import functools
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmere.llm import katz, language_crf, queries

ODD = [(None, "a b", 1), (None, None, 2), (5, "a B", 3), (5, "", 4), (9, "x" * 50_000 + " " + "y z " * 20_000, 5)]
SCHEMA = "doc_id long, text string, score int"


def good_turing(counts):
    """Katz's factors from the counts of counts, in fractions: discounted counts r* = (r + 1) n[r + 1] / n[r], less the part left to counts above 5."""
    n = collections.Counter(counts)
    d = {}
    for r in range(1, 6):
        if not (n[1] and n[r] and n[r + 1]) or 6 * n[6] >= n[1]:
            d[r] = Fraction(1)
            continue
        above = Fraction(6 * n[6], n[1])
        d[r] = (Fraction((r + 1) * n[r + 1], n[r] * r) - above) / (1 - above)
        if not 0 < d[r] <= 1:
            d[r] = Fraction(1)
    return lambda c: c * d.get(c, 1)


def plain_scores(docs):
    """The definition, by dictionaries and fractions: (tokens, known, base, score) of (text, learned) rows."""
    tokens = [[*(t or "").encode().lower().split(), "end"] for t, _ in docs]
    tables = [collections.Counter() for _ in range(3)]  # words, pairs, triples
    for (_, learned), ts in zip(docs, tokens):
        if learned:
            for a, b, c in zip(["start", "start", *ts], ["start", *ts], ts):
                for table, gram in zip(tables, ((c,), (b, c), (a, b, c))):
                    table[gram] += 1
    one, total = tables[0], sum(tables[0].values())
    discounted = [good_turing(t.values()) for t in tables]
    after = collections.defaultdict(list)
    for table in tables[1:]:
        for gram in table:
            after[gram[:-1]].append(gram)
    left = total - sum(map(discounted[0], one.values()))
    size, unknown = (total, left) if left else (total + 1, 1)

    @functools.cache
    def weight(context):
        table, disc = tables[len(context)], discounted[len(context)]
        count, taken = sum(table[g] for g in after[context]), sum(table[g] - disc(table[g]) for g in after[context])
        if not after[context]:
            return 1, 1.0
        count, taken = (count, taken) if taken else (count + 1, 1)
        alpha = float(Fraction(taken) / count) / (1 - sum(prob(g[1:]) for g in after[context]))
        return count, alpha

    @functools.cache
    def prob(gram):
        if len(gram) == 1:
            return float(Fraction(discounted[0](one[gram])) / size) if one[gram] else float(Fraction(unknown) / size)
        table, (count, alpha) = tables[len(gram) - 1], weight(gram[:-1])
        return float(Fraction(discounted[len(gram) - 1](table[gram])) / count) if table[gram] else alpha * prob(gram[1:])

    if total:
        assert abs(sum(map(prob, one)) + unknown / size - 1) < 1e-9
        vocabulary = [w for (w,) in one]
        for context in [c for c in after if len(vocabulary) < 4000][:: max(1, len(after) // 20)]:  # each context sums to 1
            assert abs(sum(prob((*context, w)) for w in vocabulary) + prob((*context, "never seen")) - 1) < 1e-6
    out = []
    for ts in tokens:
        s = sum(math.log10(prob(g)) for g in zip(["start", "start", *ts], ["start", *ts], ts))
        out.append((len(ts), sum((t,) in one for t in ts), sum(math.log10((one[t,] + 1) / (total + len(one) + 1)) for t in ts), s))
    return out


def test_katz_is_its_definition(spark, sf):
    src = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    got = queries.op1_katz(spark, sf).toPandas().sort_values("doc_id")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in src.doc_id]
    assert got.held_out.tolist() == held
    for w, g in zip(plain_scores([(t, not h) for t, h in zip(src.text, held)]), got.itertuples()):
        assert (g.n_tokens, g.n_known) == w[:2] and abs(g.base_score - w[2]) < 1e-7 and abs(g.score - w[3]) < 1e-7


def test_katz_edges(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = katz.score(df, F.lit(True)).toPandas()
    want = plain_scores([(t, True) for _, t, _ in ODD])
    assert sorted(round(x, 6) for x in got.score) == sorted(round(w[3], 6) for w in want)
    assert set(katz.score(df, F.lit(False)).toPandas().score) == {0.0}
    assert katz.score(df.limit(0), F.lit(True)).count() == 0


def test_held_out_accuracy(spark):
    got = queries.op7_language_crf(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = got.selectExpr("count(*)", "sum(cast(lang = lang_pred as int))").first()
    assert right / n > 0.97


def test_code_switch_and_edges(spark):
    rows = [(i, lang, t) for i, (lang, t) in enumerate([("en", "the and with that thing where from this those then"), ("de", "und nicht der die das ist auf mit eine sich")] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_crf.train(df)
    labels = [w for w, _ in language_crf.label_words(model, "the and with that thing where und nicht der die das ist".split())]
    assert labels[0] == "en" and labels[-1] == "de"
    odd = spark.createDataFrame([*ODD, (1, "12 ... %", 6)], SCHEMA)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_crf.predict(odd, model).collect()}
    assert got[None, None] == ("und", 0.0) and got[5, ""] == ("und", 0.0) and got[1, "12 ... %"] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_crf.train(df.limit(0)) is None
    assert {r.lang_pred for r in language_crf.predict(odd, None).collect()} == {"und"}
    assert language_crf.predict(odd.limit(0), model).count() == 0


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    m = language_crf.Model(["a", "b"], np.zeros((1, 2)), rng.random((2, 2)) + 0.1, np.array([0.4, 0.6]))
    pot = rng.normal(size=(5, 2))
    moves = np.zeros((2, 2))
    post = language_crf.posteriors(m, pot, np.array([0, 3]), np.array([3, 2]), moves)
    want, wm = np.zeros((5, 2)), np.zeros((2, 2))
    for s, n in ((0, 3), (3, 2)):
        paths = list(itertools.product(range(2), repeat=n))
        w = np.array([m.start[p[0]] * np.prod([np.exp(pot[s + k, y]) for k, y in enumerate(p)]) * np.prod([m.steps[x, y] for x, y in zip(p, p[1:])]) for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w):
            for k, y in enumerate(p):
                want[s + k, y] += x
            for u, v in zip(p, p[1:]):
                wm[u, v] += x
    assert np.allclose(post, want) and np.allclose(moves, wm)


def test_discounts_against_fractions():
    rng = np.random.default_rng(4)
    for _ in range(300):
        counts = rng.integers(0, 40, 8) * rng.integers(0, 2, 8) + rng.integers(0, 3, 8)
        got = katz.discounts(np.concatenate([[0], np.sort(counts)[::-1][:6]]))
        n = [0, *np.sort(counts)[::-1][:6].tolist()]
        want = good_turing([r for r in range(1, 7) for _ in range(n[r])])
        assert np.allclose(got[1:], [float(want(r)) / r for r in range(1, 6)]) and ((got > 0) & (got <= 1)).all()


def test_counts_beyond_32_bits():
    big = np.array([0, 5_000_000_000, 3, 2**62], np.uint64)
    assert katz.unboxed(katz.boxed([big, big.astype(np.float64)]), "uf")[0].tolist() == big.tolist()
    words = katz.Words(10_000_000_000, np.array([0, 4, 2, 1, 1, 1, 1]))
    assert abs(words(big[1:2])[0] - 0.5) < 1e-9


def test_katz_with_small_chunks_and_buckets(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.score for r in katz.score(df, F.col("doc_id") % 5 != 0).collect()}
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 3_000)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 4_000)
    monkeypatch.setattr(katz, "MOST_SPREAD", 20)
    got = {r.doc_id: r.score for r in katz.score(df, F.col("doc_id") % 5 != 0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_labels_that_share_an_id_are_learned(spark):
    en, de, fr = "the and with that thing where from", "und nicht der die das ist auf", "le la les dans pour avec sur"
    rows = [(None, "en", en), (None, "de", de), (7, "fr", fr), (7, "en", en + " this"), (7, "fr", fr)]
    model = language_crf.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.languages == ["de", "en", "fr"]
    assert [language_crf.predict_batch(model, [t])[0][0] for t in (en, de, fr)] == ["en", "de", "fr"]
