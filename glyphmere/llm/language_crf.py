"""Language identification by a linear-chain conditional random field over words.

Each word's features are its byte n-grams of 1 to 4 with marks at both ends
(those that hold a mark are its affixes) and the word itself (the lexicon),
hashed to one table of weights per language. Learned transitions join the
words; forward-backward gives each word's posterior, so code-switched texts are
labelled word by word, and a document gets the language with the greatest mean
posterior over its words with letters.

Fitting takes a bounded sample (``DOCS_PER_LANGUAGE`` labelled documents of
each language, lowest hash of id and text first, ``WORDS_PER_DOC`` words of each,
of at most ``MOST_LANGUAGES`` languages) on the driver; labelled rows that share
an id, or have none, count each, those of one id, text and label once; every document is predicted, whole. Training sequences are spliced from
the sample, a part of them from several languages, so that transitions between
languages are seen.

Null text, or text without letters, is ``und`` with score 0, as is every text if
nothing labelled was found. Of equally likely languages the first by name is taken.
Null labels are not learned from. Repeated rows and
ids are predicted one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmere.llm._common import release, slices

DOCS_PER_LANGUAGE, WORDS_PER_DOC, MOST_LANGUAGES = 300, 120, 400
SLOTS, SEQUENCE, PASSES = 1 << 17, 36, 40
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (SLOTS, languages)
    steps: np.ndarray  # (languages, languages): exp of the transition from row to column
    start: np.ndarray


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features, and the number of the word (in order) that each belongs to."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    slots, of, here = [], [], np.zeros(len(data), np.uint32)
    room = ends - np.arange(len(data))
    for n in range(1, 5):
        here[: len(data) - n + 1] = (here[: len(data) - n + 1] ^ data[n - 1 :]) * _ODD[n - 1] + np.uint32(n)
        whole = room >= n
        slots.append(here[whole] >> np.uint32(15))
        of.append(owner[whole])
    place = np.arange(len(data)) - (ends - np.repeat(sizes, sizes))
    powers = np.cumprod(np.full(int(sizes.max(initial=1)) + 1, 0x01000193, np.uint32), dtype=np.uint32)
    word = np.add.reduceat(data * powers[place], np.cumsum(sizes) - sizes, dtype=np.uint32) if len(words) else np.zeros(0, np.uint32)
    slots.append((word * _ODD[0] ^ word >> np.uint32(13)) * _ODD[2] >> np.uint32(15))
    of.append(np.arange(len(words)))
    slot, of_word = np.concatenate(slots).astype(np.int64), np.concatenate(of)
    order = np.argsort(of_word, kind="stable")
    return slot[order], of_word[order]


def emissions(weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log-potentials (words, languages)."""
    if not words:
        return np.zeros((0, weights.shape[1]), np.float32)
    out = np.empty((len(words), weights.shape[1]), np.float32)
    for a in range(0, len(words), 20_000):
        slot, of = word_features(words[a : a + 20_000])
        first = np.flatnonzero(np.diff(of, prepend=-1))
        out[a : a + 20_000] = np.add.reduceat(weights[slot], first, axis=0)
    return out


def posteriors(model: Model, potentials: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """Each word's posterior over languages, by forward-backward; texts lie at starts, ``lengths`` words each.

    All texts take one step at a time together. ``moves`` gets the expected number of each transition added.
    """
    e = np.exp(potentials - potentials.max(axis=1, keepdims=True)) if len(potentials) else potentials
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    forward = np.empty_like(e)
    a = None
    for t in range(longest):
        at = starts[: active[t]] + t
        a = (model.start if t == 0 else a[: active[t]] @ model.steps) * e[at]
        a = a / a.sum(axis=1, keepdims=True)
        forward[at] = a
    back = np.ones((len(starts), e.shape[1]), e.dtype)
    for t in range(longest - 1, -1, -1):
        at, n = starts[: active[t]] + t, active[t]
        both, ahead = forward[at] * back[:n], e[at] * back[:n]
        if moves is not None and t:
            joint = forward[at - 1][:, :, None] * model.steps * ahead[:, None, :]
            moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        forward[at] = both / both.sum(axis=1, keepdims=True)
        b = ahead @ model.steps.T
        back[:n] = b / b.sum(axis=1, keepdims=True)
    return forward


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model of (language, text) rows."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return None
    number: dict[bytes, int] = {}
    runs: list[list[np.ndarray]] = [[] for _ in languages]
    for lang, text in texts:
        ids = np.array([number.setdefault(w, len(number)) for w in text.lower().encode().split()[:WORDS_PER_DOC]], np.int64)
        runs[languages.index(lang)] += [ids[k : k + SEQUENCE // 3] for k in range(0, len(ids), SEQUENCE // 3)]
    flat = [(k, r) for k, rs in enumerate(runs) for r in rs if len(r)]
    mixed = [flat[i] for i in rng.permutation(len(flat))[: len(flat) // 2]]
    sequences = [seq[i : i + 3] for seq in (flat, mixed) for i in range(0, len(seq), 3)]
    if not sequences:
        return None
    ids = np.concatenate([r for s in sequences for _, r in s])
    gold = np.concatenate([np.full(len(r), k) for s in sequences for k, r in s])
    lengths = np.array([sum(len(r) for _, r in s) for s in sequences])
    starts = np.cumsum(lengths) - lengths
    slot, of = (x.astype(np.int32) for x in word_features(list(number)))
    first = np.flatnonzero(np.diff(of, prepend=-1))
    by_slot = np.argsort(slot, kind="stable").astype(np.int32)
    ranked, word_of = slot[by_slot], of[by_slot]
    cuts = np.flatnonzero(np.diff(ranked, prepend=-1))
    used, n = ranked[cuts], len(languages)
    del of, by_slot, ranked
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    pairs = np.zeros((n, n))
    np.add.at(pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    # gradient ascent (AdaGrad) on the chain's likelihood, weights and transitions together
    steps = (pairs + 1) / (pairs + 1).sum(axis=1, keepdims=True)
    model = Model(languages, np.zeros((SLOTS, n), np.float32), steps.astype(np.float32), np.full(n, 1 / n, np.float32))
    trans, squares, tsq = np.log(steps), np.full((len(used), n), 1e-3), np.full((n, n), 1e-3)
    want = np.zeros((len(number), n))
    np.add.at(want, (ids, gold), 1)
    for _ in range(PASSES):
        potentials = np.stack([np.add.reduceat(model.weights[:, k][slot], first) for k in range(n)], 1)  # a language at a time, to hold less
        expect = np.zeros((n, n))
        post = posteriors(model, potentials[ids], starts, lengths, expect)
        got = np.stack([np.bincount(ids, post[:, k], len(number)) for k in range(n)], 1)
        grad = np.stack([np.add.reduceat((want - got)[:, k][word_of], cuts) for k in range(n)], 1) / len(ids) - 1e-6 * model.weights[used]
        squares += grad * grad
        model.weights[used] += (0.2 * grad / np.sqrt(squares)).astype(np.float32)
        tgrad = (pairs - expect) / len(ids)
        tsq += tgrad * tgrad
        trans += 0.05 * tgrad / np.sqrt(tsq)
        model.steps = np.exp(trans - trans.max()).astype(np.float32)
    return model


def train(df: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model fitted to a bounded sample of the rows where ``learn`` holds and the label is not null."""
    rows = df.select(df[text_col].alias("t"), df[lang_col].cast("string").alias("lang"), (F.lit(True) if learn is None else learn).alias("ok"), F.xxhash64(df[id_col].cast("string"), df[text_col]).alias("h"))
    rows = rows.where("ok and lang is not null and t is not null")
    nth = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").withColumn("nth", nth).where(F.col("nth") <= DOCS_PER_LANGUAGE).distinct()
    chosen = chosen.orderBy("nth", "lang").limit(DOCS_PER_LANGUAGE * MOST_LANGUAGES).select("lang", "h")
    short = F.concat_ws(" ", F.slice(F.split("t", r"[ \t-\r]+"), 1, WORDS_PER_DOC))
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", short.alias("t"), "h").dropDuplicates(["lang", "h"])  # bounded by the two constants
    model = fit([(r["lang"], r["t"]) for r in texts.orderBy("h", "lang").collect()])
    release()  # the driver lives on
    return model


def label_words(model: Model, words: list[str]) -> list[tuple[str, float]]:
    """Language and posterior of each word of one text."""
    e = emissions(model.weights, [w.lower().encode() for w in words])
    p = posteriors(model, e, np.array([0]), np.array([len(words)])) if words else e
    return [(model.languages[k], float(row[k])) for row, k in zip(p, p.argmax(axis=1))]


def predict_batch(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's language, the language's mean posterior, and the mean of the words' greatest posteriors."""
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    number: dict[bytes, int] = {}
    found, lengths = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = t.lower().encode().split() if t else []
        lengths[k] = len(words)
        found.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
    ids = np.concatenate(found) if found else np.zeros(0, np.int32)
    starts = np.cumsum(lengths) - lengths
    names = list(number)
    lettered = np.fromiter((any(map(str.isalpha, w.decode("utf-8"))) for w in names), bool, len(names))
    post = posteriors(model, emissions(model.weights, names)[ids], starts, lengths)
    post[~lettered[ids]] = 0
    total, sure = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    some = lengths > 0
    if some.any():
        total[some] = np.add.reduceat(post.astype(np.float64), starts[some], axis=0)
        sure[some] = np.add.reduceat(post.max(axis=1).astype(np.float64), starts[some])
    mass = total.sum(axis=1)
    best = total.argmax(axis=1)
    langs = [model.languages[b] if m > 0 else "und" for b, m in zip(best, mass)]
    return langs, np.where(mass > 0, total.max(axis=1) / np.maximum(mass, 1e-12), 0.0), np.where(mass > 0, sure / np.maximum(mass, 1e-12), 0.0)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", word_score: bool = False) -> DataFrame:
    """``df`` with lang_pred and score appended, whatever other columns it has (two of these names are replaced); with ``word_score`` also the mean of the words' greatest posteriors."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages numbers
    added = ["lang_pred", "score", "word_score"][: 3 if word_score else 2]
    kept = [c for c in df.columns if c not in added]
    text_at = kept.index(text_col)
    schema = df.select([df[c] for c in kept]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 3 << 20):
            langs, *scores = predict_batch(shipped.value, batch.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), *(pa.array(np.clip(s, 0, 1), pa.float64()) for s in scores[: len(added) - 1])], [*kept, *added])

    for name in added:
        schema = schema.add(name, "string" if name == "lang_pred" else "double")
    return df.select([df[c] for c in kept]).mapInArrow(run, schema)
