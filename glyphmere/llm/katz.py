"""Language-model scoring with a Katz backoff trigram model over all documents.

Tokens are words (ASCII letters lower-cased) and one end for each text; two start
marks are the first token's context. Counts of 1 to ``LARGEST`` are discounted by
Good-Turing estimates, each order's by its own counts of counts. What is taken
from the words goes to one unknown word; what is taken from the n-grams of a
context goes to the words unseen after it, by backoff weights that make each
context sum to 1 exactly: alpha = (1 - sum of discounted) / (1 - sum of the next
lower order over the words seen). A token is scored recursively: its trigram if
seen, else alpha of the two words before times its pair's probability, which is the
pair's if seen, else alpha of the word before times its word's, else the unknown
word's.

Counts live in partitioned tables in the shared folder. Texts are cut once into
chunks (the words' numbers and the tokens). For each order a chunk sends its
distinct n-grams with their counts to buckets by hash of the context, and gets
back the totals over the corpus, and its contexts' sums, in the same order. So an
n-gram is sent once for each chunk, whatever its frequency, and there are at most
as many messages as n-grams sent. A bucket holds about ``BUCKET_TOKENS`` tokens;
there are as many as the corpus needs, and a task takes its own one by one.
Contexts with more tokens than fit a bucket are spread by n-gram, and their sums
added up; at most ``4 * buckets`` are.

Words are numbered by a table of all words (known by 64-bit hashes), frequent ones
first, so that sorted n-grams are sent as small differences. Null text counts as
empty: its end alone. Repeated rows count each time. With nothing to learn from,
every token is the unknown word, of probability 1. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmere.llm._common import as_bytes, drop_shuffles, forget, parts_of, placed, release, slices, stored
from glyphmere.llm._shingles import mixed

LARGEST = 5
CHUNK_TOKENS, BUCKET_TOKENS = 800_000, 1_000_000
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
#: The least type for whole numbers of so many bytes.
_NARROW = [np.dtype(f"<u{1 << max(0, (k - 1).bit_length())}") for k in (1, *range(1, 9))]
#: Number of the start mark; words have numbers from 1 on.
START = np.uint64(0)


def discounts(of_count: np.ndarray) -> np.ndarray:
    """Factors for counts 0..LARGEST from numbers of types with counts 0..LARGEST+1 (Katz); 1 where an estimate is unusable."""
    d = np.ones(LARGEST + 1)
    n = of_count.astype(float)
    if n[1] <= 0:
        return d
    cut = (LARGEST + 1) * n[LARGEST + 1] / n[1]
    for r in range(1, LARGEST + 1):
        if n[r] > 0 and n[r + 1] > 0 and cut < 1:
            f = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
            d[r] = f if 0 < f <= 1 else 1.0
    return d


def boxed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers (of 64 bits) or doubles, mostly small, as compressed planes of their bytes."""
    parts = []
    for x in columns:
        if x.dtype == np.float64:
            used, narrow = 8, x
        else:
            used = -(-int(x.max(initial=0)).bit_length() // 8)
            narrow = x.astype(_NARROW[used])
        planes = np.ascontiguousarray(narrow).view(np.uint8).reshape(len(x), narrow.dtype.itemsize).T[:used]
        parts += [np.array([len(x), used], "<u4").tobytes(), planes.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unboxed(raw: bytes, kinds: str) -> list[np.ndarray]:
    """Columns by their kinds (u: whole numbers, f: doubles)."""
    data, at, out = zstandard.decompress(raw), 0, []
    for kind in kinds:
        n, used = np.frombuffer(data, "<u4", 2, at).tolist()
        narrow = _NARROW[used] if kind == "u" else np.dtype("<f8")
        planes = np.zeros((n, narrow.itemsize), np.uint8)
        planes[:, :used] = np.frombuffer(data, np.uint8, n * used, at + 8).reshape(used, n).T
        at += 8 + n * used
        out.append(planes.reshape(-1).view(narrow).astype("<u8" if kind == "u" else "<f8", copy=False))
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first to 0, with the sign in the lowest bit."""
    d = np.diff(x.astype(np.int64), prepend=0)
    return (d << 1 ^ d >> 63).view(np.uint64)


def walked(d: np.ndarray) -> np.ndarray:
    """What ``steps`` was given."""
    return np.cumsum((d >> np.uint64(1)).view(np.int64) ^ -(d & np.uint64(1)).view(np.int64)).view(np.uint64)


class Words:
    """Discounted probabilities of words by their count; what they lack is the unknown word's."""

    def __init__(self, tokens: int, of_count: np.ndarray) -> None:
        self.tokens, self.d = tokens, discounts(of_count)
        r = np.arange(1, LARGEST + 1)
        left = float(((1 - self.d[1:]) * r * of_count[1 : LARGEST + 1]).sum())
        self.total = tokens if left > 0 else tokens + 1
        self.unknown = (left if left > 0 else 1) / self.total

    def __call__(self, c: np.ndarray) -> np.ndarray:
        p = c * self.d[np.where(c <= LARGEST, c, 0).astype(np.int64)] / self.total
        return np.where(c > 0, p, self.unknown)


class Contexts:
    """From a context's tokens, its seen words' lower-order sum and its numbers of n-grams by count: total and alpha."""

    def __init__(self, of_count: np.ndarray) -> None:
        self.d = discounts(of_count)

    def weights(self, c: np.ndarray, lower: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Denominator of seen n-grams, and alpha (1 for an unseen context). n: (contexts, LARGEST)."""
        taken = ((1 - self.d[1:]) * np.arange(1, LARGEST + 1) * n).sum(axis=1)
        none = taken <= 0
        total = np.where(none, c + 1.0, c)
        alpha = np.where(none, 1.0, taken) / np.maximum(total, 1) / np.maximum(1 - lower, 1e-300)
        return total, np.where(c > 0, alpha, 1.0)

    def seen(self, c: np.ndarray, total: np.ndarray) -> np.ndarray:
        return c * self.d[np.where(c <= LARGEST, c, 0).astype(np.int64)] / np.maximum(total, 1)


def chunked(df: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    """chunk, ids, learn, lengths (tokens, with the end) of documents; words (their hashes), stream (numbers into them)."""
    id_kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        ids, flags, lengths, streams = [], [], [], []

        def out() -> pa.RecordBatch:
            h = np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number)), END)
            stream = np.concatenate(streams)
            stream[stream < 0] = len(number)
            words, at = np.unique(h, return_inverse=True)
            row = [pa.array([(part << 24) + made]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([flags]), pa.array([lengths], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()), pa.array([boxed([at[stream].astype(np.uint64)])], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["chunk", "ids", "learn", "lengths", "words", "stream"])

        held = 0
        for batch in slices(batches, "t", 2 << 20):
            for t in as_bytes(batch.column("t")):
                words = t.lower().split() if t else []
                streams.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                streams.append(np.array([-1], np.int32))
                lengths.append(len(words) + 1)
                held += len(words) + 1
            ids.append(batch.column("i"))
            flags += batch.column("ok").to_pylist()
            if held > CHUNK_TOKENS:
                yield out()
                number.clear()
                ids, flags, lengths, streams = [], [], [], []
                held, made = 0, made + 1
                release()
        if lengths:
            yield out()
        release()

    rows = df.select(df[id_col].alias("i"), df[text_col].alias("t"), F.coalesce(learn, F.lit(False)).alias("ok"))
    return rows.mapInArrow(run, f"chunk long, ids array<{id_kind}>, learn array<boolean>, lengths array<long>, words binary, stream binary")


@dataclass
class Grams:
    """The distinct n-grams of a chunk, by context and word."""

    names: list[np.ndarray]  # each context's words' numbers, the nearest first
    key: np.ndarray  # each context's hash
    ctx: np.ndarray  # each n-gram's context
    word: np.ndarray  # and its last word, by its place among the chunk's
    shorter: np.ndarray  # the place of the n-gram without its first word, among the order below
    outer: np.ndarray | None  # each context's own shorter context, among those of the order below
    token: np.ndarray  # each token's n-gram


class Chunk:
    """One row of the chunk table, in arrays. Words are in the order of their numbers."""

    def __init__(self, row: dict) -> None:
        self.key = row["chunk"]
        (self.stream,) = (x.astype(np.int64) for x in unboxed(row["stream"], "u"))
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.learn = np.repeat(np.array(row["learn"], bool), self.lengths)
        if row.get("words") is not None:
            self.words = np.frombuffer(row["words"], "<u8")
        if row.get("names") is not None:
            names, self.count = unboxed(row["names"], "uu")
            self.names = np.append(walked(names), START)
        if row.get("counted") is not None:
            (self.counted,), (self.total,) = unboxed(row["counted"], "u"), unboxed(row["total"], "u")
        if row.get("alpha") is not None:
            (self.alpha,) = unboxed(row["alpha"], "f")

    def before(self, n: int) -> np.ndarray:
        """The word ``n`` places before each token (the one after the last: start)."""
        out = np.full(len(self.stream), len(self.names) - 1, np.int64)
        out[n:] = self.stream[: len(self.stream) - n]
        for k in range(n):
            at = self.starts + k
            out[at[self.lengths > k]] = len(self.names) - 1
        return out

    def grams(self, order: int, below: Grams | None = None) -> Grams:
        """n-grams of an order; ``below`` are those of the next lower one."""
        size = len(self.names)
        if order == 2:
            place, ctx = None, self.before(1)
            names = [self.names]
        else:  # contexts in the order of their nearest word, then the one before
            near, far = self.before(1), self.before(2)
            place, ctx = np.unique(near * size + far, return_inverse=True)
            names = [self.names[place // size], self.names[place % size]]
        grams, token = np.unique(ctx * size + self.stream, return_inverse=True)
        shorter = np.empty(len(grams), np.int64)
        shorter[token] = self.stream if below is None else below.token
        return Grams(names, key_of(names), grams // size, grams % size, shorter, None if place is None else place // size, token)


def spread(g: Grams, word: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each n-gram: by its context's nearest word, where that is a spread context by the whole context, where that is too by its own word also."""
    near = mixed(g.names[0])
    key = np.where(np.isin(near, hot), g.key, near)[g.ctx]
    return (np.where(np.isin(g.key, hot)[g.ctx], mixed(key ^ mixed(word)), key) >> np.uint64(20)).astype(np.int64) % buckets


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has any, and the places of its members in their order."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return ((int(bucket[o[0]]), o) for o in np.split(order, cuts[1:]) if len(o))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _sent(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(names), kinds)], names)


_ASK = ([pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["spot", "chunk", "bucket", "payload"])
ANSWER = "chunk long, bucket int, payload binary"
_TELL = ([pa.int64(), pa.int32(), pa.binary()], ["chunk", "bucket", "payload"])


def exchanged(chunks: DataFrame, columns: list[str], ask: Callable[[Chunk], Iterator[tuple[int, bytes]]], tell: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """chunk, bucket, payload: what ``tell`` answers each bucket's messages (chunk, payload) that ``ask`` makes of each chunk (bucket, payload)."""
    n = parts_of(chunks.sparkSession)
    spots = placed(chunks.sparkSession, n)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            yield _sent([(spots[b % n], chunk.key, b, payload) for b, payload in ask(chunk)], *_ASK)
            del chunk
            release()

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for r in _rows(batches):
            if r["bucket"] != at and held:
                yield _sent([(c, at, p) for c, p in tell(at, held)], *_TELL)
                held = []
                release()
            at = r["bucket"]
            held.append((r["chunk"], r["payload"]))
        if held:
            yield _sent([(c, at, p) for c, p in tell(at, held)], *_TELL)
            held = []
        release()

    sent = chunks.select(*columns).mapInArrow(asking, "spot long, " + ANSWER)
    return sent.repartition(n, "spot").sortWithinPartitions("bucket").mapInArrow(telling, ANSWER)


def of_counts(total: np.ndarray) -> np.ndarray:
    """How many of the totals are 0, 1, ... LARGEST + 1."""
    return np.bincount(np.minimum(total, LARGEST + 2).astype(np.int64), minlength=LARGEST + 3)[: LARGEST + 2]


#: Facts of a context: tokens, n-grams by count, and the sum of the lower order over its seen words.
FACTS = LARGEST + 2
#: Words of a bucket that are reported with their counts, the most frequent ones.
TOP = 256
#: Contexts that may be spread over all buckets.
MOST_SPREAD = 1_000_000


def count_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Answers (chunk, bucket, counts and numbers of words); chunk -1: tokens, words, numbers of words by count, then frequent words' numbers and counts."""

    def ask(c: Chunk) -> Iterator[tuple[int, bytes]]:
        count = np.bincount(c.stream[c.learn], minlength=len(c.words)).astype(np.uint64)
        for b, o in dealt((mixed(c.words) >> np.uint64(20)).astype(np.int64) % buckets):
            yield b, boxed([c.words[o], count[o]])

    def tell(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        got = [unboxed(p, "uu") for _, p in held]
        words, at = np.unique(np.concatenate([w for w, _ in got]), return_inverse=True)
        total = np.zeros(len(words), np.uint64)
        np.add.at(total, at, np.concatenate([c for _, c in got]))
        ranked = np.argsort(~total, kind="stable")
        number = np.empty(len(words), np.uint64)
        number[ranked] = np.arange(len(words), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)
        top = ranked[:TOP]
        yield -1, boxed([np.concatenate([[total.sum(), (total > 0).sum()], of_counts(total)]).astype(np.uint64), number[top], total[top]])
        for (chunk, _), (w, _) in zip(held, got):
            o = np.searchsorted(words, w)
            yield chunk, boxed([total[o], number[o]])

    return exchanged(chunks, ["chunk", "learn", "lengths", "words", "stream"], ask, tell)


def word_facts(told: DataFrame, share: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Tokens, words, numbers of words by count, and the numbers of words of more than 1 in ``share`` tokens, over all buckets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in as_bytes(batch.column("payload")):
                facts, number, total = unboxed(raw, "uuu")
                yield _sent([(-1 - k, int(x)) for k, x in enumerate(facts)] + list(zip(number.tolist(), total.tolist())), [pa.int64(), pa.int64()], ["number", "n"])

    rows = stored(told.where("chunk = -1").select("payload").mapInArrow(read, "number long, n long"), "facts")
    facts = {r["number"]: r["n"] for r in rows.where("number < 0").groupBy("number").agg(F.sum("n").alias("n")).collect()}  # LARGEST + 4 rows
    tokens, kinds, *of = (facts.get(-1 - k, 0) for k in range(LARGEST + 4))
    often = rows.where((F.col("number") >= 0) & (F.col("n") > tokens / share)).select("number").collect()  # at most ``share``
    forget(rows)
    return tokens, kinds, np.array(of), np.array([r["number"] for r in often], np.uint64)


def backing_off(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which contexts, whose n-grams begin at ``first``, have one never learned: only these need alpha."""
    return np.add.reduceat(counts == 0, first, dtype=np.int64) > 0


def key_of(names: list[np.ndarray]) -> np.ndarray:
    """Hash of contexts from their words' numbers, the nearest first."""
    return mixed(names[0]) if len(names) == 1 else mixed(mixed(names[0]) ^ names[1])


def decoded(payload: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """A message of ``count_grams``: contexts' words, numbers of n-grams of each, their last words, counts, counts of the order below, contexts' totals there."""
    columns = unboxed(payload, "u" * (order + 3 + (order > 2)))
    totals = columns.pop() if order > 2 else None
    *names, runs, word, learned, below = columns
    runs, ends = runs.astype(np.int64), np.cumsum(word, dtype=np.uint64)
    base = np.append(np.uint64(0), ends)[np.cumsum(runs) - runs]
    return [walked(x) for x in names], runs, ends - np.repeat(base, runs), learned, below, None if totals is None else walked(totals)


def count_grams(chunks: DataFrame, order: int, lower: Callable[[np.ndarray, np.ndarray | None], np.ndarray], hot: np.ndarray, buckets: int, often: float) -> DataFrame:
    """Answers (chunk, bucket, n-grams' counts, then facts of each context that isn't spread).

    Those of chunk -1 hold the numbers of n-grams by count, spread contexts and
    their facts here, and the hashes of n-grams of more than ``often`` tokens.
    ``lower`` gives the probability of a seen n-gram of the order below from its
    count and its context's total.
    """

    def ask(c: Chunk) -> Iterator[tuple[int, bytes]]:
        g = c.grams(2)
        g = g if order == 2 else c.grams(3, g)
        learned = np.bincount(g.token[c.learn], minlength=len(g.word)).astype(np.uint64)
        below = (c.count if order == 2 else c.counted)[g.shorter]
        word = c.names[g.word]
        for b, o in dealt(spread(g, word, hot, buckets)):
            first = np.flatnonzero(np.diff(g.ctx[o], prepend=-1))
            here = g.ctx[o[first]]
            last = np.diff(word[o], prepend=START)
            last[first] = word[o[first]]
            runs = np.diff(np.append(first, len(o))).astype(np.uint64)
            totals = [steps(c.total[g.outer[here]])] if order > 2 else []
            yield b, boxed([*(steps(x[here]) for x in g.names), runs, last, learned[o], below[o], *totals])

    def tell(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        got = [decoded(p, order) for _, p in held]
        names = [np.concatenate([g[0][k] for g in got]) for k in range(order - 1)]
        runs = np.concatenate([g[1] for g in got])
        keys, at = np.unique(key_of(names), return_inverse=True)
        one_of = np.empty(len(keys), np.int64)
        one_of[at] = np.arange(len(at))
        ctx = np.repeat(at, runs)
        words, place = np.unique(np.concatenate([g[2] for g in got]), return_inverse=True)
        cell = ctx << 32 | place
        by = np.argsort(cell)
        start = np.flatnonzero(np.diff(cell[by], prepend=-1))
        size = np.diff(np.append(start, len(by)))
        total = np.add.reduceat(np.concatenate([g[3] for g in got])[by], start)
        answer = np.empty(len(by), np.uint64)
        answer[by] = np.repeat(total, size)
        one = by[start]  # one of each n-gram
        of_ctx, last = ctx[one], words[place[one]]
        below = np.concatenate([g[4] for g in got])[one]
        outer = np.repeat(np.concatenate([g[5] for g in got]), runs)[one] if order > 2 else None
        del cell, by, place
        seen = total > 0
        facts = np.zeros((FACTS, len(keys)))
        facts[0] = np.bincount(of_ctx, total, len(keys))
        few = np.minimum(total, LARGEST + 1).astype(np.int64)
        facts[1:-1] = np.bincount(of_ctx * (LARGEST + 2) + few, minlength=len(keys) * (LARGEST + 2)).reshape(len(keys), -1).T[1 : LARGEST + 1]
        facts[-1] = np.bincount(of_ctx[seen], lower(below[seen], None if outer is None else outer[seen]), len(keys))
        mine, many = np.isin(keys, hot), total > often
        later = mixed(mixed(last[many]) ^ names[0][one_of][of_ctx[many]])
        whole = facts[:-1].astype(np.uint64)
        yield -1, boxed([of_counts(total).astype(np.uint64), later, keys[mine], *(x[mine] for x in whole), facts[-1][mine]])
        n = a = 0
        for (chunk, _), g in zip(held, got):
            counts, where = answer[n : n + len(g[2])], at[a : a + len(g[1])]
            cold = ~mine[where]
            unseen = backing_off(counts, np.cumsum(g[1]) - g[1])[cold]
            yield chunk, boxed([counts, *(x[where[cold]] for x in whole), facts[-1][where[cold]][unseen]])
            n, a = n + len(g[2]), a + len(g[1])

    return exchanged(chunks, ["chunk", "learn", "lengths", "names", "stream", *(["counted", "total"] if order > 2 else [])], ask, tell)


_FACTS_KIND = "u" * (FACTS - 1) + "f"


def gram_facts(told: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Numbers of n-grams by count, hashes of frequent n-grams, and spread contexts' facts, over all buckets."""
    names = [f"x{k}" for k in range(FACTS)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in as_bytes(batch.column("payload")):
                of, later, keys, *facts = unboxed(raw, "uuu" + _FACTS_KIND)
                rows = [(0, k, float(x), *[0.0] * (FACTS - 1)) for k, x in enumerate(of)]
                rows += [(1, x, *[0.0] * FACTS) for x in later.view(np.int64).tolist()]
                rows += [(2, x, *map(float, f)) for x, *f in zip(keys.view(np.int64).tolist(), *facts)]
                yield _sent(rows, [pa.int32(), pa.int64(), *[pa.float64()] * FACTS], ["kind", "key", *names])

    rows = told.where("chunk = -1").select("payload").mapInArrow(read, "kind int, key long, " + ", ".join(f"{f} double" for f in names))
    of, later, facts = np.zeros(LARGEST + 2), [], {}
    for r in rows.groupBy("kind", "key").agg(*(F.sum(f).alias(f) for f in names)).collect():  # at most MOST_SPREAD of a kind
        key = r["key"] & (1 << 64) - 1
        if r["kind"] == 0:
            of[key] = r["x0"]
        elif r["kind"] == 1:
            later.append(key)
        else:
            facts[key] = np.array([r[f] for f in names])
    return of, np.array(sorted(later), np.uint64), facts


def told_of(g: Grams, c: Chunk, answers: list[dict], hot: np.ndarray, hot_facts: dict[int, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a chunk's n-grams, and facts of its contexts (a row each), from the buckets' answers."""
    by = {a["bucket"]: a["payload"] for a in answers}
    counts, facts = np.zeros(len(g.word), np.uint64), np.zeros((len(g.key), FACTS))
    for b, o in dealt(spread(g, c.names[g.word], hot, buckets)):
        counts[o], *told = unboxed(by.pop(b), "u" + _FACTS_KIND)
        first = np.flatnonzero(np.diff(g.ctx[o], prepend=-1))
        here = g.ctx[o[first]]
        cold, unseen = ~np.isin(g.key[here], hot), backing_off(counts[o], first)
        for k, x in enumerate(told[:-1]):
            facts[here[cold], k] = x
        facts[here[cold & unseen], FACTS - 1] = told[-1]
    for k in np.flatnonzero(np.isin(g.key, hot)):
        facts[k] = hot_facts.get(int(g.key[k]), 0)
    return counts, facts


def _gathered(chunks: DataFrame, told: DataFrame) -> DataFrame:
    listed = told.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "payload")).alias("answers"))
    return chunks.join(listed, "chunk")


def _mapped(df: DataFrame, keep: list[str], make: Callable[[dict], dict[str, bytes]], added: list[str]) -> DataFrame:
    """The columns ``keep`` of each row, and ``added`` binary ones that ``make`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                made = make({c: one.column(c)[0].as_py() for c in one.schema.names if c != "ids"})
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in keep), *(pa.array([made[c]], pa.binary()) for c in added)], [*keep, *added])

    return df.mapInArrow(run, ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} binary" for c in added]))


def score(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, learned, n_tokens, n_known, train_tokens, base_score, score of every row; the model learns from rows where ``learn`` holds."""
    spark = df.sparkSession
    cut = stored(chunked(df, learn, id_col, text_col), "chunks", packed=True)
    buckets = max(parts_of(spark), -(-cut.count() * CHUNK_TOKENS // BUCKET_TOKENS))
    share = min(4 * buckets, MOST_SPREAD)
    told = stored(count_words(cut, buckets), "words", packed=True)
    tokens, kinds, of, frequent = word_facts(told, share)
    words = Words(tokens, of)
    hot = {2: np.append(mixed(frequent), mixed(np.array([START])))}

    def numbered(row: dict) -> dict[str, bytes]:
        h, by = np.frombuffer(row["words"], "<u8"), {a["bucket"]: a["payload"] for a in row["answers"]}
        count, number = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        for b, o in dealt((mixed(h) >> np.uint64(20)).astype(np.int64) % buckets):
            count[o], number[o] = unboxed(by.pop(b), "uu")
        order = np.argsort(number)
        place = np.empty(len(h), np.uint64)
        place[order] = np.arange(len(h), dtype=np.uint64)
        (stream,) = unboxed(row["stream"], "u")
        return {"names": boxed([steps(number[order]), count[order]]), "stream": boxed([place[stream.astype(np.int64)]])}

    base = ["chunk", "ids", "learn", "lengths"]
    chunks = stored(_mapped(_gathered(cut, told), base, numbered, ["names", "stream"]), "chunks", packed=True)
    forget(cut, told)
    told = stored(count_grams(chunks, 2, lambda c, _: words(c), hot[2], buckets, tokens / share), "pairs", packed=True)
    of, later, pair_facts = gram_facts(told)
    pairs = Contexts(of)
    hot[3] = np.concatenate([hot[2], later, mixed(mixed(np.array([START])) ^ START)])

    def paired(row: dict) -> dict[str, bytes]:
        c = Chunk(row)
        g = c.grams(2)
        counts, facts = told_of(g, c, row["answers"], hot[2], pair_facts, buckets)
        total, alpha = pairs.weights(facts[:, 0], facts[:, -1], facts[:, 1:-1])
        alpha[np.bincount(g.ctx, counts == 0, len(alpha)) == 0] = 0  # not needed
        return {"counted": boxed([counts]), "total": boxed([total.astype(np.uint64)]), "alpha": boxed([alpha])}

    wide = stored(_mapped(_gathered(chunks, told), [*base, "names", "stream"], paired, ["counted", "total", "alpha"]), "chunks", packed=True)
    forget(chunks, told)
    told = stored(count_grams(wide, 3, lambda c, total: pairs.seen(c, total), hot[3], buckets, np.inf), "triples", packed=True)
    of, _, triple_facts = gram_facts(told)
    triples = Contexts(of)
    drop_shuffles(spark, 0)
    id_kind = df.schema[id_col].dataType.simpleString()

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = {x: one.column(x)[0].as_py() for x in one.schema.names if x != "ids"}
                ids, c = one.column("ids").flatten(), Chunk(row)
                two = c.grams(2)
                three = c.grams(3, two)
                counts, facts = told_of(three, c, row["answers"], hot[3], triple_facts, buckets)
                total, alpha = triples.weights(facts[:, 0], facts[:, -1], facts[:, 1:-1])
                p = words(c.count)
                p = np.where(c.counted > 0, pairs.seen(c.counted, c.total[two.ctx]), c.alpha[two.ctx] * p[two.word])
                p = np.where(counts > 0, triples.seen(counts, total[three.ctx]), alpha[three.ctx] * p[three.shorter])
                score = np.add.reduceat(np.log10(p)[three.token], c.starts)
                plain = np.add.reduceat(np.log10((c.count + 1.0) / (tokens + 1.0 * (kinds + 1)))[c.stream], c.starts)
                known = np.add.reduceat((c.count > 0)[c.stream].astype(np.int64), c.starts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(row["learn"]), pa.array(c.lengths), pa.array(known), pa.array(np.full(len(ids), tokens)), pa.array(plain), pa.array(score)], ["i", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                del row, ids, c, two, three, counts, facts, p
                release()

    return _gathered(wide, told).mapInArrow(evaluate, f"i {id_kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("i", id_col)
