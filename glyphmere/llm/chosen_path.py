"""N-gram Jaccard self-join by chosen paths.

A document is the set of its 5-word shingles. Its 64 min-hashes are sampled
tokens, shared by two sets with a probability of their Jaccard similarity. Each
run splits the sets recursively: a node of the tree picks two of the 64 by its
own path, and a set goes on to the child named by its token there. Sets that are
alone in a bucket are done. Buckets of up to ``SMALL`` sets are compared pair by
pair there and then (pairs whose 64 tokens agree as two sets at the threshold do,
but for six standard deviations, are candidates); larger ones are split on, to
``DEPTH`` levels. What is still larger then becomes candidates by a star of
links. Two sets of similarity s meet at depth d with probability q(d), where
q(d) = 1 - (1 - s q(d-1))**2, or sooner; runs are repeated until the chance of
missing a pair at the threshold is below 1 - recall.

Equal sets are one class from the start. The connected candidates are brought
together and all pairs of them are compared exactly, by an index of their
shingles, so no link between different texts is lost, and none is assumed. Groups
larger than ``BLOCK`` are dealt into parts of half that size, and each two parts
are a block; each pair is counted in one block only. Work in a group grows with
the number of its pairs, which are what is counted.

Texts under five words have one shingle, of all their words. Null text and text
without words have the empty set, are equal to each other and like nothing else.
Repeated rows are documents of one class; null ids are kept. An empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmere.llm._common import as_bytes, forget, often_of, parts_of, release, slices, spread_join, stored
from glyphmere.llm._shingles import mixed, set_key, shingle_sets
from glyphmere.llm.components import components

TOKENS, DEPTH = 64, 3
#: Sets of a bucket that are compared with each other.
SMALL = 16
#: Texts compared in one task.
BLOCK = 2_000
_MULTIPLIERS = (mixed(np.arange(1, TOKENS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def survival(similarity: float, depth: int = DEPTH) -> float:
    """The chance that two sets share a leaf of one run."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - similarity * q) ** 2
    return q


def runs_needed(similarity: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity))))


def sampled_tokens(members: np.ndarray) -> np.ndarray:
    """The set's 64 min-hashes (32 bits)."""
    out = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    short = (members ^ members >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(short), 1 << 14):
        out = np.minimum(out, (short[a : a + (1 << 14), None] * _MULTIPLIERS).min(axis=0))
    return out


def children(paths: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Paths (sets, 2) of the two children that each set (its tokens: a row) goes to from its node."""
    own = mixed(paths)
    first = own % np.uint64(TOKENS)
    second = (first + np.uint64(1) + (own >> np.uint64(20)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
    pick = np.stack([first, second], axis=1).astype(np.int64)
    step = np.take_along_axis(tokens, pick, axis=1).astype(np.uint64) | pick.astype(np.uint64) << np.uint64(32)
    return mixed(paths[:, None] ^ mixed(step))


def least_agreement(threshold: float) -> int:
    """Tokens of ``TOKENS`` that two sets at the threshold share, less six standard deviations."""
    return max(1, math.floor(TOKENS * threshold - 6 * math.sqrt(TOKENS * threshold * (1 - threshold))))


def sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i, h (hash of the text), key (of the shingle set), tokens (of sets that aren't empty) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 3 << 20):
            sets = shingle_sets([t or b"" for t in as_bytes(batch.column("t"))])
            tokens = [sampled_tokens(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("h"), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(tokens, pa.binary())], ["i", "h", "key", "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("i"), F.xxhash64(df[text_col]).alias("h"), df[text_col].alias("t"))
    return rows.mapInArrow(run, f"i {kind}, h long, key long, tokens binary")


_ROW = "path long, key long, tokens binary"


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = np.frombuffer(b"".join(as_bytes(batch.column("tokens"))), np.uint32).reshape(-1, TOKENS)
    return batch.column("path").to_numpy(), batch.column("key").to_numpy(), tokens


def _batch(paths: np.ndarray, keys: np.ndarray, tokens: np.ndarray | None, least: np.ndarray | None = None) -> pa.RecordBatch:
    """Sets in their buckets, or with ``least`` links."""
    held = pa.nulls(len(keys), pa.binary()) if tokens is None else pa.array([t.tobytes() for t in tokens], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(keys), held, pa.nulls(len(keys), pa.int64()) if least is None else pa.array(least)], ["path", "key", "tokens", "b"])


def _split(rows: DataFrame) -> DataFrame:
    """Each set in both children of its node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens", 4 << 20):
            paths, keys, tokens = _arrays(batch)
            twice = batch.column("tokens").take(pa.array(np.repeat(np.arange(len(keys)), 2)))
            yield pa.RecordBatch.from_arrays([pa.array(children(paths.view(np.uint64), tokens).reshape(-1).view(np.int64)), pa.array(np.repeat(keys, 2)), twice], ["path", "key", "tokens"])

    return rows.select("path", "key", "tokens").mapInArrow(run, _ROW)


def bucket_rows(paths: np.ndarray, keys: np.ndarray, tokens: np.ndarray, agreement: int, last: bool) -> Iterator[pa.RecordBatch]:
    """From whole buckets, sorted by path and key: links of small ones; sets of larger ones, or after the ``last`` split links to the least key."""
    head = np.ones(len(paths), bool)
    head[1:] = paths[1:] != paths[:-1]
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(paths)))
    nth, of = np.arange(len(paths)) - np.repeat(start, size), np.repeat(size, size)
    for d in range(1, SMALL):
        at = np.flatnonzero((nth >= d) & (of <= SMALL))
        at = at[(tokens[at] == tokens[at - d]).sum(axis=1) >= agreement]
        if len(at):
            yield _batch(paths[at], keys[at], None, keys[at - d])
    large = np.flatnonzero(of > SMALL)
    if last:
        large = large[nth[large] > 0]
        yield _batch(paths[large], keys[large], None, keys[large - nth[large]])
    else:
        yield _batch(paths[large], keys[large], tokens[large])


def _bucketed(rows: DataFrame, agreement: int, last: bool) -> DataFrame:
    """Rows of ``bucket_rows`` of all buckets. A task holds one Arrow batch and the buckets that begin in it, of a large one only its first sets.

    Buckets that hold a large share of all rows aren't brought together: that they are large is all that counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, least = None, None, 0
        for batch in slices(batches, "tokens", 8 << 20):
            paths, keys, tokens = _arrays(batch)
            if large is not None:  # more of a bucket that is known to be large
                n = int(np.searchsorted(paths, large, side="right"))
                yield _batch(paths[:n], keys[:n], None, np.full(n, least)) if last else _batch(paths[:n], keys[:n], tokens[:n])
                paths, keys, tokens = paths[n:], keys[n:], tokens[n:]
                large = large if not len(paths) else None
            if held is not None:
                paths, keys, tokens = (np.concatenate(x) for x in zip(held, (paths, keys, tokens)))
            if not len(paths):
                continue
            cut = int(np.searchsorted(paths, paths[-1]))
            yield from bucket_rows(paths[:cut], keys[:cut], tokens[:cut], agreement, last)
            held = (paths[cut:], keys[cut:], tokens[cut:])
            if len(held[0]) > SMALL:
                large, least = held[0][0], int(held[1][0])
                yield from bucket_rows(*held, agreement, last)
                held = None
        if held is not None:
            yield from bucket_rows(*held, agreement, last)

    def dealt(some: DataFrame) -> DataFrame:
        return some.repartition(parts_of(some.sparkSession), "path").sortWithinPartitions("path", "key").mapInArrow(run, _ROW + ", b long")

    sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    often, largest = often_of(sizes)
    if largest <= often:
        return dealt(rows)
    marked = rows.join(F.broadcast(sizes.where(F.col("n") > often).select("path", "least")), "path", "left")  # at most 4 * partitions rows
    some, many = marked.where("least is null").drop("least"), marked.where("least is not null")
    links = many.where("key <> least").select("path", "key", F.lit(None).cast("binary").alias("tokens"), F.col("least").alias("b"))
    sets = many.select("path", "key", "tokens", F.lit(None).cast("long").alias("b"))
    return dealt(some).unionByName(links if last else sets)


def candidate_links(classes: DataFrame, threshold: float, runs: int) -> DataFrame:
    """a, b: candidates among classes (key, tokens), from ``runs`` trees."""
    roots = [int(r) for r in mixed(np.arange(1, runs + 1, dtype=np.uint64)).view(np.int64)]
    live = classes.where("tokens is not null").select(F.explode(F.lit(roots).cast("array<bigint>")).alias("path"), "key", "tokens")
    agreement, links, levels = least_agreement(threshold), None, []
    for depth in range(1, DEPTH + 1):
        levels.append(stored(_bucketed(_split(live), agreement, depth == DEPTH), "buckets"))
        found = levels[-1].where("b is not null").select(F.col("key").alias("a"), "b")
        links = found if links is None else links.union(found)
        live = levels[-1].where("tokens is not null")
    out = stored(links.distinct(), "links")
    forget(*levels)
    return out


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(m, m): how many shingles each two sets share. Frequent shingles count by products of 0/1 matrices, the others by their lists of sets."""
    m = len(sets)
    counts = np.zeros((m, m), np.float32)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(every)))
    often = (n > 1) & (n > m / 16)
    column = np.cumsum(often) - 1
    shingle = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(often[shingle])
    to, of = column[shingle[at]], owner[at]
    for a in range(0, int(often.sum()), 2048):
        i, j = np.searchsorted(to, [a, a + 2048])
        x = np.zeros((m, min(2048, int(often.sum()) - a)), np.float32)
        x[of[i:j], to[i:j] - a] = 1
        counts += x @ x.T
    at = np.flatnonzero((~often & (n > 1))[shingle])
    width = n[shingle[at]]
    ends = np.cumsum(width)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 22), side="right")))
        w = width[a:b]
        other = owner[np.repeat(head[shingle[at[a:b]]] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
        counts += np.bincount(np.repeat(owner[at[a:b]], w) * m + other, minlength=m * m).reshape(m, m)
        a = b
    return counts


def linked(sets: list[np.ndarray], threshold: float, part: np.ndarray, inner: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray]:
    """Roots and numbers of links among sets: all pairs of different parts (0, 1), and those within a part where ``inner`` says so."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    common = common_counts(sets)
    like = np.zeros((m, m), bool)
    within = np.array(inner)[part]
    for a in range(0, m, 256):
        c = common[a : a + 256].astype(np.float64)
        like[a : a + 256] = (c > 0) & (c >= threshold * (size[a : a + 256, None] + size - c) - 1e-9)
        like[a : a + 256] &= within[a : a + 256, None] | (part[a : a + 256, None] != part)
    np.fill_diagonal(like, False)
    root, left = np.arange(m), np.ones(m, bool)
    for p in range(m):
        todo = [p] if left[p] else []
        left[p] = False
        while todo:
            x = todo.pop()
            root[x] = p
            new = np.flatnonzero(like[x] & left)
            left[new] = False
            todo += new.tolist()
    return root, like.sum(axis=1)


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b, n: each text's key, the least key of its cluster in its block, and its links counted there. rows: comp, parts, lo, hi (the block's two parts), part, key, t."""
    n = parts_of(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def out() -> pa.RecordBatch:
            _, parts, lo, hi = at
            keys = np.array([k for k, _, _ in held], np.int64)
            sets = shingle_sets([t for _, _, t in held])
            good = list({int(k): i for i, (k, s) in enumerate(zip(keys, sets)) if set_key(s) == k}.values())  # ids may repeat
            keys, part = keys[good], np.array([held[i][1] != lo for i in good], np.int64)
            order = np.argsort(keys, kind="stable")
            keys, part = keys[order], part[order]
            # each part meets itself in its block with the next part, the last one in its block with the first
            inner = (hi - lo <= 1, lo == 0 and hi == parts - 1)
            root, links = linked([sets[good[i]] for i in order], threshold, part, inner)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[root]), pa.array(links, pa.int64())], ["a", "b", "n"])

        for batch in batches:
            for *block, part, key, t in zip(*(batch.column(c).to_pylist() for c in ("comp", "parts", "lo", "hi", "part", "key")), as_bytes(batch.column("t"))):
                if block != at and held:
                    yield out()
                    held = []
                at = block
                held.append((key, part, t or b""))
        if held:
            yield out()
            held = []
        release()

    dealt = rows.repartition(n, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    return dealt.select("comp", "parts", "lo", "hi", "part", "key", "t").mapInArrow(run, "a long, b long, n long")


def classified(df: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """i, h, class_id, n_class, n_links, lead (struct i, h of the class's first row) of every row."""
    made = stored(sketched(df, id_col, text_col), "sketches")
    classes = made.groupBy("key").agg(F.first("tokens").alias("tokens"))
    comps = stored(components(candidate_links(classes, threshold, runs_needed(threshold, recall))), "components")
    one = made.groupBy("key").agg(F.min("i").alias("i"), F.count("*").alias("rows"), F.min(F.struct("i", "h")).alias("lead"))
    size = comps.groupBy("root").agg(F.count("*").alias("m"))
    members = one.join(comps, one["key"] == comps["node"]).select("key", "i", "root").join(size, "root")
    texts = df.select(df[id_col].alias("i0"), df[text_col].alias("t"))
    parts = F.when(F.col("m") > BLOCK, F.ceil(F.col("m") / max(1, BLOCK // 2))).otherwise(1).cast("long")
    rows = members.join(texts, F.col("i").eqNullSafe(F.col("i0"))).select(F.col("root").alias("comp"), parts.alias("parts"), "key", "t").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    whole = F.col("parts") == 1
    with_others = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: whole | (x != F.col("part"))), lambda x: F.struct(F.least(x, "part").alias("lo"), F.greatest(x, "part").alias("hi")))
    done = stored(_verified(rows.withColumn("block", F.explode(with_others)).select("comp", "parts", "block.lo", "block.hi", "part", "key", "t"), threshold), "verified")
    links = done.select("a", "b")
    if size.where(F.col("m") > BLOCK).limit(1).count():
        links = components(links).select(F.col("node").alias("a"), F.col("root").alias("b"))
    counts = done.groupBy("a").agg(F.sum("n").alias("n_links"))
    found = one.join(links.withColumnRenamed("a", "key"), "key", "left").join(counts.withColumnRenamed("a", "key"), "key", "left")
    found = found.select("key", "i", "rows", "lead", F.coalesce("b", "key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    whole = found.groupBy("root").agg(F.min("i").alias("class_id"), F.sum("rows").alias("n_class"), F.min("lead").alias("first"))
    named = found.join(whole, "root").select(F.col("key").alias("k"), "rows", "class_id", "n_class", "n_links", F.col("first").alias("lead"))
    named = stored(named.withColumnRenamed("k", "key"), "classes")
    rows = made.select("i", "h", "key")
    told = spread_join(rows, named, ["key"], "rows")  # a text may have many copies
    return (rows.join(named, "key") if told is None else told).drop("key", "rows")


def join(df: DataFrame, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, class_id (least id of the class), n_class (its rows), n_links.

    n_links counts all texts with another shingle set that are similar to the
    document's; copies with the same set count once.
    """
    told = classified(df, threshold, recall, id_col, text_col)
    return told.select(F.col("i").alias(id_col), "class_id", "n_class", "n_links")


def deduplicated(df: DataFrame, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that come first (by id, then text hash, then a hash of all columns) in their class; of repeated rows one."""
    told = stored(classified(df, threshold, recall, id_col, text_col), "classes")
    kept = told.where(F.struct("i", "h") == F.col("lead")).select("i", F.col("h").alias("h__"))
    twice = kept.groupBy("i", "h__").count().where("count > 1").limit(1).count()
    rows = df.join(kept.distinct(), df[id_col].eqNullSafe(F.col("i")) & (F.xxhash64(df[text_col]) == F.col("h__")), "left_semi")
    if not twice:
        return rows
    row = F.struct(*df.columns)
    return rows.groupBy(F.col(id_col).alias("i__"), F.xxhash64(text_col).alias("h__")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row__")).select("row__.*")
