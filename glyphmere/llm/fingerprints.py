"""Document fingerprints from improbable features.

Every 64-byte window of a text is a feature. Its entropy (in thousandths of the
6 bits it could have) ranks it: the fewer windows of all documents have that
entropy, the rarer (``rarity`` counts them); nearly constant windows are never
taken. In each run of 64
neighbouring features the rarest (the first of equals) gets a point, and those
with 16 points or more are selected. Five 11-bit hashes of each distinct
selected feature are set in a 2048-bit Bloom filter, and after 160 features the
next filter of the chain begins. Two digests are compared filter by filter:
each filter of the shorter one takes its best overlap, normalised so that what
chance gives counts 0 and containment 1, and the mean is their likeness.

A fingerprint depends on the text and the ranks alone; digests made with
different ranks can't be compared. Null text counts as empty. A text of
under 64 bytes is one feature, and one without rare windows has its first; an
empty one has no filter. Equal fingerprints
are alike by 1, and an empty one is unlike (0) any other. In ``with_next`` rows
follow each other by id (null first), rows of one id by text, and the last row
is followed by the first; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmere.llm._common import as_bytes, parts_of, placed, slices

WINDOW, RUN, POINTS, PER_FILTER, BITS = 64, 64, 16, 160, 2048
#: Entropy below which a window is nearly constant (thousandths of 6 bits), and numbers of entropies.
LEAST, ENTROPIES = 100, 1024
LANES = 4096
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x94D049BB133111EB], np.uint64)
_C = np.arange(WINDOW + 1)
_TERM = np.zeros(WINDOW + 1)
_TERM[1:] = 1000 / 6 * _C[1:] / WINDOW * np.log2(WINDOW / _C[1:])
#: What one more of a byte adds to a window that holds c of it, in 1/16 of a thousandth.
_STEP = np.round(16 * np.diff(_TERM, append=0)).astype(np.int32)


def window_entropy(data: np.ndarray) -> np.ndarray:
    """Entropy of the window that starts at each byte, in thousandths of 6 bits (the last 63 are of no window)."""
    n = len(data)
    length = max(256, -(-n // LANES))
    lanes = -(-n // length)
    padded = np.zeros(lanes * length + WINDOW, np.uint8)
    padded[:n] = data
    steps = np.lib.stride_tricks.as_strided(padded, (lanes, length + WINDOW - 1), (length, 1)).T.copy()
    count, base = np.zeros(lanes * 256, np.uint8), np.arange(lanes, dtype=np.int64) * 256
    total, out = np.zeros(lanes, np.int32), np.empty((length, lanes), np.int16)
    for k in range(length + WINDOW - 1):
        at = base + steps[k]
        c = count[at]
        total += _STEP[c]
        count[at] = c + 1
        if k >= WINDOW - 1:
            out[k - WINDOW + 1] = np.maximum(total, 0) >> 4  # rounded terms may sum to a little under 0
            at = base + steps[k - WINDOW + 1]
            c = count[at] - 1
            total -= _STEP[c]
            count[at] = c
    return out.T.reshape(-1)[:n]


def whole_windows(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places begin a window that lies in one of the texts at starts..ends."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.maximum(ends - (WINDOW - 1), starts), 1)
    np.add.at(mark, ends, -1)
    return np.cumsum(mark[:n]) == 0


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy, 1 for the most frequent (the lower of equals first); 0 for those of nearly constant windows."""
    ranks = np.empty(ENTROPIES, np.int64)
    ranks[np.argsort(-counts, kind="stable")] = np.minimum(np.arange(ENTROPIES) + 1, ENTROPIES - 1)
    ranks[:LEAST] = 0
    return ranks


def entropy_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    counts = np.zeros(ENTROPIES, np.int64)
    for part in stretches(texts):
        data = np.frombuffer(b"".join(part), np.uint8)
        ends = np.cumsum([len(t) for t in part])
        valid = whole_windows(len(data), ends - [len(t) for t in part], ends)
        counts += np.bincount(window_entropy(data)[valid], minlength=ENTROPIES)
    return counts


def stretches(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in lists of about ``most`` bytes; longer ones cut into pieces whose windows are those of the whole, each once."""
    batch, held = [], 0
    for t in texts:
        for a in range(0, max(1, len(t) - WINDOW + 1), most):
            piece = t[a : a + most + WINDOW - 1]
            if held + len(piece) > 2 * most:
                yield batch
                batch, held = [], 0
            batch.append(piece)
            held += len(piece)
    if batch:
        yield batch


def rarity(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of all entropies by the windows of all texts of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ENTROPIES, np.int64)
        for batch in slices(batches, "t", 4 << 20):
            counts += entropy_counts([t for t in as_bytes(batch.column("t")) if t])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["entropy", "n"])

    told = df.select(df[text_col].alias("t")).mapInArrow(run, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n"))
    counts = np.zeros(ENTROPIES, np.int64)
    for r in told.collect():  # at most ENTROPIES rows
        counts[r["entropy"]] = r["n"]
    return ranks_of(counts)


def select_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Positions of the selected windows of texts that lie at starts..ends in ``data`` (whose length is below 2**22)."""
    n = len(data)
    valid = whole_windows(n, starts, ends)
    rare = ranks[window_entropy(data)]
    rare[~valid] = 0
    key = (rare << 22 | ((1 << 22) - 1 - np.arange(n))).astype(np.uint32)
    key[rare == 0] = 0
    best, span = key.copy(), 1
    while span < RUN:
        best[:-span] = np.maximum(best[:-span], best[span:])
        span *= 2
    best = best[valid & (best > 0)]
    points = np.bincount((1 << 22) - 1 - (best & ((1 << 22) - 1)).astype(np.int64), minlength=n)
    return np.flatnonzero(points >= POINTS)


def feature_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].view("<u8") if len(at) else np.zeros((0, 8), np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(8):
        h = (h ^ words[:, k]) * _MIX[k]
        h ^= h >> np.uint64(29)
    h *= _MIX[0]
    return h ^ h >> np.uint64(32)


def filters_of(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of filters, an array (filters, 256) of bytes."""
    out: list[np.ndarray] = []
    batch: list[bytes] = []
    held = 0
    for t in texts:
        t = t if len(t) >= WINDOW else t.ljust(WINDOW, b"\0") if t else b""
        if batch and held + len(t) > 1 << 21:
            out += _filters(batch, ranks)
            batch, held = [], 0
        batch.append(t)
        held += len(t)
    return out + (_filters(batch, ranks) if batch else [])


def _filters(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    if len(texts) == 1 and len(texts[0]) > 1 << 21:  # a very long text: overlapping stretches, whose features are joined in order
        step, t = 1 << 20, texts[0]
        found = []
        for a in range(0, len(t) - WINDOW + 1, step):
            lo = max(0, a - 2 * RUN)
            data = np.frombuffer(t[lo : a + step + 2 * RUN + WINDOW], np.uint8)
            at = select_features(data, np.array([0]), np.array([len(data)]), ranks)
            at = at[(at >= a - lo) & (at < a - lo + step)]
            found.append(feature_hashes(data, at))
        if not any(map(len, found)):
            found = [feature_hashes(np.frombuffer(t[:WINDOW], np.uint8), np.array([0]))]
        hashes, owner = np.concatenate(found), np.zeros(sum(map(len, found)), np.int64)
    else:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        at = select_features(data, starts, ends, ranks) if len(data) >= WINDOW else np.zeros(0, np.int64)
        bare = np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(texts)) == 0
        at = np.union1d(at, starts[bare & (ends > starts)]).astype(np.int64)  # whatever its rarity, the first window of a text without features
        hashes, owner = feature_hashes(data, at), np.searchsorted(ends, at, side="right")
    pair = np.empty(len(hashes), [("o", np.int64), ("h", np.uint64)])
    pair["o"], pair["h"] = owner, hashes
    first = np.sort(np.unique(pair, return_index=True)[1])
    hashes, owner = hashes[first], owner[first]
    n = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    chain = -(-n // PER_FILTER)
    at = np.repeat(np.cumsum(chain) - chain, n) + nth // PER_FILTER
    bits = np.zeros((int(chain.sum()), BITS), bool)
    for k in range(5):
        bits[at, (hashes >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return np.split(packed, np.cumsum(chain)[:-1]) if len(texts) else []


def as_text(filters: np.ndarray) -> str:
    return f"{len(filters)}:{base64.b64encode(filters.tobytes()).decode()}"


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    if len(a) > 1 and na[-1] < 64:  # a last filter of a few features says little
        a, na = a[:-1], na[:-1]
    total = 0.0
    for row, ones in zip(a, na):
        common = np.bitwise_count(row & b).sum(1, dtype=np.int64)
        least = np.minimum(ones, nb)
        chance = ones * nb / BITS
        cut = chance + 0.3 * (least - chance)
        total += max(0.0, float(((common - cut) / np.maximum(least - cut, 1e-9)).max()))
    return min(1.0, total / len(a))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """``id_col`` and ``fingerprint`` of every row, by the ranks given (else those of ``df``)."""
    ranks = rarity(df, text_col) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(map(as_text, filters_of([t or b"" for t in as_bytes(batch.column("t"))], ranks)), pa.string())], ["i", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"i {kind}, fingerprint string").withColumnRenamed("i", id_col)


def compared(docs: list[str], after: str, ranks: np.ndarray) -> list[tuple]:
    """n_chars, edited_sha256, both fingerprints and both likenesses of each text; ``after`` follows the last."""
    follow = [*docs[1:], after]
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(docs, follow)]
    raw = [t.encode() for t in edited]
    found = filters_of([*(t.encode() for t in docs), after.encode(), *raw], ranks)
    own, changed = found[: len(docs) + 1], found[len(docs) + 1 :]
    return [(len(t), hashlib.sha256(raw[k]).hexdigest(), as_text(own[k]), as_text(changed[k]), likeness(own[k], changed[k]), likeness(own[k], own[k + 1])) for k, t in enumerate(docs)]


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """Every text's fingerprint, that of its text with the end taken from the next, and its likeness to that and to the next.

    Texts are dealt once, by ranges of the id; the first row of each range also
    goes to the range before it.
    """
    spark, n = df.sparkSession, parts_of(df.sparkSession)
    ranks = rarity(df, text_col) if ranks is None else ranks
    ids = df.select(df[id_col].alias("i"))
    ranges = ids.where("i is not null").repartitionByRange(n, "i").groupBy(F.spark_partition_id().alias("p")).agg(F.min("i").alias("i")).orderBy("i").collect()  # a row for each range
    has_null = bool(ids.where("i is null").limit(1).count())
    cuts = [r["i"] for r in ranges]
    last = max(0, len(cuts) - 1)
    kind = df.schema[id_col].dataType.simpleString()
    edge = F.lit(cuts).cast(f"array<{kind}>") if cuts else F.array().cast(f"array<{kind}>")
    own = F.when(F.col("i").isNull() | (F.size(edge) == 0), 0).otherwise(F.greatest(F.lit(0), F.size(F.filter(edge, lambda x: x <= F.col("i"))) - 1))
    wraps = F.col("i").isNull() if has_null else F.col("i") == edge[0] if cuts else F.lit(False)
    ahead = F.when(wraps, F.lit(last)).when(F.array_contains(edge, F.col("i")), own - 1)
    goes = F.array_compact(F.array(F.struct(own.alias("part"), F.lit(0).alias("ahead")), F.when(ahead >= 0, F.struct(ahead.alias("part"), F.lit(1).alias("ahead")))))
    if has_null and cuts:  # the first row with an id follows the nulls, in the same range
        goes = F.when(F.col("i") == edge[0], F.array(F.struct(own.alias("part"), F.lit(0).alias("ahead")))).otherwise(goes)
    spots = F.lit(placed(spark, n)).cast("array<bigint>")
    dealt = df.select(df[id_col].alias("i"), df[text_col].alias("t")).select("i", "t", F.explode(goes).alias("to")).select("i", "t", "to.part", "to.ahead")
    dealt = dealt.repartition(n, F.get(spots, F.col("part"))).sortWithinPartitions("part", "ahead", F.asc_nulls_first("i"), F.asc_nulls_first("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[str] = []
        idents: list = []
        held = 0
        at, ended = None, False

        def out(after: str) -> pa.RecordBatch:
            cols = list(zip(*compared(docs, after, ranks)))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(idents, id_kind), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["i", *NAMES])

        for batch in batches:
            id_kind = batch.schema.field("i").type
            for i, t, part, is_ahead in zip(*(batch.column(c).to_pylist() for c in ("i", "t", "part", "ahead"))):
                t = t or ""
                if part != at:
                    at, ended = part, False
                if ended:
                    continue
                if is_ahead:
                    if docs:
                        yield out(t)
                    docs, idents, held, ended = [], [], 0, True
                    continue
                if held > 2 << 20:
                    yield out(t)
                    docs, idents, held = [], [], 0
                docs.append(t)
                idents.append(i)
                held += len(t)

    return dealt.mapInArrow(run, f"i {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("i", id_col)


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
