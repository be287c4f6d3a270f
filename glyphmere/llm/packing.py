"""Best-fit packing of tokenised documents by bin completion branch-and-bound.

1. Every document becomes token ids plus an end id; only documents longer than
   the capacity are cut, into whole pieces of the capacity, the first of which
   may be shorter. Pieces go to a stored table without their text.
2. How many pieces have each length is at most ``capacity`` numbers, whatever
   the corpus. On the driver, branch-and-bound over that histogram completes
   bins around the longest piece left: it enumerates undominated fillings,
   least waste first, applies one as often as supplies allow (so each step
   uses up a length, which bounds the plan by ``capacity`` patterns), prunes
   by lower and waste bounds, and starts from a best-fit-decreasing incumbent.
   Steps, branches a bin and fillings looked at are parameters; without limits
   and with ``one_by_one`` the search is exhaustive. The lower bound on the number
   of sequences is returned with the pieces, so what may be left to gain shows.
3. Each piece finds its place from its length and its rank among pieces of
   that length. Ranks come from counts by (task, length), so a length that
   many pieces share is never gathered in one task.

Null text counts as empty: one piece that holds the end id alone. Repeated
rows and repeated ids are packed as separate documents. An empty table gives
no rows.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmere.llm._common import as_bytes, slices, stored

#: Steps of the search, branches tried of each bin, and fillings looked at to find them. The plan is whole whatever they are.
SEARCH_STEPS, BRANCHES, LOOKS = 2_500, 3, 2_000

Counts = dict[int, int]
Plan = list[tuple[tuple[int, ...], int]]

#: The pre-tokens of byte-level files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space outside the ASCII blanks.
_OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


class QuickTokenizer:
    """Ids of a byte-level BPE file.

    Texts with white space beyond the ASCII blanks, of which pattern engines think
    differently, or with a special token, go to the tokenizers library, as do all
    texts where the file is of another kind.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.quick = self._quick(path)

    @staticmethod
    def _quick(path: str):
        """The same merges by ``tiktoken``, several times as fast, where ids follow the order of merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        if any(vocab[t] != 256 + k for k, t in enumerate(made)) or sorted(vocab[c] for c in letters) != list(range(256)):
            return None
        ranks = {bytes(letters[c] for c in t): vocab[t] for t in [*letters, *made]}
        return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, raw: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        text = raw.decode("utf-8")
        if self.quick is None or _OTHER_BLANK.search(text) or any(s in text for s in self.special):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.quick.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False).tobytes()


_tokenizers: dict[str, QuickTokenizer] = {}


def quick_tokenizer(path: str) -> QuickTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = QuickTokenizer(path)
    return _tokenizers[path]


def piece_lengths(n: int, capacity: int) -> list[int]:
    """A document's pieces: all but the first are whole."""
    whole, rest = divmod(n, capacity)
    return [rest] * bool(rest) + [capacity] * whole


def pieces(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: document, piece, start, length, ids_crc32, and the task and rank by which it is placed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen = quick_tokenizer(tokenizer), np.zeros(capacity + 1, np.int64)
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "t"):
            rows: list[tuple] = []
            source: list[int] = []
            for k, raw in enumerate(as_bytes(batch.column("t"))):
                ids = t.ids(raw or b"") + end
                at = 0
                for j, n in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    rows.append((j, at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)]), part, int(seen[n])))
                    source.append(k)
                    seen[n] += 1
                    at += n
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(source, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["i", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"i {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long").withColumnRenamed("i", id_col)


def lower_bound(counts: Counts, capacity: int) -> int:
    """Fewest sequences that could do: by total length, and for each threshold by the pieces too long to share (Martello and Toth)."""
    sizes = sorted(counts, reverse=True)
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for least in {s for s in sizes if 2 * s <= capacity} | {0}:
        alone = sum(n for s, n in counts.items() if s > capacity - least)
        halves = {s: n for s, n in counts.items() if capacity - least >= s and 2 * s > capacity}
        room = sum((capacity - s) * n for s, n in halves.items())
        small = sum(s * n for s, n in counts.items() if least <= s and 2 * s <= capacity)
        best = max(best, alone + sum(halves.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: Counts, capacity: int) -> Plan:
    """Best-fit decreasing over the histogram: bins that hold the same pieces are kept as one entry with their number."""
    open_bins: dict[int, list[list]] = {}  # room -> [[pieces, number of bins], ...]
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            room = min((r for r in open_bins if r >= s), default=None)
            if room is None:
                per = min(capacity // s, left)
                bins = left // per
                open_bins.setdefault(capacity - per * s, []).append([(s,) * per, bins])
                left -= per * bins
                continue
            held = open_bins[room][-1]
            per = min(room // s, left)
            bins = min(held[1], left // per)
            held[1] -= bins
            if not held[1]:
                open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            open_bins.setdefault(room - per * s, []).append([held[0] + (s,) * per, bins])
            left -= per * bins
    return [(tuple(p), n) for groups in open_bins.values() for p, n in groups]


def fillings(counts: Counts, room: int, most_waste: int, looks: int | None = None) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``room``, least waste first, then longest pieces first; of the first ``looks`` ways.

    One is dominated if a piece left over still fits, or could replace a shorter one in it.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    reach = [1] * (len(sizes) + 1)  # reach[i]: bit t set if sizes[i:] can sum to t
    mask = (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        bits, step, n = reach[i + 1], 1, min(counts[sizes[i]], room // sizes[i])
        while n > 0:
            take = min(step, n)
            bits |= (bits << (take * sizes[i])) & mask
            n, step = n - take, step * 2
        reach[i] = bits

    def search(i: int, target: int) -> Iterator[tuple[int, ...]]:
        if target == 0:
            yield ()
            return
        while i < len(sizes) and (sizes[i] > target or not reach[i] >> target & 1):
            if not reach[i] >> target & 1:
                return
            i += 1
        if i == len(sizes):
            return
        s = sizes[i]
        for k in range(min(counts[s], target // s), -1, -1):
            if reach[i + 1] >> (target - k * s) & 1:
                for rest in search(i + 1, target - k * s):
                    yield (s,) * k + rest

    looked = 0
    for waste in range(min(room, most_waste) + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        for found in search(0, room - waste):
            looked += 1
            if looks is not None and looked > looks:
                return
            if waste:
                left = {s for s in sizes if counts[s] > found.count(s)}
                if any(s <= waste for s in left) or any(x < s <= x + waste for x in set(found) for s in left):
                    continue
            yield found


def longest_first(counts: Counts, room: int) -> tuple[int, ...]:
    """The filling that takes the longest piece that fits, again and again."""
    found: list[int] = []
    for s in sorted(counts, reverse=True):
        k = min(counts[s], room // s)
        found += [s] * k
        room -= k * s
    return tuple(found)


def complete_bins(counts: Counts, capacity: int, steps: int | None = SEARCH_STEPS, branches_a_bin: int | None = BRANCHES, looks: int | None = LOOKS, one_by_one: bool = False) -> Plan:
    """Patterns and how often each is used: as few bins as the search finds.

    ``None`` lifts a limit. ``one_by_one`` tries each pattern for one bin at a
    time, where else it is used as often as supplies allow.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    best = best_fit(counts, capacity)
    fewest, target = sum(n for _, n in best), lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    if not counts or fewest == target:
        return best
    left, plan, used, wasted = dict(counts), [], 0, 0
    stack: list[Iterator] = []

    def branches() -> Iterator[tuple[int, ...]]:
        longest = max(left)
        left[longest] -= 1
        allowed = (fewest - 1) * capacity - total - wasted
        others = {s: n for s, n in left.items() if n}
        found = list(itertools.islice(fillings(others, capacity - longest, allowed, looks), branches_a_bin))
        if not found and looks is not None:  # none among those looked at
            found = [longest_first(others, capacity - longest)]
        left[longest] += 1
        return iter([(longest, *f) for f in found])

    stack.append(branches())
    step = 0
    while stack and (steps is None or step < steps) and fewest > target:
        step += 1
        pattern = next(stack[-1], None)
        if pattern is None:
            stack.pop()
            if plan:
                undone, times = plan.pop()
                used, wasted = used - times, wasted - times * (capacity - sum(undone))
                for s in undone:
                    left[s] = left.get(s, 0) + times
            continue
        need = {s: pattern.count(s) for s in pattern}
        times = 1 if one_by_one else min(left[s] // k for s, k in need.items())
        slack = capacity - sum(pattern)
        if slack:
            times = max(1, min(times, ((fewest - 1) * capacity - total - wasted) // slack))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        plan.append((pattern, times))
        used, wasted = used + times, wasted + times * slack
        if not left:
            if used < fewest:
                best, fewest = list(plan), used
            stack.append(iter(()))
            continue
        if len(left) < 24 or len(plan) % 64 == 0:
            rest = best_fit(left, capacity)
            if used + (n := sum(t for _, t in rest)) < fewest:
                best, fewest = plan + rest, used + n
        stack.append(branches() if used - (used * capacity - wasted - total) // capacity < fewest else iter(()))
    return best


def places(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first sequence, first offset), by length and rank."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in plan:
        at = 0
        for s in sorted(set(pattern), reverse=True):
            k = pattern.count(s)
            rows.append((s, taken.get(s, 0), k, sequence, at))
            taken[s] = taken.get(s, 0) + k * times
            at += k * s
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document; least_sequences: that no packing needs fewer than."""
    spark = df.sparkSession
    made = stored(pieces(df, tokenizer, capacity, end_id, id_col, text_col).withColumnRenamed(id_col, "i"), "pieces")
    by_task = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = spark.sparkContext.broadcast(places(complete_bins(counts, capacity)))  # at most capacity patterns
    least = lower_bound(counts, capacity) if counts else 0
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t[:, 0] << 42 | t[:, 1]
        for b in batches:
            rank = b.column("rank").to_numpy()
            row = t[np.searchsorted(key, b.column("length").to_numpy() << 42 | rank, side="right") - 1] if b.num_rows else t[:0]
            nth = rank - row[:, 1]
            names = ["i", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * row[:, 0])], [*names, "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    ranked = made.join(before, ["part", "length"]).select("i", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, f"i {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("i", id_col).withColumn("least_sequences", F.lit(least).cast("long"))
