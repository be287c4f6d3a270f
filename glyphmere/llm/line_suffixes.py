"""Line deduplication with a suffix array over line ids.

Suffixes of the documents' line sequences are ranked by prefix doubling: the rank
by the first 2h lines is the order of the pairs (rank by h lines here, rank by h
lines h lines on), numbered after a range-partitioned sort of the distinct pairs.
Suffixes whose first lines stand nowhere else drop out, so rounds shrink until
none is left. Suffixes of one rank are an interval of the suffix array whose
longest common prefix has h lines or more; its first place (by id, then line) is
its lead. From the deepest rank down, each suffix's interval is then narrowed, by
the binary digits of its length, to the deepest one that still holds an earlier
place: that is the longest run from there on that has stood before, and the
interval's lead is its first copy. Runs that lie in no longer one are maximal.
Every maximal run of ``min_lines`` lines and ``min_chars`` characters or more is
deleted; the first copy of each run stays.

Documents of one text are ranked once; of these the first (least id) counts, and
the text of the others is one run of it. Rows with the same id and text are one
document, and all get its result. Null text has no lines and stays null; null ids
come first. Lines are those between line feeds; empty ones count as lines. An
empty table gives no rows. Columns named runs, n_lines, n_cut and rest are
replaced. Lines and texts are told apart by 128-bit hashes. Groups that hold a
large share of all rows (a very common line) are joined by broadcast, of which
there are at most ``4 * partitions``; so no join is by a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmere.llm._common import as_bytes, forget, parts_of, slices, spread_join, stored



def _at() -> Column:
    """A place, as places are ordered."""
    return F.struct("doc", "pos")


def text_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"))


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (struct of least id and text hash), pos, a, b (the line's hash), for each line of each distinct text."""
    split = df.select(F.struct(df[id_col].alias("id")).alias("i"), text_hash(df[text_col]).alias("h"), F.posexplode(F.split(df[text_col], "\n")).alias("pos", "line"))
    hashed = split.select("i", "h", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"))
    first = hashed.groupBy("h", "pos", "a", "b").agg(F.min("i").alias("i"))
    return first.select(F.struct(F.col("i.id").alias("id"), "h").alias("doc"), "pos", "a", "b")


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame | None:
    """Rows of the stored pairs (doc, pos, *keys) that share their keys, with the keys' rank and the group's lead; None if there are none.

    Groups, not rows, are sorted, so a very common pair is one row of the sort.
    """
    n = parts_of(pairs.sparkSession)
    groups = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("lead")).where("n > 1")
    groups = stored(groups.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "groups")
    shared = spread_join(pairs, groups, keys)
    ranks = None if shared is None else stored(shared.select("doc", "pos", "rank", "lead"), "suffixes")
    forget(pairs, groups)
    return ranks


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """For h = 1, 2, 4...: doc, pos, rank (by h lines), lead of the suffixes whose first h lines stand elsewhere too, as long as there are any."""
    levels = []
    ranks = _ranked(stored(lines, "pairs"), ["a", "b"])
    while ranks is not None:
        levels.append(ranks)
        h = 1 << (len(levels) - 1)
        on = ranks.select("doc", (F.col("pos") - h).alias("pos"), F.col("rank").alias("then"))
        pairs = ranks.select("doc", "pos", F.col("rank").alias("now")).join(on, ["doc", "pos"])
        ranks = _ranked(stored(pairs, "pairs"), ["now", "then"])
    return levels


def _narrowed(held: DataFrame, ranks: DataFrame, h: int) -> tuple[DataFrame, list[DataFrame]]:
    """Suffixes ``held`` (doc, pos, len, lead, asks) in intervals, after a try to lengthen them by ``h`` lines.

    An interval is known by its lead and length. Suffixes that ask move on to the
    longer interval if it holds an earlier place; an interval is kept, with all its
    suffixes, as long as one of them asks. Also the stored tables that this reads.
    """
    on = ranks.select(F.col("doc").alias("doc2"), F.col("pos").alias("pos2"), F.col("rank").alias("g"))
    tried = held.join(on, (F.col("doc") == F.col("doc2")) & (F.col("pos") + F.col("len") == F.col("pos2")), "left")
    tried = stored(tried.select("doc", "pos", "len", "lead", "asks", F.coalesce("g", F.lit(-1)).alias("g")), "tried")
    asks = F.col("asks").cast("long")
    longer = tried.groupBy("lead", "len", "g").agg(F.count("*").alias("n"), F.sum(asks).alias("asking"), F.min(F.struct("doc", "pos", asks.alias("asks"))).alias("first"))
    left = F.when(F.col("g") < 0, F.col("asking")).otherwise(F.col("first.asks"))
    longer = stored(longer.select("lead", "len", "g", "n", F.struct("first.doc", "first.pos").alias("deeper"), left.alias("left"), ((F.col("g") >= 0) & (F.col("asking") > F.col("first.asks"))).alias("moves")), "intervals")
    stays = longer.groupBy("lead", "len").agg((F.sum("left") > 0).alias("stays"), F.count("*").alias("kinds"))
    wanted = spread_join(longer, stays, ["lead", "len"], "kinds").where("stays or moves").drop("left", "kinds")
    rows = spread_join(tried, wanted, ["lead", "len", "g"])
    moved = (F.col("g") >= 0) & (F.col("deeper") < _at())
    here = F.when(F.col("stays"), F.struct("len", "lead", (F.col("asks") & ~moved).alias("asks")))
    there = F.when(F.col("moves"), F.struct((F.col("len") + h).alias("len"), F.col("deeper").alias("lead"), (F.col("asks") & moved).alias("asks")))
    return rows.select("doc", "pos", F.explode(F.array_compact(F.array(here, there))).alias("x")).select("doc", "pos", "x.len", "x.lead", "x.asks"), [tried, longer]


def earlier_runs(lines: DataFrame) -> DataFrame:
    """doc, pos, len, lead: for each place that has any, the longest run of lines from there on that begins at an earlier place too, and the first such place."""
    levels = suffix_ranks(lines)
    held = None
    for k in reversed(range(len(levels))):
        ranks = levels[k]
        new = ranks.select("doc", "pos", F.lit(1 << k).alias("len"), "lead", (F.col("lead") < _at()).alias("asks"))
        used = []
        if held is not None:  # those that ask in a deeper interval don't ask here
            known = levels[k + 1].where(F.col("lead") < _at()).select("doc", "pos", F.lit(True).alias("known"))
            new = new.join(known, ["doc", "pos"], "left").withColumn("asks", F.col("asks") & F.col("known").isNull()).drop("known")
            narrowed, used = _narrowed(held, ranks, 1 << k)
            new = narrowed.unionByName(new)
            used.append(held)
        held = stored(new.where("asks" if k == 0 else "true"), "held")  # in the end only those that ask matter
        forget(*used)
    forget(*levels)
    if held is None:
        return lines.select("doc", "pos", F.lit(1).alias("len"), F.struct("doc", "pos").alias("lead")).where("false")
    return held.drop("asks")


def maximal_runs(lines: DataFrame) -> DataFrame:
    """Those of ``earlier_runs`` that lie in no longer one: doc, pos, end, lead."""
    by_doc = Window.partitionBy("doc").orderBy("pos")
    ends = earlier_runs(lines).select("doc", "pos", (F.col("pos") + F.col("len")).alias("end"), "lead")
    before = ends.withColumn("before", F.lag(F.struct("pos", "end")).over(by_doc))
    return before.where("before is null or before.pos < pos - 1 or before.end < end").drop("before")


def suffix_array(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rounds: int = 40) -> DataFrame:
    """doc, pos, order: the suffix array of all distinct texts' line sequences, ranked until every suffix stands alone.

    A document's end comes before any line. Equal suffixes of different
    documents have one order.
    """
    hashed = lines_of(df, id_col, text_col)
    lines = hashed.groupBy("a", "b").agg(F.count("*").alias("n")).repartitionByRange(parts_of(df.sparkSession), "a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id())
    ranks = stored(hashed.join(stored(lines, "groups"), ["a", "b"]).select("doc", "pos", "rank"), "suffixes")
    h = 1
    for _ in range(most_rounds):
        on = ranks.select("doc", (F.col("pos") - h).alias("pos"), F.col("rank").alias("then"))
        pairs = stored(ranks.join(on, ["doc", "pos"], "left").select("doc", "pos", "rank", F.coalesce("then", F.lit(-1)).alias("then")), "pairs")  # -1: the document ends there
        groups = pairs.groupBy("rank", "then").agg(F.count("*").alias("n"))
        groups = stored(groups.repartitionByRange(parts_of(df.sparkSession), "rank", "then").sortWithinPartitions("rank", "then").withColumn("named", F.monotonically_increasing_id()), "groups")
        ranks, h = stored(pairs.join(groups, ["rank", "then"]).select("doc", "pos", F.col("named").alias("rank")), "suffixes"), 2 * h
        if not groups.where("n > 1 and then >= 0").limit(1).count():
            break
    return ranks.select("doc", "pos", F.col("rank").alias("order"))


def without_lines(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    lines, out, last = raw.split(b"\n"), [], 0
    for a, b in runs:
        out += lines[last:a]
        last = b
    return b"\n".join(out + lines[last:])


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def listed_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i (struct of the id), h (of the text), runs: the maximal runs of each document, by their first line; of a later copy of a text, the whole."""
    runs = maximal_runs(lines_of(df, id_col, text_col))
    run = F.struct(F.col("pos").alias("first"), "end", F.col("lead.doc.id").alias("of"), F.col("lead.pos").alias("of_line"))
    own = stored(runs.groupBy("doc").agg(F.sort_array(F.collect_list(run)).alias("runs")).select(F.struct("doc.id").alias("i"), F.col("doc.h").alias("h"), "runs"), "runs")
    texts = df.where(df[text_col].isNotNull()).select(F.struct(df[id_col].alias("id")).alias("i"), text_hash(df[text_col]).alias("h"), F.size(F.split(df[text_col], "\n")).alias("n_lines"))
    texts = stored(texts.distinct(), "texts")
    groups = texts.groupBy("h", "n_lines").agg(F.count("*").alias("n"), F.min("i").alias("i")).where("n > 1")
    first = F.col("runs")[0]
    whole = F.when((first["first"] == 0) & (first["end"] == F.col("n_lines")), first).otherwise(F.struct(F.lit(0).alias("first"), F.col("n_lines").alias("end"), F.col("i.id").alias("of"), F.lit(0).alias("of_line")))
    groups = groups.join(own, ["i", "h"], "left").select("h", "n", F.col("i").alias("lead"), F.array(whole).alias("runs"))
    copies = spread_join(texts, stored(groups, "copies"), ["h"])
    return own if copies is None else own.unionByName(copies.where(F.col("i") != F.col("lead")).select("i", "h", "runs"))


def dedup(df: DataFrame, min_lines: int = 1, min_chars: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with runs (array of first, end: lines; of: id and of_line of the first copy), n_lines, n_cut and rest (the text without them)."""
    base = [c for c in df.columns if c not in ("runs", "n_lines", "n_cut", "rest")]
    listed = listed_runs(df, id_col, text_col).select(F.col("i").alias("i2__"), F.col("h").alias("h2__"), F.col("runs").alias("runs__"))
    keyed = df.select(*[df[c] for c in base], F.struct(df[id_col].alias("id")).alias("i__"), text_hash(df[text_col]).alias("h__"))
    joined = keyed.join(listed, (F.col("i__") == F.col("i2__")) & (F.col("h__") == F.col("h2__")), "left").drop("i__", "i2__", "h__", "h2__")
    id_kind = df.schema[id_col].dataType.simpleString()
    run_kind = f"array<struct<first: int, end: int, of: {id_kind}, of_line: int>>"
    schema = df.select([df[c] for c in base]).schema
    for name, kind in (("runs", run_kind), ("n_lines", "long"), ("n_cut", "long"), ("rest", "string")):
        schema = schema.add(name, T.DataType.fromDDL(kind))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 8 << 20):
            kept, total, gone, rest = [], [], [], []
            for t, runs in zip(as_bytes(batch.column(text_col)), batch.column("runs__").to_pylist()):
                runs = [r for r in runs or [] if r["end"] - r["first"] >= min_lines]
                if runs:
                    ends = [0]
                    for line in t.decode("utf-8").split("\n"):
                        ends.append(ends[-1] + len(line))
                    runs = [r for r in runs if ends[r["end"]] - ends[r["first"]] >= min_chars]
                spans = united([(r["first"], r["end"]) for r in runs])
                kept.append(runs)
                total.append(t.count(b"\n") + 1 if t is not None else 0)
                gone.append(sum(b - a for a, b in spans))
                rest.append((without_lines(t, spans) if runs else t).decode("utf-8") if t is not None else None)
            types = batch.schema.field("runs__").type
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in base), pa.array(kept, types), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(rest, pa.string())], [*base, "runs", "n_lines", "n_cut", "rest"])

    return joined.mapInArrow(cut, schema)
