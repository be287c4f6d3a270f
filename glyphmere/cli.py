"""Command line: python -m glyphmere.cli [options] A B | --stdin | --string S --list FILE."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import replace
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphmere.functions import verdict as V
from glyphmere.functions.normalize import PYPI, load_rules
from glyphmere.functions.tables import Sources
from glyphmere.plans.axes import metric_value, parse_fields, validate_metric
from glyphmere.plans.pairs import Config, score, watchlist
from glyphmere.sources import readers, writers

#: Lines of standard input scored at once.
BATCH = 10_000
USAGE = """usage: glyphmere [options] A B
       glyphmere [options] --stdin
       glyphmere [options] --string S --list FILE

  -t, --threshold F     keep pairs with a metric of at most F
  -m, --metric AXIS     numeric axis for -t and ranking (skeleton_damerau; with --typosquat damerau)
  --fields LIST         axes to print
  --confusables LIST    uts39, flowcrypt, digraph
  --len-tolerance F     for the spoof verdict, 0 to 1 (0.25)
  --typosquat           classify, and keep likely typosquats and combosquats
  --pypi                normalise as Python package names
  -n, --normalize FILE  normalise by the rules of a JSON file
  --sort, --top N       rank by the metric (with --list)
  -j, --json            JSON for a single pair
  -v, -h                versions, this text
"""


def parse(argv: list[str]) -> dict:
    """Options as a dict; ValueError for what isn't allowed."""
    o: dict = {"json": False, "stdin": False, "string": None, "list": None, "args": [], "ops": (), "cfg": {}}
    c, pypi, it = o["cfg"], False, iter(argv)

    def value(name: str) -> str:
        v = next(it, None)
        if v is None:
            raise ValueError(f"{name} needs a value")
        return v

    def number(name: str, kind):
        try:
            return kind(value(name))
        except ValueError as e:
            raise e if "needs" in str(e) else ValueError(f"invalid {name}") from None

    for a in it:
        if a in ("-h", "--help"):
            o["help"] = True
        elif a in ("-v", "--version"):
            o["version"] = True
        elif a in ("-j", "--json"):
            o["json"] = True
        elif a in ("-s", "--stdin"):
            o["stdin"] = True
        elif a == "--sort":
            c["sort"] = True
        elif a in ("--string", "--list"):
            o[a[2:]] = value(a)
        elif a == "--top":
            c["top"], c["sort"] = number(a, int), True
        elif a in ("-m", "--metric"):
            c["metric"] = validate_metric(value(a))
        elif a == "--typosquat":
            c["typosquat"] = True
        elif a == "--pypi":
            if pypi:
                raise ValueError("duplicate --pypi")
            pypi, o["ops"] = True, o["ops"] + PYPI
        elif a in ("-n", "--normalize"):
            o["ops"] += load_rules(value(a))
        elif a == "--fields":
            c["fields"] = parse_fields(value(a))
        elif a == "--confusables":
            c["sources"] = Sources.parse(value(a))
        elif a == "--len-tolerance":
            c["len_tolerance"] = number(a, float)
        elif a in ("-t", "--threshold"):
            c["threshold"] = number(a, float)
        elif a.startswith("-") and len(a) > 1:
            raise ValueError(f"unknown option: {a}")
        else:
            o["args"].append(a)
    if o.get("help") or o.get("version"):
        return o
    o["cfg"] = Config(norm_ops=o["ops"], **c)
    if o["list"] is not None or o["string"] is not None:
        if o["list"] is None or o["string"] is None:
            raise ValueError("--list and --string must be used together")
        if o["stdin"] or o["args"]:
            raise ValueError("--list takes neither --stdin nor other arguments")
    elif o["stdin"] and o["args"]:
        raise ValueError("--stdin takes no other arguments")
    elif not o["stdin"] and len(o["args"]) != 2:
        raise ValueError(f"expected 2 string arguments, got {len(o['args'])}")
    return o


def _single(spark: SparkSession, o: dict, out) -> int:
    cfg: Config = o["cfg"]
    a, b = o["args"]
    wide = Config(fields=None, norm_ops=cfg.norm_ops, sources=cfg.sources, len_tolerance=cfg.len_tolerance)
    df = score(readers.single_pair(spark, a, b), cfg=wide)
    on = bool(cfg.norm_ops)
    na, nb = (F.col("a_normalized"), F.col("b_normalized")) if on else (F.col("a"), F.col("b"))
    identical = F.col("a") == F.col("b")
    same = (~identical & (na == nb)) if on else F.lit(False)
    x, y = F.when(identical | same, F.col("a")).otherwise(na), F.when(identical | same, F.col("b")).otherwise(nb)
    label, reason = V.classified(identical, same, x, y, F.col("damerau"), F.col("confusable_only"), F.col("keyboard_distance"))
    tag, why = V.verdict(F.col("a"), F.col("b"), F.col("equal"), F.col("damerau"), F.col("skeleton_damerau"), F.col("uts39_skeleton_delta"), F.col("confusable_only"), same, cfg.len_tolerance)
    row = df.select("*", label.alias("classification"), reason.alias("reason"), tag.alias("tag"), why.alias("why"), metric_value(cfg.by).alias("metric")).first()
    if o["json"]:
        cols = ["a", "b", *(["a_normalized", "b_normalized"] if on else []), *cfg.shown, *(["classification", "reason"] if cfg.typosquat else [])]
        line = writers.json_lines(spark.createDataFrame([row], df.schema.add("classification", "string").add("reason", "string").add("tag", "string").add("why", "string").add("metric", "double")).select(*cols)).first()
        print(line["value"], file=out)
    else:
        norms = (row["a_normalized"], row["b_normalized"]) if on and (row["a_normalized"], row["b_normalized"]) != (a, b) else None
        told = (V.TAGS[row["classification"]], row["reason"]) if cfg.typosquat else (row["tag"], row["why"])
        print(writers.table(row, cfg.shown, *told, norms), file=out)
    return writers.OK if cfg.threshold is None or row["metric"] <= cfg.threshold else writers.NO_MATCH


def _batches(spark: SparkSession, cfg: Config, lines: Iterable[str], out) -> int:
    """Scores pair lines as they come, ``BATCH`` at a time, and prints results and malformed lines in their order; the number of results."""
    cfg = replace(cfg, sort=False, top=None)
    found = 0
    source = enumerate(line.rstrip("\n") for line in lines)
    while part := list(islice(source, BATCH)):
        good, bad = readers.split_pairs(spark.createDataFrame(part, "ord long, value string"), keep=("ord",))
        kept = score(good, cfg=cfg, gate=True, keep=("ord",))
        rows = [(r["ord"], r["value"], n) for n, df in enumerate((bad, kept)) for r in writers.json_lines(df, keep=("ord",)).collect()]
        for _, value, is_pair in sorted(rows):
            found += is_pair
            print(value, file=out)
        out.flush()
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, lines: list[str] | None = None) -> int:
    out = out or sys.stdout
    try:
        o = parse(sys.argv[1:] if argv is None else argv)
    except ValueError as e:
        print(f"error: {e}\n{USAGE}", file=sys.stderr)
        return writers.USAGE
    if o.get("help"):
        print(USAGE, file=out)
        return writers.OK
    spark = spark or SparkSession.builder.appName("glyphmere").getOrCreate()
    if o.get("version"):
        for r in writers.provenance(spark).collect():
            print(f"{r['part']} {r['version']}", file=out)
        return writers.OK
    cfg: Config = o["cfg"]
    if o["stdin"]:
        found = _batches(spark, cfg, sys.stdin if lines is None else lines, out)
    elif o["list"] is not None:
        try:
            listed = readers.names(spark, o["list"])
        except AnalysisException as e:
            print(f"error: cannot open --list file {o['list']!r}: {e.getCondition() or e}", file=sys.stderr)
            return writers.USAGE
        found = 0
        for r in writers.json_lines(watchlist(listed, o["string"], cfg)).toLocalIterator():
            found += 1
            print(r["value"], file=out)
    else:
        return _single(spark, o, out)
    filtered = cfg.threshold is not None or cfg.typosquat
    return writers.NO_MATCH if filtered and not found else writers.OK


if __name__ == "__main__":
    sys.exit(main())
