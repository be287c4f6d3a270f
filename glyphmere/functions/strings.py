"""Column functions over single strings and pairs; a null argument gives null."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmere.functions import alignment
from glyphmere.functions.tables import Sources, confusables, scripts

ASCII = r"^[\x00-\x7F]*$"
#: ASCII characters that identifiers may hold (Unicode Standard 39).
PLAIN = r"^[A-Za-z0-9'\-.:_]*$"
SEPARATORS = "-_./"
# The characters with the Unicode property White_Space.
WHITE_SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(s, F.lit(WHITE_SPACE))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b).cast("long")


def skeleton(s: Column, sources: Sources = Sources()) -> Column:
    """The string with every character replaced by what it looks like, in one pass, all in the JVM.

    Characters with one look-alike are translated together. The others are looked
    up in strings that have any; so is a character whose look-alike is itself one
    that is replaced.
    """
    table = confusables(sources)
    for pair, looks in table.digraphs.items():
        s = F.replace(s, F.lit(pair), F.lit(looks))
    ascii_only = {chr(c): t for c, t in table.table.items() if c < 128}
    native = _replaced(s, {c: t for c, t in ascii_only.items() if len(t) == 1})
    for c, t in ascii_only.items():
        if len(t) != 1:
            native = F.replace(native, F.lit(c), F.lit(t))
    single = {chr(c): t for c, t in table.table.items() if len(t) == 1 and ord(t) not in table.table}
    longer = {chr(c): t for c, t in table.table.items() if chr(c) not in single}
    other = _replaced(s, single)
    if longer:
        looks = F.str_to_map(F.lit("\x02".join(f"{c}\x01{t}" for c, t in longer.items() if c not in "\x01\x02")), F.lit("\x02"), F.lit("\x01"))
        one_by_one = F.array_join(F.transform(F.split(other, ""), lambda c: F.coalesce(F.try_element_at(looks, c), c)), "")
        other = F.when(other.rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in longer) + "]"), one_by_one).otherwise(other)
    return F.when(s.rlike(ASCII), native).otherwise(other)


def _replaced(s: Column, single: dict[str, str]) -> Column:
    return F.translate(s, "".join(single), "".join(single.values())) if single else s


def _present(*columns: pd.Series) -> np.ndarray:
    return np.logical_and.reduce([c.notna().to_numpy() for c in columns])


def _longs(values: np.ndarray, ok: np.ndarray) -> pd.Series:
    """``values`` where ``ok`` holds, else null."""
    full = np.zeros(len(ok), np.int64)
    full[ok] = values
    return pd.Series(pd.arrays.IntegerArray(full, ~ok))


@functools.lru_cache(maxsize=1)
def _damerau_udf():
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = _present(a, b)
        return _longs(alignment.distances(a[ok].tolist(), b[ok].tolist()), ok)

    return F.pandas_udf(run, "long").asNondeterministic()


def damerau(a: Column, b: Column) -> Column:
    """Edits, with adjacent swaps, where no part is edited twice (optimal string alignment)."""
    return _damerau_udf()(a, b)


ALIGNED = T.StructType().add("damerau", "long").add("uts39_confusable_count", "long").add("keyboard_distance", "double")


@functools.lru_cache(maxsize=16)
def _aligned_udf(sources: Sources, skeletons: bool):
    table = confusables(sources)

    def told(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        ok = _present(a, b)
        dist, count, keys = alignment.aligned(a[ok].tolist(), b[ok].tolist(), table)
        full = np.full(len(ok), np.nan)
        full[ok] = keys
        return pd.DataFrame({"damerau": _longs(dist, ok), "uts39_confusable_count": _longs(count, ok), "keyboard_distance": pd.arrays.FloatingArray(np.nan_to_num(full), np.isnan(full))})

    def both(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        ok = _present(x, y)
        return told(a, b).assign(skeleton_damerau=_longs(alignment.distances(x[ok].tolist(), y[ok].tolist()), ok))

    if skeletons:
        return F.pandas_udf(both, T.StructType(list(ALIGNED.fields)).add("skeleton_damerau", "long")).asNondeterministic()
    return F.pandas_udf(told, ALIGNED).asNondeterministic()


def aligned(a: Column, b: Column, sources: Sources = Sources(), skeletons: tuple[Column, Column] | None = None) -> Column:
    """Struct of the distance, confusable substitutions and keyboard distance of one alignment, and with ``skeletons`` their distance."""
    return _aligned_udf(sources, skeletons is not None)(a, b, *(skeletons or ()))


@functools.lru_cache(maxsize=1)
def _level_udf():
    table = scripts()

    def run(s: pd.Series) -> pd.Series:
        return s.map(table.level, na_action="ignore").astype("Int64")

    return F.pandas_udf(run, "long")


def restriction_level(s: Column) -> Column:
    """0 ASCII only, 1 single script, 2 to 4 highly to minimally restrictive, 5 unrestricted; ASCII stays in the JVM."""
    ascii_only = s.rlike(ASCII)
    return F.when(ascii_only, F.when(s.rlike(PLAIN), F.lit(0)).otherwise(5)).otherwise(_level_udf()(F.when(~ascii_only, s))).cast("long")


def _delimited_part(p: Column, q: Column) -> Column:
    """Whether ``q`` begins with ``p`` and a separator, ends with one and ``p``, or has ``p`` between two."""
    marks = list(SEPARATORS)
    head = F.startswith(q, p) & F.substring(q, F.length(p) + 1, F.lit(1)).isin(marks)
    tail = F.endswith(q, p) & F.substring(q, -F.length(p) - 1, F.lit(1)).isin(marks)
    one = F.lit("-")
    inside = F.contains(F.translate(q, SEPARATORS, "----"), F.concat(one, p, one)) & (F.translate(p, SEPARATORS, "") == p)
    return (F.length(p) >= 3) & (F.length(p) < F.length(q)) & (head | tail | inside)


def is_combosquat(a: Column, b: Column) -> Column:
    """Whether the shorter name (of 3 characters or more) is a delimited prefix, suffix or part of the longer, whatever the case."""
    x, y = F.lower(a), F.lower(b)
    return _delimited_part(x, y) | _delimited_part(y, x)


def register(spark, sources: Sources = Sources()) -> None:
    """Makes damerau, aligned, skeleton, restriction_level callable from SQL."""
    table, levels = confusables(sources), scripts()
    spark.udf.register("osa_damerau", _damerau_udf())
    spark.udf.register("osa_aligned", _aligned_udf(sources, False))
    spark.udf.register("skeleton", F.pandas_udf(lambda s: s.map(table.skeleton, na_action="ignore"), "string"))
    spark.udf.register("restriction_level", F.pandas_udf(lambda s: s.map(levels.level, na_action="ignore").astype("Int64"), "long"))
