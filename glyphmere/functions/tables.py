"""Confusable, digraph, script and keyboard tables.

The confusable table is not shipped: it follows from the Unicode data in the
ICU library that Spark carries (one skeleton call over all code points), or is
read from a ``confusables.txt``. The supplemental look-alikes follow from a rule
(a letter with marks looks like its ASCII base) or are read from a JSON file.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Digraph and what it looks like.
DIGRAPHS = {"vv": "w", "cl": "d", "nn": "rn"}
# Rows of a US keyboard, their height and their shift to the right, in keys.
KEY_ROWS = (("1234567890-=", 0.0, 0.0), ("qwertyuiop[]", 1.0, 0.5), ("asdfghjkl;'", 2.0, 0.75), ("zxcvbnm,./", 3.0, 1.25))
# Scripts recommended for identifiers (Unicode Annex 31, table 5).
RECOMMENDED = "Arab Armn Beng Bopo Cyrl Deva Ethi Geor Grek Gujr Guru Hang Hani Hebr Hira Kana Khmr Knda Laoo Latn Mlym Mymr Orya Sinh Taml Telu Thaa Thai Tibt".split()
# Writing systems of several scripts.
SYSTEMS = {"Hani": ("Hanb", "Jpan", "Kore"), "Hira": ("Jpan",), "Kana": ("Jpan",), "Hang": ("Kore",), "Bopo": ("Hanb",)}
# Letters with a cedilla or comma below, and what they look like.
CEDILLAS = {0x00C7: "C\u0326", 0x00E7: "c\u0326", 0x0163: "\u01ab", 0x021A: "\u0162", 0x021B: "\u01ab"}
CARON, BREVE = "\u030c", "\u0306"
SOURCES = ("uts39", "flowcrypt", "digraph")


def key_places() -> dict[str, tuple[float, float]]:
    return {c: (x + shift, y) for keys, y, shift in KEY_ROWS for x, c in enumerate(keys)}


@dataclass(frozen=True)
class Sources:
    """Which tables make skeletons; ``uts39`` always does."""

    flowcrypt: bool = False
    digraph: bool = False
    confusables_path: str | None = None
    flowcrypt_path: str | None = None

    @classmethod
    def parse(cls, spec: str) -> Sources:
        names = [n.strip() for n in spec.split(",") if n.strip()]
        for n in names:
            if n not in SOURCES:
                raise ValueError(f"unknown confusables source: {n} (valid: {', '.join(SOURCES)})")
        return cls("flowcrypt" in names, "digraph" in names)


@dataclass
class Confusables:
    """Code points and their skeletons; ``digraphs`` are replaced first, in raw text."""

    table: dict[int, str]
    digraphs: dict[str, str] = field(default_factory=dict)

    def skeleton(self, s: str) -> str:
        if self.digraphs:
            for pair, looks in self.digraphs.items():  # their letters and targets don't overlap
                s = s.replace(pair, looks)
        return s.translate(self.table)

    def of(self, c: str) -> str:
        return self.table.get(ord(c), c)

    def confusable(self, x: str, y: str) -> bool:
        return x == y or self.of(x) == self.of(y)


def _jvm(spark: SparkSession | None):
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark.sparkContext._jvm


@functools.lru_cache(maxsize=1)
def _icu_table() -> dict[int, str]:
    """Skeletons that ICU gives single code points, and those of characters that decompose, which ICU decomposes first.

    A character that stands for another one has that one's skeleton; a letter
    with a caron looks like the one with a breve, where there is one.
    """
    jvm = _jvm(None)
    checker = getattr(jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    gap = "\ue000"
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not 0xE000 <= c < 0xF900 and c < 0xF0000 and unicodedata.category(chr(c)) != "Cn"]
    found: dict[int, str] = {}
    for a in range(0, len(points), 60_000):
        part = points[a : a + 60_000]
        looks = checker.getSkeleton(gap.join(map(chr, part))).split(gap)
        for c, s in zip(part, looks):
            if s and s != chr(c) and unicodedata.is_normalized("NFD", chr(c)):
                found[c] = s
    for c in points:
        parts = unicodedata.normalize("NFD", chr(c))
        if parts != chr(c):
            if len(parts) == 1:
                found[c] = found.get(ord(parts), parts)
            elif parts[1:] == CARON and len(breve := unicodedata.normalize("NFC", parts[0] + BREVE)) == 1:
                found[c] = breve
    return found | CEDILLAS


def confusables_from_text(spark: SparkSession, path: str) -> DataFrame:
    """cp, skeleton of a ``confusables.txt``: single code points, the last line of each."""
    raw = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("value", "#.*|\ufeff", ""), ";")
    rows = raw.select("at", F.trim(F.get(parts, F.lit(0))).alias("src"), F.trim(F.get(parts, F.lit(1))).alias("dst")).where("src rlike '^[0-9A-Fa-f]+$' and dst rlike '^[0-9A-Fa-f ]+$'")
    points = F.transform(F.split("dst", " +"), lambda h: F.conv(h, 16, 10).cast("int"))
    return rows.groupBy(F.conv("src", 16, 10).cast("int").alias("cp")).agg(F.max_by(points, "at").alias("points"))


def flowcrypt_from_json(spark: SparkSession, path: str, base: Confusables) -> DataFrame:
    """cp, skeleton of a look-alike list (base character -> similar characters): ASCII bases, look-alikes beyond ASCII; the lowest base wins."""
    kind = "map<string, array<struct<char: string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<characters: {kind}>")["characters"]).alias("base", "similar"))
    rows = rows.select("base", F.explode("similar.char").alias("c")).where("length(base) = 1 and ascii(base) < 128 and length(c) = 1 and ascii(c) > 127")
    looks = F.udf(base.skeleton, "string")
    return rows.groupBy(F.ascii("c").alias("cp")).agg(F.min("base").alias("base")).select("cp", looks("base").alias("skeleton"))


def _marked_letters(table: dict[int, str]) -> dict[int, str]:
    """The rule for supplemental look-alikes: letters whose decomposition is an ASCII letter or digit and marks."""
    found = {}
    for c in range(0x80, 0x2500):
        first, *marks = unicodedata.normalize("NFKD", chr(c))
        if first.isascii() and first.isalnum() and marks and all(unicodedata.combining(m) for m in marks):
            found[c] = first.translate(table)
    return found


@functools.lru_cache(maxsize=16)
def confusables(sources: Sources = Sources()) -> Confusables:
    spark = SparkSession.getActiveSession()
    if sources.confusables_path:
        rows = confusables_from_text(spark, sources.confusables_path).collect()
        table = {r["cp"]: "".join(map(chr, r["points"])) for r in rows}
    else:
        table = dict(_icu_table())
    if sources.flowcrypt:
        if sources.flowcrypt_path:
            more = {r["cp"]: r["skeleton"] for r in flowcrypt_from_json(spark, sources.flowcrypt_path, Confusables(table)).collect()}
        else:
            more = _marked_letters(table)
        table = more | table  # the Unicode table wins
    return Confusables(table, dict(DIGRAPHS) if sources.digraph else {})


def merged_tables(base: DataFrame, more: DataFrame) -> DataFrame:
    """cp, skeleton, source of two tables, the first of which wins."""
    return base.withColumn("source", F.lit("uts39")).unionByName(more.join(base.select("cp"), "cp", "left_anti").withColumn("source", F.lit("flowcrypt")))


@dataclass
class Scripts:
    """Identifier status and scripts of code points, as ranges."""

    allowed: list[int]
    ranges: dict[str, list[int]]

    def is_allowed(self, c: str) -> bool:
        return bisect_right(self.allowed, ord(c)) % 2 == 1

    def of(self, c: str) -> frozenset[str] | None:
        """Augmented scripts of a character; None: all."""
        cp = ord(c)
        found = {s for s, r in self.ranges.items() if bisect_right(r, cp) % 2 == 1}
        if not found or found & {"Zyyy", "Zinh"}:
            return None
        return frozenset(found | {x for s in found for x in SYSTEMS.get(s, ())})

    def level(self, text: str) -> int:
        """Restriction level (Unicode Standard 39): 0 ASCII, 1 one script, 2 highly, 3 moderately, 4 minimally restrictive, 5 none."""
        if not all(map(self.is_allowed, text)):
            return 5
        if text.isascii():
            return 0
        sets = [x for x in map(self.of, dict.fromkeys(text)) if x is not None]
        if not sets or frozenset.intersection(*sets):
            return 1
        rest = [x for x in sets if "Latn" not in x]
        common = frozenset.intersection(*rest) if rest else frozenset()
        if common & {"Jpan", "Kore", "Hanb"}:
            return 2
        return 3 if common & (set(RECOMMENDED) - {"Cyrl", "Grek"}) else 4


@functools.lru_cache(maxsize=1)
def scripts() -> Scripts:
    icu = _jvm(None).com.ibm.icu

    def edges(pattern: str) -> list[int]:
        s = icu.text.UnicodeSet(pattern)
        return [x for k in range(s.getRangeCount()) for x in (s.getRangeStart(k), s.getRangeEnd(k) + 1)]

    top = icu.lang.UCharacter.getIntPropertyMaxValue(icu.lang.UProperty.SCRIPT)
    names = [icu.lang.UScript.getShortName(k) for k in range(top + 1)]
    ranges = {n: e for n in names if (e := edges(f"[:scx={n}:]"))}
    ranges.pop("Zzzz", None)
    return Scripts(edges("[:Identifier_Status=Allowed:]"), ranges)
