"""Scoring plans: given pairs, one name against a list, and many against many."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmere.functions import strings as S
from glyphmere.functions import verdict as V
from glyphmere.functions.normalize import Op, normalized
from glyphmere.functions.tables import Sources, confusables
from glyphmere.plans.axes import metric_value, panel, parse_fields, validate_metric

TYPOSQUAT_FIELDS = ["equal", "damerau", "skeleton_damerau", "confusable_only", "keyboard_distance"]
#: Metrics that lengths and the bounded Levenshtein distance bound from below.
EDIT_METRICS = ("levenshtein", "damerau", "skeleton_levenshtein", "skeleton_damerau")


@dataclass(frozen=True)
class Config:
    """What to score, keep and return. Metric and fields default by profile."""

    fields: list[str] | str | None = None
    metric: str | None = None
    threshold: float | None = None
    typosquat: bool = False
    norm_ops: tuple[Op, ...] = ()
    sources: Sources = field(default_factory=Sources)
    len_tolerance: float = 0.25
    sort: bool = False
    top: int | None = None

    def __post_init__(self) -> None:
        if self.typosquat and self.threshold is not None:
            raise ValueError("typosquat cannot be combined with a threshold")
        if self.threshold is not None and self.threshold != self.threshold:
            raise ValueError("invalid threshold")
        if not 0.0 <= self.len_tolerance <= 1.0:
            raise ValueError("len_tolerance must be between 0.0 and 1.0")
        if self.top is not None and self.top < 1:
            raise ValueError("top must be a positive integer")
        validate_metric(self.by)
        _ = self.shown

    @property
    def by(self) -> str:
        return self.metric or ("damerau" if self.typosquat else "skeleton_damerau")

    @property
    def shown(self) -> list[str]:
        if self.fields is None:
            return TYPOSQUAT_FIELDS if self.typosquat else parse_fields(",".join(_ALL))
        return parse_fields(self.fields)

    @property
    def computed(self) -> list[str]:
        ranked = self.threshold is not None or self.sort or self.top is not None
        return parse_fields(self.shown + [self.by] * ranked + ["damerau", "confusable_only", "keyboard_distance"] * self.typosquat)


_ALL = ["equal", "levenshtein", "damerau", "skeleton_levenshtein", "skeleton_damerau", "uts39_confusable_count", "uts39_skeleton_delta", "confusable_only", "script_restriction", "keyboard_distance"]


def _prepared(df: DataFrame, a: str, b: str, cfg: Config) -> DataFrame:
    """Normalised strings, the identity gate, and the strings that are scored (__x, __y)."""
    on = bool(cfg.norm_ops)
    out = df.withColumns({"__na": normalized(F.col(a), cfg.norm_ops), "__nb": normalized(F.col(b), cfg.norm_ops)}) if on else df
    identical = F.col(a) == F.col(b)
    same = ~identical & (F.col("__na") == F.col("__nb")) if on else F.lit(False)
    out = out.withColumns({"__identical": identical, "__same": same})
    plain = F.col("__identical") | F.col("__same")
    pick = lambda raw, norm: F.when(plain, F.col(raw)).otherwise(F.col(norm)) if on else F.col(raw)
    return out.withColumns({"__x": pick(a, "__na"), "__y": pick(b, "__nb")})


def may_emit(x: Column, y: Column, cfg: Config, skeleton_x: Column | None = None) -> Column:
    """A cheap test, in the JVM for ASCII names, that holds for every pair that can be kept.

    A swap is two plain edits, so a restricted Damerau distance of k needs a
    Levenshtein distance of at most 2k; lengths bound both.
    """
    known = S.skeleton(x, cfg.sources) if skeleton_x is None else skeleton_x
    if cfg.typosquat:
        skeletons = known == S.skeleton(y, cfg.sources)
        near = (F.abs(F.length(x) - F.length(y)) <= 1) & (F.levenshtein(x, y, 2) >= 0)
        return near | skeletons | S.is_combosquat(x, y)
    if cfg.threshold is None or cfg.by not in EDIT_METRICS:
        return F.lit(True)
    if cfg.threshold < 0:
        return F.lit(False)
    u, v = (known, S.skeleton(y, cfg.sources)) if cfg.by.startswith("skeleton") else (x, y)
    gate = F.abs(F.length(u) - F.length(v)) <= cfg.threshold
    if cfg.threshold <= 4:
        k = int(cfg.threshold) * (2 if cfg.by.endswith("damerau") else 1)
        gate = gate & (F.levenshtein(u, v, k) >= 0)
    return gate


def score(df: DataFrame, a: str = "a", b: str = "b", cfg: Config = Config(), gate: bool = False, keep: tuple[str, ...] = (), query: str | None = None) -> DataFrame:
    """Scored and filtered pairs: a, b, normalised forms if rules are given, axes, class and reason if typosquat; then ``keep``.

    ``query`` tells that ``a`` is this string in every row, whose skeletons are then made once.
    """
    out = _prepared(df, a, b, cfg)
    skeleton = None
    if query is not None:
        table = confusables(cfg.sources)
        skeleton = F.lit(table.skeleton(query))
        if cfg.norm_ops:
            norm = df.sparkSession.range(1).select(normalized(F.lit(query), cfg.norm_ops)).first()[0]
            skeleton = F.when(F.col("__identical") | F.col("__same"), skeleton).otherwise(F.lit(table.skeleton(norm)))
    if gate:  # the random column keeps Catalyst from pushing the gate, and with it copies of all it reads, below
        out = out.withColumn("__once", F.rand(0))
        out = out.where((F.col("__once") >= 0) & may_emit(F.col("__x"), F.col("__y"), cfg, skeleton))
    out = panel(out, F.col("__x"), F.col("__y"), cfg.computed, cfg.sources, skeleton)
    if cfg.typosquat:
        label, reason = V.classified(F.col("__identical"), F.col("__same"), F.col("__x"), F.col("__y"), F.col("damerau"), F.col("confusable_only"), F.col("keyboard_distance"))
        out = out.withColumns({"classification": label, "reason": reason}).where(F.col("classification").isin(*V.ALERTS))
    elif cfg.threshold is not None:
        out = out.where(metric_value(cfg.by) <= cfg.threshold)
    ranked = [metric_value(cfg.by).alias("__metric")] if cfg.sort or cfg.top is not None else []
    norms = [F.col("__na").alias(f"{a}_normalized"), F.col("__nb").alias(f"{b}_normalized")] if cfg.norm_ops else []
    return out.select(a, b, *norms, *cfg.shown, *(["classification", "reason"] if cfg.typosquat else []), *keep, *ranked)


def watchlist(names: DataFrame, query: str, cfg: Config = Config(), name_col: str = "value", ord_col: str = "ord", gate: bool = True) -> DataFrame:
    """One name against a list: input, match, axes. Names are trimmed and empty ones skipped; ties keep the order of ``ord_col``."""
    listed = names.select(S.trimmed(F.col(name_col)).alias("match"), *([ord_col] if ord_col in names.columns else [])).where("match <> ''")
    if ord_col not in names.columns:
        listed = listed.withColumn(ord_col, F.monotonically_increasing_id())
    out = score(listed.withColumn("input", F.lit(query)), "input", "match", cfg, gate, (ord_col,), query)
    if cfg.sort or cfg.top is not None:
        out = out.orderBy("__metric", ord_col)
        out = out.limit(cfg.top) if cfg.top is not None else out
        out = out.drop("__metric")
    return out.drop(ord_col)


def deletions(s: Column, depth: int) -> Column:
    """The string and all that arise from deleting up to ``depth`` characters."""
    out = F.array(s)
    for _ in range(depth):
        out = F.array_union(out, F.flatten(F.transform(out, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))))
    return F.array_distinct(out)


def _parts(low: Column) -> Column:
    """Strict parts of a name that stand between separators and an end, or between two separators."""
    cut = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.substring(low, i, F.lit(1)).isin(*S.SEPARATORS))
    heads = F.transform(cut, lambda i: F.substring(low, F.lit(1), i - 1))
    tails = F.transform(cut, lambda i: F.substring(low, i + 1, F.length(low)))
    return F.array_distinct(F.filter(F.concat(heads, tails, F.split(low, r"[\-_./]", -1)), lambda p: (F.length(p) >= 3) & (p != low)))


def _tagged(tag: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def _pieces(size: Column, k: int) -> Column:
    """(n, at, len): the ``k + 1`` pieces, as even as can be, that strings of a length are cut into."""
    short, longer = F.floor(size / (k + 1)), size % (k + 1)
    plain = k + 1 - longer  # so many have the shorter length
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("n"), (i * short + F.greatest(F.lit(0), i - plain)).cast("int").alias("at"), (short + F.when(i >= plain, 1).otherwise(0)).cast("int").alias("len")))


def _piece_key(size: Column, piece: Column, text: Column) -> Column:
    return F.concat_ws("|", size.cast("string"), piece["n"].cast("string"), text)


def piece_keys(s: Column, k: int) -> Column:
    """A string's ``k + 1`` pieces: of another within ``k`` edits, one is among its ``part_keys``."""
    n = F.length(s)
    return F.transform(_pieces(n, k), lambda p: _piece_key(n, p, F.substring(s, p["at"] + 1, p["len"])))


def part_keys(s: Column, k: int) -> Column:
    """Parts of a string that can be pieces of strings within ``k`` edits: of lengths, and at places, up to ``k`` off."""
    n = F.length(s)

    def at_shifts(size: Column, p: Column) -> Column:
        starts = F.filter(F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda d: p["at"] + d), lambda a: (a >= 0) & (a + p["len"] <= n))
        return F.transform(starts, lambda a: _piece_key(size, p, F.substring(s, a + 1, p["len"])))

    sizes = F.sequence(F.greatest(F.lit(0), n - k), n + k)
    return F.array_distinct(F.flatten(F.transform(sizes, lambda size: F.flatten(F.transform(_pieces(size, k), lambda p: at_shifts(size, p))))))


def _keys(s: Column, cfg: Config, left: bool) -> Column:
    """Keys of a name, of which every pair that can be kept shares one.

    Typosquats: a common deletion (one edit), a common skeleton, or one name as a
    delimited part of the other. With a threshold of k edits: common deletions of
    up to k characters for k below 3, else pieces of one name in the other (of
    skeletons where the metric is on them). A swap is two plain edits.
    """
    if not cfg.typosquat:
        text = S.skeleton(s, cfg.sources) if cfg.by.startswith("skeleton") else s
        k = int(cfg.threshold)
        if k < 3:
            return deletions(text, k)
        edits = 2 * k if cfg.by.endswith("damerau") else k
        return part_keys(text, edits) if left else piece_keys(text, edits)
    low = F.lower(s)
    whole = F.filter(F.array(low), lambda x: F.length(x) >= 3)
    first, second = (whole, _parts(low)) if left else (_parts(low), whole)
    return F.concat(_tagged("d", deletions(s, 1)), _tagged("s", F.array(S.skeleton(s, cfg.sources))), _tagged("a", first), _tagged("b", second))


def candidates(left: DataFrame, right: DataFrame, cfg: Config, a: str, b: str) -> DataFrame:
    """Pairs (``a``, ``b``) of distinct names that can be kept: one equi-join on keys that every such pair shares.

    With rewrite rules keys are of names as they stand and as rewritten. Keys are
    exploded once a side, before the shuffle, and pairs deduplicated after it. The
    join is not a broadcast: a side's keys are many times its size.
    """

    def keyed(df: DataFrame, name: str, is_left: bool) -> DataFrame:
        keys = _keys(F.col(name), cfg, is_left)
        if cfg.norm_ops:
            keys = F.concat(_tagged("0", keys), _tagged("1", _keys(F.col("__norm"), cfg, is_left)))
            df = df.withColumns({"__norm": normalized(F.col(name), cfg.norm_ops), "__once": F.rand(0)}).where("__once >= 0")
        return df.select(name, F.explode(keys).alias("__k"))

    return keyed(left, a, True).hint("merge").join(keyed(right, b, False), "__k").select(a, b).distinct()


def similarity_join(left: DataFrame, right: DataFrame, cfg: Config, a: str = "input", b: str = "match", top: int | None = None) -> DataFrame:
    """Every name of ``left`` against every one of ``right``: the pairs that scoring keeps, without comparing all.

    Needs the typosquat profile, or an edit metric with a threshold: other axes
    don't tell which names can't be near. Keys of a name grow with the third power
    of the threshold. ``top`` keeps the closest of each input (ties by name).
    """
    if not cfg.typosquat and (cfg.threshold is None or cfg.by not in EDIT_METRICS or not 0 <= cfg.threshold < 100):
        raise ValueError("a similarity join needs typosquat, or an edit metric with a threshold from 0 to 99")
    pairs = candidates(left.select(a).distinct(), right.select(b).distinct(), cfg, a, b)
    out = score(pairs, a, b, replace(cfg, sort=top is not None), gate=True)
    if top is None:
        return out
    nth = F.row_number().over(Window.partitionBy(a).orderBy("__metric", b))
    return out.withColumn("__nth", nth).where(F.col("__nth") <= top).drop("__nth", "__metric")
