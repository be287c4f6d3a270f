"""The ten axes by which a pair is scored: a registry, and the panel of those asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmere.functions import strings as S
from glyphmere.functions.tables import Sources


@dataclass(frozen=True)
class Axis:
    """needs: parts of the alignment, or other axes, that ``make`` reads from columns of the same name."""

    key: str
    kind: str
    higher_is: str
    needs: tuple[str, ...]
    make: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(f"__{name}")


# __a, __b: scored strings; __ska, __skb: skeletons; __al: alignment; __skd: distance of skeletons
AXES: dict[str, Axis] = {
    x.key: x
    for x in (
        Axis("equal", "boolean", "more similar", (), lambda: _c("a") == _c("b")),
        Axis("levenshtein", "bigint", "more different", (), lambda: S.levenshtein(_c("a"), _c("b"))),
        Axis("damerau", "bigint", "more different", ("al",), lambda: _c("al")["damerau"]),
        Axis("skeleton_levenshtein", "bigint", "more different", ("sk",), lambda: S.levenshtein(_c("ska"), _c("skb"))),
        Axis("skeleton_damerau", "bigint", "more different", ("sk", "skd"), lambda: _c("skd")),
        Axis("uts39_confusable_count", "bigint", "more similar", ("al",), lambda: _c("al")["uts39_confusable_count"]),
        Axis("uts39_skeleton_delta", "bigint", "more similar", ("al", "sk", "skd"), lambda: F.when(_c("al")["damerau"] > _c("skd"), _c("al")["damerau"] - _c("skd")).when(_c("skd").isNotNull(), 0).cast("long")),
        Axis("confusable_only", "boolean", "more similar", ("sk",), lambda: (_c("a") != _c("b")) & (_c("ska") == _c("skb"))),
        Axis("script_restriction", "bigint", "more different", (), lambda: F.when(_c("a").isNotNull() & _c("b").isNotNull(), F.greatest(S.restriction_level(_c("a")), S.restriction_level(_c("b"))))),
        Axis("keyboard_distance", "double", "more different", ("al",), lambda: _c("al")["keyboard_distance"]),
    )
}
NUMERIC = [k for k, x in AXES.items() if x.kind != "boolean"]


def parse_fields(spec: str | list[str]) -> list[str]:
    """Axis names in the registry's order, each once."""
    names = {n.strip() for n in (spec.split(",") if isinstance(spec, str) else spec)} - {""}
    for n in sorted(names - set(AXES)):
        raise ValueError(f"unknown field: {n} (valid: {', '.join(AXES)})")
    return [k for k in AXES if k in names]


def validate_metric(key: str) -> str:
    if key not in NUMERIC:
        raise ValueError(f"invalid metric: {key} (valid numeric axes: {', '.join(NUMERIC)})")
    return key


def metric_value(key: str) -> Column:
    """The metric as a double; an undefined one is infinite."""
    return F.coalesce(F.col(key).cast("double"), F.lit(float("inf")))


def panel(df: DataFrame, a: Column, b: Column, fields: list[str], sources: Sources = Sources(), skeleton_a: Column | None = None) -> DataFrame:
    """``df`` with the wanted axes appended. Only what they need is computed; pairs go to Python once.

    ``skeleton_a`` is that of ``a`` where it is known.
    """
    needs = {n for k in fields for n in AXES[k].needs}
    out = df.withColumns({"__a": a, "__b": b})
    if "sk" in needs:
        out = out.withColumns({"__ska": S.skeleton(F.col("__a"), sources) if skeleton_a is None else skeleton_a, "__skb": S.skeleton(F.col("__b"), sources)})
    both = {"al", "skd"} <= needs  # in one visit to Python
    if "al" in needs:
        only = {k for k in fields if "al" in AXES[k].needs} <= {"damerau", "uts39_skeleton_delta"} and not both
        made = F.struct(S.damerau(_c("a"), _c("b")).alias("damerau")) if only else S.aligned(_c("a"), _c("b"), sources, (_c("ska"), _c("skb")) if both else None)
        out = out.withColumn("__al", made)
    if "skd" in needs:
        out = out.withColumn("__skd", _c("al")["skeleton_damerau"] if both else S.damerau(_c("ska"), _c("skb")))
    out = out.withColumns({k: AXES[k].make() for k in fields})
    return out.drop("__a", "__b", "__ska", "__skb", "__al", "__skd")
