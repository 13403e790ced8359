"""Grouped aggregates per window, named <aggregate>_<column>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scale of a fixed-point average.
FIXED = 256
_PLAIN = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def aggregate(kind: str, column: str, distinct: bool = False) -> Column:
    """max, min, sum, count, avg (integer division, as streams hold integers), avg_exact, or avg_fixed (times FIXED); count(*) is named count_."""
    kind = kind.lower()
    if column == "*":
        return F.count("*").alias("count_")
    c = F.col(column)
    if kind == "avg":
        d = "DISTINCT " * distinct
        return F.expr(f"CAST(sum({d}`{column}`) AS BIGINT) div count({d}`{column}`)").alias(f"avg_{column}")
    if kind == "avg_fixed":
        return F.expr(f"CAST(sum(`{column}`) * {FIXED} AS BIGINT) div count(`{column}`)").alias(f"avg_fixed_{column}")
    if kind == "avg_exact":
        return F.avg(c).alias(f"avg_exact_{column}")
    if distinct and kind in ("sum", "count"):
        return (F.sum_distinct(c) if kind == "sum" else F.count_distinct(c)).alias(f"{kind}_{column}")
    if kind not in _PLAIN:
        raise ValueError(f"no aggregate {kind!r}")
    return _PLAIN[kind](c).alias(f"{kind}_{column}")


def group(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Groups per window (if df has windows) and keys; without aggregates, the distinct keys."""
    keys = [c for c in ("window_id", "window_start") if c in df.columns and c not in keys] + keys
    return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()


def latest(df: DataFrame, keys: list[str], time: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key, in each window. One pass with partial aggregation, no sort."""
    keys = [c for c in ("window_id", "window_start") if c in df.columns and c not in keys] + keys
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(time, *([tie] if tie else []))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def retract_average(average: Column, n: Column, value: Column, scale: int = FIXED) -> Column:
    """The fixed-point average of n values after one of them is taken out; 0 when it was the only one."""
    return F.when(n <= 1, F.lit(0).cast("bigint")).otherwise(F.call_function("div", average * n - scale * value, n - 1))
