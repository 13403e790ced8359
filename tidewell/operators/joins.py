"""Joins on bounded relations (windows), distinct joins and start/end pairing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import latest


def windowed_join(left: DataFrame, right: DataFrame, on: list[str], names: tuple[str, str] = ("left", "right"), how: str = "inner", condition: str | None = None) -> DataFrame:
    """Join of two relations on keys (or a condition on <name>.<column>): keys once, other columns as <column>_<name>.

    Where both have windows, windows of equal number meet; each side's windows are anchored at its own first row. A
    window's columns keep their names; if both sides have a window_start, the right one's is window_start_<name>. how:
    any of Spark's joins; semi and anti joins have the left side's columns only.
    """
    own = [c for c in ("window_id", "window_start") if c in left.columns or c in right.columns]
    keys = (["window_id"] if "window_id" in left.columns and "window_id" in right.columns and "window_id" not in on else []) + on

    def named(df: DataFrame, k: int) -> DataFrame:
        keep = [c for c in own if c in df.columns and not (k and c in left.columns)]
        return df.select(*(F.col(c).alias(c if c in keys or c in keep else f"{c}_{names[k]}") for c in df.columns))

    if condition is None:
        out = named(left, 0).join(named(right, 1), keys, how)
    else:
        text = re.sub(rf"\b({'|'.join(map(re.escape, names))})\.(\w+)", lambda m: f"{m[2]}_{m[1]}", condition)
        a, b = named(left, 0), named(right, 1)
        test = F.expr(text)
        if keys:
            b = b.withColumnRenamed("window_id", "__window_id")
            test = test & (F.col("window_id") == F.col("__window_id"))
        out = a.join(b, test, how).drop("__window_id")
    first = [c for c in own if c in out.columns]
    return out.select(*first, *(c for c in out.columns if c not in first))


def distinct_join(left: DataFrame, right: DataFrame, on: list[str], time: str, tie: str | None = None, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """The newest row of each key on both sides, joined."""
    return windowed_join(latest(left, on, time, tie), latest(right, on, time, tie), on, names)


def latency_pairs(df: DataFrame, start: str, end: str, key: str, time: str, tie: str) -> DataFrame:
    """For each end row, the last start row of its key before it, and the time between. start and end are conditions."""
    w = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, -1)
    began = F.last(F.when(F.expr(start), F.col(time)), ignorenulls=True).over(w)
    return df.withColumn("start_time", began).where(F.expr(end) & F.col("start_time").isNotNull()).withColumn("duration", F.col(time) - F.col("start_time"))


def with_looked_up(df: DataFrame, table: DataFrame, on: list[str], column: str) -> DataFrame:
    """df with a column of a table that has one row per key (such as a namespace's pid by device and inode); null where there is none."""
    one = table.groupBy(*on).agg(F.max(column).alias(column))
    return df.join(one, on, "left")
