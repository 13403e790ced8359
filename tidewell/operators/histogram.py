"""Histograms over explicit, linear or power-of-two buckets, and quantiles interpolated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper end of the last, open bucket.
OPEN_END = (1 << 63) - 1


def explicit_bucket(column: str, buckets: list[tuple[int, int]], compat: bool = False) -> Column:
    """The index of the bucket with lb <= v < ub; len(buckets) from the last ub on; -1 below and between (compat: the last one)."""
    c = F.col(column)
    out = F.when(c >= buckets[-1][1], F.lit(len(buckets)))
    for i, (lb, ub) in enumerate(buckets):
        out = out.when((c >= lb) & (c < ub), F.lit(i))
    return out.otherwise(F.lit(len(buckets) if compat else -1))


def linear_bucket(column: str, width: int) -> Column:
    return F.expr(f"{column} div {width}")


def log2_bucket(column: str, n: int) -> Column:
    """The place of the highest bit (exact for all integers), 0 for 0, at most n - 1."""
    return F.least(F.when(F.col(column) <= 0, F.lit(0)).otherwise(F.length(F.bin(column)) - 1), F.lit(n - 1))


def histogram(df: DataFrame, bucket: Column, *keys: str) -> DataFrame:
    """(keys, bucket, n)."""
    return df.groupBy(*keys, bucket.cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def quantile(hist: DataFrame, width: int, q: int, *keys: str) -> DataFrame:
    """(keys, quantile) of a histogram over linear buckets, in percent."""
    return _interpolated(hist, F.col("bucket") * width, (F.col("bucket") + 1) * width, q, keys)


def quantile_explicit(hist: DataFrame, buckets: list[tuple[int, int]], q: int, *keys: str) -> DataFrame:
    """(keys, quantile) of a histogram over explicit buckets, of any widths. Values below and between them count as of [0, first lower end)."""
    ends = F.create_map(*(F.lit(x) for i, (lb, ub) in enumerate([(0, buckets[0][0]), *buckets, (buckets[-1][1], OPEN_END)]) for x in (i - 1, F.array(F.lit(lb).cast("bigint"), F.lit(ub).cast("bigint")))))
    at = F.element_at(ends, F.col("bucket").cast("int"))
    return _interpolated(hist, at[0], at[1], q, keys)


def _interpolated(hist: DataFrame, lower: Column, upper: Column, q: int, keys: tuple[str, ...]) -> DataFrame:
    """Integers scaled by a million, interpolated in a bucket. From 50 up, buckets are read from the top: the first whose share below is at most q; else from the bottom.

    hist has as many rows as buckets.
    """
    if not 0 < q <= 100:
        raise ValueError("q is a percentage from 1 to 100")
    f, top = 1_000_000, q >= 50
    s = q * f // 100
    order = Window.partitionBy(*keys).orderBy(F.desc("bucket") if top else F.asc("bucket"))
    rows = hist.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("acc", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("b", F.expr(f"({f} * {'(total - acc)' if top else 'acc'}) div total")).withColumn("prev", F.lag("b", 1, f if top else 0).over(order))
    rows = rows.withColumns({"lb": lower.cast("decimal(38,0)"), "ub": upper.cast("decimal(38,0)")}).where(F.col("b") <= s if top else F.col("b") >= s)
    pick = (F.max_by if top else F.min_by)(F.struct("lb", "ub", "b", "prev"), "bucket").alias("r")
    part = f"r.lb + ((r.ub - r.lb) * ({s} - r.b)) div (r.prev - r.b)" if top else f"r.lb + ((r.ub - r.lb) * ({s} - r.prev)) div (r.b - r.prev)"
    value = F.expr(f"CAST(CASE WHEN r.b = {s} THEN r.{'lb' if top else 'ub'} ELSE {part} END AS BIGINT)")
    return rows.groupBy(*keys).agg(pick).select(*keys, value.alias("quantile"))
