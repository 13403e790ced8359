"""Window assignment: each function adds window_id (and window_start for time windows).

Order is (time, tie). Windows over a whole stream are global, so ranks come from cells of the time axis, about CELL_ROWS
rows each however many rows there are: rows are numbered inside a cell and shifted by the counts of earlier cells. A cell
that holds far more rows than others (a burst, or one instant) is cut again by time or by tie. No task sees the whole stream.
"""

from __future__ import annotations

import math
from typing import Tuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell of the time axis, about.
CELL_ROWS = 100_000
#: Cells that are summed up in one group.
GROUP = 4096


def _spare(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    while name in df.columns:
        name = "_" + name
    return name


def _extent(df: DataFrame, time: str):
    """One row: n, and the first and the last time."""
    return df.agg(F.count("*").alias("n"), F.min(time).alias("a"), F.max(time).alias("z")).first()


def global_rank(df: DataFrame, time: str, tie: str | None = None, name: str = "rn", cell_rows: int | None = None, extent=None) -> DataFrame:
    """Adds the 1-based rank of each row in (time, tie) order; rows without a time come first."""
    order = [time] + ([tie] if tie else [])
    cell_rows = cell_rows or CELL_ROWS
    extent = extent or _extent(df, time)
    own_order = [F.col(c).asc_nulls_first() for c in order]
    if extent.n <= cell_rows or extent.a is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*own_order)).cast("bigint"))
    cell, sub, first, own = (_spare(df, x) for x in ("__cell", "__sub", "__first", "__own"))
    width = max(1, (extent.z - extent.a + 1) * cell_rows // extent.n)
    rows = df.withColumn(cell, F.expr(f"coalesce((`{time}` - {extent.a}) div {width}, -1)"))
    # cells with far too many rows, fewer than a thousand by their bound, are cut by time, or by tie where all are of one instant
    cut = tie if tie and dict(df.dtypes)[tie] in ("bigint", "int", "smallint", "tinyint") else time
    dense = rows.groupBy(cell).agg(F.count("*").alias("n"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.min(cut).alias("k0"), F.max(cut).alias("k1")).where(f"n > {max(4 * cell_rows, extent.n // 1000)}").collect()
    part = F.lit(0).cast("bigint")
    for r in dense:
        by, lo, hi = (time, r.t0, r.t1) if r.t0 is not None and r.t1 > r.t0 else (cut, r.k0, r.k1)
        if lo is not None and hi > lo:
            part = F.when(F.col(cell) == r[0], F.expr(f"(`{by}` - {lo}) div {max(1, (hi - lo + 1) * cell_rows // r.n)}")).otherwise(part)
    rows = rows.withColumn(sub, part)
    counts = rows.groupBy(cell, sub).agg(F.count("*").alias("n")).withColumn("grp", F.expr(f"`{cell}` div {GROUP}"))
    total = counts.groupBy("grp").agg(F.sum("n").alias("n"))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = total.select("grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("g"))
    inside = Window.partitionBy("grp").orderBy(cell, sub).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("c", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups, "grp").select(cell, sub, (F.col("c") + F.col("g")).alias(first))
    rows = rows.withColumn(own, F.row_number().over(Window.partitionBy(cell, sub).orderBy(*own_order)))
    return rows.join(firsts, [cell, sub]).withColumn(name, F.col(first) + F.col(own)).drop(cell, sub, first, own)


def count_windows(df: DataFrame, size: int, time: str, tie: str | None = None, compat: bool = False, emit_partial: bool = False) -> DataFrame:
    """Tumbling windows of size rows; compat: the first has size - 1 (the id is rank div size). The unfinished last one is dropped."""
    rn, extent = _spare(df, "rn"), _extent(df, time)
    ranked = global_rank(df, time, tie, rn, extent=extent)
    out = ranked.withColumn("window_id", F.expr(f"`{rn}` div {size}" if compat else f"(`{rn}` - 1) div {size}")).drop(rn)
    return out if emit_partial else out.where(F.col("window_id") < extent.n // size)


def _outcomes(t: np.ndarray, size: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending times: for each, how many window starts follow from it here (itself included), and the place of the last one. By doubling the jumps."""
    n = len(t)
    jump = np.append(t.searchsorted(t + size, side), n)
    steps, last = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    while (jump[:n] < n).any():
        on = jump < n
        steps = steps + np.where(on, steps[jump], 0)
        last = np.where(on, last[jump], last)
        jump = jump[jump]
    return steps[:n], last[:n]


def time_boundaries(df: DataFrame, size: int, time: str, closed: bool = False, emit_partial: bool = True, extent=None) -> DataFrame:
    """(window_id, window_start): windows anchored at the first event; the next starts at the first event past the last one's end.

    Each start depends on the one before. The time axis is cut into chunks, and each chunk answers in parallel, for every
    event that a window from before it could leave as its first start (those less than a window behind its begin, and the
    first one past that), how many starts follow in it and which is the last. Neighbours with one outcome are one run; the
    driver reads the runs as a stream and keeps two numbers per chunk, then every chunk lists its own starts. A task holds
    the distinct times of two windows or of CELL_ROWS rows, whichever are more. emit_partial: the last window, still open, as well.
    """
    extent = extent or _extent(df, time)
    spark, side = df.sparkSession, "right" if closed else "left"
    form = "window_id long, window_start long"
    if extent.a is None:
        return spark.createDataFrame([], form)
    chunks = max(1, min(extent.n // CELL_ROWS, (extent.z - extent.a) // (2 * size)))
    width = (extent.z - extent.a) // chunks + 1
    times = df.where(F.col(time).isNotNull()).select(F.col(time).alias("t"), F.expr(f"(`{time}` - {extent.a}) div {width}").alias("k")).distinct()

    def outcomes(key: Tuple, frame: pd.DataFrame) -> pd.DataFrame:
        t = frame["t"].sort_values().to_numpy()
        steps, last = _outcomes(t, size, side)
        n = min(len(t), int(t.searchsorted(extent.a + int(key[0]) * width + size, "right")) + 1)
        steps, last, t_last = steps[:n], last[:n], t[last[:n]]
        ends = np.flatnonzero(np.append((steps[1:] != steps[:-1]) | (last[1:] != last[:-1]), True))
        return pd.DataFrame({"k": int(key[0]), "upto": t[ends], "steps": steps[ends], "last": t_last[ends]})

    # chunk -> windows before it, and the end of the last of them: its first start is the first time past that
    entry, number, past, open_ = {0: (0, extent.a - closed)}, 0, extent.a - closed, True
    if chunks > 1:
        now = None
        for r in times.groupBy("k").applyInPandas(outcomes, "k long, upto long, steps long, last long").orderBy("k", "upto").toLocalIterator():
            if r.k != now:
                now, open_, entry[r.k] = r.k, True, (number, past)
            if open_ and (r.upto > past or r.upto == past and not closed):
                number, past, open_ = number + r.steps, r.last + size, False

    def starts(key: Tuple, frame: pd.DataFrame) -> pd.DataFrame:
        t = frame["t"].sort_values().to_numpy()
        number, past = entry[int(key[0])]
        out, i = [], int(t.searchsorted(past, side))
        while i < len(t):
            out.append(int(t[i]))
            i = int(t.searchsorted(t[i] + size, side))
        return pd.DataFrame({"window_id": range(number, number + len(out)), "window_start": out}, dtype="int64")

    found = times.groupBy("k").applyInPandas(starts, form)
    if emit_partial:
        return found
    # the last window holds the last event
    return found.where(F.col("window_start") + size <= extent.z) if not closed else found.where(F.col("window_start") + size < extent.z)


def time_windows(df: DataFrame, size: int, time: str, closed: bool = False, emit_partial: bool = False) -> DataFrame:
    """Tumbling windows anchored at the first event, [start, start + size) or closed. The last one, still open, is dropped.

    A cell of the time axis as wide as a window holds one start at most, so rows meet their window by an equi-join on the
    cell: a window reaches into its own cell and the next one.
    """
    starts = time_boundaries(df, size, time, closed, emit_partial)
    cell = F.expr(f"window_start div {size}")
    spread = starts.withColumn("__cell", F.explode(F.array(*(cell + k for k in range(3 if closed else 2)))))
    fits = (F.col(time) >= F.col("window_start")) & ((F.col(time) <= F.col("window_start") + size) if closed else (F.col(time) < F.col("window_start") + size))
    return df.withColumn("__cell", F.expr(f"{time} div {size}")).join(spread, "__cell").where(fits).drop("__cell")


def aligned_windows(df: DataFrame, size: int, time: str) -> DataFrame:
    """Epoch-aligned tumbling windows."""
    start = F.expr(f"{time} - pmod({time}, {size})")
    return df.withColumn("window_start", start).withColumn("window_id", F.expr(f"window_start div {size}"))


def _slide(df: DataFrame, lo, hi) -> DataFrame:
    return df.where(lo <= hi).withColumn("window_id", F.explode(F.sequence(lo, hi)))


def sliding_count(df: DataFrame, size: int, step: int, time: str, tie: str | None = None) -> DataFrame:
    """Window k holds the rows of ranks k * step < rank <= k * step + size; only full windows."""
    extent, rn = _extent(df, time), _spare(df, "rn")
    most = (extent.n - size) // step
    ranked = global_rank(df, time, tie, rn, extent=extent)
    if most < 0:
        return ranked.where("false").withColumn("window_id", F.lit(0).cast("bigint")).drop(rn)
    lo, hi = F.expr(f"greatest(0, CAST(ceil((`{rn}` - {size}) / {step}) AS BIGINT))"), F.expr(f"least({most}, (`{rn}` - 1) div {step})")
    return _slide(ranked, lo, hi).drop(rn)


def expired(df: DataFrame, size: int, step: int, time: str, tie: str | None = None) -> DataFrame:
    """The rows that leave when sliding count window window_id makes way for the next one."""
    extent, rn = _extent(df, time), _spare(df, "rn")
    most = max(0, (extent.n - size) // step)
    ranked = global_rank(df, time, tie, rn, extent=extent).withColumn("window_id", F.expr(f"(`{rn}` - 1) div {step}"))
    return ranked.where(F.expr(f"window_id < {most}")).drop(rn)


def sliding_time(df: DataFrame, size: int, step: int, time: str) -> DataFrame:
    """Window k is [first + k * step, first + k * step + size), anchored at the first event; windows that end after the last event are dropped."""
    ends = _extent(df, time)
    if ends.a is None or (most := (ends.z - ends.a - size) // step) < 0:
        return df.where("false").withColumn("window_id", F.lit(0).cast("bigint")).withColumn("window_start", F.lit(0).cast("bigint"))
    d = f"(`{time}` - {ends.a})"
    lo, hi = F.expr(f"greatest(0, ({d} - {size}) div {step} + CASE WHEN {d} >= {size} THEN 1 ELSE 0 END)"), F.expr(f"least({most}, {d} div {step})")
    return _slide(df, lo, hi).withColumn("window_start", F.lit(ends.a) + F.col("window_id") * step)


def panes(df: DataFrame, kind: str, size: int, step: int, time: str, tie: str | None = None) -> tuple[DataFrame, object]:
    """df with pane, the number of the piece of gcd(size, step) that a row is in, and a function from aggregates per pane to their windows.

    A pane is wholly inside or outside each sliding window, so aggregates are made once per pane and copied, not rows.
    """
    extent, g = _extent(df, time), math.gcd(size, step)
    if kind == "count":
        rn, most = _spare(df, "rn"), (extent.n - size) // step
        rows = global_rank(df, time, tie, rn, extent=extent).withColumn("pane", F.expr(f"(`{rn}` - 1) div {g}")).drop(rn)
    else:
        first = extent.a or 0
        most = (extent.z - first - size) // step if extent.z is not None else -1
        rows = df.withColumn("pane", F.expr(f"(`{time}` - {first}) div {g}"))
    each, hop = size // g, step // g

    def windows(table: DataFrame) -> DataFrame:
        if most < 0:
            out = table.where("false").withColumn("window_id", F.lit(0).cast("bigint"))
        else:
            out = _slide(table, F.expr(f"greatest(0, CAST(ceil((pane + 1 - {each}) / {hop}) AS BIGINT))"), F.expr(f"least({most}, pane div {hop})"))
        return out.drop("pane") if kind == "count" else out.drop("pane").withColumn("window_start", F.lit(extent.a or 0) + F.col("window_id") * step)

    return rows, windows


def session_windows(df: DataFrame, gap: int, time: str, *keys: str) -> DataFrame:
    """Adds session_start: sessions of a key end after gap without an event."""
    w = Window.partitionBy(*keys).orderBy(time)
    new = F.when(F.col(time) - F.lag(time).over(w) < gap, F.lit(None)).otherwise(F.col(time))
    return df.withColumn("__new", new).withColumn("session_start", F.last("__new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
