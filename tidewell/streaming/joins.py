"""Joins and start/end pairing of streams, with state that goes once nothing can need it any more."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout


def join_streams(left: DataFrame, right: DataFrame, on: list[str], times: tuple[str, str], within: str, late: str, names: tuple[str, str] = ("left", "right"), how: str = "inner") -> DataFrame:
    """Rows of both streams with equal keys of which the right one comes at most within after the left one: keys once, other columns as <column>_<name>.

    Both sides are held until the watermark (late behind the newest event time of the slower side) shows that no partner
    can come any more. how: inner, left, right or full; unmatched rows come when their time is over. Keys that are null meet nothing.
    """
    a, b = (df.select(*(F.col(c).alias(c if c in on and not k else f"{c}_{names[k]}") for c in df.columns)) for k, df in enumerate((left, right)))
    t, u = (f"{c}_{names[k]}" for k, c in enumerate(times))
    test = F.expr(f"{u} >= {t} AND {u} <= {t} + INTERVAL {within}")
    for c in on:
        test = (F.col(c) == F.col(f"{c}_{names[1]}")) & test
    return a.withWatermark(t, late).join(b.withWatermark(u, late), test, how).drop(*(f"{c}_{names[1]}" for c in on))


def latency_stream(df: DataFrame, start: str, end: str, key: str, time: str, tie: str) -> DataFrame:
    """For each end row, the last start row of its key before it, and the time between; start and end are conditions.

    The state of a key is one number, its last start. Rows of a micro-batch are put in (time, tie) order.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("start_time", T.LongType()), T.StructField("duration", T.LongType())])
    names = df.columns

    def step(key, parts, store):
        last = store.get[0] if store.exists else None
        rows = pd.concat(list(parts), ignore_index=True).sort_values([time, tie], kind="stable")
        out, began = [], []
        for row in rows.itertuples(index=False):
            r = row._asdict()
            if r["is_end"] and last is not None:
                out.append([r[c] for c in names])
                began.append(last)
            if r["is_start"]:
                last = r[time]
        if last is not None:
            store.update((int(last),))
        if out:
            found = pd.DataFrame(out, columns=names)
            found["start_time"] = began
            found["duration"] = found[time] - found["start_time"]
            yield found

    marked = df.withColumns({"is_start": F.coalesce(F.expr(start), F.lit(False)), "is_end": F.coalesce(F.expr(end), F.lit(False))}).where("is_start OR is_end")
    return marked.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)
