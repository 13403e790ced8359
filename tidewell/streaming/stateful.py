"""Global tumbling windows over a streaming source: a row leaves once its window is closed by a later row.

Windows over the whole stream depend on all rows before them, so their state (the open window's rows) lives under one key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout


#: Rows of a frame that leaves the operator.
FRAME_ROWS = 100_000


def _closed(t: np.ndarray, kind: str, size: int, step: int, number: int, start: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int | None]:
    """Of ascending times: the places where each closed window begins and ends, its start, the rows that no later window needs, and the start of the window that follows."""
    if kind == "count":
        firsts = np.arange(max(0, (len(t) - size) // step + 1)) * step
        gone = len(firsts) * step
        if gone < len(t):
            start = int(t[gone])
        elif len(firsts):
            start = int(t[firsts[-1]]) + step
        return firsts, firsts + size, t[firsts], gone, start
    if step == size:
        # a tumbling window starts with a row; a sliding one a step behind the one before
        i, firsts, ends = 0, [], []
        while i < len(t):
            n = int(t.searchsorted(t[i] + size, "left"))
            if n == len(t):
                break
            firsts.append(i)
            ends.append(n)
            i, start = n, int(t[i]) + size
        if not firsts:
            start = int(t[0]) if len(t) else start
        firsts = np.array(firsts, np.int64)
        return firsts, np.array(ends, np.int64), t[firsts], i, start
    if len(t) and not number:
        start = int(t[0])
    starts = start + np.arange(max(0, (int(t[-1]) - start - size) // step + 1)) * step if len(t) else np.empty(0, np.int64)
    if len(starts):
        start = int(starts[-1]) + step
    return t.searchsorted(starts, "left"), t.searchsorted(starts + size, "left"), starts, int(t.searchsorted(start, "left")) if len(starts) else 0, start


def windowed_stream(df: DataFrame, kind: str, size: int, time: str, tie: str | None = None, step: int | None = None) -> DataFrame:
    """df's rows with window_id and window_start, once their window has closed. kind: count or time (anchored, half-open); step: less than size for sliding windows.

    The rows of a micro-batch and the held ones are put in (time, tie) order together, so rows may come out of order as
    long as their window is open. Rows before the begin of the open window come too late and are dropped. All windows that
    a micro-batch closes are found at once and leave in frames of FRAME_ROWS rows, however many rows a window has.
    """
    names, step = df.columns, step or size
    schema = T.StructType([T.StructField("window_id", T.LongType()), T.StructField("window_start", T.LongType()), *df.schema.fields])
    state = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("held", T.BinaryType())])
    order = [time] + ([tie] if tie else [])

    def advance(key, parts, store):
        import io

        number, start, held = store.get if store.exists else (0, None, None)
        frames = [pd.read_pickle(io.BytesIO(held))] if held is not None else []
        frames += [x[names] for x in parts]
        rows = pd.concat([x for x in frames if len(x)] or frames[:1], ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        if number and start is not None:
            rows = rows[rows[time] >= start].reset_index(drop=True)
        firsts, ends, starts, gone, start = _closed(rows[time].to_numpy(), kind, size, step, number, start)
        upto = np.cumsum(ends - firsts)
        for a in range(0, int(upto[-1]) if len(upto) else 0, FRAME_ROWS):
            flat = np.arange(a, min(a + FRAME_ROWS, int(upto[-1])))
            w = upto.searchsorted(flat, "right")
            out = rows.iloc[flat - upto[w] + ends[w]].reset_index(drop=True)
            out.insert(0, "window_start", starts[w])
            out.insert(0, "window_id", number + w)
            yield out
        buf = io.BytesIO()
        rows.iloc[gone:].reset_index(drop=True).to_pickle(buf)
        store.update((number + len(firsts), start, buf.getvalue()))

    return df.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandasWithState(advance, schema, state, "append", GroupStateTimeout.NoTimeout)


def event_time_windows(df: DataFrame, timestamp: str, size: str, late: str, *keys: str) -> DataFrame:
    """Epoch-aligned counts with a watermark, for sources with late rows."""
    return df.withWatermark(timestamp, late).groupBy(F.window(timestamp, size), *keys).agg(F.count("*").alias("count_"))


def latest_stream(df: DataFrame, timestamp: str, late: str, *keys: str) -> DataFrame:
    """Rows without repeats of a key within the watermark."""
    return df.withWatermark(timestamp, late).dropDuplicatesWithinWatermark(list(keys))
