"""Event catalog: names of event streams, their schemas and where they are read from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attributes that every kernel event has besides its own fields (fixed values of the data model).
SYSTEM = {"time": T.LongType(), "pid": T.LongType(), "tgid": T.LongType(), "cpu": T.LongType(), "comm": T.StringType(), "cgroup": T.LongType()}
_PAGE_CACHE = {"pfn": T.LongType(), "i_ino": T.LongType(), "index": T.LongType(), "s_dev": T.LongType()}
#: Fields of the known kernel events (fixed values of the data model).
KERNEL_EVENTS = {
    "filemap/mm_filemap_add_to_page_cache": _PAGE_CACHE,
    "filemap/mm_filemap_delete_from_page_cache": _PAGE_CACHE,
    "syscalls/sys_enter_pread64": {"fd": T.LongType(), "count": T.LongType(), "pos": T.LongType()},
    "syscalls/sys_exit_pread64": {"ret": T.LongType()},
}


class UnknownEvent(ValueError):
    """The catalog has no event of that name."""


def micros(ts: str) -> Column:
    """A zone-less timestamp as microseconds since the epoch, whatever the session's zone."""
    return F.expr(f"CAST(CAST(CAST(CAST({ts} AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000000 AS BIGINT)")


def timestamp_literal(us: int) -> str:
    """Microseconds since the epoch as a zone-less timestamp literal, which Parquet readers can compare with their statistics."""
    t = datetime(1970, 1, 1) + timedelta(microseconds=us)
    return f"TIMESTAMP_NTZ'{t.isoformat(sep=' ', timespec='microseconds')}'"


def kernel_schema(name: str) -> T.StructType:
    """The event's fields in declared order, then the system attributes."""
    return T.StructType([T.StructField(k, t) for k, t in (KERNEL_EVENTS[name] | SYSTEM).items()])


@dataclass(frozen=True)
class Event:
    name: str
    load: Callable[[SparkSession], DataFrame]
    time: str = "time"
    tie: str | None = None
    #: Column of the stored timestamp that time is derived from, and a loader that takes a predicate on it.
    stamp: str | None = None
    load_where: Callable[[SparkSession, str], DataFrame] | None = None


class Catalog:
    def __init__(self) -> None:
        self._events: dict[str, Event] = {}

    def add(self, name: str, load: Callable[[SparkSession], DataFrame], time: str = "time", tie: str | None = None, stamp: str | None = None, load_where: Callable[[SparkSession, str], DataFrame] | None = None) -> "Catalog":
        self._events[name] = Event(name, load, time, tie, stamp, load_where)
        return self

    def add_files(self, name: str, path: str, form: str = "parquet", time: str = "time", tie: str | None = None, schema: T.StructType | None = None, stream: bool = False, **options) -> "Catalog":
        """An event stream in files of any format that Spark reads; known kernel events need no schema."""
        schema = schema or (kernel_schema(name) if name in KERNEL_EVENTS else None)

        def load(spark: SparkSession) -> DataFrame:
            reader = (spark.readStream if stream else spark.read).format(form).options(**options)
            return (reader.schema(schema) if schema else reader).load(path)

        return self.add(name, load, time, tie)

    def get(self, name: str) -> Event:
        bare = name.removeprefix("tracepoint/")
        for n in (name, bare):
            if n in self._events:
                return self._events[n]
        raise UnknownEvent(f"no event {name!r}; known: {sorted(self._events)}")


def load_events(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """The events table as a stream: event_id, time (microseconds), user_id, event_type, value and v (value truncated); where: on stored columns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(where)
    return e.select("event_id", micros("ts").alias("time"), "user_id", "event_type", "value", F.col("value").cast("bigint").alias("v"))


def tables(sf_dir: str) -> Catalog:
    """A catalog with the events table, under its own name and as the stand-in of a kernel event, with its system attributes."""
    c = Catalog()
    c.add("events", lambda s: load_events(s, sf_dir), "time", "event_id", "ts", lambda s, w: load_events(s, sf_dir, w))

    def stand_in(s: SparkSession, w: str = "true") -> DataFrame:
        e = load_events(s, sf_dir, w)
        system = (F.col("user_id").alias("pid"), (F.col("user_id") * 10).alias("tgid"), F.expr("pmod(event_id, 4)").alias("cpu"), F.concat(F.lit("task"), F.expr("user_id % 7")).alias("comm"), F.expr("user_id div 16").alias("cgroup"))
        return e.select("event_id", F.col("event_type").alias("fd"), F.col("v").alias("count"), "time", *system)

    return c.add("syscalls/sys_enter_pread64", stand_in, "time", "event_id", "ts", stand_in)
