"""Shared storage, code shipping and distributed connected components."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

#: Pairs (16 bytes each) up to which a single task finds the components; beyond it the work is spread.
ONE_TASK_PAIRS = 2_000_000

#: A key of meet() with more than this share of all rows, and more rows than LEAST_PART, is dealt over several tasks.
SHARES, LEAST_PART = 1000, 1000

#: Bytes of an Arrow batch that a Python worker is sent, where the session leaves Spark's own 64 MB: each is held several times over, outside the heap.
BATCH_BYTES, SPARKS_OWN = "4m", ("67108864b", "67108864", "64m", "64MB")

#: Seconds from one relief of the driver's memory to the next.
RELIEF_S = 5

_relieved = 0.0
_shipped: set[str] = set()
_own_base: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and keep the batches they are sent small."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in SPARKS_OWN:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own if the master is local, else an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_base:
        _own_base[app] = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    return _own_base[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/tidewell/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors. It goes with the application, or by drop()."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    relieve(df.sparkSession)
    p, fs = _file(df.sparkSession, path)
    fs.deleteOnExit(p)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewell_path = path
    return out


def relieve(spark: SparkSession) -> None:
    """Let the driver give back what the plans and tasks of finished tables took: its heap shrinks after a full collection, then both processes return free native memory. At most every RELIEF_S seconds."""
    global _relieved
    if time.monotonic() - _relieved < RELIEF_S:
        return
    gc.collect()
    K.trim()
    jvm = spark._jvm
    jvm.java.lang.System.gc()
    beans, name = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # by the public interface: the server's own class can't be called from outside its module
    methods = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()}

    def call(method: str, *values):
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(values))
        for i, x in enumerate(values):
            args[i] = x
        return methods[method].invoke(beans, args)

    if call("isRegistered", name) and "systemTrimNativeHeap" in {x.getName() for x in call("getMBeanInfo", name).getOperations()}:
        call("invoke", name, "systemTrimNativeHeap", None, None)
    _relieved = time.monotonic()


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(*tables: DataFrame | None) -> None:
    """Delete what cut() wrote, when nothing will read it again."""
    for df in tables:
        path = getattr(df, "_tidewell_path", None)
        if path:
            p, fs = _file(df.sparkSession, path)
            fs.delete(p, True)


def meet(rows: DataFrame, points: DataFrame, on: list[str], weights: DataFrame, spread: str) -> DataFrame:
    """Inner join of rows with points (one row per key); weights is a stored table of the keys and n, their numbers of rows.

    A key with over 1/SHARES of all rows is cut into parts of that size at most, on average: its rows are dealt by the
    hash of the column spread, its point goes to every part. Fewer than SHARES keys can be so large, which bounds what
    is broadcast, and all points together are repeated less than 2 * SHARES times.
    """
    part = max((weights.agg(F.sum("n")).first()[0] or 0) // SHARES + 1, LEAST_PART)
    large = F.broadcast(weights.where(F.col("n") > part).select(*on, F.ceil(F.col("n") / part).alias("__parts")))
    dealt = rows.join(large, on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")), F.lit(0).cast("bigint")))
    each = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("__parts"), F.lit(1).cast("bigint")) - 1)
    held = points.join(large, on, "left").withColumn("__part", F.explode(each))
    return dealt.drop("__parts").join(held.drop("__parts"), [*on, "__part"]).drop("__part")


#: Points of fixed width up to which beside() broadcasts them: a few MB.
BROADCAST_POINTS = 10_000


def beside(rows: DataFrame, points: DataFrame, on: list[str], weights: DataFrame, spread: str) -> DataFrame:
    """meet() for points of a few numbers each: BROADCAST_POINTS of them or fewer are broadcast, so rows stay where they are."""
    if weights.count() <= BROADCAST_POINTS:
        return rows.join(F.broadcast(points), on)
    return meet(rows, points, on, weights, spread)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def label(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        low = np.minimum(up[a], up[b])
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        while not np.array_equal(nxt := up[up], up):
            up = nxt
        open_ = up[a] != up[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[up]


def _label_all(batches):
    import pyarrow as pa

    t = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if t:
        nodes, low = label(np.concatenate([x for x, _ in t]), np.concatenate([x for _, x in t]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["node", "component"])


def connected_components(edges: DataFrame, one_task_pairs: int = ONE_TASK_PAIRS) -> DataFrame:
    """(a, b) long pairs -> (node, component): the smallest node reachable, for every node that an edge names.

    At most one_task_pairs pairs go to one task. Beyond that bound: alternating large-star and small-star rounds: every step is a min() per key, combined before the shuffle,
    and an equi-join, so no task gathers a neighbourhood. Each round is written to the shared folder.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    if pairs.count() <= one_task_pairs:
        ship(pairs.sparkSession)
        out = cut(pairs.coalesce(1).mapInArrow(_label_all, "node long, component long"), "cc")
        drop(pairs)
        return out
    state = None
    while True:
        # large star: every larger neighbour moves to the smallest neighbour (or to the node itself)
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself move to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(pairs)
        pairs = after
        if now == state or not now[0]:
            break
        state = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
