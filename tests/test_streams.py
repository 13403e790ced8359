import os
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell import queries
from tidewell.operators import aggregates, histogram, joins, windows
from tidewell.plans.dialect import DialectError, parse
from tidewell.plans.builder import Query
from tidewell.plans.engine import Engine, predicate
from tidewell.queries import ORACLES, QUERIES
from tidewell.sources.catalog import Catalog, UnknownEvent, kernel_schema, tables
from tidewell.streaming import joins as stream_joins
from tidewell.streaming import stateful
from tidewell.streaming.stateful import windowed_stream


def stream(spark, times, values=None):
    return spark.createDataFrame([(t, i, (values or times)[i]) for i, t in enumerate(times)], "time long, id long, v long")


def rows(df):
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(ORACLES[name]).df())


def ids(df, what="id"):
    out = {}
    for r in df.collect():
        out.setdefault(r.window_id, set()).add(r[what])
    return out


def test_anchored_windows_are_half_open_and_start_at_events(spark):
    df = stream(spark, [5, 7, 14, 15, 40, 41, 60])
    assert ids(windows.time_windows(df, 10, "time")) == {0: {0, 1, 2}, 1: {3}, 2: {4, 5}}
    assert ids(windows.time_windows(df, 10, "time", closed=True)) == {0: {0, 1, 2, 3}, 1: {4, 5}}
    assert ids(windows.time_windows(df, 10, "time", emit_partial=True))[3] == {6}


def test_count_windows(spark):
    df = stream(spark, list(range(7)))
    assert ids(windows.count_windows(df, 3, "time", "id")) == {0: {0, 1, 2}, 1: {3, 4, 5}}
    assert ids(windows.count_windows(df, 3, "time", "id", compat=True)) == {0: {0, 1}, 1: {2, 3, 4}}
    assert ids(windows.count_windows(df, 1, "time", "id")) == {i: {i} for i in range(7)}
    assert windows.count_windows(df, 9, "time", "id").count() == 0
    assert ids(windows.sliding_count(df, 4, 2, "time", "id")) == {0: {0, 1, 2, 3}, 1: {2, 3, 4, 5}}


def test_empty_and_single_streams(spark):
    for df, n in ((stream(spark, [1]).where("false"), 0), (stream(spark, [1]), 0)):
        assert windows.time_windows(df, 10, "time").count() == n
        assert windows.sliding_time(df, 10, 5, "time").count() == n
        assert windows.sliding_count(df, 10, 5, "time").count() == n
        assert windows.count_windows(df, 2, "time", "id").count() == n


def test_ties_in_time_follow_the_tie_breaker(spark):
    df = stream(spark, [1, 1, 1, 1])
    assert ids(windows.count_windows(df, 2, "time", "id")) == {0: {0, 1}, 1: {2, 3}}
    assert aggregates.latest(df.withColumn("k", F.lit(1)), ["k"], "time", "id").first().id == 3


def test_zero_measures_are_emitted_and_average_is_integer(spark):
    df = stream(spark, [0, 1, 2], [0, 0, 0]).withColumn("k", F.col("id"))
    assert aggregates.group(df, ["k"], aggregates.aggregate("max", "v")).count() == 3
    assert stream(spark, [0, 1], [2, 5]).agg(aggregates.aggregate("avg", "v")).first()[0] == 3


def test_histogram_ends(spark):
    df = stream(spark, list(range(5)), [-3, 5, 12, 20, 99])
    b = [(5, 10), (10, 15), (15, 20)]
    found = {r.bucket: r.n for r in histogram.histogram(df, histogram.explicit_bucket("v", b)).collect()}
    assert found == {-1: 1, 0: 1, 1: 1, 3: 2}
    assert {r.bucket: r.n for r in histogram.histogram(df, histogram.explicit_bucket("v", b, compat=True)).collect()}[3] == 3
    big = stream(spark, [0, 1], [(1 << 48) - 1, 1 << 48]).select(histogram.log2_bucket("v", 64).alias("b"))
    assert [r.b for r in big.collect()] == [47, 48]


@pytest.mark.parametrize("q, want", [(1, 0), (25, 25), (49, 49), (50, 50), (99, 99), (100, 100)])
def test_quantile_of_uniform_values(spark, q, want):
    h = histogram.histogram(spark.range(100).withColumnRenamed("id", "v"), histogram.linear_bucket("v", 10))
    assert abs(histogram.quantile(h, 10, q).first().quantile - want) <= 1


def test_quantile_rejects_other_percentages(spark):
    with pytest.raises(ValueError):
        histogram.quantile(spark.range(1), 10, 0)


def test_joins_suffix_columns_and_match_newest(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 5)], "k long, time long, x long")
    b = spark.createDataFrame([(1, 9, 7), (3, 1, 1)], "k long, time long, x long")
    out = joins.distinct_join(a, b, ["k"], "time", names=("a", "b"))
    assert out.columns == ["k", "time_a", "x_a", "time_b", "x_b"] and [tuple(r) for r in out.collect()] == [(1, 2, 20, 9, 7)]


def test_dialect_accepts_either_clause_order():
    a = parse("SELECT fd, cpu, COUNT(*), MAX(count) FROM tracepoint/syscalls/sys_enter_pread64 GROUP BY fd, cpu WHERE pid == 10 WINDOW(time, 1000, 1000)")
    b = parse("SELECT fd, cpu, COUNT(*), MAX(count) FROM tracepoint/syscalls/sys_enter_pread64 WHERE pid == 10 GROUP BY fd, cpu WINDOW(time, 1000, 1000);")
    assert a == b and a.window.kind == "time" and [i.agg for i in a.items] == [None, None, "count", "max"]


@pytest.mark.parametrize("sql", ["INSERT INTO x VALUES (1)", "SELECT a FROM b, c", "SELECT a, MAX(b) FROM c", "SELECT a FROM b WINDOW(rows, 1, 1)", "SELECT a FROM b WINDOW(session, 5)", "SELECT a FROM b LIMIT 3 UNION SELECT a FROM c", "SELECT a FROM b CROSS JOIN (SELECT a FROM c) ON 1", "SELECT a FROM b ON a = 1", "SELECT a FROM b WINDOW(count, 0, 1)", "SELECT (a FROM b", "SELECT a FROM b JOIN (SELECT a FROM c)"])
def test_dialect_rejects(sql):
    with pytest.raises(DialectError):
        parse(sql)


def test_catalog(spark, sf):
    assert kernel_schema("syscalls/sys_exit_pread64").names == ["ret", "time", "pid", "tgid", "cpu", "comm", "cgroup"]
    with pytest.raises(UnknownEvent):
        Catalog().get("x/y")
    assert tables(sf).get("tracepoint/syscalls/sys_enter_pread64").name == "syscalls/sys_enter_pread64"


def test_batches_come_window_by_window(spark, sf):
    engine = Engine(spark, tables(sf))
    out = list(engine.batches("SELECT event_id FROM events WINDOW(count, 300, 300)"))
    assert [(k, len(r)) for k, r in out] == [(0, 300), (1, 300), (2, 300)] and engine.stats[0]["planning_s"] >= 0


def test_stream_equals_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS id", "event_id * 7 AS time", "user_id")
    for k in range(3):
        src.where(f"id >= {k * 400} AND id < {(k + 1) * 400}").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    c = Catalog().add_files("s", f"{tmp_path}/in", time="time", tie="id", schema=src.schema, stream=True).add_files("b", f"{tmp_path}/in", time="time", tie="id")
    got = []
    q = Engine(spark, c, unit=1).stream("SELECT user_id, COUNT(*) FROM s GROUP BY user_id WINDOW(time, 700, 700)", lambda df, n: got.extend(tuple(r) for r in df.collect()))
    q.awaitTermination()
    want = Engine(spark, c, unit=1).execute("SELECT user_id, COUNT(*) FROM b GROUP BY user_id WINDOW(time, 700, 700)")[1]
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and got


@pytest.mark.parametrize("sql", ["SELECT a, COUNT(*) FROM s GROUP BY a WINDOW(session, 5)", "SELECT a FROM s WINDOW(count, 5, 9)", "SELECT a FROM s UNION SELECT a FROM t", "SELECT a FROM s JOIN (SELECT a FROM c) USING (a)", "SELECT a, COUNT(*) FROM s GROUP BY a", "SELECT COUNT(*) FROM s", "SELECT DISTINCT a FROM s", "SELECT a FROM s WINDOW(count, 5, 5) LIMIT 3"])
def test_stream_refuses_what_it_cannot_do_whole(sql):
    with pytest.raises(DialectError, match="a stream"):
        Engine(None, None).stream(sql, print)


@pytest.mark.parametrize("seed", range(4))
def test_windows_over_many_cells(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    times = sorted(int(x) for x in np.concatenate([rng.integers(0, 3000, 150), rng.integers(5000, 5050, 120), [700] * 60, rng.integers(9000, 9100, 20)]))
    df = stream(spark, times).repartition(5)
    monkeypatch.setattr(windows, "CELL_ROWS", 12)
    monkeypatch.setattr(windows, "GROUP", 3)
    assert [r.id for r in windows.global_rank(df, "time", "id").orderBy("rn").collect()] == list(range(len(times)))
    assert windows.global_rank(df.withColumn("__cell", F.lit(1)).withColumn("rn", F.lit(2)), "time", "id", "at").columns == ["time", "id", "v", "__cell", "rn", "at"]
    for size in (3, 40, 211, 4000):
        for closed in (False, True):
            want, end = [], None
            for t in times:
                if end is None or t > end or t == end and not closed:
                    want.append(t)
                    end = t + size
            got = windows.time_boundaries(df, size, "time", closed).orderBy("window_id").collect()
            assert [tuple(r) for r in got] == list(enumerate(want)), (size, closed)
            assert windows.time_boundaries(df, size, "time", closed, emit_partial=False).count() == len(want) - 1
    rows, out = windows.panes(df, "count", 30, 20, "time", "id")
    got = {r.window_id: r.n for r in out(rows.groupBy("pane").agg(F.sum("id").alias("n"))).groupBy("window_id").agg(F.sum("n").alias("n")).collect()}
    assert got == {k: sum(range(20 * k, 20 * k + 30)) for k in range((len(times) - 30) // 20 + 1)}
    assert windows.count_windows(df.withColumn("rn", F.lit(5)), 10, "time", "id").where("rn = 5").count() == len(times) // 10 * 10


def test_bare_columns_in_predicates(spark):
    schema = spark.createDataFrame([], "a int, b long, c string, d boolean").schema
    for text, want in (("a", "(a <> 0)"), ("NOT a OR (b AND d)", "NOT (a <> 0) OR ((b <> 0) AND d)"), ("b BETWEEN a AND b AND a", "b BETWEEN a AND b AND (a <> 0)"), ("abs(a) > 1 AND c = 'a AND b'", "abs(a) > 1 AND c = 'a AND b'"), ("a IN (a) AND d", "a IN (a) AND d")):
        assert predicate(text, schema) == want


def test_no_item_is_dropped(spark, sf):
    engine = Engine(spark, tables(sf))
    assert engine.execute("SELECT user_id, STDDEV(v), MAX(v * 2) AS m, COUNT(*) FROM events GROUP BY user_id")[1].columns == ["user_id", "STDDEV(v)", "m", "count_"]
    for sql in ("SELECT user_id, v FROM events GROUP BY user_id", "SELECT user_id, v + 1 FROM events GROUP BY user_id", "SELECT user_id, v, SUM(v) FROM events GROUP BY user_id"):
        with pytest.raises(DialectError):
            engine.execute(sql)
    a = engine.execute("SELECT STDDEV(v) AS s FROM events WINDOW(count, 500, 500)")[1]
    assert a.columns == ["window_id", "s"] and a.count() == 2


def test_distinct_aggregates_are_made_apart_from_large_states(spark, sf):
    engine = Engine(spark, tables(sf))
    for keys in ("", "event_type", "event_type, user_id"):
        head, tail = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
        both = "COUNT(DISTINCT event_id) + COUNT(*) AS n, PERCENTILE(v, 0.5) AS p, SUM(DISTINCT v), COUNT(DISTINCT user_id) AS u"
        got = engine.execute(f"SELECT {head}{both} FROM events{tail}")[1]
        spark.read.parquet(f"{sf}/events.parquet").selectExpr("*", "CAST(value AS BIGINT) AS v").createOrReplaceTempView("plain_events")
        want = spark.sql(f"SELECT {head}COUNT(DISTINCT event_id) + COUNT(*) AS n, PERCENTILE(v, 0.5) AS p, SUM(DISTINCT v) AS sum_v, COUNT(DISTINCT user_id) AS u FROM plain_events{tail}")
        assert got.columns == want.columns and rows(got.toPandas()) == rows(want.toPandas())
        # the percentile's state is per group, not per distinct value
        assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString().split("percentile")[0] and "Join" in got._jdf.queryExecution().optimizedPlan().toString()


def test_time_bounds_reach_the_files(spark, sf):
    plan = Engine(spark, tables(sf)).execute("SELECT event_id FROM events WHERE time >= 1704500000000000 AND v > 3 AND time < 1705500000000000")[1]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_sides_of_a_self_join_have_names(spark, sf):
    engine = Engine(spark, tables(sf))
    out = engine.execute("SELECT * FROM events JOIN (SELECT user_id, v FROM events) USING (user_id)")[1]
    assert {"v_events", "v_events_2", "user_id"} <= set(out.columns)
    q = Query("events").project("user_id", "v_events", "v_events_2").join(Query("events").project("user_id", "v"), ["user_id"])
    assert q.build(engine).count() == out.count()
    assert Query("events").project("user_id").union(Query("events").project("user_id"), "intersect").build(engine).count() == engine.execute("SELECT DISTINCT user_id FROM events")[1].count()


def test_batches_statistics_and_functions(spark, sf, caplog):
    engine = Engine(spark, tables(sf))
    with caplog.at_level("INFO"):
        out = list(engine.batches("SELECT event_id FROM events WINDOW(count, 300, 300)", 256))
    assert [(k, len(r)) for k, r in out] == [(k, n) for k in range(3) for n in (256, 44)]
    assert engine.stats[-1]["rows"] == 900 and engine.stats[-1]["runs"] == 1 and engine.stats[-1]["run_s"] > 0 and "900 rows" in caplog.text

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    engine.register("spread", spread)
    got = {r.event_type: r.s for r in engine.execute("SELECT event_type, spread(v) AS s FROM events GROUP BY event_type")[1].collect()}
    want = {r.event_type: r.s for r in engine.execute("SELECT event_type, MAX(v) - MIN(v) AS s FROM events GROUP BY event_type")[1].collect()}
    assert got == want and got


def sliced(spark, path, *parts):
    schema = "time long, id long, k long"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(spark, out, name):
    out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_late_rows_of_a_stream(spark, tmp_path):
    rows = [[(0, 0, 1), (90, 1, 1)], [(40, 2, 1), (95, 3, 1), (260, 4, 1)], [(100, 5, 1), (400, 6, 1)]]
    got = run(spark, windowed_stream(sliced(spark, tmp_path / "a", *rows), "time", 60, "time", "id"), "late").collect()
    # row 90 closes window 0, so row 40 comes too late; row 260 closes the window of 90 and 95, so row 100 does
    assert sorted((r.window_id, r.window_start, r.id) for r in got) == [(0, 0, 0), (1, 90, 1), (1, 90, 3), (2, 260, 4)]
    early = [[(50, 0, 1), (55, 1, 1)], [(20, 2, 1), (30, 3, 1)], [(200, 4, 1)]]
    got = run(spark, windowed_stream(sliced(spark, tmp_path / "b", *early), "time", 60, "time", "id"), "early").collect()
    assert sorted((r.window_id, r.window_start, r.id) for r in got) == [(0, 20, 0), (0, 20, 1), (0, 20, 2), (0, 20, 3)]


@pytest.mark.parametrize("kind, size, step", [("count", 6, 2), ("count", 5, 5), ("count", 7, 3), ("time", 60, 60), ("time", 60, 20), ("time", 50, 35)])
def test_windows_of_a_stream_are_found_at_once(spark, tmp_path, monkeypatch, kind, size, step):
    monkeypatch.setattr(stateful, "FRAME_ROWS", 4)
    times = sorted(np.random.default_rng(size * step).integers(0, 900, 120).tolist())
    parts = [[(t, i, 1) for i, t in enumerate(times)][a:b] for a, b in ((0, 1), (1, 50), (50, 53), (53, 120))]
    got = run(spark, windowed_stream(sliced(spark, tmp_path / "w", *parts), kind, size, "time", "id", step), f"w_{kind}_{size}_{step}").collect()
    df = stream(spark, times)
    if kind == "count":
        want = windows.count_windows(df, size, "time", "id") if step == size else windows.sliding_count(df, size, step, "time", "id")
        assert all(r.window_start == times[r.window_id * step] for r in got)
    else:
        want = windows.time_windows(df, size, "time") if step == size else windows.sliding_time(df, size, step, "time")
        assert {(r.window_id, r.window_start) for r in got} == {(r.window_id, r.window_start) for r in want.collect()}
    assert sorted((r.window_id, r.id) for r in got) == sorted((r.window_id, r.id) for r in want.collect()) and got


def test_many_windows_of_a_stream_take_time_in_proportion(spark, tmp_path):
    spark.range(300_000).selectExpr("id * 10 AS time", "id", "id AS k").coalesce(1).write.parquet(str(tmp_path / "m"))
    s = spark.readStream.schema("time long, id long, k long").parquet(str(tmp_path / "m"))
    began = time.perf_counter()
    assert run(spark, windowed_stream(s.select("time", "id"), "count", 6, "time", "id", 4).where("id % 100 = 0"), "many").count() > 3000
    assert time.perf_counter() - began < 60  # one copy of what is left for each window took minutes


@pytest.mark.parametrize("name", ["stream_slide_count", "stream_slide_time"])
def test_rows_of_a_stream_stay_off_the_driver(spark, sf, monkeypatch, name):
    assert QUERIES[name](spark, sf).inputFiles()
    want = rows(QUERIES[name](spark, sf).toPandas())
    monkeypatch.setattr(queries, "SLICE_ROWS", 200)
    assert rows(QUERIES[name](spark, sf).toPandas()) == want


def test_time_windows_of_a_stream_read_tables_of_several_files(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["stream_time_windows"](spark, str(tmp_path))
    assert got.inputFiles() and rows(got.toPandas()) == rows(QUERIES["stream_time_windows"](spark, sf).toPandas()) and got.count()


def test_stream_joins_drop_what_cannot_meet(spark, tmp_path):
    rows = [[(0, 0, 1), (1, 1, 2)], [(3_600, 2, 1), (90_000, 3, 2)], [(100_000, 4, 1), (100_001, 5, 3)], [(100_002, 6, 3)]]
    s = sliced(spark, tmp_path / "j", *rows).withColumn("at", F.timestamp_seconds(F.col("time") + 1_000_000))
    out = stream_joins.join_streams(s.where("id IN (0, 1, 5)"), s.where("id IN (2, 3, 4)"), ["k"], ("at", "at"), "2 HOURS", "1 hour", how="left")
    got = sorted((r.k, r.id_left, r.id_right) for r in run(spark, out.select("k", "id_left", "id_right"), "joined").fillna(-1).collect())
    assert got == [(1, 0, 2), (2, 1, -1)]


def test_stream_takes_a_trigger(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS id", "event_id * 7 AS time")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    c = Catalog().add_files("s", f"{tmp_path}/in", time="time", tie="id", schema=src.schema, stream=True)
    got, engine = [], Engine(spark, c, unit=1)
    q = engine.stream("SELECT COUNT(*) FROM s WINDOW(count, 100, 50)", lambda df, n: got.extend(tuple(r) for r in df.collect()), trigger={"processingTime": "200 milliseconds"})
    try:
        q.processAllAvailable()
        assert sorted(got) == [(k, 35 + 50 * 7 * k - 35, 100) for k in range(19)] or sorted(r[0] for r in got) == list(range(19))
        assert engine.stream_stats(q)[0]["rows"] == 1000
    finally:
        q.stop()
