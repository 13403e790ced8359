"""Registered queries of the stream engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import aggregates as A
from .operators import histogram as H
from .operators import joins as J
from .operators import windows as W
from .plans.builder import Query
from .plans.engine import Engine
from .sources.catalog import load_events, micros, tables, timestamp_literal
from .streaming.joins import join_streams, latency_stream
from .streaming.stateful import windowed_stream

HOUR = 3_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUCKETS = [(5, 10), (10, 15), (15, 20), (20, 100)]

_E = "e AS (SELECT event_id, epoch_us(ts) AS time, user_id, event_type, value, CAST(trunc(value) AS BIGINT) AS v FROM events)"
_R = _E + ", r AS (SELECT *, row_number() OVER (ORDER BY time, event_id) AS rn, count(*) OVER () AS total FROM e)"


def _count(n: int) -> str:
    return _R + f", w AS (SELECT *, (rn - 1) // {n} AS window_id FROM r WHERE (rn - 1) // {n} < total // {n})"


def _anchored(size: int, closed: bool = False, rows: str = "e") -> str:
    past, within = (">", "<=") if closed else (">=", "<")
    return f"""{_E}, RECURSIVE_s(window_id, window_start) AS (
  SELECT 0, min(time) FROM {rows}
  UNION ALL SELECT window_id + 1, (SELECT min(time) FROM {rows} x WHERE x.time {past} s.window_start + {size}) FROM s WHERE window_start IS NOT NULL
), b AS (SELECT CAST(window_id AS BIGINT) AS window_id, CAST(window_start AS BIGINT) AS window_start FROM s WHERE window_start IS NOT NULL),
w AS (SELECT e.*, b.window_id, b.window_start FROM {rows} e JOIN b ON e.time >= b.window_start AND e.time {within} b.window_start + {size} WHERE b.window_id < (SELECT max(window_id) FROM b))""".replace("RECURSIVE_s", "s")


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def dialect(name: str, text: str, sql: str) -> None:
    """A query written in the dialect."""
    QUERIES[name] = lambda s, d: Engine(s, tables(d)).execute(text)[1]
    ORACLES[name] = sql


_KEYED = "user_id, event_type"

# sources, projections, predicates
dialect("scan_project", "SELECT event_id, user_id, event_type FROM events", "SELECT event_id, user_id, event_type FROM events")
dialect("project_star", "SELECT * FROM events", f"WITH {_E} SELECT * FROM e")
dialect("kernel_event_name", "SELECT pid, fd, count FROM tracepoint/syscalls/sys_enter_pread64", f"WITH {_E} SELECT user_id AS pid, event_type AS fd, v AS count FROM e")
dialect("filter_eq", "SELECT event_id FROM events WHERE event_type == 'purchase'", "SELECT event_id FROM events WHERE event_type = 'purchase'")
dialect("filter_ne", "SELECT event_id FROM events WHERE event_type != 'click'", "SELECT event_id FROM events WHERE event_type <> 'click'")
dialect("filter_range", "SELECT event_id, v FROM events WHERE v >= 10 AND v < 50 AND user_id > 5 AND user_id <= 90", f"WITH {_E} SELECT event_id, v FROM e WHERE v >= 10 AND v < 50 AND user_id > 5 AND user_id <= 90")
dialect("filter_and", "SELECT event_id FROM events WHERE v > 20 AND event_type = 'view'", f"WITH {_E} SELECT event_id FROM e WHERE v > 20 AND event_type = 'view'")
dialect("filter_or", "SELECT event_id FROM events WHERE v > 100 OR (event_type = 'signup' AND NOT v = 3)", f"WITH {_E} SELECT event_id FROM e WHERE v > 100 OR (event_type = 'signup' AND NOT v = 3)")
dialect("filter_truthy", "SELECT event_id FROM events WHERE v", f"WITH {_E} SELECT event_id FROM e WHERE v <> 0")
dialect("filter_pid", "SELECT pid, fd FROM syscalls/sys_enter_pread64 WHERE pid = 7", "SELECT user_id AS pid, event_type AS fd FROM events WHERE user_id = 7")
dialect("filter_in_between_like", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND v BETWEEN 5 AND 60 AND event_type LIKE 'c%'", f"WITH {_E} SELECT event_id FROM e WHERE event_type IN ('view', 'click') AND v BETWEEN 5 AND 60 AND event_type LIKE 'c%'")
dialect("map_arith", "SELECT event_id, v * 2 + 1 AS x, v - user_id AS y FROM events", f"WITH {_E} SELECT event_id, v * 2 + 1 AS x, v - user_id AS y FROM e")
dialect("map_in_place", "SELECT event_id, time div 1000 AS time FROM events", f"WITH {_E} SELECT event_id, time // 1000 AS time FROM e")
dialect("map_strlen", "SELECT event_id, CAST(length(event_type) AS BIGINT) AS n FROM events", "SELECT event_id, CAST(length(event_type) AS BIGINT) AS n FROM events")
dialect("case_when", "SELECT event_id, CASE WHEN v > 50 THEN 'high' WHEN v > 10 THEN 'mid' ELSE 'low' END AS band FROM events", f"WITH {_E} SELECT event_id, CASE WHEN v > 50 THEN 'high' WHEN v > 10 THEN 'mid' ELSE 'low' END AS band FROM e")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax")
def filter_col_col(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_discount < l_tax").select("l_orderkey", "l_linenumber")


@query(f"WITH {_R} SELECT event_id, rn AS running FROM r")
def running_count(spark, sf_dir):
    return W.global_rank(load_events(spark, sf_dir), "time", "event_id", name="running").select("event_id", "running")


# aggregates per window
for _name, _call, _sql in (
    ("agg_max", "MAX(v)", "max(v) AS max_v"),
    ("agg_min", "MIN(v)", "min(v) AS min_v"),
    ("agg_sum", "SUM(v)", "CAST(sum(v) AS BIGINT) AS sum_v"),
    ("agg_count_col", "COUNT(v)", "count(v) AS count_v"),
    ("agg_count_star", "COUNT(*)", "count(*) AS count_"),
    ("agg_avg_int", "AVG(v)", "CAST(sum(v) // count(v) AS BIGINT) AS avg_v"),
):
    dialect(_name, f"SELECT user_id, event_type, {_call} FROM events GROUP BY user_id, event_type WINDOW(count, 500, 500)", f"WITH {_count(500)} SELECT window_id, {_KEYED}, {_sql} FROM w GROUP BY ALL")
dialect(
    "agg_multi",
    "SELECT user_id, event_type, COUNT(*), MAX(v), AVG(v) FROM events GROUP BY user_id, event_type WHERE v > 5 WINDOW(count, 500, 500)",
    f"WITH {_count(500).replace('FROM e)', 'FROM e WHERE v > 5)')} SELECT window_id, {_KEYED}, count(*) AS count_, max(v) AS max_v, CAST(sum(v) // count(v) AS BIGINT) AS avg_v FROM w GROUP BY ALL",
)
dialect("agg_ungrouped", "SELECT COUNT(*), SUM(v), AVG(v) FROM events", f"WITH {_E} SELECT count(*) AS count_, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(v) // count(v) AS BIGINT) AS avg_v FROM e")
dialect("agg_distinct", "SELECT event_type, COUNT(DISTINCT user_id), SUM(DISTINCT v) FROM events GROUP BY event_type", f"WITH {_E} SELECT event_type, count(DISTINCT user_id) AS count_user_id, CAST(sum(DISTINCT v) AS BIGINT) AS sum_v FROM e GROUP BY ALL")
dialect("select_distinct", "SELECT DISTINCT event_type FROM events WINDOW(count, 100, 100)", f"WITH {_count(100)} SELECT DISTINCT window_id, event_type FROM w")
dialect("group_only", "SELECT user_id FROM events GROUP BY user_id WINDOW(count, 500, 500)", f"WITH {_count(500)} SELECT DISTINCT window_id, user_id FROM w")
dialect("having", "SELECT user_id, COUNT(*) FROM events GROUP BY user_id HAVING count_ > 3 WINDOW(count, 500, 500)", f"WITH {_count(500)} SELECT window_id, user_id, count(*) AS count_ FROM w GROUP BY ALL HAVING count(*) > 3")
dialect("having_nonzero", "SELECT user_id, MAX(v) FROM events GROUP BY user_id HAVING max_v <> 0", f"WITH {_E} SELECT user_id, max(v) AS max_v FROM e GROUP BY ALL HAVING max(v) <> 0")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").rollup("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), F.count("*").alias("n"))


# windows
dialect("win_count_agg", "SELECT event_type, COUNT(*), MAX(v) FROM events GROUP BY event_type WINDOW(count, 100, 100)", f"WITH {_count(100)} SELECT window_id, event_type, count(*) AS count_, max(v) AS max_v FROM w GROUP BY ALL")
dialect("win_count_raw", "SELECT event_id, v FROM events WINDOW(count, 64, 64)", f"WITH {_count(64)} SELECT window_id, event_id, v FROM w")


@query(f"WITH {_R} SELECT rn // 100 AS window_id, count(*) AS count_ FROM r WHERE rn // 100 < total // 100 GROUP BY ALL")
def win_count_ref_compat(spark, sf_dir):
    return A.group(W.count_windows(load_events(spark, sf_dir), 100, "time", "event_id", compat=True), [], A.aggregate("count", "*"))


dialect("win_time_anchored", "SELECT user_id, COUNT(*), MAX(v), AVG(v) FROM events GROUP BY user_id WINDOW(time, 21600000, 21600000)", f"WITH RECURSIVE {_anchored(6 * HOUR)} SELECT window_id, window_start, user_id, count(*) AS count_, max(v) AS max_v, CAST(sum(v) // count(v) AS BIGINT) AS avg_v FROM w GROUP BY ALL")
dialect("win_time_raw", "SELECT event_id FROM events WINDOW(time, 86400000, 86400000)", f"WITH RECURSIVE {_anchored(24 * HOUR)} SELECT window_id, window_start, event_id FROM w")


@query(f"WITH RECURSIVE {_anchored(24 * HOUR, True)} SELECT window_id, window_start, count(*) AS count_ FROM w GROUP BY ALL")
def win_time_anchored_closed(spark, sf_dir):
    return A.group(W.time_windows(load_events(spark, sf_dir), 24 * HOUR, "time", closed=True), [], A.aggregate("count", "*"))


@query(f"WITH {_E} SELECT time - time % {HOUR} AS window_start, time // {HOUR} AS window_id, event_type, count(*) AS count_ FROM e GROUP BY ALL")
def win_time_aligned(spark, sf_dir):
    return A.group(W.aligned_windows(load_events(spark, sf_dir), HOUR, "time"), ["event_type"], A.aggregate("count", "*"))


dialect("win_slide_count", "SELECT COUNT(*), SUM(v) FROM events WINDOW(count, 100, 25)", f"WITH {_R} SELECT k AS window_id, count(*) AS count_, CAST(sum(v) AS BIGINT) AS sum_v FROM r, range(0, 1 + (SELECT (count(*) - 100) // 25 FROM events)) t(k) WHERE rn > k * 25 AND rn <= k * 25 + 100 GROUP BY ALL")
dialect(
    "win_slide_time",
    "SELECT event_type, COUNT(*) FROM events GROUP BY event_type WINDOW(time, 86400000, 21600000)",
    f"WITH {_E}, a AS (SELECT min(time) AS a, max(time) AS z FROM e) SELECT k AS window_id, a + k * {6 * HOUR} AS window_start, event_type, count(*) AS count_ FROM e, a, range(0, 1 + (SELECT (z - a - {24 * HOUR}) // {6 * HOUR} FROM a)) t(k) WHERE time >= a + k * {6 * HOUR} AND time < a + k * {6 * HOUR} + {24 * HOUR} GROUP BY ALL",
)


@query(f"WITH {_E}, g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY user_id ORDER BY time) < {HOUR // 2} THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY time) AS k FROM g) SELECT user_id, min(time) AS session_start, count(*) AS count_ FROM s GROUP BY user_id, k")
def win_session(spark, sf_dir):
    return W.session_windows(load_events(spark, sf_dir), HOUR // 2, "time", "user_id").groupBy("user_id", "session_start").agg(A.aggregate("count", "*"))


# distinct and joins
@query(f"WITH {_count(500)} SELECT window_id, user_id, arg_max(event_id, rn) AS event_id, arg_max(v, rn) AS v FROM w GROUP BY ALL")
def latest_distinct(spark, sf_dir):
    w = W.count_windows(load_events(spark, sf_dir), 500, "time", "event_id")
    return A.latest(w, ["user_id"], "time", "event_id").select("window_id", "user_id", "event_id", "v")


def _sides(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return (e.where(F.col("event_type") == x).select("user_id", "time", "event_id", "v") for x in ("signup", "purchase"))


_SIDES = _E + "".join(f", {x} AS (SELECT user_id, max(time) AS time, arg_max(event_id, (time, event_id)) AS event_id, arg_max(v, (time, event_id)) AS v FROM e WHERE event_type = '{x}' GROUP BY user_id)" for x in ("signup", "purchase"))


@query(f"WITH {_SIDES} SELECT user_id, " + ", ".join(f"{x}.{c} AS {c}_{x}" for x in ("signup", "purchase") for c in ("time", "event_id", "v")) + " FROM signup JOIN purchase USING (user_id)")
def distinct_join(spark, sf_dir):
    return J.distinct_join(*_sides(spark, sf_dir), ["user_id"], "time", "event_id", ("signup", "purchase"))


@query(f"WITH {_SIDES} SELECT count(*) AS matches FROM signup JOIN purchase USING (user_id)")
def distinct_join_count(spark, sf_dir):
    return J.distinct_join(*_sides(spark, sf_dir), ["user_id"], "time", "event_id").agg(F.count("*").alias("matches"))


dialect(
    "windowed_join",
    "SELECT user_id, event_id_events, vv_events_2, n_events_2 FROM events JOIN (SELECT user_id, event_id AS n, v AS vv FROM events WHERE event_type = 'purchase' WINDOW(count, 100, 100)) USING (user_id) WHERE event_type = 'signup' WINDOW(count, 100, 100)",
    "WITH "
    + _E
    + "".join(f", {x} AS (SELECT *, (rn - 1) // 100 AS window_id FROM (SELECT *, row_number() OVER (ORDER BY time, event_id) AS rn, count(*) OVER () AS total FROM e WHERE event_type = '{x}') WHERE (rn - 1) // 100 < total // 100)" for x in ("signup", "purchase"))
    + " SELECT s.window_id, s.user_id, s.event_id AS event_id_events, p.v AS vv_events_2, p.event_id AS n_events_2 FROM signup s JOIN purchase p USING (window_id, user_id)",
)


@query(f"WITH {_E}, p AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN time END) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start_time FROM e) SELECT user_id, event_id, start_time, time - start_time AS duration FROM p WHERE event_type = 'purchase' AND start_time IS NOT NULL")
def latency_pairs(spark, sf_dir):
    return J.latency_pairs(load_events(spark, sf_dir), "event_type = 'signup'", "event_type = 'purchase'", "user_id", "time", "event_id").select("user_id", "event_id", "start_time", "duration")


# histograms
_CASES = "CASE WHEN v >= 100 THEN 4 " + " ".join(f"WHEN v >= {a} AND v < {b} THEN {i}" for i, (a, b) in enumerate(BUCKETS)) + " ELSE {} END"


@query(f"WITH {_E} SELECT CAST({_CASES.format(-1)} AS BIGINT) AS bucket, count(*) AS n FROM e GROUP BY ALL")
def hist_explicit(spark, sf_dir):
    return H.histogram(load_events(spark, sf_dir), H.explicit_bucket("v", BUCKETS))


@query(f"WITH {_E} SELECT CAST({_CASES.format(4)} AS BIGINT) AS bucket, count(*) AS n FROM e GROUP BY ALL")
def hist_explicit_compat(spark, sf_dir):
    return H.histogram(load_events(spark, sf_dir), H.explicit_bucket("v", BUCKETS, compat=True))


@query(f"WITH {_count(500)} SELECT window_id, v // 10 AS bucket, count(*) AS n FROM w GROUP BY ALL")
def hist_linear(spark, sf_dir):
    return H.histogram(W.count_windows(load_events(spark, sf_dir), 500, "time", "event_id"), H.linear_bucket("v", 10), "window_id")


@query(f"WITH {_E} SELECT CAST(CASE WHEN v <= 0 THEN 0 ELSE least(length(ltrim(CAST(CAST(v AS BIT) AS VARCHAR), '0')) - 1, 7) END AS BIGINT) AS bucket, count(*) AS n FROM e GROUP BY ALL")
def hist_log2(spark, sf_dir):
    return H.histogram(load_events(spark, sf_dir), H.log2_bucket("v", 8))


def _quantile_sql(q: int) -> str:
    s = q * 10_000
    base = f"{_E}, h AS (SELECT v // 10 AS bucket, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM h)"
    if q >= 50:
        rest = f"c AS (SELECT *, 1000000 * (total - CAST(sum(n) OVER (ORDER BY bucket DESC) AS BIGINT)) // total AS b FROM t), p AS (SELECT *, lag(b, 1, 1000000) OVER (ORDER BY bucket DESC) AS prev FROM c) SELECT CASE WHEN b = {s} THEN bucket * 10 ELSE bucket * 10 + 10 * ({s} - b) // (prev - b) END AS quantile FROM p WHERE b <= {s} ORDER BY bucket DESC LIMIT 1"
    else:
        rest = f"c AS (SELECT *, 1000000 * CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) // total AS b FROM t), p AS (SELECT *, lag(b, 1, 0) OVER (ORDER BY bucket) AS prev FROM c) SELECT CASE WHEN b = {s} THEN (bucket + 1) * 10 ELSE bucket * 10 + 10 * ({s} - prev) // (b - prev) END AS quantile FROM p WHERE b >= {s} ORDER BY bucket LIMIT 1"
    return f"WITH {base}, {rest}"


for _name, _q in (("hist_quantile_low", 25), ("hist_quantile_mid", 50), ("hist_quantile_high", 99)):
    QUERIES[_name] = lambda s, d, q=_q: H.quantile(H.histogram(load_events(s, d), H.linear_bucket("v", 10)), 10, q)
    ORACLES[_name] = _quantile_sql(_q)

# order, limits, sets, scalars
dialect("topk", "SELECT event_id, v FROM events ORDER BY v DESC, event_id LIMIT 20", f"WITH {_E} SELECT event_id, v FROM e ORDER BY v DESC, event_id LIMIT 20")
dialect("sort_desc", "SELECT event_id, time FROM events ORDER BY time DESC, event_id DESC", f"WITH {_E} SELECT event_id, time FROM e")


def _users(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return (e.where(F.col("event_type") == x).select("user_id") for x in ("signup", "purchase"))


_U = [f"SELECT user_id FROM events WHERE event_type = '{x}'" for x in ("signup", "purchase")]


@query(f"{_U[0]} UNION ALL {_U[1]}")
def union_all(spark, sf_dir):
    a, b = _users(spark, sf_dir)
    return a.union(b)


@query(f"{_U[0]} INTERSECT {_U[1]}")
def intersect_q(spark, sf_dir):
    a, b = _users(spark, sf_dir)
    return a.intersect(b)


_X = ["SELECT user_id FROM events WHERE event_type = 'signup' AND v < 40", "SELECT user_id FROM events WHERE event_type = 'purchase' AND v > 60"]
for _name, _kind in (("except_q", "EXCEPT"), ("except_all", "EXCEPT ALL"), ("union_distinct", "UNION"), ("intersect_all", "INTERSECT ALL")):
    dialect(_name, f" {_kind} ".join(_X), f"WITH {_E} " + f" {_kind} ".join(x.replace("FROM events", "FROM e") for x in _X))
dialect("union_top", f"{_X[0]} UNION ALL {_X[1]} ORDER BY user_id DESC LIMIT 7", f"WITH {_E} SELECT * FROM ({_X[0].replace('FROM events', 'FROM e')} UNION ALL {_X[1].replace('FROM events', 'FROM e')}) ORDER BY user_id DESC LIMIT 7")


@query(f"WITH {_E} SELECT event_id, CAST(CASE WHEN time <= 0 THEN 0 ELSE length(ltrim(CAST(CAST(time AS BIT) AS VARCHAR), '0')) - 1 END AS BIGINT) AS l FROM e")
def math_log2(spark, sf_dir):
    return load_events(spark, sf_dir).select("event_id", scalars.log2_int(F.col("time")).alias("l"))


@query(f"WITH {_E} SELECT event_id, (v + user_id) // 2 AS m FROM e")
def math_avg_no_overflow(spark, sf_dir):
    return load_events(spark, sf_dir).select("event_id", scalars.average_of_two(F.col("v"), F.col("user_id")).alias("m"))


@query(f"WITH {_E} SELECT event_id, CAST((v >> 3) & 1 AS INTEGER) AS b FROM e")
def bit_test(spark, sf_dir):
    return load_events(spark, sf_dir).select("event_id", scalars.bit(F.col("v"), 3).alias("b"))


# general expressions, predicates and joins of the dialect
_K = "k AS (SELECT event_id, event_type AS fd, v AS count, time, user_id AS pid, user_id * 10 AS tgid, event_id % 4 AS cpu, 'task' || CAST(user_id % 7 AS VARCHAR) AS comm, user_id // 16 AS cgroup FROM e)"
_P = "syscalls/sys_enter_pread64"
dialect("filter_truthy_and", "SELECT event_id FROM events WHERE v AND NOT (user_id) AND event_id BETWEEN 10 AND 9000 OR (v AND user_id > 50)", f"WITH {_E} SELECT event_id FROM e WHERE v <> 0 AND NOT (user_id <> 0) AND event_id BETWEEN 10 AND 9000 OR (v <> 0 AND user_id > 50)")
dialect("filter_functions", "SELECT event_id FROM events WHERE LENGTH(event_type) > 5 AND ABS(v - 50) < 10", f"WITH {_E} SELECT event_id FROM e WHERE length(event_type) > 5 AND abs(v - 50) < 10")
dialect("filter_time", "SELECT event_id, time FROM events WHERE time >= 1704500000000000 AND time < 1705500000000000 AND v > 3", f"WITH {_E} SELECT event_id, time FROM e WHERE time >= 1704500000000000 AND time < 1705500000000000 AND v > 3")
dialect("star_qualified", "SELECT e.* FROM events AS e WHERE e.v > 50", f"WITH {_E} SELECT * FROM e WHERE v > 50")
dialect("system_attributes", f"SELECT tgid, cpu, comm, cgroup, COUNT(*), MAX(count) FROM tracepoint/{_P} GROUP BY tgid, cpu, comm, cgroup", f"WITH {_E}, {_K} SELECT tgid, cpu, comm, cgroup, count(*) AS count_, max(count) AS max_count FROM k GROUP BY ALL")
dialect("scalars_of_spark", "SELECT event_id, UPPER(event_type) AS u, SIZE(SPLIT(event_type, 'i')) AS parts, time div 86400000000 AS day, ROUND(SQRT(v), 6) AS root FROM events WHERE v >= 0", f"WITH {_E} SELECT event_id, upper(event_type) AS u, CAST(len(string_split(event_type, 'i')) AS INTEGER) AS parts, time // 86400000000 AS day, round(sqrt(v), 6) AS root FROM e WHERE v >= 0")
dialect("ranking", "SELECT event_id, RANK() OVER (PARTITION BY user_id ORDER BY v DESC) AS r, COALESCE(LAG(v) OVER (PARTITION BY user_id ORDER BY time, event_id), -1) AS before FROM events", f"WITH {_E} SELECT event_id, CAST(rank() OVER (PARTITION BY user_id ORDER BY v DESC) AS INTEGER) AS r, coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY time, event_id), -1) AS before FROM e")
dialect("agg_expressions", "SELECT event_type, MAX(v * 2) AS m, SUM(v) + COUNT(*) AS s, COUNT(*) FROM events GROUP BY event_type WINDOW(count, 500, 500)", f"WITH {_count(500)} SELECT window_id, event_type, max(v * 2) AS m, CAST(sum(v) + count(*) AS BIGINT) AS s, count(*) AS count_ FROM w GROUP BY ALL")
dialect("agg_spread", "SELECT event_type, ROUND(STDDEV(v), 6) AS sd, ROUND(VAR_POP(v), 4) AS var FROM events GROUP BY event_type", f"WITH {_E} SELECT event_type, round(stddev(v), 6) AS sd, round(var_pop(v), 4) AS var FROM e GROUP BY ALL")
dialect("agg_collect", "SELECT event_type, ARRAY_JOIN(SORT_ARRAY(COLLECT_SET(CAST(v % 5 AS STRING))), ',') AS rests FROM events GROUP BY event_type", f"WITH {_E} SELECT event_type, array_to_string(list_sort(list(DISTINCT CAST(v % 5 AS VARCHAR))), ',') AS rests FROM e GROUP BY ALL")
dialect("agg_sketch", "SELECT ABS(APPROX_COUNT_DISTINCT(event_id) - COUNT(DISTINCT event_id)) <= 0.15 * COUNT(*) AS near, ABS(APPROX_PERCENTILE(v, 0.5) - PERCENTILE(v, 0.5)) <= 1 AS middle FROM events", "SELECT true AS near, true AS middle")
dialect("cube", f"SELECT fd, comm, COUNT(*), SUM(count) FROM {_P} GROUP BY CUBE (fd, comm)", f"WITH {_E}, {_K} SELECT fd, comm, count(*) AS count_, CAST(sum(count) AS BIGINT) AS sum_count FROM k GROUP BY CUBE (fd, comm)")
dialect("grouping_sets", f"SELECT fd, comm, COUNT(*) FROM {_P} GROUP BY GROUPING SETS ((fd, comm), (comm), ()) WINDOW(count, 1000, 1000)", f"WITH {_E}, {_K}, w AS (SELECT *, (row_number() OVER (ORDER BY time, event_id) - 1) // 1000 AS window_id FROM k) SELECT window_id, fd, comm, count(*) AS count_ FROM w WHERE window_id < (SELECT count(*) // 1000 FROM e) GROUP BY GROUPING SETS ((window_id, fd, comm), (window_id, comm), (window_id))")
dialect("rollup_dialect", f"SELECT fd, comm, MAX(count) FROM {_P} GROUP BY ROLLUP (fd, comm)", f"WITH {_E}, {_K} SELECT fd, comm, max(count) AS max_count FROM k GROUP BY ROLLUP (fd, comm)")
dialect("having_aggregate", "SELECT user_id, COUNT(*) FROM events GROUP BY user_id HAVING SUM(v) > 500 AND MIN(v) < 5", f"WITH {_E} SELECT user_id, count(*) AS count_ FROM e GROUP BY ALL HAVING sum(v) > 500 AND min(v) < 5")
dialect("session_dialect", "SELECT user_id, COUNT(*), MAX(v) FROM events GROUP BY user_id WINDOW(session, 1800000)", f"WITH {_E}, g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY user_id ORDER BY time) < {HOUR // 2} THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY time) AS k FROM g) SELECT min(time) AS window_start, user_id, count(*) AS count_, max(v) AS max_v FROM s GROUP BY user_id, k")
dialect("slide_raw", "SELECT event_id FROM events WINDOW(count, 60, 20)", f"WITH {_R} SELECT k AS window_id, event_id FROM r, range(0, 1 + (SELECT (count(*) - 60) // 20 FROM events)) t(k) WHERE rn > k * 20 AND rn <= k * 20 + 60")
_RIGHT = "(SELECT user_id, event_id, v FROM events WHERE event_type = 'purchase' AND v > 90)"
dialect("join_left_on", f"SELECT user_id_s, event_id_s, COALESCE(event_id_p, -1) AS event_id_p FROM events AS s LEFT JOIN {_RIGHT} AS p ON s.user_id = p.user_id AND s.v < p.v WHERE event_type = 'signup' AND v > 50", f"WITH {_E}, p AS (SELECT * FROM e WHERE event_type = 'purchase' AND v > 90) SELECT s.user_id AS user_id_s, s.event_id AS event_id_s, coalesce(p.event_id, -1) AS event_id_p FROM e s LEFT JOIN p ON s.user_id = p.user_id AND s.v < p.v WHERE s.event_type = 'signup' AND s.v > 50")
dialect("join_full", f"SELECT user_id, COALESCE(event_id_s, -1) AS event_id_s, COALESCE(event_id_p, -1) AS event_id_p FROM events AS s FULL OUTER JOIN {_RIGHT} AS p USING (user_id) WHERE event_type = 'signup' AND v > 90", f"WITH {_E}, p AS (SELECT * FROM e WHERE event_type = 'purchase' AND v > 90), s AS (SELECT * FROM e WHERE event_type = 'signup' AND v > 90) SELECT user_id, coalesce(s.event_id, -1) AS event_id_s, coalesce(p.event_id, -1) AS event_id_p FROM s FULL JOIN p USING (user_id)")
for _name, _kind, _test in (("join_semi", "SEMI", "IN"), ("join_anti", "ANTI", "NOT IN")):
    dialect(_name, f"SELECT user_id, event_id_events FROM events LEFT {_kind} JOIN {_RIGHT} AS p USING (user_id) WHERE event_type = 'signup'", f"WITH {_E} SELECT user_id, event_id AS event_id_events FROM e WHERE event_type = 'signup' AND user_id {_test} (SELECT user_id FROM e WHERE event_type = 'purchase' AND v > 90)")
dialect("join_one_window", "SELECT event_type_events, COUNT(*), MAX(top_u) FROM events JOIN (SELECT user_id, MAX(v) AS top FROM events GROUP BY user_id) AS u USING (user_id) GROUP BY event_type_events WINDOW(count, 500, 500)", f"WITH {_count(500)}, u AS (SELECT user_id, max(v) AS top FROM e GROUP BY ALL) SELECT window_id, event_type AS event_type_events, count(*) AS count_, max(top) AS max_top_u FROM w JOIN u USING (user_id) GROUP BY ALL")


@query(f"WITH {_E} SELECT event_id, 2 * v + 1 AS odd FROM e WHERE v > 50")
def udf_hook(spark, sf_dir):
    return Engine(spark, tables(sf_dir)).register("make_odd", lambda x: 2 * x + 1).execute("SELECT event_id, make_odd(v) AS odd FROM events WHERE v > 50")[1]


@query(f"WITH {_count(500)} SELECT window_id, user_id, count(*) AS count_, max(v) AS max_v FROM w GROUP BY ALL HAVING count(*) > 2 ORDER BY count_ DESC, window_id, user_id LIMIT 40")
def fluent_builder(spark, sf_dir):
    q = Query("events").window("count", 500).group_by("user_id").count().max("v").having("count_ > 2").order_by("count_ desc", "window_id", "user_id").limit(40)
    return q.build(Engine(spark, tables(sf_dir)))


@query(f"WITH {_E}, g AS (SELECT user_id, event_type, max(v) AS max_v FROM e GROUP BY ALL) SELECT user_id, count(*) AS count_, max(max_v) AS max_max_v FROM g GROUP BY ALL")
def shared_synopsis(spark, sf_dir):
    engine = Engine(spark, tables(sf_dir)).share("tops", "SELECT user_id, event_type, MAX(v) FROM events GROUP BY user_id, event_type")
    return engine.execute("SELECT user_id, COUNT(*), MAX(max_v) FROM tops GROUP BY user_id")[1]


@query(f"WITH {_E}, a AS (SELECT user_id, CAST(sum(v) * 256 AS BIGINT) // count(v) AS avg_fixed_v, count(v) AS n, max(v) AS top FROM e GROUP BY ALL) SELECT user_id, avg_fixed_v, CASE WHEN n <= 1 THEN 0 ELSE (avg_fixed_v * n - 256 * top) // (n - 1) END AS without_top FROM a")
def agg_avg_fixed(spark, sf_dir):
    a = load_events(spark, sf_dir).groupBy("user_id").agg(A.aggregate("avg_fixed", "v"), F.count("v").alias("n"), F.max("v").alias("top"))
    return a.select("user_id", "avg_fixed_v", A.retract_average(F.col("avg_fixed_v"), F.col("n"), F.col("top")).alias("without_top"))


@query(f"WITH {_R} SELECT (rn - 1) // 20 AS window_id, event_id FROM r WHERE (rn - 1) // 20 < (total - 60) // 20")
def expired_rows(spark, sf_dir):
    return W.expired(load_events(spark, sf_dir), 60, 20, "time", "event_id").select("window_id", "event_id")


@query("SELECT s_suppkey, s_nationkey, coalesce(n_regionkey, -1) AS ns_pid FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey > 1")
def namespace_lookup(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey > 1").selectExpr("n_nationkey AS s_nationkey", "n_regionkey AS ns_pid")
    return J.with_looked_up(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey"), nation, ["s_nationkey"], "ns_pid").fillna(-1, "ns_pid")


@query(f"WITH {_E} SELECT event_id, CAST(CASE WHEN v > 50 THEN 3 WHEN v > 20 THEN 2 WHEN v > 5 THEN 1 ELSE 0 END AS INTEGER) AS place, event_type AS plain FROM e")
def search_and_padding(spark, sf_dir):
    padded = F.rpad("event_type", 16, "\0")
    return load_events(spark, sf_dir).select("event_id", scalars.search_sorted(F.array(*(F.lit(x).cast("bigint") for x in (5, 20, 50))), F.col("v")).alias("place"), scalars.without_padding(padded).alias("plain"))


def _explicit_quantile_sql(q: int) -> str:
    s, ends = q * 10_000, [(0, BUCKETS[0][0]), *BUCKETS, (BUCKETS[-1][1], H.OPEN_END)]
    pick = lambda k: "CAST(CASE bucket " + " ".join(f"WHEN {i - 1} THEN {e[k]}" for i, e in enumerate(ends)) + " END AS HUGEINT)"
    base = f"{_E}, h AS (SELECT {_CASES.format(-1)} AS bucket, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, {pick(0)} AS lb, {pick(1)} AS ub FROM h)"
    order, share, first = ("bucket DESC", "total - CAST(sum(n) OVER (ORDER BY bucket DESC) AS BIGINT)", 1_000_000) if q >= 50 else ("bucket", "CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT)", 0)
    value = f"CASE WHEN b = {s} THEN {'lb' if q >= 50 else 'ub'} ELSE lb + (ub - lb) * " + (f"({s} - b) // (prev - b)" if q >= 50 else f"({s} - prev) // (b - prev)") + " END"
    return f"WITH {base}, c AS (SELECT *, 1000000 * ({share}) // total AS b FROM t), p AS (SELECT *, lag(b, 1, {first}) OVER (ORDER BY {order}) AS prev FROM c) SELECT CAST({value} AS BIGINT) AS quantile FROM (SELECT * FROM p WHERE b {'<=' if q >= 50 else '>='} {s} ORDER BY {order} LIMIT 1)"


for _name, _q in (("hist_quantile_explicit_low", 20), ("hist_quantile_explicit_mid", 50), ("hist_quantile_explicit_high", 60)):
    QUERIES[_name] = lambda s, d, q=_q: H.quantile_explicit(H.histogram(load_events(s, d), H.explicit_bucket("v", BUCKETS)), BUCKETS, q)
    ORACLES[_name] = _explicit_quantile_sql(_q)


# streams, read in several micro-batches
#: Rows of a micro-batch, at most about.
SLICE_ROWS = 2_000_000


def _shared(spark: SparkSession, name: str) -> str:
    """A new path on the folder that the cluster shares (a temporary one where the master is local)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return f"{base or 'file://' + tempfile.mkdtemp()}/{name}-{uuid.uuid4().hex}"


def _sliced(spark: SparkSession, sf_dir: str, slices: int = 4) -> DataFrame:
    """The events as a stream of several files in time order, at least so many, on the shared folder. They are parted by the stored timestamp, so only the rows of a slice are worked on."""
    path = _shared(spark, "events")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = e.agg(F.count("ts").alias("n"), F.percentile_approx(micros("ts"), [k / 1000 for k in range(1, 1000)], 10_000).alias("q")).first()
    slices = min(1000, max(slices, -(-found.n // SLICE_ROWS)))
    ends = [found.q[k * 1000 // slices - 1] for k in range(1, slices)] if found.q else []
    cols = ["event_id", "ts", micros("ts").alias("time"), "user_id", "event_type", F.col("value").cast("bigint").alias("v")]
    for lo, hi in zip([None, *ends], [*ends, None], strict=True):
        part = e if lo is None else e.where(f"ts > {timestamp_literal(lo)}")
        (part if hi is None else part.where(f"ts <= {timestamp_literal(hi)}")).select(*cols).repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.select(*cols).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _gathered(spark: SparkSession, out: DataFrame, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """What shape makes of each micro-batch's rows, in files on the shared folder. A window's rows come in one micro-batch, so shape may aggregate windows."""
    path = _shared(spark, "stream")
    shape(spark.createDataFrame([], out.schema)).write.parquet(f"{path}/none")

    def each(rows: DataFrame, n: int) -> None:
        shape(rows).write.mode("overwrite").parquet(f"{path}/{n}")

    out.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", _shared(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/*")


@query(ORACLES["slide_raw"])
def stream_slide_count(spark, sf_dir):
    e = _sliced(spark, sf_dir).select("time", "event_id")
    return _gathered(spark, windowed_stream(e, "count", 60, "time", "event_id", 20), lambda rows: rows.select("window_id", "event_id"))


@query(ORACLES["win_slide_time"])
def stream_slide_time(spark, sf_dir):
    e = _sliced(spark, sf_dir).select("time", "event_id", "event_type")
    return _gathered(spark, windowed_stream(e, "time", 24 * HOUR, "time", "event_id", 6 * HOUR), lambda rows: A.group(rows, ["event_type"], A.aggregate("count", "*")))


@query(ORACLES["latency_pairs"])
def stream_latency(spark, sf_dir):
    out = latency_stream(_sliced(spark, sf_dir).select("event_id", "time", "user_id", "event_type"), "event_type = 'signup'", "event_type = 'purchase'", "user_id", "time", "event_id")
    return _gathered(spark, out).select("user_id", "event_id", "start_time", "duration")


@query("SELECT s.user_id, s.event_id AS event_id_s, p.event_id AS event_id_p FROM events s JOIN events p ON s.user_id = p.user_id AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 6 HOURS WHERE s.event_type = 'signup' AND p.event_type = 'purchase'")
def stream_join(spark, sf_dir):
    e = _sliced(spark, sf_dir).withColumn("at", F.expr("CAST(CAST(ts AS STRING) AS TIMESTAMP)"))
    sides = (e.where(F.col("event_type") == x).select("user_id", "at", "event_id") for x in ("signup", "purchase"))
    return _gathered(spark, join_streams(*sides, ["user_id"], ("at", "at"), "6 HOURS", "1 day", ("s", "p"))).select("user_id", "event_id_s", "event_id_p")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored time windows over a streaming read of the events, counted per window."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").select("event_id", micros("ts").alias("time"))
    return _gathered(spark, windowed_stream(e, "time", 24 * HOUR, "time", "event_id"), lambda rows: A.group(rows, [], A.aggregate("count", "*")))


QUERIES["stream_time_windows"] = streamed
ORACLES["stream_time_windows"] = f"WITH RECURSIVE {_anchored(24 * HOUR)} SELECT window_id, window_start, count(*) AS count_ FROM w GROUP BY ALL"
