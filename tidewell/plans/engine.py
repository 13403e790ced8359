"""Engine: queries of the dialect on a catalog, as lazy DataFrames or as streaming queries.

Building a plan may run small jobs first: global windows need the number of rows and the first and last time, anchored
time windows their starts per chunk. Everything else is lazy.
"""

from __future__ import annotations

import logging
import re
import time as clock
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregates, joins, windows
from ..sources.catalog import Catalog, Event, timestamp_literal
from .dialect import DialectError, Item, QuerySpec, WindowSpec, parse

log = logging.getLogger(__name__)
_BOUND = re.compile(r"\(?\s*`?(\w+)`?\s*(>=|<=|==|=|>|<)\s*(-?\d+)\s*\)?$")
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Aggregates that windows can combine from panes: what is made per pane, and how it is put together.
_PANES = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}

#: Aggregates whose state is a few numbers. Beside a DISTINCT one, Spark makes the state of every other aggregate once per distinct value.
_SMALL = {"max", "min", "sum", "count", "avg", "mean", "first", "last", "any_value", "bool_and", "bool_or", "every", "some", "stddev", "stddev_pop", "stddev_samp", "var_pop", "var_samp", "variance"}
_CALL = re.compile(r"'(?:[^']|'')*'|`[^`]*`|(\w+)\s*\(")
_QUOTED = re.compile(r"'(?:[^']|'')*'|`[^`]*`|[()]")


def _conjuncts(text: str) -> list[str]:
    """The parts of a predicate that all have to hold."""
    from .dialect import _masked

    masked = re.sub(r"(?i)\bBETWEEN\b(.*?)\bAND\b", lambda m: " " * len(m[0]), _masked(text))
    if re.search(r"\bOR\b", masked, re.I):
        return []
    cuts = [(m.start(), m.end()) for m in re.finditer(r"\bAND\b", masked, re.I)]
    return [text[a:b].strip() for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(text)], strict=True)]


def predicate(text: str, schema: T.StructType) -> str:
    """The predicate with bare integer columns read as <> 0, wherever a condition stands."""
    numbers = {f.name.lower() for f in schema.fields if isinstance(f.dataType, _NUMBERS)}
    word = re.compile(r"'(?:[^']|'')*'|`[^`]*`|\w+|[()]|[^\s\w'`()]+")
    found = [(m.start(), m.end(), m[0]) for m in word.finditer(text)]
    out, at, between = [], 0, 0
    for i, (a, b, x) in enumerate(found):
        before, after = found[i - 1][2].upper() if i else "(", found[i + 1][2].upper() if i + 1 < len(found) else ")"
        starts = before in ("(", "AND", "OR", "NOT", "WHEN") and not (before == "AND" and between)
        if x.upper() == "BETWEEN":
            between += 1
        if before == "(" and i > 1 and re.fullmatch(r"\w+", found[i - 2][2]) and found[i - 2][2].upper() not in ("AND", "OR", "NOT", "WHEN"):
            starts = False  # the argument of a function
        if starts and after in (")", "AND", "OR", "THEN") and x.strip("`").lower() in numbers:
            out.append(text[at:a] + f"({x} <> 0)")
            at = b
        if before == "AND" and between:
            between -= 1
    return "".join(out) + text[at:]


class Engine:
    """unit: ticks of the time column in a millisecond."""

    def __init__(self, spark: SparkSession, catalog: Catalog, unit: int = 1000, emit_partial: bool = False):
        self.spark, self.catalog, self.unit, self.emit_partial = spark, catalog, unit, emit_partial
        #: One entry for each query: query, planning_s, and once it was read runs, run_s and rows.
        self.stats: list[dict] = []

    # functions, shared results, statistics

    def register(self, name: str, function: Callable, returns: str | T.DataType = "bigint") -> "Engine":
        """A user function for all later queries: a plain Python function, or one made by udf() or pandas_udf() (also for aggregates)."""
        self.spark.udf.register(name, function, *([] if hasattr(function, "evalType") else [returns]))
        return self

    def share(self, name: str, sql: str) -> "Engine":
        """The query's result as an event stream that later queries read; it is computed once and held (spilling to disk)."""
        df = self.execute(sql)[1].persist()
        time = next((c for c in ("time", "window_start", "window_id") if c in df.columns), df.columns[0])
        self.catalog.add(name, lambda spark: df, time)
        return self

    def execute(self, sql: "str | QuerySpec") -> tuple[T.StructType, DataFrame]:
        """Schema and DataFrame of a query, as text or as plans.builder makes it."""
        began = clock.perf_counter()
        df = self.plan(parse(sql) if isinstance(sql, str) else sql)
        self.stats.append({"query": sql, "planning_s": clock.perf_counter() - began, "runs": 0, "run_s": 0.0, "rows": 0})
        log.info("planned %s", sql)
        log.debug("%s", df.schema.simpleString())
        return df.schema, df

    def batches(self, sql: str, most: int | None = None) -> Iterator[tuple[int | None, list[Row]]]:
        """Rows window by window, read to the driver one partition at a time; at most most rows in a batch."""
        _, df = self.execute(sql)
        stat, began = self.stats[-1], clock.perf_counter()
        windowed = "window_id" in df.columns
        now, rows = None, []
        for row in (df.orderBy("window_id") if windowed else df).toLocalIterator():
            if rows and (windowed and row.window_id != now or len(rows) == most):
                yield now, rows
                rows = []
            now = row.window_id if windowed else None
            rows.append(row)
            stat["rows"] += 1
        stat["runs"], stat["run_s"] = stat["runs"] + 1, stat["run_s"] + clock.perf_counter() - began
        log.info("%d rows in %.3f s: %s", stat["rows"], stat["run_s"], sql)
        if rows or not windowed:
            yield now, rows

    # streams

    def stream(self, sql: str, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, trigger: dict | None = None):
        """Starts the query on a streaming source; each closed window comes once. Global windows hold state under one key.

        trigger: keywords of writeStream.trigger, such as {"processingTime": "1 second"}; by default all that is there is read and the query ends.
        """
        from ..streaming.stateful import windowed_stream

        spec = parse(sql)
        if spec.join or spec.more:
            raise DialectError("a stream can't JOIN or take part in UNION; streaming.joins has joins of streams")
        if spec.window and (spec.window.kind == "session" or spec.window.step > spec.window.size):
            raise DialectError("a stream's WINDOW is of time or count, with a step of at most its size")
        if spec.order_by or spec.limit is not None:
            raise DialectError("a stream can't ORDER BY or LIMIT")
        if not spec.window and (spec.group_by or spec.distinct or any(i.agg for i in spec.items)):
            raise DialectError("a stream needs a WINDOW for aggregates, GROUP BY and DISTINCT")
        event = self.catalog.get(spec.source)
        df = event.load(self.spark)
        df = df.where(predicate(spec.where, df.schema)) if spec.where else df
        if not spec.window and any(self._is_aggregate(i.text, df.schema) for i in spec.items):
            raise DialectError("a stream needs a WINDOW for aggregates, GROUP BY and DISTINCT")
        if spec.window:
            unit = self.unit if spec.window.kind == "time" else 1
            df = windowed_stream(df, spec.window.kind, spec.window.size * unit, event.time, event.tie, spec.window.step * unit)

        def each(batch: DataFrame, n: int) -> None:
            log.debug("batch %d", n)
            sink(self._project(spec, batch), n)

        writer = df.writeStream.foreachBatch(each).outputMode("append").trigger(**(trigger or {"availableNow": True}))
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()

    @staticmethod
    def stream_stats(query) -> list[dict]:
        """Run time and rows of each micro-batch of a streaming query."""
        return [{"batch": p["batchId"], "rows": p["numInputRows"], "run_ms": p["durationMs"].get("triggerExecution", 0), "state_rows": sum(s["numRowsTotal"] for s in p["stateOperators"])} for p in query.recentProgress]

    # plans

    def plan(self, spec: QuerySpec) -> DataFrame:
        df = self._plan_one(spec)
        for kind, other in spec.more:
            right = self._plan_one(other)
            if len(right.columns) != len(df.columns):
                raise DialectError(f"{kind} needs equal numbers of columns")
            right = right.toDF(*df.columns)
            df = {"union all": df.unionAll, "union": lambda r, d=df: d.unionAll(r).distinct(), "intersect": df.intersect, "intersect all": df.intersectAll, "except": df.subtract, "except all": df.exceptAll}[kind](right)
        return self._ordered(spec, df)

    def _load(self, spec: QuerySpec, event: Event) -> DataFrame:
        """The stream's rows; bounds on its time reach the files as bounds on the stored timestamp."""
        if spec.where and event.stamp and self.unit == 1000:
            bounds = [m for c in _conjuncts(spec.where) if (m := _BOUND.match(c)) and m[1] == event.time]
            if bounds:
                where = " AND ".join(f"{event.stamp} {'=' if m[2] == '==' else m[2]} {timestamp_literal(int(m[3]))}" for m in bounds)
                return event.load_where(self.spark, where)
        return event.load(self.spark)

    def _plan_one(self, spec: QuerySpec) -> DataFrame:
        event = self.catalog.get(spec.source)
        df = self._load(spec, event)
        if spec.where:
            df = df.alias(spec.name).where(predicate(spec.where, df.schema))
        if not spec.join and (sliding := self._by_panes(spec, df, event)) is not None:
            return sliding
        if spec.window:
            df = self._window(df, spec, event)
        if spec.join:
            right = self.plan(spec.join)
            df = joins.windowed_join(df, right, spec.using, (spec.name, spec.join.name), spec.how, spec.on)
        return self._project(spec, df)

    def _window(self, df: DataFrame, spec: QuerySpec, event: Event) -> DataFrame:
        w = spec.window
        if w.kind == "session":
            return windows.session_windows(df, w.size * self.unit, event.time, *spec.group_by).withColumnRenamed("session_start", "window_start")
        if w.kind == "count":
            if w.step != w.size:
                return windows.sliding_count(df, w.size, w.step, event.time, event.tie)
            return windows.count_windows(df, w.size, event.time, event.tie, emit_partial=self.emit_partial)
        size, step = w.size * self.unit, w.step * self.unit
        if step != size:
            return windows.sliding_time(df, size, step, event.time)
        return windows.time_windows(df, size, event.time, emit_partial=self.emit_partial)

    def _by_panes(self, spec: QuerySpec, df: DataFrame, event: Event) -> DataFrame | None:
        """A sliding window with aggregates that can be combined: per pane, then per window. None where that isn't so."""
        w, aggs = spec.window, [i for i in spec.items if i.agg]
        if not w or w.kind == "session" or w.step >= w.size or not aggs or spec.sets or spec.distinct or spec.having:
            return None
        if any(i.distinct or i.agg not in _PANES for i in aggs) or any(not i.agg and (i.text not in spec.group_by or i.alias) for i in spec.items):
            return None
        unit = self.unit if w.kind == "time" else 1
        rows, to_windows = windows.panes(df, w.kind, w.size * unit, w.step * unit, event.time, event.tie)
        made = [aggregates.aggregate(i.agg, i.text).alias(f"__{k}") for k, i in enumerate(aggs)]
        table = to_windows(rows.groupBy("pane", *spec.group_by).agg(*made))
        own = [c for c in ("window_id", "window_start") if c in table.columns]
        names = [i.alias or ("count_" if i.text == "*" else f"{i.agg}_{i.text}") for i in aggs]
        return table.groupBy(*own, *spec.group_by).agg(*(_PANES[i.agg](f"__{k}").alias(n) for k, (i, n) in enumerate(zip(aggs, names, strict=True))))

    def _is_aggregate(self, text: str, schema: T.StructType) -> bool:
        """Whether an expression holds an aggregate function: Spark's analyzer says so."""
        if "(" not in text:
            return False
        try:
            plan = self.spark.createDataFrame([], schema).select(F.expr(text))._jdf.queryExecution().analyzed()
            return plan.nodeName() == "Aggregate"
        except AnalysisException as e:
            if e.getCondition() in ("MISSING_GROUP_BY", "MISSING_AGGREGATION"):
                return True
            raise

    def _calls(self, text: str, schema: T.StructType) -> list[tuple[int, int]]:
        """Where the aggregate calls of an expression begin and end."""
        out, at = [], 0
        while m := _CALL.search(text, at):
            at = m.end()
            if not m[1]:
                continue
            depth = 1
            for x in _QUOTED.finditer(text, m.end()):
                depth += {"(": 1, ")": -1}.get(x[0], 0)
                if not depth:
                    break
            inner = [(m.end() + a, m.end() + b) for a, b in self._calls(text[m.end() : x.start()], schema)]
            try:
                own = not inner and self._is_aggregate(text[m.start() : x.end()], schema)
            except AnalysisException:
                own = False  # a keyword before a parenthesis, or the argument of a higher-order function
            out += [(m.start(), x.end())] if own else inner
            at = x.end()
        return out

    def _apart(self, df: DataFrame, keys: list[str], made: list[tuple[str, str]]) -> DataFrame | None:
        """The aggregates of (name, text), with the DISTINCT ones in a table of their own that meets the others by key. None where one table does as well."""
        text = " ".join(t for _, t in made)
        if not re.search(r"\(\s*DISTINCT\b", text, re.I) or re.search(r"\)\s*(FILTER|OVER|WITHIN)\b", text, re.I):
            return None
        sides: dict[bool, list[tuple[str, str]]] = {False: [], True: []}
        out = []
        for name, text in made:
            for a, b in reversed(self._calls(text, df.schema)):
                side = sides[bool(re.match(r"\w+\s*\(\s*DISTINCT\b", text[a:b], re.I))]
                side.append((f"__{len(sides[False]) + len(sides[True])}", text[a:b]))
                text = f"{text[:a]}`{side[-1][0]}`{text[b:]}"
            out.append((name, text))
        if not sides[True] or all(re.match(r"\w+", t)[0].lower() in _SMALL for _, t in sides[False]):
            return None
        plain, apart = (df.groupBy(*keys).agg(*(F.expr(t).alias(n) for n, t in sides[k])) for k in (False, True))
        apart = apart.select(*(F.col(k).alias(f"__key{j}") for j, k in enumerate(keys)), *(n for n, _ in sides[True]))
        test = F.lit(True)
        for j, k in enumerate(keys):
            test = test & F.col(k).eqNullSafe(F.col(f"__key{j}"))
        both = plain.join(apart, test) if keys else plain.crossJoin(apart)
        return both.select(*keys, *(F.expr(t).alias(n) for n, t in out))

    def _column(self, item: Item, df: DataFrame, spec: QuerySpec) -> list[Column]:
        star = re.fullmatch(r"(?:(\w+)\.)?\*", item.text)
        if star and star[1] and star[1] not in (spec.name, spec.source, spec.join.name if spec.join else None):
            raise DialectError(f"no stream {star[1]!r} in the query")
        if star and star[1] and spec.join:
            return [F.col(c) for c in df.columns if c.endswith(f"_{star[1]}") or c in spec.using]
        if star:
            return [F.col(c) for c in df.columns if c not in ("window_id", "window_start")]
        c = F.expr(re.sub(rf"\b{re.escape(spec.name)}\.(\w+)", r"\1", item.text) if not spec.join else item.text)
        return [c.alias(item.alias) if item.alias else c]

    def _project(self, spec: QuerySpec, df: DataFrame) -> DataFrame:
        own = [c for c in ("window_id", "window_start") if c in df.columns]
        schema = df.schema
        general = [not i.agg and i.text not in spec.group_by and not re.match(r"grouping(_id)?\s*\(", i.text, re.I) and self._is_aggregate(i.text, schema) for i in spec.items]
        if any(i.agg for i in spec.items) or any(general) or spec.group_by or spec.sets:
            df = self._grouped(spec, df, own, general)
        elif not (len(spec.items) == 1 and spec.items[0].text == "*"):
            named = [i.text for i in spec.items]
            df = df.select(*(c for c in own if c not in named), *(c for i in spec.items for c in self._column(i, df, spec)))
        return df.distinct() if spec.distinct else df

    def _grouped(self, spec: QuerySpec, df: DataFrame, own: list[str], general: list[bool]) -> DataFrame:
        cols, keys, made = [], own + [c for c in spec.group_by if c not in own], []
        for i, holds in zip(spec.items, general, strict=True):
            if i.agg:
                c = aggregates.aggregate(i.agg, i.text, i.distinct)
                cols.append(c.alias(i.alias) if i.alias else c)
                plain = f"{i.agg}({'DISTINCT ' * i.distinct}{i.text})" if i.agg in _PANES else f"CAST(sum({'DISTINCT ' * i.distinct}{i.text}) AS BIGINT) div count({'DISTINCT ' * i.distinct}{i.text})" if i.agg == "avg" else None
                made.append((i.alias or ("count_" if i.text == "*" else f"{i.agg}_{i.text}"), plain))
            elif holds or i.text not in spec.group_by:
                if not holds and not spec.sets:
                    raise DialectError(f"{i.text!r} is neither an aggregate nor in GROUP BY")
                cols.append(F.expr(i.text).alias(i.alias or i.text))
                made.append((i.alias or i.text, i.text))
        having, hidden = None, "__having"
        if spec.having:
            try:
                having = F.expr(spec.having) if not self._is_aggregate(spec.having, df.schema) else None
            except AnalysisException:
                having = F.expr(spec.having)  # it names the results
            if having is None:
                cols, having = [*cols, F.expr(spec.having).alias(hidden)], F.col(hidden)
                made.append((hidden, spec.having))
        if spec.sets:
            if not cols:
                raise DialectError("GROUPING SETS, CUBE and ROLLUP need aggregates")
            out = df.groupingSets([[F.col(c) for c in own + s] for s in spec.sets], *keys).agg(*cols)
        elif made and all(t for _, t in made) and (out := self._apart(df, keys, made)) is not None:
            pass
        elif keys:
            out = aggregates.group(df, spec.group_by, *cols)
        else:
            out = df.agg(*cols)
        out = out.where(having) if having is not None else out
        renamed = {i.text: i.alias for i in spec.items if i.alias and not i.agg and i.text in spec.group_by}
        return out.drop(hidden).withColumnsRenamed(renamed)

    def _ordered(self, spec: QuerySpec, df: DataFrame) -> DataFrame:
        if spec.order_by:
            df = df.orderBy(*(F.expr(o.rsplit(None, 1)[0]).desc() if o.lower().endswith(" desc") else F.expr(o.rsplit(None, 1)[0] if o.lower().endswith(" asc") else o) for o in spec.order_by))
        return df.limit(spec.limit) if spec.limit is not None else df


__all__ = ["Engine", "WindowSpec", "predicate"]
