"""Queries put together call by call instead of as text; every call gives a new query.

  Query("events").filter("v > 5").window("count", 500).group_by("user_id").count().max("v").build(engine)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, Row

from .dialect import DialectError, Item, QuerySpec, WindowSpec


class Query:
    def __init__(self, source: str, alias: str | None = None, spec: QuerySpec | None = None):
        self.spec = spec or QuerySpec(source, [], alias=alias)

    def _with(self, **changes) -> "Query":
        return Query("", spec=replace(self.spec, **changes))

    def _item(self, *items: Item) -> "Query":
        return self._with(items=[*self.spec.items, *items])

    def project(self, *columns: str) -> "Query":
        return self._item(*(Item(c) for c in columns))

    def map(self, name: str, expression: str) -> "Query":
        """A new column; under the name of an old one it takes its place."""
        return self._item(Item(expression, name))

    def filter(self, predicate: str) -> "Query":
        return self._with(where=f"({self.spec.where}) AND ({predicate})" if self.spec.where else predicate)

    def window(self, kind: str, size: int, step: int | None = None) -> "Query":
        if kind not in ("time", "count", "session"):
            raise DialectError(f"no window {kind!r}")
        return self._with(window=WindowSpec(kind, size, step or size))

    def group_by(self, *columns: str) -> "Query":
        return self._with(group_by=[*self.spec.group_by, *columns])._item(*(Item(c) for c in columns))

    def aggregate(self, expression: str, name: str) -> "Query":
        """Any aggregate expression of Spark or of a registered function."""
        return self._item(Item(expression, name))

    def count(self, column: str = "*", distinct: bool = False) -> "Query":
        return self._item(Item(column, None, "count", distinct))

    def max(self, column: str) -> "Query":
        return self._item(Item(column, None, "max"))

    def min(self, column: str) -> "Query":
        return self._item(Item(column, None, "min"))

    def sum(self, column: str) -> "Query":
        return self._item(Item(column, None, "sum"))

    def avg(self, column: str) -> "Query":
        return self._item(Item(column, None, "avg"))

    def having(self, predicate: str) -> "Query":
        return self._with(having=predicate)

    def distinct(self) -> "Query":
        return self._with(distinct=True)

    def join(self, other: "Query", using: list[str] | None = None, on: str | None = None, how: str = "inner") -> "Query":
        right = other.spec if other.spec.name != self.spec.name else replace(other.spec, alias=other.spec.name + "_2")
        return self._with(join=right, using=using or [], on=on, how=how)

    def union(self, other: "Query", kind: str = "union all") -> "Query":
        return self._with(more=[*self.spec.more, (kind, other.spec)])

    def order_by(self, *columns: str) -> "Query":
        return self._with(order_by=list(columns))

    def limit(self, n: int) -> "Query":
        return self._with(limit=n)

    def build(self, engine) -> DataFrame:
        return engine.execute(self.spec)[1]

    def batches(self, engine, size: int) -> Iterator[tuple[int | None, list[Row]]]:
        return engine.batches(self.spec, size)
