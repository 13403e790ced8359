"""The SQL dialect: SELECTs over event streams, with WINDOW(time|count, size, step) or WINDOW(session, gap).

  SELECT [DISTINCT] items FROM name [[AS] alias] [[LEFT|RIGHT|FULL|SEMI|ANTI] JOIN (SELECT ...) [AS alias] USING (cols) | ON p]
  [WHERE p] [GROUP BY cols | ROLLUP (cols) | CUBE (cols) | GROUPING SETS ((cols), ...)] [HAVING p]
  [WINDOW(...)] [UNION|INTERSECT|EXCEPT [ALL] SELECT ...] [ORDER BY cols] [LIMIT n]

Clauses after FROM come in any order; ORDER BY and LIMIT of the last SELECT hold for the whole. Names may hold slashes; =
and == are equal. Predicates, items and aggregates are Spark's own expressions; a bare integer column in a predicate is
true where it isn't 0. Sizes of time windows are in milliseconds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_CLAUSES = re.compile(r"\b(SELECT|FROM|((?:LEFT|RIGHT|FULL|INNER)(?:\s+(?:OUTER|SEMI|ANTI))?\s+)?JOIN|USING|ON|WHERE|GROUP\s+BY|HAVING|WINDOW|ORDER\s+BY|LIMIT)\b", re.I)
_SETS = re.compile(r"\b(UNION|INTERSECT|EXCEPT)(\s+ALL)?\b", re.I)
_AGG = re.compile(r"(max|min|sum|count|avg)\s*\(\s*(distinct\s+)?([\w.]+|\*)\s*\)$", re.I)
_ALIAS = re.compile(r"(.*\S)\s+AS\s+(\w+)$", re.I | re.S)
_SOURCE = re.compile(r"`?([\w/.\-]+)`?(?:\s+(?:AS\s+)?(\w+))?$", re.I)
_JOINS = {"": "inner", "INNER": "inner", "LEFT": "left", "LEFT OUTER": "left", "RIGHT": "right", "RIGHT OUTER": "right", "FULL": "full", "FULL OUTER": "full", "LEFT SEMI": "left_semi", "LEFT ANTI": "left_anti"}


class DialectError(ValueError):
    """The text isn't a query of this dialect."""


@dataclass(frozen=True)
class WindowSpec:
    kind: str
    size: int
    step: int


@dataclass(frozen=True)
class Item:
    text: str
    alias: str | None = None
    agg: str | None = None
    distinct: bool = False


@dataclass
class QuerySpec:
    source: str
    items: list[Item]
    distinct: bool = False
    where: str | None = None
    group_by: list[str] = field(default_factory=list)
    having: str | None = None
    window: WindowSpec | None = None
    join: "QuerySpec | None" = None
    using: list[str] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    limit: int | None = None
    alias: str | None = None
    how: str = "inner"
    on: str | None = None
    #: Sets of grouping columns (CUBE, ROLLUP, GROUPING SETS), else empty.
    sets: list[list[str]] = field(default_factory=list)
    #: ("union all" and the like, query) pairs that follow.
    more: list[tuple[str, "QuerySpec"]] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.alias or self.source.split("/")[-1]


def _masked(sql: str) -> str:
    """The text with everything in quotes or parentheses blanked, at equal length."""
    out, depth, quote = [], 0, ""
    for c in sql:
        if quote:
            quote = "" if c == quote else quote
            out.append(" ")
        elif c in "'\"`":
            quote = c
            out.append(" ")
        else:
            depth -= c == ")"
            out.append(c if depth == 0 and c not in "()" else " ")
            depth += c == "("
        if depth < 0:
            raise DialectError("unbalanced parentheses")
    if depth or quote:
        raise DialectError("unbalanced parentheses or quotes")
    return "".join(out)


def _split(text: str) -> list[str]:
    cuts = [m.start() for m in re.finditer(",", _masked(text))]
    return [text[a + 1 : b].strip() for a, b in zip([-1, *cuts], [*cuts, len(text)], strict=True)]


def _inner(text: str) -> str:
    text = text.strip()
    if not (text.startswith("(") and text.endswith(")")):
        raise DialectError(f"expected parentheses, not {text!r}")
    return text[1:-1].strip()


def _grouping(text: str) -> tuple[list[str], list[list[str]]]:
    """(all grouping columns, sets of them where there are several)."""
    m = re.match(r"(CUBE|ROLLUP|GROUPING\s+SETS)\s*(\(.*\))$", text.strip(), re.I | re.S)
    if not m:
        return _split(text), []
    kind, parts = m[1].upper(), _split(_inner(m[2]))
    if kind == "ROLLUP":
        sets = [parts[:n] for n in range(len(parts), -1, -1)]
    elif kind == "CUBE":
        sets = [[c for k, c in enumerate(parts) if mask >> k & 1] for mask in range(1 << len(parts))]
    else:
        sets = [[c for c in _split(_inner(p)) if c] if p.startswith("(") else [p] for p in parts]
    return list(dict.fromkeys(c for s in sets for c in s)), sets


def _window(text: str) -> WindowSpec:
    kind, *sizes = _split(_inner(text))
    kind = kind.lower()
    if not all(x.isdigit() and int(x) for x in sizes) or len(sizes) != {"time": 2, "count": 2, "session": 1}.get(kind):
        raise DialectError("WINDOW takes (time|count, size, step) or (session, gap)")
    return WindowSpec(kind, int(sizes[0]), int(sizes[-1]))


def _joined(text: str) -> tuple["QuerySpec", str | None]:
    """The query in parentheses of a JOIN, and its alias."""
    end = next((i for i in range(len(text), 0, -1) if text[i - 1] == ")"), 0)
    rest = re.fullmatch(r"\s*(?:(?:AS\s+)?(\w+))?\s*", text[end:], re.I)
    if not rest:
        raise DialectError("JOIN takes (SELECT ...) and a name")
    return parse(_inner(text[:end])), rest[1]


def parse(sql: str) -> QuerySpec:
    sql = sql.strip().rstrip(";").strip()
    cuts = list(_SETS.finditer(_masked(sql)))
    if cuts:
        ends = [*(m.start() for m in cuts), len(sql)]
        spec = _select(sql[: ends[0]])
        spec.more = [(re.sub(r"\s+", " ", m[0].lower()), _select(sql[m.end() : e])) for m, e in zip(cuts, ends[1:], strict=True)]
        if any(s.order_by or s.limit is not None for s in (spec, *(q for _, q in spec.more[:-1]))):
            raise DialectError("ORDER BY and LIMIT belong to the last SELECT")
        last = spec.more[-1][1]
        spec.order_by, spec.limit, last.order_by, last.limit = last.order_by, last.limit, [], None
        return spec
    return _select(sql)


def _select(sql: str) -> QuerySpec:
    sql = sql.strip()
    marks = list(_CLAUSES.finditer(_masked(sql)))
    if not marks or marks[0].start() or marks[0][1].upper() != "SELECT":
        raise DialectError("only SELECT is supported")
    parts: dict[str, str] = {}
    how = ""
    for m, nxt in zip(marks, [*marks[1:], None], strict=True):
        name = re.sub(r"\s+", " ", m[1].upper())
        if name.endswith("JOIN"):
            name, how = "JOIN", name.removesuffix("JOIN").strip()
        if name in parts:
            raise DialectError(f"{name} appears twice")
        parts[name] = sql[m.end() : nxt.start() if nxt else len(sql)].strip()
    source = _SOURCE.match(parts.get("FROM", ""))
    if not source or (source[2] or "").upper() in ("CROSS", "NATURAL", "SEMI", "ANTI"):
        raise DialectError("exactly one event stream is needed after FROM")
    select = parts["SELECT"]
    distinct = bool(re.match(r"distinct\b", select, re.I))
    select = re.sub(r"^distinct\b", "", select, flags=re.I).strip() if distinct else select
    items = []
    for text in _split(select):
        if not text:
            raise DialectError("empty item in SELECT")
        m = _ALIAS.match(text)
        body, alias = (m[1].strip(), m[2]) if m else (text, None)
        a = _AGG.match(body)
        items.append(Item(a[3], alias, a[1].lower(), bool(a[2])) if a else Item(body, alias))
    group_by, sets = _grouping(parts["GROUP BY"]) if "GROUP BY" in parts else ([], [])
    spec = QuerySpec(source[1], items, distinct, parts.get("WHERE"), group_by, parts.get("HAVING"), alias=source[2], sets=sets)
    if "WINDOW" in parts:
        spec.window = _window(parts["WINDOW"])
        if spec.window.kind == "session" and not group_by:
            raise DialectError("a session belongs to the columns of GROUP BY")
    if "JOIN" in parts:
        if how not in _JOINS or ("USING" in parts) == ("ON" in parts):
            raise DialectError("JOIN needs USING (columns) or ON, and a known kind")
        spec.join, other = _joined(parts["JOIN"])
        spec.how, spec.on = _JOINS[how], parts.get("ON")
        spec.using = _split(_inner(parts["USING"])) if "USING" in parts else []
        spec.join.alias = other or spec.join.alias
        if spec.join.name == spec.name:
            spec.join.alias = spec.name + "_2"
    elif "ON" in parts or "USING" in parts:
        raise DialectError("ON and USING belong to a JOIN")
    if "ORDER BY" in parts:
        spec.order_by = _split(parts["ORDER BY"])
    if "LIMIT" in parts:
        if not parts["LIMIT"].isdigit():
            raise DialectError("LIMIT takes a number")
        spec.limit = int(parts["LIMIT"])
    if any(i.agg for i in items) and not sets and any(not i.agg and re.fullmatch(r"\w+|\*", i.text) and i.text not in group_by for i in items):
        raise DialectError("columns beside aggregates have to be in GROUP BY")
    return spec
