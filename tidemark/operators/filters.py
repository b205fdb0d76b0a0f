"""The attribute filter language: text or mapping to a tree, the tree to a Column or to other stores' filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators by name, as written, and as other stores name them.
SYMBOLS = {"eq": "=", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
LISTS = ("in", "nin")
KEYWORDS = frozenset("AND OR NOT IN IS NULL TRUE FALSE".split())

#: Columns of every chunk that a filter may name.
BUILT_IN = ("chunk_id", "origin", "start_index", "end_index", "char_count", "context")


@dataclass(frozen=True)
class Test:
    path: str
    op: str
    value: Any


@dataclass(frozen=True)
class Group:
    op: str
    parts: tuple


_LEX = re.compile(
    r"\s*(?:(?P<text>'(?:[^']|'')*')|(?P<number>-?\d+(?:\.\d+)?(?![\w.]))|(?P<word>[A-Za-z_]\w*)|(?P<sign>!=|>=|<=|[=<>(),.]))"
)


def _lex(source: str) -> list[tuple[str, Any]]:
    out, at, end = [], 0, len(source.rstrip())
    while at < end:
        m = _LEX.match(source, at)
        if not m:
            raise ValueError(f"Unexpected character {source[at:].lstrip()[0]!r} in attributes filter")
        at, kind, raw = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "text":
            out.append(("literal", raw[1:-1].replace("''", "'")))
        elif kind == "number":
            out.append(("literal", float(raw) if "." in raw else int(raw)))
        elif kind == "word" and raw.upper() in KEYWORDS:
            word = raw.upper()
            out.append(("literal", word == "TRUE") if word in ("TRUE", "FALSE") else (word, None))
        else:
            out.append((raw, None) if kind == "sign" else ("name", raw))
    return [*out, ("end", None)]


class _Reader:
    """expr := all (OR all)*; all := one (AND one)*; one := '(' expr ')' | path test."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def take(self, *kinds: str) -> tuple[str, Any] | None:
        token = self.tokens[self.at]
        if token[0] not in kinds:
            return None
        self.at += 1
        return token

    def need(self, *kinds: str) -> tuple[str, Any]:
        if (token := self.take(*kinds)) is None:
            raise ValueError(f"Expected {' or '.join(kinds)}, got {self.tokens[self.at]}")
        return token

    def chain(self, word: str, below: Callable) -> Test | Group:
        parts = [below()]
        while self.take(word):
            parts.append(below())
        return parts[0] if len(parts) == 1 else Group(word.lower(), tuple(parts))

    def expr(self) -> Test | Group:
        return self.chain("OR", lambda: self.chain("AND", self.one))

    def one(self) -> Test | Group:
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        path = self.need("name")[1]
        while self.take("."):
            path += "." + self.need("name")[1]
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return Test(path, "ne" if negated else "eq", None)
        if self.take("NOT"):
            self.need("IN")
            return Test(path, "nin", self.values())
        if self.take("IN"):
            return Test(path, "in", self.values())
        sign = self.need(*SYMBOLS.values())[0]
        if self.take("NULL"):
            raise ValueError("Use IS NULL or IS NOT NULL for NULL comparisons")
        return Test(path, next(k for k, v in SYMBOLS.items() if v == sign), self.need("literal")[1])

    def values(self) -> tuple:
        self.need("(")
        out = [self.need("literal")[1]]
        while self.take(","):
            out.append(self.need("literal")[1])
        self.need(")")
        return tuple(out)


def _scalar(value: Any) -> Any:
    if value is not None and not isinstance(value, (str, int, float, bool)):
        raise ValueError(f"Unsupported filter value type: {type(value).__name__}")
    return value


def _from_mapping(node: Mapping) -> Test | Group:
    op = str(node.get("type", "")).lower()
    if op in ("and", "or"):
        inner = node.get("filters")
        if not isinstance(inner, (list, tuple)) or not inner:
            raise ValueError("a logical filter needs a non-empty list of filters")
        if not all(isinstance(x, Mapping) for x in inner):
            raise TypeError("filters are mappings")
        return Group(op, tuple(map(_from_mapping, inner)))
    if op not in SYMBOLS and op not in LISTS:
        raise ValueError(f"Unknown filter operator: {op!r}")
    if not isinstance(node.get("key"), str) or "value" not in node:
        raise ValueError("a comparison needs a key and a value")
    value = node["value"]
    if op in LISTS:
        if not isinstance(value, (list, tuple)) or not value or any(v is None for v in value):
            raise ValueError("IN needs a non-empty list without NULL")
        return Test(node["key"], op, tuple(map(_scalar, value)))
    if _scalar(value) is None and op not in ("eq", "ne"):
        raise ValueError("NULL can only be compared by eq and ne")
    return Test(node["key"], op, value)


def parse(source: str | Mapping | None, allowed: Collection[str] | None = None) -> Test | Group | None:
    """The tree of a filter; None for no filter. ``allowed`` names the columns and struct paths that may occur."""
    if source is None or (isinstance(source, str) and not source.strip()):
        return None
    if isinstance(source, str):
        reader = _Reader(source)
        tree = reader.expr()
        reader.need("end")
    elif isinstance(source, Mapping):
        tree = _from_mapping(source)
    else:
        raise TypeError("an attributes filter is a string or a mapping")
    if allowed is not None:
        for test in _tests(tree):
            if test.path not in allowed:
                raise ValueError(f"Unknown attribute column {test.path!r}; known: {', '.join(sorted(allowed))}")
    return tree


def _tests(tree: Test | Group):
    if isinstance(tree, Test):
        yield tree
    else:
        for part in tree.parts:
            yield from _tests(part)


def to_column(tree: Test | Group | None, column: Callable[[str], Column] = F.col) -> Column | None:
    """The filter as a Column, pushed down by Catalyst like any other. Nulls drop out of != and NOT IN, as in SQL."""
    if tree is None:
        return None
    if isinstance(tree, Group):
        parts = [to_column(p, column) for p in tree.parts]
        return reduce(lambda a, b: a & b if tree.op == "and" else a | b, parts)
    c, v = column(tree.path), tree.value
    if tree.op in LISTS:
        return c.isin(*v) if tree.op == "in" else ~c.isin(*v)
    if v is None:
        return c.isNull() if tree.op == "eq" else c.isNotNull()
    compare = {"eq": c.__eq__, "ne": c.__ne__, "gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}
    return compare[tree.op](F.lit(v))


def _literal(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).upper()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def sql_path(path: str, json: bool = False) -> str:
    """A quoted column; its fields by struct_extract, or by ->> where structs are JSON."""
    first, *fields = path.split(".")
    out = '"' + first.replace('"', '""') + '"'
    for f in fields:
        out = f"{out}->>{_literal(f)}" if json else f"struct_extract({out}, {_literal(f)})"
    return out


def to_sql(tree: Test | Group, path: Callable[[str], str] = sql_path) -> str:
    if isinstance(tree, Group):
        return "(" + f" {tree.op.upper()} ".join(to_sql(p, path) for p in tree.parts) + ")"
    c, v = path(tree.path), tree.value
    if tree.op in LISTS:
        return f"{c} {'IN' if tree.op == 'in' else 'NOT IN'} ({', '.join(map(_literal, v))})"
    if v is None:
        return f"{c} IS NULL" if tree.op == "eq" else f"{c} IS NOT NULL"
    return f"{c} {SYMBOLS[tree.op]} {_literal(v)}"


def to_where(tree: Test | Group) -> dict:
    """As nested mappings with $and, $or, $eq and so on; NULL has none."""
    if isinstance(tree, Group):
        return {f"${tree.op}": [to_where(p) for p in tree.parts]}
    if tree.value is None:
        raise ValueError("NULL is not supported in where filters")
    return {tree.path: {f"${tree.op}": list(tree.value) if tree.op in LISTS else tree.value}}


def to_typed(tree: Test | Group) -> dict:
    """As nested mappings with type, key and value; NULL has none, lists hold no booleans, integers stay exact."""
    if isinstance(tree, Group):
        return {"type": tree.op, "filters": [to_typed(p) for p in tree.parts]}
    if tree.value is None:
        raise ValueError("NULL is not supported in typed filters")
    if tree.op in LISTS and any(isinstance(v, bool) for v in tree.value):
        raise TypeError("booleans are not supported in IN lists of typed filters")
    return {"type": tree.op, "key": tree.path, "value": list(tree.value) if tree.op in LISTS else tree.value}
