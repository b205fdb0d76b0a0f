"""Typed attributes that a store's user declares, and the columns they become."""

from __future__ import annotations

import re
import types
import typing
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Annotated, Any, get_args, get_origin, get_type_hints

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.filters import BUILT_IN, KEYWORDS

#: Scalar types by name, and their columns.
SCALARS = {"str": T.StringType(), "int": T.IntegerType(), "float": T.DoubleType(), "bool": T.BooleanType()}
_PYTHON = {str: "str", int: "int", float: "float", bool: "bool"}

#: Names that attributes can't have.
RESERVED = {*BUILT_IN, "text", "embedding", "metric_name", "metric_value", "chunk_ids", "metrics", "arrival", "content", "chunks"}

MISSING = object()


@dataclass(frozen=True)
class Vector:
    size: int


@dataclass(frozen=True)
class Struct:
    fields: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class Attribute:
    """``kind``: a scalar's name, a Vector or a Struct."""

    kind: Any
    nullable: bool = False
    default: Any = MISSING

    @property
    def required(self) -> bool:
        return self.default is MISSING and not self.nullable


def _kind(declared: Any, inside: bool = False) -> tuple[Any, bool]:
    """(kind, nullable) of a declared type."""
    if get_origin(declared) in (typing.Union, types.UnionType):
        rest = [a for a in get_args(declared) if a is not type(None)]
        if len(rest) != 1 or len(rest) == len(get_args(declared)):
            raise TypeError(f"unions other than with None aren't attribute types: {declared}")
        if inside:
            raise TypeError("fields of a struct can't be optional")
        return _kind(rest[0])[0], True
    if isinstance(declared, type) and declared in _PYTHON:
        return _PYTHON[declared], False
    if get_origin(declared) is Annotated:
        base, size, *_ = get_args(declared)
        if get_origin(base) is not list or get_args(base) != (float,) or not isinstance(size, int) or isinstance(size, bool) or size < 1:
            raise TypeError("vectors are Annotated[list[float], size]")
        return Vector(size), False
    if isinstance(declared, Mapping):
        if not declared:
            raise TypeError("a struct needs fields")
        for name in declared:
            _check_name(name)
        return Struct(tuple((n, _kind(d, True)[0]) for n, d in declared.items())), False
    if isinstance(declared, type) and getattr(declared, "__annotations__", None):
        return _kind(get_type_hints(declared, include_extras=True))
    raise TypeError(f"not an attribute type: {declared!r}")


def _check_name(name: str) -> None:
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_]\w*", name, re.A) or name.upper() in KEYWORDS:
        raise ValueError(f"not an attribute name: {name!r}")


def declare(declared: Mapping | type | None, reserved: set[str] = RESERVED) -> dict[str, Attribute]:
    """A mapping of names to types or (type, default), or a class with annotations and defaults, as attributes."""
    if declared is None:
        return {}
    if isinstance(declared, Mapping):
        items = {n: (d if isinstance(d, tuple) else (d,)) for n, d in declared.items()}
    elif isinstance(declared, type):
        items = {n: (d, vars(declared)[n]) if n in vars(declared) else (d,) for n, d in get_type_hints(declared, include_extras=True).items()}
    else:
        raise TypeError("attributes are declared by a mapping or a class")
    out = {}
    for name, item in items.items():
        _check_name(name)
        if name.lower() in reserved:
            raise ValueError(f"{name!r} is reserved")
        if len(item) > 2:
            raise ValueError(f"{name}: a type, or a type and a default")
        kind, nullable = _kind(item[0])
        a = Attribute(kind, nullable, item[1] if len(item) > 1 else MISSING)
        if a.default is not MISSING:
            check_value(name, a, a.default)
        elif nullable:
            a = Attribute(kind, True, None)
        out[name] = a
    return out


def check_value(name: str, attribute: Attribute, value: Any) -> Any:
    """``value`` if it fits: bool is no int, int no float; structs have exactly their fields, none null."""
    if value is None:
        if not attribute.nullable:
            raise ValueError(f"{name} can't be null")
        return None
    return _check(name, attribute.kind, value)


def _check(name: str, kind: Any, value: Any) -> Any:
    if isinstance(kind, Vector):
        if not isinstance(value, (list, tuple)) or len(value) != kind.size or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in value):
            raise ValueError(f"{name} takes {kind.size} numbers")
        return [float(v) for v in value]
    if isinstance(kind, Struct):
        if not isinstance(value, Mapping) or set(value) != {n for n, _ in kind.fields}:
            raise ValueError(f"{name} takes exactly the fields {[n for n, _ in kind.fields]}")
        return {n: _check(f"{name}.{n}", k, value[n]) for n, k in kind.fields}
    if type(value) is not {v: k for k, v in _PYTHON.items()}[kind]:
        raise TypeError(f"{name} takes {kind}, not {type(value).__name__}")
    return value


def column_type(kind: Any) -> T.DataType:
    if isinstance(kind, Vector):
        return T.ArrayType(T.FloatType())
    if isinstance(kind, Struct):
        return T.StructType([T.StructField(n, column_type(k)) for n, k in kind.fields])
    return SCALARS[kind]


def fields(attributes: dict[str, Attribute]) -> list[T.StructField]:
    return [T.StructField(n, column_type(a.kind), True) for n, a in attributes.items()]


def filterable(attributes: dict[str, Attribute]) -> list[str]:
    """Built-in columns, scalar attributes and the scalar paths of structs; never texts of chunks or vectors."""

    def paths(name: str, kind: Any):
        if isinstance(kind, Struct):
            for n, k in kind.fields:
                yield from paths(f"{name}.{n}", k)
        elif not isinstance(kind, Vector):
            yield name

    return [*BUILT_IN, *(p for n, a in attributes.items() for p in paths(n, a.kind))]


def _literal(kind: Any, value: Any) -> Column:
    if value is None:
        return F.lit(None).cast(column_type(kind))
    if isinstance(kind, Vector):
        return F.array(*map(F.lit, value)).cast(column_type(kind))
    if isinstance(kind, Struct):
        return F.struct(*(_literal(k, value[n]).alias(n) for n, k in kind.fields))
    return F.lit(value).cast(column_type(kind))


def resolve(df: DataFrame, attributes: dict[str, Attribute], override: str | None = None) -> dict[str, Column]:
    """Each attribute's column: the document's, overridden by a field of the struct ``override`` where that isn't null.

    A default stands in for a column that is missing, never for a null. A missing required column is an error.
    """
    inner = {f.name for f in df.schema[override].dataType.fields} if override and override in df.columns else set()
    if unknown := inner - set(attributes):
        raise ValueError(f"undeclared attributes: {sorted(unknown)}")
    out = {}
    for n, a in attributes.items():
        own = F.col(n) if n in df.columns else None
        over = F.col(f"{override}.{n}") if n in inner else None
        if own is None and over is None and a.required:
            raise ValueError(f"attribute {n!r} is required")
        base = own if own is not None else (_literal(a.kind, a.default) if a.default is not MISSING else F.lit(None))
        out[n] = (base if over is None else F.coalesce(over, base)).cast(column_type(a.kind))
    return out


def violations(attributes: dict[str, Attribute]) -> Column:
    """How many of a row's attributes break their declaration: null where none is allowed, vectors of another size, struct fields of null."""
    total = F.lit(0)
    for n, a in attributes.items():
        c = F.col(n)
        bad = F.lit(False) if a.nullable else c.isNull()
        if isinstance(a.kind, Vector):
            bad = bad | (c.isNotNull() & ((F.size(c) != a.kind.size) | F.exists(c, lambda x: x.isNull())))
        if isinstance(a.kind, Struct):
            bad = bad | (c.isNotNull() & _holes(c, a.kind))
        total = total + bad.cast("int")
    return total


def _holes(c: Column, kind: Struct) -> Column:
    out = F.lit(False)
    for n, k in kind.fields:
        out = out | c[n].isNull() | (_holes(c[n], k) if isinstance(k, Struct) else F.lit(False))
    return out


def _kind_json(kind: Any) -> Any:
    if isinstance(kind, Vector):
        return f"float_vector[{kind.size}]"
    if isinstance(kind, Struct):
        return {"type": "struct", "fields": {n: _kind_json(k) for n, k in kind.fields}}
    return kind


def _kind_from(x: Any) -> Any:
    if isinstance(x, Mapping):
        return Struct(tuple((n, _kind_from(k)) for n, k in x["fields"].items()))
    if m := re.fullmatch(r"float_vector\[(\d+)\]", x):
        return Vector(int(m[1]))
    if x not in SCALARS:
        raise ValueError(f"unknown attribute type {x!r}")
    return x


def to_json(attributes: dict[str, Attribute]) -> dict:
    return {
        n: {"type": _kind_json(a.kind), "nullable": a.nullable, "required": a.required, **({} if a.default is MISSING else {"default": a.default})}
        for n, a in attributes.items()
    }


def from_json(data: Mapping) -> dict[str, Attribute]:
    return {n: Attribute(_kind_from(x["type"]), x["nullable"], x.get("default", MISSING)) for n, x in data.items()}


def check_profile(attributes: dict[str, Attribute], profile: str) -> None:
    """``flat`` stores have scalars only, none optional or with default; ``files`` ones at most 14 of them."""
    if profile not in ("full", "flat", "files"):
        raise ValueError(f"unknown profile {profile!r}")
    for n, a in attributes.items():
        if profile != "full" and (not isinstance(a.kind, str) or not a.required):
            raise ValueError(f"{n}: a {profile} store takes required scalars only")
    if profile == "files" and len(attributes) > 14:
        raise ValueError("a files store takes at most 14 attributes")
