"""Schemas: axis expressions, their consistency, and dtype names.

An axis expression is a linear form ``offset + coefficient * name``; a name may be dynamic
(``name[...]``, its length varies over the axes in brackets).  Given actual shapes, every
name is solved from the first expression that pins it, and later ones must agree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

_TERM = re.compile(r"\s*(?:(\d+)\s*\*\s*)?([A-Za-z_]\w*)(\[[^\]]*\]|\([^)]*\))?\s*\Z")

#: Fixed names of scalar types; Spark has no unsigned types and no half floats.
_KINDS = {
    "float64": T.DoubleType(), "float": T.DoubleType(), "double": T.DoubleType(), "float32": T.FloatType(), "float16": T.FloatType(),
    "int64": T.LongType(), "int": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "int8": T.ByteType(),
    "uint64": T.LongType(), "uint32": T.LongType(), "uint16": T.LongType(), "uint8": T.LongType(), "bool": T.BooleanType(),
}


def parse_dtype(kind) -> T.DataType:
    """The Spark type of a dtype name, a Python type or a NumPy type."""
    name = kind if isinstance(kind, str) else getattr(kind, "__name__", str(kind))
    if name not in _KINDS:
        raise ValueError(f"no scalar type {name!r}")
    return _KINDS[name]


@dataclass(frozen=True)
class AxisTerm:
    coefficient: int
    name: str
    arguments: tuple[str, ...] = ()
    dynamic: bool = False


@dataclass(frozen=True)
class AxisExpression:
    offset: int
    terms: tuple[AxisTerm, ...]


def _split(text: str, mark: str) -> list[str]:
    """Parts of text at marks outside brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "[(") - (c in "])")
        if c == mark and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def parse_axis(text: str) -> AxisExpression:
    offset, terms = 0, []
    for part in _split(text, "+"):
        if part.strip().isdigit():
            offset += int(part)
            continue
        m = _TERM.match(part)
        if not m:
            raise ValueError(f"no axis term: {part.strip()!r}")
        inner = m[3] or ""
        arguments = tuple(x.strip() for x in inner[1:-1].split(",") if x.strip())
        terms.append(AxisTerm(int(m[1] or 1), m[2], arguments, inner.startswith("[")))
    return AxisExpression(offset, tuple(terms))


class AxisSystem:
    """Axis expressions of several fields, and the sizes that fit their shapes."""

    def __init__(self, fields: dict[str, str]):
        self.fields = {name: [parse_axis(x) for x in _split(text, ",")] for name, text in fields.items()}

    def solve(self, shapes: dict[str, tuple[int, ...]]) -> dict[str, int]:
        sizes: dict[str, int] = {}
        todo = []
        for name, shape in shapes.items():
            axes = self.fields[name]
            if len(axes) != len(shape):
                raise ValueError(f"{name} has rank {len(shape)}, not {len(axes)}")
            todo += [(name, e, n) for e, n in zip(axes, shape, strict=True)]
        while todo:
            left = []
            for name, e, n in todo:
                rest = n - e.offset - sum(t.coefficient * sizes[t.name] for t in e.terms if t.name in sizes)
                free = [t for t in e.terms if t.name not in sizes]
                if len(free) == 1:
                    size, odd = divmod(rest, free[0].coefficient)
                    if odd or size < 0:
                        raise ValueError(f"{name}: no size of {free[0].name} gives {n}")
                    sizes[free[0].name] = size
                elif not free and rest:
                    raise ValueError(f"{name}: {' + '.join(t.name for t in e.terms)} disagrees with {n}")
                elif free:
                    left.append((name, e, n))
            if len(left) == len(todo):
                break
            todo = left
        return sizes
