"""Predicates: atoms over numeric, categorical and text columns, and their disjunctive normal form.

An atom knows its Spark condition (which can be pushed into a scan), and a canonical text of full precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LT, GT, INTERVAL, EQ, CONTAINS, FUNCTION = "lt", "gt", "interval", "eq", "contains", "function"


@dataclass(frozen=True)
class Atom:
    """form over column, with bounds a (and b), a pattern, or a user's condition.

    Bounds are strict. NaN satisfies nothing, null satisfies nothing. An empty pattern is contained in nothing. proxy and
    code name a categorical column that stands for a text atom in statistics only.
    """

    form: str
    column: str
    a: float = 0.0
    b: float = 0.0
    pattern: str = ""
    proxy: str = ""
    code: float = -1.0
    make: Callable[[], Column] | None = None

    def condition(self) -> Column:
        c = F.col(self.column) if self.make is None else None
        match self.form:
            case "lt":
                out = c < F.lit(self.a)
            case "gt":
                out = (c > F.lit(self.a)) & ~F.isnan(c.cast("double"))
            case "interval":
                out = (c > F.lit(self.a)) & (c < F.lit(self.b))
            case "eq":
                out = (c == F.lit(self.a)) & ~F.isnan(c.cast("double"))
            case "contains":
                out = F.contains(c, F.lit(self.pattern)) if self.pattern else F.lit(False)
            case "function":
                out = self.make()
            case _:
                raise ValueError(f"unknown form {self.form}")
        return F.coalesce(out, F.lit(False))

    def canonical(self) -> str:
        match self.form:
            case "lt":
                return f"{self.column}<{self.a!r}"
            case "gt":
                return f"{self.column}>{self.a!r}"
            case "interval":
                return f"{self.a!r}<{self.column}<{self.b!r}"
            case "eq":
                return f"{self.column}={self.a!r}"
            case "contains":
                return f"contains_{self.column}_{self.pattern}"
        return self.column


def lt(column: str, a: float) -> Atom:
    return Atom(LT, column, float(a))


def gt(column: str, a: float) -> Atom:
    return Atom(GT, column, float(a))


def interval(column: str, a: float, b: float) -> Atom:
    return Atom(INTERVAL, column, float(a), float(b))


def eq(column: str, code: float) -> Atom:
    return Atom(EQ, column, float(code))


def contains(column: str, pattern: str, proxy: str = "", code: float = -1.0) -> Atom:
    return Atom(CONTAINS, column, pattern=pattern, proxy=proxy, code=code)


def function(name: str, make: Callable[[], Column]) -> Atom:
    """Any boolean Column, for instance a pandas UDF over columns, under a name."""
    return Atom(FUNCTION, name, make=make)


@dataclass(frozen=True)
class DNF:
    """OR of ANDs. No clause: false; an empty clause: true. tombstone: a boolean column whose true rows never match."""

    clauses: tuple[tuple[Atom, ...], ...]
    tombstone: str = ""

    def condition(self) -> Column:
        each = [reduce(lambda x, y: x & y, [a.condition() for a in clause]) if clause else F.lit(True) for clause in self.clauses]
        out = reduce(lambda x, y: x | y, each) if each else F.lit(False)
        return out & ~F.coalesce(F.col(self.tombstone), F.lit(False)) if self.tombstone else out

    def canonical(self) -> str:
        inner = ",".join("AND(" + ",".join(a.canonical() for a in clause) + ")" for clause in self.clauses)
        return f"OR({inner})" + (f"-{self.tombstone}" if self.tombstone else "")

    def key(self) -> str:
        """A name for files: a digest, so that different predicates never share one."""
        return hashlib.sha256(self.canonical().encode()).hexdigest()


def dnf(*clauses: Sequence[Atom], tombstone: str = "") -> DNF:
    return DNF(tuple(tuple(c) for c in clauses), tombstone)


def spinning(inner: Column, spin: int) -> Column:
    """The same truth as inner, made costly by spin steps in Python: for measuring routing, not for use."""

    @F.pandas_udf("boolean")
    def slow(values):
        import pandas as pd

        total = 0
        for _ in range(spin * len(values)):
            total += 1
        return pd.Series(values) & (total >= 0)

    return slow(inner)
