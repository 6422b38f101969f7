"""The one model that SQL text and the fluent API both become.  Everything is immutable."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

#: Each comparison with what it is from the other side.
MIRRORED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "<>": "<>"}


@dataclass(frozen=True, order=True)
class Col:
    """A column; ``table`` is an alias, None until resolved."""

    table: str | None
    name: str

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Lit:
    """A constant: int, Decimal, str, date, datetime or bool."""

    value: Any

    def __str__(self) -> str:
        return f"'{self.value}'" if isinstance(self.value, str) else str(self.value)


@dataclass(frozen=True)
class Cmp:
    """left op right, with a lone constant on the right."""

    left: Col | Lit
    op: str
    right: Col | Lit

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"

    @property
    def columns(self) -> tuple[Col, ...]:
        return tuple(x for x in (self.left, self.right) if isinstance(x, Col))

    @property
    def tables(self) -> frozenset[str]:
        return frozenset(c.table for c in self.columns)

    def flipped(self) -> Cmp:
        return Cmp(self.right, MIRRORED[self.op], self.left)


def compare(left: Col | Lit, op: str, right: Col | Lit) -> Cmp:
    """A comparison in its usual form."""
    out = Cmp(left, op, right)
    return out.flipped() if isinstance(left, Lit) and isinstance(right, Col) else out


@dataclass(frozen=True)
class Table:
    name: str
    alias: str


@dataclass(frozen=True)
class Item:
    """An output column; name None is the column's own.  A col with the name ``*`` is all of its table's."""

    col: Col
    name: str | None = None


@dataclass(frozen=True)
class Query:
    """SELECT [DISTINCT] items FROM tables WHERE all of where ORDER BY order; no items: all columns."""

    tables: tuple[Table, ...]
    items: tuple[Item, ...] = ()
    where: tuple[Cmp, ...] = ()
    order: tuple[Col, ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class Interval:
    """What a column's values are bounded by; None is no bound."""

    low: Any = None
    high: Any = None
    low_open: bool = False
    high_open: bool = False

    def narrowed(self, op: str, value: Any) -> Interval:
        """The interval of those values for which ``value op`` its mirror also holds."""
        low, low_open, high, high_open = self.low, self.low_open, self.high, self.high_open
        if op in (">", ">=", "=") and (low is None or value > low or (value == low and op == ">")):
            low, low_open = value, op == ">"
        if op in ("<", "<=", "=") and (high is None or value < high or (value == high and op == "<")):
            high, high_open = value, op == "<"
        return Interval(low, high, low_open, high_open)

    @property
    def empty(self) -> bool:
        if self.low is None or self.high is None:
            return False
        return self.low > self.high or (self.low == self.high and (self.low_open or self.high_open))

    @property
    def point(self) -> bool:
        return self.low is not None and self.low == self.high and not (self.low_open or self.high_open)

    def comparisons(self, col: Col) -> tuple[Cmp, ...]:
        if self.point:
            return (Cmp(col, "=", Lit(self.low)),)
        out = []
        if self.low is not None:
            out.append(Cmp(col, ">" if self.low_open else ">=", Lit(self.low)))
        if self.high is not None:
            out.append(Cmp(col, "<" if self.high_open else "<=", Lit(self.high)))
        return tuple(out)
