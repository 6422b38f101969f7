"""The fluent API: ``Select("o.o_orderkey").from_("orders", "o").where("o.o_custkey", "<", 5)``."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from conjunx.plans.dialect import DialectError
from conjunx.plans.model import MIRRORED, Col, Item, Lit, Query, Table, compare


def column(text: str) -> Col:
    table, _, name = text.rpartition(".")
    return Col(table or None, name)


@dataclass(frozen=True)
class Value:
    """A string constant, where a plain string would be a column."""

    text: str


def _operand(x: Any) -> Col | Lit:
    if isinstance(x, Value):
        return Lit(x.text)
    return column(x) if isinstance(x, str) else x if isinstance(x, Col | Lit) else Lit(x)


class Select:
    """A query under construction; every step gives a new one.  No columns: all."""

    def __init__(self, *columns: str, **named: str):
        self.query = Query((), tuple(Item(column(c)) for c in columns) + tuple(Item(column(c), n) for n, c in named.items()))

    def _with(self, **changes: Any) -> Select:
        out = Select.__new__(Select)
        out.query = replace(self.query, **changes)
        return out

    def from_(self, table: str, alias: str | None = None) -> Select:
        return self._with(tables=(*self.query.tables, Table(table, alias or table)))

    def where(self, left: Any, op: str, right: Any) -> Select:
        """A further condition; strings are columns, ``Value`` a string constant."""
        op = "<>" if op == "!=" else op
        if op not in MIRRORED:
            raise DialectError(f"a comparison expected, {op!r} met")
        return self._with(where=(*self.query.where, compare(_operand(left), op, _operand(right))))

    def join(self, table: str, alias: str, *equal: tuple[str, str]) -> Select:
        """A further table, with equalities."""
        out = self.from_(table, alias)
        for a, b in equal:
            out = out.where(a, "=", b)
        return out

    def order_by(self, *columns: str) -> Select:
        return self._with(order=tuple(column(c) for c in columns))

    def distinct(self) -> Select:
        return self._with(distinct=True)
