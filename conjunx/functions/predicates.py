"""Comparisons as Spark columns."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from conjunx.plans.model import Cmp, Col, Lit

_OPERATORS = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "=": operator.eq, "<>": operator.ne}


def comparison(c: Cmp, column: Callable[[Col], Column]) -> Column:
    """``c`` over the columns that ``column`` gives.  A column compared with itself asks for it to be not null."""
    if isinstance(c.left, Col) and c.left == c.right:
        known = column(c.left).isNotNull()
        return known if c.op in ("=", "<=", ">=") else known & F.lit(False)
    sides = [F.lit(x.value) if isinstance(x, Lit) else column(x) for x in (c.left, c.right)]
    return _OPERATORS[c.op](*sides)


def conjunction(parts: Iterable[Column]) -> Column | None:
    """All of ``parts``; None for none."""
    parts = list(parts)
    return reduce(operator.and_, parts) if parts else None
