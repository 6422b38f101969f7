"""Which way to read a table: all of it, a copy sorted by a column, or the places that an index of a column names.

Costs are pages read, from row counts, value ranges and the bounds of the query.  A sorted copy reads its share of
the pages; an index reads its share of its own entries, and then one unit (a file, or a page of a paged table) for
each match until all are read.  Reaching either costs ``PROBE`` pages.  The scan is taken unless another is cheaper.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from conjunx.plans.joinorder import Stats, share
from conjunx.plans.model import Interval

#: Bytes of a page, pages to find where a range of a copy or an index begins, bytes of an index entry besides its key.
PAGE, PROBE, ENTRY = 4096, 3, 8


@dataclass(frozen=True)
class Access:
    """``kind``: scan, clustered or unclustered; the column of the last two, and the bound on it."""

    kind: str = "scan"
    column: str | None = None
    interval: Interval = Interval()
    cost: float = 0.0


def choose(stats: Stats, row_bytes: int, units: int, bounds: dict[str, Interval], layouts: dict[tuple[str, str], int]) -> Access:
    """The cheapest access.  ``layouts``: by kind and column the bytes of a key; ``units``: what an index can tell apart."""
    pages = math.ceil(stats.rows * row_bytes / PAGE)
    best = Access(cost=float(pages))
    for (kind, column), key_bytes in sorted(layouts.items()):
        interval = bounds.get(column, Interval())
        if interval == Interval():
            continue
        part = min(1.0, share(interval, *stats.ranges.get(column, (None, None))))
        if kind == "clustered":
            cost = PROBE + math.ceil(pages * part)
        else:
            entries = math.ceil(stats.rows * (key_bytes + ENTRY) / PAGE)
            cost = PROBE + math.ceil(entries * part) + math.ceil(min(stats.rows * part, units) * pages / max(1, units))
        if cost < best.cost:
            best = Access(kind, column, interval, float(cost))
    return best
