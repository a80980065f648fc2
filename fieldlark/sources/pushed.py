"""Predicates that Spark hands to a data source, as bounds on extents and as filters on rows."""

from __future__ import annotations

import functools
import operator

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

#: How a predicate on a column bounds the extents of the files that can hold a row for it.
_MEETS = {
    EqualTo: lambda lo, hi, v: (lo <= v) & (hi >= v),
    GreaterThan: lambda lo, hi, v: hi > v,
    GreaterThanOrEqual: lambda lo, hi, v: hi >= v,
    LessThan: lambda lo, hi, v: lo < v,
    LessThanOrEqual: lambda lo, hi, v: lo <= v,
    In: lambda lo, hi, v: functools.reduce(operator.or_, [(lo <= x) & (hi >= x) for x in v if x is not None], ds.scalar(False)),
}
_HOLDS = {
    EqualTo: operator.eq,
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
    In: lambda c, v: c.isin([x for x in v if x is not None]),
}


class Pushed:
    """Comparisons of a column with a value that have to hold together; others are left to Spark."""

    def __init__(self):
        self.known: list[tuple[type, str, object]] = []

    def take(self, filters: list[Filter]) -> None:
        self.known += [(type(f), f.attribute[0], f.value) for f in filters if type(f) in _MEETS and len(f.attribute) == 1]

    def on_extents(self, columns) -> pc.Expression | None:
        """A filter on ``least_`` and ``most_`` columns, for those of the given columns that have them."""
        return self._all(_MEETS[kind](ds.field(f"least_{c}"), ds.field(f"most_{c}"), v) for kind, c, v in self.known if c in columns)

    def on_rows(self, columns) -> pc.Expression | None:
        return self._all(_HOLDS[kind](ds.field(c), v) for kind, c, v in self.known if c in columns)

    @staticmethod
    def _all(parts) -> pc.Expression | None:
        parts = list(parts)
        return functools.reduce(operator.and_, parts) if parts else None
