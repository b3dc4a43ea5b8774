"""Local names for expressions that a lambda or a filter uses often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, even where ``body`` uses it in a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """``value`` as a generated column: the optimizer pushes no filter on it below the generator, which would compute it again for
    the filter (as it does with a filter on a projected column, and with the one on size that it adds to every inner explode)."""
    return F.explode_outer(F.array(value))
