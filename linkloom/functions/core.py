"""Expression helpers shared by the column-function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Column functions that use an input several times would otherwise copy its
    expression tree at every use; Catalyst then inlines those copies through
    projections and pushed-down filters, so nested URL functions grow
    exponentially.  Binding through a one-element ``transform`` keeps the
    expression linear and evaluates the input once per row.
    """
    return F.element_at(F.transform(F.array(col(value)), fn), 1)
