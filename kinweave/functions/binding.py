"""Names for intermediate values inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, where ``value`` is computed once however often ``body`` uses it.

    A Python helper that uses a column twice copies its whole tree; helpers that
    build on each other then grow as a product. Inside a lambda function the value
    is a variable, so the tree stays as long as it is written.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
