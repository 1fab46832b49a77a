"""Values that are evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, also inside other lambdas, where nothing else shares it."""
    return F.get(F.transform(F.array(value), use), 0)
