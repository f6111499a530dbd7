"""Small helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f of the value, which is computed once for each row however often f names it."""
    return F.transform(F.array(value), f)[0]
