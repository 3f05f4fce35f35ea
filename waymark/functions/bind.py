"""A name for a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once a row. What a lambda or a formula repeats is computed anew at each place (Spark shares
    equal parts of an expression only outside of lambdas), so that nested formulas grow with the power of their depth."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
