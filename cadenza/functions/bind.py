"""Binding a value for use in an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row.

    An expression inside the function of transform or aggregate is computed for every element; a bound
    one is not.
    """
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)
