"""Evaluate an expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    A column that is mentioned twice in a conditional is a tree that is copied twice, and a chain of
    such steps grows exponentially.  A one-element array and a lambda bind the value instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
