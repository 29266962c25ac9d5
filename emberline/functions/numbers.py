"""Rounding of doubles by their exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals.

    ``format_number`` decides ties on the exact binary value and so agrees with C and Python
    formatting; ``format_string`` and ``round`` work on the shortest decimal text instead.
    """
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def round_binary(value: Column, digits: int) -> Column:
    return fixed(value, digits).cast("double")
