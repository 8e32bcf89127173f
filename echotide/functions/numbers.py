"""Sums and means that do not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXACT = "decimal(18,12)"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def exact_sum(value: Column | str) -> Column:
    """Sum of fractions as decimals of twelve places: any order of addition gives the same digits."""
    return F.sum(_column(value).cast(EXACT))


def exact_mean(value: Column | str) -> Column:
    return F.avg(_column(value).cast(EXACT)).cast("double")


def rounded(value: Column | str, digits: int) -> Column:
    return F.round(_column(value), digits).cast("double")
