"""Window frames over a panel: cross-sections by date, histories by asset, rolling rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def cross_section():
    return Window.partitionBy("date")


def history():
    return Window.partitionBy("asset").orderBy("date")


def last_rows(n: int):
    """The current row and the n - 1 before it, of one asset."""
    return history().rowsBetween(-(n - 1), 0)


def once_full(value: Column, n: int, *needed: Column) -> Column:
    """``value`` (over the last n rows) where all n rows have the needed columns; null during warm-up."""
    present = reduce(lambda a, b: a & b, (c.isNotNull() for c in needed))
    return F.when(F.count(F.when(present, 1)).over(last_rows(n)) >= n, value)


def average_rank(x: Column, *by: str) -> Column:
    """Rank from 1 within ``by``, ties on average, nulls unranked: the mean of the first and the last rank among equals, both from one sorted pass."""
    in_order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    first, last = F.rank().over(in_order), F.count(F.lit(1)).over(in_order)  # the frame ends with the row's equals
    return F.when(x.isNotNull(), (first + last) / 2)
