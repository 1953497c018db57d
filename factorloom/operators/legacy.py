"""Operators on a single series ``date, close, ...``: one row a date, so windows over all dates are on purpose."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames, ieee

DAYS = 252


def by_date():
    return Window.orderBy("date")


def column_or_zero(series: DataFrame, name: str) -> Column:
    """A column as factor; 0.0 where the series has none of the name."""
    return F.col(name).cast("double") if name in series.columns else F.lit(0.0)


def changes(series: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``date`` and relative changes from the row before, under new names; null on the first."""
    return series.select("date", *[(ieee.div(F.col(c), F.lag(c).over(by_date())) - 1).alias(n) for c, n in names.items()])


def series_ic(series: DataFrame, factor: str, price: str = "close") -> DataFrame:
    """One row ``ic, rank_ic``: correlation of a factor with the same date's change of price, and of their ranks."""
    rows = series.select(column_or_zero(series, factor).alias("f"), (ieee.div(F.col(price), F.lag(price).over(by_date())) - 1).alias("r"))
    rows = rows.where("f IS NOT NULL AND r IS NOT NULL").withColumns({"a": frames.average_rank(F.col("f")), "b": frames.average_rank(F.col("r"))})
    return rows.agg(F.coalesce(ieee.pearson(F.col("f"), F.col("r")), F.lit(0.0)).alias("ic"), F.coalesce(ieee.pearson(F.col("a"), F.col("b")), F.lit(0.0)).alias("rank_ic"))


def quantile_pnl(series: DataFrame, factor: str, price: str = "close", buckets: int = 5) -> DataFrame:
    """``date, bucket, pnl``: long the top and short the bottom quantile bucket (from 1) of the factor, ties by date."""
    rows = series.select("date", column_or_zero(series, factor).alias("f"), F.coalesce(ieee.div(F.col(price), F.lag(price).over(by_date())) - 1, F.lit(0.0)).alias("r")).where("f IS NOT NULL")
    rows = rows.withColumns({"k": F.row_number().over(Window.orderBy("f", "date")), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    steps = F.greatest(F.col("n") - 1, F.lit(1))
    bucket = F.greatest(F.floor(((F.col("k") - 1) * buckets + steps - 1) / steps), F.lit(1)).cast("int")
    return rows.select("date", bucket.alias("bucket"), F.when(bucket == buckets, F.col("r")).when(bucket == 1, -F.col("r")).otherwise(0.0).alias("pnl"))


def tracking(moves: DataFrame, pnl: str, benchmark: str) -> DataFrame:
    """One row ``mean_dev, std_dev, tracking_error, win_rate`` of the difference from a benchmark; missing counts as 0."""
    p = F.coalesce(pnl, F.lit(0.0))
    diff = p - F.coalesce(benchmark, F.lit(0.0))
    wins = F.count_if(p > 0) / F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1)))
    return moves.agg(F.avg(diff).alias("mean_dev"), F.stddev_samp(diff).alias("std_dev"), (F.stddev_samp(diff) * math.sqrt(DAYS)).alias("tracking_error"), wins.alias("win_rate"))


def train_split(series: DataFrame, share: float = 0.7) -> DataFrame:
    """``series`` with ``train``: the first share of dates."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return series.withColumn("train", F.row_number().over(by_date()) <= F.floor(n * F.lit(share)))


#: Dates whose curve is built at a time.
BLOCK = 256


def rounded_curve(moves: DataFrame, pnl: str, start: float = 100.0, digits: int = 6) -> DataFrame:
    """``place, excess``: start times the running product of 1 + pnl, rounded at every step.

    Rounding makes each value depend on the one before, so one series is one row, one number a date. It is built in blocks, since a list that grows by each
    date takes time by its square."""
    series = moves.agg(F.array_sort(F.collect_list(F.struct("date", F.coalesce(pnl, F.lit(0.0)).cast("double").alias("r")))).alias("s")).where(F.size("s") > 0)
    numbers = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / BLOCK).cast("int")), lambda k: F.slice("s", k * BLOCK + 1, F.lit(BLOCK)))

    def built(block: Column, last: Column) -> Column:
        """The value before the block, and those of its dates."""
        return F.aggregate(block, F.array(last), lambda acc, x: F.concat(acc, F.array(ieee.rounded(F.element_at(acc, -1) * (1 + x["r"]), digits))))

    # a block's curve ends with what the next one begins with
    curves = F.aggregate(numbers, F.array(F.array(F.lit(float(start)))), lambda acc, b: F.concat(acc, F.array(built(b, F.element_at(F.element_at(acc, -1), -1)))))
    values = F.flatten(F.transform(F.slice(curves, 2, F.size(numbers)), lambda c: F.slice(c, 2, F.size(c) - 1)))
    return series.select(F.posexplode(values).alias("place", "excess"))


def compounded(moves: DataFrame, pnl: str) -> DataFrame:
    """One row ``ann_return, max_drawdown`` in per cent of exp(cumulative pnl)."""
    upto = by_date().rowsBetween(Window.unboundedPreceding, 0)
    curve = moves.select("date", F.exp(F.sum(F.coalesce(pnl, F.lit(0.0))).over(upto)).alias("e"))
    fall = F.min("e").over(upto) / F.max("e").over(upto) - 1
    return curve.withColumn("fall", fall).agg(((F.max_by("e", "date") - 1) * 100).alias("ann_return"), (F.min("fall") * 100).alias("max_drawdown"))


def ranked_factors(scores: DataFrame) -> DataFrame:
    """``scores`` (``name, rank_ic``) with ``rank`` from 1, the greatest rank IC first, ties by name."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rank_ic"), "name")))


def ticket_action(reverse: Column, category: Column, retries: Column, most_retries: int = 2) -> Column:
    """What becomes of a deviation case: ``skip, submit, drop, error``."""
    return (
        F.when(~F.coalesce(reverse, F.lit(False)), "skip").when(category == "entity_merge", "submit")
        .when((category == "layout_reflection") & (retries > most_retries + 2), "drop").when(category == "layout_reflection", "submit").otherwise("error")
    )
