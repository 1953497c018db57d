"""Metrics of factors and return series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames, ieee

DAYS = 252
LAGS = (1, 2, 3, 5, 10, 20)


def mean_or_zero(name: str) -> Column:
    return F.coalesce(ieee.zero_unless_finite(F.avg(name)), F.lit(0.0))


def spearman_by(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """``by, ic``: rank correlation of x and y within groups; rows with a null are left out, undefined values too."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.withColumns({"__x": frames.average_rank(F.col(x), *by), "__y": frames.average_rank(F.col(y), *by)})
    found = ranked.groupBy(*by).agg(ieee.pearson(F.col("__x"), F.col("__y")).alias("ic"))
    return found.where(ieee.finite(F.col("ic")))


def rank_ic(factor: DataFrame, returns: DataFrame) -> DataFrame:
    """``date, ic``."""
    return spearman_by(factor.join(returns, ["date", "asset"]), "factor_value", "forward_return", "date")


def ic_summary(ic: DataFrame) -> DataFrame:
    """One row: ``ic_mean, ic_std, ic_ir``, 0 where undefined."""
    found = ic.agg(mean_or_zero("ic").alias("ic_mean"), F.coalesce(ieee.zero_unless_finite(F.stddev_samp("ic")), F.lit(0.0)).alias("ic_std"))
    return found.withColumn("ic_ir", F.when(F.col("ic_std") != 0, F.col("ic_mean") / F.when(F.col("ic_std") != 0, F.col("ic_std"))).otherwise(0.0))


def group_annual_returns(by_group: DataFrame) -> DataFrame:
    """One row: ``group_annual_returns``, a map from group to mean daily return times 252."""
    means = by_group.groupBy("group").agg((F.avg("daily_return") * DAYS).alias("annual"))
    return means.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("group", "annual")))).alias("group_annual_returns"))


def sharpe(name: str, periods: float = DAYS) -> Column:
    """Mean over sample deviation times the root of ``periods``; 0 where undefined. An aggregate."""
    deviation = F.stddev_samp(name)
    return F.coalesce(ieee.zero_unless_finite(F.avg(name) / F.when(deviation > 0, deviation) * math.sqrt(periods)), F.lit(0.0))


def max_drawdown(curve: DataFrame, column: str = "equity") -> DataFrame:
    """One row: ``max_drawdown``, the greatest fall from the highest value so far; the first value is the first high."""
    high = F.max(column).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    falls = curve.select(ieee.div(F.col(column) - high, high).alias("fall"))
    return falls.agg(F.coalesce(ieee.zero_unless_finite(F.abs(F.min("fall"))), F.lit(0.0)).alias("max_drawdown"))


def alpha_decay(factor: DataFrame, returns: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """``lag, ic``: mean rank IC of the factor with the forward return ``lag`` joined rows later, 0 where undefined; all lags in one pass."""
    joined = factor.join(returns, ["date", "asset"]).where("factor_value IS NOT NULL AND forward_return IS NOT NULL")
    later = [F.struct(F.lit(n).alias("lag"), F.lead("forward_return", n).over(frames.history()).alias("later")) for n in lags]
    wide = joined.select("date", "factor_value", *[s.alias(f"__lag{n}") for s, n in zip(later, lags)])
    long = wide.select("date", "factor_value", F.inline(F.array(*[f"__lag{n}" for n in lags])))
    daily = spearman_by(long, "factor_value", "later", "lag", "date")
    every = factor.sparkSession.createDataFrame([(n,) for n in lags], "lag int")
    return every.join(daily.groupBy("lag").agg(F.avg("ic").alias("ic")), "lag", "left").withColumn("ic", F.coalesce("ic", F.lit(0.0)))


def kendall_by(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """``by, tau``: Kendall's tau-b of x and y within groups, null where a side does not vary. Pairs are formed within a
    group, which has as many rows as there are quantile groups or combinations."""
    items = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("items"))

    def pairs(f) -> Column:
        def of_one(a: Column, i: Column) -> Column:
            later = F.slice(F.col("items"), i + 2, F.size("items"))
            return F.aggregate(later, F.lit(0.0), lambda acc, b: acc + f(F.signum((a["x"] - b["x"]).cast("double")), F.signum((a["y"] - b["y"]).cast("double"))))

        return F.aggregate(F.transform("items", of_one), F.lit(0.0), lambda acc, v: acc + v)

    both, of_x, of_y = pairs(lambda s, t: s * t), pairs(lambda s, t: s * s), pairs(lambda s, t: t * t)
    scale = F.sqrt(of_x * of_y)
    return items.select(*by, (both / F.when(scale > 0, scale)).alias("tau"))


def monotonicity(by_group: DataFrame) -> DataFrame:
    """One row: ``monotonicity``, the mean over dates of tau between group and return; 0 without any."""
    taus = kendall_by(by_group, "group", "daily_return", "date")
    return taus.agg(F.coalesce(F.avg("tau"), F.lit(0.0)).alias("monotonicity"))


def half_life(decay: DataFrame) -> DataFrame:
    """One row: ``half_life`` of a ``lag, ic`` curve: the first lag whose IC is below half of the first one's in size; else from
    an exponential fit; else the number of lags; 0 for an empty curve."""
    first = F.abs(F.min_by("ic", "lag"))
    curve = decay.agg(F.sort_array(F.collect_list(F.struct("lag", "ic"))).alias("curve"), F.when(first != 0, first).otherwise(1.0).alias("first"), F.regr_slope(F.log(F.greatest(F.abs(F.col("ic")), F.lit(1e-10))), F.col("lag").cast("double")).alias("slope"))
    below = F.get(F.filter("curve", lambda p: F.abs(p["ic"]) < F.col("first") / 2), 0)["lag"].cast("double")
    n = F.size("curve")
    fitted = F.when((n >= 2) & (F.abs("slope") > 1e-10), -math.log(2) / F.col("slope"))
    return curve.select(F.when(n == 0, 0.0).otherwise(F.coalesce(below, fitted, n.cast("double"))).alias("half_life"))
