"""Quantile long/short backtest as one lazy plan: forward returns, groups, legs, turnover, costs, equity, neutralisation.

Frames: factor values ``date, asset, factor_value``; forward returns ``date, asset, forward_return``. What comes out by date
has one row a date, a few thousand at most, so windows over all dates run in one task on purpose.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames, ieee

DAYS = 252


def forward_returns(panel: DataFrame) -> DataFrame:
    """Next row's close over this one's, less 1; an asset's last row has none."""
    following = F.lead(F.col("close").cast("double")).over(frames.history())
    return panel.select("date", "asset", (ieee.div(following, F.col("close")) - 1).alias("forward_return")).where("forward_return IS NOT NULL")


def quantile_groups(factor: DataFrame, groups: int = 5) -> DataFrame:
    """``factor`` with ``rank`` and ``group`` from 0: int(rank / (n + 1) * groups), ranks by value, ties by asset."""
    by_value = Window.partitionBy("date").orderBy("factor_value", "asset")
    ranked = factor.where("factor_value IS NOT NULL").withColumn("rank", F.row_number().over(by_value))
    n = F.max("rank").over(Window.partitionBy("date"))
    return ranked.withColumn("group", (F.col("rank") / (n + 1) * groups).cast("int"))


def group_returns(grouped: DataFrame, returns: DataFrame) -> DataFrame:
    """``date, group, daily_return``: equal-weighted means."""
    return grouped.join(returns, ["date", "asset"]).groupBy("date", "group").agg(F.avg("forward_return").alias("daily_return"))


def long_short(by_group: DataFrame, groups: int = 5) -> DataFrame:
    """``date, long_ret, short_ret, ls_return_raw`` of dates that have both extreme groups."""
    legs = by_group.where(F.col("group").isin(0, groups - 1)).groupBy("date").agg(
        F.max(F.when(F.col("group") == groups - 1, F.col("daily_return"))).alias("long_ret"), F.max(F.when(F.col("group") == 0, F.col("daily_return"))).alias("short_ret")
    )
    return legs.where("long_ret IS NOT NULL AND short_ret IS NOT NULL").withColumn("ls_return_raw", F.col("long_ret") - F.col("short_ret"))


def leg_weights(grouped: DataFrame, groups: int = 5) -> DataFrame:
    """``date, asset, weight``: each leg's assets in equal parts, the short leg's negative."""
    side = F.when(F.col("group") == groups - 1, 1.0).when(F.col("group") == 0, -1.0)
    legs = grouped.where(side.isNotNull()).withColumn("side", side)
    return legs.select("date", "asset", (F.col("side") / F.count(F.lit(1)).over(Window.partitionBy("date", "group"))).alias("weight"))


def turnover(weights: DataFrame) -> DataFrame:
    """``date, turnover``: half the absolute changes of weight since the date before; all of it on the first date.

    Each weight also stands, negated, on the next date; sums by date and asset are the changes, without an outer join.
    """
    dates = weights.select("date").distinct().withColumn("next_date", F.lead("date").over(Window.orderBy("date")))
    left = weights.join(F.broadcast(dates), "date").where("next_date IS NOT NULL").select(F.col("next_date").alias("date"), "asset", (-F.col("weight")).alias("weight"))
    changes = weights.unionByName(left).groupBy("date", "asset").agg(F.sum("weight").alias("change"))
    return changes.groupBy("date").agg((F.sum(F.abs("change")) / 2).alias("turnover"))


def with_costs(legs: DataFrame, traded: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """``legs`` with ``turnover`` (0 where there is none) and ``ls_return`` after costs."""
    out = legs.join(traded, "date", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    return out.withColumn("ls_return", F.col("ls_return_raw") - F.col("turnover") * F.lit(cost_bps / 1e4))


def equity(returns: DataFrame, column: str = "ls_return") -> DataFrame:
    """``returns`` with ``equity``, the running product of 1 + return."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", F.product(1 + F.col(column)).over(upto))


def equity_frame(factor: DataFrame, panel: DataFrame, groups: int = 5, cost_bps: float = 10.0) -> DataFrame:
    """Daily legs, turnover, net return and equity of one factor."""
    grouped = quantile_groups(factor, groups)
    legs = long_short(group_returns(grouped, forward_returns(panel)), groups)
    return equity(with_costs(legs, turnover(leg_weights(grouped, groups)), cost_bps))


def backtest(factor: DataFrame, panel: DataFrame, groups: int = 5, cost_bps: float = 10.0, undefined_is_zero: bool = True) -> DataFrame:
    """One row: IC mean, deviation and ratio, annual long/short return, Sharpe, drawdown, turnover, the groups' annual returns, and ``n_nonfinite``, the
    number of dates whose return is infinite or undefined (a price of 0): where it is not 0, measures that are 0 may say only that.

    With ``undefined_is_zero=False`` measures are what the returns make them: infinite or NaN where a return is, null where there is nothing to measure."""
    grouped = quantile_groups(factor, groups)
    both = grouped.join(forward_returns(panel), ["date", "asset"], "left")
    ranks = {"x": frames.average_rank(F.when(F.col("forward_return").isNotNull(), F.col("factor_value")), "date"), "y": frames.average_rank(F.col("forward_return"), "date")}
    ic = ieee.pearson(F.col("x"), F.col("y"))
    means = [F.avg(F.when(F.col("group") == g, F.col("forward_return"))).alias(f"group{g}") for g in range(groups)]
    daily = both.withColumns(ranks).groupBy("date").agg(F.when(ieee.finite(ic), ic).alias("ic"), *means)
    # one row a date from here on: everything else is one pass over these rows in order
    traded = turnover(leg_weights(grouped, groups)).withColumnRenamed("turnover", "traded")
    raw = F.col(f"group{groups - 1}") - F.col("group0")  # null unless both legs are there
    net = daily.join(traded, "date", "left").withColumn("ls_return", raw - F.coalesce("traded", F.lit(0.0)) * F.lit(cost_bps / 1e4))
    curve = equity(net).withColumn("equity", F.when(F.col("ls_return").isNotNull(), F.col("equity")))
    high = F.max("equity").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    curve = curve.withColumn("fall", ieee.div(F.col("equity") - high, high))
    annual = F.array(*[F.struct(F.lit(g).alias("group"), (F.avg(f"group{g}") * DAYS).alias("annual")) for g in range(groups)])

    def told(c):
        return F.coalesce(ieee.zero_unless_finite(c), F.lit(0.0)) if undefined_is_zero else c

    def ratio(mean, deviation):
        return F.coalesce(ieee.zero_unless_finite(mean / F.when(deviation > 0, deviation)), F.lit(0.0)) if undefined_is_zero else ieee.div(mean, deviation)

    found = curve.agg(
        told(F.avg("ic")).alias("ic_mean"), told(F.stddev_samp("ic")).alias("ic_std"), (ratio(F.avg("ls_return"), F.stddev_samp("ls_return")) * math.sqrt(DAYS)).alias("sharpe_ratio"), (told(F.avg("ls_return")) * DAYS).alias("long_short_annual_return"),
        F.count_if(F.col("ls_return").isNotNull() & ~ieee.finite(F.col("ls_return"))).alias("n_nonfinite"), told(F.abs(F.min("fall"))).alias("max_drawdown"),
        told(F.avg("traded")).alias("turnover"), F.map_from_entries(F.filter(annual, lambda g: g["annual"].isNotNull())).alias("group_annual_returns"),
    )
    return found.select("ic_mean", "ic_std", ratio(F.col("ic_mean"), F.col("ic_std")).alias("ic_ir"), "sharpe_ratio", "long_short_annual_return", "n_nonfinite", "max_drawdown", "turnover", "group_annual_returns")


def industry_neutral(factor: DataFrame, industry: str, by_date: bool = True) -> DataFrame:
    """Factor values less their industry's mean, on the date or over the whole input; no industry, no change."""
    by = (["date"] if by_date else []) + [industry]
    mean = F.avg("factor_value").over(Window.partitionBy(*by))
    return factor.withColumn("factor_value", F.when(F.col(industry).isNull(), F.col("factor_value")).otherwise(F.col("factor_value") - mean))


def size_neutral(factor: DataFrame, size: str, by_date: bool = True) -> DataFrame:
    """Residual of the factor on an intercept and ``size`` (rows with both), on the date or over the whole input; unchanged where sizes do not vary."""
    both = F.col("factor_value").isNotNull() & F.col(size).isNotNull()
    y, x = F.when(both, F.col("factor_value")), F.when(both, F.col(size).cast("double"))
    spread, mean_x, mean_y = F.var_pop(x), F.avg(x), F.avg(y)
    slope = F.covar_pop(x, y) / F.when(spread > 0, spread)
    if by_date:
        w = Window.partitionBy("date")
        spread, mean_x, mean_y = spread.over(w), mean_x.over(w), mean_y.over(w)
        residual = y - mean_y - F.covar_pop(x, y).over(w) / F.when(spread > 0, spread) * (x - mean_x)
        return factor.withColumn("factor_value", F.coalesce(residual, F.col("factor_value")))
    fit = factor.agg(slope.alias("__slope"), mean_x.alias("__x"), mean_y.alias("__y"))  # one row
    residual = y - F.col("__y") - F.col("__slope") * (x - F.col("__x"))
    return factor.crossJoin(F.broadcast(fit)).withColumn("factor_value", F.coalesce(residual, F.col("factor_value"))).select(*factor.columns)
