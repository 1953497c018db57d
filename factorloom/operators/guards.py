"""Guards: rows that a backtest must not trade on, dropped in a fixed order with counts.

Order: special treatment, suspended, newly listed, at the price limit; then a check that prices are adjusted. The limit is
measured on the rows that are left, so its previous close comes from the survivors. One pass marks each row with the guard
that drops it; the counts are one aggregate of the marks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames, ieee

#: Fixed value: marks of special treatment, wherever they stand in a name or code.
SPECIAL = r"(?i)\*?ST|ST\*|\*ST"


@dataclass(frozen=True)
class GuardSettings:
    special: bool = True
    suspended: bool = True
    new_listing: bool = True
    limit: bool = True
    adjusted: bool = True
    min_list_days: int = 60
    limit_share: float = 0.098
    jump_share: float = 0.3
    most_jumps: float = 0.01


def _special(df: DataFrame) -> Column:
    """True for rows to drop; a null name counts as unknown and is dropped."""
    drop = F.lit(False)
    for name in ("name", "asset"):
        if name in df.columns:
            drop = drop | F.coalesce(F.col(name).cast("string").rlike(SPECIAL), F.lit(True))
    return drop


def _suspended(df: DataFrame) -> Column:
    drop = F.lit(False)
    if "volume" in df.columns:
        drop = drop | ~F.coalesce(F.col("volume") > 0, F.lit(False))
    if "status" in df.columns:
        drop = drop | ~F.coalesce(F.col("status") != "suspended", F.lit(False))
    return drop


def _new(df: DataFrame, days: int) -> Column:
    for name in ("list_date", "ipo_date"):
        if name in df.columns:
            return ~F.coalesce(F.datediff("date", F.to_date(name)) >= days, F.lit(False))
    return F.lit(False)


def marked(panel: DataFrame, settings: GuardSettings = GuardSettings()) -> DataFrame:
    """``panel`` with ``dropped_by``: the first guard that drops the row, null for rows that stay.

    A survivor without a previous close (its asset's first) is dropped as ``no_previous_close``.
    """
    first = F.lit(None).cast("string")
    for name, on, drop in (("new_listing", settings.new_listing, _new(panel, settings.min_list_days)), ("suspended", settings.suspended, _suspended(panel)), ("special", settings.special, _special(panel))):
        if on:
            first = F.when(drop, name).otherwise(first)
    out = panel.withColumn("dropped_by", first)
    if not settings.limit or "close" not in panel.columns:
        return out
    if "pre_close" in panel.columns:
        before = F.col("pre_close")
    else:  # the survivors' history stands apart from the dropped rows'
        before = F.lag("close").over(Window.partitionBy("asset", F.col("dropped_by").isNull()).orderBy("date"))
    move = ieee.div(F.col("close"), before) - 1
    out = out.withColumn("__move", move)
    at_limit = F.when(F.col("__move").isNull(), "no_previous_close").when((F.col("__move") > settings.limit_share) | (F.col("__move") < -settings.limit_share), "limit")
    return out.withColumn("dropped_by", F.coalesce("dropped_by", at_limit)).drop("__move")


def guarded(panel: DataFrame, settings: GuardSettings = GuardSettings()) -> DataFrame:
    """The rows that stay; a given ``pre_close`` is taken away too."""
    return marked(panel, settings).where("dropped_by IS NULL").drop("dropped_by", "pre_close")


def guard_counts(panel: DataFrame, settings: GuardSettings = GuardSettings()) -> DataFrame:
    """One row: rows before and after, and dropped by each guard (an asset's first row is in no guard's count)."""
    rows = marked(panel, settings)
    counts = [F.count_if(F.col("dropped_by") == g).alias(f"dropped_{g}") for g in ("special", "suspended", "new_listing", "limit", "no_previous_close")]
    return rows.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(F.col("dropped_by").isNull()).alias("rows_after"), *counts)


def adjustment_check(panel: DataFrame, settings: GuardSettings = GuardSettings()) -> DataFrame:
    """One row: ``adjusted``, whether an adjustment factor varies, or else few closes jump; and the share of jumps."""
    if "adj_factor" in panel.columns:
        spread = F.coalesce(F.stddev_samp("adj_factor"), F.lit(0.0))
        return panel.agg((spread > 0).alias("adjusted"), F.lit(None).cast("double").alias("jump_share"))
    moves = panel.select(F.abs(ieee.div(F.col("close"), F.lag("close").over(frames.history())) - 1).alias("move")).where("move IS NOT NULL")
    share = F.coalesce(F.count_if(F.col("move") > settings.jump_share) / F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1))), F.lit(0.0))
    return moves.agg((share <= settings.most_jumps).alias("adjusted"), share.alias("jump_share"))
