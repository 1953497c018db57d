"""Bars from ticks: first, highest, lowest and last price and summed volume of each asset and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bars(ticks: DataFrame, asset: Column, date: Column, price: Column, order: list[Column], volume: Column | None = None, in_order: bool = False) -> DataFrame:
    """A panel of bars. ``order``: what orders ticks within a period; must tell any two ticks apart.

    One grouped aggregation with partial sums, so an asset with most of the ticks costs no more than another.

    ``in_order``: volumes are added up in the ticks' order, for sizes with fractions, whose sums else depend in their last digits on how the input was cut,
    and with them ranks by volume. Where the volume is asked for, the ticks are then sorted by bar; a bar's ticks stream through one task, which spills and holds no bar whole.
    """
    at = F.struct(*order)
    rows = ticks.select(asset.alias("asset"), date.alias("date"), price.cast("double").alias("price"), at.alias("at"), (volume if volume is not None else price).cast("double").alias("size"))
    rows = rows.where("price IS NOT NULL AND asset IS NOT NULL AND date IS NOT NULL")
    total = F.sum("size")
    if in_order:
        upto = Window.partitionBy("date", "asset").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        rows, total = rows.withColumn("upto", F.sum("size").over(upto)), F.max_by("upto", "at")
    return rows.groupBy("date", "asset").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        total.alias("volume"), F.count(F.lit(1)).cast("double").alias("amount"),
    )


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as assets, days as dates, event values as prices."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars(events, F.col("user_id").cast("string"), F.to_date("ts"), F.col("value"), [F.col("ts"), F.col("event_id")], in_order=True)


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as assets, shipping months as dates, unit prices as prices, quantities as volume."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")]
    month = F.trunc(F.to_date("l_shipdate"), "month")
    return bars(lines, F.col("l_suppkey").cast("string"), month, F.col("l_extendedprice") / F.col("l_quantity"), order, F.col("l_quantity"))
