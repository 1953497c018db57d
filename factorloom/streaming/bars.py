"""Daily bars from a stream of ticks: the batch resample as an incremental aggregation with bounded state.

A bar's state is four extremes and two sums, whatever the number of ticks. Late ticks are taken until the watermark has passed
their day, and its bars' state goes then. In append mode a day's bars come out once, after that; in update mode each time they change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def daily_bars(ticks: DataFrame, asset: Column, time: Column, price: Column, order: list[Column], late: str = "1 day") -> DataFrame:
    """Streaming ``date, asset, open, high, low, close, volume, amount``."""
    rows = ticks.select(asset.alias("asset"), time.cast("timestamp").alias("time"), price.cast("double").alias("price"), F.struct(time, *order).alias("at"))
    rows = rows.where("price IS NOT NULL AND asset IS NOT NULL AND time IS NOT NULL").withWatermark("time", late)
    bars = rows.groupBy(F.window("time", "1 day").alias("day"), "asset").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.sum("price").alias("volume"), F.count(F.lit(1)).cast("double").alias("amount"),
    )
    return bars.select(F.to_date("day.start").alias("date"), "asset", "open", "high", "low", "close", "volume", "amount")


def run_to_end(bars: DataFrame, path: str) -> DataFrame:
    """Read all that is there, keep the bars that each batch changed under ``path`` (a shared folder), and return every bar's last state as a batch.
    A batch that is run again replaces its own files; a later run goes on from where this one stopped."""
    spark = bars.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/bars/batch={batch_id}")

    query = bars.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    kept = spark.read.schema(StructType([*bars.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/bars")
    values = F.struct(*[c for c in bars.columns if c not in ("date", "asset")])
    return kept.groupBy("date", "asset").agg(F.max_by(values, "batch").alias("bar")).select("date", "asset", "bar.*")
