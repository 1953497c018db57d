"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ieee
from ..session import scratch_path
from ..streaming.bars import daily_bars, run_to_end
from . import query
from .sql import EVENTS_PANEL


@query("stream_daily_bars", f"WITH {EVENTS_PANEL} SELECT date, asset, open, high, low, close, round(volume, 6) AS volume, amount FROM panel")
def stream_daily_bars(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    bars = daily_bars(events, F.col("user_id").cast("string"), F.col("ts"), F.col("value"), [F.col("event_id")])
    return run_to_end(bars, scratch_path(spark, "bars")).withColumn("volume", ieee.rounded(F.col("volume"), 6))
