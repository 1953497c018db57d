"""Spark sessions with the settings that the engine is designed for."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: ANSI mode stays on: division by zero and the like are expressed explicitly (``factorloom.functions.ieee``).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "factorloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session; ``settings`` with dots written as double underscores override the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone; the shared folder has its own retention then
            return


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path under the folder of ``spark.checkpoint.dir``, deleted when the driver ends; under a private folder only where that is unset on a local master (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="factorloom-")
        spark.sparkContext.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what several branches of a plan read is computed once, and outlives lost executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
