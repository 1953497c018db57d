"""Helpers shared by the corpus operators: table access, shared scratch space, staging."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator that counts words defines it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a private one only where that is unset on a local master (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="factorloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{scratch(spark)}/{spark.sparkContext.applicationId}-{what}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where it does not exist."""
    fs, p = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone; the shared folder has its own retention then
            return


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage so that what was
    computed outlives lost executors, and is not computed twice."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that only fed tables staged since."""
    for df in staged:
        delete(df.sparkSession, df.staged_at)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
