"""A keyed table on shared storage: upserts rewrite the buckets that they touch, and one new manifest makes them visible.

A table is a folder. Rows live in buckets by the hash of their key; a manifest, numbered, names the folder of each bucket and the batches
applied so far. An upsert reads the touched buckets alone, writes their next state beside them, and then renames the next manifest into
place, which is the only step that readers see. A job that dies before it leaves files that no manifest names; run again it does the whole
batch, and after it, nothing, as the manifest has the batch's name. Of two jobs that apply batches at a time one fails to take the next number.

Cases
-----
* of a batch's rows with one key the one that comes last by ``order`` stays (ties: by all its columns); null keys are a key like others
* an empty batch is a batch: it is noted, and touches nothing; an empty table can be read
* columns are those of the first batch; a batch that lacks some or has others is refused
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PanelError

BUCKET = "bucket__"


class KeyedTable:
    """The table in ``path`` with one row for each value of ``key``. ``buckets`` counts for a new table only: a few hundred MB each."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._new_buckets = buckets

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._hadoop(folder))] if self._fs.exists(self._hadoop(folder)) else []

    def manifest(self) -> dict:
        """The newest one: ``number, buckets, schema, folders`` (of each bucket that has rows) and ``batches``."""
        numbers = [int(n.removeprefix("manifest-")) for n in self._names(self.path) if n.startswith("manifest-")]
        if not numbers:
            return {"number": 0, "buckets": self._new_buckets, "schema": None, "folders": {}, "batches": []}
        stream = self._fs.open(self._hadoop(f"{self.path}/manifest-{max(numbers):08}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        pending, target = (self._hadoop(f"{self.path}/{n}") for n in (f"pending-{uuid.uuid4().hex[:12]}", f"manifest-{manifest['number']:08}"))
        stream = self._fs.create(pending, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(pending, target):
            self._fs.delete(pending, False)
            raise PanelError(f"another batch was applied to {self.path} meanwhile")

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{f}" for b, f in sorted(manifest["folders"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows, as of now: later batches do not change what was read."""
        manifest = self.manifest()
        if manifest["schema"] is None:
            raise PanelError(f"there is no table in {self.path} yet")
        return self._read(manifest)

    def _bucket_of(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(manifest["buckets"])).cast("int")

    def upsert(self, rows: DataFrame, batch: str, order: str | None = None) -> bool:
        """Put ``rows`` in the place of those with their keys, and add the others; whether there was anything left to do for ``batch``."""
        manifest = self.manifest()
        if batch in manifest["batches"]:
            return False
        columns = sorted(rows.columns)
        if manifest["schema"] is not None and sorted(f["name"] for f in manifest["schema"]["fields"]) != columns:
            raise PanelError(f"the batch's columns are not those of {self.path}")
        schema = T.StructType.fromJson(manifest["schema"]) if manifest["schema"] else T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        rank = F.struct(*([order] if order else []), *[f.name for f in schema if f.name != order])
        latest = rows.groupBy(F.col(self.key).alias("key__")).agg(F.max(rank).alias("row__")).select(*(F.col(f"row__.{f.name}").cast(f.dataType).alias(f.name) for f in schema))
        folder = f"data/{manifest['number'] + 1:08}-{uuid.uuid4().hex[:12]}"
        incoming = f"{self.path}/{folder}/batch"
        latest.withColumn(BUCKET, self._bucket_of(manifest)).write.parquet(incoming)
        fresh = self.spark.read.parquet(incoming)
        touched = {r[0] for r in fresh.select(BUCKET).distinct().toLocalIterator()}  # no more than there are buckets
        if touched:
            old = self._read({**manifest, "schema": schema.jsonValue()}, touched).alias("o")
            kept = old.join(fresh.select(F.col(self.key).alias("key__")), F.col(f"o.{self.key}").eqNullSafe(F.col("key__")), "left_anti")
            merged = kept.withColumn(BUCKET, self._bucket_of(manifest)).unionByName(fresh)
            merged.repartition(len(touched), BUCKET).sortWithinPartitions(BUCKET, self.key).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}/rows")
        self._fs.delete(self._hadoop(incoming), True)
        folders = manifest["folders"] | {str(b): f"{folder}/rows/{BUCKET}={b}" for b in touched}
        self._publish({**manifest, "number": manifest["number"] + 1, "schema": schema.jsonValue(), "folders": folders, "batches": [*manifest["batches"], batch]})
        return True

    def vacuum(self) -> int:
        """Delete what the newest manifest does not name (earlier states, and what dead jobs left), and count it; readers of earlier states must be done."""
        manifest = self.manifest()
        named = {f.split("/")[1]: set() for f in manifest["folders"].values()}
        for f in manifest["folders"].values():
            named[f.split("/")[1]].add(f.split("/")[3])
        gone = [f"{self.path}/{n}" for n in self._names(self.path) if n.startswith("pending-") or (n.startswith("manifest-") and int(n.removeprefix("manifest-")) < manifest["number"])]
        for state in self._names(f"{self.path}/data"):
            if state not in named:
                gone.append(f"{self.path}/data/{state}")
            else:
                gone += [f"{self.path}/data/{state}/rows/{n}" for n in self._names(f"{self.path}/data/{state}/rows") if n.startswith(BUCKET) and n not in named[state]]
        for path in gone:
            self._fs.delete(self._hadoop(path), True)
        return len(gone)


def page_results(pages: DataFrame, table: KeyedTable, process: Callable[[DataFrame], DataFrame], batch: str, settings: str = "") -> DataFrame:
    """``pages`` with the columns of ``process``, computed only for contents that ``table`` (keyed by ``content_key``) has no result of yet.

    A content's key is the digest of ``settings`` and the page's text, so that other settings are other results. ``process`` gets the new contents, each
    once (``content_key, text``), and returns ``content_key`` with its results, which are stored under ``batch``. Pages that are gone are not
    in the answer; what is stored for them is found again if they return. A run that died is run again by the same batch name.
    """
    keyed = pages.withColumn("content_key", F.sha2(F.concat_ws("\n", F.lit(settings), F.coalesce("text", F.lit(""))), 256))
    contents = keyed.groupBy("content_key").agg(F.first("text").alias("text"))
    if table.manifest()["schema"] is not None:
        contents = contents.join(table.read().select("content_key"), "content_key", "left_anti")
    table.upsert(process(contents), batch)
    return keyed.join(table.read(), "content_key").drop("content_key")
