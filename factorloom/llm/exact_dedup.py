"""Exact dedup over a persistent digest index, bucketed and sorted by digest.

The index is a table ``(digest, keep_id, batch)`` laid out in hash buckets with each bucket sorted, so a batch is
compared with it by a sort-merge anti-join that never shuffles the index: only the batch's own groups move. What the anti-join
leaves is appended. A report then looks every row up in the index, whatever was appended before it.

An index lives in a folder. Its files stand in generations, ``g<number>-<buckets>``; the newest one that was written to its end counts. Appending
again after a job died adds only what is missing, and the batch's name tells which rows are its own, so a batch may be rerun at any
point with the same report. Compacting writes the next generation beside the present one.

Cases
-----
* null text counts as empty; texts are equal when identical after lower-casing A-Z only
* of equal texts in one batch the row with the largest doc_id stays; a null doc_id is below every other
* a text that another batch brought to the index is dropped in favour of the indexed row, also where the doc_id is the same
* rows repeated with the same doc_id and text: the first copy is kept, each is reported
* an empty table gives an empty report; columns besides doc_id and text are ignored
* one job at a time may append to an index
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import children, delete, discard, parallelism, scratch_path, spare, stage, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS = "digest BINARY, keep_id BIGINT, batch STRING"


def digest_of(name: str = "text") -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.translate(text_or_empty(name), UPPER, LOWER), 256))


def members_of(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, copies``: the different (doc_id, text) rows of a batch, staged."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest"))
    return stage(rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")), "digests")


class DigestIndex:
    """A persistent index of the digests already kept, in the folder ``path``.

    ``buckets`` counts for a new index only; choose it for the corpus the index will come to hold (a few hundred MB a
    bucket), not for one batch.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._generations()
        self.generation, self.buckets = found[-1] if found else (0, buckets or parallelism(spark))
        self._register()
        if not found:
            self._write(spark.createDataFrame([], ROWS))

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int | None = None) -> DigestIndex:
        """An index for one run, under the scratch folder; it goes with the driver."""
        return cls(spark, scratch_path(spark, "digest-index"), buckets)

    def _generations(self) -> list[tuple[int, int]]:
        """Number and buckets of the generations that were written to their end."""
        names = [n for n in children(self.spark, self.path) if n.startswith("g")]
        ended = [n for n in names if "_SUCCESS" in children(self.spark, f"{self.path}/{n}")]
        return sorted(tuple(map(int, n[1:].split("-"))) for n in ended)

    def _folder(self) -> str:
        return f"{self.path}/g{self.generation:05}-{self.buckets}"

    def _register(self) -> None:
        """A table for the folder's files, in this session's catalogue."""
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.name} ({ROWS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(self.buckets)} BUCKETS LOCATION '{self._folder()}'"
        )

    def close(self) -> None:
        """Take the table out of the catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _write(self, rows: DataFrame) -> None:
        (rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, members: DataFrame, batch: str) -> None:
        """Bring the digests of ``members_of`` a batch that the index lacks into it, each with its largest doc_id."""
        groups = stage(members.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "digest-groups")
        new = stage(groups.repartition(self.buckets, "digest").hint("merge").join(self.table().select("digest"), "digest", "left_anti"), "digests-new")
        self._write(new.withColumn("batch", F.lit(batch)))
        discard(groups, new)

    def report(self, members: DataFrame, batches: Sequence[str]) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, digest`` of every row behind ``members``, after they were appended under the names ``batches``."""
        # staged, so that copies are summed before the join and a digest with a third of all rows is split at run time
        sizes = stage(members.groupBy("digest").agg(F.sum("copies").alias("group_size")), "digest-sizes")
        own = F.col("batch").isin(*batches)
        resolved = sizes.repartition(self.buckets, "digest").hint("merge").join(self.table(), "digest")
        resolved = stage(resolved.select("digest", "keep_id", "group_size", own.alias("own")), "digests-resolved")
        wins = F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
        joined = members.hint("merge").join(resolved, "digest").select("doc_id", "keep_id", "group_size", wins.alias("wins"), "digest", copy.alias("copy"))
        return joined.select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("copy") == 1)).alias("kept"), "digest")

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Dedup a batch against the index and itself, append what is new, report every row. Rerun under the same name ``batch``, a batch
        that was appended wholly or in part gives the same report."""
        batch = batch or uuid.uuid4().hex
        members = members_of(docs)
        self.append(members, batch)
        return self.report(members, [batch])

    def compact(self) -> None:
        """Rewrite the appended files as one sorted file a bucket, in the next generation, and drop older ones once it is there."""
        rows, old = self.table(), self.name
        self.generation += 1
        delete(self.spark, self._folder())  # of an attempt that died
        self._register()
        self._write(rows)
        self.spark.sql(f"DROP TABLE {old}")
        for name in children(self.spark, self.path):
            if name.startswith("g") and f"{self.path}/{name}" != self._folder():
                delete(self.spark, f"{self.path}/{name}")


def dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` of every row of ``docs``: they go into a fresh index in ``batches`` batches, cut at quantiles of
    doc_id, the largest doc_ids first (null last), so that what came with an earlier batch is kept out of the later ones by the index."""
    spark = docs.sparkSession
    members = members_of(docs)
    cuts = members.select(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)] or [0.5], 1000)).first()[0] or []
    no = sum((F.when(F.col("doc_id") > c, 0).otherwise(1) for c in cuts[: batches - 1]), F.lit(0))
    no = F.coalesce(no, F.lit(0)) + F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(0)
    index = DigestIndex.fresh(spark)
    names = [f"{k:03}" for k in range(len(cuts[: batches - 1]) + 1)]
    for k, name in enumerate(names):
        index.append(members.where(F.least(no, F.lit(len(names) - 1)) == k), name)
    return index.report(members, names)


def keep_first(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: against ``index``, or among themselves alone."""
    absent = F.lit(-(2**63))
    report = index.add(docs, batch) if index else dedup(docs)
    digest, id_, no_id, copy = keys = spare(docs, "digest", "id", "no_id", "copy")
    kept = report.where("kept").select(F.col("digest").alias(digest), F.coalesce("doc_id", absent).alias(id_), F.col("doc_id").isNull().alias(no_id))
    doc_id = F.col("doc_id").cast("long")
    tagged = docs.withColumns({digest: digest_of(), id_: F.coalesce(doc_id, absent), no_id: doc_id.isNull()})
    # what is left repeats only as whole (doc_id, text) rows; the window shares the join's partitioning
    first = Window.partitionBy(*keys[:3]).orderBy(id_)
    out = tagged.join(kept.hint("merge"), keys[:3], "left_semi").withColumn(copy, F.row_number().over(first))
    return out.where(F.col(copy) == 1).select(*docs.columns)
