"""Exact top-k inner-product search by norm-bucketed retrieval.

Candidates are grouped by length into buckets of bounded size (a length that many vectors share is dealt over several
buckets). Queries, in blocks, first meet a bucket of greatest lengths, which gives each a lower bound for its k-th score.
A block of queries goes on to a bucket only if for one of them the bucket's greatest length allows the bound to be reached. In
a bucket, the bound divided by both lengths is the query's local cosine threshold: above 1 the bucket is pruned for the
query (length pruning); where it is high enough to narrow a coordinate, candidates outside the feasible range of the query's
largest coordinates are pruned (coordinate pruning); else lengths decide. Products of what is left are verified exactly in
integers, those of the queries without coordinate pruning as one matrix product.

A bucket travels once to each group of up to ``GROUP`` blocks that visit it: they are sorted behind it, and a task holds one
bucket and one block at a time.

Cases
-----
* vectors that are null, empty, or hold null or non-finite components take no part, as query or candidate
* nor do vectors whose squared integer length passes 2**63; so no product overflows
* vectors of other length than a query's are no candidates of it
* every candidate row counts, repeated ones too; ties go to the smaller id; rows with a query's own id are no candidates of it; a null id takes no part
* every query row is answered, repeated ones each; fewer candidates than k give fewer rows; extra columns are ignored; empty tables give no rows
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage

SCALE = 1024
#: Vectors in a bucket of candidates, and in a block of queries; blocks that visit one copy of a bucket.
BUCKET, BLOCK, GROUP = 4096, 1024, 64
#: Ranges of length; beyond that a range is dealt over more buckets, so their size stays.
MOST_RANGES = 512
#: Local cosine thresholds from which coordinates are worth testing, and how many of them.
COORDINATE_FROM, COORDINATES = 0.4, 3


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, v, dim, norm2``: floor(1024 x) of each usable vector."""
    x = F.transform(F.col(embedding).cast("array<double>"), lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c))
    usable = F.col(vec_id).isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull())
    v = F.transform("x", lambda c: F.floor(c * SCALE))
    rows = vectors.select(F.col(vec_id).cast("long").alias(vec_id), x.alias("x")).where(usable).select(F.col(vec_id).alias("id"), v.alias("v"))
    return rows.select("id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0).cast("long"), lambda s, c: F.try_add(s, F.try_multiply(c, c))).alias("norm2")).where("norm2 IS NOT NULL")


def _numbered(rows: DataFrame, what: str) -> DataFrame:
    """Staged, with a number ``no`` for each row."""
    return stage(rows.select("id", "v", "dim", "norm2").withColumn("no", F.monotonically_increasing_id()), what)


def _bucketed(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``bucket``, 0 for the greatest lengths; bounds come from quantiles of the lengths, and a range with
    more than ``BUCKET`` vectors is dealt over several buckets by row."""
    n = candidates.count()
    ranges = min(MOST_RANGES, max(1, -(-n // BUCKET)))
    cuts = candidates.select(F.percentile_approx("norm2", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    step = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    placed = candidates.withColumn("range", F.size(F.filter(step, lambda c: F.col("norm2") < c)))
    sizes = placed.groupBy("dim", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / BUCKET))
    before = F.coalesce(F.sum("parts").over(Window.partitionBy("dim").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("dim", "range", "parts", before.alias("before"))  # one row a range
    return placed.join(sizes, ["dim", "range"]).withColumn("bucket", F.col("before") + F.pmod(F.xxhash64("no"), F.col("parts"))).drop("parts", "before")


def _packed(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each block: row numbers, ids, the vectors row by row, lengths."""
    items = F.sort_array(F.collect_list(F.struct("norm2", "id", "no", "v")), asc=False)
    packed = rows.groupBy("dim", *keys).agg(items.alias("items"))
    return packed.select(
        "dim", *keys, F.col("items.no").alias("nos"), F.col("items.id").alias("ids"), F.flatten("items.v").alias("flat"), F.col("items.norm2").alias("norms"),
        F.sqrt(F.col("items")[0]["norm2"]).alias("longest"),
    )


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= kth)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _products(c: np.ndarray, q: np.ndarray, reach: float) -> np.ndarray:
    """Integer products of candidate rows with a query, or with several as columns."""
    if reach < 2.0**52:  # every partial sum is an integer that a double holds
        return (c @ q).astype(np.int64)
    return c.astype(np.int64) @ q.astype(np.int64)


def _retrieve(q_ids, q, q_norm, bound, c_ids, c, c_norm, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query: its best candidates of one bucket with scores that reach its bound."""
    longest = float(c_norm.max())
    unit = c / np.maximum(c_norm, 1e-300)[:, None]
    reach = q_norm * longest
    going = bound <= reach * (1 + 1e-9) + 1e-6  # length pruning of the whole bucket
    threshold = np.where(reach > 0, bound / np.maximum(reach, 1e-300), -np.inf)
    narrow = going & (threshold >= COORDINATE_FROM)
    for i in np.flatnonzero(narrow):
        # a cosine of at least t with the query bounds each coordinate of a unit vector
        keep = c_ids != q_ids[i]
        unit_q = q[i] / q_norm[i]
        t = min(1.0, threshold[i])
        for f in np.argsort(-np.abs(unit_q))[:COORDINATES]:
            slack = np.sqrt(max(0.0, (1 - unit_q[f] ** 2) * (1 - t * t))) + 1e-9
            keep &= (unit[:, f] >= unit_q[f] * t - slack) | (unit_q[f] < 0)
            keep &= (unit[:, f] <= unit_q[f] * t + slack) | (unit_q[f] > 0)
        rows = np.flatnonzero(keep)
        scores = _products(c[rows], q[i], reach[i])
        reached = scores >= bound[i]
        scores, rows = scores[reached], rows[reached]
        top = _best(scores, c_ids[rows], k)
        yield i, c_ids[rows][top], scores[top]
    wide = np.flatnonzero(going & ~narrow)
    for a in range(0, len(wide), 128):
        part = wide[a : a + 128]
        # candidates are sorted by length: those too short for the least demanding query of the part come last
        least = np.min(np.where(bound[part] > 0, (bound[part] - 1e-6) / np.maximum(q_norm[part], 1e-300), 0.0))
        n = int(np.searchsorted(-c_norm, -least * (1 - 1e-9), side="right")) if least > 0 else len(c_norm)
        products = _products(c[:n], q[part].T, float(reach[part].max()))
        for col, i in enumerate(part):
            rows = np.flatnonzero((products[:, col] >= bound[i]) & (c_ids[:n] != q_ids[i]))
            top = rows[_best(products[rows, col], c_ids[rows], k)]
            yield i, c_ids[top], products[top, col]


def _search(k: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: a bucket, then the blocks that visit it."""
    here = ids = c = norms = None
    for batch in batches:
        for r in range(batch.num_rows):
            row = {n: batch.column(n)[r] for n in batch.schema.names}
            flat, dim = row["flat"].values.to_numpy(zero_copy_only=False).astype(np.float64), row["dim"].as_py()
            row_ids, lengths = row["ids"].values.to_numpy(zero_copy_only=False), np.sqrt(row["norms"].values.to_numpy(zero_copy_only=False).astype(np.float64))
            place = (dim, row["bucket"].as_py(), row["part"].as_py())
            if not row["bounds"].is_valid:
                here, ids, c, norms = place, row_ids, flat.reshape(-1, dim), lengths
                continue
            if place != here:
                continue  # a bucket without vectors
            nos, out = row["nos"].values.to_numpy(zero_copy_only=False), []
            bounds = row["bounds"].values.to_numpy(zero_copy_only=False)
            for i, hits, scores in _retrieve(row_ids, flat.reshape(-1, dim), lengths, bounds, ids, c, norms, k):
                out.append((np.full(len(hits), nos[i]), np.full(len(hits), row_ids[i]), hits, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["no", "query_id", "vec_id", "score"])


def _meet(goes: DataFrame, blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """What the blocks find in the buckets that ``goes`` (dim, block, bucket) sends them to."""
    goes = goes.withColumn("part", F.floor(F.col("block") / GROUP))
    columns = ["dim", "bucket", "part", "block", "nos", "ids", "flat", "norms", "bounds"]
    visited = goes.select("dim", "bucket", "part").distinct().join(buckets, ["dim", "bucket"])
    visited = visited.withColumns({"block": F.lit(-1).cast("long"), "bounds": F.lit(None).cast("array<double>")}).select(*columns)
    rows = visited.unionByName(goes.join(blocks, ["dim", "block"]).select(*columns))
    place = ["dim", "bucket", "part"]
    rows = rows.repartition(*place).sortWithinPartitions(*place, "block")
    return rows.mapInArrow(lambda b: _search(k, b), "no long, query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k greatest inner products.

    Both tables as ``quantised`` gives them; a query id and a candidate id that are equal are never matched.
    """
    vectors = _numbered(candidates, "vectors")
    buckets = stage(_packed(_bucketed(vectors), "range", "bucket"), "vector-buckets")
    asked = _numbered(queries, "queries")
    n_blocks = max(1, -(-asked.count() // BLOCK))
    blocks = stage(_packed(asked.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(n_blocks))), "block").drop("longest"), "query-blocks")
    discard(vectors, asked)

    lowest = F.lit(float("-inf"))
    first = blocks.withColumn("bounds", F.transform("nos", lambda _: lowest))
    head = stage(_meet(blocks.select("dim", "block", F.lit(0).cast("long").alias("bucket")), first, buckets, k), "top-first")

    # the k-th score of those that have k; the rest keep no bound
    bounds = _ranked(head, k).where(F.col("rank") == k).select("no", F.col("score").cast("double").alias("bound"))
    each = blocks.select("dim", "block", F.posexplode("nos").alias("place", "no")).join(bounds, "no", "left")
    each = each.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("bound", lowest).alias("bound")))).alias("b"))
    bounded = stage(blocks.join(each.select("dim", "block", F.col("b.bound").alias("bounds")), ["dim", "block"]), "query-bounds")
    # least length that a bucket must have for one of the block's queries
    needs = F.array_min(F.zip_with("bounds", "norms", lambda b, n: F.when(b <= 0, F.lit(0.0)).when(n > 0, b / F.sqrt(n)).otherwise(F.lit(float("inf")))))
    # at most MOST_RANGES rows for each dimension, each with its run of buckets
    ranges = buckets.groupBy("dim", "range").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.max("longest").alias("longest"))
    goes = bounded.select("dim", "block", needs.alias("needs")).join(ranges, "dim").where(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("needs"))
    goes = goes.select("dim", "block", F.explode(F.sequence("low", "high")).alias("bucket")).where("bucket > 0")
    rest = _meet(goes, bounded, buckets, k)
    return _ranked(head.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
