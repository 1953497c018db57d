"""The factor catalogue: identity, versions, redundancy, filters, classification, experience. Tables and joins.

Factors are rows ``id, name, name_cn, formula, fields array<string>, style, status, version, tags array<string>, report_id, created_at``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..session import staged

# Words that mark a style or mechanism, first hit wins, in this order.
STYLES = (
    ("momentum", ("动量", "momentum", "ret", "return", "涨跌")),
    ("value", ("估值", "value", "pe", "pb", "市盈率", "市净率")),
    ("quality", ("质量", "quality", "roe", "roa", "盈利")),
    ("volatility", ("波动", "volatility", "vol", "std")),
    ("liquidity", ("流动性", "liquidity", "turnover", "换手", "成交")),
    ("size", ("市值", "size", "cap", "规模")),
    ("growth", ("成长", "growth", "增长", "yoy")),
    ("technical", ("ma", "macd", "rsi", "boll", "kdj", "技术", "technical")),
    ("macro", ("gdp", "cpi", "pmi", "宏观", "macro")),
)
MECHANISMS = (
    ("momentum", ("mom", "动量", "momentum", "趋势", "continuation")),
    ("reversal", ("rev", "反转", "reversal", "mean reversion", "均值回复")),
    ("value", ("value", "估值", "pe", "pb", "ps", "估值类")),
    ("growth", ("growth", "成长", "营收增长")),
    ("quality", ("quality", "质量", "roe", "roa")),
    ("size", ("size", "市值", "小盘")),
    ("volatility", ("vol", "波动", "volatility", "振幅")),
    ("liquidity", ("liq", "流动性", "换手", "turnover", "illiquid")),
    ("price_volume", ("量价", "price.volume", "价量", "volume.price")),
    ("macro", ("macro", "宏观", "利率", "industry")),
    ("technical", ("technical", "技术", "rsi", "macd", "boll")),
)
FUNDAMENTAL_TYPES = ("fundamental", "macro")
PRICE_TYPES = ("price", "volume", "derived")


def _first_hit(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    low = F.lower(text)
    out = F.lit("other")
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def style_of(*texts: Column) -> Column:
    """Style by the first rule with a word in the texts; ``other`` if none has."""
    return _first_hit(F.concat_ws(" ", *texts), STYLES)


def mechanism_of(*texts: Column) -> Column:
    return _first_hit(F.concat_ws(" ", *texts), MECHANISMS)


def eligibility(types: Column, source: Column) -> Column:
    """``drop`` where a local source cannot have the types of the inputs, else ``keep``."""
    hard = F.arrays_overlap(types, F.array(*[F.lit(t) for t in FUNDAMENTAL_TYPES]))
    return F.when(F.coalesce(hard, F.lit(False)) & (source == "local"), "drop").otherwise("keep")


def identity(formula: Column, fields: Column) -> Column:
    """Digest of a formula and its fields in any order."""
    return F.sha2(F.concat(formula, F.lit("|"), F.array_join(F.array_sort(fields), ",")), 256)


def short_key(*parts: Column) -> Column:
    """Sixteen digits of the digest of parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def bumped(version: Column, part: str = "patch") -> Column:
    """The next version; what is no ``major.minor.patch`` counts as 1.0.0."""
    numbers = F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.split(version, r"\.").cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(0), F.lit(0)))
    major, minor, patch = (F.get(numbers, k) for k in range(3))
    nexts = {"major": (major + 1, F.lit(0), F.lit(0)), "minor": (major, minor + 1, F.lit(0)), "patch": (major, minor, patch + 1)}
    return F.concat_ws(".", *[x.cast("string") for x in nexts[part]])


def register(catalogue: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalogue after registering factors: one with a known identity keeps the known id and gets the next patch version, others
    are added at 1.0.0; of several incoming with one identity the last by ``created_at`` counts."""
    known = catalogue.withColumn("dedup_hash", identity(F.col("formula"), F.col("fields")))
    newest = Window.partitionBy("dedup_hash").orderBy(F.desc("created_at"), F.desc("id"))
    fresh = incoming.withColumn("dedup_hash", identity(F.col("formula"), F.col("fields"))).withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k")
    old = known.select("dedup_hash", F.col("id").alias("__id"), F.col("version").alias("__version"))
    fresh = fresh.join(old, "dedup_hash", "left")
    fresh = fresh.withColumn("version", F.when(F.col("__id").isNull(), "1.0.0").otherwise(bumped(F.col("__version")))).withColumn("id", F.coalesce("__id", "id")).drop("__id", "__version")
    return known.join(fresh.select("dedup_hash"), "dedup_hash", "left_anti").unionByName(fresh, allowMissingColumns=True)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what an upsert by key leaves."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k")


#: Factors of a block at most: a block pair's moments are seven squares of this side.
GRAM_BLOCK = 256


def _scattered(column: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``(pos, x)`` lists as dense rows of ``side`` values, 0 where there is none or NaN, where there is one, and where it is NaN."""
    offsets, flat = column.offsets.to_numpy(), column.values
    first, last = offsets[0], offsets[-1]
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    pos, x = (flat.field(k).to_numpy()[first:last] for k in (0, 1))
    dense, there, odd = (np.zeros((len(column), side)) for _ in range(3))
    none = np.isnan(x)
    dense[rows, pos], there[rows, pos], odd[rows, pos] = np.where(none, 0.0, x), 1.0, none
    return dense, there, odd


def _moments(side: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of each pair of blocks, from rows sorted by block pair: one pair's sums are held at a time."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block[0]], pa.int32()), pa.array([block[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["bi", "bj", "moments"])

    block, total = None, None
    for batch in batches:
        bi, bj = batch.column("bi").to_numpy(), batch.column("bj").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]).tolist() if len(bi) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(bi)]):
            if (bi[lo], bj[lo]) != block:
                if block is not None:
                    yield out()
                block, total = (bi[lo], bj[lo]), np.zeros((7, side, side))
            for a in range(lo, hi, 2000):
                part = batch.slice(a, min(2000, hi - a))
                (x, mx, ox), (y, my, oy) = (_scattered(part.column(c), side) for c in ("left", "right"))
                total[:6] += np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y])
                if ox.any() or oy.any():
                    total[6] += ox.T @ my + mx.T @ oy
    if block is not None:
        yield out()


def _best_in_block(least_rows: int, side: int, undefined: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From parts of block pairs' moments, sorted by pair: of each factor the known one in the block that it correlates with most; with ``undefined`` a correlation of NaN is more than any number."""

    def best() -> pa.RecordBatch:
        n, sx, sy, sxx, syy, sxy, odd = total
        with np.errstate(all="ignore"):
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            r = np.abs((sxy - sx * sy / n) / np.sqrt(vx * vy))
            # what is left of a constant by rounding is no variance
            defined = (n >= least_rows) & (vx > 1e-14 * sxx) & (vy > 1e-14 * syy) & np.isfinite(r) & (odd == 0)
        # ties in all but rounding go to the first known factor
        r = np.where(defined, np.minimum(np.round(r, 12), 1.0), np.where(undefined & (n >= least_rows), 2.0, -1.0))
        i = np.arange(side) + block[0] * side
        top = []
        for skip in (False, True):  # the best, and the best but for that one, which may be the factor itself
            j = r.argmax(axis=1)
            top.append((j + block[1] * side, r.max(axis=1), n[np.arange(side), j]))
            r[np.arange(side), j] = -1.0
        j, c, k = (np.concatenate(x) for x in zip(*top))
        keep = c >= 0
        c = np.where(c > 1, np.nan, c)
        return pa.RecordBatch.from_arrays([pa.array(np.tile(i, 2)[keep].astype(np.int32)), pa.array(j[keep].astype(np.int32)), pa.array(k[keep].astype(np.int64)), pa.array(c[keep])], ["i", "j", "n", "correlation"])

    block, total = None, None
    for batch in batches:
        for bi, bj, moments in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "moments"))):
            if (bi, bj) != block:
                if block is not None:
                    yield best()
                block, total = (bi, bj), np.zeros((7, side, side))
            total += np.frombuffer(moments).reshape(7, side, side)
    if block is not None:
        yield best()


def redundancy(values: DataFrame, known: DataFrame, least_rows: int = 10, most: float = 0.7, undefined: bool = False) -> DataFrame:
    """``factor, known_factor, n, correlation, redundant``: of each factor the known one it correlates with most, pooled over dates
    and assets. ``values`` and ``known``: ``factor, date, asset, factor_value``, each factor once a date and asset; values that are not finite are left out, and so are undefined correlations (of constants).

    With ``undefined`` they count as in SQL: a value that is not finite makes each correlation NaN that it takes part in, and NaN, being more than any number, comes first and is redundant.

    No pairs of values are formed. Factors are numbered and dealt into blocks; each date and asset has one list of values a block, and a pair of
    blocks is six matrix products over these rows, summed by task and then by pair. Values are centred first, so that sums of squares lose nothing.
    """
    spark = values.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def numbered(rows: DataFrame) -> DataFrame:
        means = rows.groupBy("factor").agg(F.coalesce(F.avg(F.when(ieee.finite(F.col("factor_value")), F.col("factor_value"))), F.lit(0.0)).alias("mean"))
        return staged(means.withColumn("k", F.row_number().over(Window.orderBy("factor")) - 1), "factor-numbers")  # one row a factor

    def blocks(rows: DataFrame, numbers: DataFrame, block: str, name: str) -> DataFrame:
        item = F.struct((F.col("k") % side).alias("pos"), F.when(ieee.finite(F.col("factor_value")), F.col("factor_value") - F.col("mean")).otherwise(float("nan")).alias("x"))
        placed = rows.join(numbers, "factor").select("date", "asset", F.floor(F.col("k") / side).cast("int").alias(block), item.alias("item"))
        return placed.groupBy("date", "asset", block).agg(F.collect_list("item").alias(name))

    left, right = (df.select("factor", "date", "asset", F.col("factor_value").cast("double").alias("factor_value")).where(F.col("factor_value").isNotNull() if undefined else ieee.finite(F.col("factor_value"))) for df in (values, known))
    left_no, right_no = numbered(left), numbered(right)
    side = max(1, min(GRAM_BLOCK, max(left_no.count(), right_no.count())))
    pairs = blocks(left, left_no, "bi", "left").join(blocks(right, right_no, "bj", "right"), ["date", "asset"])
    share = F.pmod(F.xxhash64("date", "asset"), F.lit(shares))
    parts = pairs.repartition(shares, "bi", "bj", share).sortWithinPartitions("bi", "bj").select("bi", "bj", "left", "right").mapInArrow(partial(_moments, side), "bi int, bj int, moments binary")
    found = parts.repartition(shares, "bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(partial(_best_in_block, least_rows, side, undefined), "i int, j int, n long, correlation double")
    named = found.join(left_no.select(F.col("k").alias("i"), "factor"), "i").join(right_no.select(F.col("k").alias("j"), F.col("factor").alias("known_factor")), "j").where("factor <> known_factor")
    best = Window.partitionBy("factor").orderBy(F.desc("correlation"), "known_factor")
    first = named.withColumn("__k", F.row_number().over(best)).where("__k = 1")
    return first.select("factor", "known_factor", "n", "correlation", (F.col("correlation") > most).alias("redundant"))


def filtered(catalogue: DataFrame, status: str | None = None, style: str | None = None, tags: Sequence[str] = (), broker: str | None = None, reports: DataFrame | None = None) -> DataFrame:
    """Factors by status, style, all of some tags, and their report's broker."""
    out = catalogue
    for name, value in (("status", status), ("style", style)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if tags:
        out = out.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0)
    if broker is not None:
        if reports is None:
            raise ValueError("a filter by broker needs the reports")
        out = out.join(reports.where(F.col("broker") == broker).select(F.col("id").alias("report_id")), "report_id", "left_semi")
    return out


def search(catalogue: DataFrame, text: str) -> DataFrame:
    """Factors with a text in their names or style, in any case."""
    hit = F.lit(False)
    for name in ("name", "name_cn", "style"):
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(text.lower()), F.lit(False))
    return catalogue.where(hit)


def next_in_queue(queue: DataFrame) -> DataFrame:
    """The oldest pending entry."""
    return queue.where("status = 'pending'").orderBy("created_at", "id").limit(1)


def counts(catalogue: DataFrame, by: str = "style") -> DataFrame:
    return catalogue.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def template_of(formula: Column) -> Column:
    """A formula with its whole numbers as N and without white space."""
    return F.regexp_replace(F.regexp_replace(formula, r"\b[0-9]+\b", "N"), r"\s+", "")


def _patterns(runs: DataFrame) -> DataFrame:
    named = runs.withColumn("template", template_of(F.col("formula"))).withColumn("fields", F.array_sort("fields"))
    return named.withColumn("key", short_key(F.col("template"), F.array_join("fields", ",")))


def experience(runs: DataFrame) -> DataFrame:
    """``key, template, fields, avg_ic, n_successes, n_reports`` of runs ``formula, fields, ic, report_id``, by template and fields. Sums by report come first, so
    that no task holds the reports of a pattern that very many runs share; ``experience_reports`` has them as rows."""
    by_report = _patterns(runs).groupBy("key", "report_id").agg(F.min("template").alias("template"), F.min("fields").alias("fields"), F.sum("ic").alias("ic"), F.count("ic").alias("n_ic"), F.count(F.lit(1)).alias("n"))
    n_ic = F.sum("n_ic")
    return by_report.groupBy("key").agg(
        F.min("template").alias("template"), F.min("fields").alias("fields"), (F.sum("ic") / F.when(n_ic > 0, n_ic)).alias("avg_ic"), F.sum("n").alias("n_successes"), F.count("report_id").alias("n_reports")
    )


def experience_reports(runs: DataFrame) -> DataFrame:
    """``key, report_id``: the reports of each pattern of ``experience``, each once."""
    return _patterns(runs).where("report_id IS NOT NULL").select("key", "report_id").distinct()


def similar(patterns: DataFrame, formula: str, fields: Sequence[str], k: int = 5) -> DataFrame:
    """The k patterns most similar to a formula: 0.6 for its template (0.7 of it for a part) and 0.4 for shared fields."""
    mine = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
    template = template_of(F.lit(formula))
    alike = F.when(F.col("template") == template, 1.0).when(F.col("template").contains(template) | template.contains(F.col("template")), 0.7).otherwise(0.0)
    shared = F.size(F.array_intersect("fields", mine)) / F.greatest(F.size(F.array_union("fields", mine)), F.lit(1))
    scored = patterns.withColumn("score", 0.6 * alike + 0.4 * shared).where("score > 0")
    return scored.orderBy(F.desc("score"), "key").limit(k)


def merged_specs(specs: DataFrame) -> DataFrame:
    """One spec for each name (lower case, without white space; the other name if empty): the most confident, then the longest formula,
    then the first. ``specs``: ``seq, name, name_cn, formula, confidence``."""
    squeezed = [F.regexp_replace(F.lower(F.coalesce(n, F.lit(""))), r"\s+", "") for n in (F.col("name"), F.col("name_cn"))]
    key = F.when(squeezed[0] != "", squeezed[0]).when(squeezed[1] != "", squeezed[1]).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string")))
    best = Window.partitionBy("key").orderBy(F.desc("confidence"), F.desc(F.length(F.coalesce("formula", F.lit("")))), "seq")
    return specs.withColumn("key", key).withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")


def distinct_articles(articles: DataFrame, head: int = 1200) -> DataFrame:
    """``articles`` (``id, text``) without re-uploads: of those with equal first ``head`` characters other than white space the least id."""
    mark = F.sha1(F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""), 1, head))
    return articles.withColumn("fingerprint", mark).groupBy("fingerprint").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"))


def merged_lists(rows: DataFrame, key: str, order: str, *lists: str) -> DataFrame:
    """Upsert of list columns: of each key the different items in order of first appearance."""
    out = []
    for c in lists:
        in_order = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))
        out.append(F.array_distinct(F.flatten(F.transform(in_order, lambda x: x["v"]))).alias(c))
    return rows.groupBy(key).agg(*out)


def term_mappings(seen: DataFrame) -> DataFrame:
    """``term, canonical, confidence, n`` of observed ``term, canonical, confidence``: by lower-case term, the greatest confidence, the
    first canonical form."""
    return seen.groupBy(F.lower("term").alias("term")).agg(F.min_by("canonical", "seq").alias("canonical"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
