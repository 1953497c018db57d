"""MinHash near-dedup on weighted shingles: ProbMinHash sketches, banding, exact verification, components.

A document is the multiset of its runs of five words (lower case; a shorter text is one run). Each distinct shingle is the
source of a Poisson process with its count as rate; an arrival falls on one of ``BANDS * ROWS`` registers, a register keeps the
shingle that arrives first. A shingle whose next arrival is later than every register's first is done: early
termination. Registers of two documents agree with the probability Jaccard similarity
J_P = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i), which is the plain Jaccard similarity for sets.

Bands of registers deal documents into buckets. Texts with the same words are one class and are sketched and compared once.
In two steps no bucket is expanded into all its pairs:

1. every member is verified against the bucket's centre, the member that shares most buckets with others; verified links
   are joined to components
2. members that are not in their centre's component are compared with all members of other components in their bucket, in
   blocks, each pair in the first bucket that it shares; who has come into a component within the block is not compared again

Pairs of J_P = 0.8 share no band with probability 6e-7: the only links that can be missed. Verification is exact. ``least_bands`` above 1 lets
step 2 pass over pairs that share fewer bands.

Cases
-----
* null text counts as empty; all texts without words are one class
* null doc_ids stand in classes but never name one unless no member has a doc_id (then the class id is null)
* rows of one doc_id with unrelated texts are in different classes; where it is the least of both, both have it as class_id, and
  only their labels tell them apart (``keep_one`` goes by labels and keeps a row of each)
* repeated rows and ties are members of one class; an empty table gives an empty report; other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, spare, stage, text_or_empty
from .components import components

SHINGLE = 5
BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
#: Words sketched at a time, and members of one side of a block in step 2.
SLICE_WORDS = 1_000_000
BLOCK = 512
#: Profiles of texts that a worker keeps while it goes through blocks.
PROFILES = 5_000

# Odd multipliers of a public 64-bit mixing function.
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(name: str = "text") -> Column:
    """Array of the hashes of a text's words, in order."""
    return F.transform(F.regexp_extract_all(F.lower(text_or_empty(name)), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def profile_key(name: str = "text") -> Column:
    """Digest that texts with the same words share: their shingles are the same."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text_or_empty(name)), r"[\x20\x09-\x0D]+", " ")))


def shingle_counts(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``document, shingle, count`` of flat word hashes, sorted by document and shingle."""
    n = np.maximum(lengths - SHINGLE + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + starts[doc]
    h = np.repeat(lengths.astype(np.uint64), n)  # short texts differ from longer ones
    h[lengths[doc] >= SHINGLE] = SHINGLE
    flat = words.astype(np.uint64)
    for k in range(SHINGLE):
        inside = k < lengths[doc]
        w = flat[np.minimum(at + k, len(flat) - 1)] if len(flat) else flat
        h = np.where(inside, _mix(h * _GOLD + w + np.uint64(k + 1)), h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    where = np.flatnonzero(first)
    return doc[where], h[where], np.diff(np.append(where, len(h)))


def sketch(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """Registers[document, register]: the low 32 bits of the shingle that arrives first.

    Arrival times are kept as the bits of a float above the shingle's, so that one minimum finds both.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n_docs * REGISTERS, none)
    low = shingle & np.uint64(0xFFFFFFFF)
    time = np.zeros(len(doc))
    alone = np.bincount(doc, minlength=n_docs)[doc] == 1  # the one shingle of a document takes every register
    best.reshape(n_docs, REGISTERS)[doc[alone]] = low[alone, None]
    live = np.flatnonzero(~alone)
    arrival = 0
    while len(live):
        arrival += 1
        r = _mix(shingle[live] + np.uint64(arrival * int(_GOLD) % 2**64))
        step = -np.log1p(-((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time[live] += step / count[live]
        place = doc[live] * REGISTERS + (_mix(r ^ _M2) % np.uint64(REGISTERS)).astype(np.int64)
        bits = time[live].astype(np.float32).view(np.uint32).astype(np.uint64)
        np.minimum.at(best, place, bits << np.uint64(32) | low[live])
        last = (best.reshape(n_docs, REGISTERS).max(axis=1) >> np.uint64(32)).astype(np.uint32)
        last_time = np.where(last == 0xFFFFFFFF, np.inf, last.view(np.float32).astype(np.float64))
        live = live[time[live] <= last_time[doc[live]]]
    return (best & np.uint64(0xFFFFFFFF)).reshape(n_docs, REGISTERS)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    r = registers.reshape(len(registers), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, r.shape[:2]).copy()
    for k in range(ROWS):
        h = _mix(h * _M1 + r[:, :, k])
    return h.view(np.int64)


def _list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = _list_parts(batch.column("words"))
        flat = flat.view(np.uint64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_WORDS, side="right")) - 1)
            lengths = np.diff(offsets[a : b + 1])
            bands = band_hashes(sketch(*shingle_counts(flat, offsets[a:b], lengths), b - a))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)), mask=pa.array(lengths == 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), lists], ["doc_id", "key", "bands"])
            a = b


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two profiles ``(sorted shingles, counts)``."""
    (s, x), (t, y) = a, b
    place = np.minimum(np.searchsorted(t, s), max(len(t) - 1, 0))
    i = np.flatnonzero(t[place] == s) if len(t) else np.zeros(0, np.int64)
    if not len(i):
        return 0.0
    j = place[i]
    u, v = x[i].astype(np.float64), y[j].astype(np.float64)
    order = np.argsort(v / u, kind="stable")
    u, v = u[order], v[order]
    ratio = v / u
    last = np.searchsorted(ratio, ratio, side="right")
    sum_u, sum_v = np.append(0, np.cumsum(u)), np.append(0, np.cumsum(v))
    # of shingles with a lower ratio the first text's weight counts, of the others the second's
    below = x.sum() - u.sum() + sum_u[last]
    above = y.sum() - v.sum() + (sum_v[-1] - sum_v[last])
    return float((1 / (below / u + above / v)).sum())


def _profile(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(words, np.int64).view(np.uint64)
    _, s, n = shingle_counts(words, np.zeros(1, np.int64), np.array([len(words)]))
    return s, n


def _too_far(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float) -> bool:
    """Whether a's weight on shingles that b lacks rules the similarity out: J_P is at most the share of a's weight that both have. Shingles are hashes in
    order, so a first part of them mostly tells."""
    (s, x), (t, _) = a, b
    most = (1 - least + 1e-9) * x.sum()
    missed, start = 0, 0
    for end in (len(s) // 3, len(s)):
        part = s[start:end]
        missed += x[start:end][t[np.minimum(np.searchsorted(t, part), len(t) - 1)] != part].sum()
        if missed > most:
            return True
        start = end
    return False


def _close(a: tuple, b: tuple, least: float) -> bool:
    return len(a[0]) > 0 and len(b[0]) > 0 and not _too_far(a, b, least) and not _too_far(b, a, least) and similarity(a, b) >= least - 1e-12


def _verified(least: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (fa, oa), (fb, ob) = _list_parts(batch.column("words_u")), _list_parts(batch.column("words_v"))
        keep, last, pu = [], None, None
        names = batch.column("u").to_pylist()
        for k, u in enumerate(names):
            if u != last:
                last, pu = u, _profile(fa[oa[k] : oa[k + 1]])
            keep.append(_close(pu, _profile(fb[ob[k] : ob[k + 1]]), least))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _block_links(least: float, least_bands: int, band: int, members: list[dict], profile) -> Iterator[tuple[str, str]]:
    """Links between the left and the right rows of one block: other components, the first bucket they share."""
    left, right = [m for m in members if m["side"] == 0], [m for m in members if m["side"] == 1]
    if not left or not right:
        return
    rb = np.array([m["bands"] for m in right], np.int64)
    group: dict[str, str] = {}

    def root(x: str) -> str:
        while (up := group.get(x, x)) != x:
            group[x] = group.get(up, up)
            x = up
        return x

    outside = np.array([m["outside"] for m in right])
    labels = np.array([m["label"] for m in right])
    keys = np.array([m["key"] for m in right])
    for m in left:
        same = rb == np.array(m["bands"], np.int64)
        shared = same.sum(axis=1)
        # pairs of two members outside their centre's component come up from both sides
        todo = np.flatnonzero((shared >= least_bands) & (labels != m["label"]) & ~same[:, :band].any(axis=1) & (~outside | (keys > m["key"])))
        for k in todo[np.argsort(-shared[todo], kind="stable")]:
            if root(m["label"]) != root(right[k]["label"]) and _close(profile(m), profile(right[k]), least):
                group[root(m["label"])] = root(right[k]["label"])
                yield m["key"], right[k]["key"]


def _in_blocks(least: float, least_bands: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks one after another, from rows sorted by block; one block's rows are held at a time."""
    known: dict[str, tuple] = {}

    def profile(m: dict) -> tuple:
        if m["key"] not in known:
            if len(known) >= PROFILES:
                known.clear()
            known[m["key"]] = _profile(m["words"].values.to_numpy())
        return known[m["key"]]

    def links(members: list[dict]) -> list[tuple[str, str]]:
        return list(_block_links(least, least_bands, members[0]["band"], members, profile))

    members: list[dict] = []
    block = None
    for batch in batches:
        found: list[tuple[str, str]] = []
        columns = {n: batch.column(n).to_pylist() for n in ("band", "bucket", "left", "right", "key", "label", "outside", "side", "bands")}
        words = batch.column("words")
        for k, here in enumerate(zip(*(columns[n] for n in ("band", "bucket", "left", "right")))):
            if here != block:
                if members:
                    found += links(members)
                block, members = here, []
            members.append({n: columns[n][k] for n in ("band", "key", "label", "outside", "side", "bands")} | {"words": words[k]})
        yield _pairs(found)
    if members:
        yield _pairs(links(members))


def _pairs(found: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["u", "v"])


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, least_bands: int = 1) -> DataFrame:
    """``doc_id, key, label, class_id, text_id``: of each row the class of near-duplicates that it is in, told apart from others by its
    label, its least key, and named by its least doc_id; and the least doc_id of the rows with the same words."""
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), profile_key().alias("key"), word_hashes().alias("words"))
    sketched = stage(every.mapInArrow(_sketched, "doc_id long, key string, bands array<long>"), "sketches")
    texts = stage(sketched.groupBy("key").agg(F.min("doc_id").alias("text_id"), F.first("bands").alias("bands")), "sketch-texts")

    # buckets with two texts or more, and their centres; what is counted by bucket is staged, so that the joins back split large buckets
    dealt = texts.select("key", F.posexplode("bands").alias("band", "bucket"))
    shared = stage(dealt.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sketch-shared")
    dealt = stage(dealt.hint("merge").join(shared, ["band", "bucket"]), "sketch-buckets")
    degree = dealt.groupBy("key").agg(F.sum(F.log2("n")).alias("degree"))
    weighed = stage(dealt.hint("merge").join(degree, "key"), "sketch-degrees")
    centres = weighed.groupBy("band", "bucket").agg(F.max(F.struct(F.round("degree", 6), "key")).alias("top")).select("band", "bucket", F.col("top.key").alias("centre"))
    centres = stage(centres, "sketch-tops")
    centred = stage(weighed.hint("merge").join(centres, ["band", "bucket"]), "sketch-centres")
    discard(shared, weighed, centres)

    # the words of the texts that stand in such buckets
    needed = degree.select("key").join(texts, "key")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), profile_key().alias("key"), F.col("text"))
    words = source.hint("merge").join(needed, "key", "inner").where(source["doc_id"].eqNullSafe(needed["text_id"]))
    words = words.groupBy("key").agg(F.first("text").alias("text"), F.first("bands").alias("bands"))
    words = stage(words, "sketch-words")
    discard(dealt)

    pairs = centred.where("key <> centre").select(F.col("centre").alias("u"), F.col("key").alias("v")).distinct()
    right = words.select(F.col("key").alias("v"), word_hashes().alias("words_v"))
    left = words.select(F.col("key").alias("u"), word_hashes().alias("words_u"))
    compared = pairs.hint("merge").join(right, "v").hint("merge").join(left, "u")
    links = stage(compared.mapInArrow(lambda b: _verified(least, b), "u string, v string"), "links-centres")

    labels = components(links)
    placed = centred.select("band", "bucket", "key", "centre").hint("merge").join(labels.withColumnRenamed("node", "key"), "key", "left")
    placed = placed.withColumn("label", F.coalesce("label", "key"))
    of_centre = placed.where("key = centre").select("band", "bucket", F.col("label").alias("centre_label"))
    placed = stage(placed.hint("merge").join(of_centre, ["band", "bucket"]).withColumn("outside", F.col("label") != F.col("centre_label")), "sketch-labels")
    mixed = placed.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("outside").cast("long")).alias("n_outside")).where("n_outside > 0")
    mixed = stage(mixed.select("band", "bucket", F.ceil(F.col("n") / BLOCK).alias("rights"), F.ceil(F.col("n_outside") / BLOCK).alias("lefts")), "sketch-mixed")
    again = placed.hint("merge").join(mixed, ["band", "bucket"]).select("band", "bucket", "key", "label", "outside", "lefts", "rights")

    def numbered(side: int, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("key"), F.col(own)).alias("own")
        rows = again.where("outside") if side == 0 else again
        rows = rows.select("band", "bucket", "key", "label", "outside", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("other"))
        left, right = ("own", "other") if side == 0 else ("other", "own")
        return rows.select("band", "bucket", "key", "label", "outside", F.col(left).alias("left"), F.col(right).alias("right"), F.lit(side).alias("side"))

    blocks = numbered(0, "lefts", "rights").unionByName(numbered(1, "rights", "lefts"))
    hashed = words.select("key", "bands", word_hashes().alias("words"))
    block = ["band", "bucket", "left", "right"]
    blocks = blocks.hint("merge").join(hashed, "key").repartition(*block).sortWithinPartitions(*block, "side", "key")
    more = blocks.mapInArrow(lambda b: _in_blocks(least, least_bands, b), "u string, v string")

    every_link = stage(links.unionByName(more), "links-all")
    discard(centred, placed, mixed, words, links)
    named = components(every_link)
    classes = texts.select("key", "text_id").hint("merge").join(named.withColumnRenamed("node", "key"), "key", "left")
    labelled = stage(classes.withColumn("label", F.coalesce("label", "key")), "near-classes")
    ids = stage(labelled.groupBy("label").agg(F.min("text_id").alias("class_id")), "near-labels")
    classes = stage(labelled.hint("merge").join(ids, "label").select("key", "label", "text_id", "class_id"), "near-ids")
    discard(every_link, texts, labelled, ids)
    return sketched.select("doc_id", "key").hint("merge").join(classes, "key").select("doc_id", "key", "label", "class_id", "text_id")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least doc_id stays, with all its columns
    (one row, where that doc_id repeats within the class)."""
    found = near_duplicates(docs, least)
    absent = F.lit(-(2**63))
    key, id_, no_id, copy = spare(docs, "key", "id", "no_id", "copy")
    keys = [key, id_, no_id]
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "class_id").agg(F.min("key").alias("key"))
    stays = stays.select("key", F.coalesce("class_id", absent), F.col("class_id").isNull()).toDF(*keys)
    doc_id = F.col("doc_id").cast("long")
    tagged = docs.withColumns({key: profile_key(), id_: F.coalesce(doc_id, absent), no_id: doc_id.isNull()})
    first = Window.partitionBy(*keys).orderBy(id_)  # shares the join's partitioning
    out = tagged.join(stays.hint("merge"), keys, "left_semi").withColumn(copy, F.row_number().over(first))
    return out.where(F.col(copy) == 1).select(*docs.columns)
