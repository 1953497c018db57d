"""Prefix trie of conversations by polynomial rolling fingerprints.

Each turn has a hash; the fingerprint of a conversation's first d turns is the sum of the turns' hashes times powers of a base, under two
moduli, taken by numpy scans over blocks of ``BLOCK`` turns whose totals are carried on. Prefixes of equal depth and fingerprint are
a candidate group. Each member is verified against the group's representative, its smallest conversation: the last turns must
agree by role and by the text's SHA-256, and so must the groups of the prefixes before them, so that by induction all turns do. A member that
fails splits from its group, from that turn on, and the groups are formed anew until none fails.

A node belongs to its smallest member, and a conversation's own nodes are the end of its path. So what a subtree holds is a
sum over the members of what each one's own nodes hold from that depth on: one suffix scan by conversation and one grouped
sum roll everything up, whatever the depth, without going through the trie level by level.

Turns are numbered by one range sort with counts by partition. A conversation or a prefix that many rows share is
counted before it moves, and joined by sort-merge from staged tables, which split it at run time.

Cases
-----
* turns go by ``turn``, null first, those of one turn by role, then by the text's SHA-256; null role or text counts as empty
* rows with a null ``conv_id`` are left out; repeated rows are turns of their own; other columns are ignored
* a conversation without turns is a member of the root; an empty table has no nodes, not even a root
* texts may have any length; code points are counted
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, parallelism, stage

#: Turns of a block, and conversation ids of a piece of a digest.
BLOCK, PIECE = 2048, 4096
#: Two primes under 2^31 and a base for each.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 69_621)


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, size, role, digest, chars`` of ``turns`` (conv_id, turn, role, text): each turn's place from 0, and how many turns its conversation has."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), F.length(text).cast("long").alias("chars")
    )
    order = ("conv_id", "turn", "role", "digest")
    sorted_rows = slim.repartitionByRange(parallelism(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = stage(sorted_rows.select("*", F.monotonically_increasing_id().alias("no")), "trie-turns").withColumn("part", F.shiftright("no", 33))
    by_part = rows.groupBy("conv_id", "part").agg(F.min("no").alias("first_no"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_part.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_no")).alias("shift"), F.sum("n").over(Window.partitionBy("conv_id")).alias("size"))
    found = rows.join(placed, ["conv_id", "part"])
    return found.select("conv_id", (F.col("no") + F.col("shift")).alias("pos"), "size", "role", "digest", "chars")


def with_shared_heads(own: DataFrame, most: int = 6, family: int = 100) -> DataFrame:
    """``conv_id, depth, length, role, digest, chars``: conversations of ``numbered`` rebuilt so that families share their first turns, with a root row (depth 0) each.

    Conversation c takes the first h turns of conversation c - c % ``family``, h being crc32 of its decimal id modulo ``most``, then its own after its first h.
    """
    own = stage(own, "trie-own")
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    all_ids = own.where("pos = 0").select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    sizes = all_ids.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    k = F.least("h", F.coalesce("base_size", F.lit(0)))
    ids = all_ids.join(sizes, "base", "left").select("conv_id", "base", "h", k.alias("k"), (k + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length"))
    ids = stage(ids, "trie-ids")
    head = own.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base").join(ids, "base").where("pos < k")
    tail = own.hint("merge").join(ids, "conv_id").where("pos >= h")
    turn = ["length", "role", "digest", "chars"]
    return (
        head.select("conv_id", (F.col("pos") + 1).alias("depth"), *turn)
        .unionByName(tail.select("conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), *turn))
        .unionByName(ids.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("chars")))
    )


def _powers(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    out, square = np.ones(len(exponents), np.uint64), np.uint64(base)
    left = exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * square % np.uint64(modulus)
        square = square * square % np.uint64(modulus)
        left >>= np.uint64(1)
    return out


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each turn's own share (v1, v2) and the running sums in its block (f1, f2). A partition is sorted by conversation, block and depth."""
    last, carry = None, [np.uint64(0)] * 2
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, depth, mix = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "mix"))
        block = depth // BLOCK
        opens = np.ones(n, bool)
        opens[1:] = (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])
        opens[0] = last != (conv[0], block[0])
        start = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
        added = {}
        for k, (modulus, base) in enumerate(zip(MODULI, BASES)):
            half = (mix.view(np.uint64) >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)
            v = np.where(depth > 0, (half % np.uint64(modulus)) * _powers(base, depth, modulus) % np.uint64(modulus), np.uint64(0))
            total = np.cumsum(v)
            before = np.where(start > 0, total[start - 1], np.uint64(0))
            f = (total - before + np.where(start < 0, carry[k], np.uint64(0))) % np.uint64(modulus)
            carry[k] = f[-1]
            added[f"v{k + 1}"], added[f"f{k + 1}"] = v.astype(np.int64), f.astype(np.int64)
        last = (conv[-1], block[-1])
        keep = [x for x in batch.schema.names if x != "mix"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), *map(pa.array, added.values())], [*keep, *added])


def fingerprints(rows: DataFrame, bits: int = 62) -> DataFrame:
    """``rows`` (conv_id, depth, ...) with ``fp`` and ``fp_before``, of the prefix that ends here and of the one before; ``bits`` under 62 weakens them for tests."""
    block = F.floor(F.col("depth") / BLOCK).cast("long").alias("block")
    keyed = rows.select("*", block, F.xxhash64("role", "digest").alias("mix"))
    dealt = keyed.repartition(parallelism(rows.sparkSession), "conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    schema = T.StructType([*(f for f in keyed.schema.fields if f.name != "mix"), *(T.StructField(n, T.LongType()) for n in ("v1", "f1", "v2", "f2"))])
    found = stage(dealt.mapInArrow(_scanned, schema), "trie-scan")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = found.where(F.col("depth") % BLOCK == BLOCK - 1)
    carry = ends.select("conv_id", (F.col("block") + 1).alias("block"), *(F.pmod(F.sum(f"f{k}").over(before), F.lit(MODULI[k - 1])).alias(f"c{k}") for k in (1, 2)))
    none = [F.lit(0).cast("long").alias(f"c{k}") for k in (1, 2)]
    carried = found.where("block = 0").select("*", *none).unionByName(found.where("block > 0").join(carry, ["conv_id", "block"]))

    def both(*parts: Column) -> Column:
        one, two = (F.pmod(x, F.lit(m)) for x, m in zip(parts, MODULI))
        return (F.shiftleft(one, 31) + two) % F.lit(1 << bits)

    here = [F.col(f"f{k}") + F.col(f"c{k}") for k in (1, 2)]
    past = [x - F.col(f"v{k}") for k, x in zip((1, 2), here)]
    return carried.select(*(c for c in rows.columns), "block", both(*here).alias("fp"), F.when(F.col("depth") > 0, both(*past)).alias("fp_before"))


def grouped(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, block, length, chars, rep, n_convs, n_ends`` of fingerprinted ``rows``: the verified group of every prefix, by its smallest member."""
    none = F.lit("")
    rows = stage(rows.withColumns({"split": none, "split_before": none}), "trie-keys")
    key = ["depth", "fp", "split"]
    turn = ["role", "digest", "fp_before", "split_before"]
    while True:
        groups = rows.groupBy(*key).agg(F.min(F.struct("conv_id", *turn)).alias("first"), F.count(F.lit(1)).alias("n_convs"), F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends"))
        groups = stage(groups, "trie-groups")
        same = F.lit(True)
        for c in turn:
            same = same & F.col(c).eqNullSafe(F.col(f"first.{c}"))
        joined = rows.hint("merge").join(groups, key).select("*", (~same).alias("differs"))
        tag = F.sha2(F.concat_ws(":", F.length("role"), "role", F.hex("digest"), "fp_before", "split_before"), 256)
        held = stage(joined.select("conv_id", "depth", "block", "length", "chars", F.col("first.conv_id").alias("rep"), "n_convs", "n_ends", F.when(F.col("differs"), tag).alias("tag")), "trie-members")
        at_fault = held.where("tag IS NOT NULL").groupBy("conv_id").agg(F.min(F.struct("depth", "tag")).alias("fault"))
        if at_fault.isEmpty():
            discard(rows, groups)
            return held.drop("tag")
        faults = stage(at_fault, "trie-faults")

        def split(name: str, depth: Column) -> Column:
            return F.when(depth >= F.col("fault.depth"), F.sha2(F.concat_ws(":", name, "fault.tag"), 256)).otherwise(F.col(name)).alias(name)

        after = rows.hint("merge").join(faults, "conv_id", "left")
        rest = [c for c in rows.columns if c not in ("split", "split_before")]
        renewed = stage(after.select(*rest, split("split", F.col("depth")), split("split_before", F.col("depth") - 1)), "trie-keys")
        discard(rows, groups, held, faults)
        rows = renewed


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most PIECE ids of one node, as text."""
    for batch in batches:
        rep, depth, conv = (batch.column(c).to_numpy() for c in ("rep", "depth", "conv_id"))
        cuts = np.flatnonzero(np.r_[True, (rep[1:] != rep[:-1]) | (depth[1:] != depth[:-1])]).tolist() if len(rep) else []
        out = [(int(rep[a]), int(depth[a]), int(conv[a]), ",".join(map(str, conv[a : min(a + PIECE, b)].tolist()))) for lo, b in zip(cuts, [*cuts[1:], len(rep)]) for a in range(lo, b, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["rep", "depth", "conv_id", "piece"])


def _piece_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, running = None, None
    names, kinds = ["rep", "depth", "ends_sha256"], (pa.int64(), pa.int64(), pa.string())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, kinds)], names)

    for batch in batches:
        rows = []
        for rep, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "piece"))):
            if (rep, depth) != node:
                if running is not None:
                    rows.append((*node, running.hexdigest()))
                node, running = (rep, depth), hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        yield batch_of(rows)
    if running is not None:
        yield batch_of([(*node, running.hexdigest())])


def end_digests(members: DataFrame) -> DataFrame:
    """``rep, depth, ends_sha256``: SHA-256 of the ascending ids of the conversations that end at a node, in pieces first, so that a common conversation's ids are written by many tasks."""
    n = parallelism(members.sparkSession)
    order = ("rep", "depth", "conv_id")
    ends = members.where("depth = length").select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    pieces = ends.mapInArrow(_pieces, "rep long, depth long, conv_id long, piece string")
    return pieces.repartition(n, "rep", "depth").sortWithinPartitions(*order).mapInArrow(_piece_digests, "rep long, depth long, ends_sha256 string")


def rolled_up(members: DataFrame) -> DataFrame:
    """The trie's nodes, of ``grouped`` members: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``."""
    own = F.col("conv_id") == F.col("rep")
    saved = F.when(own, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)
    leaf = F.when(own & (F.col("depth") == F.col("length")) & (F.col("n_convs") == F.col("n_ends")), 1).otherwise(0).cast("long")
    rows = members.select("conv_id", "depth", "block", "length", "rep", "n_convs", saved.alias("saved"), leaf.alias("leaf"))
    back = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc())
    to_end = back.rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.select("conv_id", "depth", "block", "length", "rep", "n_convs", F.lead("rep").over(back).alias("parent"), *(F.sum(c).over(to_end).alias(c) for c in ("saved", "leaf")))
    blocks = rows.where(F.col("length") >= BLOCK).groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.max(F.when(F.col("depth") % BLOCK == BLOCK - 1, F.col("rep"))).alias("last"))
    onward = Window.partitionBy("conv_id").orderBy("block")
    later = onward.rowsBetween(1, Window.unboundedFollowing)
    carry = blocks.select("conv_id", "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("saved", "leaf")), F.lag("last").over(onward).alias("parent_before"))
    long = scanned.where(F.col("length") >= BLOCK).join(carry, ["conv_id", "block"])
    carried = long.withColumns({"saved": F.col("saved") + F.col("later_saved"), "leaf": F.col("leaf") + F.col("later_leaf"), "parent": F.coalesce("parent", "parent_before")}).select(*scanned.columns)
    whole = stage(scanned.where(F.col("length") < BLOCK).unionByName(carried), "trie-scanned")
    nodes = whole.where("conv_id = rep").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs")
    below = whole.groupBy(F.col("rep").alias("conv_id"), "depth").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    found = nodes.join(below, ["conv_id", "depth"]).join(children, ["conv_id", "depth"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens")


def prefix_trie(rows: DataFrame, bits: int = 62) -> DataFrame:
    """Nodes of the trie over ``rows`` (conv_id, depth from 0, length, role, digest, chars), with ``ends_sha256``."""
    members = grouped(fingerprints(rows, bits))
    nodes = rolled_up(members).alias("n")
    ends = end_digests(members).select(F.col("rep").alias("conv_id"), "depth", "ends_sha256")
    return nodes.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
