"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents stand in a fixed shuffled order. A document's virtual finish time is the cumulative size of
its source up to and including it, divided by the source's target; repeats of a source follow as further
epochs, at most ``max_repeats`` in all. All (document, epoch) rows are range-sorted by virtual finish time and cut
where the running size passes the total budget. A source's finish time reaches 1 as it meets its target, so the cut
falls at or just after 1 and every source is near its target.

No window holds a whole source: cumulative sizes are prefix sums over hash ranges of the shuffle key, and the range
sort works in equal slices of virtual time, which hold equal shares of the budget whatever the source sizes. The
numbers of ranges and slices follow the number of rows, so that a task's share stays; the result does not depend on them.

Cases
-----
* null text has size 0; null is a source of its own, after all others; a null doc_id is shuffled by its text
* a document of size 0 is never taken (it adds nothing); a source of size 0 has target 0
* documents that share doc_id, source and text are interchangeable; each is reported, and ``mix_rows`` takes them in all as often as the queue does
* an empty table gives an empty report; other columns are ignored (``mix_rows`` keeps them)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, spare, stage, text_or_empty

#: Least number of hash ranges, and of slices of virtual time up to 1, where each source has met its target, and for each
#: doubling after that; rows of a range or slice beyond which there are more of them.
RANGES, SLICES, ROWS = 4096, 1024, 200_000


def n_words(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def shuffle_key(seed: int) -> Column:
    """Hex digest that fixes the order of a source's documents."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")))


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int, share: float) -> DataFrame:
    """``source, rank, source_size, target`` of every source, one row each.

    Sources in code-point order, null last, take ``weights`` in turn. Water filling: the target is the weight times a
    common level, or ``max_repeats`` times the source's size where that is less. One row per source is all
    that the windows here see.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size") * max_repeats)
    # fill by rising cap/weight: with the first j capped, the level is what is left over the weight that is left
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns({
        "budget": F.sum("source_size").over(whole) * F.lit(share),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    level = (F.col("budget") - F.col("cap_before")) / F.col("weight_left")
    s = s.withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") >= level, level)).over(whole))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return s.select("named", "source", "rank", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"), "budget")


def fair_queue(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, share: float = 1.0, seed: int = 0, ranges: int = RANGES) -> DataFrame:
    """``doc_id, source, key, size, source_size, target, epochs, taken`` of every document.

    ``epochs`` is the number of epochs in which the document stands before the cut, ``taken`` its size as often. ``ranges``: hash ranges
    of the shuffle key, at least, by which a source's cumulative size is computed in parts.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words().alias("size"), shuffle_key(seed).alias("key"),
    )
    sizes = stage(base.withColumn("named", _named(F.col("source"))), "mix-sizes")
    n = sizes.count()
    ranges, slice_count = max(ranges, -(-n // ROWS)), max(SLICES, -(-n * max_repeats // ROWS))
    hashed = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    base = sizes.withColumn("range", F.floor(hashed * ranges / F.lit(2.0**32)).cast("int"))

    parts = base.groupBy("named", "source", "range").agg(F.sum("size").alias("part"))
    of_source = parts.groupBy("named", "source").agg(F.sum("part").alias("source_size"))
    targets = stage(source_targets(of_source, weights, max_repeats, share), "mix-targets")
    earlier = Window.partitionBy("named").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("named", "range", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("before"))
    parts = parts.join(targets.drop("source"), "named")
    inside = Window.partitionBy("named", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = base.withColumn("in_range", F.sum("size").over(inside)).join(parts, ["named", "range"])
    queued = queued.withColumn("cum", F.col("before") + F.col("in_range"))
    queued = stage(queued.select("doc_id", "source", "key", "size", "rank", "cum", "source_size", "target", "budget"), "mix-queue")
    discard(sizes, targets)

    def finish(epoch: int) -> Column:
        return (F.col("source_size") * epoch + F.col("cum")) / F.col("target")

    def place(epoch: int) -> Column:
        return F.struct(finish(epoch).alias("vft"), F.col("rank"), F.lit(epoch).alias("epoch"), F.col("key"), F.col("doc_id"))

    waiting = queued.where("size > 0")
    runs = waiting.select("size", "budget", F.explode(F.array(*[place(e) for e in range(max_repeats)])).alias("place"))
    vft = F.col("place.vft")
    runs = runs.withColumn("slice", F.floor(F.when(vft < 1, vft * slice_count).otherwise(slice_count + F.log2(vft) * slice_count)))
    slices = runs.groupBy("slice").agg(F.sum("size").alias("in_slice"))
    up_to = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.coalesce(F.sum("in_slice").over(up_to), F.lit(0)).alias("ahead"))
    running = Window.partitionBy("slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ordered = runs.withColumn("in_slice", F.sum("size").over(running)).join(slices, "slice")
    cut = ordered.where(F.col("ahead") + F.col("in_slice") <= F.col("budget")).agg(F.max("place").alias("cut"))

    placed = queued.crossJoin(F.broadcast(cut))  # one row
    epochs = sum((F.when((F.col("size") > 0) & (place(e) <= F.col("cut")), 1).otherwise(0) for e in range(max_repeats)), F.lit(0))
    placed = placed.withColumn("epochs", epochs)
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).cast("long").alias("taken"))


def _named(source: Column) -> Column:
    """A source's key, which is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken, with all its columns."""
    key, named, each, rest, row, copy = spare(docs, "key", "named", "each", "rest", "row", "copy")
    # rows that share doc_id, source and text are one key here: they share out what the queue took of them
    taken = fair_queue(docs, **options).groupBy(F.col("key").alias(key), _named(F.col("source")).alias(named)).agg(F.sum("epochs").alias("all"), F.count(F.lit(1)).alias("n"))
    taken = taken.where("all > 0").select(key, named, F.floor(F.col("all") / F.col("n")).alias(each), (F.col("all") % F.col("n")).alias(rest))
    tagged = docs.withColumns({key: shuffle_key(options.get("seed", 0)), named: _named(F.col("source"))})
    out = tagged.join(taken.hint("merge"), [key, named])
    out = out.withColumn(row, F.row_number().over(Window.partitionBy(key, named).orderBy(key)))  # shares the join's partitioning
    times = F.col(each) + F.when(F.col(row) <= F.col(rest), 1).otherwise(0)
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)
