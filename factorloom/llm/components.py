"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join on the links; nothing is gathered in one task or on the driver, and each
step's links are written to the shared folder, which cuts lineage; those of the step before are deleted then.

Cases
-----
* links in any direction, repeated links and links of a node with itself count once or not at all; nodes without a link to another node are left out
* a null on either side is no link; an empty table has no components; other columns are ignored
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _step(both: DataFrame, large: bool, what: str) -> DataFrame:
    """Staged links. ``both``: links (u, v). large: of each u, link its larger neighbours to its least one, small: u and its smaller ones."""
    near = both if large else both.where("v < u")
    # staged, so that both sides of the join are dealt anew and a node with very many links is split at run time
    least = stage(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "links-least")
    joined = near.hint("merge").join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = stage(out.where("u <> v").distinct(), what)
    discard(least)
    return out


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node with a link, label being the least node of its component.

    ``links``: columns ``u, v`` of one orderable type, in any direction, repeats and self-links allowed.
    """
    links = stage(links.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**40)))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        large = _step(_both(links), True, "links-large")
        small = _step(large, False, "links-small")
        discard(links, large)
        links = small
    # every link now goes from a node to the least of its component
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
