"""Places of a pattern's matches in a text, by the built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose places are summed up together.
BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_places(text: Column, pattern: str, groups: Sequence[int] = (), needs: str | None = None) -> Column:
    """Array of ``(start, end, raw, g<k> for each of groups)`` of all matches, leftmost and not overlapping; a group that takes no part is ''. Offsets
    count code points. The text is searched twice, for matches and for what is between them; groups are taken from each match by itself, so the pattern must not look
    beyond it. ``needs``: a cheap pattern that every match has somewhere in it; texts without it are not searched. The running place is summed in blocks, since a list that grows by each match of a long text takes time by its square."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # one more than there are matches: the last has no match behind it
    found = F.arrays_zip(gaps.alias("gap"), hits.alias("raw"))
    nothing = F.array().cast("array<struct<start:int,end:int,raw:string" + "".join(f",g{g}:string" for g in groups) + ">>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["raw"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["raw"].alias("raw"), *[F.regexp_extract(x["raw"], pattern, g).alias(f"g{g}") for g in groups])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    def starts(blocks: Column) -> Column:
        def after(acc: Column, b: Column) -> Column:
            return F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["raw"]))))

        return F.aggregate(blocks, F.array(F.lit(0)), after)

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), nothing.alias("spans")), step, lambda acc: acc["spans"])

    def in_blocks(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 2) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, F.least(F.lit(BLOCK), F.size(all_) - 1 - k * BLOCK)))
        return bound(cut, lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), lambda b, at: F.when(b.isNotNull(), placed(b, at)).otherwise(nothing))))

    searched = found if needs is None else F.when(text.rlike(needs), found)
    return bound(searched, lambda all_: F.when(F.size(all_) > 1, in_blocks(all_)).otherwise(nothing))
