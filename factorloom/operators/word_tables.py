"""Tables from word boxes: words of a page fall into rows by height, runs of rows of several words are regions, gaps that line up cut a region into columns.

A page is a group: its words come together once, sorted by height, and all else is worked out from that array, so nothing is moved, sorted
or written again but the finished tables, which are numbered by page.

Cases
-----
* words without text or without a box are left out; a page of fewer than ``LEAST_WORDS`` other words has no table
* words of one height go from left to right, then by their other bounds and their text, so that ties are settled
* an empty table of words has no tables; other columns are ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matches import bound

#: Points within which words share a row, gaps that may part columns, distance within which gaps line up.
ROW_TOLERANCE, LEAST_GAP, GAP_RADIUS = 4.0, 8.0, 8.0
#: Words of a page, rows of a region and columns of a table at least; share of cells with a digit.
LEAST_WORDS, LEAST_ROWS, LEAST_COLUMNS, NUMERIC_SHARE = 6, 2, 3, 0.25
#: A caption has at most so many cells.
CAPTION_CELLS = 2
PAGE = ("doc_id", "page_num")
BOX = ("x0", "y0", "x1", "y1")


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once: as the one item of an exploded array, which the optimizer copies into no later filter or lambda."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def _page_rows(words: DataFrame, tolerance: float) -> DataFrame:
    """``doc_id, page_num, rows``: a page's rows from top to bottom, each an array of words from left to right."""
    boxes = words.select(*PAGE, *(F.col(c).cast("double").alias(c) for c in BOX), "text").where(F.trim("text") != "").dropna(subset=list(BOX))
    word = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("middle"), *BOX, "text")
    pages = boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(word)).alias("words")).where(F.size("words") >= LEAST_WORDS)
    start = F.struct(F.lit(None).cast("double").alias("reach"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def follow(state: Column, w: Column) -> Column:
        begins = state["reach"].isNull() | (w["middle"] > state["reach"])
        starts = F.when(begins, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"])
        return F.struct(F.when(begins, w["middle"] + F.lit(float(tolerance))).otherwise(state["reach"]).alias("reach"), (state["at"] + 1).alias("at"), starts.alias("starts"))

    starts = _held(pages, "starts", F.aggregate("words", start, follow, lambda s: s["starts"]))

    def row(a: Column, k: Column) -> Column:
        b = F.coalesce(F.get("starts", k + 1), F.size("words"))
        return F.array_sort(F.transform(F.slice("words", a + 1, b - a), lambda w, j: F.struct(w["x0"].alias("x0"), (a + j).alias("left"), *(w[c].alias(c) for c in (*BOX[1:], "text")))))

    return _held(starts, "rows", F.transform("starts", row)).select(*PAGE, "rows")


def rows_of(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """``doc_id, page_num, row_no, words``: rows from top to bottom, each an array of words from left to right.

    A row begins with its highest word and holds the words whose middles are at most ``tolerance`` below that one's.
    """
    return _page_rows(words, tolerance).select(*PAGE, F.posexplode("rows").alias("row_no", "words"))


def _regions(rows: Column) -> Column:
    """Runs of rows of several words, without those of too few rows."""
    lone = F.filter(F.transform(rows, lambda r, i: F.when(F.size(r) < 2, i)), lambda i: i.isNotNull())
    return bound(F.concat(F.array(F.lit(-1)), lone, F.array(F.size(rows))), lambda ends: F.filter(
        F.transform(F.sequence(F.lit(0), F.size(ends) - 2), lambda k: F.slice(rows, F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1)), lambda r: F.size(r) >= LEAST_ROWS
    ))


def _cuts(rows: Column, least_gap: float) -> Column:
    """Places between columns: means of gaps' middles that line up in a quarter of the rows, two at least."""

    def gaps_of(r: Column) -> Column:
        pairs = F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r)).alias("b"))
        return F.transform(F.filter(pairs, lambda p: p["b"]["x0"] - p["a"]["x1"] >= least_gap), lambda p: (p["a"]["x1"] + p["b"]["x0"]) / 2)

    def islands(gaps: Column) -> Column:
        begins = F.filter(F.transform(gaps, lambda g, i: F.when((i == 0) | (g - F.get(gaps, i - 1) >= GAP_RADIUS), i)), lambda i: i.isNotNull())
        return bound(begins, lambda at: F.transform(at, lambda a, k: F.slice(gaps, a + 1, F.coalesce(F.get(at, k + 1), F.size(gaps)) - a)))

    lined_up = bound(F.array_sort(F.flatten(F.transform(rows, gaps_of))), lambda gaps: F.filter(islands(gaps), lambda i: F.size(i) >= F.greatest(F.lit(2), F.floor(F.size(rows) / 4))))
    return F.transform(lined_up, lambda i: F.aggregate(i, F.lit(0.0), lambda s, g: s + g) / F.size(i))


def tables(words: DataFrame, tolerance: float = ROW_TOLERANCE, least_gap: float = LEAST_GAP) -> DataFrame:
    """``doc_id, page_num, table_no, x0, y0, x1, y1, table`` of the words ``doc_id, page_num, x0, y0, x1, y1, text``: each region with enough columns and numbers, as a pipe table.

    A word's column is the one that its middle falls into; columns at the end that are empty in all rows go, down to two. Rows at a region's beginning with
    ``CAPTION_CELLS`` cells or fewer are captions and no part of the table, unless fewer than ``LEAST_ROWS`` rows were left.
    """
    regions = _page_rows(words, tolerance).select(*PAGE, F.posexplode(_regions(F.col("rows"))).alias("region", "rows"))
    cut = _held(regions, "cuts", _cuts(F.col("rows"), least_gap)).where(F.size("cuts") > 0)

    def placed(w: Column) -> Column:
        return F.struct(F.size(F.filter("cuts", lambda c: c < (w["x0"] + w["x1"]) / 2)).alias("k"), w["text"].alias("text"))

    def bounds(c: str, extreme) -> Column:
        return extreme(F.transform("rows", lambda r: extreme(F.transform(r, lambda w: w[c])))).alias(c)

    grid = _held(cut, "placed", F.transform("rows", lambda r: F.transform(r, placed)))
    grid = grid.select(*PAGE, "region", bounds("x0", F.array_min), bounds("y0", F.array_min), bounds("x1", F.array_max), bounds("y1", F.array_max), "placed")
    most = F.array_max(F.transform("placed", lambda r: F.array_max(F.transform(r, lambda w: w["k"]))))
    grid = _held(grid, "width", F.greatest(most + 1, F.lit(2)))

    def cells(r: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.array_join(F.transform(F.filter(r, lambda w: w["k"] == k), lambda w: w["text"]), " "))

    grid = _held(grid, "cells", F.transform("placed", cells)).drop("placed")
    n_rows = F.size("cells")
    wide = F.filter(F.transform("cells", lambda r, i: F.when(F.size(F.filter(r, lambda c: c != "")) > CAPTION_CELLS, i)), lambda i: i.isNotNull())
    captions = F.least(F.coalesce(F.get(wide, F.lit(0)), n_rows), n_rows - LEAST_ROWS)
    grid = _held(_held(grid, "captions", captions), "cells", F.slice("cells", F.col("captions") + 1, n_rows - F.col("captions"))).drop("captions")
    flat = F.flatten("cells")
    filled, numeric = F.size(F.filter(flat, lambda c: c != "")), F.size(F.filter(flat, lambda c: c.rlike(r"\p{Nd}")))
    good = grid.where((F.col("width") >= LEAST_COLUMNS) & (filled > 0) & (numeric >= NUMERIC_SHARE * filled))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    lines = F.transform("cells", lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    found = good.select(*PAGE, "region", *BOX, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size("cells"))), "\n").alias("table"))
    number = (F.row_number().over(Window.partitionBy(*PAGE).orderBy("region")) - 1).alias("table_no")
    return found.select(*PAGE, number, *BOX, "table")
