"""Text operators for research documents: boilerplate, chunks, numbers, metrics, tables, formulas. Columns where the built-in
functions can say it, Arrow-batched pandas functions for scans that carry state through a text.

Pages are rows ``doc_id, page_num, text``; lines of a text are what stands between line feeds.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matches import match_places
from . import vocabulary as v

SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]"


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


# ---- text quality and page classes ----------------------------------------------------------------------------------


def cjk_ratio(text: Column) -> Column:
    """Share of Chinese characters among those that are no white space."""
    solid = F.length(F.regexp_replace(text, SPACE, ""))
    return F.coalesce(_count(text, r"[\u4e00-\u9fff]") / F.when(solid > 0, solid), F.lit(0.0))


def is_garbled(text: Column, threshold: float = 0.3) -> Column:
    """Too many replacement, private-use and control characters, or some Chinese but little."""
    n = F.length(text)
    bad = _count(text, r"[\ufffd\ue000-\uf8ff]|(?![\n\r\t])[\p{C}&&[^\ue000-\uf8ff]]|(?! )[\p{Zs}\p{Zl}\p{Zp}]")
    share = bad / F.when(n > 0, n)
    ratio = cjk_ratio(text)
    return F.coalesce((share > threshold) | ((ratio > 0) & (ratio < threshold)), F.lit(False))


def _digit_lines(text: Column) -> Column:
    heavy = F.filter(F.split(text, "\n"), lambda s: (F.length(s) > 5) & (F.regexp_count(s, F.lit(r"\d")) > F.length(s) * 0.3))
    return F.size(heavy)


def page_class(text: Column, n_images: Column, needs_ocr: Column) -> Column:
    """``blank, scanned, table_candidate, chart_candidate, text_rich, mixed``."""
    text = F.trim(F.coalesce(text, F.lit("")))
    n, images = F.length(text), n_images > 0
    low = F.lower(text)
    chart = _any([low.contains("图表"), low.contains("figure"), low.contains("chart"), text.rlike(r"图\s*[0-9一二三四五六七八九十]+")])
    return (
        F.when((n == 0) & ~images, "blank").when(images & (needs_ocr | (n == 0)), "scanned").when((_count(text, r"\|") > 5) | (_digit_lines(text) > 3), "table_candidate")
        .when(images & ((n < 200) | chart), "chart_candidate").when((n > 200) & ~needs_ocr & ~images, "text_rich").otherwise("mixed")
    )


def page_route(text: Column, n_images: Column, needs_ocr: Column, mode: str = "balanced") -> Column:
    """Struct ``ocr, structure, vision`` of the steps that a page needs in a mode (``fast, balanced, max_quality``)."""
    kind = page_class(text, n_images, needs_ocr)
    ocr = needs_ocr | (kind == "scanned")
    structure = vision = F.lit(False)
    if mode == "balanced":
        structure = (kind == "table_candidate") | ((kind == "mixed") & ((_digit_lines(text) > 3) | (_count(text, "%") >= 8)))
        vision = (kind == "chart_candidate") | ((kind == "mixed") & (n_images >= 1))
    elif mode == "max_quality":
        ocr = needs_ocr | kind.isin("scanned", "mixed", "chart_candidate", "table_candidate")
        structure = kind.isin("table_candidate", "mixed")
        vision = kind.isin("chart_candidate", "mixed")
    elif mode != "fast":
        raise ValueError(f"no such mode: {mode}")
    return F.struct(ocr.alias("ocr"), structure.alias("structure"), vision.alias("vision"))


# ---- boilerplate ----------------------------------------------------------------------------------------------------


def is_boilerplate(line: Column) -> Column:
    """Whether a line is a header or footer by its text."""
    s = F.trim(line)
    marked = (F.length(s) <= 80) & _any([s.contains(m) for m in v.BOILERPLATE_MARKS])
    brand = (F.length(s) <= 24) & s.rlike(r"^[A-Z][A-Z\s.]+$")
    return F.coalesce((s != "") & (s.rlike("|".join(f"(?:{p})" for p in v.BOILERPLATE_LINES)) | marked | brand), F.lit(False))


def line_key(line: Column) -> Column:
    """What repeats of a line across pages share: no white space, no final digits."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(line, F.lit("")), SPACE, ""), r"\d+$", "")


def repeated_lines(pages: DataFrame, longest: int = 80) -> DataFrame:
    """``doc_id, line_key, n_pages`` of short lines on enough pages of a document: a quarter of them, 2 to 3."""
    n_pages = pages.groupBy("doc_id").agg(F.countDistinct("page_num").alias("n"))
    lines = pages.select("doc_id", "page_num", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).withColumn("line", F.trim("line"))
    keys = lines.where((F.length("line") > 0) & (F.length("line") <= longest)).select("doc_id", "page_num", line_key(F.col("line")).alias("line_key")).where("line_key <> ''").distinct()
    counted = keys.groupBy("doc_id", "line_key").agg(F.count(F.lit(1)).alias("n_pages")).join(n_pages, "doc_id")
    quarter = F.floor(F.col("n") / 4)
    least = F.greatest(F.lit(2), F.least(F.lit(3), F.when(quarter > 0, quarter).otherwise(2)))
    return counted.where(F.col("n_pages") >= least).drop("n")


def without_boilerplate(text: Column) -> Column:
    """A text without its boilerplate lines; runs of blank lines become one."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda s: ~is_boilerplate(s)), "\n")
    return F.trim(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def drop_blocks(blocks: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Blocks ``doc_id, page_num, type, text, y0, y1, page_height`` without headers and footers: by type, text, place on the page
    (top 8 %, bottom 10 %) or repetition; tables and formulas only by text."""
    text = F.trim(F.coalesce("text", F.lit("")))
    h = F.col("page_height")
    top, bottom = (F.col("y1") <= h * 0.08) | (F.col("y0") <= h * 0.048), F.col("y0") >= h * 0.9
    short = (F.length(text) <= 60) & ~text.contains("\n")
    footer = (F.length(text) <= 100) & (text.contains("免责") | text.contains("请务必") | text.rlike(r"\d{1,3}$"))
    thin = (F.col("y1") - F.col("y0") > 0) & (F.col("y1") - F.col("y0") < h * 0.04) & (F.length(text) < 40)
    by_place = F.coalesce((h > 0) & ((top & (short | thin)) | (bottom & (short | footer | thin))), F.lit(False))
    out = blocks.withColumn("__key", line_key(text))
    if repeated is not None:
        out = out.join(repeated.select("doc_id", F.col("line_key").alias("__key"), F.lit(True).alias("__repeats")), ["doc_id", "__key"], "left")
    else:
        out = out.withColumn("__repeats", F.lit(None).cast("boolean"))
    repeats = F.coalesce("__repeats", F.lit(False)) & (F.length(text) <= 80)
    plain = ~F.col("type").isin("table", "formula", "mermaid", "chart")
    drop = F.col("type").isin("header", "footer") | (F.col("type").isin("formula", "mermaid") & is_boilerplate(text)) | (plain & (text != "") & (is_boilerplate(text) | by_place | repeats))
    return out.where(~drop).select(*blocks.columns)


def sanitized(text: Column) -> Column:
    """Without template tags, boilerplate table cells and boilerplate lines."""
    text = F.trim(F.regexp_replace(text, r"\\?\[Table_[A-Za-z0-9_]+\\?\]", ""))

    def cell(c: Column) -> Column:
        s = F.trim(c)
        brand = s.isin(*v.BOILERPLATE_CELLS) | _any([s.startswith(p) for p in v.BOILERPLATE_CELL_STARTS]) | s.rlike(r"^[-—\s]*\d+[-—\s]*$")
        return F.when(brand, F.repeat(F.lit(" "), F.length(c))).otherwise(c)

    def line(s: Column) -> Column:
        bare = F.trim(s)
        cells = F.split(bare, r"\|", -1)
        inner = F.transform(cells, lambda c, i: F.when((i == 0) | (i == F.size(cells) - 1), c).otherwise(cell(c)))
        return F.when(bare.startswith("|") & bare.endswith("|"), F.array_join(inner, "|")).otherwise(s)

    return without_boilerplate(F.array_join(F.transform(F.split(text, "\n", -1), line), "\n"))


# ---- chunks ---------------------------------------------------------------------------------------------------------

#: A line that begins a page; only a line feed ends a line.
PAGE_MARK = r"(?md)^(?:<!--\s*page\s*:\s*\d+\s*-->|#+\s*page\s+\d+)"
BLANKS = " \t\n\r\x0b\x0c"


def hard_split(text: Column, size: int = 10_000, overlap: int = 400) -> Column:
    """Array of pieces of ``size`` characters, each starting ``overlap`` before the end of the last."""
    step = max(1, size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def _stripped(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def segments_of(text: Column) -> Column:
    """A text's pages, if two marks or more begin one (what stands before the first is no page), or else its paragraphs; none of them blank."""
    n_marks = F.size(F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(0)))
    cut = F.split(text, PAGE_MARK.replace("^(?:", "(?=^(?:", 1) + ")", -1)
    pages = F.transform(F.slice(cut, F.greatest(F.size(cut) - n_marks, F.lit(0)) + 1, F.greatest(n_marks, F.lit(1))), _stripped)
    return F.filter(F.when(n_marks >= 2, pages).otherwise(F.split(text, "\n{2,}", -1)), lambda s: _stripped(s) != "")


def packed(segments: Column, size: int = 10_000, overlap: int = 400) -> Column:
    """Segments packed up to ``size``: a fold with the chunk that is still open and those that are done. A chunk that neither comes first nor follows a
    segment that was split for its length begins with the end of the one before."""
    none = F.array().cast("array<string>")

    def joined(a: Column, b: Column) -> Column:
        return _stripped(F.concat(a, F.lit("\n\n"), b))

    def add(state: Column, s: Column) -> Column:
        held, out = state["held"], state["out"]
        long, empty, fits = F.length(s) > size, held == "", F.length(joined(held, s)) <= size
        begun = joined(F.right(held, F.lit(overlap)), s) if overlap > 0 else s
        open_ = F.when(long, "").when(empty, s).when(fits, joined(held, s)).otherwise(begun)
        done = F.when(empty, out).otherwise(F.concat(out, F.array(held)))
        return F.struct(open_.alias("held"), F.when(long, F.concat(done, hard_split(s, size, overlap))).when(empty | fits, out).otherwise(done).alias("out"))

    return F.aggregate(segments, F.struct(F.lit("").alias("held"), none.alias("out")), add, lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))


def chunks(docs: DataFrame, size: int = 10_000, overlap: int = 400) -> DataFrame:
    """``doc_id, chunk_no, chunk`` of ``doc_id, text``: a text of at most ``size`` characters whole, a longer one packed; null and blank texts have no chunk."""
    text = F.col("text")
    found = F.when(_stripped(text) == "", F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(packed(segments_of(text), size, overlap))
    return docs.select("doc_id", F.posexplode(found).alias("chunk_no", "chunk"))


# ---- numbers and metrics --------------------------------------------------------------------------------------------

NUMBER = re.compile(rf"{v.CURRENCY}({v.ANY_NUMBER})\s*(?:(?:-|~|至)\s*{v.CURRENCY}(?:{v.ANY_NUMBER})\s*)?({v.NUMBER_UNIT})?", re.I)
METRIC = re.compile(
    rf"{v.CURRENCY}{v.PERIOD}({'|'.join(v.METRICS)})\s*[:：]?\s*({v.VERBS})?\s*{v.PERIOD}\s*{v.CURRENCY}([+-]?\d+(?:\.\d+)?)\s*"
    rf"(?:(?:-|~|至)\s*{v.CURRENCY}[+-]?\d+(?:\.\d+)?\s*)?(亿元|万元|万|元|%)?",
    re.I,
)
#: Decimal digits of all scripts, and the ASCII digits that they stand for.
DIGITS = tuple(map("".join, zip(*((chr(c), str(unicodedata.decimal(chr(c)))) for c in range(128, 0x10000) if chr(c).isdecimal()))))
KINDS = (("yoy", "YoY"), ("qoq", "QoQ"), ("同比", "同比"), ("环比", "环比"))
METRICS_TYPE = "array<struct<name:string,raw_name:string,value:double,unit:string,yoy:double,qoq:double>>"


def numbers_in(text: str) -> list[dict]:
    """Numbers of a text with units and places; in brackets they are negative."""
    out = []
    for m in NUMBER.finditer(text):
        digits, unit = m[1], m[2]
        bracketed = digits[0] in "(（"
        value = float(re.sub("[,、()（）]", "", digits)) * (-1 if bracketed else 1)
        if unit:
            bare = re.sub(r"\s+", "", unit).lower()
            unit = next((name for mark, name in KINDS if mark in bare), unit)
        out.append({"value": value, "unit": unit, "raw": m[0], "start": m.start(), "end": m.end()})
    return out


def _has(text: str, words) -> bool:
    return any(w in text for w in words)


def _changes_after(text: str) -> dict[str, float]:
    """Changes on the year and on the quarter said in the text after a metric."""
    found: dict[str, float] = {}
    seen = 0
    for n in numbers_in(text):
        before, after = text[seen : n["start"]], text[n["end"] : n["end"] + 10]
        seen = n["end"]
        around = before + "\0" + after
        bracketed = before.strip().endswith(("(", "（")) and after.strip().startswith((")", "）")) and n["unit"] == "%"
        if n["unit"] in ("YoY", "同比"):
            kind = "yoy"
        elif n["unit"] in ("QoQ", "环比") or _has(around, ("环比", "QoQ")):
            kind = "qoq"
        elif _has(around, ("同比", "YoY")) or bracketed or _has(before, v.RISES + v.FALLS):
            kind = "yoy"
        else:
            continue
        found[kind] = -abs(n["value"]) if _has(before, v.FALLS) else n["value"]
    return found


def metrics_in(text: str) -> list[dict]:
    """Financial metrics named in a text with value, unit and changes; a falling verb makes the value negative."""
    out = []
    for m in METRIC.finditer(text):
        name, verb, value = m[1], m[2] or "", float(m[3])
        changes = _changes_after(text[m.end() : m.end() + 40])
        out.append({"name": v.GLOSSARY.get(name.strip(), name.strip()), "raw_name": name, "value": -abs(value) if _has(verb, v.FALLS) else value, "unit": m[4], "yoy": changes.get("yoy"), "qoq": changes.get("qoq")})
    return out


def table_metrics_in(table: str) -> list[dict]:
    """Metrics of a table's rows whose first cell names one."""
    out = []
    for cells in rows_of(table):
        name = cells[0] if cells else ""
        known = v.GLOSSARY.get(name, name) != name or re.fullmatch("|".join(v.METRICS), name, re.I)
        for cell in filter(None, cells[1:] if name and known else []):
            found = metrics_in(f"{name} {cell}")
            if not found and (numbers := numbers_in(cell)):
                found = [{"name": v.GLOSSARY.get(name, name), "raw_name": name, "value": numbers[0]["value"], "unit": numbers[0]["unit"], "yoy": None, "qoq": None}]
            out += found
    return out


def _scan(f, returns: str):
    @F.pandas_udf(returns)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(t or ""))

    return scan


def number_spans(text: Column) -> Column:
    """Array of ``(value, unit, raw, start, end)``: the same as ``numbers_in``, without Python."""
    found = match_places(F.coalesce(text, F.lit("")), f"(?iU){NUMBER.pattern}", (1, 2), needs=r"(?U)\d")

    def number(m: Column) -> Column:
        digits, bare = m["g1"], F.lower(F.regexp_replace(m["g2"], r"(?U)\s+", ""))
        sign = F.when(F.substring(digits, 1, 1).isin("(", "（"), -1.0).otherwise(1.0)
        unit = F.when(m["g2"] != "", m["g2"])
        for mark, name in reversed(KINDS):
            unit = F.when(bare.contains(mark), name).otherwise(unit)
        value = F.translate(F.regexp_replace(digits, "[,、()（）]", ""), *DIGITS).cast("double") * sign
        return F.struct(value.alias("value"), unit.alias("unit"), m["raw"].alias("raw"), m["start"].alias("start"), m["end"].alias("end"))

    return F.transform(found, number)


def metric_items(text: Column) -> Column:
    return _scan(metrics_in, METRICS_TYPE)(text)


def table_metric_items(text: Column) -> Column:
    return _scan(table_metrics_in, METRICS_TYPE)(text)


def canonical_term(term: Column) -> Column:
    """The glossary's name for a term, else the term itself without surrounding spaces."""
    glossary = F.create_map(*[F.lit(x) for pair in v.GLOSSARY.items() for x in pair])
    return F.coalesce(F.element_at(glossary, F.trim(term)), F.trim(term))


# ---- tables ---------------------------------------------------------------------------------------------------------


def rows_of(table: str) -> list[list[str]]:
    """Cells of a pipe table without separator rows."""
    lines = [s.strip() for s in table.strip().split("\n")]
    cells = [[c.strip() for c in s.strip("|").split("|")] for s in lines if s.startswith("|")]
    return [r for r in cells if not all(re.fullmatch(r":?-+:?", c or "-") for c in r)]


def table_rows(table: Column) -> Column:
    """Array of arrays of cells of a pipe table, without separator rows."""
    lines = F.filter(F.transform(F.split(F.trim(table), "\n"), lambda s: F.trim(s)), lambda s: s.startswith("|"))
    cells = F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c)))
    return F.filter(cells, lambda r: F.exists(r, lambda c: ~c.rlike(r"^(:?-+:?)?$")))


def _all_cells(rows: Column) -> Column:
    return F.flatten(rows)


def table_score(rows: Column) -> Column:
    """0 to 1 from empty cells, cell lengths, widths, glued headers and garbage; 0 for what is no table. Tables pass from 0.35."""
    header, data = F.get(rows, 0), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))
    cells = _all_cells(data)
    n, cols = F.size(cells), F.size(header)
    empty = F.size(F.filter(cells, lambda c: c == "")) / F.when(n > 0, n)
    mean = F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c)) / F.when(n > 0, n)
    first = F.coalesce(F.get(F.get(data, 0), 0), F.lit(""))
    bad = F.exists(cells, lambda c: c.contains("请务必阅读正文之后")) | _any([first.contains(w) for w in v.CONTAMINATED])
    widths = F.array_sort(F.transform(data, lambda r: F.size(r)))
    off = F.abs(F.get(widths, F.floor(F.size(widths) / 2).cast("int")) - cols)
    empty_heads = F.size(F.filter(header, lambda c: c == ""))
    long_head = F.exists(header, lambda c: F.length(F.regexp_replace(c, r"\s+", "")) >= 18) & (cols >= 4)
    sample = F.array_join(F.concat(header, _all_cells(F.slice(data, 1, 3))), "|")
    garbage = sum((F.when(sample.contains(g), 1).otherwise(0) for g in v.GARBAGE), F.lit(0))
    score = 1.0 - empty * 0.2 - mean / 100 * 0.2 - F.when(off >= 2, 0.25).when(off == 1, 0.1).otherwise(0.0)
    score = score - F.when(empty_heads >= F.greatest(F.lit(2), F.floor(cols / 2)), 0.3).otherwise(0.0) - F.when(long_head, 0.2).otherwise(0.0) - garbage * 0.12
    usable = (F.size(rows) >= 2) & (cols >= 2) & (n > 0) & ~bad & (mean <= 100) & (empty <= 0.7)
    return F.when(F.coalesce(usable, F.lit(False)), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def statement_type(rows: Column) -> Column:
    """Struct ``statement, confidence`` by the words of financial statements in a table."""
    text = F.array_join(_all_cells(rows), " ")
    hits = {k: sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0)) for k, words in v.STATEMENTS.items()}
    best = F.greatest(*hits.values())
    order = F.reverse(F.array_sort(F.array(*hits.values())))
    second = F.get(order, 1)
    base = F.least(best / 5.0, F.lit(1.0))
    sure = F.when(second == 0, F.least(0.5 + base * 0.5, F.lit(1.0))).otherwise(base * best / F.when(best > 0, best + second))
    name = F.lit("unknown")
    for k in reversed(hits):
        name = F.when((best > 0) & (hits[k] == best), k).otherwise(name)
    return F.struct(name.alias("statement"), F.when(best > 0, F.round(F.greatest(sure, F.lit(0.3)), 3)).otherwise(0.0).alias("confidence"))


def is_total_row(cells: Column) -> Column:
    return F.exists(cells, lambda c: _any([F.lower(c).contains(w) for w in v.TOTALS]))


def header_row(rows: Column) -> Column:
    """Number of the header among the first five rows: the first with the most years, units and header words; 0 if none scores 2."""

    def points(c: Column) -> Column:
        score = F.when(c.rlike(r"\b(?:19|20)\d{2}\b"), 2).otherwise(0) + F.when(c.contains("年"), 1).otherwise(0)
        score = score + F.when(_any([c.contains(u) for u in ("亿元", "万元", "%")]), 1).otherwise(0)
        return score + F.when(_any([c.contains(w) for w in ("指标", "项目", "科目")]), 2).otherwise(0)

    scores = F.transform(F.slice(rows, 1, 5), lambda r: F.aggregate(r, F.lit(0), lambda a, c: a + points(c)))
    best = F.array_max(scores)
    return F.when(best >= 2, F.array_position(scores, best).cast("int") - 1).otherwise(0)


def total_mismatches(tables: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``table_id, row_no, col_no, expected, actual`` where a total row differs from the sum of the plain rows above it.

    ``tables``: ``table_id, rows`` (arrays of cells). Cells are exploded; the sums are grouped aggregates by table and column."""
    number = _scan(lambda t: next((n["value"] for n in numbers_in(t)), None), "double")
    rows = tables.select("table_id", F.size(F.get("rows", 0)).alias("cols"), F.size("rows").alias("n_rows"), F.posexplode("rows").alias("row_no", "cells")).where("n_rows >= 3 AND row_no > 0 AND size(cells) = cols")
    rows = rows.withColumn("total", is_total_row(F.col("cells")))
    cells = rows.select("table_id", "row_no", "total", F.posexplode("cells").alias("col_no", "cell")).where("col_no > 0").withColumn("value", number("cell"))
    above = Window.partitionBy("table_id", "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.when(~F.col("total"), F.col("value"))
    summed = cells.withColumns({"expected": F.sum(plain).over(above), "found": F.count(plain).over(above)})
    off = summed.where("total AND value IS NOT NULL AND found > 0").where(F.abs(F.col("expected") - F.col("value")) > tolerance)
    return off.select("table_id", "row_no", "col_no", "expected", F.col("value").alias("actual"))


def merge_continued(blocks: DataFrame) -> DataFrame:
    """Tables continued over pages joined to one: ``doc_id, page_num, pages, table``.

    ``blocks``: ``doc_id, page_num, block_no, type, text``. A table at the end of a page and one at the start of the next page with
    blocks are one if their header lines agree but for bars and white space. Chains are islands in page order.
    """
    page = Window.partitionBy("doc_id", "page_num")
    by_place = Window.partitionBy("doc_id").orderBy("page_num", "block_no")
    head = F.regexp_replace(F.get(F.split(F.trim("text"), "\n"), 0), r"[|\s]+", "")
    b = blocks.withColumns({"first": F.col("block_no") == F.min("block_no").over(page), "last": F.col("block_no") == F.max("block_no").over(page), "head": head})
    before = {n: F.lag(n).over(by_place) for n in ("type", "last", "head")}
    follows = (F.col("type") == "table") & F.col("first") & (before["type"] == "table") & before["last"] & (before["head"] == F.col("head"))
    b = b.withColumn("follows", F.coalesce(follows, F.lit(False))).where("type = 'table'")
    b = b.withColumn("chain", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(by_place))
    lines = F.split(F.trim("text"), "\n")
    body = F.when(F.coalesce(F.get(lines, 1).rlike(r"^[|\-\s]*$"), F.lit(False)) & (F.size(lines) > 2), F.slice(lines, 3, F.size(lines))).otherwise(F.slice(lines, 2, F.size(lines)))
    b = b.withColumn("part", F.when(F.col("follows"), body).otherwise(lines))
    in_order = F.array_sort(F.collect_list(F.struct("page_num", "block_no", "part")))
    merged = b.groupBy("doc_id", "chain").agg(in_order.alias("parts"))
    return merged.select("doc_id", F.get("parts", 0)["page_num"].alias("page_num"), F.array_distinct(F.col("parts.page_num")).alias("pages"), F.array_join(F.flatten("parts.part"), "\n").alias("table"))


# ---- formulas, diagrams, quality ------------------------------------------------------------------------------------


def is_formula_line(line: Column) -> Column:
    """Whether private-use characters, operators, risk names and an equation number make a line a formula: 5 points or more."""
    n = F.length(line)
    private, cjk = _count(line, r"[\ue000-\uf8ff]"), _count(line, r"[\u4e00-\u9fff]")
    operators, latin = _count(line, r"[=+\-*/<>()\[\]]"), _count(line, "[a-zA-Z]")
    rejected = line.rlike(r"\[Table_[A-Za-z0-9_]+\]") | line.rlike("(?i)Tel:|Email:|证书:") | ((cjk > 40) & (private / F.when(n > 0, n) < 0.02) & ~line.rlike(r"ES|VaR|∑|\\sum|[≤≥=+\-]"))
    score = private * 3 + F.when(line.rlike("ES|VaR|CVaR") & ((operators > 0) | (private > 0)), 5).otherwise(0) + F.when(line.rlike(r"\(\d+\)\s*$"), 5).otherwise(0)
    score = score + F.when((n < 50) & ((operators > 0) | (private > 0)) & (latin > 0), F.least(F.lit(5), operators + private)).otherwise(0)
    score = score - F.when((n > 30) & (cjk > n * 0.5) & (operators == 0) & (private == 0), 10).otherwise(0)
    found = F.coalesce((F.trim(line) != "") & ~rejected & (score >= 5), F.lit(False))
    return F.when(line.rlike(r"[=+\-*/<>()\[\]\ue000-\uf8ff]"), found).otherwise(False)  # no other line has points


def formula_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, start_line, end_line, n_lines`` of runs of formula lines: islands in line order."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")).where(is_formula_line(F.col("line")))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("n_lines")).drop("island")


#: What is no formula by itself, and what makes a short text one.
TRIVIAL_FORMULAS = ("(", ")", "((", "))", "...", "…", r"\dots")
TELLING = r"ES|\\sum|∑|\\leq|≤|\\lambda|w_"
BOUNDS = ("x0", "y0", "x1", "y1")


def is_trivial_formula(latex: Column) -> Column:
    """Whether a formula says nothing: empty, a lone bracket or dots, or fewer than four characters without a telling name."""
    bare = F.regexp_replace(F.coalesce(latex, F.lit("")), r"\s+", "")
    return bare.isin("", *TRIVIAL_FORMULAS) | ((F.length(bare) < 4) & ~latex.rlike(TELLING))


def promoted_formulas(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_num, block_no, piece, type, text, eq_number, x0, y0, x1, y1, confidence``: text blocks cut at their runs of formula lines.

    A run becomes a block of type ``formula`` with its text as LaTeX and the number that it ends with; a trivial one stays text. Text
    between runs loses its private-use glyphs, and goes if it is blank. Blocks of other types, and texts without formulas, stay whole
    (piece 0); pieces have their block's bounds and confidence. A null text stays, and reads as empty once merged.
    """
    own = ["doc_id", "page_num", "block_no"]
    cut = (F.col("type") == "text") & (F.coalesce("text", F.lit("")) != "")
    others = blocks.where(~F.coalesce(cut, F.lit(False))).select(*own, F.lit(0).alias("piece"), "type", "text", F.lit(None).cast("string").alias("eq_number"), *BOUNDS, "confidence")
    lines = blocks.where(cut).select(*own, *BOUNDS, "confidence", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("formula", is_formula_line(F.col("line")))
    down = Window.partitionBy(*own).orderBy("n")
    turns = (F.col("formula") != F.lag("formula").over(down)).cast("int")
    lines = lines.withColumn("turn", F.coalesce(turns, F.lit(0))).withColumn("piece", F.sum("turn").over(down).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    pieces = lines.groupBy(*own, "piece").agg(F.first("formula").alias("formula"), text.alias("raw"), *(F.first(c).alias(c) for c in (*BOUNDS, "confidence")))
    pieces = pieces.withColumn("n_pieces", F.count(F.lit(1)).over(Window.partitionBy(*own))).where(F.col("formula") | (F.col("n_pieces") == 1) | (F.trim("raw") != ""))
    # each in a column of its own: as expressions they would be written out, and reckoned, wherever they are named
    pieces = pieces.withColumn("latex", F.when(F.col("formula"), glyphs_to_latex(F.col("raw"))))
    pieces = pieces.withColumn("real", F.col("formula") & ~is_trivial_formula(F.col("latex")))
    pieces = pieces.withColumn("number", F.when(F.col("real"), F.regexp_extract("raw", r"\(\s*(\d+)\s*\)\s*$", 1)))
    found = pieces.select(
        *own, "piece", F.when(F.col("real"), "formula").otherwise("text").alias("type"), F.when(F.col("real"), F.col("latex")).otherwise(glyphs_to_unicode(F.col("raw"))).alias("text"),
        F.when(F.col("number") != "", F.col("number")).alias("eq_number"), *BOUNDS, "confidence",
    )
    return others.unionByName(found)


def merged_formulas(blocks: DataFrame) -> DataFrame:
    """Promoted ``blocks`` with each run of formulas of a page as one block, and ``n_blocks``, the number that it was.

    A formula goes on in the next block while that one has no number, or the number of the formula. So a numbered block begins a
    formula unless the last number before it in the run is its own; that is all that is carried along a run.
    Texts are joined as lines of one formula, bounds are united (null bounds count for nothing); the first block's number and confidence stay.
    """
    page = Window.partitionBy("doc_id", "page_num").orderBy("block_no", "piece")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    formula = F.col("type") == "formula"
    runs = blocks.withColumns({"run": F.count_if(~formula).over(so_far), "new": F.coalesce(~formula | (F.lag("type").over(page) != "formula"), F.lit(True))})
    before = Window.partitionBy("doc_id", "page_num", "run").orderBy("block_no", "piece").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(formula, F.col("eq_number")), ignorenulls=True).over(before)
    begins = F.col("new") | (F.col("eq_number").isNotNull() & ~F.col("eq_number").eqNullSafe(last))
    chained = runs.withColumn("begins", begins).withColumn("chain", F.count_if("begins").over(so_far))
    first = F.min_by(F.struct("block_no", "piece", "type", "eq_number", "confidence"), F.struct("block_no", "piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "piece", "text"))), lambda x: x["text"]), r" \\ ")
    united = [*(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1"))]
    merged = chained.groupBy("doc_id", "page_num", "chain").agg(first.alias("f"), text.alias("text"), *united, F.count(F.lit(1)).alias("n_blocks"))
    return merged.select("doc_id", "page_num", "f.block_no", "f.piece", "f.type", "text", "f.eq_number", *BOUNDS, "f.confidence", "n_blocks")


def is_diagram(code: Column) -> Column:
    first = F.trim(F.get(F.split(F.trim(code), "\n"), 0))
    return F.coalesce(_any([first.startswith(d) for d in v.DIAGRAMS]), F.lit(False))


def quality_counters(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """``by, n_blocks, n_low_confidence, n_bad_diagrams`` of blocks ``type, text, confidence``."""
    return blocks.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("confidence") < 0.8).alias("n_low_confidence"), F.count_if((F.col("type") == "mermaid") & ~is_diagram(F.col("text"))).alias("n_bad_diagrams")
    )


def overlaps_table(text: Column, table: Column, share: float = 0.5) -> Column:
    """Whether more than a share of a text's characters (white space aside) occur in a table's."""
    chars = F.split(F.regexp_replace(text, r"\s+", ""), "")
    known = F.array_distinct(F.split(table, ""))
    n = F.size(chars)
    return F.coalesce(F.size(F.filter(chars, lambda c: F.array_contains(known, c))) / F.when(n > 0, n) > share, F.lit(False))


def reading_order(blocks: DataFrame, *ties: str) -> DataFrame:
    """``blocks`` (``doc_id, page_num, x0, y0``) with ``place``: rows of ten points from top to bottom, then left to right, then by ``ties``."""
    order = Window.partitionBy("doc_id", "page_num").orderBy(F.rint(F.col("y0") / 10) * 10, "x0", *ties)
    return blocks.withColumn("place", F.row_number().over(order))


# ---- glyphs and table repair ----------------------------------------------------------------------------------------

# Private-use glyphs of symbol fonts, as Unicode and as LaTeX.
GLYPHS = {
    "\uf0e5": ("∑", "\\sum"), "\uf0a3": ("≤", "\\leq"), "\uf03d": ("=", "="), "\uf02b": ("+", "+"), "\uf02d": ("-", "-"), "\uf0e6": ("", ""), "\uf0e7": ("(", "("), "\uf0e8": ("", ""),
    "\uf0f6": ("", ""), "\uf0f7": (")", ")"), "\uf0f8": ("", ""), "\uf028": ("(", "("), "\uf029": (")", ")"), "\uf05b": ("[", "["), "\uf05d": ("]", "]"), "\uf065": ("ε", "\\varepsilon"),
    "\uf0b9": ("≠", "\\neq"), "\uf04c": ("…", "\\dots"), "\uf04d": ("…", "\\dots"), "\uf04b": ("…", "\\dots"), "\uf04f": ("…", "\\dots"),
}
LAMBDA = "\uf06c"


def _glyphs(text: Column, latex: bool) -> Column:
    bullet = F.ltrim(text, F.lit(" \t\r\n\f\x0b")).startswith(LAMBDA) & text.rlike(r"[一-鿿]")
    out = F.when(bullet, F.replace(text, F.lit(LAMBDA), F.lit("•"))).otherwise(F.replace(text, F.lit(LAMBDA), F.lit("\\lambda" if latex else "λ")))
    for glyph, forms in GLYPHS.items():
        out = F.replace(out, F.lit(glyph), F.lit(forms[latex]))
    return F.when(text.rlike(r"[\uf000-\uf0ff]"), out).otherwise(text)  # all glyphs, lambda too, are in this range


def glyphs_to_unicode(text: Column) -> Column:
    """Private-use glyphs as Unicode; a leading lambda before Chinese is a bullet."""
    return _glyphs(text, latex=False)


def glyphs_to_latex(text: Column) -> Column:
    """Private-use glyphs as LaTeX, commands set off by spaces, common subscripts."""
    out = _glyphs(text, latex=True)
    for plain, indexed in (("ESi", "ES_i"), ("Xi", "X_i"), ("wi", "w_i")):
        out = F.regexp_replace(out, rf"\b{plain}\b", indexed)
    out = F.regexp_replace(out, r"(?<!\s)(\\leq|\\sum|\\lambda|\\dots)(?!\s)", " $1 ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def split_numbers(cell: str) -> list[str]:
    """The numbers of a cell that holds nothing else; the cell itself where it is no run of numbers."""
    parts = re.findall(r"[+-]?\d+(?:\.\d+)?%?", cell)
    glued = re.fullmatch(r"([+-]?\d+(?:\.\d+)?%)([+-]?\d+(?:\.\d+)?%)", cell)
    if glued:
        return list(glued.groups())
    return parts if len(parts) >= 2 and "".join(parts) == re.sub(r"[\s,，、;/|]+", "", cell) else [cell]


def split_header(cell: str, words: tuple[str, ...]) -> list[str]:
    """A header cell cut into the known words that it runs together, the longest first; what lies between stays as it is."""
    pieces = re.split("(" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")", re.sub(r"\s+", "", cell)) if words else [cell]
    return [p for p in (x.strip("、，,./;；:：|·• ") for x in pieces) if p in words or len(p) >= 2 or re.fullmatch("[A-Za-z0-9%]+", p)]


def fitted(row: list[str], width: int) -> list[str]:
    """A data row brought to a width: run-together numbers are split into the places that empty cells leave, what is too much
    goes to the last cell."""
    solid = [c for c in row if c]
    if len(solid) < len(row) and sum(len(split_numbers(c)) for c in solid) >= width:
        row = solid
    while len(row) > width and "" in row:
        row.remove("")
    out: list[str] = []
    for k, cell in enumerate(row):
        parts = split_numbers(cell)
        out += parts if len(out) + len(parts) + len(row) - k - 1 <= width else [cell]
    return out[: width - 1] + [" ".join(out[width - 1 :])] if len(out) > width else out + [""] * (width - len(out))


def repaired(table: str, phrases: dict[str, str] | None = None, header_words: tuple[str, ...] = ()) -> str:
    """A pipe table with known misreadings replaced (longest first), run-together headers and numbers split, rows of one width.

    ``phrases`` and ``header_words`` are a corpus's own lexicon."""
    for wrong in sorted(phrases or {}, key=len, reverse=True):
        table = table.replace(wrong, phrases[wrong])
    rows = rows_of(table)
    if len(rows) < 2:
        return table
    header = [h for c in rows[0] for h in (split_header(c, header_words) if sum(w in c for w in header_words) >= 2 else [c])]
    widths = sorted(len(r) for r in rows[1:])
    typical = widths[len(widths) // 2]
    width = len(header) if len(header) > len(rows[0]) or abs(len(header) - typical) <= 1 and len(header) >= 6 else max(typical, 2)
    lines = [fitted(header, width), ["---"] * width, *(fitted(r, width) for r in rows[1:])]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)


def repaired_table(text: Column, phrases: dict[str, str] | None = None, header_words: tuple[str, ...] = ()) -> Column:
    return _scan(lambda t: repaired(t, phrases, header_words), "string")(text)
