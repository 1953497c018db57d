"""Report sinks: results as JSON, catalogue entries as Markdown pages with an index, and an HTML overview.

A sink is a table of files ``path, text``, made by Spark however many there are, and one writer that puts each row in its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PanelError
from ..session import staged

#: Labels of a page and of the index.
LABELS = (("风格", "style"), ("版本", "version"), ("状态", "status"), ("Universe", "universe"), ("调仓频率", "rebalance_frequency"))
INDEX_HEAD = "| 因子 | 风格 | 版本 | 状态 | 去重哈希 | 创建时间 |\n|------|------|------|------|----------|----------|"
#: Characters that a file name must not have, and its greatest length.
UNSAFE, LONGEST_NAME = r'[\\/:*?"<>|\s]+', 120


def file_name(name: Column) -> Column:
    """A name as part of a path; ``factor`` where nothing is left of it."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), UNSAFE, "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.when(bare == "", "factor").otherwise(bare), 1, LONGEST_NAME)


def run_status(total: Column, passed: Column, errors: Column) -> Column:
    return F.when(errors == total, "error").when(passed == total, "passed").when(passed > 0, "partial").otherwise("failed")


def result_files(results: DataFrame, start: str, end: str) -> DataFrame:
    """``path, text``: one JSON result of each report from rows ``report_id, factor, passed, error`` (a report's factors are a short list)."""
    counted = results.groupBy("report_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("factor").alias("factor_name"), F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("error", F.lit("")).alias("error")))).alias("factors"),
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("passed") & F.col("error").isNull()).alias("n_passed"), F.count_if(F.col("error").isNotNull()).alias("n_errors"),
    )
    summary = F.struct("total", F.col("n_passed").alias("passed"), (F.col("total") - F.col("n_passed") - F.col("n_errors")).alias("failed"), F.col("n_errors").alias("errors"))
    window = F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"))
    status = run_status(F.col("total"), F.col("n_passed"), F.col("n_errors"))
    text = F.to_json(F.struct("report_id", status.alias("status"), "factors", summary.alias("summary"), window.alias("backtest_window")))
    return counted.select(F.concat(file_name(F.col("report_id")), F.lit("/result.json")).alias("path"), text.alias("text"))


def wiki_pages(entries: DataFrame) -> DataFrame:
    """``path, text``: a Markdown page of each catalogue entry; what is null leaves its line empty."""

    def own(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    fields = F.array_join(F.transform("input_fields", lambda f: F.concat(F.lit("- "), f)), "\n")
    lines = [
        F.concat(F.lit("# "), own("name_cn"), F.lit(" ("), own("name"), F.lit(")")), F.lit(""), *[F.concat(F.lit(f"- **{label}**: "), own(c)) for label, c in LABELS],
        F.concat(F.lit("- **去重哈希**: `"), own("dedup_hash"), F.lit("`")), F.concat(F.lit("- **创建时间**: "), F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit(""))), F.lit(""),
        F.lit("## 公式\n\n```"), own("formula"), F.lit("```\n\n## 输入字段\n"), F.coalesce(fields, F.lit("")),
        F.lit("\n## 标签\n"), F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("（无）"), F.lit("\n[← 返回索引](../INDEX.md)\n"),
    ]
    return entries.select(F.concat(F.lit("factors/"), file_name(F.col("name")), F.lit(".md")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


def index_lines(entries: DataFrame) -> DataFrame:
    """``place, line`` of the index: a row for each entry, the newest first, ties by hash."""
    cells = [
        F.concat(F.lit("["), "name_cn", F.lit("](factors/"), file_name(F.col("name")), F.lit(".md)")), F.col("style"), F.col("version").cast("string"), F.col("status"), F.substring("dedup_hash", 1, 8),
        F.date_format("created_at", "yyyy-MM-dd HH:mm"),
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))
    # numbered within a day, after all days that are later; the window over days sees one row a day
    rows = entries.select(F.to_date("created_at").alias("day"), "created_at", "dedup_hash", line.alias("line"))
    latest_first = Window.orderBy(F.desc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).select(F.col("day").alias("of_day"), F.coalesce(F.sum("n").over(latest_first), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("created_at"), "dedup_hash", "line"))
    placed = rows.withColumn("k", within).join(F.broadcast(days), F.col("day").eqNullSafe(F.col("of_day")))
    return placed.select((F.col("before") + F.col("k")).cast("int").alias("place"), "line")


def index_file(entries: DataFrame) -> DataFrame:
    """``path, text`` of the index: one file by its nature."""
    rows = index_lines(entries).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    text = F.concat(F.lit("# 因子库索引\n\n共 "), "n", F.lit(f" 个因子。\n\n{INDEX_HEAD}\n"), F.array_join("lines.line", "\n"), F.lit("\n"))
    return rows.select(F.lit("INDEX.md").alias("path"), text.alias("text"))


def overview_file(stats: DataFrame, title: str = "因子库仪表盘") -> DataFrame:
    """``path, text`` of an HTML table of factors' statistics ``name, ic, icir, ann_return, max_drawdown, win_rate``; readable without scripts."""
    columns = ("ic", "icir", "ann_return", "max_drawdown", "win_rate")

    def escaped(c: Column) -> Column:
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(sign), F.lit(entity))
        return c

    cells = [F.concat(F.lit("<td>"), F.coalesce(F.format_string("%.4f", F.col(c).cast("double")), F.lit("")), F.lit("</td>")) for c in columns]
    row = F.concat(F.lit("<tr><th>"), escaped(F.col("name")), F.lit("</th>"), *cells, F.lit("</tr>"))
    head = "".join(f"<th>{c}</th>" for c in ("name", *columns))
    rows = stats.agg(F.array_sort(F.collect_list(F.struct("name", row.alias("row")))).alias("rows"))
    text = F.concat(F.lit(f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1>\n<table><tr>{head}</tr>\n'), F.array_join("rows.row", "\n"), F.lit("\n</table></body></html>\n"))
    return rows.select(F.lit("dashboard.html").alias("path"), text.alias("text"))


#: Files beyond which the driver, which names them one by one, refuses; ``write_table`` has no bound.
MOST_FILES = 20_000


def distinct_paths(files: DataFrame) -> DataFrame:
    """``files`` with each path once: of rows that share one, the first by their text's digest keeps it and the others are numbered before the ending (``a-2.md``)."""
    k = F.row_number().over(Window.partitionBy("path").orderBy(F.sha2("text", 256)))
    ending = F.regexp_extract("path", r"(\.[^./]*)?$", 1)
    numbered = F.concat(F.expr("substring(path, 1, length(path) - length(ending))"), F.lit("-"), F.col("k"), F.col("ending"))
    return files.withColumns({"k": k, "ending": ending}).withColumn("path", F.when(F.col("k") > 1, numbered).otherwise(F.col("path"))).drop("k", "ending")


def write_table(files: DataFrame, folder: str) -> None:
    """All files as one table ``path, text``, written by the executors: the sink for any number of them."""
    distinct_paths(files).select("path", "text").write.mode("overwrite").parquet(folder)


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row's text to its path under ``folder``, through Spark's own file system, so that any store will do; their number.

    Rows that share a path are numbered first; nothing is written if a number's path is taken too, or if there are more than ``MOST_FILES``.
    """
    spark = files.sparkSession
    pending = f"{folder.rstrip('/')}/_rows"
    # as text rows partitioned by path: the executors write; then each part takes its file's name
    numbered = staged(distinct_paths(files).select(F.sha2("path", 256).alias("key"), "path", "text"), "report-files")
    n, different = numbered.agg(F.count(F.lit(1)), F.countDistinct("path")).first()
    if n > MOST_FILES or different < n:
        raise PanelError(f"{n} files, {different} of them with a path of their own")
    numbered.select("key", F.col("text").alias("value")).repartition("key").write.mode("overwrite").partitionBy("key").option("lineSep", "\n").text(pending)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{pending}/key=*/part-*"))
    part_of = {p.getPath().getParent().getName().removeprefix("key="): p.getPath() for p in parts or []}
    for r in numbered.select("key", "path").toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{r['path']}")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        fs.rename(part_of[r["key"]], target)
    fs.delete(jvm.org.apache.hadoop.fs.Path(pending), True)
    return n
