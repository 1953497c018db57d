"""Results that differed from the queries' SQL on odd or larger tables."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from factorloom.functions import ieee
from factorloom.queries import ORACLE_SQL, QUERIES, load_all

from .oracle import assert_same

load_all()


def events(spark, tmp_path, rows):
    """A folder with an events table of ``day, hour, user, value``, and a connection to it."""
    start = dt.datetime(2024, 1, 1)
    ticks = [(i, start + dt.timedelta(days=d, hours=h), u, float(v)) for i, (d, h, u, v) in enumerate(rows)]
    spark.createDataFrame(ticks, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    return con


def test_rounding_as_in_sql(spark):
    """Ratios that meet a half at the seventh decimal; numbers that overflow when scaled; those that are no numbers."""
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT a, b, (a / 100) / (b / 100) - 1 AS x FROM range(1, 1500) r(a), (VALUES (64), (128), (192), (320), (384), (640), (1280)) s(b)")
    con.execute("INSERT INTO t SELECT 0, 0, unnest([1e300, -1e305, 1e308, 'inf', '-inf', 'nan', 0.0, -0.0000005, 0.49999999999999994e-6, NULL]::DOUBLE[])")
    df = spark.createDataFrame(con.execute("SELECT x FROM t").fetchall(), "x double")
    assert df.where(F.round("x", 6) != ieee.rounded(F.col("x"), 6)).count() > 0
    assert_same(df.select("x", (ieee.rounded(F.col("x"), 6) + F.lit(0.0)).alias("r")), con, "SELECT x, round(x, 6) + 0.0 AS r FROM t")


def test_bootstrap_without_finite_returns(spark, tmp_path):
    """Each day one user's close is 0, so every day has an infinite return: no draws, as in the SQL."""
    con = events(spark, tmp_path, [(d, h, u, 0.0 if u == d % 10 else 1 + (u * 7 + d * 3) % 11) for d in range(12) for u in range(10) for h in (1,)])
    assert con.execute(f"SELECT n_boot, n_dropped FROM ({ORACLE_SQL['robust_bootstrap']})").fetchone() == (0, 6)
    assert_same(QUERIES["robust_bootstrap"](spark, str(tmp_path)), con, ORACLE_SQL["robust_bootstrap"])


@pytest.mark.parametrize("zeros, days", [(1, 12), (0, 12), (0, 7), (0, 3)])
def test_summary_of_infinite_returns(spark, tmp_path, zeros, days):
    """A close of 0 makes a return infinite: the summary says so rather than 0. Of one day, or of none, most measures are null."""
    con = events(spark, tmp_path, [(d, 1, u, 0.0 if zeros and (d, u) == (6, 3) else 1 + (u * 7 + d * d * 3 + u * d) % 17) for d in range(days) for u in range(10)])
    nonfinite = con.execute(f"SELECT n_nonfinite FROM ({ORACLE_SQL['backtest_summary']})").fetchone()[0]
    assert (nonfinite > 0) == bool(zeros)
    assert_same(QUERIES["backtest_summary"](spark, str(tmp_path)), con, ORACLE_SQL["backtest_summary"])


@pytest.mark.parametrize("odd", ["zero", "constant", None])
def test_redundancy_of_undefined_values(spark, tmp_path, odd):
    """A close of 0, or one tick a day for all (a constant activity), makes correlations NaN, which SQL ranks above all numbers."""
    rows = [(d, h, u, 0.0 if odd == "zero" and (d, u) == (3, 3) else 1 + (u * 7 + d * d * 3 + u * d + h * 5) % 17) for d in range(12) for u in range(8) for h in range(1 if odd == "constant" else 1 + (u + d) % 3)]
    con = events(spark, tmp_path, rows)
    assert con.execute(f"SELECT bool_or(isnan(correlation)) FROM ({ORACLE_SQL['catalog_redundancy']})").fetchone()[0] == bool(odd)
    assert_same(QUERIES["catalog_redundancy"](spark, str(tmp_path)), con, ORACLE_SQL["catalog_redundancy"])


def test_volumes_do_not_depend_on_partitions(spark):
    """Fractions of many sizes in many partitions: the volume is their sum one after another, and a panel without volumes needs no sort of ticks."""
    from factorloom.sources.bars import bars

    rows = [(f"a{k % 3}", dt.date(2024, 1, 1 + k % 2), k, (k * 7919 % 10007) / 100 * 10.0 ** (k % 5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "a string, d date, k int, v double")
    expected = {}
    for a, d, _, v in rows:
        expected[d, a] = expected.get((d, a), 0.0) + v
    for n in (1, 7, 16):
        panel = bars(df.repartition(n), F.col("a"), F.col("d"), F.col("v"), [F.col("k")], in_order=True)
        assert {(r["date"], r["asset"]): r["volume"] for r in panel.collect()} == expected
    assert "Window" not in panel.select("date", "asset", "close")._jdf.queryExecution().optimizedPlan().toString()


def test_tables_move_words_once(spark):
    """One exchange of the words, and nothing staged, from words to tables; a lone word parts two tables of a page."""
    from factorloom.operators import word_tables

    lines = [(y, x, f"{y + x}") for y in (10, 22, 34, 60, 72) for x in (0, 50, 100)] + [(47, 0, "between")]
    words = spark.createDataFrame([(1, 1, float(x), float(y), float(x + 20), float(y + 8), t) for y, x, t in lines], "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double, text string")
    found = word_tables.tables(words)
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FileScan" not in plan
    got = [tuple(r) for r in found.select("table_no", "y0", "y1", "table").orderBy("table_no").collect()]
    assert [g[:3] for g in got] == [(0, 10.0, 42.0), (1, 60.0, 80.0)] and got[1][3] == "| 60 | 110 | 160 |\n| --- | --- | --- |\n| 72 | 122 | 172 |"


def test_formula_blocks_move_texts_once(spark, tmp_path):
    """Lines go to their pages once, and a formula is rewritten once; null, empty and odd texts give the rows of the SQL."""
    from factorloom.operators.documents import GLYPHS, LAMBDA

    assert all("\uf000" <= g <= "\uf0ff" for g in [*GLYPHS, LAMBDA])
    lines = ["plain words", "", "VaR = x - y (4)", "[Table_x] = y+z*(a+b)", "ESi = wi*Xi", "(3)", " ", "Tel: 1-2 (5)", "x=(1)"]
    texts = [None, "", *("\n".join(lines[(k * j) % 9] for j in range(k)) for k in range(1, 24))]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["text_formula_blocks"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # one, named twice
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ES_i") == 1
    assert_same(found, con, ORACLE_SQL["text_formula_blocks"])
