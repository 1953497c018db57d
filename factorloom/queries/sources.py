"""Queries on universes, report terms, report sinks, word boxes and formulas as texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ieee
from ..operators import robust, word_tables
from ..plans import checks, normalize
from ..sources import reports, universe
from . import query
from .sql import normal_cdf

#: Members of three indexes at four dates, from the suppliers.
COMPONENTS = """components AS (
  SELECT ['000300.XSHG', '000905.XSHG', '000852.XSHG'][1 + s_nationkey % 3] AS index_id, DATE '2024-01-01' + (s_suppkey % 4 * 91)::INTEGER AS date, lpad(s_suppkey::VARCHAR, 6, '0') || '.XSHG' AS asset FROM supplier)"""


def components(spark, sf_dir):
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    index = F.element_at(F.array(F.lit("000300.XSHG"), F.lit("000905.XSHG"), F.lit("000852.XSHG")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    return suppliers.select(index.alias("index_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 4 * 91).cast("int")).alias("date"), F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".XSHG")).alias("asset"))


@query(
    "universe_members",
    f"""WITH {COMPONENTS}, asked(pool, index_id, day) AS (VALUES ('CSI 500', '000905.XSHG', DATE '2024-07-15'), ('中证1000', '000852.XSHG', DATE '2023-01-01')),
days AS (SELECT pool, index_id, coalesce(max(date) FILTER (date <= day), max(date)) AS date FROM asked JOIN components USING (index_id) GROUP BY ALL)
SELECT DISTINCT pool, asset FROM days JOIN components USING (index_id, date) UNION ALL VALUES ('codes', '000001.XSHE'), ('codes', '600000.XSHG'), ('codes', '830001.XBSE')""",
)
def universe_members(spark, sf_dir):
    """An index on a date, one before all dates, and a list of codes as vendors write them."""
    table = components(spark, sf_dir)
    pools = {"CSI 500": ("CSI 500", "2024-07-15"), "中证1000": ("中证1000", "2023-01-01"), "codes": (["000001.SZ", "600000", " 830001.bj", "600000.SH"], "2024-01-01")}
    out = None
    for name, (asked, day) in pools.items():
        found = universe.members(spark, asked, day, table).select(F.lit(name).alias("pool"), "asset")
        out = found if out is None else out.unionByName(found)
    return out


TERMS = list(universe.FIELDS)


@query(
    "universe_terms",
    "WITH known(term, field) AS (VALUES " + ", ".join(f"('{t}', '{f}')" for t, f in universe.FIELDS.items()) + f"""),
asked AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN p_name ELSE [{', '.join(f"'{t}'" for t in TERMS)}][1 + p_partkey % {len(TERMS)}] END AS term FROM part)
SELECT id, term, coalesce(field, term) AS field FROM asked LEFT JOIN known USING (term)""",
)
def universe_terms(spark, sf_dir):
    k = F.col("p_partkey")
    term = F.when(k % 9 == 0, F.col("p_name")).otherwise(F.element_at(F.array(*[F.lit(t) for t in TERMS]), (k % len(TERMS) + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), term.alias("term"), universe.field_of(term).alias("field"))


@query(
    "report_results",
    """WITH r AS (SELECT 'r/' || c_nationkey AS report_id, 'f' || c_custkey AS factor, c_custkey % 3 > 0 AS passed, CASE WHEN c_nationkey % 5 = 0 OR c_custkey % 11 = 0 THEN 'no data' END AS error FROM customer),
g AS (SELECT report_id, count(*) AS total, count(*) FILTER (passed AND error IS NULL) AS passed, count(error) AS errors FROM r GROUP BY report_id)
SELECT replace(report_id, '/', '_') || '/result.json' AS path, report_id, CASE WHEN errors = total THEN 'error' WHEN passed = total THEN 'passed' WHEN passed > 0 THEN 'partial' ELSE 'failed' END AS status,
       total, passed, total - passed - errors AS failed, errors FROM g""",
)
def report_results(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    results = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("r/"), n).alias("report_id"), F.concat(F.lit("f"), k).alias("factor"), (k % 3 > 0).alias("passed"), F.when((n % 5 == 0) | (k % 11 == 0), "no data").alias("error")
    )
    files = reports.result_files(results, "2020-01-01", "2024-12-31")
    read = F.from_json("text", "report_id string, status string, summary struct<total:long,passed:long,failed:long,errors:long>").alias("r")
    return files.select("path", read).select("path", "r.report_id", "r.status", "r.summary.*")


def entries(spark, sf_dir):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("E/P "), k).alias("name"), F.concat(F.lit("因子"), k).alias("name_cn"), F.when(k % 2 == 0, "value").otherwise("size").alias("style"), F.concat(F.lit("1."), k % 4, F.lit(".0")).alias("version"),
        F.lit("active").alias("status"), F.lit("csi300").alias("universe"), F.lit("monthly").alias("rebalance_frequency"), F.concat(F.lit("Rank(close / "), k, F.lit(")")).alias("formula"),
        F.array(F.lit("close"), F.lit("volume")).alias("input_fields"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("tags"),
        F.md5(k.cast("string")).alias("dedup_hash"), F.timestamp_seconds(1_700_000_000 + k % 50 * 3600).alias("created_at"),
    )


ENTRIES = """e AS (SELECT s_suppkey AS k, 'E_P_' || s_suppkey AS file, md5(s_suppkey::VARCHAR) AS hash, CASE WHEN s_suppkey % 2 = 0 THEN 'value' ELSE 'size' END AS style, '1.' || s_suppkey % 4 || '.0' AS version,
  make_timestamp((1700000000 + s_suppkey % 50 * 3600) * 1000000) AS made FROM supplier)"""


@query(
    "report_wiki",
    f"""WITH {ENTRIES} SELECT 'factors/' || file || '.md' AS path, array_to_string(['# 因子' || k || ' (E/P ' || k || ')', '', '- **风格**: ' || style, '- **版本**: ' || version, '- **状态**: active', '- **Universe**: csi300',
  '- **调仓频率**: monthly', '- **去重哈希**: `' || hash || '`', '- **创建时间**: ' || strftime(made, '%Y-%m-%d %H:%M'), '', '## 公式', '', '```', 'Rank(close / ' || k || ')', '```', '', '## 输入字段', '', '- close', '- volume', '', '## 标签', '',
  CASE WHEN k % 3 = 0 THEN '（无）' ELSE 'a, b' END, '', '[← 返回索引](../INDEX.md)', ''], chr(10)) AS text FROM e""",
)
def report_wiki(spark, sf_dir):
    return reports.wiki_pages(entries(spark, sf_dir))


@query(
    "report_index",
    f"""WITH {ENTRIES} SELECT row_number() OVER (ORDER BY made DESC, hash)::INTEGER AS place, '| [因子' || k || '](factors/' || file || '.md) | ' || style || ' | ' || version || ' | active | ' || hash[:8] || ' | ' || strftime(made, '%Y-%m-%d %H:%M') || ' |' AS line FROM e""",
)
def report_index(spark, sf_dir):
    return reports.index_lines(entries(spark, sf_dir))


@query(
    "table_from_words",
    """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, 'p' || l_partkey AS part, l_suppkey::VARCHAR AS supp, l_quantity::INTEGER::VARCHAR AS quantity FROM lineitem),
g AS (SELECT k, count(*) AS rows, string_agg('| ' || part || ' x | ' || supp || ' | ' || quantity || ' |', chr(10) ORDER BY n) AS body FROM l GROUP BY k)
SELECT k AS doc_id, 0::INTEGER AS table_no, 20.0::DOUBLE AS x0, (22 + rows * 12)::DOUBLE AS y1, '| part | supp | quantity |' || chr(10) || '| --- | --- | --- |' || chr(10) || body AS "table" FROM g""",
)
def table_from_words(spark, sf_dir):
    """The lines of an order as words of a page, under a head, heights off by a point; a title and a line of text around the table."""
    from pyspark.sql import Window

    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("n", F.row_number().over(by_order))

    def word(x0: float, x1: float, text, dy: float = 0.0, y=None):
        y = F.lit(20.0) + F.col("n") * 12 if y is None else F.lit(y)
        return F.struct(F.lit(x0).alias("x0"), (y - 9 + dy).alias("y0"), F.lit(x1).alias("x1"), (y + 1 + dy).alias("y1"), text.cast("string").alias("text"))

    cells = [word(20.0, 60.0, F.concat(F.lit("p"), "l_partkey")), word(62.0, 66.0, F.lit("x")), word(100.0, 130.0, F.col("l_suppkey"), 1.0), word(180.0, 210.0, F.col("l_quantity").cast("int"), -1.0)]
    head = [word(20.0, 50.0, F.lit("part"), y=20.0), word(105.0, 125.0, F.lit("supp"), y=20.0), word(170.0, 215.0, F.lit("quantity"), y=20.0), word(20.0, 200.0, F.lit("A title"), y=2.0)]
    words = F.when(F.col("n") == 1, F.array(*head, *cells)).otherwise(F.array(*cells))
    boxes = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_num"), F.inline(words))
    return word_tables.tables(boxes).select("doc_id", "table_no", "x0", "y1", "table")


#: Formulas as reports write them, and what is expected of each, with a number of the part in both.
WRITTEN = (
    ("Power($close, {n})", "Pow(close, {n})", False, True, "CSI 500", "csi500", False),
    ("mkt_cap ÷ Delay(close, {n})", "market_cap / Ref(close, {n})", False, True, "可转债", "全转债", False),
    ("Std(ret) + {n}", "Std(close / Ref(close, 1) - 1, 20) + {n}", False, True, "nikkei", "csi300", True),
    ("\\frac{close}{Mean(close, {n})}", "close / Mean(close, {n})", False, True, "", "csi300", False),
    ("因子 = 收盘价 {n}", "close / Ref(close, 20) - 1", True, False, "全A", "csi300", False),
    ("Rank(ytm + {n})", "Rank(close + {n})", True, False, "hs300", "csi300", False),
    ("Corr(close, volume, N) * {n}^2", "Corr(close, volume, 20) * {n} ** 2", False, True, "zz500", "csi500", False),
)


def _pick(place: int):
    """A text of ``WRITTEN`` with the part's number in it."""
    texts = F.array(*[F.lit(w[place]) for w in WRITTEN])
    return F.replace(F.element_at(texts, (F.col("p_partkey") % len(WRITTEN) + 1).cast("int")), F.lit("{n}"), F.col("p_size").cast("string"))


@query(
    "formula_normalised",
    "WITH w(k, formula, used_proxy, mechanical_rewrite, universe, universe_fallback) AS (VALUES "
    + ", ".join(f"({k}, '{w[1]}', {w[2]}, {w[3]}, '{w[5]}', {w[6]})" for k, w in enumerate(WRITTEN))
    + f") SELECT p_partkey AS id, replace(formula, '{{n}}', p_size::VARCHAR) AS formula, universe, used_proxy, universe_fallback, mechanical_rewrite FROM part JOIN w ON p_partkey % {len(WRITTEN)} = k",
)
def formula_normalised(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.col("p_partkey").alias("id"), normalize.normalized(_pick(0), _pick(4)).alias("r")).select("id", "r.*")


@query(
    "formula_checked",
    """WITH p AS (SELECT p_partkey AS id, p_size - 25 AS n, p_partkey % 4 AS k FROM part)
SELECT id, CASE k WHEN 0 THEN n >= 0 WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS valid, CASE k WHEN 0 THEN (n < 0)::INTEGER WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS n_errors, CASE k WHEN 1 THEN 2 ELSE 0 END AS n_warnings,
       CASE k WHEN 0 THEN CASE WHEN n < 0 THEN 'high' ELSE 'none' END WHEN 1 THEN 'medium' ELSE 'none' END AS risk, k <> 3 AS safe FROM p""",
)
def formula_checked(spark, sf_dir):
    """Shifts by a part's size less 25, two prices of the day, an unknown operator, an open bracket."""
    n, k = F.col("p_size") - 25, F.col("p_partkey") % 4
    formula = F.when(k == 0, F.concat(F.lit("Ref(volume, "), n, F.lit(")"))).when(k == 1, "close / open").when(k == 2, F.concat(F.lit("Foo(volume, "), n, F.lit(")"))).otherwise("Mean(volume, 5")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), checks.checked(formula).alias("r")).select("id", "r.*")


@query(
    "robust_deflated",
    f"""WITH s AS (SELECT c_custkey AS id, (c_custkey % 300 - 50) / 100.0::DOUBLE AS sharpe, 1 + c_custkey % 20 AS trials, 20 + c_custkey % 200 AS n FROM customer),
z AS (SELECT *, sharpe / sqrt((1 + sharpe * sharpe / 2 + sharpe * sharpe / 2) / (n - 1)) AS psr_z FROM s),
d AS (SELECT id, sharpe, {normal_cdf('psr_z')} AS psr, {normal_cdf('psr_z - CASE WHEN trials > 1 THEN sqrt(2 * ln(trials)) ELSE 0 END')} AS dsr FROM z)
SELECT id, round(dsr, 6) + 0.0 AS dsr, round(psr, 6) + 0.0 AS psr, round(1 - dsr, 6) + 0.0 AS p_value, dsr < 0.05 AS deflated,
       CASE WHEN sharpe > 0 THEN ceil(0.04::DOUBLE * pow({robust.normal_quantile(0.975)!r}::DOUBLE, 2) / (sharpe * sharpe / 252))::BIGINT ELSE 1000000000 END AS min_obs FROM d""",
)
def robust_deflated(spark, sf_dir):
    k = F.col("c_custkey")
    sharpe = (k % 300 - 50) / F.lit(100.0)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), robust.deflated_sharpe_columns(sharpe, 1 + k % 20, 20 + k % 200).alias("r"), robust.min_backtest_column(sharpe).alias("min_obs"))
    out = rows.select("id", "r.*", "min_obs")
    return out.withColumns({c: ieee.rounded(F.col(c), 6) + F.lit(0.0) for c in ("dsr", "psr", "p_value")})
