"""Queries on texts: the documents table, its lines as blocks of pages, and tables made from its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ieee
from ..operators import documents as d
from ..operators import vocabulary
from . import query


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


#: Three lines of a document are a page; every page ends with a running title and a page number.
PAGES = r"""lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
pages AS (SELECT doc_id, (n // 3 + 1)::INTEGER AS page_num, string_agg(line, chr(10) ORDER BY n) || chr(10) || 'Report of unit ' || doc_id % 7 || chr(10) || '- ' || (n // 3 + 1) || ' -' AS text FROM lines GROUP BY doc_id, n // 3)"""


def pages(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    grouped = lines.groupBy("doc_id", (F.floor(F.col("n") / 3) + 1).cast("int").alias("page_num")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    text = F.concat_ws("\n", F.array_join("l.line", "\n"), F.concat(F.lit("Report of unit "), F.col("doc_id") % 7), F.concat(F.lit("- "), "page_num", F.lit(" -")))
    return grouped.select("doc_id", "page_num", text.alias("text"))


@query(
    "text_quality",
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' 营业收入增长' ELSE '' END AS text FROM documents),
c AS (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS solid, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS cjk FROM t)
SELECT doc_id, round(CASE WHEN solid > 0 THEN cjk / solid::DOUBLE ELSE 0 END, 6) AS cjk_ratio, CASE WHEN solid > 0 THEN cjk > 0 AND cjk / solid::DOUBLE < 0.3 ELSE false END AS garbled FROM c""",
)
def text_quality(spark, sf_dir):
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " 营业收入增长").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", ieee.rounded(d.cjk_ratio(text), 6).alias("cjk_ratio"), d.is_garbled(text).alias("garbled"))


PAGE_CLASS = r"""t AS (SELECT doc_id, trim(coalesce(text, '')) AS text, doc_id % 3 = 0 AS images, doc_id % 4 = 0 AS ocr FROM documents),
h AS (SELECT *, length(text) AS n, len(regexp_extract_all(text, '\|')) AS pipes, len(list_filter(string_split(text, chr(10)), lambda s: length(s) > 5 AND len(regexp_extract_all(s, '\d')) > length(s) * 0.3)) AS heavy,
       contains(lower(text), 'figure') OR contains(lower(text), 'chart') OR contains(text, '图表') AS chart, len(regexp_extract_all(text, '%')) AS percents FROM t),
classes AS (SELECT *, CASE WHEN n = 0 AND NOT images THEN 'blank' WHEN images AND (ocr OR n = 0) THEN 'scanned' WHEN pipes > 5 OR heavy > 3 THEN 'table_candidate'
  WHEN images AND (n < 200 OR chart) THEN 'chart_candidate' WHEN n > 200 AND NOT ocr AND NOT images THEN 'text_rich' ELSE 'mixed' END AS page_class FROM h)"""


@query("text_page_class", f"WITH {PAGE_CLASS} SELECT doc_id, page_class FROM classes")
def page_class(spark, sf_dir):
    images, ocr = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0), F.col("doc_id") % 4 == 0
    return docs(spark, sf_dir).select("doc_id", d.page_class(F.col("text"), images, ocr).alias("page_class"))


@query(
    "text_page_route",
    f"""WITH {PAGE_CLASS} SELECT doc_id, ocr OR page_class = 'scanned' AS ocr, page_class = 'table_candidate' OR (page_class = 'mixed' AND (heavy > 3 OR percents >= 8)) AS structure,
       page_class = 'chart_candidate' OR (page_class = 'mixed' AND images) AS vision FROM classes""",
)
def page_route(spark, sf_dir):
    images, ocr = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0), F.col("doc_id") % 4 == 0
    return docs(spark, sf_dir).select("doc_id", d.page_route(F.col("text"), images, ocr).alias("r")).select("doc_id", "r.*")


@query(
    "text_repeated_lines",
    f"WITH {PAGES}" + r""", n AS (SELECT doc_id, count(DISTINCT page_num) AS n FROM pages GROUP BY doc_id),
l AS (SELECT doc_id, page_num, trim(unnest(string_split(text, chr(10)))) AS line FROM pages),
k AS (SELECT DISTINCT doc_id, page_num, regexp_replace(regexp_replace(line, '\s', '', 'g'), '\d+$', '') AS line_key FROM l WHERE length(line) BETWEEN 1 AND 80)
SELECT doc_id, line_key, count(*) AS n_pages FROM k JOIN n USING (doc_id) WHERE line_key <> '' GROUP BY doc_id, line_key, n.n HAVING count(*) >= greatest(2, least(3, CASE WHEN n.n // 4 > 0 THEN n.n // 4 ELSE 2 END))""",
)
def repeated_lines(spark, sf_dir):
    return d.repeated_lines(pages(spark, sf_dir))


@query(
    "text_without_boilerplate",
    f"""WITH {PAGES} SELECT doc_id, page_num, trim(array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT (regexp_matches(trim(s), '^[-—–\\s]*\\d{{1,3}}[-—–\\s]*$') OR regexp_matches(trim(s), '^\\d+\\s*/\\s*\\d+\\s*$')
  OR (length(trim(s)) <= 24 AND regexp_matches(trim(s), '^[A-Z][A-Z\\s.]+$')))), chr(10))) AS text FROM pages""",
)
def without_boilerplate(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", "page_num", d.without_boilerplate(F.col("text")).alias("text"))


@query("text_hard_split", "SELECT doc_id, unnest(range(0, length(text), 1600)) // 1600 AS piece_no, substr(text, unnest(range(0, length(text), 1600)) + 1, 2000) AS piece FROM documents WHERE length(text) > 0")
def hard_split(spark, sf_dir):
    pieces = docs(spark, sf_dir).select("doc_id", F.posexplode(d.hard_split(F.col("text"), 2000, 400)).alias("piece_no", "piece"))
    return pieces.withColumn("piece_no", F.col("piece_no").cast("long"))


#: Packing as a recursion over a text's paragraphs: what is held, and what has come out.
@query(
    "text_chunks",
    r"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT row_no, doc_id, text, list_transform(list_filter(string_split_regex(text, '\n{2,}'), lambda p: trim(p, E' \t\n\r\v\f') <> ''), lambda p: p) AS s FROM t WHERE trim(text, E' \t\n\r\v\f') <> ''),
steps AS (
  SELECT row_no, doc_id, s, 1 AS k, '' AS held, []::VARCHAR[] AS out FROM parts WHERE length(text) > 1500
  UNION ALL
  SELECT row_no, doc_id, s, k + 1,
         CASE WHEN length(s[k]) > 1500 THEN '' WHEN held = '' THEN s[k] WHEN length(trim(held || E'\n\n' || s[k], E' \t\n\r\v\f')) <= 1500 THEN trim(held || E'\n\n' || s[k], E' \t\n\r\v\f')
              ELSE trim(right(held, 200) || E'\n\n' || s[k], E' \t\n\r\v\f') END,
         CASE WHEN length(s[k]) > 1500 THEN list_concat(list_concat(out, CASE WHEN held = '' THEN []::VARCHAR[] ELSE [held] END), list_transform(range(0, length(s[k]), 1300), lambda i: substr(s[k], i + 1, 1500)))
              WHEN held = '' OR length(trim(held || E'\n\n' || s[k], E' \t\n\r\v\f')) <= 1500 THEN out ELSE list_append(out, held) END
  FROM steps WHERE k <= len(s)),
ended AS (SELECT row_no, doc_id, CASE WHEN held = '' THEN out ELSE list_append(out, held) END AS out FROM steps WHERE k = len(s) + 1
          UNION ALL SELECT row_no, doc_id, [text] FROM parts WHERE length(text) <= 1500)
SELECT doc_id, unnest(range(0, len(out)))::INTEGER AS chunk_no, unnest(out) AS chunk FROM ended""",
)
def chunks(spark, sf_dir):
    return d.chunks(docs(spark, sf_dir), 1500, 200)


def _numbers_sql() -> str:
    pattern = f"'(?i){d.NUMBER.pattern}'"
    return f"""WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT row_no, doc_id, regexp_extract_all(text, {pattern}) AS hits, regexp_extract_all(text, {pattern}, 1) AS digits, regexp_extract_all(text, {pattern}, 2) AS units, string_split_regex(text, {pattern}) AS gaps FROM t),
e AS (SELECT row_no, doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS raw, unnest(digits) AS digits, unnest(units) AS unit, unnest(gaps[:len(hits)]) AS gap FROM m),
p AS (SELECT *, lower(regexp_replace(unit, '\\s+', '', 'g')) AS bare, (sum(length(gap) + length(raw)) OVER (PARTITION BY row_no ORDER BY i ROWS UNBOUNDED PRECEDING))::INTEGER AS "end" FROM e)
SELECT doc_id, CASE WHEN digits[1] IN ('(', '（') THEN -1 ELSE 1 END * regexp_replace(digits, '[,、()（）]', '', 'g')::DOUBLE AS value,
       CASE WHEN contains(bare, 'yoy') THEN 'YoY' WHEN contains(bare, 'qoq') THEN 'QoQ' WHEN contains(bare, '同比') THEN '同比' WHEN contains(bare, '环比') THEN '环比' WHEN unit <> '' THEN unit END AS unit,
       raw, ("end" - length(raw))::INTEGER AS start, "end" FROM p"""


@query("text_number_spans", _numbers_sql())
def number_spans(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(d.number_spans(F.col("text"))).alias("n")).select("doc_id", "n.*")


#: A sentence of a report from a customer's number. A change that is said later, here the fall of profit, replaces an earlier one.
SENTENCE = ("2023年营业收入", "亿元，同比增长", "%，归母净利润下降", "万元")


@query(
    "text_metrics",
    """WITH c AS (SELECT c_custkey AS id, (c_custkey % 500) / 10.0::DOUBLE AS a, (c_custkey % 37) / 4.0::DOUBLE AS b, c_custkey % 90 AS c FROM customer)
SELECT id, '营收' AS name, '营业收入' AS raw_name, a AS value, '亿元' AS unit, -c::DOUBLE + 0.0 AS yoy, NULL::DOUBLE AS qoq FROM c UNION ALL SELECT id, '归母净利润', '归母净利润', CASE WHEN c = 0 THEN 0 ELSE -c END, '万元', NULL, NULL FROM c""",
)
def metric_items(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(F.lit(SENTENCE[0]), (k % 500) / 10, F.lit(SENTENCE[1]), (k % 37) / 4, F.lit(SENTENCE[2]), k % 90, F.lit(SENTENCE[3]))
    found = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), F.explode(d.metric_items(text)).alias("m")).select("id", "m.*")
    return found.withColumns({c: F.col(c) + F.lit(0.0) for c in ("value", "yoy")})


@query("text_terms", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '营收' WHEN 1 THEN 'ROE' WHEN 2 THEN 'PE' ELSE trim(p_name) END AS term FROM part")
def terms(spark, sf_dir):
    k = F.col("p_partkey")
    term = F.when(k % 4 == 0, " 营业收入 ").when(k % 4 == 1, "净资产收益率").when(k % 4 == 2, "市盈率").otherwise(F.col("p_name"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), d.canonical_term(term).alias("term"))


def tables(spark, sf_dir):
    """One pipe table for each supplier: three rows, a total that is off for some, an empty cell for some."""
    k = F.col("s_suppkey")
    a, b = k % 10, k % 7
    total = a + b + F.when(k % 5 == 0, 1).otherwise(0)
    cell = F.when(k % 3 == 0, F.lit("")).otherwise(b.cast("string"))
    text = F.concat(F.lit("| 项目 | 2023年 | note |\n|---|---|---|\n| 货币资金 | "), a, F.lit(" | "), F.lit("x |\n| 存货 | "), cell, F.lit(" | y |\n| 合计 | "), total, F.lit(" | z |"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("table_id"), text.alias("text"))


TABLE_SQL = "s AS (SELECT s_suppkey AS k, s_suppkey % 10 AS a, s_suppkey % 7 AS b, s_suppkey % 3 = 0 AS gap, s_suppkey % 10 + s_suppkey % 7 + (s_suppkey % 5 = 0)::INTEGER AS total FROM supplier)"


@query(
    "table_score",
    f"""WITH {TABLE_SQL}, c AS (SELECT k, gap::INTEGER / 9.0::DOUBLE AS empty, (4 + 1 + 1 + 2 + 1 + 2 + 1 + (CASE WHEN gap THEN 0 ELSE 1 END) + length(total::VARCHAR)) / 9.0::DOUBLE AS mean FROM s)
SELECT k AS table_id, round(1 - empty * 0.2 - mean / 100 * 0.2, 6) AS score FROM c""",
)
def table_score(spark, sf_dir):
    return tables(spark, sf_dir).select("table_id", ieee.rounded(d.table_score(d.table_rows(F.col("text"))), 6).alias("score"))


#: Words of the three statements as SQL lists.
WORDS = {k: "[" + ", ".join(f"'{w}'" for w in words) + "]" for k, words in vocabulary.STATEMENTS.items()}
ITEMS = {"income_statement": (1, 2), "balance_sheet": (7, 3), "cash_flow": (3, 5)}


def _semantics_sql() -> str:
    items = {k: f"{WORDS[k]}[1 + k * {step} % {len(vocabulary.STATEMENTS[k])}]" for k, (step, _) in ITEMS.items()}
    rows = " || ".join(f"CASE WHEN k % {every} = 0 THEN chr(10) || '| ' || {items[k]} || ' | ' || k || ' |' ELSE '' END" for k, (_, every) in ITEMS.items())
    totals = "[" + ", ".join(f"'{w}'" for w in vocabulary.TOTALS) + "]"
    hits = ", ".join(f"len(list_filter({WORDS[k]}, lambda w: contains(text, w))) AS {k}" for k in ITEMS)
    return f"""WITH t AS (SELECT s_suppkey AS k, CASE WHEN k % 4 = 0 THEN '| 表 | x |' || chr(10) ELSE '' END || '| 项目 | 2023年 |' {'|| ' + rows} || chr(10) || '| Total | 1 |' AS text FROM supplier),
h AS (SELECT k, text, {hits} FROM t),
b AS (SELECT *, greatest(income_statement, balance_sheet, cash_flow) AS best, list_sort([income_statement, balance_sheet, cash_flow], 'DESC')[2] AS second FROM h)
SELECT k AS table_id, CASE WHEN best = 0 THEN 'unknown' WHEN income_statement = best THEN 'income_statement' WHEN balance_sheet = best THEN 'balance_sheet' ELSE 'cash_flow' END AS statement,
       CASE WHEN best = 0 THEN 0 ELSE round(greatest(CASE WHEN second = 0 THEN least(0.5 + least(best / 5.0::DOUBLE, 1) * 0.5, 1) ELSE least(best / 5.0::DOUBLE, 1) * best / (best + second) END, 0.3), 3) END::DOUBLE AS confidence,
       CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS header, (list_position(list_transform(string_split(text, chr(10)), lambda l: len(list_filter({totals}, lambda w: contains(lower(l), w))) > 0), true) - 1)::INTEGER AS total_row FROM b"""


@query("table_semantics", _semantics_sql())
def table_semantics(spark, sf_dir):
    """Items of none to three statements, some under a title, a total last."""
    k = F.col("s_suppkey")
    text = F.concat(F.when(k % 4 == 0, "| 表 | x |\n").otherwise(""), F.lit("| 项目 | 2023年 |"))
    for name, (step, every) in ITEMS.items():
        words = vocabulary.STATEMENTS[name]
        item = F.element_at(F.array(*[F.lit(w) for w in words]), (1 + k * step % len(words)).cast("int"))
        text = F.concat(text, F.when(k % every == 0, F.concat(F.lit("\n| "), item, F.lit(" | "), k, F.lit(" |"))).otherwise(""))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("table_id"), d.table_rows(F.concat(text, F.lit("\n| Total | 1 |"))).alias("rows"))
    total = F.array_position(F.transform("rows", d.is_total_row), True).cast("int") - 1
    out = rows.select("table_id", d.statement_type(F.col("rows")).alias("s"), d.header_row(F.col("rows")).alias("header"), total.alias("total_row"))
    return out.select("table_id", "s.*", "header", "total_row")


@query(
    "table_total_mismatches",
    f"WITH {TABLE_SQL} SELECT k AS table_id, 3::INTEGER AS row_no, 1::INTEGER AS col_no, (a + CASE WHEN gap THEN 0 ELSE b END)::DOUBLE AS expected, total::DOUBLE AS actual FROM s WHERE a + CASE WHEN gap THEN 0 ELSE b END <> total",
)
def table_total_mismatches(spark, sf_dir):
    return d.total_mismatches(tables(spark, sf_dir).select("table_id", d.table_rows(F.col("text")).alias("rows")))


@query(
    "table_continued",
    """WITH b AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_num, o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'text' ELSE 'table' END AS type FROM orders),
t AS (SELECT *, type = 'table' AND lag(type) OVER w = 'table' AS follows FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)),
c AS (SELECT *, sum(CASE WHEN coalesce(follows, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_num) AS chain FROM t WHERE type = 'table')
SELECT doc_id, min(page_num)::INTEGER AS page_num, string_agg(page_num, ',' ORDER BY page_num) AS pages, '| key |' || chr(10) || '|---|' || chr(10) || string_agg('| ' || k || ' |', chr(10) ORDER BY page_num) AS "table" FROM c GROUP BY doc_id, chain""",
)
def table_continued(spark, sf_dir):
    from pyspark.sql import Window

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    blocks = orders.select(
        F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page_num"), F.lit(0).alias("block_no"),
        F.when(F.col("o_orderstatus") == "P", "text").otherwise("table").alias("type"), F.concat(F.lit("| key |\n|---|\n| "), "o_orderkey", F.lit(" |")).alias("text"),
    )
    return d.merge_continued(blocks).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(
    "text_formula_spans",
    r"""WITH t AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'ES = a + b*c (' || doc_id % 9 || ')' || chr(10) || 'VaR = x - y' WHEN 1 THEN chr(10) || '[Table_x] = y+z*(a+b)' ELSE '' END AS text FROM documents),
l AS (SELECT row_no, doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS n FROM t),
c AS (SELECT *, len(regexp_extract_all(s, '[=+\-*/<>()\[\]]')) AS ops, len(regexp_extract_all(s, '[a-zA-Z]')) AS latin FROM l),
f AS (
  SELECT * FROM c WHERE trim(s) <> '' AND NOT regexp_matches(s, '\[Table_[A-Za-z0-9_]+\]') AND NOT regexp_matches(s, '(?i)Tel:|Email:')
    AND (CASE WHEN regexp_matches(s, 'ES|VaR|CVaR') AND ops > 0 THEN 5 ELSE 0 END) + (CASE WHEN regexp_matches(s, '\(\d+\)\s*$') THEN 5 ELSE 0 END) + (CASE WHEN length(s) < 50 AND ops > 0 AND latin > 0 THEN least(5, ops) ELSE 0 END) >= 5),
i AS (SELECT *, n - row_number() OVER (PARTITION BY row_no ORDER BY n) AS island FROM f)
SELECT doc_id, min(n) AS start_line, max(n) AS end_line, count(*) AS n_lines FROM i GROUP BY row_no, doc_id, island""",
)
def formula_spans(spark, sf_dir):
    """Documents with formulas, and lines that only look like them, at the end of some."""
    k = F.col("doc_id")
    added = F.when(k % 3 == 0, F.concat(F.lit("\nES = a + b*c ("), k % 9, F.lit(")\nVaR = x - y"))).when(k % 3 == 1, "\n[Table_x] = y+z*(a+b)").otherwise("")
    return d.formula_spans(docs(spark, sf_dir).withColumn("text", F.concat("text", added)))


#: Two lines of a document are a block, three blocks a page; most blocks end with a numbered, unnumbered or trivial formula.
FORMULA_BLOCKS = r"""t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
b AS (SELECT doc_id, i // 2 AS block, string_agg(s, chr(10) ORDER BY i) AS text FROM t GROUP BY ALL),
ended AS (SELECT doc_id, block, (doc_id + block) % 5 AS k, doc_id % 3 + 1 AS number, text FROM b),
blocks AS (
  SELECT doc_id, block // 3 + 1 AS page_num, block % 3 AS block_no, 10.0 * block AS y0,
         text || CASE k WHEN 0 THEN chr(10) || 'ES = a + b*c (' || number || ')' WHEN 1 THEN chr(10) || 'VaR = x - y' WHEN 2 THEN chr(10) || '(3)' WHEN 3 THEN chr(10) || 'ES = wi*Xi + y (' || number || ')' || chr(10) || ' ' ELSE '' END AS text FROM ended)"""


@query(
    "text_formula_blocks",
    f"""WITH {FORMULA_BLOCKS},
l AS (SELECT doc_id, page_num, block_no, y0, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM blocks),
c AS (SELECT *, len(regexp_extract_all(s, '[=+\\-*/<>()\\[\\]]')) AS ops, len(regexp_extract_all(s, '[a-zA-Z]')) AS latin FROM l),
f AS (
  SELECT *, trim(s) <> '' AND NOT regexp_matches(s, '\\[Table_[A-Za-z0-9_]+\\]') AND NOT regexp_matches(s, '(?i)Tel:|Email:')
    AND (CASE WHEN regexp_matches(s, 'ES|VaR|CVaR') AND ops > 0 THEN 5 ELSE 0 END) + (CASE WHEN regexp_matches(s, '\\(\\d+\\)\\s*$') THEN 5 ELSE 0 END) + (CASE WHEN length(s) < 50 AND ops > 0 AND latin > 0 THEN least(5, ops) ELSE 0 END) >= 5 AS formula FROM c),
p AS (SELECT *, sum(CASE WHEN formula <> was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num, block_no ORDER BY n) AS piece FROM (SELECT *, lag(formula) OVER (PARTITION BY doc_id, page_num, block_no ORDER BY n) AS was FROM f)),
g AS (SELECT doc_id, page_num, block_no, piece, bool_and(formula) AS formula, any_value(y0) AS y0, string_agg(s, chr(10) ORDER BY n) AS raw, count(*) OVER (PARTITION BY doc_id, page_num, block_no) AS n FROM p GROUP BY doc_id, page_num, block_no, piece),
x AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\bESi\\b', 'ES_i', 'g'), '\\bXi\\b', 'X_i', 'g'), '\\bwi\\b', 'w_i', 'g'), '\\s+', ' ', 'g')) AS latex FROM g WHERE formula OR n = 1 OR trim(raw) <> ''),
y AS (SELECT *, formula AND NOT (length(replace(latex, ' ', '')) < 4 AND NOT regexp_matches(latex, 'ES|w_')) AS real, nullif(regexp_extract(raw, '\\(\\s*(\\d+)\\s*\\)\\s*$', 1), '') AS number FROM x),
r AS (SELECT *, coalesce(NOT real OR NOT lag(real) OVER w, true) AS new, count(*) FILTER (NOT real) OVER w AS run FROM y WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY block_no, piece)),
e AS (SELECT *, new OR (number IS NOT NULL AND number IS DISTINCT FROM last_value(CASE WHEN real THEN number END IGNORE NULLS) OVER (PARTITION BY doc_id, page_num, run ORDER BY block_no, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS begins FROM r),
h AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY doc_id, page_num ORDER BY block_no, piece) AS chain FROM e)
SELECT doc_id, page_num, min(block_no) AS block_no, CASE WHEN bool_or(real) THEN 'formula' ELSE 'text' END AS type, string_agg(CASE WHEN real THEN latex ELSE raw END, ' \\\\ ' ORDER BY block_no, piece) AS text,
       arg_min(CASE WHEN real THEN number END, (block_no, piece)) AS eq_number, min(y0)::DOUBLE AS y0, (max(y0) + 8)::DOUBLE AS y1, count(*) AS n_blocks FROM h GROUP BY doc_id, page_num, chain""",
)
def formula_blocks(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s")).withColumn("block", F.floor(F.col("i") / 2))
    lines = lines.withColumn("page_num", F.floor(F.col("block") / 3) + 1).repartition("doc_id", "page_num")  # texts move once: blocks, pieces and runs stay within a page
    by_block = lines.groupBy("doc_id", "page_num", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "\n").alias("text"))
    k, number = (F.col("doc_id") + F.col("block")) % 5, F.col("doc_id") % 3 + 1
    end = F.when(k == 0, F.concat(F.lit("\nES = a + b*c ("), number, F.lit(")"))).when(k == 1, "\nVaR = x - y").when(k == 2, "\n(3)").when(k == 3, F.concat(F.lit("\nES = wi*Xi + y ("), number, F.lit(")\n "))).otherwise("")
    y0 = F.lit(10.0) * F.col("block")
    blocks = by_block.select(
        "doc_id", "page_num", (F.col("block") % 3).alias("block_no"), F.lit("text").alias("type"), F.concat("text", end).alias("text"),
        F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(100.0).alias("x1"), (y0 + 8).alias("y1"), F.lit(0.9).alias("confidence"),
    )
    return d.merged_formulas(d.promoted_formulas(blocks)).select("doc_id", "page_num", "block_no", "type", "text", "eq_number", "y0", "y1", "n_blocks")


@query("text_diagrams", "SELECT p_partkey AS id, p_partkey % 3 < 2 AS valid FROM part")
def diagrams(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, "graph TD\nA-->B").when(k % 3 == 1, "  pie title x").otherwise("A --> B\ngraph")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), d.is_diagram(code).alias("valid"))


@query("text_quality_counters", "SELECT o_custkey AS doc_id, count(*) AS n_blocks, count(*) FILTER (o_orderkey % 10 < 8) AS n_low_confidence, count(*) FILTER (o_orderkey % 4 = 0 AND o_orderkey % 3 = 0) AS n_bad_diagrams FROM orders GROUP BY o_custkey")
def quality_counters(spark, sf_dir):
    k = F.col("o_orderkey")
    blocks = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("doc_id"), F.when(k % 4 == 0, "mermaid").otherwise("text").alias("type"), F.when(k % 3 == 0, "A-->B").otherwise("graph LR").alias("text"), ((k % 10) / 10).alias("confidence")
    )
    return d.quality_counters(blocks)


@query(
    "text_blocks_kept",
    f"WITH {PAGES}" + r""", n AS (SELECT doc_id, count(DISTINCT page_num) AS n FROM pages GROUP BY doc_id),
l AS (SELECT doc_id, page_num, trim(unnest(string_split(text, chr(10)))) AS line FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(line, '\s', '', 'g'), '\d+$', '') AS line_key FROM l),
repeated AS (SELECT doc_id, line_key FROM k JOIN n USING (doc_id) WHERE length(line) BETWEEN 1 AND 80 AND line_key <> '' GROUP BY doc_id, line_key, n.n
             HAVING count(DISTINCT page_num) >= greatest(2, least(3, CASE WHEN n.n // 4 > 0 THEN n.n // 4 ELSE 2 END))),
kept AS (
  SELECT k.* FROM k LEFT JOIN repeated r USING (doc_id, line_key)
  WHERE line = '' OR NOT (regexp_matches(line, '^[-—–\s]*\d{1,3}[-—–\s]*$') OR regexp_matches(line, '^\d+\s*/\s*\d+\s*$') OR (length(line) <= 24 AND regexp_matches(line, '^[A-Z][A-Z\s.]+$'))
                      OR (r.line_key IS NOT NULL AND length(line) <= 80)))
SELECT doc_id, count(*) AS n_blocks FROM kept GROUP BY doc_id""",
)
def blocks_kept(spark, sf_dir):
    paged = pages(spark, sf_dir)
    blocks = paged.select("doc_id", "page_num", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    placed = blocks.withColumns({"type": F.lit("text"), "page_height": F.lit(800.0), "y0": 100.0 + F.col("block_no") * 20, "y1": 112.0 + F.col("block_no") * 20})
    return d.drop_blocks(placed, d.repeated_lines(paged)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"))


@query(
    "text_overlap",
    r"""WITH t AS (SELECT item_id, string_split(regexp_replace(text, '\s+', '', 'g'), '') AS chars, '| ' || text[:item_id % 9 + 1] || ' |' AS tab FROM benchmark)
SELECT item_id, len(list_filter(chars, lambda c: contains(tab, c))) / len(chars)::DOUBLE > 0.5 AS overlaps FROM t""",
)
def overlap(spark, sf_dir):
    """A text against a table with its first one to nine characters."""
    table = F.concat(F.lit("| "), F.substring("text", 1, (F.col("item_id") % 9 + 1).cast("int")), F.lit(" |"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", d.overlaps_table(F.col("text"), table).alias("overlaps"))


@query(
    "text_reading_order",
    """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY round_even(l_quantity / 10, 0) * 10, l_extendedprice, l_partkey) AS place FROM lineitem""",
)
def reading_order(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_num"), F.col("l_quantity").alias("y0"), F.col("l_extendedprice").alias("x0"))
    return d.reading_order(lines, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", F.col("place").cast("long").alias("place"))


@query(
    "text_chart_types",
    """WITH t AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_partkey % 3 AS m FROM part),
s AS (SELECT id, CASE k WHEN 0 THEN 'bar' WHEN 1 THEN 'pie' WHEN 2 THEN 'line' ELSE 'unknown' END AS t, CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0 END AS tc,
      CASE m WHEN 0 THEN 'pie' WHEN 1 THEN 'bar' ELSE 'unknown' END AS m, CASE m WHEN 0 THEN 0.85 WHEN 1 THEN 0.65 ELSE 0 END AS mc FROM t)
SELECT id, t AS from_texts, m AS from_label, CASE WHEN m = 'unknown' THEN t WHEN t = 'unknown' OR m = t THEN m WHEN mc >= tc + 0.15 THEN m WHEN tc >= mc + 0.15 THEN t WHEN (CASE t WHEN 'pie' THEN 1 ELSE 2 END) > (CASE m WHEN 'pie' THEN 1 ELSE 2 END) THEN t
  WHEN (CASE t WHEN 'pie' THEN 1 ELSE 2 END) = (CASE m WHEN 'pie' THEN 1 ELSE 2 END) AND tc >= mc THEN t ELSE m END AS fused FROM s""",
)
def chart_types(spark, sf_dir):
    from ..operators import charts

    k = F.col("p_partkey")
    texts = F.when(k % 4 == 0, F.array(F.lit("柱状图"))).when(k % 4 == 1, F.array(F.lit("Pie chart"), F.lit("资料来源 x"))).when(k % 4 == 2, F.array(F.lit("2021"), F.lit("2022"), F.lit("2023"))).otherwise(F.array().cast("array<string>"))
    label = F.when(k % 3 == 0, "I see:\nPie.").when(k % 3 == 1, "a bar is there maybe").otherwise("")
    both = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), charts.from_texts(texts).alias("t"), charts.from_label(label).alias("m"))
    return both.select("id", F.col("t.type").alias("from_texts"), F.col("m.type").alias("from_label"), charts.fused(F.col("m"), F.col("t"))["type"].alias("fused"))


@query("text_glyphs", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'ES ≤ λ' ELSE '• 中文' END AS plain, CASE WHEN p_partkey % 2 = 0 THEN 'ES \\leq \\lambda' ELSE '• 中文' END AS latex FROM part")
def glyphs(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, "ES \uf0a3 \uf06c").otherwise("\uf06c 中文")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), d.glyphs_to_unicode(text).alias("plain"), d.glyphs_to_latex(text).alias("latex"))


@query(
    "table_repair",
    "SELECT s_suppkey AS id, '| 名称 | 年化收益率 | 最大回撤 |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| f' || s_suppkey || ' | ' || s_suppkey % 50 || '.5% | -3.25% |' AS \"table\" FROM supplier",
)
def table_repair(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat(F.lit("| 名称 | 年化收孟率最大回撤 |\n|---|---|\n| f"), k, F.lit(" | "), k % 50, F.lit(".5%-3.25% |"))
    fixed = d.repaired_table(text, {"年化收孟率": "年化收益率"}, ("年化收益率", "最大回撤"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("id"), fixed.alias("table"))
