"""Queries on reviews; the reproduced and claimed metrics are made from order numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ieee
from ..operators import legacy, review
from . import query

_K = {"ic_mean": (37, 200, 100, 1000), "ic_ir": (53, 100, 50, 50), "long_short_annual_return": (29, 400, 200, 500), "sharpe_ratio": (41, 500, 200, 100), "max_drawdown": (17, 60, 0, 100), "turnover": (13, 90, 0, 100)}
_C = {"ic_mean": (37, 200, 90, 1000), "ic_ir": (53, 100, 48, 50), "long_short_annual_return": (29, 400, 210, 500), "sharpe_ratio": (41, 500, 190, 100), "max_drawdown": (17, 60, 2, 100)}
_NONE = {"ic_mean": 7, "ic_ir": 5, "long_short_annual_return": 3, "sharpe_ratio": 4, "max_drawdown": 6}


def _sql(k):
    a, m, b, d = k
    return f"((o_orderkey * {a}) % {m} - {b}) / {d}.0::DOUBLE"


ROWS_SQL = "r AS (SELECT o_orderkey AS id, " + ", ".join(f"{_sql(k)} AS {n}" for n, k in _K.items()) + ", " + ", ".join(
    f"CASE WHEN o_orderkey % {_NONE[n]} <> 0 THEN {_sql(k)} + (o_orderkey % 9 - 4) / 40.0::DOUBLE END AS claimed_{n}" for n, k in _C.items()
) + " FROM orders)"
D = {n: f"({n} - claimed_{n})" for n in review.COMPARED}
WITHIN = {
    "ic_mean": f"abs({D['ic_mean']}) <= 0.03", "ic_ir": f"abs({D['ic_ir']}) <= 0.2", "sharpe_ratio": f"abs({D['sharpe_ratio']}) <= 0.3", "max_drawdown": f"abs({D['max_drawdown']}) <= 0.05",
    "long_short_annual_return": f"CASE WHEN claimed_long_short_annual_return <> 0 THEN abs({D['long_short_annual_return']}) / abs(claimed_long_short_annual_return) <= 0.15 ELSE abs({D['long_short_annual_return']}) <= 5 END",
}
COMPARED_SQL = f"""{ROWS_SQL}, d AS (SELECT *, {', '.join(f'{D[n]} AS delta_{n}' for n in D)}, abs(ic_mean) > 1e-15 AS healthy FROM r),
c AS (SELECT *, {' + '.join(f'(delta_{n} IS NOT NULL)::INTEGER' for n in D)} AS n_claimed, {' AND '.join(f'coalesce({w}, true)' for w in WITHIN.values())} AND healthy AS passed FROM d)"""


def rows(spark, sf_dir):
    k = F.col("o_orderkey")

    def value(x):
        a, m, b, d = x
        return ((k * a) % m - b) / F.lit(float(d))

    out = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("id"), *[value(x).alias(n) for n, x in _K.items()],
        *[F.when(k % _NONE[n] != 0, value(x) + (k % 9 - 4) / F.lit(40.0)).alias(f"claimed_{n}") for n, x in _C.items()],
    )
    return review.compared(out, review.not_degenerate())


def _round(df, *names):
    return df.withColumns({n: ieee.rounded(F.col(n), 6) + F.lit(0.0) for n in names})


@query(
    "review_deviation",
    f"WITH {COMPARED_SQL} SELECT id, n_claimed, healthy, passed, {', '.join(f'round(delta_{n}, 6) + 0.0 AS delta_{n}' for n in D)} FROM c",
)
def deviation(spark, sf_dir):
    names = [f"delta_{n}" for n in D]
    return _round(rows(spark, sf_dir).select("id", "n_claimed", "healthy", "passed", *names), *names)


SCALES = {"ic_mean": 0.03, "ic_ir": 0.2, "long_short_annual_return": 0.15, "sharpe_ratio": 0.3, "max_drawdown": 0.05}


@query(
    "review_deviation_score",
    f"WITH {COMPARED_SQL} SELECT id, round(CASE WHEN passed THEN 0 WHEN n_claimed = 0 THEN 1 ELSE sqrt({' + '.join(f'coalesce(pow(delta_{n} / {s}::DOUBLE, 2), 0)' for n, s in SCALES.items())}) END, 6) + 0.0 AS score FROM c",
)
def deviation_score(spark, sf_dir):
    return _round(rows(spark, sf_dir).select("id", review.deviation_score().alias("score")), "score")


ALL = "[" + ", ".join(f"delta_{n}" for n in D) + "]"
CAUSE_SQL = f"""CASE WHEN abs(delta_ic_mean) > 0.05 AND abs(delta_ic_ir) > 0.3 AND delta_ic_mean * delta_ic_ir > 0 THEN 'lookahead_bias'
  WHEN len(list_filter({ALL}, lambda v: abs(v) > 0.01)) >= 3 AND (len(list_filter({ALL}, lambda v: abs(v) > 0.01 AND v > 0)) IN (0, len(list_filter({ALL}, lambda v: abs(v) > 0.01)))) THEN 'data_mismatch'
  WHEN abs(delta_ic_mean) <= 0.03 AND (coalesce(abs(delta_sharpe_ratio) > 0.3, false) OR coalesce(abs(delta_long_short_annual_return) > 5, false)) THEN 'parameter_error'
  WHEN abs(delta_ic_mean) > 0.03 AND (coalesce(abs(delta_long_short_annual_return) <= 0.05, false) OR coalesce(abs(delta_sharpe_ratio) <= 0.05, false) OR coalesce(abs(delta_max_drawdown) <= 0.05, false)) THEN 'formula_error'
  WHEN abs(delta_ic_mean) > 0.02 AND abs(delta_sharpe_ratio) > 0.2 AND delta_ic_mean * delta_sharpe_ratio > 0 THEN 'universe_mismatch' ELSE 'unknown' END"""


@query("review_root_cause", f"WITH {COMPARED_SQL} SELECT id, {CAUSE_SQL} AS cause FROM c")
def root_cause(spark, sf_dir):
    return rows(spark, sf_dir).select("id", review.root_cause().alias("cause"))


@query(
    "review_significance",
    f"""WITH {COMPARED_SQL}, s AS (SELECT id, list_transform(list_filter({ALL}, lambda v: v IS NOT NULL), lambda v: abs(v)) AS v FROM c),
t AS (SELECT id, len(v) AS n, list_avg(v) AS m, list_stddev_pop(v) AS sd FROM s)
SELECT id, CASE WHEN n = 0 THEN false WHEN n < 2 OR sd < 1e-10 THEN m > 0.02 ELSE m / (sd / sqrt(n)) > 2 END AS significant FROM t""",
)
def significance(spark, sf_dir):
    return rows(spark, sf_dir).select("id", review.significant().alias("significant"))


@query(
    "review_score",
    f"""WITH {ROWS_SQL}, s AS (SELECT id, greatest(least(50 + greatest(least(ic_mean * 200, 20), -20) + greatest(least(sharpe_ratio * 10, 20), -15) - least(abs(max_drawdown) * 30, 15)
  + CASE WHEN id % 3 = 0 THEN 0 ELSE greatest(least(((id % 10) / 10.0::DOUBLE - 0.5) * 20, 15), -10) END - CASE WHEN id % 4 = 0 THEN 0 ELSE least((id % 11) / 11.0::DOUBLE * 25, 20) END, 100), 0) AS s FROM r)
SELECT id, round(s, 4) + 0.0 AS score, CASE WHEN s >= 80 THEN 'A' WHEN s >= 65 THEN 'B' WHEN s >= 50 THEN 'C' ELSE 'D' END AS grade FROM s""",
)
def score(spark, sf_dir):
    df = rows(spark, sf_dir)
    points = review.quality_score(F.when(F.col("id") % 3 != 0, (F.col("id") % 10) / F.lit(10.0)), F.when(F.col("id") % 4 != 0, (F.col("id") % 11) / F.lit(11.0)))
    return df.select("id", (ieee.rounded(points, 4) + F.lit(0.0)).alias("score"), review.grade(points).alias("grade"))


@query(
    "review_decay",
    """WITH r AS (SELECT c_custkey AS id, (c_custkey % 21 - 5) / 100.0::DOUBLE AS was, (c_custkey % 17 - 6) / 100.0::DOUBLE AS now FROM customer),
d AS (SELECT *, CASE WHEN was > 0 THEN greatest((was - now) / was, -1) WHEN now > 0 THEN -1 ELSE 0 END AS drop_ratio FROM r)
SELECT id, round(drop_ratio, 6) + 0.0 AS drop_ratio, CASE WHEN drop_ratio > 0.5 THEN 'deprecated' WHEN drop_ratio > 0.3 THEN 'decaying' ELSE 'stable' END AS status FROM d""",
)
def decay(spark, sf_dir):
    k = F.col("c_custkey")
    ratio, status = review.decay((k % 21 - 5) / F.lit(100.0), (k % 17 - 6) / F.lit(100.0))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), (ieee.rounded(ratio, 6) + F.lit(0.0)).alias("drop_ratio"), status.alias("status"))


@query("review_elite", f"WITH {COMPARED_SQL} SELECT id, passed AND coalesce(abs(delta_ic_mean) <= 0.015, true) AS elite FROM c")
def elite(spark, sf_dir):
    return rows(spark, sf_dir).select("id", review.elite().alias("elite"))


@query("review_should_reflect", f"WITH {COMPARED_SQL} SELECT id, NOT passed AND id % 5 < 3 AS again FROM c")
def should_reflect(spark, sf_dir):
    return rows(spark, sf_dir).select("id", review.should_reflect((F.col("id") % 5).cast("int")).alias("again"))


@query(
    "review_usable_values",
    """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS asset, value FROM events) SELECT count(value) >= 10 AND stddev_samp(value) >= 1e-12 AS usable FROM p""",
)
def usable(spark, sf_dir):
    return review.usable_values(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("factor_value", F.col("value")))


@query(
    "review_confidence",
    """SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN (p_size % 10) / 10.0 < 0.5 THEN 'low_confidence' END, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 3 > (p_partkey % 4) * 0.5 THEN 'warned_mappings' END,
  CASE WHEN p_partkey % 7 = 0 THEN 'marked_warning' END, CASE WHEN p_partkey % 9 = 0 THEN 'empty_formula' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part""",
)
def confidence(spark, sf_dir):
    k = F.col("p_partkey")
    reasons = review.confidence_reasons(
        (F.col("p_size") % 10) / F.lit(10.0), k % 3, k % 4, F.when(k % 7 == 0, F.concat("p_name", F.lit(" [WARN]"))).otherwise(F.col("p_name")), F.when(k % 9 != 0, F.lit("close"))
    )
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), F.array_join(reasons, ",").alias("reasons"))


STATUSES = "['passed', 'converged', 'review_enqueued', 'failed']"


@query(
    "review_overall_status",
    f"""WITH f AS (SELECT o_custkey AS report, CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 6 = 1 THEN 'passed' ELSE {STATUSES}[(o_orderkey % 4 + 1)::INTEGER] END AS status FROM orders)
SELECT report, count(status) AS n_factors, CASE WHEN count(status) = 0 THEN 'no_factors' WHEN count(*) FILTER (status IN ('passed', 'converged')) = count(status) THEN 'passed'
  WHEN count(*) FILTER (status IN ('passed', 'converged')) > 0 THEN 'partial' WHEN count(*) FILTER (status = 'review_enqueued') > 0 THEN 'review_enqueued' ELSE min(status) END AS status FROM f GROUP BY report""",
)
def overall_status(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(c % 6 == 0, None).when(c % 6 == 1, "passed").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("passed", "converged", "review_enqueued", "failed")]), (k % 4 + 1).cast("int")))
    return review.overall_status(spark.read.parquet(f"{sf_dir}/orders.parquet").select(c.alias("report"), status.alias("status")), "report")


@query(
    "review_failure_modes",
    """WITH r AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 'partial' WHEN 'F' THEN 'passed' ELSE 'no_factors' END AS status FROM orders),
m AS (SELECT CASE WHEN k % 8 <> 0 AND status = 'passed' AND k % 13 <> 0 AND k % 11 <> 0 AND k % 17 <> 0 AND k % 7 <> 0 AND k % 19 <> 0 THEN NULL WHEN k % 13 = 0 THEN 'recovery' WHEN k % 11 = 0 THEN 'formula_proxy_or_fallback'
  WHEN k % 17 = 0 THEN 'universe_fallback' WHEN k % 7 = 0 THEN 'soft_pass' WHEN status = 'partial' OR k % 19 = 0 THEN 'partial_or_factor_fail' WHEN status = 'no_factors' THEN status WHEN k % 8 = 0 THEN 'hard_fail' ELSE 'other:' || status END AS mode FROM r)
SELECT mode, count(*) AS n FROM m GROUP BY mode""",
)
def failure_modes(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "partial").when(F.col("o_orderstatus") == "F", "passed").otherwise("no_factors")
    flags = {"recovery": k % 13 == 0, "proxy": k % 11 == 0, "universe": k % 17 == 0, "soft": k % 7 == 0, "bad": k % 19 == 0}
    mode = review.failure_mode(flags, status, F.when(k % 8 == 0, 1).otherwise(0))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(mode.alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query("review_proposals", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'accept' WHEN o_orderkey % 3 = 1 THEN 'reject' ELSE 'defer' END AS action FROM orders")
def proposals(spark, sf_dir):
    k = F.col("o_orderkey")
    verdict = F.when(k % 3 == 0, "approve").when(k % 3 == 1, "reject").otherwise("revise")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), review.proposal(k % 2 == 0, verdict).alias("action"))


@query(
    "review_tickets",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'skip' WHEN o_orderkey % 3 = 0 THEN 'submit' WHEN o_orderkey % 3 = 1 AND o_orderkey % 7 > 4 THEN 'drop' WHEN o_orderkey % 3 = 1 THEN 'submit' ELSE 'error' END AS action FROM orders""",
)
def tickets(spark, sf_dir):
    k = F.col("o_orderkey")
    category = F.when(k % 3 == 0, "entity_merge").when(k % 3 == 1, "layout_reflection").otherwise("odd")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), legacy.ticket_action(k % 4 != 0, category, k % 7).alias("action"))


#: Terms that reports use for a part's fields, one of them not in the dictionary, and brackets of its formula.
TERMS, ENDS = ("收盘价", "溢价率", "隐波", "某指标", ""), ("close", "(close", "close)", "[close)", "")
NAMES = ("close", "PB ", "x_field")


@query(
    "review_specs",
    f"""WITH p AS (SELECT p_partkey AS id, {list(TERMS)}[1 + p_partkey % 5] AS term, {list(NAMES)}[1 + p_partkey % 3] AS name, {list(ENDS)}[1 + p_partkey % 5] AS formula, p_partkey % 10 / 10.0::DOUBLE AS sure, p_partkey % 4 = 0 AS given FROM part),
d(term, field) AS (VALUES {", ".join(f"('{t}', '{f}')" for t, f in review.DATA_DICTIONARY.items())}),
m AS (SELECT p.*, coalesce(d.field, CASE WHEN lower(trim(name)) IN (SELECT field FROM d) THEN lower(trim(name)) END) AS known FROM p LEFT JOIN d USING (term)),
b AS (SELECT *, replace(replace(regexp_replace(formula, '[^()\\[\\]]', '', 'g'), '()', ''), '[]', '') AS rest FROM m)
SELECT id, CASE WHEN given THEN 'given' WHEN term <> '' THEN term ELSE name END AS report_term, CASE WHEN given THEN 'close' ELSE coalesce(known, name) END AS canonical_term,
       CASE WHEN given THEN CASE WHEN sure >= 0.8 THEN 'OK' ELSE 'WARN' END WHEN known IS NOT NULL THEN 'OK' ELSE 'WARN' END AS tag, CASE WHEN NOT given THEN CASE WHEN known IS NOT NULL THEN 'Auto-mapped' ELSE 'Fallback mapping' END END AS note,
       CASE WHEN formula = '' THEN 'no formula' END AS problem,
       'text' || CASE WHEN rest IN ('(', '[') THEN chr(10) || '[WARN] Formula has unclosed brackets.' WHEN rest <> '' THEN chr(10) || '[WARN] Formula has mismatched brackets.' ELSE '' END
              || CASE WHEN sure < 0.5 THEN chr(10) || '[WARN] Low extraction confidence.' ELSE '' END AS description FROM b""",
)
def specs(spark, sf_dir):
    k = F.col("p_partkey")

    def pick(items):
        return F.element_at(F.array(*[F.lit(x) for x in items]), (k % len(items) + 1).cast("int"))

    sure = k % 10 / F.lit(10.0)
    given = F.struct(F.lit("given").alias("report_term"), F.lit("close").alias("canonical_term"), sure.alias("confidence"))
    table = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("id"), F.col("p_name").alias("factor_name"), pick(ENDS).alias("formula"), F.lit("text").alias("description"), sure.alias("extraction_confidence"),
        F.array(F.struct(pick(NAMES).alias("name"), pick(TERMS).alias("report_name"))).alias("input_fields"), F.when(k % 4 == 0, F.array(given)).alias("mappings"),
    )
    return review.validated_specs(table).select("id", F.explode("mappings").alias("m"), "problem", "description").select("id", "m.report_term", "m.canonical_term", "m.tag", "m.note", "problem", "description")
