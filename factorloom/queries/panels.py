"""Queries on panels: bars, guards, universes, fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ieee
from ..operators import guards
from ..plans.run import run
from ..session import scratch_path
from ..sources import panel as source
from ..sources.bars import events_panel, supplier_panel
from . import query
from .sql import EVENTS_PANEL, SUPPLIER_PANEL


@query("bars_events", f"WITH {EVENTS_PANEL} SELECT date, asset, open, high, low, close, round(volume, 6) AS volume, amount FROM panel")
def bars_events(spark, sf_dir):
    return events_panel(spark, sf_dir).withColumn("volume", ieee.rounded(F.col("volume"), 6))


@query("bars_suppliers", f"WITH {SUPPLIER_PANEL} SELECT date, asset, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume, amount FROM panel")
def bars_suppliers(spark, sf_dir):
    return supplier_panel(spark, sf_dir).withColumns({c: ieee.rounded(F.col(c), 8) for c in ("open", "high", "low", "close")})


@query("universe_filter", f"WITH {EVENTS_PANEL} SELECT date, asset, close FROM panel WHERE asset IN ('1', '2', '3', '5', '8') AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def universe_filter(spark, sf_dir):
    kept = source.in_universe(events_panel(spark, sf_dir), ["1", "2", "3", "5", "8"])
    return kept.where(F.col("date").between("2024-01-05", "2024-01-20")).select("date", "asset", "close")


@query("repeated_keys", f"WITH {EVENTS_PANEL}, twice AS (SELECT date, asset FROM panel UNION ALL SELECT date, asset FROM panel WHERE asset = '7') SELECT date, asset, count(*) AS n FROM twice GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    p = events_panel(spark, sf_dir).select("date", "asset")
    return source.repeated_keys(p.unionByName(p.where("asset = '7'")))


@query(
    "fundamentals_join",
    f"WITH {SUPPLIER_PANEL} SELECT date, asset, round(close, 8) AS close, s_acctbal AS market_cap FROM panel LEFT JOIN supplier ON asset = CAST(s_suppkey AS VARCHAR) AND date >= DATE '1996-01-01'",
)
def fundamentals_join(spark, sf_dir):
    p = supplier_panel(spark, sf_dir)
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("ts_code"), F.col("s_acctbal").alias("market_cap"))
    later = p.where(F.col("date") >= "1996-01-01").select(F.col("date").alias("trade_date"), F.col("asset").alias("ts_code"))
    fundamentals = later.join(supplier, "ts_code")
    joined = source.with_fundamentals(p, fundamentals, ["market_cap", "pe_ratio"])
    return joined.select("date", "asset", ieee.rounded(F.col("close"), 8).alias("close"), "market_cap")


#: A panel with what guards look at, from the events panel: names, listing dates and states by asset and day.
GUARDED = f"""{EVENTS_PANEL},
listed AS (
  SELECT *, CASE WHEN asset::BIGINT % 11 = 0 THEN '*ST ' || asset WHEN asset::BIGINT % 13 = 0 THEN NULL ELSE 'unit ' || asset END AS name,
         CASE WHEN asset::BIGINT % 5 = 0 AND day(date) % 9 = 0 THEN 'suspended' ELSE 'active' END AS status,
         DATE '2023-11-01' + (asset::BIGINT % 7)::INTEGER * 5 AS list_date FROM panel),
early AS (
  SELECT *, CASE WHEN name IS NULL OR regexp_matches(name, '(?i)\\*?ST|ST\\*|\\*ST') OR regexp_matches(asset, '(?i)\\*?ST') THEN 'special'
                 WHEN NOT volume > 0 OR status = 'suspended' THEN 'suspended' WHEN date - list_date < 60 THEN 'new_listing' END AS early FROM listed),
moved AS (SELECT *, close / lag(close) OVER (PARTITION BY asset, early IS NULL ORDER BY date) - 1 AS move FROM early),
marked AS (
  SELECT *, coalesce(early, CASE WHEN move IS NULL THEN 'no_previous_close' WHEN move > 0.098 OR move < -0.098 THEN 'limit' END) AS dropped_by FROM moved)"""


def listed_panel(spark, sf_dir):
    p = events_panel(spark, sf_dir)
    n = F.col("asset").cast("long")
    return p.withColumns({
        "name": F.when(n % 11 == 0, F.concat(F.lit("*ST "), "asset")).when(n % 13 == 0, None).otherwise(F.concat(F.lit("unit "), "asset")),
        "status": F.when((n % 5 == 0) & (F.dayofmonth("date") % 9 == 0), "suspended").otherwise("active"),
        "list_date": F.date_add(F.lit("2023-11-01").cast("date"), ((n % 7) * 5).cast("int")),
    })


@query("guard_rows", f"WITH {GUARDED} SELECT date, asset, close FROM marked WHERE dropped_by IS NULL")
def guard_rows(spark, sf_dir):
    return guards.guarded(listed_panel(spark, sf_dir)).select("date", "asset", "close")


@query(
    "guard_counts",
    f"""WITH {GUARDED} SELECT count(*) AS rows_before, count(*) FILTER (dropped_by IS NULL) AS rows_after, count(*) FILTER (dropped_by = 'special') AS dropped_special,
    count(*) FILTER (dropped_by = 'suspended') AS dropped_suspended, count(*) FILTER (dropped_by = 'new_listing') AS dropped_new_listing,
    count(*) FILTER (dropped_by = 'limit') AS dropped_limit, count(*) FILTER (dropped_by = 'no_previous_close') AS dropped_no_previous_close FROM marked""",
)
def guard_counts(spark, sf_dir):
    return guards.guard_counts(listed_panel(spark, sf_dir))


@query(
    "run_flags",
    f"""WITH {GUARDED} SELECT count(*) AS rows_before, count(*) FILTER (dropped_by IS NULL) AS rows_after, count(*) FILTER (dropped_by = 'special') AS special, count(*) FILTER (dropped_by = 'suspended') AS suspended,
    count(*) FILTER (dropped_by = 'new_listing') AS new_listing, count(*) FILTER (dropped_by = 'limit') AS "limit", count(*) FILTER (dropped_by = 'no_previous_close') AS no_previous_close,
    'close / Ref(close, 2) - 1' AS formula, false AS formula_fallback, true AS formula_rewritten, true AS universe_fallback FROM marked""",
)
def run_flags(spark, sf_dir):
    """A formula as a report writes it in a pool that is not known: the counts of its guards and what stood in for what."""
    result, flags = run(listed_panel(spark, sf_dir), "$close ÷ Delay($close, 2) - 1", "nikkei")
    values = {"rows_before": flags.rows_before, "rows_after": flags.rows_after, **flags.dropped, "formula": flags.formula, "formula_fallback": flags.formula_fallback, "formula_rewritten": flags.formula_rewritten, "universe_fallback": flags.universe_fallback}
    return result.select(*(F.lit(v).cast("long").alias(k) if type(v) is int else F.lit(v).alias(k) for k, v in values.items()))


@query(
    "adjustment_check",
    f"""WITH {EVENTS_PANEL}, moves AS (SELECT abs(close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1) AS move FROM panel)
SELECT count(*) FILTER (move > 0.3) / count(move)::DOUBLE <= 0.01 AS adjusted, round(count(*) FILTER (move > 0.3) / count(move)::DOUBLE, 6) AS jump_share FROM moves""",
)
def adjustment_check(spark, sf_dir):
    return guards.adjustment_check(events_panel(spark, sf_dir)).withColumn("jump_share", ieee.rounded(F.col("jump_share"), 6))


@query(
    "panel_cache",
    f"""WITH {EVENTS_PANEL}, days AS (SELECT DISTINCT date FROM panel WHERE asset IN ('1', '2', '3', '5', '8') AND date <= DATE '2024-01-20')
SELECT date, asset, close, (SELECT count(*) FROM days WHERE date > DATE '2024-01-12') AS days_added FROM panel WHERE asset IN ('1', '2', '3', '5', '8') AND date BETWEEN DATE '2024-01-08' AND DATE '2024-01-20'""",
)
def panel_cache(spark, sf_dir):
    """Five assets to the twelfth, then to the twentieth: the second read adds the days between alone."""
    folder, added = scratch_path(spark, "prices"), []

    def read(codes, first, last):
        found = source.in_universe(events_panel(spark, sf_dir), codes).where(F.col("date").between(first.isoformat(), last.isoformat()) if first.year > 1 else F.col("date") <= last.isoformat())
        added.append(found.select("date").distinct())
        return found

    assets = ["8", "1", "2", "3", "5"]
    source.cached(spark, folder, assets, read, end="2024-01-12")
    found = source.cached(spark, folder, assets, read, "2024-01-08", "2024-01-20")
    return found.crossJoin(F.broadcast(added[-1].agg(F.count(F.lit(1)).alias("days_added")))).select("date", "asset", "close", "days_added")
