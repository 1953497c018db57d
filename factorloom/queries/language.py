"""One query for each operator of the factor language, over the events panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ieee
from ..plans.compiler import compute, compute_many
from ..sources.bars import events_panel
from . import query
from .sql import EVENTS_PANEL

DAY, ASSET = "PARTITION BY date", "PARTITION BY asset ORDER BY date"


def rows(n: int) -> str:
    return f"({ASSET} ROWS {n - 1} PRECEDING)"


def rolling(agg: str, n: int = 5, x: str = "close") -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} >= {n} THEN {agg} OVER {rows(n)} END"


def rank_of(x: str) -> str:
    return f"(rank() OVER ({DAY} ORDER BY {x}) + (count(*) OVER ({DAY}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER ({DAY})"


def listed(expr: str, n: int = 5) -> str:
    """``expr`` over the list ``seen`` of the last n closes."""
    return f"CASE WHEN len(seen{n}) = {n} THEN {expr.replace('seen', f'seen{n}')} END"


def _moments(power: int, less: float) -> str:
    m = "list_avg(list_transform(seen, lambda v: pow(v - list_avg(seen), {})))"
    return f"({m.format(power)} / pow({m.format(2)}, {power / 2}) - {less})"


QUANTILE = "max(CASE WHEN o = floor((n - 1) * {p} + 0.5) + 1 THEN close END) OVER (PARTITION BY date)"
DECAY = 1 - 2 / 6
EMA = (
    f"list_sum(list_transform(hist, lambda v, i: v * pow({DECAY!r}::DOUBLE, len(hist) - i))) / list_sum(list_transform(hist, lambda v, i: pow({DECAY!r}::DOUBLE, len(hist) - i)))"
)
PEARSON = "CASE WHEN stddev_pop(close) OVER {w} > 0 AND stddev_pop(volume) OVER {w} > 0 THEN covar_pop(close, volume) OVER {w} / (stddev_pop(close) OVER {w} * stddev_pop(volume) OVER {w}) END"

#: name: (formula, the same in SQL over columns of ``panel`` with lists of last closes)
OPERATORS: dict[str, tuple[str, str]] = {
    # cross-sections
    "rank": ("Rank(close)", rank_of("close")),
    "csrank": ("CSRank(volume)", rank_of("volume")),
    "percentile": ("Percentile(amount)", rank_of("amount")),
    "cszscore": ("CSZScore(close)", f"(close - avg(close) OVER ({DAY})) / CASE WHEN stddev_samp(close) OVER ({DAY}) = 0 THEN 1 ELSE stddev_samp(close) OVER ({DAY}) END"),
    "groupneutral": ("GroupNeutral(close)", f"close - avg(close) OVER ({DAY})"),
    "winsorize": ("Winsorize(close, 0.05)", f"CASE WHEN close < {QUANTILE.format(p=0.05)} THEN {QUANTILE.format(p=0.05)} WHEN close > {QUANTILE.format(p=0.95)} THEN {QUANTILE.format(p=0.95)} ELSE close END"),
    "scale": ("Scale(close, 2)", f"close * 2 / sum(abs(close)) OVER ({DAY})"),
    "mean_date": ("Mean(close)", f"avg(close) OVER ({DAY})"),
    "std_date": ("Std(close)", f"stddev_samp(close) OVER ({DAY})"),
    "sum_date": ("Sum(close)", f"sum(close) OVER ({DAY})"),
    "var_date": ("Var(close)", f"var_samp(close) OVER ({DAY})"),
    # histories
    "ref": ("Ref(close, 3)", f"lag(close, 3) OVER ({ASSET})"),
    "ref_ahead": ("Ref(close, -2)", f"lead(close, 2) OVER ({ASSET})"),
    "delta": ("Delta(close, 2)", f"close - lag(close, 2) OVER ({ASSET})"),
    "mean": ("Mean(close, 5)", rolling("avg(close)")),
    "std": ("Std(close, 5)", rolling("stddev_samp(close)")),
    "var": ("Var(close, 5)", rolling("var_samp(close)")),
    "sum": ("Sum(close, 5)", rolling("sum(close)")),
    "median": ("Median(close, 5)", rolling("median(close)")),
    "ema": ("EMA(close, 5)", EMA),
    "wma": ("WMA(close, 5)", listed("list_sum(list_transform(seen, lambda v, i: v * i)) / 15.0")),
    "skew": ("Skew(close, 5)", listed(_moments(3, 0))),
    "kurt": ("Kurt(close, 5)", listed(_moments(4, 3))),
    "mad": ("Mad(close, 4)", f"CASE WHEN count(dev) OVER {rows(4)} >= 4 THEN median(dev) OVER {rows(4)} END"),
    "ts_rank": ("Ts_Rank(close, 5)", listed("len(list_filter(seen, lambda v: v <= close)) / 5.0")),
    "ts_max": ("Ts_Max(high, 5)", rolling("max(high)", x="high")),
    "ts_min": ("Ts_Min(low, 5)", rolling("min(low)", x="low")),
    "ts_argmax": ("Ts_ArgMax(close, 5)", listed("5 - list_position(seen, list_max(seen))")),
    "ts_argmin": ("Ts_ArgMin(close, 5)", listed("5 - list_position(seen, list_min(seen))")),
    "ts_percentile": ("Ts_Percentile(close, 5, 25)", rolling("quantile_cont(close, 0.25)")),
    "count": ("Count(Ref(close, 1)) + Count()", f"CASE WHEN lag(close) OVER ({ASSET}) IS NULL THEN 0 ELSE 1 END + 1"),
    "corr": ("Corr(close, volume, 6)", f"CASE WHEN count(close) OVER {rows(6)} >= 6 THEN {PEARSON.format(w=rows(6))} END"),
    "correlation": ("Correlation(close, volume, 8)", f"CASE WHEN count(close) OVER {rows(8)} >= 8 THEN {PEARSON.format(w=rows(8))} END"),
    "cov": ("Cov(close, volume, 6)", f"CASE WHEN count(close) OVER {rows(6)} >= 6 THEN covar_samp(close, volume) OVER {rows(6)} END"),
    # row by row
    "abs": ("Abs(close - open)", "abs(close - open)"),
    "log": ("Log(volume + 1)", "ln(volume + 1)"),
    "sqrt": ("Sqrt(volume)", "sqrt(volume)"),
    "exp": ("Exp(close / 100)", "exp(close / 100)"),
    "sign": ("Sign(close - open)", "sign(close - open)::DOUBLE"),
    "pow": ("Pow(amount, 3)", "pow(amount, 3)"),
    "power_truncated": ("Power(amount, 2.9) + Pow(amount)", "pow(amount, 2) * 2"),
    "neg": ("Neg(close) + Negate(open)", "-close - open"),
    "inv": ("Inv(amount)", "1 / amount"),
    "ceil": ("Ceil(close)", "ceil(close)"),
    "floor": ("Floor(close)", "floor(close)"),
    "trigonometry": ("Sin(amount) + Cos(amount) + Tan(amount / 100)", "sin(amount) + cos(amount) + tan(amount / 100)"),
    "round": ("Round(close)", "round(close)"),
    "max": ("Max(close - open) + Max(close, 50)", "greatest(close - open, 0) + greatest(close, 50)"),
    "min": ("Min(close - open) + Min(close, 50)", "least(close - open, 0) + least(close, 50)"),
    "const": ("Const(3) * close", "3 * close"),
    "if": ("If(Greater(close, open), close, open * 2)", "CASE WHEN close > open THEN close ELSE open * 2 END"),
    "comparisons": (
        "Greater(close, open) + 2 * Less(close, open) + 4 * GreaterEqual(close, high) + 8 * LessEqual(close, low) + 16 * Equal(close, open) + 32 * NotEqual(close, open)",
        "(close > open)::INT + 2 * (close < open)::INT + 4 * (close >= high)::INT + 8 * (close <= low)::INT + 16 * (close = open)::INT + 32 * (close <> open)::INT",
    ),
    "logic": ("If(And(Greater(close, 10), Less(close, 60), Not(Equal(amount, 1))), 1, If(Or(Less(close, 5), Greater(amount, 4)), 2, 3))",
              "CASE WHEN close > 10 AND close < 60 AND NOT amount = 1 THEN 1 WHEN close < 5 OR amount > 4 THEN 2 ELSE 3 END"),
    "clip": ("Clip(close, 20, 60)", "greatest(least(close, 60), 20)"),
    "arithmetic": ("Add(close, open) - Sub(close, low) * Mul(2, amount) / Div(high, 3)", "close + open - (close - low) * (2 * amount) / (high / 3)"),
    "arithmetic_aliases": ("Plus(close, Minus(open, Subtract(high, Mult(low, Multiply(2, Divide(open, Divi(high, 2)))))))", "close + (open - (high - low * (2 * (open / (high / 2)))))"),
    "infix": ("-close + +open * 2 - amount ** 0.5", "-close + open * 2 - pow(amount, 0.5)"),
    "field_alias": ("$turnover / 10 + $vwap", "volume / 10 + close"),
    # compositions
    "nested_history_of_cross_section": ("Mean(Rank(close), 5)", rolling("avg(cs_rank)", x="cs_rank")),
    "nested_cross_section_of_history": ("CSZScore(Std(close, 5) / Mean(close, 5))", "(cv - avg(cv) OVER (PARTITION BY date)) / CASE WHEN stddev_samp(cv) OVER (PARTITION BY date) = 0 THEN 1 ELSE stddev_samp(cv) OVER (PARTITION BY date) END"),
}

SQL = """WITH {panel},
helped AS (
  SELECT *, list(close) OVER {five} AS seen5, list(close) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS hist,
         row_number() OVER (PARTITION BY date ORDER BY close) AS o, count(close) OVER (PARTITION BY date) AS n, {cs_rank} AS cs_rank,
         CASE WHEN count(close) OVER {five} >= 5 THEN stddev_samp(close) OVER {five} / avg(close) OVER {five} END AS cv,
         abs(close - CASE WHEN count(close) OVER {four} >= 4 THEN median(close) OVER {four} END) AS dev
  FROM panel)
SELECT * FROM (SELECT date, asset, round(({expr})::DOUBLE, 6) + 0.0 AS factor_value FROM helped) WHERE factor_value IS NOT NULL"""


def _register(name: str, formula: str, expr: str) -> None:
    sql = SQL.format(panel=EVENTS_PANEL, five=rows(5), four=rows(4), cs_rank=rank_of("close"), expr=expr)

    @query(f"factor_{name}", sql)
    def run(spark, sf_dir):
        values = compute(events_panel(spark, sf_dir), formula)
        return values.withColumn("factor_value", ieee.rounded(F.col("factor_value"), 6) + F.lit(0.0))


for _name, (_formula, _expr) in OPERATORS.items():
    _register(_name, _formula, _expr)

MANY = {"momentum": "close / Ref(close, 5) - 1", "reversal": "-1 * Delta(close, 1) / Ref(close, 1)", "liquidity": "Rank(volume)", "trend": "Mean(close, 5) / Mean(close, 10) - 1"}


@query(
    "factor_many_in_one_plan",
    f"""WITH {EVENTS_PANEL}, wide AS (
  SELECT date, asset, close / lag(close, 5) OVER ({ASSET}) - 1 AS momentum, -1 * (close - lag(close, 1) OVER ({ASSET})) / lag(close, 1) OVER ({ASSET}) AS reversal,
         {rank_of("volume")} AS liquidity, ({rolling("avg(close)")}) / ({rolling("avg(close)", 10)}) - 1 AS trend FROM panel)
SELECT date, asset, round(momentum, 6) + 0.0 AS momentum, round(reversal, 6) + 0.0 AS reversal, round(liquidity, 6) + 0.0 AS liquidity, round(trend, 6) + 0.0 AS trend FROM wide""",
)
def many(spark, sf_dir):
    wide = compute_many(events_panel(spark, sf_dir), MANY)
    return wide.select("date", "asset", *[(ieee.rounded(F.col(n), 6) + F.lit(0.0)).alias(n) for n in MANY])
