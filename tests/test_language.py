"""The factor language: edges that the driver's tables do not have, and independent pandas and NumPy results."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.errors import FormulaError, UnsafeFormulaError
from factorloom.operators.language import REGISTRY
from factorloom.plans import checks, normalize
from factorloom.plans.compiler import Compiler, compute, compute_long, compute_many, compute_or_proxy

DAY = dt.date(2024, 1, 1)


def panel(spark, **assets):
    rows = [(DAY + dt.timedelta(days=i), a, None if x is None else float(x), float(i + 1)) for a, xs in assets.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "date date, asset string, close double, volume double")


def values(df, formula, asset="a"):
    rows = compute_many(df, {"v": formula}).where(f"asset = '{asset}'").orderBy("date").collect()
    return [r["v"] for r in rows]


def test_warm_up_and_nulls(spark):
    p = panel(spark, a=[1, 2, None, 4, 5, 6])
    assert values(p, "Mean(close, 2)") == [None, 1.5, None, None, 4.5, 5.5]
    assert values(p, "Ref(close, 1)") == [None, 1.0, 2.0, None, 4.0, 5.0]
    assert values(p, "Ref(close, -1)") == [2.0, None, 4.0, 5.0, 6.0, None]
    assert values(p, "Count(close)") == [1.0, 1.0, 0.0, 1.0, 1.0, 1.0]


def test_division_and_logs_are_ieee(spark):
    p = panel(spark, a=[0, 1, -1])
    assert values(p, "close / 0")[1:] == [math.inf, -math.inf] and math.isnan(values(p, "close / 0")[0])
    logs = values(p, "Log(close)")
    assert logs[0] == -math.inf and logs[1] == 0.0 and math.isnan(logs[2])
    assert values(p, "Inv(close)")[0] == math.inf


def test_constants(spark):
    p = panel(spark, a=[1, 2])
    for formula, value in {"Rank(3)": 0.5, "CSZScore(3)": 0.0, "Mean(3, 5)": 3.0, "Std(3, 5)": 0.0, "Sum(3, 5)": 15.0, "Ref(3, 1)": 3.0, "Delta(3, 1)": 0.0, "Ts_Rank(3, 5)": 0.5, "Inv(0)": math.inf, "Pow(3)": 9.0, "EMA(3, 2)": 3.0}.items():
        assert values(p, formula) == [value, value], formula


def test_windows_are_truncated_and_columns_stand_for_twenty(spark):
    p = panel(spark, a=range(1, 31))
    assert values(p, "Mean(close, 2.9)") == values(p, "Mean(close, 2)")
    assert values(p, "Mean(close, volume)") == values(p, "Mean(close, 20)")
    assert values(p, "Pow(close, 0.5)") == [1.0] * 30
    assert values(p, "close ** 0.5")[3] == 2.0


def test_max_is_row_wise(spark):
    assert values(panel(spark, a=[-1, 5, 3]), "Max(close, 2)") == [2.0, 5.0, 3.0]
    assert values(panel(spark, a=[-1, 5, 3]), "Max(close)") == [0.0, 5.0, 3.0]


def test_constant_cross_section_and_correlation(spark):
    p = panel(spark, a=[1, 1, 1, 1], b=[1, 1, 1, 1])
    assert values(p, "CSZScore(close)") == [0.0] * 4
    assert values(p, "Corr(close, volume, 3)") == [None] * 4


def test_rank_ties_and_missing(spark):
    p = panel(spark, a=[1], b=[1], c=[3], d=[None])
    got = {r["asset"]: r["v"] for r in compute_many(p, {"v": "Rank(close)"}).collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 1.0, "d": None}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-100, 100, width=32), min_size=8, max_size=25, unique=True), st.integers(2, 6))
def test_histories_agree_with_pandas(spark, xs, n):
    p, s = panel(spark, a=xs), pd.Series(xs)
    want = {
        f"EMA(close, {n})": s.ewm(span=n).mean(), f"Mean(close, {n})": s.rolling(n).mean(), f"Std(close, {n})": s.rolling(n).std(), f"Median(close, {n})": s.rolling(n).median(),
        f"Ts_Rank(close, {n})": s.rolling(n).apply(lambda w: (w <= w.iloc[-1]).mean()), f"Ts_ArgMax(close, {n})": s.rolling(n).apply(lambda w: n - 1 - np.argmax(w.to_numpy())),
        f"WMA(close, {n})": s.rolling(n).apply(lambda w: np.average(w, weights=range(1, n + 1))),
    }
    got = compute_many(p, {f"c{i}": f for i, f in enumerate(want)}).orderBy("date").toPandas()
    for i, series in enumerate(want.values()):
        np.testing.assert_allclose(got[f"c{i}"].to_numpy(float), series.to_numpy(), rtol=1e-6, atol=1e-6)


def test_long_history_of_exponential_average(spark):
    xs = list(np.random.default_rng(1).normal(size=700))
    np.testing.assert_allclose(values(panel(spark, a=xs), "EMA(close, 10)"), pd.Series(xs).ewm(span=10).mean(), rtol=1e-12)


def test_equal_parts_share_one_column(spark):
    c = Compiler(["date", "asset", "close"])
    for formula in ("Std(close, 5) / Mean(close, 5)", "CSZScore(Std(close, 5) / Mean(close, 5))", "Mean(close, 5)"):
        c.compile(formula)
    assert sum(map(len, c.levels)) == 3 and len(c.levels) == 2


def test_one_exchange_for_all_histories(spark):
    p = panel(spark, a=[1, 2, 3]).repartition(3)
    plan = compute_many(p, {"x": "Mean(close, 2) + Ref(close, 1)", "y": "EMA(close, 3) - Ts_Max(close, 2)"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(asset") == 1


@pytest.mark.parametrize("formula", ["close +", "close > 1", "Nope(close)", "missing + 1", "Mean(close, n=3)", "close.shift(1)", "Mean()", "Mean(close, 0)", "lambda: 1", "'x'", "1 / 0", "Ref(close)"])
def test_refused(spark, formula):
    with pytest.raises(FormulaError):
        compute(panel(spark, a=[1]), formula)


def test_proxy_is_flagged(spark):
    flags = {}
    got = compute_or_proxy(panel(spark, a=[7]), "Nope(close)", flags, strict=False).collect()
    assert got[0]["factor_value"] == 7.0 and flags["formula_fallback"]


def test_long_form(spark):
    got = compute_long(panel(spark, a=[1, 2]), {"x": "close", "y": "Ref(close, 1)"})
    assert sorted((r["factor"], r["factor_value"]) for r in got.collect()) == [("x", 1.0), ("x", 2.0), ("y", 1.0)]


def test_names_of_the_language():
    assert len(REGISTRY) >= 66 and {"Rank", "Ts_ArgMin", "Divi", "Correlation", "Subtract"} <= set(REGISTRY)


# ---- checks ---------------------------------------------------------------------------------------------------------


def test_validation():
    assert checks.validate("Rank(Ref(volume, 1))").valid
    for bad in ("", "Mean(close, 5", "close)", "Foo(close)", "Ref(close, -1)", "Delta(volume, -2)", "Corr(close, close, 5)", "Div(open, open)", "Const(3)"):
        assert not checks.validate(bad).valid, bad
    assert len(checks.validate("close / open").warnings) == 2


def test_lookahead():
    assert checks.lookahead("Ref(volume, 1)").risk == "none"
    assert checks.lookahead("Ref(volume, -1)").risk == "high"
    assert checks.lookahead("volume * close").risk == "low"
    assert checks.lookahead("open * close").risk == "medium"
    assert checks.lookahead("volume.shift(-1)").has_lookahead
    assert {f.rule for f in checks.lookahead("lead(volume)").findings} == {"text_lead"}
    assert checks.lookahead("volume +").risk == "none"


def test_safety():
    checks.assert_safe("Rank(close) + 1")
    for bad in ("__import__('os')", "eval(close)", "close.x", "[c for c in close]", "(lambda: 1)()", "open(1).read()"):
        with pytest.raises(UnsafeFormulaError):
            checks.assert_safe(bad)


def test_normalisation():
    assert normalize.rewrite("Delay($pe, 5) × 2") == "Ref(pe_ratio, 5) * 2"
    assert normalize.rewrite("Std(close)") == "Std(close, 20)" and normalize.rewrite("Mean(close)") == "Mean(close)"
    assert normalize.rewrite("Std(close, N)") == "Std(close, 20)"
    assert normalize.rewrite("Mean(returns, 5)") == "Mean(close / Ref(close, 1) - 1, 5)"
    assert normalize.normalize_formula("Rank(volume)") == ("Rank(volume)", False, False)
    assert normalize.normalize_formula("Rank(ytm)") == ("Rank(close)", True, False)
    assert normalize.normalize_formula("", "size") == ("-1 * CSZScore(Log(market_cap))", True, False)
    assert normalize.normalize_formula("因子 = 收盘价 / 均价")[1]
    assert normalize.normalize_universe("沪深300成分") == ("csi300", False)
    assert normalize.normalize_universe("futures") == ("csi300", True)
    assert normalize.normalize("Power(close, 2)", None).mechanical_rewrite
    for written, want in {
        "\\frac{close}{Mean(close, N)}": "close / Mean(close, 20)", "close^2 + mkt_cap³": "Pow(close, 2) + Pow(market_cap, 3)", "(open+high)**0.5": "Pow(open + high, 0.5)",
        "Resid(PB, [size, 市值])": "CSZScore(pb_ratio)", "resid(roe)": "CSZScore(return_on_equity)", "Mean(收盘价, lookback)": "Mean(close, 20)", "Corr(close, volume, Window)": "Corr(close, volume, 20)",
        "EMA(power(turnover_rate, 2))": "EMA(Pow(volume, 2), 20)", "close +": "close +", "Mean(Ret, 5) ÷ 2": "Mean(close / Ref(close, 1) - 1, 5) / 2", "n * close": "n * close",
    }.items():
        assert normalize.rewrite(written) == want
    assert [normalize.is_prose(f) for f in ("alpha = close", "close >= open", "If(close == open, 1, 2)", "a b " * 40, "σ(close)", "close / open", "x_ =1", "(1) = 2")] == [True, False, False, True, True, False, True, False]
    assert [normalize.normalize_universe(u) for u in (None, " ", "CSI 1000 index", "可转债池", "全A", "nikkei")] == [("csi300", False)] * 2 + [("csi1000", False), ("全转债", False), ("csi300", False), ("csi300", True)]


@pytest.mark.parametrize(
    ("cause", "want"),
    [("lookahead_bias", "Mean(Ref(close, 1), 20)"), ("formula_error", "CSZScore(Mean(close, 20))"), ("parameter_error", "Mean(close, 10)"), ("data_mismatch", "Rank(Mean(close, 20))"), ("unknown", "(Mean(close, 20))")],
)
def test_revision(cause, want):
    assert normalize.revise("Mean(close, 20)", "csi300", cause)[0] == want


def test_revision_of_universe():
    assert normalize.revise("close", "csi300", "universe_mismatch")[1] == "csi500"
    assert normalize.revise("close", "可转债", "universe_mismatch")[1] == "csi300"


@pytest.mark.parametrize(
    ("formula", "cause", "want"),
    [
        ("Mean(volume, 5)", "lookahead_bias", "Ref(Mean(volume, 5), 1)"), ("Ref(close, 5) / open", "lookahead_bias", "Ref(close, 5) / Ref(open, 1)"), ("CSZScore(close)", "formula_error", "Rank(CSZScore(close))"),
        ("Rank(close)", "formula_error", "Rank(close)"), ("Rank(close)", "data_mismatch", "Rank(close)"), ("Ref(close, 1) / Mean(close, 9)", "parameter_error", "Ref(close, 2) / Mean(close, 9)"), ("close * 0.5", "parameter_error", "close * 0.5"),
        ("close +", "formula_error", "CSZScore(close)"), ("", "lookahead_bias", "Ref(close, 1)"), ("close", "other", "close"),
    ],
)
def test_revision_works_on_the_tree(formula, cause, want):
    assert normalize.revise(formula, "csi300", cause)[0] == want


def test_reflection_ends():
    from factorloom.plans.reflection import reflect

    fixed = reflect(lambda f, u, w: ("CSZScore" in f, 0.0 if "CSZScore" in f else 2.0, "formula_error"), "Mean(close, 20)", "csi300")
    assert fixed.status == "converged" and fixed.best.formula == "CSZScore(Mean(close, 20))"
    assert reflect(lambda f, u, w: (False, 1.0, "unknown"), "close", "csi300").status == "escalated"
    scores = iter([3.0, 2.0, 1.0])
    assert reflect(lambda f, u, w: (False, next(scores), "data_mismatch"), "close", "csi300").status == "exhausted"


@pytest.mark.parametrize("n", [1, 2, 5, 20, 250])
def test_ema_over_long_histories(spark, n):
    """Blocks of every length (five rows at n = 1 or 2, 1,728 at n = 250), gaps and values far apart, against pandas."""
    r = np.random.default_rng(n)
    xs = np.where(r.random(6000) < 0.1, np.nan, r.normal(0, 1, 6000).cumsum() * 10.0 ** r.integers(0, 6, 6000))
    got = np.array(values(panel(spark, a=[None if math.isnan(x) else float(x) for x in xs], b=[1.0, 2.0, 3.0]), f"EMA(close, {n})"), float)
    want = pd.Series(xs).ewm(span=n, ignore_na=False).mean().where(~np.isnan(xs))
    size = pd.Series(np.abs(xs)).ewm(span=n, ignore_na=False).mean()
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=float(size.max()) * 1e-12, equal_nan=True)


def test_ema_costs_the_same_for_any_window(spark):
    import time

    p = panel(spark, **{f"s{k}": np.random.default_rng(k).normal(size=3000).tolist() for k in range(20)}).cache()
    p.count()

    def seconds(n):
        began = time.perf_counter()
        compute_many(p, {"x": f"EMA(close, {n})"}).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(20)
    short, long = (min(seconds(n) for _ in range(2)) for n in (20, 250))
    assert long < 2 * short + 0.5


@pytest.mark.parametrize("n", [63, 64, 100, 250])
def test_rolling_extremes_over_long_windows(spark, n):
    """By blocks from 64 rows on, against pandas: gaps, ties, NaN, a history shorter than the window, and beside a cross-section of the same column."""
    r = np.random.default_rng(n)
    xs = [None if r.random() < 0.004 else math.nan if r.random() < 0.002 else float(x) for x in r.integers(0, 40, 1200)]
    p = panel(spark, a=xs, b=[1.0, 3.0, 2.0])
    names = {"Ts_Max": lambda w: np.max(w), "Ts_Min": lambda w: np.nanmin(w), "Ts_ArgMax": lambda w: n - 1 - (np.flatnonzero(np.isnan(w))[0] if np.isnan(w).any() else np.argmax(w)), "Ts_ArgMin": lambda w: n - 1 - np.nanargmin(w)}
    rows = compute_many(p, {k: f"{k}(close, {n})" for k in names} | {"w": "Winsorize(close, 0.1)"}).orderBy("asset", "date").collect()
    assert all(r[k] is None for r in rows[1200:] for k in names)
    for k, f in names.items():
        for i, row in enumerate(rows[:1200]):
            window = xs[max(0, i - n + 1) : i + 1]
            if len(window) < n or any(x is None for x in window):
                assert row[k] is None, (k, i)
            else:
                want = f(np.array(window))
                assert row[k] == want or (math.isnan(row[k]) and math.isnan(want)), (k, i)


def test_long_windows_of_extremes_cost_the_same(spark):
    import time

    p = panel(spark, **{f"s{k}": np.random.default_rng(k).normal(size=2000).tolist() for k in range(12)}).cache()
    p.count()

    def seconds(n):
        began = time.perf_counter()
        compute_many(p, {"x": f"Ts_Max(close, {n})"}).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(64)
    short, long = (min(seconds(n) for _ in range(2)) for n in (64, 1000))
    assert long < 2 * short + 0.5
