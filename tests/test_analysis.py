"""Backtest, metrics, robustness, guards, documents: known values and edges."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.errors import PanelError
from factorloom.operators import backtest, catalog, documents, guards, legacy, metrics, robust
from factorloom.sources import bars, panel

DAY = dt.date(2024, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def factor(spark, dates=12, assets=10, seed=0, constant=False):
    rng = np.random.default_rng(seed)
    rows = [(DAY + dt.timedelta(days=d), f"a{a}", 1.0 if constant else float(rng.normal()), float(rng.normal()) / 50) for d in range(dates) for a in range(assets)]
    df = frame(spark, rows, "date date, asset string, factor_value double, forward_return double")
    return df.select("date", "asset", "factor_value"), df.select("date", "asset", "forward_return")


def test_perfect_and_constant_ic(spark):
    f, _ = factor(spark)
    same = f.select("date", "asset", (F.col("factor_value") * 2).alias("forward_return"))
    assert all(abs(r["ic"] - 1) < 1e-12 for r in metrics.rank_ic(f, same).collect())
    constant, returns = factor(spark, constant=True)
    assert metrics.rank_ic(constant, returns).count() == 0
    assert metrics.ic_summary(metrics.rank_ic(constant, returns)).first().asDict() == {"ic_mean": 0.0, "ic_std": 0.0, "ic_ir": 0.0}


def test_drawdown_starts_at_the_first_value(spark):
    curve = frame(spark, [(DAY + dt.timedelta(days=i), x) for i, x in enumerate([1.0, 0.8, 0.9])], "date date, equity double")
    assert metrics.max_drawdown(curve).first()[0] == pytest.approx(0.2)


def test_weights_and_turnover(spark):
    f, returns = factor(spark)
    grouped = backtest.quantile_groups(f)
    weights = backtest.leg_weights(grouped)
    assert all(abs(r["s"]) < 1e-12 for r in weights.groupBy("date").agg(F.sum("weight").alias("s")).collect())
    traded = backtest.turnover(weights).orderBy("date").collect()
    assert traded[0]["turnover"] == pytest.approx(1.0) and all(0 <= r["turnover"] <= 2 + 1e-12 for r in traded)
    assert {r["group"] for r in grouped.collect()} == set(range(5))


def test_fewer_assets_than_groups_gives_no_legs(spark):
    f, returns = factor(spark, assets=2)
    assert backtest.long_short(backtest.group_returns(backtest.quantile_groups(f), returns)).count() == 0
    prices = f.select("date", "asset", (F.abs("factor_value") + 1).alias("close"))
    row = backtest.backtest(f, prices).first()
    assert row["sharpe_ratio"] == 0.0 and row["max_drawdown"] == 0.0


def test_size_neutral_of_equal_sizes_is_unchanged(spark):
    f, _ = factor(spark)
    same = backtest.size_neutral(f.withColumn("size", F.lit(3.0)), "size")
    assert same.select("date", "asset", "factor_value").exceptAll(f).count() == 0


def test_tau(spark):
    df = frame(spark, [(1, x, y) for x, y in [(1, 1.0), (2, 2.0), (3, 3.0), (3, 2.0)]], "g int, x int, y double")
    assert metrics.kendall_by(df, "x", "y", "g").first()["tau"] == pytest.approx(0.8, abs=1e-9)


def test_half_life(spark):
    curve = frame(spark, [(1, 0.1), (2, 0.06), (5, 0.04)], "lag int, ic double")
    assert metrics.half_life(curve).first()[0] == 5.0
    slow = frame(spark, [(1, 0.1), (2, 0.09), (3, 0.081)], "lag int, ic double")
    assert metrics.half_life(slow).first()[0] == pytest.approx(-math.log(2) / math.log(0.9), rel=1e-9)


def _sharpe(x):
    return x.mean() / x.std(ddof=1) * math.sqrt(252) if len(x) > 1 and x.std(ddof=1) > 0 else 0.0


def test_overfitting_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=63)
    df = frame(spark, [(DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "date date, ls_return double")
    size, ranks = 63 // 5, []
    for chosen in combinations(range(5), 2):
        inside, outside = [], []
        for s in range(5):
            end = (s + 1) * size if s < 4 else 63
            (inside if s in chosen else outside).append(x[s * size : end] if s in chosen else x[int(end - size * 0.3) : end])
        ranks.append((_sharpe(np.concatenate(inside)), _sharpe(np.concatenate(outside))))
    a, b = (np.argsort(np.argsort([r[i] for r in ranks])) for i in (0, 1))
    tau = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i, j in combinations(range(10), 2)) / 45
    assert robust.overfitting_probability(df).first()["pbo"] == pytest.approx((1 - tau) / 2)


def test_bootstrap_and_placebo_repeat(spark):
    x = np.random.default_rng(3).normal(0.1, 1, size=80)
    df = frame(spark, [(DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "date date, ls_return double")
    one, two = (robust.bootstrap_sharpe(d, replicates=300).first() for d in (df, df.repartition(7)))
    assert one == two and one["sharpe_ci_lower"] < _sharpe(x) < one["sharpe_ci_upper"]
    f, returns = factor(spark)
    first, second = (robust.placebo(d, returns, shuffles=30).first() for d in (f, f.repartition(5)))
    assert first["placebo_std"] == pytest.approx(second["placebo_std"]) and abs(first["placebo_mean"]) < 0.1


def test_normal_functions(spark):
    for p in (1e-4, 0.02, 0.3, 0.5, 0.9, 0.975, 0.9999):
        assert robust.normal_cdf(robust.normal_quantile(p)) == pytest.approx(p, rel=1e-6)
    got = spark.range(1).select(*[robust.normal_cdf_column(F.lit(z)).alias(f"c{i}") for i, z in enumerate((-2.0, 0.0, 1.3))]).first()
    np.testing.assert_allclose(list(got), [robust.normal_cdf(z) for z in (-2.0, 0.0, 1.3)], rtol=1e-6)
    assert robust.min_backtest_length(-1)["min_obs"] == 10**9
    assert robust.min_backtest_length(1.0, mirrored_tail=True)["min_obs"] <= robust.min_backtest_length(1.0)["min_obs"]
    assert 0 <= robust.deflated_sharpe(1.0, 10, 252)["dsr"] <= 1 and robust.deflated_sharpe(1.0, 10, 252, deviation=0.0)["p_value"] == 1.0


def test_rolling_walk_forward_differs_from_expanding(spark):
    f, returns = factor(spark, dates=30)
    wide, narrow = robust.walk_forward(f, returns).first(), robust.walk_forward(f, returns, rolling=True).first()
    assert wide["ic_oos_mean"] == pytest.approx(narrow["ic_oos_mean"]) and wide["ic_is_mean"] != pytest.approx(narrow["ic_is_mean"])


def test_guards(spark):
    rows = [(DAY + dt.timedelta(days=i), a, c, v, n) for a, n, s in [("x", "one", [(10, 1), (10.5, 1), (12, 1), (12.1, 0)]), ("y", "*ST two", [(5, 1), (5, 1)]), ("z", None, [(5, 1)])] for i, (c, v) in enumerate(s)]
    df = frame(spark, [(d, a, float(c), float(v), n) for d, a, c, v, n in rows], "date date, asset string, close double, volume double, name string")
    counts = guards.guard_counts(df).first().asDict()
    assert counts == {"rows_before": 7, "rows_after": 1, "dropped_special": 3, "dropped_suspended": 1, "dropped_new_listing": 0, "dropped_limit": 1, "dropped_no_previous_close": 1}
    off = guards.GuardSettings(special=False, suspended=False, new_listing=False, limit=False)
    assert guards.guarded(df, off).count() == 7
    assert guards.adjustment_check(df.withColumn("adj_factor", F.lit(1.0))).first()["adjusted"] is False


def test_panel_names_dates_codes(spark, tmp_path):
    raw = frame(spark, [("20240102", "000001.SZ", 1.0, 1.0, 1.0, 1.0, 5.0)], "trade_date string, ts_code string, open double, high double, low double, close double, vol double")
    raw.write.parquet(f"{tmp_path}/prices.parquet")
    got = panel.load_first(spark, [f"{tmp_path}/none.parquet", f"{tmp_path}/prices.parquet"], universe="csi300", start="2024-01-01").first()
    assert got["date"] == dt.date(2024, 1, 2) and got["asset"] == "000001.SZ"
    codes = frame(spark, [("000001.sz",), ("600000.SH",), ("600000",), ("000001.XSHE",)], "c string").select(panel.asset_code(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["000001.XSHE", "600000.XSHG", "600000.XSHG", "000001.XSHE"]
    with pytest.raises(PanelError):
        panel.require(raw.drop("close"))


def test_bars_of_an_empty_table(spark):
    empty = frame(spark, [], "u string, t timestamp, p double")
    assert bars.bars(empty, F.col("u"), F.to_date("t"), F.col("p"), [F.col("t")]).count() == 0


def test_catalogue(spark):
    versions = frame(spark, [("1.2.3",), ("odd",)], "v string").select(catalog.bumped(F.col("v")), catalog.bumped(F.col("v"), "minor")).collect()
    assert [tuple(r) for r in versions] == [("1.2.4", "1.3.0"), ("1.0.1", "1.1.0")]
    assert frame(spark, [("Mean( close , 20 )",)], "f string").select(catalog.template_of(F.col("f"))).first()[0] == "Mean(close,N)"


def test_rounded_curve(spark):
    moves = frame(spark, [(DAY + dt.timedelta(days=i), x) for i, x in enumerate([0.1, -0.05, 0.0])], "date date, pnl double")
    assert [r["excess"] for r in legacy.rounded_curve(moves, "pnl").orderBy("place").collect()] == [110.0, 104.5, 104.5]
    steps = [round(float(x), 4) for x in np.random.default_rng(1).normal(0, 0.01, 600)]
    want = [100.0]
    for x in steps:
        want.append(round(want[-1] * (1 + x), 6))
    long = frame(spark, [(DAY + dt.timedelta(days=i), x) for i, x in enumerate(steps)], "date date, pnl double")
    got = [(r["place"], r["excess"]) for r in legacy.rounded_curve(long, "pnl").orderBy("place").collect()]
    assert [g[0] for g in got] == list(range(600)) and [g[1] for g in got] == pytest.approx(want[1:], abs=1e-4)
    assert legacy.rounded_curve(long.limit(0), "pnl").count() == 0


# ---- documents ------------------------------------------------------------------------------------------------------


def brute_chunks(text, size, overlap):
    """Chunks by a plain loop over pages or paragraphs."""
    import re

    text = text or ""
    if not text.strip() or len(text) <= size:
        return [text] if text.strip() else []
    marks = [m.start() for m in re.finditer(r"(?m)^(?:<!--\s*page\s*:\s*\d+\s*-->|#+\s*page\s+\d+)", text)]
    parts = [text[i:j].strip() for i, j in zip(marks, [*marks[1:], len(text)])] if len(marks) >= 2 else [p for p in re.split(r"\n{2,}", text) if p.strip()]
    out, held = [], ""
    for part in parts:
        if len(part) > size:
            out += [held] * bool(held) + [part[i : i + size] for i in range(0, len(part), max(1, size - overlap))]
            held = ""
        elif held and len(f"{held}\n\n{part}".strip()) > size:
            out.append(held)
            held = f"{held[-overlap:]}\n\n{part}".strip() if overlap else part
        else:
            held = f"{held}\n\n{part}".strip() if held else part
    return out + [held] * bool(held)


@pytest.mark.parametrize(("size", "overlap"), [(100, 10), (10, 2), (40, 0), (7, 9)])
def test_chunks_pack_pages_and_paragraphs(spark, size, overlap):
    r = np.random.default_rng(size)
    pieces = ["x" * 60, "word ", "\n", "\n\n", "\n\n\n", "<!-- page: 3 -->\n", "\n## page 4 ", " ", "é中🙂", "\r\n", "y" * 25]
    texts = [None, "", "  \n ", "short", "y" * 25, "\n".join(f"<!-- page: {i} -->\n" + "x" * 60 for i in range(3)), "head\n# page 1\na\n# page 2\nb" + "z" * 30] + ["".join(r.choice(pieces, size=r.integers(1, 25))) for _ in range(200)]
    got: dict[int, list] = {}
    for row in documents.chunks(frame(spark, list(enumerate(texts)), "doc_id int, text string"), size, overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(row["doc_id"], []).append(row["chunk"])
    for k, text in enumerate(texts):
        assert got.get(k, []) == brute_chunks(text, size, overlap), text


def test_numbers():
    got = [(n["value"], n["unit"]) for n in documents.numbers_in("收入12.3亿元，(45.6)%，1,234万元 同比 下降3%同比")]
    assert got[:3] == [(12.3, "亿元"), (-45.6, "%"), (1234.0, "万元")] and got[-1] == (3.0, "同比")


def test_metrics():
    got = documents.metrics_in("归母净利润下降 5.2 亿元")
    assert got[0]["name"] == "归母净利润" and got[0]["value"] == -5.2 and got[0]["unit"] == "亿元"
    table = "| 指标 | 2023 |\n|---|---|\n| 营业收入 | 12.5亿元 |\n| other | 3 |"
    assert [(m["name"], m["value"]) for m in documents.table_metrics_in(table)] == [("营收", 12.5)]


def test_text_columns(spark):
    lines = frame(spark, [("证券研究报告",), ("- 12 -",), ("第 3 页 共 9 页",), ("HUATAI SECURITIES",), ("正文内容",), ("",), (None,)], "s string")
    assert [r[0] for r in lines.select(documents.is_boilerplate(F.col("s"))).collect()] == [True, True, True, True, False, False, False]
    texts = frame(spark, [("中文文本",), ("some 中",), ("���a",), ("plain",), ("",)], "s string")
    assert [r[0] for r in texts.select(documents.is_garbled(F.col("s"))).collect()] == [False, True, True, False, False]
    formulas = frame(spark, [("ES = VaR + x (3)",), ("这是一段很长的中文叙述文字没有任何运算符号只是在描述市场情况而已对吧是的没错",), ("[Table_Info] = x",)], "s string")
    assert [r[0] for r in formulas.select(documents.is_formula_line(F.col("s"))).collect()] == [True, False, False]
    clean = frame(spark, [("[Table_A]| HAITONG | x |\n证券研究报告\nbody",)], "s string").select(documents.sanitized(F.col("s"))).first()[0]
    assert "HAITONG" not in clean and "证券研究报告" not in clean and clean.endswith("body")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 63, 97, 1000])
def test_placebo_is_a_permutation(spark, n):
    """Also where the grid has spare cells; replicates and seeds differ."""
    placed = {s: {k: [] for k in (1, 2)} for s in (7, 8)}
    for seed, found in placed.items():
        keys = frame(spark, [(k, robust.round_keys(seed, k)) for k in (1, 2)], "rep int, keys array<long>")
        for r in robust.permuted(spark.range(n).crossJoin(keys).withColumn("place", F.col("id")), "place", n, "keys").orderBy("id").collect():
            found[r["rep"]].append(r["place"])
    orders = [order for found in placed.values() for order in found.values()]
    assert all(sorted(order) == list(range(n)) for order in orders)
    assert n < 63 or len({tuple(order) for order in orders}) == 4


def test_grid_has_few_spare_cells():
    for n in (1, 2, 3, 4, 97, 1009, 39_989, 1_000_003, 10_000_000_019):
        a, b = robust.grid(n)
        assert n <= a * b <= n + max(3, 4 * n**0.25) and (n < 10 or 0.1 < a / b < 10)


def test_bootstrap_against_numpy(spark):
    x = np.random.default_rng(9).normal(0.05, 1, size=120)
    df = frame(spark, [(DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "date date, ls_return double")
    r = np.random.default_rng(1)
    drawn = [_sharpe(r.choice(x, len(x))) for _ in range(4000)]
    got = robust.bootstrap_sharpe(df, replicates=4000).first()
    assert got["n_boot"] == 4000 and got["sharpe_ci_lower"] == pytest.approx(np.quantile(drawn, 0.025), abs=0.4) and got["sharpe_ci_upper"] == pytest.approx(np.quantile(drawn, 0.975), abs=0.4)
    for few in (df.limit(0), df.limit(1)):
        assert tuple(robust.bootstrap_sharpe(few, replicates=50).first()) == (0.0, 0.0, 50, 0, False)
    with pytest.raises(PanelError):
        robust.overfitting_probability(df, splits=20)


def test_placebo_against_numpy(spark):
    """Shuffled factors have the spread of chance: 1 / sqrt(dates * (assets - 1))."""
    f, returns = factor(spark, dates=20, assets=15)
    got = robust.placebo(f, returns, shuffles=60).first()
    assert abs(got["placebo_mean"]) < 0.03 and got["placebo_std"] == pytest.approx(1 / math.sqrt(20 * 14), rel=0.35)
    assert got["true_ic"] == pytest.approx(metrics.rank_ic(f, returns).agg(F.avg("ic")).first()[0])


def test_inversions(spark):
    r = np.random.default_rng(5)
    for n in (1, 2, 7, 33, 64):
        y = r.permutation(n).tolist()
        got = robust.inversions(frame(spark, list(enumerate(y)), "x int, y int"), "x", "y", n).first()[0]
        assert got == sum(y[i] > y[j] for i in range(n) for j in range(i + 1, n))


def test_infinite_returns_are_counted(spark):
    rows = [(DAY + dt.timedelta(days=d), f"a{a}", 0.0 if (d, a) == (3, 1) else 1.0 + a / 10 + d / 100) for d in range(6) for a in range(10)]
    prices = frame(spark, rows, "date date, asset string, close double")
    row = backtest.backtest(prices.select("date", "asset", F.col("close").alias("factor_value")), prices).first()
    assert row["n_nonfinite"] == 1
    series = frame(spark, [(DAY + dt.timedelta(days=i), x) for i, x in enumerate([0.1, float("inf"), 0.2, float("nan"), 0.1, 0.3])], "date date, ls_return double")
    found = robust.bootstrap_sharpe(series, replicates=200).first()
    assert found["n_dropped"] == 2 and math.isfinite(found["sharpe_ci_upper"]) and found["sharpe_ci_upper"] > found["sharpe_ci_lower"] >= 0


def test_size_neutral_over_all_dates(spark):
    f, _ = factor(spark)
    sized = f.withColumn("size", F.pmod(F.xxhash64("asset", "date"), F.lit(100)).cast("double"))
    rows = sized.orderBy("date", "asset").collect()
    x, y = (np.array([r[c] for r in rows]) for c in ("size", "factor_value"))
    b = np.polyfit(x, y, 1)
    got = backtest.size_neutral(sized, "size", by_date=False).orderBy("date", "asset").collect()
    np.testing.assert_allclose([r["factor_value"] for r in got], y - np.polyval(b, x), atol=1e-9)


def test_late_ticks(spark, tmp_path):
    """Ticks count until the watermark has passed their day; later ones are left out, and state of passed days is dropped."""
    from factorloom.streaming.bars import daily_bars, run_to_end

    schema = "asset string, ts timestamp, price double, n long"
    batches = [
        [("a", dt.datetime(2024, 1, 1, 9), 10.0, 1), ("a", dt.datetime(2024, 1, 1, 12), 12.0, 2)],
        [("a", dt.datetime(2024, 1, 1, 8), 9.0, 3), ("b", dt.datetime(2024, 1, 2, 8), 5.0, 4)],  # late, within the watermark
        [("a", dt.datetime(2024, 1, 9, 8), 20.0, 5)],
        [("a", dt.datetime(2024, 1, 1, 23), 99.0, 6), ("a", dt.datetime(2024, 1, 9, 9), 21.0, 7)],  # too late
    ]
    for k, rows in enumerate(batches):
        frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        ticks = spark.readStream.schema(schema).parquet(f"{tmp_path}/ticks")
        bars_ = daily_bars(ticks, F.col("asset"), F.col("ts"), F.col("price"), [F.col("n")])
        got = {(r["date"].day, r["asset"]): (r["open"], r["high"], r["close"], r["amount"]) for r in run_to_end(bars_, f"{tmp_path}/out").collect()}
    assert got == {(1, "a"): (9.0, 12.0, 12.0, 3.0), (2, "b"): (5.0, 5.0, 5.0, 1.0), (9, "a"): (20.0, 21.0, 21.0, 2.0)}


def test_number_spans_are_those_of_the_scan(spark):
    texts = ["收入12.3亿元，(45.6)%，1,234万元 同比 下降3%同比", "", None, "￥ 5 - 7 万 and 1 2 3", "x" * 300 + " 1,000.5% YoY（2）", " ".join(f"{k}元" for k in range(900)), "１２%  qoq 3、000"]
    df = frame(spark, list(enumerate(texts)), "i int, s string").select("i", documents.number_spans(F.col("s")).alias("n"))
    for r in df.collect():
        assert [x.asDict() for x in r["n"]] == documents.numbers_in(texts[r["i"]] or ""), r["i"]


def test_universes_that_cannot_be_resolved(spark):
    from factorloom.sources import universe

    parts = frame(spark, [("000300.XSHG", DAY, "a"), ("000300.XSHG", DAY + dt.timedelta(days=9), "b")], "index_id string, date date, asset string")
    bonds = frame(spark, [("110001.XSHG",), ("110001.XSHG",)], "asset string")
    got = [r["asset"] for u, day in ((None, "2024-01-05"), ("全 A", "2025-01-01"), ("hs300", "2020-01-01")) for r in universe.members(spark, u, day, parts).collect()]
    assert got == ["a", "b", "b"] and universe.members(spark, "可转债池", "2024-01-01", None, bonds).count() == 1
    assert universe.members(spark, "300750.sz", "2024-01-01").first()["asset"] == "300750.XSHE"
    for bad in ("nikkei", [], ["  "], "csi500", "cb"):
        with pytest.raises(PanelError):
            universe.members(spark, bad, "2024-01-01", parts)
    assert universe.field_names(["市盈率", "x"]) == ["pe_ttm", "x"]


def test_price_cache_covers_what_is_asked(spark, tmp_path):
    reads = []

    def read(codes, first, last):
        reads.append((codes, first.day if first.year > 1 else None, last.day if last.year < 9999 else None))
        rows = [(DAY + dt.timedelta(days=d), c, float(d)) for d in range(9) for c in codes]
        return frame(spark, [r for r in rows if first <= r[0] <= last], "trade_date date, ts_code string, close double")

    def ask(assets, *days):
        return panel.cached(spark, str(tmp_path), assets, read, *(d and f"2024-01-{d:02}" for d in days))

    assert ask(["b", "a", "a"], 2, 3).count() == 4 and ask(["a", "b"], 1, 9).count() == 18
    assert reads == [(["a", "b"], 2, 3), (["a", "b"], 1, 1), (["a", "b"], 4, 9)]
    assert ask(["a", "b"], 3, 5).count() == 6 and len(reads) == 3
    assert ask(["a"]).count() == 9 and ask(["a"], 8).count() == 2 and reads[3:] == [(["a"], None, None), (["a"], 10, None)]  # later days may have come since
    assert ask(["c"], 20, 25).count() == 0 and ask(["c"], 20, 25).count() == 0 and len(reads) == 6
    (tmp_path / "x").mkdir()
    assert ask(["a", "b"], 1, 9).select("date", "asset").distinct().count() == 18


def test_missing_days():
    d = [DAY + dt.timedelta(days=k) for k in range(10)]
    assert panel.missing_days([], d[0], d[9]) == [(d[0], d[9])] and panel.missing_days([(d[0], d[9])], d[2], d[5]) == []
    assert panel.missing_days([(d[6], d[7]), (d[2], d[3]), (d[3], d[4])], d[1], d[9]) == [(d[1], d[1]), (d[5], d[5]), (d[8], d[9])]
    assert panel.missing_days([(panel.FIRST_DAY, d[3])], panel.FIRST_DAY, panel.LAST_DAY) == [(d[4], panel.LAST_DAY)]


def test_report_files_that_share_a_path(spark, tmp_path):
    from factorloom.sources import reports

    files = frame(spark, [("f/a.md", "1"), ("f/a.md", "2"), ("f/a.md", "2"), ("b", "x"), ("b", "y"), ("c.d/e", "z")], "path string, text string")
    assert reports.write_files(files, str(tmp_path / "out")) == 6
    assert sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith((".", "_"))) == ["b", "b-2", "c.d/e", "f/a-2.md", "f/a-3.md", "f/a.md"]
    assert sorted((tmp_path / "out/f" / n).read_text().strip() for n in ("a.md", "a-2.md", "a-3.md")) == ["1", "2", "2"]
    with pytest.raises(PanelError):
        reports.write_files(files.unionByName(frame(spark, [("b-2", "taken")], "path string, text string")), str(tmp_path / "no"))
    reports.write_table(files, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).select("path").distinct().count() == 6
    entry = spark.range(1).select(*(F.lit(None).cast("string").alias(c) for c in ("name", "name_cn", "style", "version", "status", "universe", "rebalance_frequency", "formula", "dedup_hash")), F.lit(None).cast("timestamp").alias("created_at"), *(F.lit(None).cast("array<string>").alias(c) for c in ("input_fields", "tags")))
    page = reports.wiki_pages(entry).first()
    assert page["path"] == "factors/factor.md" and page["text"].startswith("#  ()\n\n- **风格**: \n") and "- **去重哈希**: ``\n- **创建时间**: \n" in page["text"]
    assert reports.index_lines(entry).first()["place"] == 1


def test_report_files(spark, tmp_path):
    from factorloom.sources import reports

    stats = frame(spark, [("b<1>", 0.1, 1.0, 0.2, None, 0.5), ("a", 0.0, 0.0, 0.0, 0.0, 0.0)], "name string, ic double, icir double, ann_return double, max_drawdown double, win_rate double")
    files = reports.overview_file(stats).unionByName(frame(spark, [("factors/x.md", "line 1\n\nline 3\n")], "path string, text string"))
    assert reports.write_files(files, str(tmp_path)) == reports.write_files(files, str(tmp_path)) == 2
    page = (tmp_path / "dashboard.html").read_text()
    assert "<th>b&lt;1&gt;</th><td>0.1000</td>" in page and page.index("<th>a</th>") < page.index("b&lt;1") and (tmp_path / "factors/x.md").read_text().rstrip("\n") == "line 1\n\nline 3"
    names = frame(spark, [("E/P  x",), (" ..",), (None,), ("n" * 200,)], "s string").select(reports.file_name(F.col("s"))).collect()
    assert [r[0] for r in names] == ["E_P_x", "factor", "factor", "n" * 120]


def boxes(spark, doc, rows, height=10.0):
    """Words of one page: rows of (x, text), each word 8 wide."""
    return [(doc, 1, float(x), height * y, x + 8.0, height * y + 8, t) for y, row in enumerate(rows) for x, t in row]


def test_tables_from_words(spark):
    from factorloom.operators import word_tables

    prose = [[(0, "one"), (30, "two"), (60, "three")]] * 4
    numbers = [[(0, "Chart"), (30, "5")]] + [[(0, f"a{k}"), (30, "1"), (60, "2")] for k in range(4)] + [[(0, "alone")]] + [[(0, "x"), (30, "3"), (60, "4")]] * 2
    empty_end = [[(0, "h"), (30, "i"), (60, "9")], [(0, "1"), (30, "2")], [(0, "3"), (30, "4"), (60, "5")]]
    captions = [[(0, "a"), (60, "b")], [(30, "c"), (60, "d")]] + [[(0, "7"), (30, "8"), (60, "9")]] * 2
    odd = [(9, 1, None, 0.0, 1.0, 1.0, "null box"), (9, 1, 0.0, 0.0, 1.0, 1.0, None), (9, 1, 0.0, 0.0, 1.0, 1.0, "  "), (None, None, 0.0, 0.0, 1.0, 1.0, "no page")]
    rows = [*boxes(spark, 1, prose), *boxes(spark, 2, prose[:1]), *boxes(spark, 3, numbers), *boxes(spark, 4, empty_end), *boxes(spark, 5, captions), *odd]
    words = frame(spark, rows, "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double, text string")
    found = {(r["doc_id"], r["table_no"]): r for r in word_tables.tables(words).collect()}
    assert set(found) == {(3, 0), (3, 1), (4, 0), (5, 0)}
    assert found[3, 0]["table"] == "| a0 | 1 | 2 |\n| --- | --- | --- |\n" + "\n".join(f"| a{k} | 1 | 2 |" for k in (1, 2, 3))
    assert found[3, 1]["table"].count("\n") == 2 and found[3, 0]["y1"] < found[3, 1]["y0"] and (found[3, 0]["x0"], found[3, 0]["x1"]) == (0.0, 68.0)
    assert found[4, 0]["table"].split("\n")[2] == "| 1 | 2 |  |" and found[5, 0]["table"] == "| 7 | 8 | 9 |\n| --- | --- | --- |\n| 7 | 8 | 9 |"
    assert word_tables.tables(words.limit(0)).count() == 0


def test_rows_begin_beyond_the_tolerance_of_their_first_word(spark):
    """Middles drift by three points a word: a row holds what is within four points of its first word, not of the one before."""
    from factorloom.operators import word_tables

    words = frame(spark, [(1, 1, 10.0 * (7 - k), 3.0 * k, 10.0 * (7 - k) + 5, 3.0 * k + 8, str(k)) for k in range(8)] + [(1, 1, 200.0, 0.0, 205.0, 8.0, "tie")] * 2, "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double, text string")
    rows = [[w["text"] for w in r["words"]] for r in word_tables.rows_of(words).orderBy("row_no").collect()]
    assert rows == [["1", "0", "tie", "tie"], ["3", "2"], ["5", "4"], ["7", "6"]]


def test_formula_blocks(spark):
    rows = [
        (1, 1, 0, "text", "Text before.\nES = a + b*c (1)\nText after."), (1, 1, 1, "text", "VaR = x - y + ES"), (1, 1, 2, "formula", "f_3"), (1, 1, 3, "table", "| a |"), (1, 1, 4, "text", None), (1, 1, 5, "text", "  "),
        (1, 2, 0, "text", "ES = a + b*c (1)"), (1, 2, 1, "text", "VaR = x - y"), (1, 2, 2, "text", "ES = d*e + f (1)"), (1, 2, 3, "text", "VaR = x + y\nES = d*e + f (2)"), (1, 2, 4, "text", "(7)"), (1, 2, 5, "text", "VaR = x - y"), (1, 2, 6, "text", "ES = q + r (4)"),
        (1, 3, 0, "text", " ES = Xi + wi \n\n  中文 item"),
    ]
    blocks = frame(spark, [(*r, float(k), float(k), k + 9.0, k + 9.0, 0.5) for k, r in enumerate(rows)], "doc_id int, page_num int, block_no int, type string, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    got = documents.merged_formulas(documents.promoted_formulas(blocks)).orderBy("page_num", "block_no", "piece").collect()
    assert [(r["type"], r["text"], r["eq_number"], r["n_blocks"]) for r in got if r["page_num"] == 1] == [
        ("text", "Text before.", None, 1), ("formula", "ES = a + b*c (1)", "1", 1), ("text", "Text after.", None, 1), ("formula", r"VaR = x - y + ES \\ f_3", None, 2), ("table", "| a |", None, 1), ("text", "", None, 1), ("text", "  ", None, 1),
    ]
    assert [(r["type"], r["text"], r["eq_number"]) for r in got if r["page_num"] == 2] == [
        ("formula", r"ES = a + b*c (1) \\ VaR = x - y \\ ES = d*e + f (1)", "1"), ("formula", r"VaR = x + y ES = d*e + f (2)", "2"), ("text", "(7)", None), ("formula", "VaR = x - y", None), ("formula", "ES = q + r (4)", "4"),
    ]
    assert [(r["y0"], r["y1"]) for r in got if r["n_blocks"] == 3] == [(6.0, 17.0)]
    assert [(r["type"], r["text"]) for r in got if r["page_num"] == 3][0] == ("formula", " ES = X_i + w_i") and got[-1]["text"].strip().endswith("• 中文 item")
    assert documents.merged_formulas(documents.promoted_formulas(blocks.limit(0))).count() == 0


def test_keyed_table(spark, tmp_path):
    from factorloom.sources.store import KeyedTable, page_results

    schema = "id string, x int, at int"
    table = KeyedTable(spark, str(tmp_path / "t"), "id", buckets=4)
    with pytest.raises(PanelError):
        table.read()
    assert table.upsert(frame(spark, [("a", 1, 1), ("b", 1, 1), (None, 1, 1), ("a", 2, 0)], schema), "one", "at")
    before = table.read()
    assert not table.upsert(frame(spark, [("a", 9, 9)], schema), "one", "at")
    touched = set(table.manifest()["folders"].values())
    assert table.upsert(frame(spark, [(None, 5, 5), ("c", 5, 5)], schema), "two", "at") and table.upsert(frame(spark, [], schema), "nothing")
    assert sorted((r["id"] or "", r["x"]) for r in table.read().collect()) == [("", 5), ("a", 1), ("b", 1), ("c", 5)]
    assert sorted((r["id"] or "", r["x"]) for r in before.collect()) == [("", 1), ("a", 1), ("b", 1)]  # as of then
    assert touched & set(table.manifest()["folders"].values())  # the other buckets were not rewritten
    with pytest.raises(PanelError):
        table.upsert(frame(spark, [("a", 1)], "id string, y int"), "odd")

    # a job that dies before its manifest changes nothing, and may be run again
    publish, table._publish = table._publish, lambda manifest: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        table.upsert(frame(spark, [("a", 7, 7)], schema), "three", "at")
    assert table.read().count() == 4 and "three" not in table.manifest()["batches"]
    table._publish = publish
    assert table.upsert(frame(spark, [("a", 7, 7)], schema), "three", "at") and table.read().where("id = 'a'").first()["x"] == 7
    stale = table.manifest()
    with pytest.raises(PanelError):
        table._publish(stale)  # a second job with the same number
    assert table.vacuum() > 3 and table.vacuum() == 0 and table.read().count() == 4

    seen = []

    def process(contents):
        seen.append(sorted(r["text"] or "" for r in contents.collect()))
        return contents.select("content_key", F.length(F.coalesce("text", F.lit(""))).alias("n"))

    pages = frame(spark, [(k, f"page {k % 20}") for k in range(25)] + [(99, None), (98, "")], "page int, text string")
    results = KeyedTable(spark, str(tmp_path / "p"), "content_key", buckets=4)
    assert page_results(pages, results, process, "one").count() == 27
    changed = pages.where("page < 20").withColumn("text", F.when(F.col("page") < 10, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    again = page_results(changed, results, process, "two").collect()
    assert len(seen[0]) == 21 and seen[1] == sorted(f"page {k}!" for k in range(10)) and len(again) == 20 and {r["n"] for r in again if r["page"] < 10} == {7}
    page_results(pages, results, process, "other", settings="v2")
    assert len(seen[2]) == 21


def test_redundancy_against_pandas(spark):
    """More factors than a block has, gaps, a constant, large means, and factors that are known by their own name."""
    import pandas as pd

    r = np.random.default_rng(4)
    base = r.normal(size=(5, 60))
    new = {f"n{k:03}": base[k % 5] * (1 + k) + r.normal(size=60) * (k % 7) + 1e6 * (k % 2) for k in range(300)} | {"flat": np.full(60, 3.5), "k1": base[1]}
    known = {f"k{k}": base[k] for k in range(5)} | {"k9": np.full(60, 0.1), "few": base[2]}
    gaps = {name: r.random(60) < 0.1 for name in (*new, *known)}
    gaps["few"][:] = True
    gaps["few"][:5] = False

    def rows(columns):
        return [(n, DAY + dt.timedelta(days=i // 6), f"a{i % 6}", None if gaps[n][i] else float(x[i])) for n, x in columns.items() for i in range(60)]

    schema = "factor string, date date, asset string, factor_value double"
    got = {r["factor"]: r for r in catalog.redundancy(frame(spark, rows(new), schema), frame(spark, rows(known), schema)).collect()}
    table = pd.DataFrame({**{("new", n): np.where(gaps[n], np.nan, x) for n, x in new.items()}, **{("known", n): np.where(gaps[n], np.nan, x) for n, x in known.items()}})
    for name in new:
        each = {k: abs(table["new", name].corr(table["known", k], min_periods=10)) for k in known if k != name and k != "k9"}
        each = {k: c for k, c in each.items() if c == c}
        if name == "flat":
            assert name not in got
            continue
        best = max(each, key=each.get)
        assert got[name]["correlation"] == pytest.approx(each[best], abs=1e-6) and (got[name]["known_factor"] == best or each[got[name]["known_factor"]] == pytest.approx(each[best], abs=1e-6))
        assert got[name]["n"] == (~gaps[name] & ~gaps[got[name]["known_factor"]]).sum() and got[name]["redundant"] == (got[name]["correlation"] > 0.7)
    assert got["k1"]["known_factor"] != "k1" and catalog.redundancy(frame(spark, [], schema), frame(spark, rows(known), schema)).count() == 0


def test_run_flags(spark):
    from factorloom.plans.run import run

    rows = [(DAY + dt.timedelta(days=d), f"{a:06}", 10.0 + a + (d * (a + 1)) % 3 / 10, 100.0 if (d, a) != (4, 1) else 0.0) for d in range(30) for a in range(12)]
    prices = frame(spark, rows, "date date, asset string, close double, volume double")
    result, flags = run(prices, "$close ÷ Delay($close, 2) - 1", "csi300")
    assert flags.formula == "close / Ref(close, 2) - 1" and flags.clean and flags.formula_rewritten
    assert (flags.rows_before, flags.dropped["suspended"], flags.dropped["no_previous_close"]) == (360, 1, 12) and flags.rows_after == 360 - sum(flags.dropped.values())
    assert result.count() == 1 and result.first()["n_nonfinite"] == 0
    _, odd = run(prices, "因子 = 动量", "nikkei", ("momentum",))
    assert odd.formula_proxy and odd.formula_fallback and odd.universe_fallback and "nikkei" in odd.universe_fallback_reason and not odd.clean
    _, lacking = run(prices, "Mean(roe, 5)", None)
    assert lacking.formula_fallback and "return_on_equity" in lacking.formula_fallback_reason


def test_brackets_and_specs(spark):
    from factorloom.operators import review

    def brute(text):
        stack = []
        for c in text or "":
            if c in "([{":
                stack.append(c)
            elif c in ")]}":
                if not stack or "([{".index(stack.pop()) != ")]}".index(c):
                    return "mismatched brackets"
        return "unclosed brackets" if stack else None

    r = np.random.default_rng(6)
    texts = [None, "", "(a[b]{c})", "([)]", "((", "a)b("] + ["".join(r.choice(list("([{)]}ab"), size=r.integers(1, 9))) for _ in range(300)]
    got = frame(spark, list(enumerate(texts)), "i int, s string").select("i", review.bracket_warning(F.col("s")).alias("w")).orderBy("i").collect()
    assert [x["w"] for x in got] == [brute(t) for t in texts]
    schema = "factor_name string, formula string, description string, extraction_confidence double, input_fields array<struct<name:string,report_name:string>>, mappings array<struct<report_term:string,canonical_term:string,confidence:double>>"
    nulls, own = (review.validated_specs(frame(spark, [row], schema)).first() for row in ((None,) * 6, ("f", "close", "d", 0.9, [(None, None), (" YTM", None), ("c", "债底")], [])))
    assert nulls["problem"] == "no factor name" and nulls["mappings"] == [] and nulls["description"] == "\n[WARN] Low extraction confidence."
    assert [(m["canonical_term"], m["tag"]) for m in own["mappings"]] == [(None, "WARN"), ("ytm", "OK"), ("bond_value", "OK")] and own["problem"] is None and own["description"] == "d"
