"""Review of reproduced factors: deviations from claimed metrics, health, root causes, scores, decay, gates. Row-wise columns.

A row holds the reproduced metrics ``ic_mean, ic_ir, long_short_annual_return, sharpe_ratio, max_drawdown, turnover`` and the claimed
ones under the same names with ``claimed_`` in front, null where nothing is claimed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee

#: Metrics that are compared, in order.
COMPARED = ("ic_mean", "ic_ir", "long_short_annual_return", "sharpe_ratio", "max_drawdown")
CORE = (*COMPARED, "turnover")


@dataclass(frozen=True)
class Tolerances:
    ic_mean: float = 0.03
    ic_ir: float = 0.2
    long_short_relative: float = 0.15
    long_short_absolute: float = 5.0
    sharpe_ratio: float = 0.3
    max_drawdown: float = 0.05


def usable_values(factor: DataFrame, least_rows: int = 10, least_deviation: float = 1e-12) -> DataFrame:
    """One row ``usable``: enough values, and they vary."""
    deviation = F.stddev_samp("factor_value")
    varies = F.coalesce(ieee.finite(deviation) & (F.abs(deviation) >= least_deviation), F.lit(False))
    return factor.agg(((F.count("factor_value") >= least_rows) & varies).alias("usable"))


def not_degenerate(groups: Column | None = None, tiny: float = 1e-15) -> Column:
    """All core metrics finite, not all zero, and an IC or groups."""
    sound = F.lit(True)
    some = F.lit(False)
    for name in CORE:
        sound = sound & F.coalesce(ieee.finite(F.col(name)), F.lit(False))
        some = some | (F.abs(name) > tiny)
    has_groups = F.lit(False) if groups is None else F.coalesce(F.size(groups) > 0, F.lit(False))
    return sound & F.coalesce(some & ((F.abs("ic_mean") > tiny) | has_groups), F.lit(False))


def deltas() -> dict[str, Column]:
    """Reproduced less claimed, null where nothing is claimed."""
    return {name: F.col(name) - F.col(f"claimed_{name}") for name in COMPARED}


def _within(name: str, t: Tolerances) -> Column:
    size, claim = F.abs(f"delta_{name}"), F.abs(f"claimed_{name}")
    if name != "long_short_annual_return":
        return size <= getattr(t, name)
    relative = size / F.when(claim > 0, claim) <= t.long_short_relative
    return F.when((claim > 0) & F.lit(t.long_short_relative > 0), relative).otherwise(size <= t.long_short_absolute)


def compared(rows: DataFrame, healthy: Column, t: Tolerances = Tolerances()) -> DataFrame:
    """``rows`` with ``delta_*``, ``n_claimed``, ``healthy`` and ``passed``: all claims within tolerance and healthy."""
    out = rows.withColumns({f"delta_{n}": c for n, c in deltas().items()}).withColumn("healthy", healthy)
    fine = F.lit(True)
    claimed = F.lit(0)
    for name in COMPARED:
        fine = fine & F.coalesce(_within(name, t), F.lit(True))
        claimed = claimed + F.when(F.col(f"delta_{name}").isNotNull(), 1).otherwise(0)
    return out.withColumns({"n_claimed": claimed, "passed": fine & F.col("healthy")})


def deviation_score(t: Tolerances = Tolerances()) -> Column:
    """Root of the squared deltas over their tolerances; 0 if passed, 1 if there are none."""
    scale = {"ic_mean": t.ic_mean, "ic_ir": t.ic_ir, "long_short_annual_return": t.long_short_relative or 5.0, "sharpe_ratio": t.sharpe_ratio, "max_drawdown": t.max_drawdown}
    total = sum((F.coalesce(F.pow(F.col(f"delta_{n}") / F.lit(s), F.lit(2.0)), F.lit(0.0)) for n, s in scale.items()), F.lit(0.0))
    return F.when(F.col("passed"), 0.0).when(F.col("n_claimed") == 0, 1.0).otherwise(F.sqrt(total))


def _delta(name: str) -> Column:
    return F.col(f"delta_{name}")


def root_cause() -> Column:
    """The first rule that fits the deltas: ``lookahead_bias, data_mismatch, parameter_error, formula_error, universe_mismatch``, else ``unknown``."""
    ic, ir, sharpe, ls = (_delta(n) for n in ("ic_mean", "ic_ir", "sharpe_ratio", "long_short_annual_return"))
    every = F.array_compact(F.array(*[_delta(n) for n in COMPARED]))
    moved = F.filter(every, lambda v: F.abs(v) > 0.01)
    one_way = (F.size(moved) >= 3) & (F.forall(moved, lambda v: v > 0) | F.forall(moved, lambda v: v <= 0))
    others = F.array_compact(F.array(*[_delta(n) for n in ("long_short_annual_return", "sharpe_ratio", "max_drawdown")]))
    rules = [
        ("lookahead_bias", (F.abs(ic) > 0.05) & (F.abs(ir) > 0.3) & (ic * ir > 0)),
        ("data_mismatch", one_way),
        ("parameter_error", (F.abs(ic) <= 0.03) & (F.coalesce(F.abs(sharpe) > 0.3, F.lit(False)) | F.coalesce(F.abs(ls) > 5.0, F.lit(False)))),
        ("formula_error", (F.abs(ic) > 0.03) & F.exists(others, lambda v: F.abs(v) <= 0.05)),
        ("universe_mismatch", (F.abs(ic) > 0.02) & (F.abs(sharpe) > 0.2) & (ic * sharpe > 0)),
    ]
    out = F.lit("unknown")
    for cause, fits in reversed(rules):
        out = F.when(fits, cause).otherwise(out)
    return out


def significant() -> Column:
    """Whether the deltas' sizes stand out: their mean over its error is above 2; of one, or equal ones, above 0.02."""
    sizes = F.transform(F.array_compact(F.array(*[_delta(n) for n in COMPARED])), lambda v: F.abs(v))
    n = F.size(sizes)
    mean = F.aggregate(sizes, F.lit(0.0), lambda a, v: a + v) / F.when(n > 0, n)
    spread = F.sqrt(F.aggregate(sizes, F.lit(0.0), lambda a, v: a + F.pow(v - mean, F.lit(2.0))) / F.when(n > 0, n))
    t = mean / F.when(spread >= 1e-10, spread / F.sqrt(n.cast("double")))
    return F.when(n == 0, False).when((n < 2) | (spread < 1e-10), mean > 0.02).otherwise(t > 2.0)


def should_reflect(iteration: Column, most: int = 3, status: Column | None = None) -> Column:
    """Not passed, still in progress, and rounds left."""
    in_progress = F.lit(True) if status is None else status == "in_progress"
    return ~F.col("passed") & in_progress & (iteration < most)


def _clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def quality_score(dsr: Column, pbo: Column) -> Column:
    """0 to 100 from IC, Sharpe and drawdown, and from dsr and pbo where they are known; one decimal."""
    score = 50 + _clamped(F.col("ic_mean") * 200, -20, 20) + _clamped(F.col("sharpe_ratio") * 10, -15, 20) - _clamped(F.abs("max_drawdown") * 30, 0, 15)
    score = score + F.coalesce(F.when(dsr.isNotNull(), _clamped((dsr - 0.5) * 20, -10, 15)), F.lit(0.0)) - F.coalesce(F.when(pbo.isNotNull(), _clamped(pbo * 25, 0, 20)), F.lit(0.0))
    return _clamped(score, 0, 100)


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").otherwise("D")


def decay(original: Column, current: Column) -> tuple[Column, Column]:
    """Drop ratio of the IC (-1 at least, where it improved) and status ``stable, decaying, deprecated``; an original that was not
    positive does not decay."""
    drop = F.when(original > 0, F.greatest((original - current) / F.when(original > 0, original), F.lit(-1.0))).when(current > 0, -1.0).otherwise(0.0)
    return drop, F.when(drop > 0.5, "deprecated").when(drop > 0.3, "decaying").otherwise("stable")


def elite(most: float = 0.015) -> Column:
    """Passed, with the IC's delta small if there is one."""
    return F.col("passed") & F.coalesce(F.abs(_delta("ic_mean")) <= most, F.lit(True))


def confidence_reasons(confidence: Column, warned: Column, mapped: Column, description: Column, formula: Column, least: float = 0.5, most_warned: float = 0.5) -> Column:
    """Array of reasons against an automatic run; empty if there is none."""
    return F.array_compact(F.array(
        F.when(F.coalesce(confidence, F.lit(0.0)) < least, "low_confidence"),
        F.when((mapped > 0) & (warned / F.when(mapped > 0, mapped) > most_warned), "warned_mappings"),
        F.when(F.coalesce(description.contains("[WARN]"), F.lit(False)), "marked_warning"),
        F.when(F.trim(F.coalesce(formula, F.lit(""))) == "", "empty_formula"),
    ))


def overall_status(factors: DataFrame, by: str) -> DataFrame:
    """``by, status, n_factors``: of reports from their factors' statuses; without factors the status is null and becomes ``no_factors``."""
    good = F.col("status").isin("passed", "converged")
    n, n_good = F.count("status"), F.count_if(good)
    rest = F.min("status")
    status = F.when(n == 0, "no_factors").when(n == n_good, "passed").when(n_good > 0, "partial").when(F.max(F.col("status") == "review_enqueued"), "review_enqueued").otherwise(rest)
    return factors.groupBy(by).agg(status.alias("status"), n.alias("n_factors"))


def failure_mode(flags: dict[str, Column], status: Column, exit_code: Column) -> Column:
    """Why a run is no full success, by precedence; null for a full success. ``flags``: ``recovery, proxy, universe, soft, bad``."""
    clean = ~(flags["recovery"] | flags["proxy"] | flags["universe"] | flags["soft"] | flags["bad"])
    return (
        F.when((exit_code == 0) & (status == "passed") & clean, None).when(flags["recovery"], "recovery").when(flags["proxy"], "formula_proxy_or_fallback")
        .when(flags["universe"], "universe_fallback").when(flags["soft"], "soft_pass").when((status == "partial") | flags["bad"], "partial_or_factor_fail")
        .when(status.isin("no_factors", "review_enqueued"), status).when(exit_code != 0, "hard_fail").otherwise(F.concat(F.lit("other:"), status))
    )


def proposal(passed: Column, verdict: Column) -> Column:
    """``accept, reject, defer`` from an evaluation and a review's verdict."""
    return F.when(passed & (verdict == "approve"), "accept").when(verdict == "reject", "reject").otherwise("defer")


# ---- extracted specifications ---------------------------------------------------------------------------------------

#: Terms of reports and the fields they mean; confidence from which a mapping is trusted, and an extraction.
DATA_DICTIONARY = {
    "收盘价": "close", "开盘价": "open", "最高价": "high", "最低价": "low", "成交量": "volume", "成交额": "amount", "换手率": "turnover_rate", "市盈率": "pe_ttm", "市净率": "pb", "收益率": "returns",
    "到期收益率": "ytm", "YTM": "ytm", "ytm": "ytm", "债性": "ytm", "平价溢价率": "premium_rate", "转股溢价率": "premium_rate", "溢价率": "premium_rate", "债底": "bond_value", "纯债价值": "bond_value",
    "隐含波动率": "implied_vol", "隐波": "implied_vol", "期权价值": "option_value", "剩余规模": "remaining_size", "转股价": "conversion_price", "绝对价格": "close", "转债价格": "close",
}
SURE_MAPPING, SURE_EXTRACTION = 0.8, 0.5
BRACKETS = {"(": ")", "[": "]", "{": "}"}
MAPPINGS = "array<struct<report_term:string,canonical_term:string,confidence:double>>"


def bracket_warning(formula: Column) -> Column:
    """What is wrong with a text's brackets, or null: one closes what is not open, or some stay open. A fold over its brackets with those that are due."""
    due = F.create_map(*[F.lit(x) for pair in BRACKETS.items() for x in pair])
    start = F.struct(F.lit("").alias("due"), F.lit(False).alias("wrong"))

    def step(s: Column, c: Column) -> Column:
        opens = c.isin(*BRACKETS)
        fits = F.substring(s["due"], 1, 1) == c
        after = F.when(opens, F.concat(F.element_at(due, c), s["due"])).when(fits, F.substring(s["due"], F.lit(2), F.length(s["due"]))).otherwise(s["due"])
        return F.struct(F.when(s["wrong"], s["due"]).otherwise(after).alias("due"), (s["wrong"] | (~opens & ~fits)).alias("wrong"))

    signs = F.regexp_extract_all(F.coalesce(formula, F.lit("")), F.lit(r"[()\[\]{}]"), F.lit(0))
    said = F.aggregate(signs, start, step)
    return F.when(said["wrong"], "mismatched brackets").when(said["due"] != "", "unclosed brackets")


def validated_specs(specs: DataFrame) -> DataFrame:
    """``specs`` (factor_name, formula, description, extraction_confidence, ``input_fields`` of (name, report_name), ``mappings`` of (report_term, canonical_term, confidence))
    with each mapping's ``tag`` (OK, WARN) and ``note``, warnings at the description's end, and ``problem``, null unless the name or formula is missing.

    Without mappings the input fields are mapped by the data dictionary: by the report's term, else by the field's own name if it is a field; other
    fields stand for themselves with half confidence. Null arrays and texts count as empty.
    """
    terms = F.create_map(*[F.lit(x) for pair in DATA_DICTIONARY.items() for x in pair])
    fields = sorted(set(DATA_DICTIONARY.values()))

    def tagged(m: Column, note: Column) -> Column:
        tag = F.when(m["confidence"] >= SURE_MAPPING, "OK").otherwise("WARN")
        return F.struct(m["report_term"].alias("report_term"), m["canonical_term"].alias("canonical_term"), m["confidence"].alias("confidence"), tag.alias("tag"), note.alias("note"))

    def mapped(f: Column) -> Column:
        own, meant = F.lower(F.trim(F.coalesce(f["name"], F.lit("")))), F.element_at(terms, F.coalesce(f["report_name"], F.lit("")))
        known = F.coalesce(meant, F.when(own.isin(*fields), own))
        term = F.when(F.coalesce(f["report_name"], F.lit("")) != "", f["report_name"]).otherwise(f["name"])
        one = F.struct(term.alias("report_term"), F.coalesce(known, f["name"]).alias("canonical_term"), F.when(known.isNotNull(), 1.0).otherwise(0.5).alias("confidence"))
        return tagged(one, F.when(known.isNotNull(), "Auto-mapped").otherwise("Fallback mapping"))

    given = F.coalesce("mappings", F.array().cast(MAPPINGS))
    by_field = F.coalesce(F.transform("input_fields", mapped), F.array().cast(MAPPINGS.replace("double", "double,tag:string,note:string")))
    warnings = F.array_compact(F.array(
        F.concat(F.lit("[WARN] Formula has "), bracket_warning(F.col("formula")), F.lit(".")),
        F.when(F.coalesce("extraction_confidence", F.lit(0.0)) < SURE_EXTRACTION, "[WARN] Low extraction confidence."),
    ))
    description = F.concat_ws("\n", F.coalesce("description", F.lit("")), warnings)
    problem = F.when(F.coalesce("factor_name", F.lit("")) == "", "no factor name").when(F.coalesce("formula", F.lit("")) == "", "no formula")
    mappings = F.when(F.size(given) > 0, F.transform(given, lambda m: tagged(m, F.lit(None).cast("string")))).otherwise(by_field)
    return specs.withColumns({"problem": problem, "description": description, "mappings": mappings})
