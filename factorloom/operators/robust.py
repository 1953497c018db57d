"""Statistical checks of a backtest: deflated Sharpe, overfitting probability, minimum length, bootstrap, walk-forward, regimes,
placebo.

Random procedures take a seed and give the same numbers again, whatever the partitioning: a replicate's draws depend on the
seed and its own number alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PanelError
from ..functions import frames, ieee
from ..session import staged
from . import metrics

DAYS = 252

# Coefficients of a public rational approximation of the normal quantile (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def _horner(coefficients: tuple[float, ...], x: float) -> float:
    value = 0.0
    for c in coefficients:
        value = value * x + c
    return value


def normal_quantile(p: float) -> float:
    if not 0 < p < 1:
        return -math.inf if p <= 0 else math.inf
    tail = min(p, 1 - p)
    if tail < 0.02425:
        q = math.sqrt(-2 * math.log(tail))
        z = _horner(_C, q) / _horner((*_D, 1.0), q)
        return z if p < 0.5 else -z
    q = p - 0.5
    return q * _horner(_A, q * q) / _horner((*_B, 1.0), q * q)


def normal_cdf_column(z: Column) -> Column:
    """The normal distribution function as a column, to a fractional error of the tail below 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    # Coefficients of a public approximation of erfc, highest power first.
    poly = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = t * F.exp(-x * x + poly) / 2
    return F.when(z > 0, 1 - tail).otherwise(tail)


def deflated_sharpe(sharpe: float, trials: int, observations: int, deviation: float | None = None, skew: float = 0.0, kurtosis: float = 3.0) -> dict:
    """Probability that the Sharpe ratio beats the best expected of ``trials`` chance ones: ``dsr, psr, p_value, deflated``."""
    if deviation is None:
        deviation = math.sqrt((1 + sharpe**2 / 2 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2) / (observations - 1))
    if deviation == 0:
        return {"dsr": 0.0, "psr": 0.0, "p_value": 1.0, "deflated": False}
    z = sharpe / deviation
    chance = math.sqrt(2 * math.log(trials)) if trials > 1 else 0.0
    dsr = normal_cdf(z - chance)
    return {"dsr": dsr, "psr": normal_cdf(z), "p_value": 1 - dsr, "deflated": dsr < 0.05}


def deflated_sharpe_columns(sharpe: Column, trials: Column, observations: Column, skew: float = 0.0, kurtosis: float = 3.0) -> Column:
    """The same for many backtests: a struct ``dsr, psr, p_value, deflated``."""
    deviation = F.sqrt((1 + sharpe * sharpe / 2 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (observations - 1))
    z = sharpe / deviation
    dsr = normal_cdf_column(z - F.when(trials > 1, F.sqrt(2 * F.log(trials))).otherwise(0.0))
    return F.struct(dsr.alias("dsr"), normal_cdf_column(z).alias("psr"), (1 - dsr).alias("p_value"), (dsr < 0.05).alias("deflated"))


def min_backtest_column(sharpe: Column, variance: float = 0.04, alpha: float = 0.05) -> Column:
    """Observations needed for each Sharpe ratio to be significant; 10**9 for none above 0."""
    z = normal_quantile(1 - alpha / 2)
    return F.when(sharpe > 0, F.ceil(variance * z**2 / (sharpe * sharpe / DAYS))).otherwise(10**9)


def min_backtest_length(sharpe: float, variance: float = 0.04, alpha: float = 0.05, actual: int = 0, mirrored_tail: bool = False) -> dict:
    """Observations needed for a Sharpe ratio to be significant: ``min_obs, actual_obs, sufficient``.

    ``mirrored_tail``: use the upper-tail quantile of a known faulty formula (about 2 % low) to reproduce its published numbers.
    """
    if sharpe <= 0:
        needed = 10**9
    else:
        p = 1 - alpha / 2
        z = normal_quantile(p)
        if mirrored_tail and p > 1 - 0.02425:
            q = math.sqrt(-2 * math.log(p))
            z = -_horner(_C, q) / _horner((*_D, 1.0), q)
        needed = math.ceil(variance * z**2 / (sharpe**2 / DAYS))
    return {"min_obs": needed, "actual_obs": actual, "sufficient": actual >= needed}


def inversions(ranks: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """One row ``inversions``: pairs that two rankings from 0 to below ``n``, without ties, order otherwise. By the bits of y: two rows are an inversion
    at the highest bit in which their y differ, if the one with that bit set has the lower x; so no pairs are formed."""
    bits = F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 1).bit_length() - 1))).alias("bit")
    rows = ranks.select(x, F.col(y).cast("long").alias(y), bits)
    set_ = F.expr(f"shiftright({y}, bit) & 1")
    earlier = Window.partitionBy("bit", "above").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(x, "bit", F.expr(f"shiftright({y}, bit + 1)").alias("above"), set_.alias("is_set"))
    counted = rows.select(F.when(F.col("is_set") == 0, F.sum("is_set").over(earlier)).alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inversions"))


#: Combinations of segments beyond which their table, which every task gets, is refused.
MOST_COMBINATIONS = 50_000


def overfitting_probability(returns: DataFrame, column: str = "ls_return", splits: int = 5, oos_share: float = 0.3) -> DataFrame:
    """One row ``pbo, n_combinations, overfit``: (1 - tau) / 2 of in-sample and out-of-sample Sharpe ranks over all choices of half
    the segments; out of sample counts the last ``oos_share`` of each segment left.

    All combinations are one grouped job: sums by segment come first, so a combination touches 2 * splits numbers.
    """
    spark = returns.sparkSession
    if math.comb(splits, max(splits // 2, 1)) > MOST_COMBINATIONS:
        raise PanelError(f"{splits} splits have more than {MOST_COMBINATIONS} combinations")
    chosen = list(combinations(range(splits), max(splits // 2, 1)))
    numbered = returns.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("r"), (F.row_number().over(Window.orderBy("date")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    size = F.floor(F.col("n") / splits)
    segment = F.least(F.floor(F.col("i") / F.when(size > 0, size)), F.lit(splits - 1))
    end = F.when(F.col("segment") == splits - 1, F.col("n")).otherwise((F.col("segment") + 1) * size)
    rows = numbered.where(F.col("n") >= 2 * splits).withColumn("segment", segment).withColumn("late", F.col("i") >= F.floor(end - size * F.lit(oos_share)))

    def sums(when: Column, name: str) -> list[Column]:
        r = F.when(when, F.col("r"))
        return [F.count(r).alias(f"{name}_n"), F.coalesce(F.sum(r), F.lit(0.0)).alias(f"{name}_s"), F.coalesce(F.sum(r * r), F.lit(0.0)).alias(f"{name}_q")]

    parts = rows.groupBy("segment").agg(*sums(F.lit(True), "all"), *sums(F.col("late"), "late"))
    members = spark.createDataFrame([(k, s, s in c) for k, c in enumerate(chosen) for s in range(splits)], "combination int, segment long, inside boolean")
    met = parts.join(F.broadcast(members), "segment")

    def ratio(name: str, inside: Column) -> Column:
        def total(x: str) -> Column:
            return F.sum(F.when(inside, F.col(f"{name}_{x}")))

        n, s, q = total("n"), total("s"), total("q")
        variance = (q - s * s / n) / F.when(n > 1, n - 1)
        return F.when(variance > 1e-30, s / n / F.sqrt(F.when(variance > 1e-30, variance)) * math.sqrt(DAYS)).otherwise(0.0)

    each = met.groupBy("combination").agg(ratio("all", F.col("inside")).alias("is_sharpe"), ratio("late", ~F.col("inside")).alias("oos_sharpe"))
    each = each.select(*[(F.row_number().over(Window.orderBy(F.round(f"{n}_sharpe", 12), "combination")) - 1).alias(n) for n in ("is", "oos")])
    n = F.count(F.lit(1))
    found = each.agg(n.alias("found")).crossJoin(F.broadcast(inversions(each, "is", "oos", len(chosen))))
    found = found.withColumn("tau", 1 - 4 * F.col("inversions") / F.when(F.col("found") > 1, F.col("found") * (F.col("found") - 1)))
    pbo = F.when(F.col("found") >= 2, (1 - F.col("tau")) / 2).otherwise(0.0)
    return found.select(pbo.alias("pbo"), F.lit(len(chosen)).alias("n_combinations"), F.coalesce(pbo > 0.5, F.lit(False)).alias("overfit"))


def drawn(*parts: Column | str | int) -> Column:
    """A number from 0 to below 2^32 that ``parts`` alone decide: the first eight hexadecimal digits of their MD5."""
    text = F.concat_ws("|", *(F.lit(x) if isinstance(x, int) else F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bootstrap_sharpe(returns: DataFrame, column: str = "ls_return", replicates: int = 2000, alpha: float = 0.05, seed: int = 42, none_is_zero: bool = True) -> DataFrame:
    """One row ``sharpe_ci_lower, sharpe_ci_upper, n_boot, n_dropped, significant``. Draw k of a replicate is the row whose number a digest of
    ``(seed, replicate, k)`` names, so draws need no generator and no order; they are joined to the numbered series, one row a date, and
    summed by replicate. Returns that are not finite have no place in a mean; they are dropped and counted. Without two rows every Sharpe ratio is 0;
    with ``none_is_zero=False`` a series without finite returns has no replicates (``n_boot`` 0) and null bounds instead."""
    spark = returns.sparkSession
    value = F.col(column).cast("double")
    series = returns.where(value.isNotNull()).select("date", value.alias("r"))
    finite = series.where(ieee.finite(F.col("r"))).select("r", (F.row_number().over(Window.orderBy("date", "r")) - 1).cast("long").alias("i"))
    counts = series.agg(F.count_if(ieee.finite(F.col("r"))).alias("n"), F.count_if(~ieee.finite(F.col("r"))).alias("n_dropped"))
    every = spark.range(replicates).select(F.col("id").alias("replicate")).crossJoin(F.broadcast(counts))
    draws = every.where("n > 0").select("replicate", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select("replicate", (drawn(seed, "replicate", "k") % F.col("n")).alias("i"))
    deviation = F.stddev_samp("r")
    drawn_sharpe = draws.join(finite, "i").groupBy("replicate").agg(F.when(deviation > 0, F.avg("r") / F.when(deviation > 0, deviation) * math.sqrt(DAYS)).otherwise(0.0).alias("sharpe"))
    each = every.join(drawn_sharpe, "replicate", "left").select(F.coalesce("sharpe", F.lit(0.0)).alias("sharpe"), "n", "n_dropped")
    bounds = each.agg(
        F.percentile("sharpe", F.lit(alpha / 2)).alias("sharpe_ci_lower"), F.percentile("sharpe", F.lit(1 - alpha / 2)).alias("sharpe_ci_upper"), F.count(F.lit(1)).alias("n_boot"),
        F.max("n_dropped").alias("n_dropped"), F.max("n").alias("n"),
    )
    if not none_is_zero:
        some = F.col("n") > 0
        bounds = bounds.withColumns({"n_boot": F.when(some, F.col("n_boot")).otherwise(0), **{c: F.when(some, F.col(c)) for c in ("sharpe_ci_lower", "sharpe_ci_upper")}})
    bounds = bounds.drop("n")
    return bounds.withColumn("significant", F.col("sharpe_ci_lower") > 0)


def walk_forward(factor: DataFrame, returns: DataFrame, splits: int = 5, rolling: bool = False) -> DataFrame:
    """One row: mean and deviation of the splits' in-sample and out-of-sample mean IC, their ratio and whether it is stable.

    Daily IC is computed once. In-sample is all dates before a split's, or with ``rolling`` the one split before.
    """
    joined = factor.join(returns, ["date", "asset"]).where("factor_value IS NOT NULL AND forward_return IS NOT NULL")
    ic = metrics.spearman_by(joined, "factor_value", "forward_return", "date")
    days = joined.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    k = F.when(F.col("n") < 2 * splits, F.greatest(F.floor(F.col("n") / 2), F.lit(2))).otherwise(splits)
    days = days.withColumn("k", k).withColumn("part", F.floor(F.col("i") / F.greatest(F.floor(F.col("n") / F.col("k")), F.lit(1))))
    daily = days.where(F.col("part") < F.col("k")).join(ic, "date", "left")
    sums = daily.groupBy("part").agg(F.sum("ic").alias("s"), F.count("ic").alias("c"), F.max("k").alias("k"))
    before = Window.orderBy("part").rowsBetween(-1 if rolling else Window.unboundedPreceding, -1)
    n_before = F.sum("c").over(before)
    each = sums.select("k", "part", (F.sum("s").over(before) / F.when(n_before > 0, n_before)).alias("is_ic"), (F.col("s") / F.when(F.col("c") > 0, F.col("c"))).alias("oos_ic")).where("part > 0")

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    found = each.agg(*[zero(f(c)).alias(f"ic_{c[:-3]}_{n}") for c in ("is_ic", "oos_ic") for n, f in (("mean", F.avg), ("std", F.stddev_pop))], F.coalesce(F.max("k"), F.lit(splits)).cast("int").alias("n_splits"))
    usable = (F.col("ic_is_mean") != 0) & (F.col("ic_oos_mean") != 0)
    found = found.withColumn("ic_decay", F.when(usable, F.col("ic_oos_mean") / F.when(usable, F.col("ic_is_mean"))).otherwise(1.0))
    return found.withColumn("stable", (F.col("ic_decay") > 0.5) & (F.col("ic_oos_mean") > 0))


def regime_stress(df: DataFrame, returns: str = "forward_return", reference: str | None = None) -> DataFrame:
    """``regime, n_rows, ic, worst, consistent`` of bull, bear and sideways rows: above, below and within two deviations of the mean of
    ``reference`` (else of the returns). A regime without rows has IC 0."""
    ref = reference or returns
    spread = F.coalesce(F.col("std"), F.lit(0.0))
    bounds = df.agg(F.avg(ref).alias("mean"), F.stddev_samp(ref).alias("std")).select("mean", F.when(spread == 0, 0.01).otherwise(spread).alias("spread"))
    high, low = F.col("mean") + 2 * F.col("spread"), F.col("mean") - 2 * F.col("spread")
    labelled = df.crossJoin(F.broadcast(bounds)).withColumn("regime", F.when(F.col(ref) > high, "bull").when(F.col(ref) < low, "bear").when(F.col(ref).isNotNull(), "sideways")).where("regime IS NOT NULL")
    counts = labelled.groupBy("regime").agg(F.count(F.lit(1)).alias("n_rows"))
    ics = metrics.spearman_by(labelled, "factor_value", returns, "regime", "date").groupBy("regime").agg(F.avg("ic").alias("ic"))
    every = df.sparkSession.createDataFrame([("bear", 1), ("bull", 0), ("sideways", 2)], "regime string, place int")
    out = every.join(counts, "regime", "left").join(ics, "regime", "left").select("regime", "place", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("ic", F.lit(0.0)).alias("ic"))
    all_three = Window.partitionBy()
    worst = F.min(F.struct("ic", "place")).over(all_three)["place"] == F.col("place")
    one_sign = (F.min("ic").over(all_three) > 0) | (F.max("ic").over(all_three) < 0)
    return out.select("regime", "n_rows", "ic", worst.alias("worst"), one_sign.alias("consistent"))


def grid(n: int) -> tuple[int, int]:
    """Sides (a, b) of the grid that holds 0 to n - 1 with the fewest spare cells, neither side much longer than the other."""
    root = math.isqrt(n)
    a = min(range(max(2, root // 2), 2 * root + 3), key=lambda a: (a * -(-n // a) - n, a))
    return a, -(-n // a)


#: A prime below 2^31: squares of what is below it fit a long. Rounds of a bijection, each with two keys.
PRIME, ROUNDS = 2_147_483_647, 4


def round_keys(*key: int) -> list[int]:
    """The keys of each round, from a digest of ``key`` and the round's number."""
    digests = [hashlib.md5("|".join(map(str, (*key, k))).encode()).hexdigest() for k in range(ROUNDS)]
    return [int(d[at : at + 8], 16) % PRIME for d in digests for at in (0, 8)]


def permuted(df: DataFrame, place: str, n: int, keys: str) -> DataFrame:
    """``df`` with ``place`` moved by a bijection of 0 to n - 1 that its row's ``keys`` (an array of ``round_keys``) decide, so that nothing is sorted and any task can compute its own rows.

    Rows and columns of a grid are shifted in turns, each by a mixture of the other with two keys, which can be undone, so no two places
    meet; a place that comes out in a spare cell is moved on until it is in range. All is integer arithmetic over Arrow batches: as columns, the
    optimizer would repeat the rounds within each other.
    """
    a, b = grid(n)

    def moved(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        sides = [x // b, x % b]
        for r in range(ROUNDS):
            own, size = r % 2, (a, b)[r % 2]
            t = (sides[1 - own] + k[:, 2 * r]) % PRIME
            t = (t * t % PRIME + k[:, 2 * r + 1]) % PRIME
            sides[own] = (sides[own] + t * t % PRIME) % size
        return sides[0] * b + sides[1]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(keys).flatten().to_numpy().reshape(-1, 2 * ROUNDS)
            x = moved(batch.column(place).to_numpy().astype(np.int64), k)
            while len(spare := np.flatnonzero(x >= n)):
                x[spare] = moved(x[spare], k[spare])
            yield pa.RecordBatch.from_arrays([pa.array(x) if name == place else batch.column(name) for name in batch.schema.names], batch.schema.names)

    return df.withColumn(place, F.col(place).cast("long")).mapInArrow(each, df.withColumn(place, F.col(place).cast("long")).schema)


def placebo(factor: DataFrame, returns: DataFrame, shuffles: int = 100, seed: int = 42) -> DataFrame:
    """One row ``true_ic, placebo_mean, placebo_std, p_value, n_shuffles, significant``: the mean IC against that of shuffled factors.

    Rows are numbered once, by date and asset; a replicate gives each row the value of the row that a keyed bijection names, a permutation over all
    rows. Ranks of the returns within dates are the same in every replicate, so they are formed once too. Replicates are groups of one job.
    """
    rows = factor.join(returns, ["date", "asset"]).where("factor_value IS NOT NULL AND forward_return IS NOT NULL")
    spark, day = factor.sparkSession, Window.partitionBy("date")
    rows = rows.select("date", "factor_value", frames.average_rank(F.col("forward_return"), "date").alias("y"), F.row_number().over(day.orderBy("asset", "factor_value", "forward_return")).alias("k"))
    rows = staged(rows, "placebo")
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    before = days.select("date", F.coalesce(F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.join(F.broadcast(before), "date").select("date", "y", "factor_value", (F.col("before") + F.col("k") - 1).alias("place"))

    def mean_ic(paired: DataFrame, *by: str) -> DataFrame:
        ranked = paired.withColumn("x", frames.average_rank(F.col("factor_value"), *by, "date"))
        ic = ranked.groupBy(*by, "date").agg(ieee.pearson(F.col("x"), F.col("y")).alias("ic")).where(ieee.finite(F.col("ic")))
        return ic.groupBy(*by).agg(F.avg("ic").alias("ic"))

    true_ic = mean_ic(rows).agg(F.coalesce(F.max("ic"), F.lit(0.0)).alias("true_ic"))
    values = numbered.select("place", "factor_value")
    replicates = spark.createDataFrame([(k, round_keys(seed, k)) for k in range(1, shuffles + 1)], "rep int, keys array<long>")
    copies = numbered.select("date", "y", "place").crossJoin(F.broadcast(replicates))  # one short row a replicate
    paired = permuted(copies, "place", rows.count(), "keys").drop("keys").join(values, "place")
    chance = mean_ic(paired, "rep")
    found = chance.agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("placebo_mean"), F.coalesce(F.stddev_pop("ic"), F.lit(0.0)).alias("placebo_std")).crossJoin(F.broadcast(true_ic))
    z = F.abs(F.col("true_ic") - F.col("placebo_mean")) / F.when(F.col("placebo_std") > 0, F.col("placebo_std"))
    p = F.when(F.col("placebo_std") > 0, 2 * (1 - normal_cdf_column(z))).otherwise(1.0)
    return found.select("true_ic", "placebo_mean", "placebo_std", p.alias("p_value"), F.lit(shuffles).alias("n_shuffles"), (p < 0.05).alias("significant"))
