"""Operators of the factor language.

An operator takes its arguments as Python numbers or ``Value``s and returns a number or a ``Value``. Numbers fold in
Python; what folds to a number where the language has a rule for constants is stated with the operator. Operators that
need a window ask the compiler to place their result as a column (``cx.place``), so that equal sub-expressions are computed
once and operators with one partitioning share a sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import FormulaError
from ..functions import frames, ieee

#: Window length where a column stands for it.
DEFAULT_WINDOW = 20
#: Rows from which a rolling extreme goes by blocks.
LONG_WINDOW = 64
#: What weights of an exponential average fall to within a block of rows, and how many blocks before a row's own still count.
BLOCK_DECAY, CARRIED = 1e-6, 3


@dataclass(frozen=True)
class Value:
    """A column at a level: 0 reads the panel, each window operator adds one. ``key`` names the expression, ``truth`` tells that it is
    boolean; as a number it is 1 or 0."""

    column: Column
    level: int
    key: str
    truth: bool = False


REGISTRY: dict[str, Callable[..., Any]] = {}


def operator(*names: str, least: int = 1, most: int | None = None):
    """Register under ``names`` an operator with ``least`` to ``most`` arguments."""

    def add(f: Callable[..., Any]) -> Callable[..., Any]:
        for name in names:

            def checked(cx, *args: Any, name: str = name) -> Any:
                if not least <= len(args) <= (most if most is not None else least):
                    raise FormulaError(f"{name} takes {least} to {most or least} arguments, not {len(args)}")
                return f(cx, *args)

            REGISTRY[name] = checked
        return f

    return add


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float))


def as_value(x: Any) -> Value:
    return x if isinstance(x, Value) else Value(F.lit(float(x)), 0, repr(float(x)))


def window_length(n: Any, name: str, least: int | None = 1) -> int:
    """A window argument: truncated to an integer; a column stands for the default."""
    if isinstance(n, Value):
        return DEFAULT_WINDOW
    try:
        n = int(float(n))
    except (TypeError, ValueError) as e:
        raise FormulaError(f"{name}: no window length: {n!r}") from e
    if least is not None and n < least:
        raise FormulaError(f"{name}: window length {n} is below {least}")
    return n


#: Row-wise functions with boolean results, and those that take booleans as such.
TRUTHS = frozenset(("gt", "lt", "ge", "le", "eq", "ne", "and", "or", "not"))
TAKE_TRUTHS = frozenset(("and", "or", "not", "if", "present"))


def combine(name: str, f: Callable[..., Column], *args: Any) -> Value:
    """Apply a row-wise function."""
    values = [as_value(a) for a in args]
    if name == "if" and values[1].truth != values[2].truth or name not in TAKE_TRUTHS:
        values = values[: name == "if"] + [replace(v, column=v.column.cast("double")) if v.truth else v for v in values[name == "if" :]]
    truth = name in TRUTHS or (name == "if" and values[1].truth and values[2].truth)
    return Value(f(*[v.column for v in values]), max(v.level for v in values), f"{name}({','.join(v.key for v in values)})", truth)


# ---- row-wise -------------------------------------------------------------------------------------------------------


def _numbers_or(name: str, fold: Callable[..., Any], f: Callable[..., Column]):
    def op(cx, *args: Any) -> Any:
        if all(is_number(a) for a in args):
            try:
                return fold(*args)
            except (ArithmeticError, ValueError) as e:
                raise FormulaError(f"{name} of constants {args}: {e}") from e
        return combine(name, f, *args)

    return op


add = _numbers_or("add", lambda a, b: a + b, lambda a, b: a + b)
subtract = _numbers_or("sub", lambda a, b: a - b, lambda a, b: a - b)
multiply = _numbers_or("mul", lambda a, b: a * b, lambda a, b: a * b)
divide = _numbers_or("div", lambda a, b: a / b, ieee.div)
raise_to = _numbers_or("pow", lambda a, b: float(a) ** b, ieee.power)
negate = _numbers_or("neg", lambda a: -a, lambda a: -a)

operator("Add", "Plus", least=2)(add)
operator("Sub", "Minus", "Subtract", least=2)(subtract)
operator("Mul", "Mult", "Multiply", least=2)(multiply)
operator("Div", "Divide", "Divi", least=2)(divide)
operator("Neg", "Negate")(negate)


@operator("Abs")
def absolute(cx, x):
    return combine("abs", F.abs, x)


@operator("Log")
def log(cx, x):
    return combine("log", ieee.ln, x)


@operator("Sqrt")
def square_root(cx, x):
    return combine("sqrt", lambda c: F.sqrt(c.cast("double")), x)


@operator("Exp")
def exponential(cx, x):
    return combine("exp", lambda c: F.exp(c.cast("double")), x)


@operator("Sign")
def sign(cx, x):
    return combine("sign", lambda c: F.signum(c.cast("double")), x)


@operator("Ceil")
def ceiling(cx, x):
    return combine("ceil", lambda c: F.ceil(c).cast("double"), x)


@operator("Floor")
def floor(cx, x):
    return combine("floor", lambda c: F.floor(c).cast("double"), x)


@operator("Sin")
def sine(cx, x):
    return combine("sin", F.sin, x)


@operator("Cos")
def cosine(cx, x):
    return combine("cos", F.cos, x)


@operator("Tan")
def tangent(cx, x):
    return combine("tan", F.tan, x)


@operator("Round", most=2)
def rounded(cx, x, digits=0):
    return combine(f"round{int(digits)}", lambda c: F.round(c.cast("double"), int(digits)), x)


@operator("Inv")
def inverse(cx, x):
    if is_number(x):
        return 1.0 / x if x else math.inf
    return combine("div", ieee.div, 1.0, x)


@operator("Pow", "Power", most=2)
def integer_power(cx, x, n=2):
    """The exponent is truncated to an integer; ``**`` is not."""
    return raise_to(cx, x, float(window_length(n, "Pow", None)))


@operator("Max", most=2)
def larger(cx, a, b=0.0):
    """Row-wise, not rolling; of one argument and 0. Nulls are passed over."""
    return combine("max", F.greatest, a, b)


@operator("Min", most=2)
def smaller(cx, a, b=0.0):
    return combine("min", F.least, a, b)


@operator("Const")
def constant(cx, x):
    return x


@operator("If", least=3)
def choose(cx, condition, a, b):
    """A null condition counts as false."""
    return combine("if", lambda c, x, y: F.when(c.cast("boolean"), x).otherwise(y), condition, a, b)


@operator("Greater", least=2)
def greater(cx, a, b):
    return combine("gt", lambda x, y: x > y, a, b)


@operator("Less", least=2)
def less(cx, a, b):
    return combine("lt", lambda x, y: x < y, a, b)


@operator("GreaterEqual", least=2)
def at_least(cx, a, b):
    return combine("ge", lambda x, y: x >= y, a, b)


@operator("LessEqual", least=2)
def at_most(cx, a, b):
    return combine("le", lambda x, y: x <= y, a, b)


@operator("Equal", least=2)
def equal(cx, a, b):
    return combine("eq", lambda x, y: x == y, a, b)


@operator("NotEqual", least=2)
def not_equal(cx, a, b):
    return combine("ne", lambda x, y: x != y, a, b)


def _boolean(c: Column) -> Column:
    return c.cast("boolean")


@operator("And", most=99)
def all_of(cx, first, *others):
    for x in others:
        first = combine("and", lambda a, b: _boolean(a) & _boolean(b), first, x)
    return first


@operator("Or", most=99)
def any_of(cx, first, *others):
    for x in others:
        first = combine("or", lambda a, b: _boolean(a) | _boolean(b), first, x)
    return first


@operator("Not")
def negation(cx, x):
    return combine("not", lambda c: ~_boolean(c), x)


@operator("Clip", least=3)
def clip(cx, x, low, high):
    return combine("clip", lambda c, lo, hi: F.when(c.isNotNull(), F.greatest(F.least(c, hi), lo)), x, low, high)


@operator("Count", least=0, most=1)
def present(cx, x=None):
    """1.0 where x is present, else 0.0, row by row; without argument 1.0."""
    return 1.0 if x is None else combine("present", lambda c: c.isNotNull().cast("double"), x)


# ---- cross-sections -------------------------------------------------------------------------------------------------


@operator("Rank", "CSRank", "Percentile", most=2)
def rank(cx, x, n=None):
    """Average rank over the number present on the date, in (0, 1]; a constant ranks 0.5."""
    if is_number(x):
        return 0.5
    return cx.place("rank", x, lambda c: frames.average_rank(c, "date") / F.count(c).over(frames.cross_section()))


@operator("CSZScore", most=2)
def z_score(cx, x, n=None):
    if is_number(x):
        return 0.0
    w = frames.cross_section()

    def f(c: Column) -> Column:
        deviation = F.stddev_samp(c).over(w)
        return (c - F.avg(c).over(w)) / F.when(deviation == 0, 1.0).otherwise(deviation)

    return cx.place("zscore", x, f)


@operator("GroupNeutral")
def less_mean(cx, x):
    return 0.0 if is_number(x) else cx.place("neutral", x, lambda c: c - F.avg(c).over(frames.cross_section()))


@operator("Scale", most=2)
def scale(cx, x, a=1.0):
    """x times int(a) over the date's sum of absolutes."""
    if is_number(x):
        return float(x)
    times = window_length(a, "Scale", None)
    return cx.place(f"scale{times}", x, lambda c: ieee.div(c * times, F.sum(F.abs(c)).over(frames.cross_section())))


@operator("Winsorize", most=2)
def winsorize(cx, x, share=0.05):
    """Clip to the date's quantiles ``share`` and 1 - ``share``, taken as the nearest present value (halves round up)."""
    if is_number(x):
        return float(x)
    w = frames.cross_section()
    order = cx.place("order", x, lambda c: F.when(c.isNotNull(), F.row_number().over(Window.partitionBy("date").orderBy(c.asc_nulls_last()))))
    n = cx.place("present", x, lambda c: F.count(c).over(w))

    def clipped(c: Column, place: Column, n: Column) -> Column:
        def quantile(p: float) -> Column:
            return F.max(F.when(place == F.floor((n - 1) * F.lit(p) + 0.5) + 1, c)).over(w)

        low, high = quantile(share), quantile(1 - share)
        return F.when(c < low, low).when(c > high, high).otherwise(c)

    return cx.place_all(f"winsorize{share!r}", clipped, x, order, n)


# ---- histories ------------------------------------------------------------------------------------------------------


def _rolling(cx, name: str, f: Callable[[Column], Column], x: Any, n: Any) -> Any:
    n = window_length(n, name)
    return cx.place(f"{name}{n}", x, lambda c: frames.once_full(f(c).over(frames.last_rows(n)), n, c))


def _two_ways(name: str, constant: Callable[[float], float], f: Callable[[Column], Column]):
    """With a window rolling, without one the date's aggregate."""

    def op(cx, x, n=None):
        if is_number(x):
            return constant(float(x))
        if n is None:
            return cx.place(f"{name}.date", x, lambda c: f(c).over(frames.cross_section()))
        return _rolling(cx, name, f, x, n)

    return op


operator("Mean", most=2)(_two_ways("mean", lambda c: c, F.avg))
operator("Std", most=2)(_two_ways("std", lambda c: 0.0, F.stddev_samp))
operator("Var", most=2)(_two_ways("var", lambda c: 0.0, F.var_samp))


@operator("Sum", most=2)
def total(cx, x, n=None):
    if is_number(x):
        return float(x) * (1 if n is None else window_length(n, "Sum", None))
    return _two_ways("sum", float, F.sum)(cx, x, n)


@operator("Ref", least=2)
def shifted(cx, x, n):
    if is_number(x):
        return float(x)
    n = window_length(n, "Ref", None)
    return cx.place(f"ref{n}", x, lambda c: F.lag(c, n).over(frames.history()))


@operator("Delta", least=2)
def change(cx, x, n):
    return 0.0 if is_number(x) else subtract(cx, x, shifted(cx, x, n))


def _of_history(name: str, constant: float | None, f: Callable[[Column], Column]):
    def op(cx, x, n):
        if is_number(x):
            return float(x) if constant is None else constant
        return _rolling(cx, name, f, x, n)

    return op


operator("Median", least=2)(_of_history("median", None, lambda c: F.percentile(c, F.lit(0.5))))
operator("Skew", least=2)(_of_history("skew", math.nan, F.skewness))
operator("Kurt", least=2)(_of_history("kurt", math.nan, F.kurtosis))
def _extreme(name: str, constant: float | None, frame: Callable[[Column, int], Column], best: Callable[[Column], Column], item: Callable[[Column, Column], Column], found: Callable[[Column, Column, Column], Column]):
    """A rolling extreme. Short windows are read row by row (``frame``). From ``LONG_WINDOW`` rows on, histories are cut into blocks as long as the window: the last n rows
    are the end of one block and the beginning of the next, so an extreme is the better of two running ones, whatever n. ``item``: what is compared, of
    value and row number, NaN above all; ``found``: the result from the best item, the value and the row number."""

    def op(cx, x, n):
        if is_number(x):
            return float(x) if constant is None else constant
        n = window_length(n, name)
        if n < LONG_WINDOW:
            return cx.place(f"{name}{n}", x, lambda c: frames.once_full(frame(c, n), n, c))
        row = cx.place("row", x, lambda c: F.row_number().over(frames.history()) - 1)
        within = Window.partitionBy("asset", F.floor(row.column / n))

        def up_to(order: Column):
            return lambda c, r: best(F.when(c.isNotNull(), item(c, r))).over(within.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

        head = cx.place_all(f"{name}{n}.head", up_to(F.col("date").asc()), x, row)
        tail = cx.place_all(f"{name}{n}.tail", up_to(F.col("date").desc()), x, row)
        present = cx.place("running_count", x, lambda c: F.count(c).over(frames.history().rowsBetween(Window.unboundedPreceding, 0)))
        before = cx.place_all(f"{name}{n}.before", lambda t: F.lag(t, n - 1).over(frames.history()), tail)
        earlier = cx.place_all(f"{name}{n}.present", lambda p: F.lag(p, n, 0).over(frames.history()), present)

        def better(c: Column, r: Column, h: Column, b: Column, p: Column, e: Column) -> Column:
            either = F.array(h, b)  # both hold a value where all n rows do
            top = F.array_max(either) if best is F.max else F.array_min(either)
            return F.when((p - e >= n) & (r >= n - 1), found(top, c, r))

        return cx.place_all(f"{name}{n}", better, x, row, head, before, present, earlier)

    return op


def _just(c: Column, _: Column) -> Column:
    return c.cast("double")


operator("Ts_Max", least=2)(_extreme("tsmax", None, lambda c, n: F.max(c).over(frames.last_rows(n)), F.max, _just, lambda top, c, r: top))
operator("Ts_Min", least=2)(_extreme("tsmin", None, lambda c, n: F.min(c).over(frames.last_rows(n)), F.min, _just, lambda top, c, r: top))


@operator("Ts_Percentile", least=2, most=3)
def rolling_percentile(cx, x, n, p=50):
    if is_number(x):
        return float(x)
    p = window_length(p, "Ts_Percentile", 0)
    return _rolling(cx, f"pct{p}.", lambda c: F.percentile(c, F.lit(p / 100)), x, n)


@operator("Mad", least=2)
def rolling_mad(cx, x, n):
    """Rolling median of each day's distance from that day's rolling median."""
    if is_number(x):
        return 0.0
    median = REGISTRY["Median"]
    return median(cx, absolute(cx, subtract(cx, x, median(cx, x, n))), n)


@operator("EMA", least=2)
def exponential_average(cx, x, n):
    """Weights (1 - alpha)^age with alpha = 2 / (n + 1), normalised by the weights present; null where x is null.

    A decay scan in two levels, at a constant cost for each row whatever n. Blocks hold as many rows as let weights fall to ``BLOCK_DECAY``; within
    one, sums are scaled so that one running sum serves all its rows. What the ``CARRIED`` blocks before hold is carried from
    block end to block end; weights below BLOCK_DECAY^CARRIED count for nothing.
    """
    if is_number(x):
        return float(x)
    n = window_length(n, "EMA")
    keep = 1 - 2 / (n + 1)
    if keep <= 0:
        return x
    rows = math.ceil(math.log(BLOCK_DECAY) / math.log(keep))
    name = f"ema{n}"

    def local(c: Column, r: Column) -> Column:
        within = Window.partitionBy("asset", F.floor(r / rows)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        scale = F.pow(F.lit(keep), r % rows)
        value, weight = F.when(c.isNotNull(), c.cast("double") / scale), F.when(c.isNotNull(), 1 / scale)
        return F.struct(*((F.coalesce(F.sum(v).over(within), F.lit(0.0)) * scale).alias(k) for k, v in (("value", value), ("weight", weight))))

    def with_carry(p: Column, carry: Column, decay: Column) -> Column:
        return F.struct(*((p[k] + F.coalesce(carry[k], F.lit(0.0)) * decay).alias(k) for k in ("value", "weight")))

    def at_last_end(r: Column, p: Column) -> Column:
        before = frames.history().rowsBetween(Window.unboundedPreceding, -1)
        return F.last(F.when(r % rows == rows - 1, p), ignorenulls=True).over(before)

    r = cx.place("row", x, lambda c: F.row_number().over(frames.history()) - 1)
    part = cx.place_all(f"{name}.part", local, x, r)
    carry = cx.place_all(f"{name}.carry", at_last_end, r, part)
    for k in range(1, CARRIED):
        carry = cx.place_all(f"{name}.carry{k}", lambda r, p, c: at_last_end(r, with_carry(p, c, F.lit(keep**rows))), r, part, carry)

    def f(c: Column, r: Column, p: Column, carried: Column) -> Column:
        whole = with_carry(p, carried, F.pow(F.lit(keep), r % rows + 1))
        return F.when(c.isNotNull(), whole["value"] / whole["weight"])

    return cx.place_all(name, f, x, r, part, carry)


@operator("WMA", least=2)
def weighted_average(cx, x, n):
    """Weights 1 to n, the newest row the heaviest."""
    if is_number(x):
        return float(x)
    n = window_length(n, "WMA")

    def f(c: Column) -> Column:
        seen = F.collect_list(c).over(frames.last_rows(n))
        weighted = F.aggregate(F.transform(seen, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
        return frames.once_full(weighted / (n * (n + 1) / 2), n, c)

    return cx.place(f"wma{n}", x, f)


def _of_list(name: str, constant: float, f: Callable[[Column, Column, int], Column]):
    def op(cx, x, n):
        if is_number(x):
            return constant
        n = window_length(n, name)

        def over_rows(c: Column) -> Column:
            return frames.once_full(f(F.collect_list(c).over(frames.last_rows(n)), c, n).cast("double"), n, c)

        return cx.place(f"{name}{n}", x, over_rows)

    return op


#: Share of the last n rows not above the current one: the ordinal rank of the newest among equals.
operator("Ts_Rank", least=2)(_of_list("tsrank", 0.5, lambda seen, c, n: F.size(F.filter(seen, lambda v: v <= c)) / n))
#: Rows since the extreme, its first occurrence.
def _since(seen_best: Callable[[Column], Column]) -> Callable[[Column, int], Column]:
    def rows(c: Column, n: int) -> Column:
        seen = F.collect_list(c.cast("double")).over(frames.last_rows(n))
        return (n - F.array_position(seen, seen_best(seen))).cast("double")

    return rows


operator("Ts_ArgMax", least=2)(_extreme("argmax", 0.0, _since(F.array_max), F.max, lambda c, r: F.struct(c.cast("double").alias("x"), (-r).alias("r")), lambda top, c, r: (r + top["r"]).cast("double")))
operator("Ts_ArgMin", least=2)(_extreme("argmin", 0.0, _since(F.array_min), F.min, lambda c, r: F.struct(c.cast("double").alias("x"), r.alias("r")), lambda top, c, r: (r - top["r"]).cast("double")))


@operator("Corr", "Correlation", least=3)
def rolling_correlation(cx, x, y, n):
    n = window_length(n, "Corr")
    return cx.place_all(f"corr{n}", lambda a, b: frames.once_full(ieee.pearson(a, b, frames.last_rows(n)), n, a, b), x, y)


@operator("Cov", least=3)
def rolling_covariance(cx, x, y, n):
    n = window_length(n, "Cov")
    return cx.place_all(f"cov{n}", lambda a, b: frames.once_full(F.covar_samp(a, b).over(frames.last_rows(n)), n, a, b), x, y)
