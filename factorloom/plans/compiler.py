"""Compile factor formulas to Spark columns.

Formula text is parsed by Python's own parser and lowered to column expressions. Every window operator becomes a named column
of a level, levels are added to the panel one after another, and equal sub-expressions, within a formula and across formulas
compiled together, share one column. So all windows by asset of a level share one exchange and sort, as do all by date.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FormulaError
from ..operators import language
from ..operators.language import REGISTRY, Value

#: Names of the formula language that stand for other columns of a panel.
FIELD_ALIASES = {
    "total_market_cap": "market_cap", "mkt_cap": "market_cap", "circ_mv": "market_cap", "float_mv": "market_cap",
    "turnover": "volume", "turnover_rate": "volume", "returns": "close", "ret": "close", "adj_close": "close", "vwap": "close",
    "pe": "pe_ratio", "pe_ttm": "pe_ratio", "pb": "pb_ratio", "roe": "return_on_equity", "roa": "return_on_asset",
}

_BINARY = {ast.Add: language.add, ast.Sub: language.subtract, ast.Mult: language.multiply, ast.Div: language.divide, ast.Pow: language.raise_to}


def parse(formula: str) -> ast.expr:
    """The formula's syntax tree; ``$field`` reads as ``field``."""
    try:
        return ast.parse(re.sub(r"\$(\w+)", r"\1", formula).strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise FormulaError(f"cannot read formula {formula!r}: {e}") from e


class Compiler:
    """Compiles formulas over one panel; formulas compiled by the same compiler share columns."""

    def __init__(self, columns: list[str]):
        self.columns = set(columns)
        self.levels: list[dict[str, Column]] = []
        self._placed: dict[str, Value] = {}

    # what operators call
    def place_all(self, name: str, f: Callable[..., Column], *args: Any) -> Value:
        """The column of a window operator over ``args``, one level above them."""
        values = [language.as_value(a) for a in args]
        values = [replace(v, column=v.column.cast("double")) if v.truth else v for v in values]
        key = f"{name}({','.join(v.key for v in values)})"
        if key not in self._placed:
            level = max(v.level for v in values)
            while len(self.levels) <= level:
                self.levels.append({})
            column = f"__w{len(self._placed)}"
            self.levels[level][column] = f(*[v.column for v in values])
            self._placed[key] = Value(F.col(column), level + 1, key)
        return self._placed[key]

    def place(self, name: str, x: Any, f: Callable[[Column], Column]) -> Value:
        return self.place_all(name, f, x)

    # lowering
    def compile(self, formula: str) -> Value:
        try:
            return language.as_value(self._lower(parse(formula)))
        except RecursionError as e:
            raise FormulaError("formula is nested too deeply") from e

    def _field(self, name: str) -> Value:
        column = FIELD_ALIASES.get(name, name)
        if column not in self.columns:
            raise FormulaError(f"the panel has no column {column!r}" + (f" (for {name!r})" if name != column else ""))
        return Value(F.col(column).cast("double") if column not in ("date", "asset") else F.col(column), 0, f"${column}")

    def _lower(self, node: ast.expr) -> Any:
        match node:
            case ast.Constant(value=bool() | int() | float() as x):
                return float(x)
            case ast.Name(id=name):
                return self._field(name)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](self, self._lower(a), self._lower(b))
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return self._lower(a)
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return language.negate(self, self._lower(a))
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return language.negation(self, self._lower(a))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=keywords):
                if keywords:
                    raise FormulaError(f"{name}: arguments have no names in formulas")
                if name not in REGISTRY:
                    raise FormulaError(f"unknown operator {name!r}")
                return REGISTRY[name](self, *[self._lower(a) for a in args])
        raise FormulaError(f"not part of the formula language: {ast.unparse(node)}")


def compute_many(panel: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """``panel``'s date and asset with one column for each formula, in one plan; nulls are kept."""
    compiler = Compiler(panel.columns)
    values = {name: compiler.compile(f) for name, f in formulas.items()}
    for level in compiler.levels:
        panel = panel.withColumns(level)
    return panel.select("date", "asset", *[v.column.cast("double").alias(n) for n, v in values.items()])


def compute(panel: DataFrame, formula: str) -> DataFrame:
    """``date, asset, factor_value`` where the value is not null (NaN stays)."""
    return compute_many(panel, {"factor_value": formula}).where(F.col("factor_value").isNotNull())


def compute_long(panel: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """``factor, date, asset, factor_value`` of many formulas, from one plan."""
    wide = compute_many(panel, formulas)
    pairs = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("factor_value")) for n in formulas])
    return wide.select("date", "asset", F.inline(pairs)).where(F.col("factor_value").isNotNull())


def compute_or_proxy(panel: DataFrame, formula: str, flags: dict[str, Any] | None = None, strict: bool = True) -> DataFrame:
    """``compute``; not ``strict``: a formula that cannot be compiled gives the close, and ``flags`` says so."""
    try:
        return compute(panel, formula)
    except FormulaError as e:
        if strict:
            raise
        if flags is not None:
            flags.update(formula_fallback=True, formula_fallback_reason=str(e))
        return panel.select("date", "asset", F.col("close").cast("double").alias("factor_value")).where("factor_value IS NOT NULL")
