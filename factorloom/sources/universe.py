"""Universes by name, code or list, resolved to tables of assets; report terms resolved to field names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PanelError
from .panel import asset_code

# Names of the pool of convertible bonds, of index pools, and parts of names that say an index.
BOND_POOLS = frozenset({"cb", "convertible", "convertible_bond", "convertible_bonds", "全转债", "转债", "可转债"})
INDEX_POOLS = {
    "all": "000300.XSHG", "csi300": "000300.XSHG", "hs300": "000300.XSHG", "沪深300": "000300.XSHG", "csi500": "000905.XSHG", "zz500": "000905.XSHG",
    "中证500": "000905.XSHG", "csi1000": "000852.XSHG", "中证1000": "000852.XSHG", "全a股": "000300.XSHG", "全a": "000300.XSHG", "a股": "000300.XSHG", "全市场": "000300.XSHG",
}
INDEX_PARTS = {"1000": "000852.XSHG", "500": "000905.XSHG", "300": "000300.XSHG", "全a": "000300.XSHG", "a股": "000300.XSHG"}
DEFAULT_UNIVERSE = "csi300"
# Fields of fundamentals by the terms of reports.
FIELDS = {
    "pe": "pe_ttm", "市盈率": "pe_ttm", "pe_ttm": "pe_ttm", "pb": "pb", "市净率": "pb", "ps": "ps_ttm", "市销率": "ps_ttm",
    "roe": "roe_ttm", "净资产收益率": "roe_ttm", "roe_ttm": "roe_ttm", "roa": "roa_ttm", "总资产收益率": "roa_ttm", "roa_ttm": "roa_ttm",
    "grossprofit_margin": "grossprofit_margin", "毛利率": "grossprofit_margin", "netprofit_margin": "netprofit_margin", "净利率": "netprofit_margin",
    "revenue_yoy": "revenue_yoy", "营收增速": "revenue_yoy", "profit_yoy": "profit_yoy", "净利润增速": "profit_yoy",
    "market_cap": "market_cap", "总市值": "market_cap", "float_market_cap": "float_market_cap", "流通市值": "float_market_cap",
    "turnover_rate": "turnover_rate", "换手率": "turnover_rate", "turnover": "turnover_rate",
    "debt_to_equity": "debt_to_equity", "资产负债率": "debt_to_equity", "current_ratio": "current_ratio", "流动比率": "current_ratio", "dividend_yield": "dividend_yield", "股息率": "dividend_yield",
    "ytm": "ytm", "YTM": "ytm", "到期收益率": "ytm", "债性": "ytm", "premium_rate": "premium_rate", "平价溢价率": "premium_rate", "转股溢价率": "premium_rate", "溢价率": "premium_rate",
    "bond_value": "bond_value", "债底": "bond_value", "纯债价值": "bond_value", "implied_vol": "implied_vol", "隐波": "implied_vol", "隐含波动率": "implied_vol",
    "option_value": "option_value", "期权价值": "option_value", "remaining_size": "remaining_size", "剩余规模": "remaining_size", "余额": "remaining_size",
    "conversion_price": "conversion_price", "转股价": "conversion_price",
    "$roe": "roe_ttm", "$pe": "pe_ttm", "$pb": "pb", "$market_cap": "market_cap", "$turnover_rate": "turnover_rate", "$ytm": "ytm", "$premium_rate": "premium_rate",
}


def field_names(terms: Iterable[str]) -> list[str]:
    """Field names of report terms; what is not known stays."""
    return [FIELDS.get(t, t) for t in terms]


def field_of(term: Column) -> Column:
    """The same as a column."""
    known = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, term), term)


def is_bond_pool(universe: str) -> bool:
    name = universe.strip().lower()
    return name in BOND_POOLS or "转债" in name


def index_of(universe: str) -> str | None:
    """The index that a pool's name stands for."""
    key = universe.lower().replace(" ", "").strip()
    return INDEX_POOLS.get(key) or next((index for part, index in INDEX_PARTS.items() if part in key), None)


def members(spark: SparkSession, universe: str | Iterable[str] | None, as_of: str, components: DataFrame | None = None, bonds: DataFrame | None = None) -> DataFrame:
    """A table of the distinct ``asset`` codes of a universe.

    A list or one code stands for itself. A pool of bonds is the table ``bonds`` (``asset``), an index pool its members in ``components`` (``index_id,
    date, asset``): those of the last date up to ``as_of``, else of the last there is. Nothing and blanks are the default pool; a name that is none of these, and a pool without
    members, are refused.
    """
    if universe is not None and not isinstance(universe, str):
        codes = sorted({u.strip() for u in universe if u.strip()})
        if not codes:
            raise PanelError("an empty list of assets")
        return spark.createDataFrame([(c,) for c in codes], "code string").select(asset_code(F.col("code")).alias("asset")).distinct()
    name = (universe or "").strip() or DEFAULT_UNIVERSE
    if is_bond_pool(name):
        found = bonds
    elif re.fullmatch(r"[0-9]{6}(\.[A-Za-z]+)?", name):
        return spark.createDataFrame([(name,)], "code string").select(asset_code(F.col("code")).alias("asset"))
    elif (index := index_of(name)) is not None:
        found = None
        if components is not None:
            rows = components.where(F.col("index_id") == index)
            day = F.to_date(F.lit(as_of))
            dates = rows.agg(F.max(F.when(F.col("date") <= day, F.col("date"))).alias("before"), F.max("date").alias("last"))  # one row
            found = rows.join(F.broadcast(dates.select(F.coalesce("before", "last").alias("date"))), "date", "left_semi")
    else:
        raise PanelError(f"unknown universe: {name}")
    if found is None or found.isEmpty():
        raise PanelError(f"no members of universe {name}")
    return found.select("asset").distinct()
