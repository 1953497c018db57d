"""Reading price panels: column names, dates, universes, fundamentals, checks.

A panel has one row for each ``(date, asset)``, with ``open, high, low, close, volume, amount`` and whatever else its source has.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PanelError

#: Column names of sources, by the panel's name for them.
COLUMN_NAMES = {
    "date": ("trade_date", "datetime", "trading_date"),
    "asset": ("ts_code", "instrument", "order_book_id", "stock_code", "code"),
    "volume": ("vol",),
    "amount": ("total_turnover",),
}
REQUIRED = ("date", "asset", "open", "high", "low", "close", "volume")
#: Named pools, which keep every asset of their source.
POOLS = {
    "csi300": "000300.XSHG", "hs300": "000300.XSHG", "沪深300": "000300.XSHG", "csi500": "000905.XSHG", "zz500": "000905.XSHG", "中证500": "000905.XSHG",
    "csi1000": "000852.XSHG", "中证1000": "000852.XSHG", "all": None, "全a股": None, "全转债": None, "cb": None, "convertible": None,
}
#: Exchange suffixes and the forms they are written in.
EXCHANGES = {"SZ": "XSHE", "SH": "XSHG", "BJ": "XBSE"}


def as_date(c: Column, source_type: str) -> Column:
    """A date from a date, a timestamp, ISO text or yyyyMMdd text."""
    if source_type != "string":
        return F.to_date(c)
    return F.when(c.rlike("^[0-9]{8}$"), F.to_date(F.when(c.rlike("^[0-9]{8}$"), c), "yyyyMMdd")).otherwise(F.to_date(F.when(~c.rlike("^[0-9]{8}$"), F.substring(c, 1, 10))))


def canonical(df: DataFrame) -> DataFrame:
    """Give columns the panel's names (where the panel's name is not taken) and dates the type."""
    for name, others in COLUMN_NAMES.items():
        if name not in df.columns:
            for other in others:
                if other in df.columns:
                    df = df.withColumnRenamed(other, name)
                    break
    if "date" in df.columns:
        df = df.withColumn("date", as_date(F.col("date"), dict(df.dtypes)["date"]))
    return df


def require(df: DataFrame, columns: Iterable[str] = REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise PanelError(f"the panel lacks {', '.join(missing)}")
    return df


def asset_code(code: Column) -> Column:
    """An instrument code with the exchange's long suffix; six digits alone get it from their first digit."""
    code = F.upper(F.trim(code))
    out = code
    for short, long in EXCHANGES.items():
        out = F.when(code.endswith(f".{short}"), F.concat(F.substring_index(code, ".", 1), F.lit(f".{long}"))).otherwise(out)
    bare = code.rlike("^[0-9]{6}$")
    return F.when(bare, F.concat(code, F.when(F.substring(code, 1, 1).isin("5", "6", "9"), ".XSHG").otherwise(".XSHE"))).otherwise(out)


def in_universe(df: DataFrame, universe: str | Iterable[str] | DataFrame | None) -> DataFrame:
    """Keep a universe: a named pool keeps all, a code keeps one asset, a list or a table of ``asset`` its assets."""
    if universe is None:
        return df
    if isinstance(universe, DataFrame):
        return df.join(universe.select("asset").distinct(), "asset", "left_semi")
    if isinstance(universe, str):
        return df if universe.strip().lower() in POOLS else df.where(F.col("asset") == universe)
    return df.where(F.col("asset").isin(list(universe)))


def _csv(spark: SparkSession, path: str, schema: str | None, options: dict) -> DataFrame:
    """A CSV file by its header: with a schema of one's own, else names, codes and dates as text and the panel's numbers as doubles. Only
    the header is looked at, so types do not depend on the values."""
    reader = spark.read.options(**options).option("header", True)
    names = reader.csv(path).columns
    if schema is None:
        numbers = {"open", "high", "low", "close", *(n for k in ("volume", "amount") for n in (k, *COLUMN_NAMES[k]))}
        schema = ", ".join(f"`{n}` {'double' if n in numbers else 'string'}" for n in names)
    return reader.schema(schema).csv(path)


def load(spark: SparkSession, path: str, universe=None, start: str | None = None, end: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """A price panel from Parquet or CSV files; the date range (both ends in) and the universe are pushed to the scan. ``schema``: of a CSV file."""
    raw = _csv(spark, path, schema, options) if path.rstrip("/").endswith(".csv") else spark.read.options(**options).parquet(path)
    df = require(canonical(raw))
    if start is not None:
        df = df.where(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col("date") <= F.to_date(F.lit(end)))
    return in_universe(df, universe)


def load_first(spark: SparkSession, paths: Iterable[str], **options) -> DataFrame:
    """The first of ``paths`` that exists."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(hadoop).exists(p):
            return load(spark, path, **options)
    raise PanelError(f"no price file among {list(paths)}")


FIRST_DAY, LAST_DAY = dt.date(1, 1, 1), dt.date(9999, 12, 31)
_PIECE = re.compile(r"from-(\d{4}-\d{2}-\d{2})-to-(\d{4}-\d{2}-\d{2})")


def missing_days(covered: Iterable[tuple[dt.date, dt.date]], start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """The parts of ``start`` to ``end`` that no range of ``covered`` holds (both ends in), in order."""
    out, next_day = [], start
    for low, high in sorted(covered):
        if low > end or next_day > end:
            break
        if low > next_day:
            out.append((next_day, low - dt.timedelta(days=1)))
        if high >= next_day:
            next_day = high + dt.timedelta(days=1) if high < LAST_DAY else LAST_DAY
    if next_day <= end:
        out.append((next_day, end))
    return out


def _within(first: dt.date, last: dt.date) -> Column:
    return F.col("date").between(*(F.to_date(F.lit(day.isoformat())) for day in (first, last)))


def cached(spark: SparkSession, folder: str, assets: Iterable[str], read: Callable[[list[str], dt.date, dt.date], DataFrame], start: str | None = None, end: str | None = None) -> DataFrame:
    """Prices of a set of assets from a folder of earlier reads. Each piece there is named by the range of days that it covers; only days that no piece covers
    are read (``read(codes, first, last)``, both days in) and added, so an answer is never short of what was asked.

    Without ``end`` a read covers no day beyond the last that it found, so that later days are asked for again. A write that died leaves a
    pending folder, which is no piece; one job at a time may write for a set.
    """
    codes = sorted(set(assets))
    home = f"{folder.rstrip('/')}/{hashlib.sha256(','.join(codes).encode()).hexdigest()[:24]}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def pieces() -> dict[str, tuple[dt.date, dt.date]]:
        names = [x.getPath().getName() for x in fs.listStatus(hadoop_path(home))] if fs.exists(hadoop_path(home)) else []
        return {n: tuple(map(dt.date.fromisoformat, m.groups())) for n in names if (m := _PIECE.fullmatch(n))}

    first, last = (dt.date.fromisoformat(start) if start else FIRST_DAY), (dt.date.fromisoformat(end) if end else LAST_DAY)
    for low, high in missing_days(pieces().values(), first, last):
        pending = f"{home}/pending-{uuid.uuid4().hex[:12]}"
        found = canonical(read(codes, low, high))
        found.where(_within(low, high)).write.parquet(pending)
        if high == LAST_DAY:
            high = spark.read.parquet(pending).agg(F.max("date")).first()[0] or (low if not pieces() else None)
        if high is None:
            fs.delete(hadoop_path(pending), True)  # nothing new after the last piece
        else:
            fs.rename(hadoop_path(pending), hadoop_path(f"{home}/from-{low.isoformat()}-to-{high.isoformat()}"))
    paths = [f"{home}/{name}" for name, (low, high) in sorted(pieces().items()) if low <= last and high >= first]
    df = spark.read.option("mergeSchema", True).parquet(*(paths or [f"{home}/{min(pieces())}"]))
    return df.where(_within(first, last))


def repeated_keys(df: DataFrame) -> DataFrame:
    """``date, asset, n`` of keys with more than one row; a panel must have none."""
    return df.groupBy("date", "asset").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_fundamentals(panel: DataFrame, fundamentals: DataFrame | None, fields: Iterable[str]) -> DataFrame:
    """Join the fields of a fundamentals table that it has; without a table the fields are null."""
    fields = list(fields)
    if fundamentals is None:
        return panel.withColumns({f: F.lit(None).cast("double") for f in fields})
    there = canonical(fundamentals)
    known = [f for f in fields if f in there.columns and f not in panel.columns]
    return panel.join(there.select("date", "asset", *known), ["date", "asset"], "left")


def write(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A sink for factor values, daily IC and equity frames."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
