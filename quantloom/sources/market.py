"""Market data: CSV and Parquet scans with projection and pushed-down date ranges."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import DATE, SYMBOL
from ..operators import panel as P
from ..operators import pit

REQUIRED = ("open", "high", "low", "close", "volume")
OPTIONAL = ("amount", "vwap", "adjfactor")
ETL_COLUMNS = (DATE, SYMBOL, "open", "high", "low", "close", "volume", "amount", "vwap")


def data_path(config: dict) -> str:
    """``market_data_path``, or the older ``market_data_csv_path``."""
    path = config.get("market_data_path") or config.get("market_data_csv_path")
    if not path:
        raise ValueError("market_data_path is missing")
    return str(path)


def _is_csv(path: str) -> bool:
    return path.rstrip("/").lower().endswith((".csv", ".csv.gz"))


def scan(spark: SparkSession, path: str, *, merge_schema: bool = False) -> DataFrame:
    """CSV files by their header, all as text; Parquet files and Hive-partitioned folders by their schema.

    ``merge_schema`` opens the footers of all files, for tables whose files differ in columns.
    """
    if _is_csv(path):
        return spark.read.option("header", True).csv(path)
    if "." in path.rstrip("/").rsplit("/", 1)[-1] and not path.rstrip("/").lower().endswith((".parquet", ".pq")) and "=" not in path:
        raise ValueError(f"{path} is neither CSV nor Parquet")
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


@dataclass(frozen=True)
class Source:
    columns: list[str]
    rows: int | None
    format: str


def inspect(spark: SparkSession, path: str) -> Source:
    """Columns from header or footers; rows of Parquet only."""
    frame = scan(spark, path)
    return Source(frame.columns, None if _is_csv(path) else frame.count(), "csv" if _is_csv(path) else "parquet")


def date_literal(kind: T.DataType, day: str) -> Column:
    """A literal of the column's own type, so that the comparison is pushed into the scan."""
    value = dt.date.fromisoformat(day)
    match kind:
        case T.DateType():
            return F.lit(value)
        case T.TimestampType() | T.TimestampNTZType():
            return F.lit(dt.datetime.combine(value, dt.time())).cast(kind)
        case T.IntegerType() | T.LongType():
            return F.lit(int(value.strftime("%Y%m%d"))).cast(kind)
    return F.lit(day)


def _end_of(kind: T.DataType, day: str) -> Column:
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.lit(dt.datetime.combine(dt.date.fromisoformat(day), dt.time(23, 59, 59, 999999))).cast(kind)
    return date_literal(kind, day)


def load(spark: SparkSession, path: str, *, columns: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """date, symbol and the columns; dates from start to end included, rows without a key left out."""
    frame = scan(spark, path)
    if missing := [c for c in (DATE, SYMBOL) if c not in frame.columns]:
        raise ValueError(f"{path} has no {missing}")
    wanted = [*dict.fromkeys([DATE, SYMBOL, *(columns if columns is not None else frame.columns)])]
    if missing := [c for c in wanted if c not in frame.columns]:
        raise ValueError(f"{path} has no columns {missing}")
    frame, kind = frame.select(*wanted), frame.schema[DATE].dataType
    if not isinstance(kind, T.StringType):
        if start:
            frame = frame.where(F.col(DATE) >= date_literal(kind, start))
        if end:
            frame = frame.where(F.col(DATE) <= _end_of(kind, end))
    out = P.between(P.normalise(frame), start, end)
    if out.isEmpty():
        raise ValueError(f"{path} has no rows from {start or 'the first date'} to {end or 'the last'}")
    return out


def load_market(spark: SparkSession, path: str, *, columns: list[str] | None = None, start: str | None = None, end: str | None = None, need_bars: bool = True) -> DataFrame:
    """Bars and the requested fields, with amount and vwap derived, one row for each key (the file's last)."""
    there = scan(spark, path).columns
    if need_bars and (missing := [c for c in REQUIRED if c not in there]):
        raise ValueError(f"{path} has no {missing}")
    bars = [c for c in (*REQUIRED, *OPTIONAL) if c in there]
    frame = load(spark, path, columns=[*dict.fromkeys([*(columns or []), *bars])], start=start, end=end)
    frame = P.keep_last(frame.withColumn("_order", F.monotonically_increasing_id()), [DATE, SYMBOL], [F.col("_order")]).drop("_order")
    return P.derive_amount_vwap(frame) if {"close", "volume"} <= {*frame.columns} else frame


def load_etl_market(spark: SparkSession, path: str, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """The nine bar columns with strict dates; repeated keys and empty results are errors."""
    frame = scan(spark, path)
    if missing := [c for c in ETL_COLUMNS if c not in frame.columns]:
        raise ValueError(f"{path} has no {missing}")
    frame = P.require_dates(frame.select(*ETL_COLUMNS), DATE) if frame.schema[DATE].dataType.typeName() not in ("date", "timestamp") else frame.withColumn(DATE, F.to_date(DATE))
    frame = P.between(P.normalise(frame, upper=True), start, end)
    if frame.isEmpty():
        raise ValueError(f"{path} has no rows in the range")
    return P.require_unique(frame, [DATE, SYMBOL], "market data")


def load_report_years(spark: SparkSession, root: str, columns: list[str], first: int, last: int) -> DataFrame:
    """``report_year=`` partitions from first to last; columns that older files lack are NULL, so all footers are opened."""
    frame = scan(spark, root, merge_schema=True).where(F.col("report_year").between(first, last))
    return frame.select(*(F.col(c) if c in frame.columns else F.lit(None).cast("double").alias(c) for c in columns))


def load_months(spark: SparkSession, root: str, columns: list[str], start: str, end: str) -> DataFrame:
    """``year=/month=`` partitions of a date range: whole partitions are pruned, the rest filtered by date."""
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    frame = scan(spark, root)
    month = F.col("year") * 12 + F.col("month")
    frame = frame.where(F.col("year").between(a.year, b.year) & month.between(a.year * 12 + a.month, b.year * 12 + b.month))
    frame = P.normalise(frame.select(DATE, SYMBOL, *columns), upper=True)
    frame = P.between(frame, start, end)
    if frame.isEmpty():
        raise ValueError(f"{root} has no rows from {start} to {end}")
    return frame


def load_calendar(spark: SparkSession, path: str) -> DataFrame:
    """nature_date, next_trade_date, is_trade; one row for each day."""
    frame = spark.read.parquet(path)
    if missing := [c for c in ("nature_date", "next_trade_date", "is_trade") if c not in frame.columns]:
        raise ValueError(f"the calendar has no {missing}")
    for c in ("nature_date", "next_trade_date"):
        frame = frame.withColumn(c, F.to_date(c)) if frame.schema[c].dataType.typeName() in ("date", "timestamp") else P.require_dates(frame, c)
    return P.require_unique(frame.select("nature_date", "next_trade_date", "is_trade"), ["nature_date"], "calendar")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def statement_fields(columns: list[str]) -> tuple[list[str], list[str]]:
    """Flows (``is_``, ``cfs_``) and balances (``bs_``) among statement columns; another prefix is an error."""
    keys = {SYMBOL, DATE, "quarter", "if_adjusted", "available_date", "report_year", "report_quarter", "is_warmup"}
    own = [c for c in columns if c not in keys]
    if unknown := [c for c in own if not c.startswith(("is_", "cfs_", "bs_"))]:
        raise ValueError(f"statement columns of no known kind: {unknown}")
    return [c for c in own if not c.startswith("bs_")], [c for c in own if c.startswith("bs_")]


def forecasts(events: DataFrame) -> DataFrame:
    """Forecast midpoints by symbol and activation date, the last available one of a date."""
    mid = lambda x: pit.midpoint(F.col(f"forecast_{x}_floor"), F.col(f"forecast_{x}_ceiling")).alias(f"fund_forecast_{x}_mid")
    more = [F.col("net_profit_yoy_const_forecast").alias("fund_forecast_net_profit_yoy")] if "net_profit_yoy_const_forecast" in events.columns else []
    out = events.select(SYMBOL, F.col("available_date").alias("fund_forecast_available_date"), "activation_date", mid("np"), mid("eps"), mid("growth_rate"), *more)
    return P.keep_last(out, [SYMBOL, "activation_date"], [F.col("fund_forecast_available_date"), *(F.col(c) for c in out.columns if c.startswith("fund_forecast_") and not c.endswith("_date"))])


#: Source column -> field of performance announcements.
PERFORMANCE = {c: f"fund_performance_{c}" for c in ("operating_revenue_yoy", "net_profit_parent_yoy", "net_cash_flow_operating_yoy", "roe_weighted", "total_assets_growth_rate")}


def performance(events: DataFrame) -> DataFrame:
    """Performance announcements by symbol and activation date; absent source columns are NULL."""
    own = [(P.numeric(F.col(c)) if c in events.columns else F.lit(None).cast("double")).alias(n) for c, n in PERFORMANCE.items()]
    out = events.select(SYMBOL, F.col("available_date").alias("fund_performance_available_date"), "activation_date", *own)
    return P.keep_last(out, [SYMBOL, "activation_date"], [F.col("fund_performance_available_date"), *(F.col(n) for n in PERFORMANCE.values())])
