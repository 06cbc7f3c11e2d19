"""Long panels keyed by (date, symbol): normalisation, density, duplicates, derived fields, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from ..functions.core import DATE, SYMBOL

#: Columns that are never numeric fields.
KEYS = (DATE, SYMBOL)


def lenient_date(raw: Column) -> Column:
    """YYYYMMDD (also as an int or with .0), dates with - or /, or any date text; NULL for others."""
    text = F.trim(raw.cast("string"))
    bare = F.regexp_replace(F.regexp_replace(text, r"\.0$", ""), "[-/]", "")
    return F.when(bare.rlike("^[0-9]{8}$"), F.try_to_date(bare, "yyyyMMdd")).otherwise(text.try_cast("date"))


def strict_date(raw: Column) -> Column:
    """Only YYYYMMDD after removing - and / and .0; NULL for others (see ``require_dates``)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw.cast("string")), r"\.0$", ""), "[-/]", "")
    return F.when(bare.rlike("^[0-9]{8}$"), F.try_to_date(bare, "yyyyMMdd"))


def require_dates(frame: DataFrame, column: str) -> DataFrame:
    """``frame`` with a strict date column; an error shows five of the values that aren't dates."""
    bad = frame.where(strict_date(F.col(column)).isNull()).select(F.col(column).cast("string")).limit(5).collect()
    if bad:
        raise ValueError(f"{column} holds values that are not dates: {[r[0] for r in bad]}")
    return frame.withColumn(column, strict_date(F.col(column)))


def numeric(raw: Column) -> Column:
    """Number or NULL; NaN is NULL."""
    value = raw.try_cast("double")
    return F.when(~F.isnan(value), value)


def normalise(frame: DataFrame, *, upper: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Dates parsed, symbols as text, other columns numeric; rows without a key go."""
    symbol = F.trim(F.col(SYMBOL).cast("string"))
    own = [c for c in frame.columns if c not in KEYS] if fields is None else fields
    date = F.col(DATE).cast("date") if frame.schema[DATE].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else lenient_date(F.col(DATE))
    return frame.select(date.alias(DATE), (F.upper(symbol) if upper else F.col(SYMBOL).cast("string")).alias(SYMBOL), *(numeric(F.col(c)).alias(c) for c in own)).na.drop(subset=[*KEYS])


def derive_amount_vwap(frame: DataFrame, *, matrix: bool = False) -> DataFrame:
    """``amount`` and ``vwap`` where they are absent.

    For factor code, vwap takes the adjustment factor only when the amount was there already, and is also made when
    it holds no value at all; for matrices (``matrix``), the amount is unadjusted first and vwap always adjusted.
    """
    had = "amount" in frame.columns
    factor = F.coalesce("adjfactor", F.lit(1.0)) if "adjfactor" in frame.columns else F.lit(1.0)
    if not had:
        price = core.divide(F.col("close"), F.col("adjfactor")) if matrix and "adjfactor" in frame.columns else F.col("close")
        frame = frame.withColumn("amount", price * F.col("volume"))
    if "vwap" not in frame.columns or (not matrix and frame.where("vwap is not null").isEmpty()):
        vwap = core.divide(F.col("amount"), F.col("volume"))
        frame = frame.withColumn("vwap", vwap * factor if matrix or had else vwap)
    return frame


def keep_last(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows with equal keys the last by ``order``."""
    own = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return frame.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def require_unique(frame: DataFrame, keys: list[str], what: str = "panel") -> DataFrame:
    bad = frame.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"{what} holds rows with equal keys: {[tuple(r[k] for k in keys) for r in bad]}")
    return frame


def densify(frame: DataFrame) -> DataFrame:
    """A row for every date and symbol that occur. The dates, a calendar, are broadcast; symbols are not."""
    dates = frame.select(DATE).distinct().agg(F.sort_array(F.collect_set(DATE)).alias("_dates"))
    grid = frame.select(SYMBOL).distinct().crossJoin(F.broadcast(dates)).select(F.explode("_dates").alias(DATE), SYMBOL)
    return grid.join(frame, [*KEYS], "left").select(*KEYS, *(c for c in frame.columns if c not in KEYS))


def only_symbols(frame: DataFrame, symbols: list[str] | None) -> DataFrame:
    """The listed symbols; all if none of them is there."""
    if not symbols:
        return frame
    some = frame.where(F.col(SYMBOL).isin(symbols))
    return frame if some.isEmpty() else some


def between(frame: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Dates from start to end, both included."""
    if start:
        frame = frame.where(F.col(DATE) >= F.to_date(F.lit(start)))
    return frame.where(F.col(DATE) <= F.to_date(F.lit(end))) if end else frame


def forward_return(price: Column, span: int) -> Column:
    """Return of entering at the next date and leaving ``span`` dates later. On a dense panel only."""
    return core.divide(F.lead(price, span + 1).over(core.along()), F.lead(price, 1).over(core.along())) - 1


def labels(frame: DataFrame, field: str = "close", span: int = 1, preprocess: str | None = None) -> DataFrame:
    """(date, symbol, label): forward returns over the dense panel, as they are, as cross-section z-scores, or as ranks."""
    dense = densify(frame.select(*KEYS, field)).withColumn("raw", forward_return(F.col(field), span))
    if preprocess in (None, "", "none"):
        out = F.col("raw")
    elif preprocess == "cs_zscore":
        out = core.zscore(F.col("raw"))
    elif preprocess == "cs_rank":
        out = core.rank(F.col("raw"))
    else:
        raise ValueError(f"label preprocess {preprocess!r} is none of none, cs_zscore, cs_rank")
    return dense.select(*KEYS, out.alias("label"))


def on_grid(frame: DataFrame, grid: DataFrame) -> DataFrame:
    """The rows of ``grid``'s keys with the frame's columns; repeated keys in ``frame`` are an error."""
    return grid.select(*KEYS).join(require_unique(frame, [*KEYS], "output"), [*KEYS], "left")
