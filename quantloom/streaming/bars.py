"""Bars from a stream of trades or events: windows with a watermark, then the panel's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(events: DataFrame, *, time: str = "ts", symbol: str = "user_id", price: str = "value", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(date, symbol, open, high, low, close, volume, amount, vwap) of every window; events later than ``late`` are dropped by the watermark.

    Works on static and streaming frames. State is one row for each open window and symbol.
    """
    own = events.select(F.col(time).cast("timestamp").alias("t"), F.col(symbol).cast("string").alias("symbol"), F.col(price).alias("p"))
    if own.isStreaming:
        own = own.withWatermark("t", late)
    out = own.groupBy(F.window("t", window).alias("w"), "symbol").agg(
        F.min_by("p", "t").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "t").alias("close"), F.count("p").cast("double").alias("volume"), F.sum("p").alias("amount")
    )
    return out.select(F.to_date("w.start").alias("date"), "symbol", "open", "high", "low", "close", "volume", "amount", F.try_divide("amount", "volume").alias("vwap"))


def start(frame: DataFrame, path: str, checkpoint: str, *, once: bool = False):
    """Append finished bars to a Parquet folder, each exactly once."""
    writer = frame.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
