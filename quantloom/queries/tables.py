"""Panels made from the driver's tables, as DataFrames and as SQL.

EV: daily bars of ``events`` by user. LI: weekly bars of ``lineitem`` by supplier. Prices are rounded to cents, so that
ties are the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import densify


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round("value", 2)
    bars = read(spark, sf_dir, "events").select("ts", F.col("user_id").cast("string").alias("symbol"), cents.alias("value"), F.to_date("ts").alias("date"))
    out = bars.groupBy("date", "symbol").agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.count("*").cast("double").alias("volume"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
    )
    return out.withColumn("amount", F.col("cents") / 100.0).withColumn("vwap", F.col("amount") / F.col("volume")).drop("cents")


EV_SQL = """ev AS (
  SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS symbol,
    arg_min(round(value, 2), ts) AS open, max(round(value, 2)) AS high, min(round(value, 2)) AS low, arg_max(round(value, 2), ts) AS close,
    CAST(count(*) AS DOUBLE) AS volume, sum(CAST(round(round(value, 2) * 100) AS BIGINT)) / 100.0 AS amount,
    sum(CAST(round(round(value, 2) * 100) AS BIGINT)) / 100.0 / count(*) AS vwap
  FROM events GROUP BY 1, 2)"""

EV_DENSE_SQL = f"""{EV_SQL},
p AS (
  SELECT d.date, s.symbol, open, high, low, close, volume, amount, vwap
  FROM (SELECT DISTINCT date FROM ev) d CROSS JOIN (SELECT DISTINCT symbol FROM ev) s LEFT JOIN ev ON ev.date = d.date AND ev.symbol = s.symbol)"""


def ev_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(ev_panel(spark, sf_dir))


def li_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_quantity > 0").select(
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("l_suppkey").cast("string").alias("symbol"),
        (F.floor(F.col("l_extendedprice") * 100.0 / F.col("l_quantity") + 0.5) / 100.0).alias("price"), F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("o"),
    )
    out = rows.groupBy("date", "symbol").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"),
        F.sum("quantity").alias("volume"), F.sum("cents").alias("cents"),
    )
    return out.withColumn("amount", F.col("cents") / 100.0).withColumn("vwap", F.col("amount") / F.col("volume")).drop("cents")


LI_SQL = """li AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS symbol,
    first(floor(l_extendedprice * 100.0 / l_quantity + 0.5) / 100.0 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS open,
    max(floor(l_extendedprice * 100.0 / l_quantity + 0.5) / 100.0) AS high, min(floor(l_extendedprice * 100.0 / l_quantity + 0.5) / 100.0) AS low,
    last(floor(l_extendedprice * 100.0 / l_quantity + 0.5) / 100.0 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS close,
    sum(l_quantity) AS volume, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS amount,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 / sum(l_quantity) AS vwap
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
p AS (SELECT * FROM li)"""
