"""Dynamic checks of factors: enough values, comparable scale, no look-ahead, no dependence on row order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import DATE, SYMBOL

Factor = Callable[[DataFrame], DataFrame]
#: Fixed limits of the checks.
LEAST_NONNULL, MOST_DIFFERENCE, MOST_SPREAD, TRUNCATED_DAYS, LEAST_DAYS = 0.01, 1e-3, 100.0, 100, 120


def nonnull_rate(values: DataFrame, value: str = "value") -> DataFrame:
    """(rate, enough)"""
    return values.agg(F.avg(F.col(value).isNotNull().cast("int")).alias("rate")).withColumn("enough", F.col("rate") >= LEAST_NONNULL)


def scale_spread(values: DataFrame, value: str = "value") -> DataFrame:
    """(low, high, comparable): the 1st and 99th percentile of the symbols' standard deviations and whether they are within a hundredfold."""
    spread = values.groupBy(SYMBOL).agg(F.stddev_samp(value).alias("s")).where("s is not null")
    out = spread.agg(F.percentile("s", 0.01).alias("low"), F.percentile("s", 0.99).alias("high"))
    return out.withColumn("comparable", F.coalesce(F.try_divide(F.col("high"), F.col("low")) < MOST_SPREAD, F.lit(False)))


def difference(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """(max_difference, compared, same): the largest relative difference over the keys that both have."""
    both = a.select(DATE, SYMBOL, F.col(value).alias("a")).join(b.select(DATE, SYMBOL, F.col(value).alias("b")), [DATE, SYMBOL])
    one_null = F.col("a").isNull() != F.col("b").isNull()
    gap = F.when(one_null, 1.0).otherwise(F.abs(F.col("a") - F.col("b")) / (F.abs("a") + 1e-8))
    return both.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("max_difference"), F.count("*").alias("compared")).withColumn("same", F.col("max_difference") < MOST_DIFFERENCE)


def truncation(panel: DataFrame, factor: Factor, days: int = TRUNCATED_DAYS) -> DataFrame:
    """Compare the factor with itself on a panel that ends ``days`` earlier: a difference means look-ahead."""
    end = panel.agg(F.date_sub(F.max(DATE), days).alias("_end"))
    early = panel.join(F.broadcast(end), F.col(DATE) <= F.col("_end")).drop("_end")
    return difference(factor(panel), factor(early))


def order(panel: DataFrame, factor: Factor) -> DataFrame:
    """Compare the factor with itself on the same rows dealt out in another order."""
    return difference(factor(panel), factor(panel.repartition(7, F.xxhash64(SYMBOL, DATE)).sortWithinPartitions(F.desc(SYMBOL), F.desc(DATE))))


def validate(panel: DataFrame, factor: Factor) -> dict[str, str]:
    """Status of a factor: empty if all checks pass, else by failed check (NAN, DIMENSION, FUTURE, ORDER) what was found."""
    values = factor(panel).persist()
    found = {}
    try:
        r = nonnull_rate(values).first()
        if not r["enough"]:
            found["NAN"] = f"{r['rate'] or 0:.4f} of the values are there"
        r = scale_spread(values).first()
        if not r["comparable"]:
            found["DIMENSION"] = f"standard deviations by symbol range from {r['low']} to {r['high']}"
        span = panel.agg(F.datediff(F.max(DATE), F.min(DATE))).first()[0]
        if span is not None and span > LEAST_DAYS and not (r := truncation(panel, factor).first())["same"]:
            found["FUTURE"] = f"values change by {r['max_difference']:.3g} when later dates are cut off"
        if not (r := order(panel, factor).first())["same"]:
            found["ORDER"] = f"values change by {r['max_difference']:.3g} with the order of rows"
    finally:
        values.unpersist()
    return found
