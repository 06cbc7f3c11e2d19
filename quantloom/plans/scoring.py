"""Scores of factors against labels: per-date correlation (IC), its information ratio, direction, and the metric bundle."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from ..functions.core import DATE, SYMBOL

MODES = {"pearson": "pearson_ic", "pearson_ic": "pearson_ic", "ic": "pearson_ic", "icir": "pearson_ic", "rank": "rank_ic", "rank_ic": "rank_ic", "spearman": "rank_ic", "rankic": "rank_ic", "rankicir": "rank_ic", "hybrid": "hybrid", "hybridicir": "hybrid"}
KEY_METRIC = {"pearson_ic": "ICIR", "rank_ic": "RankICIR", "hybrid": "HybridICIR"}


def evaluation_mode(value: str | None = None, legacy_key_metric: str | None = None) -> str:
    """The mode of a name, else the one that an old key metric implies, else Pearson."""
    for x in (value, legacy_key_metric):
        if x:
            key = x.strip().lower().replace("-", "_")
            if key not in MODES:
                raise ValueError(f"evaluation mode {x!r} is not known")
            return MODES[key]
    return "pearson_ic"


@dataclass(frozen=True)
class Samples:
    """In- and out-of-sample date ranges, both ends included."""

    inside: tuple[str, str]
    outside: tuple[str, str]

    def of(self, date: Column) -> Column:
        within = lambda r: date.between(F.to_date(F.lit(r[0])), F.to_date(F.lit(r[1])))
        return F.when(within(self.inside), "in").when(within(self.outside), "out")


def long_factors(frame: DataFrame, factors: list[str]) -> DataFrame:
    """(date, symbol, factor, value): values as float32, the type that factors are kept in."""
    return frame.select(DATE, SYMBOL, F.posexplode(F.array(*(F.col(f).cast("float").cast("double") for f in factors))).alias("_i", "value")).select(DATE, SYMBOL, F.array(*map(F.lit, factors))[F.col("_i")].alias("factor"), "value")


def daily_ic(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(factor, date, ic, rank_ic, pairs) of every date with a pair. values: date, symbol, factor, value.

    All factors and both methods are scored in one aggregation after one shuffle of the pairs for their ranks.
    """
    pairs = values.join(labels, [DATE, SYMBOL]).where("value is not null and label is not null")

    def average_rank(c: str) -> Column:
        own = Window.partitionBy("factor", DATE)
        return F.rank().over(own.orderBy(c)).cast("double") + (F.count(F.lit(1)).over(Window.partitionBy("factor", DATE, c)) - 1).cast("double") / F.lit(2.0)

    ranked = pairs.withColumns({"_rv": average_rank("value"), "_rl": average_rank("label")})
    return ranked.groupBy("factor", DATE).agg(core.corr_of(F.col("value"), F.col("label")).alias("ic"), core.corr_of(F.col("_rv"), F.col("_rl")).alias("rank_ic"), F.count("*").alias("pairs"))


def ratio(x: Column) -> Column:
    """Mean over standard deviation of the dates' values."""
    spread = F.stddev_samp(x)
    return F.try_divide(F.avg(x), F.when(spread > core.TINY, spread))


def bundle(ic: DataFrame, samples: Samples) -> DataFrame:
    """One row per factor: IC, ICIR, RankIC, RankICIR, HybridICIR, the same out of sample (O_), directions and their agreement.

    The sign of the in-sample mean turns both samples, so that a factor that predicts the other way round scores alike.
    """
    own = ic.withColumn("sample", samples.of(F.col(DATE)))
    picked = lambda c, s: F.when(F.col("sample") == s, F.col(c))
    aggs = [f(picked(c, s)).alias(f"{s}_{c}_{name}") for c in ("ic", "rank_ic") for s in ("in", "out") for name, f in (("mean", F.avg), ("ratio", ratio))]
    out = own.groupBy("factor").agg(*aggs)
    way = {c: F.when(F.col(f"in_{c}_mean") < 0, -1).otherwise(1) for c in ("ic", "rank_ic")}
    out = out.withColumns({"direction": way["ic"], "rank_direction": way["rank_ic"]})
    turned = {
        f"{o}{label}": F.col(f"{s}_{c}_{name}") * F.col("direction" if c == "ic" else "rank_direction")
        for s, o in (("in", ""), ("out", "O_"))
        for c, name, label in (("ic", "mean", "IC"), ("ic", "ratio", "ICIR"), ("rank_ic", "mean", "RankIC"), ("rank_ic", "ratio", "RankICIR"))
    }
    out = out.withColumns(turned)
    out = out.withColumns({"HybridICIR": core.least(F.col("ICIR"), F.col("RankICIR")), "O_HybridICIR": core.least(F.col("O_ICIR"), F.col("O_RankICIR"))})
    metrics = ["IC", "ICIR", "RankIC", "RankICIR", "HybridICIR", "O_IC", "O_ICIR", "O_RankIC", "O_RankICIR", "O_HybridICIR"]
    return out.select("factor", *(F.round(m, 5).alias(m) for m in metrics), "direction", "rank_direction", (F.col("direction") == F.col("rank_direction")).alias("direction_consistent"))


def score(panel: DataFrame, factors: list[str], labels: DataFrame, samples: Samples) -> DataFrame:
    return bundle(daily_ic(long_factors(panel, factors), labels), samples)


def summary(ic: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and information ratio of a per-date IC."""
    aggs = [F.avg("ic").alias("ic_mean"), ratio(F.col("ic")).alias("icir"), F.count("ic").alias("dates")]
    return ic.groupBy(*by).agg(*aggs) if by else ic.agg(*aggs)


def correlations(frame: DataFrame, factors: list[str]) -> DataFrame:
    """(a, b, corr, pairs) of every two factors over the rows where both have a value."""
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), core.corr_of(F.col(a), F.col(b)).alias("corr"), F.count(core.both(F.col(a), F.col(b), F.lit(1))).alias("pairs")) for a, b in combinations(factors, 2)]
    return frame.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
