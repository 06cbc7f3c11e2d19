"""Queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import core
from ..operators import panel as P
from ..operators import pit
from ..plans import factors, scoring
from ..plans.debate import similar_series
from ..plans.expression import evaluate
from .sql import expressions_sql
from .tables import EV_DENSE_SQL, EV_SQL, LI_SQL, ev_dense, ev_panel, li_panel, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def put(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


# operators of expressions

#: Query -> expression over the dense daily panel.
OPS = {
    "op_rank": "rank(close)", "op_zscore": "zscore(close)", "op_scale": "scale(close, 2)",
    "op_delay": "delay(close, 2)", "op_delta": "delta(close, 5)", "op_returns": "returns(close, 1)", "op_returns_pad": "returns_pad(close, 1)", "op_adv": "adv(5)",
    "op_ts_mean": "ts_mean(close, 5)", "op_ts_std": "ts_std(close, 5)", "op_ts_max": "ts_max(close, 5)", "op_ts_min": "ts_min(close, 5)", "op_ts_sum": "ts_sum(close, 5)", "op_ts_zscore": "ts_zscore(close, 5)",
    "op_ts_rank": "ts_rank(close, 5)", "op_ts_argmax": "ts_argmax(close, 5)", "op_ts_argmin": "ts_argmin(close, 5)", "op_decay_linear": "decay_linear(close, 4)",
    "op_correlation": "correlation(close, volume, 6)", "op_covariance": "covariance(close, volume, 6)",
    "op_sign": "sign(close - open)", "op_log": "log(close - open)", "op_abs": "abs(close - open)", "op_power": "power(close - open, 2)", "op_signed_power": "signed_power(close - open, 0.5)",
    "op_min": "min(close, open)", "op_max": "max(close, open)", "op_clip": "clip(close, low + 1, 50)",
    "expr_arithmetic": "-(close - open) / (high - low + 0.001) * 2", "expr_reversal": "rank(-delta(close, 5))", "expr_nested": "rank(ts_mean(zscore(close), 5)) - rank(ts_std(returns(close, 1), 5))",
    "expr_conditional": "np.where(close > open, ts_sum(volume, 3), -ts_sum(volume, 3))", "expr_volume_price": "-correlation(rank(close), rank(volume), 6) * sign(delta(vwap, 1))", "expr_decay": "scale(decay_linear(rank(close / open_ - 1), 3))",
}


def _expression(text: str) -> Query:
    return lambda spark, d: evaluate(ev_dense(spark, d), {"value": text}).select("date", "symbol", rounded("value").alias("value"))


for _name, _text in OPS.items():
    put(_name, _expression(_text), expressions_sql(EV_DENSE_SQL, {"value": _text}))

# panels and loading

_BARS = ["open", "high", "low", "close", "volume", "amount", "vwap"]


def _bars(panel: Query) -> Query:
    return lambda spark, d: panel(spark, d).select("date", "symbol", *(rounded(c, 9).alias(c) for c in _BARS))


_BARS_SQL = ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in _BARS)
put("panel_bars_ev", _bars(ev_panel), f"WITH {EV_SQL} SELECT date, symbol, {_BARS_SQL} FROM ev")
put("panel_bars_li", _bars(li_panel), f"WITH {LI_SQL} SELECT date, symbol, {_BARS_SQL} FROM p")
put("panel_dense_ev", _bars(ev_dense), f"WITH {EV_DENSE_SQL} SELECT date, symbol, {_BARS_SQL} FROM p")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Orders with dates in several forms and numbers as text, some of them bad."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.when(k % 5 == 0, F.date_format(day, "yyyyMMdd")).when(k % 5 == 1, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 2, F.date_format(day, "yyyy/MM/dd")).when(k % 5 == 3, F.concat(F.date_format(day, "yyyyMMdd"), F.lit(".0"))).otherwise("n/a")
    number = F.when(k % 7 == 0, F.lit("bad")).otherwise(F.format_string("%.2f", "o_totalprice"))
    return read(spark, d, "orders").select(k.alias("id"), text.alias("date"), F.concat(F.lit(" c"), F.col("o_custkey")).alias("symbol"), number.alias("price"))


put(
    "load_normalize_dates", lambda spark, d: _raw(spark, d).select("id", P.lenient_date(F.col("date")).alias("date"), P.strict_date(F.col("date")).alias("strict")),
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderdate AS DATE) END AS strict FROM orders",
)
put(
    "load_numeric_coerce", lambda spark, d: P.normalise(_raw(spark, d).select("date", "symbol", "price", F.col("id").alias("key")), upper=True).select("date", "symbol", rounded("price", 2).alias("price"), rounded("key", 0).alias("key")),
    "SELECT CAST(o_orderdate AS DATE) AS date, 'C' || o_custkey AS symbol, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END + 0.0 AS price, CAST(o_orderkey AS DOUBLE) AS key FROM orders WHERE o_orderkey % 5 <> 4",
)
put(
    "load_date_range", lambda spark, d: P.between(read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("id")), "1995-01-10", "1996-03-31"),
    "SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-10' AND DATE '1996-03-31'",
)
put(
    "load_dedupe_last", lambda spark, d: P.keep_last(read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_custkey").cast("string").alias("symbol"), "o_orderkey", rounded("o_totalprice", 2).alias("price")), ["date", "symbol"], [F.col("o_orderkey"), F.col("price")]),
    "SELECT date, symbol, o_orderkey, price FROM (SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS symbol, o_orderkey, round(o_totalprice, 2) + 0.0 AS price, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), o_custkey ORDER BY o_orderkey DESC, round(o_totalprice, 2) DESC) AS n FROM orders) WHERE n = 1",
)

# labels and scores

_LEAD = "(lead(close, 2) OVER (PARTITION BY symbol ORDER BY date) / nullif(lead(close, 1) OVER (PARTITION BY symbol ORDER BY date), 0) - 1)"
_LABEL_SQL = f"{EV_DENSE_SQL}, l AS (SELECT date, symbol, {_LEAD} AS raw FROM p)"
for _kind, _sql in {
    "raw": "raw",
    "cs_zscore": "(raw - avg(raw) OVER (PARTITION BY date)) / nullif(stddev_samp(raw) OVER (PARTITION BY date), 0)",
    "cs_rank": "CASE WHEN raw IS NOT NULL THEN (rank() OVER (PARTITION BY date, raw IS NULL ORDER BY raw) + (count(*) OVER (PARTITION BY date, raw) - 1) / 2.0) / count(raw) OVER (PARTITION BY date) END",
}.items():
    put(
        f"label_{_kind}", lambda spark, d, kind=_kind: P.labels(ev_panel(spark, d), "close", 1, None if kind == "raw" else kind).select("date", "symbol", rounded("label").alias("label")),
        f"WITH {_LABEL_SQL} SELECT date, symbol, round({_sql}, 6) + 0.0 AS label FROM l",
    )

#: The expressions that the scoring queries score.
SCORED = {"reversal": "-delta(close, 5)", "momentum": "ts_mean(returns(close, 1), 5)", "turnover": "volume / ts_mean(volume, 10)"}
SAMPLES = scoring.Samples(("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-31"))


def _ic(spark: SparkSession, d: str) -> DataFrame:
    panel = ev_dense(spark, d)
    return scoring.daily_ic(scoring.long_factors(evaluate(panel, SCORED), [*SCORED]), P.labels(panel, "close", 1))


def _ic_sql() -> str:
    head, _, tail = expressions_sql(EV_DENSE_SQL, SCORED, None).rpartition(" SELECT date")
    values = " UNION ALL ".join(f"SELECT date, symbol, '{n}' AS factor, CAST(CAST({n} AS FLOAT) AS DOUBLE) AS value FROM fs" for n in SCORED)
    ranks = lambda c: f"rank() OVER (PARTITION BY factor, date ORDER BY {c}) + (count(*) OVER (PARTITION BY factor, date, {c}) - 1) / 2.0"
    corr = lambda a, b: f"covar_samp({a}, {b}) / CASE WHEN stddev_samp({a}) * stddev_samp({b}) > 1e-12 THEN stddev_samp({a}) * stddev_samp({b}) END"
    return (
        f"{head}, fs AS (SELECT date{tail}), v AS ({values}), l AS (SELECT date, symbol, {_LEAD} AS label FROM p),"
        f" j AS (SELECT v.*, l.label FROM v JOIN l ON v.date = l.date AND v.symbol = l.symbol WHERE value IS NOT NULL AND label IS NOT NULL),"
        f" r AS (SELECT *, {ranks('value')} AS rv, {ranks('label')} AS rl FROM j),"
        f" ic AS (SELECT factor, date, {corr('value', 'label')} AS ic, {corr('rv', 'rl')} AS rank_ic, count(*) AS pairs FROM r GROUP BY factor, date)"
    )


_IC = _ic_sql()
put("ic_pearson", lambda spark, d: _ic(spark, d).select("factor", "date", rounded("ic").alias("ic"), "pairs"), f"{_IC} SELECT factor, date, round(ic, 6) + 0.0 AS ic, pairs FROM ic")
put("ic_spearman", lambda spark, d: _ic(spark, d).select("factor", "date", rounded("rank_ic").alias("rank_ic"), "pairs"), f"{_IC} SELECT factor, date, round(rank_ic, 6) + 0.0 AS rank_ic, pairs FROM ic")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Per-date correlation of ranked five-day reversal with the next return."""
    panel = ev_dense(spark, d)
    values = scoring.long_factors(evaluate(panel, {"reversal": "rank(-delta(close, 5))"}), ["reversal"])
    return scoring.daily_ic(values, P.labels(panel, "close", 1)).select("date", rounded("ic").alias("ic"), rounded("rank_ic").alias("rank_ic"), "pairs")


put("flagship_daily_ic", flagship, _IC.replace("'reversal' AS factor, CAST(CAST(reversal AS FLOAT) AS DOUBLE)", "'reversal' AS factor, CAST(CAST(CASE WHEN reversal IS NOT NULL THEN (rank() OVER (PARTITION BY date, reversal IS NULL ORDER BY reversal) + (count(*) OVER (PARTITION BY date, reversal) - 1) / 2.0) / count(reversal) OVER (PARTITION BY date) END AS FLOAT) AS DOUBLE)") + " SELECT date, round(ic, 6) + 0.0 AS ic, round(rank_ic, 6) + 0.0 AS rank_ic, pairs FROM ic WHERE factor = 'reversal'")


def _bundle(spark: SparkSession, d: str) -> DataFrame:
    return scoring.bundle(_ic(spark, d), SAMPLES)


def _bundle_sql() -> str:
    parts, metrics = [], []
    for c in ("ic", "rank_ic"):
        for s in ("in", "out"):
            x = f"CASE WHEN sample = '{s}' THEN {c} END"
            parts += [f"avg({x}) AS {s}_{c}_mean", f"avg({x}) / CASE WHEN stddev_samp({x}) > 1e-12 THEN stddev_samp({x}) END AS {s}_{c}_ratio"]
    for s, o in (("in", ""), ("out", "O_")):
        for c, way, label in (("ic", "direction", ""), ("rank_ic", "rank_direction", "Rank")):
            metrics += [f"{s}_{c}_mean * {way} AS {o}{label}IC", f"{s}_{c}_ratio * {way} AS {o}{label}ICIR"]
    names = ["IC", "ICIR", "RankIC", "RankICIR", "HybridICIR", "O_IC", "O_ICIR", "O_RankIC", "O_RankICIR", "O_HybridICIR"]
    least = lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END"
    return (
        f"{_IC}, s AS (SELECT *, CASE WHEN date BETWEEN DATE '{SAMPLES.inside[0]}' AND DATE '{SAMPLES.inside[1]}' THEN 'in' WHEN date BETWEEN DATE '{SAMPLES.outside[0]}' AND DATE '{SAMPLES.outside[1]}' THEN 'out' END AS sample FROM ic),"
        f" a AS (SELECT factor, {', '.join(parts)} FROM s GROUP BY factor),"
        " w AS (SELECT *, CASE WHEN in_ic_mean < 0 THEN -1 ELSE 1 END AS direction, CASE WHEN in_rank_ic_mean < 0 THEN -1 ELSE 1 END AS rank_direction FROM a),"
        f" m AS (SELECT factor, direction, rank_direction, {', '.join(metrics)} FROM w),"
        f" h AS (SELECT *, {least('ICIR', 'RankICIR')} AS HybridICIR, {least('O_ICIR', 'O_RankICIR')} AS O_HybridICIR FROM m)"
        f" SELECT factor, {', '.join(f'round({n}, 5) AS {n}' for n in names)}, direction, rank_direction, direction = rank_direction AS direction_consistent FROM h"
    )


put("metric_bundle", _bundle, _bundle_sql())
put("hybrid_icir", lambda spark, d: _bundle(spark, d).select("factor", "HybridICIR", "O_HybridICIR"), f"SELECT factor, HybridICIR, O_HybridICIR FROM ({_bundle_sql()})")
put("direction", lambda spark, d: _bundle(spark, d).select("factor", "direction", "rank_direction", "direction_consistent"), f"SELECT factor, direction, rank_direction, direction_consistent FROM ({_bundle_sql()})")

# factors, over the weekly panel

for _i, _name in enumerate(factors.FACTORS, 1):

    def _factor(spark: SparkSession, d: str, name: str = _name) -> DataFrame:
        panel = li_panel(spark, d)
        panel = panel.withColumn("fundamental", F.col("amount") / F.col("volume"))
        return factors.compute(panel, [name]).select("date", "symbol", rounded(name).alias("value"))

    _panel_sql = LI_SQL.replace("p AS (SELECT * FROM li)", "p AS (SELECT *, amount / volume AS fundamental FROM li)")
    put(f"factor_g{_i:02d}_{_name}", _factor, expressions_sql(_panel_sql, {"value": factors.formula(_name)}))

_WIDE = ["congestion_effort_result", "amplitude", "volume_spike", "price_drawdown"]
put(
    "alpha_wide", lambda spark, d: factors.compute(li_panel(spark, d), _WIDE).select("date", "symbol", *(rounded(n).alias(f"alpha_{i:03d}_{n}") for i, n in enumerate(_WIDE))),
    expressions_sql(LI_SQL, {f"alpha_{i:03d}_{n}": factors.formula(n) for i, n in enumerate(_WIDE)}),
)
#: A new factor and the accepted ones; ranks across symbols are taken over the whole panel before the demo symbol's series.
_NEW = {"new": "rank(delta(close, 1))"}
_KIN = {"rank_change": "rank(pct_change(close, 1)) * 2", "location": factors.formula("close_location_volume_pressure"), "change": "delta(close, 1)", "rank_volume": "rank(volume)", "opposite": "-rank(delta(close, 1))"}
_SIMILAR = 0.05


def _similar(spark: SparkSession, d: str) -> DataFrame:
    panel = li_panel(spark, d)
    first = F.broadcast(panel.agg(F.min("symbol").alias("symbol")))
    series = evaluate(panel, _NEW | _KIN).join(first, "symbol", "left_semi")
    return similar_series(series, "new", [*_KIN], _SIMILAR).select("factor", rounded("corr").alias("corr"), "pairs")


def _similar_sql() -> str:
    inner = expressions_sql(LI_SQL, _NEW | _KIN, None)
    one = lambda n: f"SELECT '{n}' AS factor, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS c, count(*) AS pairs FROM (SELECT new AS x, {n} AS y FROM own WHERE new IS NOT NULL AND {n} IS NOT NULL)"
    return f"WITH f AS ({inner}), own AS (SELECT * FROM f WHERE symbol = (SELECT min(symbol) FROM f)) SELECT factor, round(c, 6) + 0.0 AS corr, pairs FROM ({' UNION ALL '.join(map(one, _KIN))}) WHERE c > {_SIMILAR}"


put("sim_retrieval", _similar, _similar_sql())
