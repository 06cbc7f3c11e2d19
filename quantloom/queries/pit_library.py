"""Queries of point-in-time, library and validation operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pit
from ..plans import expression, factor_code, factors, library, validate
from .catalogue import put, rounded
from .sql import expressions_sql
from .tables import EV_SQL, LI_SQL, ev_panel, li_panel, read

FLOWS, BALANCES = ["is_total_revenue", "is_n_income_attr_p"], ["bs_total_assets"]


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("qs"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    q = q.groupBy("k", "qs").agg(F.sum("c").alias("c"))
    return q.select(
        F.col("k").cast("string").alias("symbol"), "k", F.date_sub(F.add_months("qs", 3), 1).alias("date"), F.concat(F.year("qs"), F.lit("q"), F.quarter("qs")).alias("quarter"), F.quarter("qs").alias("n"),
        F.sum("c").over(Window.partitionBy("k", F.year("qs")).orderBy("qs")).alias("ytd"), F.sum("c").over(Window.partitionBy("k").orderBy("qs")).alias("total"),
    ).withColumn("available", F.date_add("date", (F.lit(30) + F.col("k") % 60).cast("int")))


def base_statements(spark: SparkSession, d: str) -> DataFrame:
    q = _quarters(spark, d)
    row = lambda adjusted, late, more: (F.lit(adjusted).alias("if_adjusted"), F.date_add("available", late).alias("available_date"), ((F.col("ytd") + more) / 100.0).alias("is_total_revenue"), ((F.col("ytd") - 30 * F.col("total") / 100) / 1000.0).alias("is_n_income_attr_p"))
    return q.select("symbol", "date", "quarter", *row(0, 0, 0)).union(q.where("k % 5 = 0 and n = 4").select("symbol", "date", "quarter", *row(1, 200, 100)))


def extended_statements(spark: SparkSession, d: str) -> DataFrame:
    q = _quarters(spark, d).where("k % 4 <> 0")
    return q.select("symbol", "date", "quarter", F.lit(0).alias("if_adjusted"), F.date_add("available", (F.col("k") % 3).cast("int")).alias("available_date"), (F.col("total") / 100.0).alias("bs_total_assets"))


def calendar(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    span = days.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence("a", F.date_add("b", 400))).alias("nature_date"))
    own = span.join(days, F.col("nature_date") == F.col("d"), "left")
    # one row a day
    ahead = Window.orderBy("nature_date").rowsBetween(1, Window.unboundedFollowing)
    return own.select("nature_date", F.min("d").over(ahead).alias("next_trade_date"), F.col("d").isNotNull().cast("int").alias("is_trade"))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return pit.merge_statements(base_statements(spark, d), extended_statements(spark, d))


def statements(spark: SparkSession, d: str) -> DataFrame:
    out = pit.activate(merged(spark, d), calendar(spark, d), strict=False).where("activation_date is not null")
    return out.withColumn("report_ordinal", pit.report_ordinal(F.col("quarter")))


_FU = """q0 AS (SELECT o_custkey AS k, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS qs, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c FROM orders GROUP BY 1, 2),
q AS (SELECT CAST(k AS VARCHAR) AS symbol, k, CAST(qs + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS date, year(qs) || 'q' || quarter(qs) AS quarter, quarter(qs) AS n, year(qs) * 4 + quarter(qs) - 1 AS ordinal,
  sum(c) OVER (PARTITION BY k, year(qs) ORDER BY qs) AS ytd, sum(c) OVER (PARTITION BY k ORDER BY qs) AS total FROM q0),
base AS (SELECT symbol, date, quarter, ordinal, 0 AS if_adjusted, date + CAST(30 + k % 60 AS INTEGER) AS available_date, ytd / 100.0 AS is_total_revenue, (ytd - 30 * total / 100) / 1000.0 AS is_n_income_attr_p FROM q
  UNION ALL SELECT symbol, date, quarter, ordinal, 1, date + CAST(230 + k % 60 AS INTEGER), (ytd + 100) / 100.0, (ytd - 30 * total / 100) / 1000.0 FROM q WHERE k % 5 = 0 AND n = 4),
ext AS (SELECT symbol, date, quarter, 0 AS if_adjusted, date + CAST(30 + k % 60 + k % 3 AS INTEGER) AS available_date, total / 100.0 AS bs_total_assets FROM q WHERE k % 4 <> 0),
m AS (SELECT b.symbol, b.date, b.quarter, b.ordinal, b.if_adjusted, greatest(b.available_date, coalesce(e.available_date, b.available_date)) AS available_date, is_total_revenue, is_n_income_attr_p, bs_total_assets,
  true AS in_base, e.symbol IS NOT NULL AS in_extended, coalesce(b.available_date <> e.available_date, false) AS conflict
  FROM base b LEFT JOIN ext e ON b.symbol = e.symbol AND b.date = e.date AND b.quarter = e.quarter AND b.if_adjusted = e.if_adjusted),
td AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
cal AS (SELECT g.nd AS nature_date, min(td.d) AS next_trade_date FROM (SELECT CAST(unnest(generate_series((SELECT min(d) FROM td), (SELECT max(d) FROM td) + INTERVAL 400 DAY, INTERVAL 1 DAY)) AS DATE) AS nd) g ASOF JOIN td ON td.d > g.nd GROUP BY 1),
st AS (SELECT m.*, next_trade_date AS activation_date FROM m JOIN cal ON cal.nature_date = m.available_date)"""

_SNAP = f"""{_FU},
ev0 AS (SELECT symbol, activation_date, max(ordinal) AS o, max(available_date) AS event_available_date FROM st GROUP BY 1, 2),
ev AS (SELECT symbol, activation_date, event_available_date, max(o) OVER (PARTITION BY symbol ORDER BY activation_date) AS latest FROM ev0),
near AS (SELECT ev.*, ev.latest - st.ordinal AS back, st.activation_date AS a, st.available_date AS v, st.is_total_revenue AS r, st.is_n_income_attr_p AS i, st.bs_total_assets AS b,
  row_number() OVER (PARTITION BY ev.symbol, ev.activation_date, st.ordinal ORDER BY st.activation_date DESC, st.available_date DESC) AS n
  FROM ev JOIN st ON st.symbol = ev.symbol AND st.activation_date <= ev.activation_date AND st.ordinal BETWEEN ev.latest - 4 AND ev.latest),
w AS (SELECT symbol, activation_date, event_available_date, latest, max(CASE WHEN back = 0 THEN v END) AS v0,
  {", ".join(f"max(CASE WHEN back = {k} THEN {x} END) AS {x}{k}" for x in "rib" for k in range(5))} FROM near WHERE n = 1 GROUP BY 1, 2, 3, 4),
sq AS (SELECT *, {", ".join(f"CASE WHEN (latest - {k}) % 4 = 0 THEN {x}{k} ELSE {x}{k} - {x}{k + 1} END AS {x}s{k}" for x in "ri" for k in range(4))} FROM w),
snap AS (SELECT symbol, activation_date, event_available_date, v0 AS report_available_date, latest AS report_ordinal, CAST(latest // 4 AS INTEGER) AS report_year, CAST(latest % 4 + 1 AS INTEGER) AS report_quarter,
  {", ".join(f"{x}0 AS {n}_ytd, {x}s0 AS {n}_sq, {x}s0 + {x}s1 + {x}s2 + {x}s3 AS {n}_ttm, CASE WHEN abs({x}4) >= 1e-12 THEN {x}0 / {x}4 - 1 END AS {n}_yoy" for x, n in zip("ri", FLOWS, strict=True))},
  b0 AS bs_total_assets_latest, CASE WHEN abs(b4) >= 1e-12 THEN b0 / b4 - 1 END AS bs_total_assets_yoy FROM sq)"""
_STATE = [f"{f}_{s}" for f in FLOWS for s in ("ytd", "sq", "ttm", "yoy")] + ["bs_total_assets_latest", "bs_total_assets_yoy"]
_META = ["event_available_date", "report_available_date", "report_ordinal", "report_year", "report_quarter"]


def snaps(spark: SparkSession, d: str) -> DataFrame:
    return pit.snapshots(statements(spark, d), FLOWS, BALANCES)


def market(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_custkey").cast("string").alias("symbol")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("market_value"))


def attached(spark: SparkSession, d: str) -> DataFrame:
    """The market with each symbol's state as of the date, fields prefixed by ``fund_``."""
    state = snaps(spark, d)
    named = state.select("symbol", "activation_date", *(F.col(c).alias(f"fund_{c}") for c in [*_META, *_STATE]))
    return pit.asof_join(market(spark, d), named, on="activation_date")


def panel(spark: SparkSession, d: str) -> DataFrame:
    return pit.ratio_features(pit.age_features(attached(spark, d), "statement", "fund_report_available_date", "activation_date"))


_MARKET = "fm AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS symbol, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS market_value FROM orders GROUP BY 1, 2)"
_ATTACHED = f"{_SNAP}, {_MARKET}, att AS (SELECT fm.date, fm.symbol, fm.market_value, snap.activation_date, {', '.join(f'snap.{c} AS fund_{c}' for c in [*_META, *_STATE])} FROM fm ASOF LEFT JOIN snap ON fm.symbol = snap.symbol AND fm.date >= snap.activation_date)"
_ratio = lambda a, b: f"CASE WHEN abs({b}) > 1e-12 THEN ({a}) / {b} END"
_inputs = {"market_value", *(f"fund_{c}" for c in _STATE)}
_RATIOS = {f"fund_{k}": _ratio(a, b) for k, (a, b) in pit.RATIOS.items() if {a, b} <= _inputs}
_RATIOS |= {f"fund_{k}": _ratio(f"{a} * (CASE WHEN fund_report_quarter BETWEEN 1 AND 4 THEN 4.0 / fund_report_quarter END)", b) for k, (a, b) in pit.ANNUAL.items() if {a, b} <= _inputs}
_PANEL = f"{_ATTACHED}, panel AS (SELECT *, CAST(date - fund_report_available_date AS FLOAT) AS statement_age_days, CAST(coalesce(date = activation_date, false) AS TINYINT) AS statement_event_today, {', '.join(f'{c} AS {k}' for k, c in _RATIOS.items())} FROM att)"
_r = lambda cs: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cs)

put("pit_activation", lambda s, d: pit.activate(base_statements(s, d), calendar(s, d), strict=False).select("symbol", "quarter", "if_adjusted", "available_date", "activation_date"),
    f"WITH {_FU} SELECT symbol, quarter, if_adjusted, available_date, next_trade_date AS activation_date FROM base LEFT JOIN cal ON nature_date = available_date")
put("pit_merge_sources", lambda s, d: merged(s, d).select("symbol", "date", "quarter", "if_adjusted", "available_date", rounded("is_total_revenue").alias("is_total_revenue"), rounded("bs_total_assets").alias("bs_total_assets"), "in_base", "in_extended", "conflict"),
    f"WITH {_FU} SELECT symbol, date, quarter, if_adjusted, available_date, {_r(['is_total_revenue', 'bs_total_assets'])}, in_base, in_extended, conflict FROM m")
put("pit_alignment", lambda s, d: pit.alignment(merged(s, d)),
    f"WITH {_FU} SELECT count(*) FILTER (in_extended) AS in_both, count(*) FILTER (NOT in_extended) AS base_only, 0 AS extended_only, count(*) FILTER (conflict) AS availability_conflicts FROM m")
put("pit_snapshots", lambda s, d: snaps(s, d).select("symbol", "activation_date", *_META, *(rounded(c).alias(c) for c in _STATE)), f"WITH {_SNAP} SELECT symbol, activation_date, {', '.join(_META)}, {_r(_STATE)} FROM snap")
_fund = [f"fund_{c}" for c in _STATE]
put("pit_asof", lambda s, d: attached(s, d).select("date", "symbol", "activation_date", "fund_report_ordinal", *(rounded(c).alias(c) for c in _fund)), f"WITH {_ATTACHED} SELECT date, symbol, activation_date, fund_report_ordinal, {_r(_fund)} FROM att")
put("pit_age_flags", lambda s, d: panel(s, d).select("date", "symbol", "statement_age_days", "statement_event_today"), f"WITH {_PANEL} SELECT date, symbol, statement_age_days, statement_event_today FROM panel")
put("pit_ratios", lambda s, d: panel(s, d).select("date", "symbol", *(rounded(c, 5).alias(c) for c in _RATIOS)), f"WITH {_PANEL} SELECT date, symbol, {_r(_RATIOS).replace(', 6)', ', 5)')} FROM panel")
_covered = [*_fund, *_RATIOS]
_COVER = lambda by: " UNION ALL ".join(f"SELECT {by}'{c}' AS field, count(*) AS rows, count({c}) AS nonnull_rows, count({c}) FILTER (isfinite({c})) AS finite_rows, round(count({c}) / count(*), 6) AS nonnull_rate FROM panel{' GROUP BY 1' if by else ''}" for c in _covered)
_cols = ["field", "rows", "nonnull_rows", "finite_rows"]
put("pit_coverage", lambda s, d: pit.coverage(panel(s, d), _covered).select(*_cols, rounded("nonnull_rate").alias("nonnull_rate")), f"WITH {_PANEL} {_COVER('')}")
put("pit_coverage_by_year", lambda s, d: pit.coverage(panel(s, d), _covered, [F.year("date").alias("year")]).select("year", *_cols, rounded("nonnull_rate").alias("nonnull_rate")), f"WITH {_PANEL} {_COVER('year(date) AS year, ')}")
put("catalog_filter", lambda s, d: pit.least_coverage(pit.coverage(panel(s, d), _covered, [F.year("date").alias("year")]), s.createDataFrame([(y,) for y in range(1995, 2002)], "year int")).select("field", rounded("min_rate").alias("min_rate"), (F.col("min_rate") < 0.2).alias("excluded")),
    f"WITH {_PANEL}, c AS ({_COVER('year(date) AS year, ')}), y AS (SELECT unnest(generate_series(1995, 2001)) AS year), f AS (SELECT DISTINCT field FROM c) SELECT f.field, round(min(coalesce(nonnull_rate, 0)), 6) AS min_rate, min(coalesce(nonnull_rate, 0)) < 0.2 AS excluded FROM f CROSS JOIN y LEFT JOIN c ON c.field = f.field AND c.year = y.year GROUP BY 1")
put("pit_quality_gate", lambda s, d: pit.quality_gate(panel(s, d), market(s, d), "activation_date", ["fund_book_to_market", "fund_roa_ttm"]),
    f"WITH {_PANEL} SELECT (SELECT count(*) FROM panel) = (SELECT count(*) FROM fm) AS rows_match, (SELECT count(*) FROM panel) = (SELECT count(*) FROM (SELECT DISTINCT date, symbol FROM panel)) AS keys_unique, (SELECT count(*) FROM panel WHERE activation_date > date) = 0 AS no_future, false AS features_present")
put("pit_forecast_midpoint", lambda s, d: read(s, d, "orders").select("o_orderkey", rounded(pit.midpoint(F.when(F.col("o_orderkey") % 3 != 0, F.floor("o_totalprice")), F.when(F.col("o_orderkey") % 5 != 0, F.ceil("o_totalprice")))).alias("mid")),
    "SELECT o_orderkey, round(coalesce((lo + hi) / 2, lo, hi), 6) + 0.0 AS mid FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice) END AS lo, CASE WHEN o_orderkey % 5 <> 0 THEN ceil(o_totalprice) END AS hi FROM orders)")

# factor libraries: a record for each nation and market segment


def records(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg((F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) / F.count("*") / 1e6).alias("x"), F.count("*").alias("n"))
    k = F.col("c_nationkey")
    x = F.col("x")
    out = c.select(
        (k * 100 + F.ascii("c_mktsegment")).cast("long").alias("seq"), F.concat(F.when(k == 3, "seed_").otherwise("f_"), k, F.lit("_"), F.lower("c_mktsegment")).alias("name"), F.concat(F.lit("code "), k).alias("code"), F.substring(F.md5(F.concat(F.lit("code "), k % 10).cast("binary")), 1, 8).alias("hash"),
        F.create_map(F.lit("IC"), x / 3, F.lit("ICIR"), x - 0.2, F.lit("RankICIR"), x - 0.1, F.lit("O-ICIR"), (x - 0.2) * 0.9, F.lit("O-RankICIR"), x - 0.15, F.lit("O-HybridICIR"), F.when(k == 7, F.lit(float("nan"))).when(k != 9, x - 0.22)).alias("metric"),
        F.when(k % 6 == 5, "similar").otherwise("effective").alias("status"), (k % 4 != 1).alias("direction_consistent"),
    )
    return out


_REC = """rec AS (SELECT c_nationkey * 100 + ascii(c_mktsegment) AS seq, (CASE WHEN c_nationkey = 3 THEN 'seed_' ELSE 'f_' END) || c_nationkey || '_' || lower(c_mktsegment) AS name, substr(md5('code ' || (c_nationkey % 10)), 1, 8) AS hash, c_nationkey AS k,
  x / 3 AS ic, x - 0.2 AS icir, x - 0.1 AS ricir, (x - 0.2) * 0.9 AS oicir, x - 0.15 AS oricir, CASE WHEN c_nationkey = 7 THEN CAST('nan' AS DOUBLE) WHEN c_nationkey <> 9 THEN x - 0.22 END AS oh,
  CASE WHEN c_nationkey % 6 = 5 THEN 'similar' ELSE 'effective' END AS status, c_nationkey % 4 <> 1 AS direction_consistent
  FROM (SELECT c_nationkey, c_mktsegment, sum(CAST(round(c_acctbal * 100) AS BIGINT)) / count(*) / 1e6 AS x FROM customer GROUP BY 1, 2))"""
_EFF = f"{_REC}, eff AS (SELECT * FROM rec WHERE status = 'effective' AND name NOT LIKE 'seed\\_%' ESCAPE '\\')"
_JUDGED = f"""{_REC}, ret AS (SELECT *, CASE WHEN icir > 0 AND ricir > 0 THEN oicir / icir END AS pr, CASE WHEN icir > 0 AND ricir > 0 THEN oricir / ricir END AS rr FROM rec),
j AS (SELECT *, least(pr, rr) AS worst, list_filter([CASE WHEN oh IS NULL THEN 'missing_or_invalid_metric:O-HybridICIR' END, CASE WHEN isnan(oh) THEN 'nonfinite_metric:O-HybridICIR' END, CASE WHEN status <> 'effective' THEN 'status_not_effective' END,
  CASE WHEN NOT direction_consistent THEN 'direction_inconsistent' END, CASE WHEN oh < 0.2 AND NOT isnan(oh) THEN 'o_hybrid_icir_below_threshold' END, CASE WHEN icir <= 0 THEN 'nonpositive_insample_metric:ICIR' END, CASE WHEN ricir <= 0 THEN 'nonpositive_insample_metric:RankICIR' END,
  CASE WHEN least(pr, rr) < 0.9 - 1e-12 THEN 'decay_above_threshold' END], lambda r: r IS NOT NULL) AS reasons FROM ret)"""
_FILTER = library.LibraryFilter(0.2, 0.1)
_metric = lambda n: rounded(library.metric(n)).alias("value")
put("lib_effective", lambda s, d: library.effective(records(s, d)).select("name", "hash", _metric("ICIR")), f"WITH {_EFF} SELECT name, hash, round(icir, 6) + 0.0 AS value FROM eff")
put("lib_dedupe_best", lambda s, d: library.best_of_each(library.effective(records(s, d))).select("name", "hash", _metric("ICIR")), f"WITH {_EFF} SELECT name, hash, round(icir, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY icir DESC NULLS LAST, seq) AS n FROM eff) WHERE n = 1")
put("lib_topn", lambda s, d: library.best(records(s, d), 7, "RankICIR").select("name", _metric("RankICIR")), f"WITH {_REC} SELECT name, round(ricir, 6) + 0.0 AS value FROM rec ORDER BY ricir DESC NULLS LAST, seq LIMIT 7")
put("lib_best", lambda s, d: library.best(records(s, d)).select("name", _metric("ICIR")), f"WITH {_REC} SELECT name, round(icir, 6) + 0.0 AS value FROM rec ORDER BY icir DESC NULLS LAST, seq LIMIT 1")
put("lib_filter", lambda s, d: library.judged(records(s, d), _FILTER).select("name", "kept", F.array_join("reasons", "|").alias("reasons"), rounded("worst_retention").alias("worst_retention"), rounded("decay").alias("decay")),
    f"WITH {_JUDGED} SELECT name, len(reasons) = 0 AS kept, array_to_string(reasons, '|') AS reasons, round(worst, 6) + 0.0 AS worst_retention, round(1 - worst, 6) + 0.0 AS decay FROM j")
put("lib_filter_reasons", lambda s, d: library.reason_counts(library.judged(records(s, d), _FILTER)), f"WITH {_JUDGED} SELECT r AS reason, count(*) AS count FROM (SELECT unnest(reasons) AS r FROM j) GROUP BY 1")
_KNOWN = lambda s: s.createDataFrame([("f_2_building", "f_0_building", 0.9), ("f_4_machinery", "f_0_building", 0.7)], "a string, b string, corr double")
put("factorset_status", lambda s, d: library.admission_status(records(s, d), _KNOWN(s), library.Admission(mode="hybrid")).select("name", "verdict"),
    f"WITH {_REC} SELECT name, CASE WHEN NOT (icir >= 0.2 AND ricir >= 0.2 AND direction_consistent) THEN 'invalid' WHEN name = 'f_2_building' THEN 'similar' ELSE 'effective' END AS verdict FROM rec")

# checks of factors

_CHECKED = "intraday_reversal_liquidity"


def _value(frame: DataFrame) -> DataFrame:
    return factors.compute(frame, [_CHECKED]).withColumnRenamed(_CHECKED, "value")


_VALUE = expressions_sql(LI_SQL, {"value": factors.formula(_CHECKED)}, None)
put("val_nonnull_rate", lambda s, d: validate.nonnull_rate(_value(li_panel(s, d))).select(rounded("rate").alias("rate"), "enough"), f"WITH v AS ({_VALUE}) SELECT round(count(value) / count(*), 6) + 0.0 AS rate, count(value) / count(*) >= 0.01 AS enough FROM v")
put("val_scale", lambda s, d: validate.scale_spread(_value(li_panel(s, d))).select(rounded("low", 4).alias("low"), rounded("high", 4).alias("high"), "comparable"),
    f"WITH v AS ({_VALUE}), s AS (SELECT stddev_samp(value) AS s FROM v GROUP BY symbol), q AS (SELECT quantile_cont(s, 0.01) AS low, quantile_cont(s, 0.99) AS high FROM s) SELECT round(low, 4) + 0.0 AS low, round(high, 4) + 0.0 AS high, high / low < 100 AS comparable FROM q")
put("val_truncation", lambda s, d: validate.truncation(li_panel(s, d), _value).select("compared", "same"), f"WITH v AS ({_VALUE}) SELECT count(*) AS compared, true AS same FROM v WHERE date <= (SELECT max(date) FROM v) - 100")
put("val_order", lambda s, d: validate.order(li_panel(s, d), _value).select("compared", "same"), f"WITH v AS ({_VALUE}) SELECT count(*) AS compared, true AS same FROM v")

# factor code in Python

_SYMBOL_CODE = """
def close_vwap_gap(data, window=5):
    gap = data["close"] / (data["vwap"].abs() + 1e-8) - 1
    return gap.groupby(level="symbol").rolling(window, min_periods=2).mean().droplevel(0)
"""
_PANEL_CODE = """
def demeaned(data):
    gap = data["close"] - data["open"]
    return gap - gap.groupby(level="time").transform("mean")
"""
put("udf_symbol_map", lambda s, d: factor_code.run_per_symbol(li_panel(s, d), _SYMBOL_CODE).select("date", "symbol", rounded(F.col("value").cast("double"), 4).alias("value")),
    f"SELECT date, symbol, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) + 0.0 AS value FROM ({expressions_sql(LI_SQL, {'value': factors.formula('example_close_vwap_gap')}, None)})")
put("udf_panel_map", lambda s, d: factor_code.run_per_date(ev_panel(s, d), _PANEL_CODE).select("date", "symbol", rounded(F.col("value").cast("double"), 3).alias("value")),
    f"WITH {EV_SQL} SELECT date, symbol, round(CAST(CAST(close - open - avg(close - open) OVER (PARTITION BY date) AS FLOAT) AS DOUBLE), 3) + 0.0 AS value FROM ev")
_FIELDS = ("open", "high", "low", "close", "volume", "vwap")
# The fields that each shipped factor reads and how many rows it looks back at most.
_FACTOR_FIELDS = """
('congestion_effort_result', 'close,high,low,open,volume', 23), ('vwap_dislocation_volume_reversal', 'close,high,low,volume,vwap', 20), ('churn_inefficiency', 'close,volume', 30),
('gap_rejection_volume', 'close,open,volume', 25), ('close_location_volume_pressure', 'close,high,low,volume', 23), ('compressed_breakout_quality', 'close,high,low,volume', 24),
('persistent_range_volume_trend', 'close,high,low,volume', 23), ('turnover_displacement_friction', 'close,high,low,volume', 23), ('intraday_reversal_liquidity', 'close,high,low,open,volume', 23),
('conviction_instability_turnover', 'close,high,low,open,volume', 23), ('example_close_vwap_gap', 'close,vwap', 5), ('macd', 'close', 35), ('price_volume_correlation', 'close,volume', 100), ('volatility', 'close', 31),
('volume_spike', 'volume', 10), ('price_drawdown', 'close', 60), ('amplitude', 'high,low', 10), ('dry_run_hybrid_value_momentum', 'close,fundamental', 5), ('dry_run_close_to_vwap_gap', 'close,vwap', 5)
"""


def _expr_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields that each factor reads, how far it looks back, and how many values of the field the panel has."""
    trees = {n: expression.parse(factors.formula(n)) for n in factors.FACTORS}
    read_by = spark.createDataFrame([(n, f, expression.longest_look_back(t)) for n, t in trees.items() for f in sorted(expression.fields_of(t))], "factor string, field string, look_back int")
    counts = li_panel(spark, d).agg(*(F.count(f).alias(f) for f in _FIELDS)).select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in _FIELDS))))
    return read_by.join(F.broadcast(counts), "field", "left").select("factor", "field", "look_back", F.coalesce("values", F.lit(0)).alias("values"))


put(
    "expr_fields", _expr_fields,
    f"WITH {LI_SQL}, c AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, count({f}) AS n FROM p" for f in _FIELDS)}), v AS (SELECT factor, unnest(string_split(fields, ',')) AS field, look_back FROM (VALUES {_FACTOR_FIELDS}) t(factor, fields, look_back)) "
    "SELECT factor, field, look_back, coalesce(n, 0) AS values FROM v LEFT JOIN c USING (field)",
)
