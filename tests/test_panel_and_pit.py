import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import panel as P
from quantloom.operators import pit
from quantloom.plans import build_panel
from quantloom.sources import market, sinks

D = dt.date


def test_dates(spark):
    raw = ["20240105", "2024-01-05", "2024/01/05", "20240105.0", " 2024-01-05 ", "x", None, "20241399"]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, d string").select("i", P.lenient_date(F.col("d")).alias("a"), P.strict_date(F.col("d")).alias("b")).orderBy("i").collect()
    assert [r.a for r in out] == [D(2024, 1, 5)] * 5 + [None] * 3 and [r.b for r in out] == [D(2024, 1, 5)] * 5 + [None] * 3
    with pytest.raises(ValueError, match="x"):
        P.require_dates(spark.createDataFrame([("x",)], "d string"), "d")


def test_csv_and_parquet_load_alike(spark, tmp_path):
    rows = [(20240102, "a.sz", "1.5", 3.0), (20240103, "a.sz", "bad", 4.0), (20240104, None, "2", 1.0)]
    frame = spark.createDataFrame(rows, "date int, symbol string, close string, volume double")
    frame.write.parquet(str(tmp_path / "p"))
    frame.coalesce(1).write.option("header", True).csv(str(tmp_path / "m.csv"))
    a = market.load(spark, str(tmp_path / "p"), start="2024-01-02", end="2024-01-03").collect()
    b = market.load(spark, str(tmp_path / "m.csv"), start="2024-01-02", end="2024-01-03").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 2 and {r.close for r in a} == {1.5, None}
    with pytest.raises(ValueError, match="no columns"):
        market.load(spark, str(tmp_path / "p"), columns=["nothing"])
    with pytest.raises(ValueError, match="no rows"):
        market.load(spark, str(tmp_path / "p"), start="2030-01-01")
    assert market.inspect(spark, str(tmp_path / "p")).rows == 3 and market.inspect(spark, str(tmp_path / "m.csv")).rows is None


def test_date_filter_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([(20240102, "a", 1.0)], "date int, symbol string, close double").write.parquet(str(tmp_path / "p"))
    plan = market.load(spark, str(tmp_path / "p"), columns=["close"], start="2024-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,20240101)" in plan


def test_derived_fields(spark):
    frame = spark.createDataFrame([(D(2024, 1, 1), "a", 10.0, 2.0, 0.5), (D(2024, 1, 1), "b", 10.0, 0.0, 0.5)], "date date, symbol string, close double, volume double, adjfactor double")
    code = {r.symbol: (r.amount, r.vwap) for r in P.derive_amount_vwap(frame).collect()}
    matrix = {r.symbol: (r.amount, r.vwap) for r in P.derive_amount_vwap(frame, matrix=True).collect()}
    assert code == {"a": (20.0, 10.0), "b": (0.0, None)} and matrix == {"a": (40.0, 10.0), "b": (0.0, None)}


def test_activation_is_the_next_trading_day(spark):
    cal = spark.createDataFrame([(D(2020, 4, 30), D(2020, 5, 4), 1), (D(2020, 5, 1), D(2020, 5, 4), 0), (D(2020, 5, 4), D(2020, 5, 5), 1)], "nature_date date, next_trade_date date, is_trade int")
    events = spark.createDataFrame([(D(2020, 4, 30),), (D(2020, 5, 1),)], "available_date date")
    assert {r.activation_date for r in pit.activate(events, cal).collect()} == {D(2020, 5, 4)}
    with pytest.raises(ValueError, match="2021-01-01"):
        pit.activate(spark.createDataFrame([(D(2021, 1, 1),)], "available_date date"), cal)


def _statements(spark):
    rows = []
    for q, (r, b) in enumerate(zip([10, 30, 60, 100], [100, 110, 120, 130], strict=True)):
        day = D(2020, 4 + 2 * q, 1)
        rows.append(("a", day, day, 2020 * 4 + q, float(r), float(b)))
    rows.append(("a", D(2021, 3, 1), D(2021, 3, 2), 2019 * 4 + 3, 80.0, 90.0))
    return spark.createDataFrame(rows, "symbol string, available_date date, activation_date date, report_ordinal int, is_revenue double, bs_assets double")


def test_snapshots(spark):
    out = pit.snapshots(_statements(spark), ["is_revenue"], ["bs_assets"]).orderBy("activation_date").collect()
    year, late = out[3], out[4]
    assert (year.is_revenue_ytd, year.is_revenue_sq, year.is_revenue_ttm, year.bs_assets_latest) == (100, 40, 100, 130)
    assert (late.report_ordinal, late.bs_assets_latest, late.is_revenue_ttm) == (2020 * 4 + 3, 130, 100)
    assert year.is_revenue_yoy is None and late.is_revenue_yoy == pytest.approx(0.25)


def test_snapshots_match_a_fold(spark):
    import random

    rng = random.Random(3)
    rows = []
    for s in ("a", "b"):
        for i in range(40):
            o = 8000 + rng.randrange(12)
            day = D(2000, 1, 1) + dt.timedelta(days=rng.randrange(60))
            rows.append((s, day - dt.timedelta(days=rng.randrange(3)), day, o, None if rng.random() < 0.2 else float(rng.randrange(100)), float(i)))
    # one row for each report, availability and activation
    rows = list({r[:4]: r for r in rows}.values())
    schema = "symbol string, available_date date, activation_date date, report_ordinal int, f double, b double"
    out = {(r.symbol, r.activation_date): r for r in pit.snapshots(spark.createDataFrame(rows, schema), ["f"], ["b"]).collect()}
    for s in ("a", "b"):
        state, latest = {}, -1
        for day in sorted({r[2] for r in rows if r[0] == s}):
            for r in sorted((r for r in rows if r[0] == s and r[2] == day), key=lambda r: (r[3], r[1])):
                state[r[3]] = r[4:]
                latest = max(latest, r[3])
            got = out[s, day]

            def single(o):
                now = state.get(o, (None,))[0]
                if o % 4 == 0 or now is None:
                    return now
                before = state.get(o - 1, (None,))[0]
                return None if before is None else now - before

            parts = [single(latest - k) for k in range(4)]
            assert got.report_ordinal == latest and got.f_sq == parts[0]
            assert got.f_ttm == (None if None in parts else sum(parts))
            assert (got.f_ytd, got.b_latest) == state[latest]


def test_asof_never_fills_back(spark):
    left = spark.createDataFrame([(D(2024, 1, i), "a") for i in (1, 2, 3)], "date date, symbol string")
    right = spark.createDataFrame([("a", D(2024, 1, 2), 1.0), ("a", D(2024, 1, 2), None)], "symbol string, activation_date date, fund_value double")
    out = [r.fund_value for r in pit.asof_join(left, right.limit(1), on="activation_date").orderBy("date").collect()]
    assert out == [None, 1.0, 1.0]
    assert pit.asof_attach(left, right.where("false")).columns == left.columns


def test_merge_of_sources(spark):
    key = "symbol string, date date, quarter string, if_adjusted int, available_date date"
    base = spark.createDataFrame([("a", D(2026, 3, 31), "2026q1", 0, D(2026, 4, 20), 5.0)], f"{key}, is_revenue double")
    more = spark.createDataFrame([("a", D(2026, 3, 31), "2026q1", 0, D(2026, 4, 22), 9.0), ("b", D(2026, 3, 31), "2026q1", 0, D(2026, 4, 1), 7.0)], f"{key}, bs_total_assets double")
    merged = pit.merge_statements(base, more)
    assert {r.symbol: r.available_date for r in merged.collect()} == {"a": D(2026, 4, 22), "b": D(2026, 4, 1)}
    assert tuple(pit.alignment(merged).first()) == (1, 0, 1, 1)
    with pytest.raises(ValueError, match="is_revenue"):
        pit.merge_statements(base, base)


def test_ratios(spark):
    row = spark.createDataFrame([(2, 100.0, 10.0, 16.0, 50.0, 90.0, 20.0, 200.0)], "fund_report_quarter int, market_value double, fund_is_n_income_attr_p_ytd double, fund_is_n_income_attr_p_ttm double, fund_is_total_revenue_ytd double, fund_is_total_revenue_ttm double, fund_is_gross_profit_ytd double, fund_bs_total_assets_latest double")
    r = pit.ratio_features(row).first()
    assert (r.fund_earnings_yield_ttm, r.fund_earnings_yield_ytd_ann, r.fund_gross_margin_ytd) == pytest.approx((0.16, 0.20, 0.40))


def test_panel_build_and_files(spark, tmp_path):
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(500)]
    cal = spark.createDataFrame([(a, b, 1) for a, b in zip(days, days[1:], strict=False)], "nature_date date, next_trade_date date, is_trade int")
    bars = spark.createDataFrame([(d, s, 10.0, 11.0, 9.0, 10.0, 5.0) for d in days[::5] for s in ("a", "b")], "date date, symbol string, open double, high double, low double, close double, volume double")
    daily = bars.select("date", "symbol", F.lit(1000.0).alias("market_value"))
    st = _statements(spark).select("symbol", F.col("available_date").alias("date"), F.format_string("%dq%d", F.floor(F.col("report_ordinal") / 4).cast("int"), F.col("report_ordinal") % 4 + 1).alias("quarter"), F.lit(0).alias("if_adjusted"), "available_date", F.col("is_revenue").alias("is_total_revenue"), F.col("bs_assets").alias("bs_total_assets"))
    fc = spark.createDataFrame([("a", D(2020, 2, 1), 1.0, 3.0, None, 2.0, 1.0, None)], "symbol string, available_date date, forecast_np_floor double, forecast_np_ceiling double, forecast_eps_floor double, forecast_eps_ceiling double, forecast_growth_rate_floor double, forecast_growth_rate_ceiling double")
    made = build_panel.build(build_panel.Inputs(bars, cal, st, daily=daily, forecasts=fc))
    manifest = build_panel.write(made, bars, str(tmp_path / "out"))
    assert manifest["rows"] == bars.count() and sum(p["rows"] for p in manifest["partitions"]) == bars.count()
    back = spark.read.parquet(str(tmp_path / "out/panel"))
    row = back.where("symbol = 'a' and date = date'2020-12-26'").first()
    assert row.fund_is_total_revenue_ttm == 100 and row.fund_sales_to_market_ttm == 0.1 and row.fund_forecast_np_mid == 2.0
    assert back.where("symbol = 'b' and fund_report_ordinal is not null").count() == 0
    with pytest.raises(FileExistsError):
        sinks.publish(bars, str(tmp_path / "out/panel"))
