import datetime as dt

import pandas as pd
import pytest

from quantloom.plans import expression as X
from quantloom.plans import factors


def panel(spark, values: dict[str, list], symbols: int = 1):
    n = len(next(iter(values.values())))
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), f"s{k}", *(float(v[i]) if v[i] is not None else None for v in values.values())) for k in range(symbols) for i in range(n)]
    return spark.createDataFrame(rows, "date date, symbol string, " + ", ".join(f"{c} double" for c in values))


def column(spark, text, **values):
    out = X.evaluate(panel(spark, values), {"v": text}).orderBy("date").collect()
    return [r.v for r in out]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("delta(close, -1)", "FUTURE"), ("delay(close, -2)", "FUTURE"), ("pct_change(close, -1)", "FUTURE"), ("price + 1", "KEY"), ("nosuch(close)", "KEY"), ("close +", "EXEC"), ("__import__('os')", "KEY"), ("close.x", "EXEC"), ("ts_mean(close, 0)", "EXEC"), ("ts_mean(close)", "EXEC"), ("ts_mean(close, 2.5)", "EXEC"), ("[close]", "EXEC"), ("lambda: 1", "EXEC"), ("close if close else 1", "EXEC")],
)
def test_refused(text, kind):
    with pytest.raises(X.ExpressionError) as e:
        X.parse(text, {"close", "volume"})
    assert e.value.kind == kind


def test_fields_and_look_back():
    node = X.parse("rank(ts_mean(delta(close, 3), 5)) - adv(10) + returns()")
    assert X.fields_of(node) == {"close", "volume"} and X.longest_look_back(node) == 10
    assert X.parse("open_ + np.log(close)", {"open", "close"}) == X.Call("add", (X.Field("open"), X.Call("log", (X.Field("close"),))))


def test_missing_values_and_positions(spark):
    x = [1, 3, None, 3, 2, 5]
    assert column(spark, "ts_argmax(x, 3)", x=x) == [0, 0, 0, 1, 2, 0]
    assert column(spark, "returns_pad(x)", x=[1, 3, None, 3]) == [None, 2, 0, 0]
    assert column(spark, "pct_change(x)", x=[1, 3, None, 3]) == [None, 2, None, None]
    assert column(spark, "ts_rank(x, 3)", x=[1, 1, 2, None]) == [1, 0.75, 1, None]
    assert column(spark, "decay_linear(x, 2)", x=[3, 6, None, 3]) == [None, 5, None, None]
    assert column(spark, "ts_std(x, 3)", x=[2, 2, None])[:2] == [None, 0]
    assert column(spark, "ewm(x, 3)", x=[1, None, 3]) == pytest.approx([1, 1, 2.6])


def test_nothing_infinite(spark):
    assert column(spark, "x / y", x=[1, 0, 4], y=[0, 0, 2]) == [None, None, 2]
    assert column(spark, "log(x)", x=[0, -1, 1]) == [None, None, 0]
    assert column(spark, "power(x, -1)", x=[0, 2, None]) == [None, 0.5, None]
    assert column(spark, "correlation(x, y, 3)", x=[1, 1, 1], y=[1, 2, 3]) == [None, None, None]
    assert column(spark, "min(x, y)", x=[1, None, 2], y=[3, 1, 1]) == [1, None, 1]
    assert column(spark, "clip(x, 0, 1)", x=[-1, None, 2]) == [0, None, 1]


def test_rolling_like_pandas(spark):
    x = [1, 5, None, 2, 2, 8, 1, None, 4, 3]
    s = pd.Series(x, dtype=float)
    for text, want in {"mean(x, 3, 2)": s.rolling(3, min_periods=2).mean(), "std(x, 4)": s.rolling(4).std(), "sum(x, 3, 1)": s.rolling(3, min_periods=1).sum(), "ts_zscore(x, 4)": (s - s.rolling(4, min_periods=1).mean()) / s.rolling(4, min_periods=2).std()}.items():
        got = pd.Series(column(spark, text, x=x), dtype=float)
        pd.testing.assert_series_equal(got, want, check_names=False)


def test_order_of_rows_changes_nothing(spark):
    frame = panel(spark, {"close": [3, 1, 4, 1, 5, 9, 2, 6], "volume": [1, 2, 3, 4, 5, 6, 7, 8]}, 3)
    run = lambda f: sorted(map(tuple, X.evaluate(f, {"v": "rank(delta(close, 2)) * ts_mean(volume, 3)"}).collect()), key=str)
    assert run(frame) == run(frame.repartition(5))


def test_every_factor_parses():
    for name in factors.FACTORS:
        assert X.fields_of(X.parse(factors.formula(name)))


def test_long_windows_take_running_sums(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 220
    x, y = 1e6 + rng.normal(size=n).cumsum(), rng.normal(size=n)
    x[60:140] = x[60]  # a constant window has no correlation
    x[[5, 170]] = np.nan
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "a", None if np.isnan(x[i]) else float(x[i]), float(y[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, "date date, symbol string, close double, volume double")
    out = X.evaluate(frame, {"r": "correlation(close, volume, 40, 20)", "c": "covariance(close, volume, 40)"}).orderBy("date").toPandas()
    a, b = pd.Series(np.where(np.isnan(x), np.nan, x)), pd.Series(np.where(np.isnan(x), np.nan, y))
    want = a.rolling(40, 20).corr(b)
    constant = a.rolling(40, 1).max() == a.rolling(40, 1).min()
    assert out.r[constant].isna().all() and constant.sum() > 30
    assert np.allclose(out.r[~constant].astype(float), want[~constant], rtol=1e-6, atol=1e-8, equal_nan=True)
    assert np.allclose(out.c.astype(float), a.rolling(40, 2).cov(b), rtol=1e-6, atol=1e-7, equal_nan=True)
