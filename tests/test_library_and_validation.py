import datetime as dt
import json

import pytest

from quantloom.plans import catalog, debate, factor_code, library, scoring, validate
from quantloom.plans.expression import ExpressionError
from quantloom.operators import panel as P


def record(name, icir=0.5, rank=0.5, o=0.4, o_rank=0.4, hybrid=0.4, **more):
    return {"name": name, "code": f"def {name}(data): pass", "hash": name, "metric": {"IC": 0.1, "ICIR": icir, "RankICIR": rank, "O-ICIR": o, "O-RankICIR": o_rank, "O-HybridICIR": hybrid}, "status": "effective", "direction_consistent": True} | more


def test_library_filter(spark, tmp_path):
    rows = [record("edge"), record("weak", hybrid=0.1), record("decayed", o=0.3), record("turned", direction_consistent=False), record("old", status="similar"), record("negative", icir=-0.1), {"name": "bare", "code": "x"}, record("nan", hybrid=float("nan"))]
    source = tmp_path / "library.json"
    source.write_text(json.dumps({"factors": rows}))
    before = source.read_bytes()
    audit = library.filter_library(spark, source, tmp_path / "kept.json", library.LibraryFilter(0.2, 0.2))
    reasons = {d["name"]: d["reasons"] for d in audit["decisions"]}
    assert reasons["edge"] == [] and audit["kept_count"] == 1 and source.read_bytes() == before
    assert reasons["weak"] == ["o_hybrid_icir_below_threshold"] and reasons["decayed"] == ["decay_above_threshold"] and reasons["turned"] == ["direction_inconsistent"]
    assert "nonpositive_insample_metric:ICIR" in reasons["negative"] and reasons["nan"] == ["nonfinite_metric:O-HybridICIR"]
    assert reasons["bare"] == ["missing_metric_object", "status_not_effective", "direction_inconsistent"]
    assert [x["name"] for x in json.loads((tmp_path / "kept.json").read_text())] == ["edge"]
    assert library.filter_library(spark, source, tmp_path / "all.json", library.LibraryFilter(0.2))["kept_count"] == 2
    with pytest.raises(ValueError):
        library.filter_library(spark, source, source)


def test_upsert_keeps_the_best(spark, tmp_path):
    path = tmp_path / "lib.json"
    assert library.upsert(spark, path, [record("a", 0.3), record("seed_x"), record("b", 0.9), record("c", status="invalid")])["after_count"] == 2
    out = library.upsert(spark, path, [record("a", 0.6), record("d", 0.1)], metadata={"source": "test"})
    assert (out["before_count"], out["after_count"], out["added_count"]) == (2, 3, 1)
    assert [(x["name"], x["metric"]["ICIR"]) for x in json.loads(path.read_text())] == [("b", 0.9), ("a", 0.6), ("d", 0.1)]
    broken = tmp_path / "broken.json"
    broken.write_text("{")
    assert library.load(spark, broken).count() == 0
    with pytest.raises(ValueError):
        library.read_json(broken, strict=True)


def test_static_analysis():
    allowed = {"close", "volume", "fund_x"}
    check = lambda body, **k: [kind for kind, _ in factor_code.analyse(f"def f(data, n=-1):\n    return {body}", allowed, **k)[1]]
    assert check("data['close'] * data['fund_x']", mode="hybrid", market={"close", "volume"}) == []
    assert check("data['close']", mode="hybrid", market={"close", "volume"}) == ["KEY"]
    for body in ("data['close'].shift(-1)", "data['close'].shift(n)", "data['close'].pct_change(periods=-2)", "data['close'].bfill()", "data['close'].rolling(3, center=True).mean()", "data['close'].fillna(method='bfill')", "data['close'].interpolate(limit_direction='both')", "np.roll(data['close'], -1)"):
        assert check(body) == ["FUTURE"], body
    assert check("data['nothing']") == ["KEY", "KEY"] and check("1") == ["KEY"]
    assert "EXEC" in check("data['close'].__class__") and check("data['close'") == ["EXEC"]
    assert factor_code.analyse("import os\ndef f(data):\n    return data['close']", allowed)[1][0][0] == "IMPORT"


def _panel(spark, n=150):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), s, 10 + (i * k % 7) * 0.1 + k, 10 + (i * k % 5) * 0.1 + k, float(100 + i % 9)) for i in range(n) for k, s in enumerate(("a", "b", "c", "d"), 1)]
    return spark.createDataFrame(rows, "date date, symbol string, close double, vwap double, volume double")


def test_factor_code_runs_with_its_fields_only(spark):
    code = "def f(data):\n    assert list(data.columns) == ['close']\n    return data['close'].groupby(level='symbol').shift(1)"
    out = factor_code.run(_panel(spark, 5), code)
    assert out.count() == 20 and out.where("value is null").count() == 4
    with pytest.raises(ExpressionError):
        factor_code.run(_panel(spark, 5), "def f(data):\n    return data['close'].shift(-1)")
    whole = factor_code.run(_panel(spark, 5), "def f(data):\n    return data['close'] - data['close'].groupby(level='time').transform('mean') + data['close'].groupby(level='symbol').shift(1)")
    assert whole.where("value is not null").count() == 16
    with pytest.raises(TimeoutError), factor_code.job_limit(spark, 0.3):
        spark.range(10**13).selectExpr("sum(hash(id))").collect()
    assert spark.range(5).count() == 5


@pytest.mark.parametrize(
    ("body", "level"),
    [
        ("data['close'].groupby(level='symbol').shift(1)", "symbol"),
        ("data['close'].groupby('symbol', group_keys=False).apply(lambda x: x.rolling(3).mean())", "symbol"),
        ("data['close'] / (data['close'].groupby(level=1).shift(2) + 1).abs()", "symbol"),
        ("data['close'].groupby(level='time').rank()", "time"),
        ("data['close'].groupby(level='symbol').shift(1) - data['close'].mean()", None),
        ("data['close'].groupby(level='symbol').shift(1) - data['close'].shift(1)", None),
        ("data['close'].groupby(level='symbol').shift(1).unstack().rank(axis=1).stack()", None),
        ("data['close'].groupby(level='symbol').shift(1) + data['close'].groupby(level='time').rank()", None),
        ("data['close'].groupby(lambda k: k[0]).rank() + data['close'].groupby(level='symbol').shift(1)", None),
        ("data['close'] * 2", "symbol"),
        ("data['close'][1:]", None),
        ("data['close'] * len(data)", None),
        ("data['close'].groupby(level='symbol').mean()", None),
        ("np.log(data['close']).clip(0, 1)", "symbol"),
        ("np.mean(data['close'])", None),
    ],
)
def test_code_is_dealt_out_only_where_it_stays_within_a_level(body, level):
    assert factor_code.within(f"def f(data):\n    return {body}") == level


def test_dealt_out_code_equals_whole_code(spark):
    panel = _panel(spark, 12)
    for body in ("data['close'].groupby('symbol', group_keys=False).apply(lambda x: x.rolling(3).mean()) - data['close'].groupby(level='symbol').shift(1)", "data['close'].groupby(level='time').rank()"):
        code = f"def f(data):\n    return {body}"
        rows = [sorted(map(tuple, f(panel, code).collect()), key=str) for f in (factor_code.run, factor_code.run_whole)]
        assert factor_code.within(code) and rows[0] == rows[1]
    with pytest.raises(ExpressionError, match="whole panel"):
        before, factor_code.MOST_WHOLE_ROWS = factor_code.MOST_WHOLE_ROWS, 3
        try:
            factor_code.run(panel, "def f(data):\n    return data['close'] - data['close'].mean()")
        finally:
            factor_code.MOST_WHOLE_ROWS = before


def test_fields_by_computed_names_are_refused():
    for body in ("data[name]", "data.get(name)", "data[['close', name]]", "data['clo' + 'se']"):
        assert "KEY" in {k for k, _ in factor_code.analyse(f"def f(data, name='close'):\n    return {body} + data['close']", {"close"})[1]}
    assert factor_code.analyse("def f(data):\n    return data.get('close') + data[['close']]['close']", {"close"})[1] == []


def test_look_ahead_is_found(spark):
    panel = _panel(spark)
    honest = lambda f: f.selectExpr("date", "symbol", "close as value")
    assert validate.validate(panel, honest) == {}
    assert "FUTURE" in validate.validate(panel, lambda f: f.selectExpr("date", "symbol", "close * (max(unix_date(date)) over (partition by symbol) - 19000) as value"))
    assert "NAN" in validate.validate(panel, lambda f: f.selectExpr("date", "symbol", "cast(null as double) as value"))
    assert "DIMENSION" in validate.validate(panel, lambda f: f.selectExpr("date", "symbol", "if(symbol = 'a', 1e6, 1) * close as value"))


def test_search(spark):
    panel = _panel(spark)
    labels = P.labels(panel, "close", 1).persist()
    factors = debate.FactorSet(panel, labels, scoring.Samples(("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-05-29")), debate.Thresholds(icir=0.0))
    proposals = [{"name": "one", "expression": "-delta(close, 1)"}, {"name": "same", "expression": "-delta(close, 1) * 2"}, {"name": "bad", "expression": "delta(close, -1)"}]
    out = debate.run(factors, [debate.Replay(proposals)], rounds=5, seeds=[])
    assert [r["status"] for r in out["debate_rounds"]] == ["effective", "similar", "invalid"] and out["best"]["name"] == "one"
    assert factors.similar[0]["similar_to"] == ["one"]


def _set(spark, **more):
    panel = _panel(spark)
    return debate.FactorSet(panel, P.labels(panel, "close", 1).persist(), scoring.Samples(("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-05-29")), **more)


def test_search_stops_at_good_seeds(spark):
    class Never:
        def propose(self, context):
            raise AssertionError("a good seed ends the search")

    seeds = [{"name": "s", "expression": "-delta(close, 1)"}]
    out = debate.run(_set(spark, thresholds=debate.Thresholds(seed_stop=-9.0)), [Never()], seeds=seeds)
    assert out["stopped_at_seeds"] and len(out["debate_rounds"]) == 1
    out = debate.run(_set(spark, thresholds=debate.Thresholds(seed_stop=99.0)), [], seeds=seeds)
    assert not out["stopped_at_seeds"] and out["best"]["name"] == "s"


def test_search_repairs_and_takes_library_factors(spark):
    class Mender:
        asked = []

        def propose(self, context):
            return {"name": "p", "expression": "delta(close, -1)"}

        def repair(self, proposal, error):
            self.asked.append(error)
            return proposal | {"expression": "delta(nothing, 1)" if len(self.asked) == 1 else "rank(close)"}

    code = "def f(data, n=1):\n    return -data['close'].groupby(level='symbol').diff(n)"
    library = [{"name": "kept", "factor_code": code, "arguments": {"n": 2}}, {"name": "gone", "code": "delta(missing, 1)"}, {"name": "empty"}]
    factors = _set(spark, thresholds=debate.Thresholds(seed_stop=99.0, icir=-9.0), lineage={"factor_mode": "ohlcv"})
    out = debate.run(factors, [Mender()], rounds=1, seeds=[], library=library)
    assert [x["name"] for x in out["library_failures"]] == ["gone", "empty"] and [r["name"] for r in out["accepted_factors"]] == ["kept", "p"]
    last = out["debate_rounds"][-1]
    assert [a["error"] is None for a in last["repairs"]] == [False, False, True] and Mender.asked[0].startswith("FUTURE") and Mender.asked[1].startswith("KEY")
    record = factors.backtest("kept", code, {"n": 2})
    assert record["demo_symbol"] == "a" and len(record["value"]) == len(record["dates"]) == 150 and record["factor_mode"] == "ohlcv" and record["referenced_fields"] == ["close"]
    assert [n for n, _ in factors.similar_to({"code": "-delta(close, 2) * 3"})] == ["kept"]


def test_search_takes_too_long(spark):
    out = _set(spark, seconds=0.001).add({"name": "slow", "expression": "rank(ts_rank(close, 60))"})
    assert out["status"] == "invalid" and out["error"].startswith("TIME")


def test_seeds(tmp_path):
    assert len(debate.seeds_of({})) == 6
    assert debate.seeds_of({"examples": [{"code": "close", "arguments": {}}]}) == [{"name": "seed_1", "expression": "close", "arguments": {}}]
    (tmp_path / "seeds.json").write_text(json.dumps({"alphas": [{"factor_code": "volume", "name": "v"}, {"name": "none"}, 3]}))
    assert [x["name"] for x in debate.seeds_of({"seed_alphas_json_path": str(tmp_path / "seeds.json")})] == ["v"]
    assert len(debate.seeds_of({"seed_factors_json_path": str(tmp_path / "gone.json")})) == 6


def test_modes():
    assert scoring.evaluation_mode(None) == "pearson_ic" and scoring.evaluation_mode("Spearman") == "rank_ic" and scoring.evaluation_mode(None, "HybridICIR") == "hybrid"
    with pytest.raises(ValueError):
        scoring.evaluation_mode("other")


def test_catalog(spark, tmp_path):
    spark.createDataFrame([("fund_a", 0.9), ("fund_b", 0.1)], "field string, nonnull_rate double").write.parquet(str(tmp_path / "cov"))
    spark.createDataFrame([(2020, "fund_a", 0.9), (2021, "fund_a", 0.8), (2020, "fund_c", 1.0)], "year int, field string, nonnull_rate double").write.parquet(str(tmp_path / "year"))
    manifest = {"rows": 3, "field_groups": {"value": ["fund_a", "fund_b", "fund_c", "fund_gone", "fund_x_available_date"]}, "artifacts": {"field_coverage": "cov", "field_coverage_by_year": "year"}, "point_in_time_contract": {"future_backfill": False}}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(manifest))
    config = {"market_data_manifest_path": str(path), "feature_groups": ["value"], "min_feature_coverage": 0.2, "min_yearly_coverage": 0.2, "insample_time_range": ["2020-01-01", "2021-12-31"]}
    columns = ["date", "symbol", "open", "high", "low", "close", "volume", "fund_a", "fund_b", "fund_c"]
    out = catalog.build(spark, config, columns)
    assert out.fundamental == ["fund_a"] and out.mode == "hybrid" and "vwap" in out.allowed
    assert {x["field"]: x["reason"] for x in out.excluded} == {"fund_b": "overall_coverage_below_threshold", "fund_c": "yearly_coverage_below_threshold", "fund_gone": "missing_from_data", "fund_x_available_date": "point_in_time_metadata"}
    assert "fund_a" in catalog.requirement(out)
    with pytest.raises(ValueError, match="rows"):
        catalog.check_rows(out, 4)
    manifest["point_in_time_contract"] = {}
    path.write_text(json.dumps(manifest))
    with pytest.raises(ValueError, match="future_backfill"):
        catalog.build(spark, config, columns)
    with pytest.raises(ValueError, match="manifest"):
        catalog.build(spark, {"feature_columns": ["fund_a"]}, columns)


def test_similar_factors_across_symbols(spark):
    panel = _panel(spark)
    factors = debate.FactorSet(panel, P.labels(panel, "close", 1), scoring.Samples(("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-05-29")))
    factors.accepted.append({"name": "one", "code": "rank(delta(close, 1))"})
    assert [n for n, _ in factors.similar_to({"code": "rank(delta(close, 1)) * 2"})] == ["one"]
