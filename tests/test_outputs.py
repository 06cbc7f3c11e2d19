import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quantloom import cli
from quantloom.plans import alpha
from quantloom.sources import sinks
from quantloom.streaming import bars


def _market(spark, days=40):
    rows = [(int((dt.date(2024, 1, 1) + dt.timedelta(days=i)).strftime("%Y%m%d")), s, 10.0 + k + i % 5, 12.0 + k + i % 5, 9.0 + k, 10.5 + k + (i * k) % 4, 100.0 + i) for i in range(days) for k, s in enumerate(("a", "b", "c"))]
    return spark.createDataFrame(rows, "date int, symbol string, open double, high double, low double, close double, volume double")


def test_wide_output(spark):
    panel = _market(spark).withColumn("date", F.to_date(F.col("date").cast("string"), "yyyyMMdd"))
    wide = alpha.compute_wide(panel, [("One two", "delta(close, 1)"), ("one-two", "rank(close)"), ("bad", "delta(close, -1)")])
    assert wide.frame.columns == ["date", "symbol", "alpha_001_one_two", "alpha_002_one_two_2"] and wide.errors["bad"].startswith("FUTURE")
    assert wide.missing().first().asDict() == {"rows": 120, "alpha_001_one_two": 3, "alpha_002_one_two_2": 0}


def test_small_helpers():
    assert alpha.json_of('text ```json\n{"a": [1]}\n``` {"b": 2}') == {"a": [1]} and alpha.json_of('x {"b": 2}', "b") == 2
    with pytest.raises(ValueError):
        alpha.json_of("none")
    good, trace = alpha.repaired({"e": 0}, lambda p: None if p["e"] == 2 else "low", lambda p, _: {"e": p["e"] + 1})
    assert good == {"e": 2} and len(trace) == 3
    assert alpha.repaired({"e": 0}, lambda p: "low", lambda p, _: p, 1)[0] is None
    costs = alpha.Costs({"m": (1.0, 2.0)})
    costs.add("m", 500_000, 250_000)
    assert costs.total() == 1.0
    assert alpha.compact_error("Traceback:\n  other\n  File <factor> line 3\nKeyError: x") == "Traceback:\nFile <factor> line 3\nKeyError: x"
    assert alpha.summary({"name": "a", "value": [1, None]})["value"] == {"count": 2, "missing": 1, "preview": [1, None]}


def test_command_line(spark, tmp_path):
    _market(spark).write.parquet(str(tmp_path / "market"))
    config = {"market_data_path": "market", "insample_time_range": ["2024-01-01", "2024-01-20"], "outsample_time_range": ["2024-01-21", "2024-02-09"], "seed_metric_threshold": 99}
    (tmp_path / "run.json").write_text(json.dumps(config))
    cli.session = lambda name="": spark
    assert cli.main(["search", "--input", str(tmp_path / "run.json"), "--output", str(tmp_path / "dry"), "--dry-run"]) == 0
    out = json.loads((tmp_path / "dry/factor_search_result.json").read_text())
    assert out["source"]["rows"] == 120 and out["catalog"]["mode"] == "ohlcv" and out["accepted_factors"][0]["values"] > 0
    (tmp_path / "proposals.json").write_text(json.dumps([{"name": "p", "expression": "-delta(close, 2)"}]))
    cli.main(["search", "--input", str(tmp_path / "run.json"), "--output", str(tmp_path / "full"), "--proposals", str(tmp_path / "proposals.json")])
    rounds = json.loads((tmp_path / "full/debate_rounds.json").read_text())
    assert rounds[-1]["name"] == "p" and rounds[0]["status"] == "effective" and len(rounds) == 7
    config |= {"use_alpha_library": True, "alpha_library_path": str(tmp_path / "library.json"), "icir_threshold": -9, "factor_correlation_threshold": 2, "examples": [{"name": "seed_x", "code": "close"}], "demo_symbol": "b"}
    (tmp_path / "run.json").write_text(json.dumps(config))
    for turn in range(2):
        cli.main(["search", "--input", str(tmp_path / "run.json"), "--output", str(tmp_path / f"lib{turn}"), "--proposals", str(tmp_path / "proposals.json")])
        result = json.loads((tmp_path / f"lib{turn}/factor_search_result.json").read_text())
        # the second run begins with the factor that the first one added
        assert [r["proposer"] for r in result["debate_rounds"]] == ["seed", *["library"] * turn, 0]
        assert result["library_update"]["after_count"] == 1 and result["best"]["demo_symbol"] == "b" and result["best"]["value"]["count"] == 40
    cli.main(["evaluate", "--data", str(tmp_path / "market"), "--expression", "rank(close)", "--output", str(tmp_path / "csv")])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 120


def test_unique_files(tmp_path):
    assert [sinks.write_text("x", tmp_path, "a").name for _ in range(3)] == ["a.txt", "a_2.txt", "a_3.txt"]


def test_streamed_bars_equal_static_ones(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = bars.bars(spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*"))
    query = bars.start(stream, str(tmp_path / "bars"), str(tmp_path / "state"), once=True)
    query.awaitTermination(120)
    got = {(r.date, r.symbol): (r.open, r.close, r.volume) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "bars")).collect()}
    want = {(r.date, r.symbol): (r.open, r.close, r.volume) for r in bars.bars(events).collect()}
    # the last window stays open
    last = max(d for d, _ in want)
    assert got == {k: v for k, v in want.items() if k[0] < last} or got == want


def test_entry(spark):
    assert {"date", "ic", "rank_ic", "pairs"} == {*__spark_entry__.entry(spark).columns} and __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert {*__spark_entry__.oracle_sql()} <= {*names}


def test_partitions_carry_bytes_and_digests(spark, tmp_path):
    import hashlib

    panel = _market(spark).withColumn("date", F.to_date(F.col("date").cast("string"), "yyyyMMdd"))
    parts = sinks.write_panel(panel, str(tmp_path / "panel"))
    rows = parts.collect()
    assert [(r.year, r.month, r.rows) for r in rows] == [(2024, 1, 93), (2024, 2, 27)]
    for r in rows:
        files = [*(tmp_path / f"panel/year={r.year}/month={r.month}").glob("*.parquet")]
        assert r.bytes == sum(f.stat().st_size for f in files) and r.files == len(files)
        if len(files) == 1:
            assert r.sha256 == hashlib.sha256(files[0].read_bytes()).hexdigest()
    written = sinks.manifest(panel, str(tmp_path / "panel"), {}, partitions=parts)
    assert [x["rows"] for x in written["partitions"]] == [93, 27]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# no=1\nexport QL_A='x y'\nQL_B=\nQL_C=file\n")
    monkeypatch.setenv("QL_C", "own")
    monkeypatch.setenv("QL_D", " ")
    found = lambda *names: sinks.first_setting(*names, dotenv=tmp_path / ".env")
    assert found("QL_B", "QL_A") == "x y" and found("QL_C") == "own" and found("QL_D", "QL_B") is None
    assert sinks.first_setting("QL_A") is None
