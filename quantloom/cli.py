"""Command line: dry runs, library filters and expression evaluation."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.core import DATE, SYMBOL
from .operators import panel as P
from .plans import alpha, catalog, debate, library, scoring
from .plans.expression import evaluate
from .sources import market, sinks


def session(name: str = "quantloom") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def resolve(path: str, config: Path) -> str:
    """A relative path of a configuration: beside it, else in the working folder. URIs stay."""
    if "://" in path or Path(path).is_absolute():
        return path
    beside = config.parent / path
    return str(beside if beside.exists() else Path.cwd() / path)


def ranges(config: dict) -> dict[str, list[str]]:
    """Each metric with the dates that it is taken over."""
    inside, outside = config["insample_time_range"], config["outsample_time_range"]
    names = ("IC", "ICIR", "RankIC", "RankICIR", "HybridICIR")
    return {n: inside for n in names} | {f"O-{n}": outside for n in names}


def prepare(spark: SparkSession, config: dict):
    """Source, catalog and market panel of a configuration."""
    path = market.data_path(config)
    source = market.inspect(spark, path)
    fields = catalog.build(spark, config, source.columns)
    catalog.check_rows(fields, source.rows)
    span = config.get("load_time_range") or [config["insample_time_range"][0], config["outsample_time_range"][1]]
    there = [f for f in fields.allowed if f in source.columns]
    return source, fields, market.load_market(spark, path, columns=there, start=span[0], end=span[1])


def library_paths(config: dict) -> tuple[list[str], str]:
    """Libraries that a search begins with, and the one that it adds to: configured, else named by the environment, else in the working folder."""
    own = config.get("alpha_library_path") or sinks.first_setting("QUANTLOOM_LIBRARY", dotenv=".env") or "factor_library.json"
    listed = config.get("few_shot_library_paths") or []
    if not isinstance(listed, list):
        raise ValueError("few_shot_library_paths must be a list")
    wanted = config.get("few_shot_from_library", bool(config.get("use_alpha_library") or listed))
    return ([*map(str, listed)] or [str(own)] if wanted else []), str(own)


def search(spark: SparkSession, config: dict, out: Path, proposals: list[dict] | None = None) -> dict:
    """Run the search with replayed proposals, write its three result files, and add its factors to the library if one is used."""
    _, fields, panel = prepare(spark, config)
    label = config.get("label_config") or {"preprocess": "cs_zscore"}
    labels = P.labels(panel, label.get("field", "close"), int(label.get("span", 1)), label.get("preprocess")).persist()
    samples = scoring.Samples(tuple(config["insample_time_range"]), tuple(config["outsample_time_range"]))
    mode = scoring.evaluation_mode(config.get("evaluation_mode"), config.get("key_metric"))
    lineage = {"factor_mode": fields.mode, "market_data_manifest_path": config.get("market_data_manifest_path"), "market_data_manifest_sha256": fields.manifest_sha256}
    limits = {k: float(config[c]) for k, c in (("seed_stop", "seed_metric_threshold"), ("icir", "icir_threshold"), ("rank_icir", "rank_icir_threshold"), ("similar", "factor_correlation_threshold")) if config.get(c) is not None}
    factors = debate.FactorSet(panel.persist(), labels, samples, debate.Thresholds(**limits), mode=mode, symbol=config.get("demo_symbol"), lineage=lineage)
    read, own = library_paths(config)
    known = [x for path in read if Path(path).is_file() for x in library.read_json(path)]
    result = debate.run(factors, [debate.Replay(proposals)] if proposals else [], rounds=int(config.get("debate_max_rounds", 4)), seeds=debate.seeds_of(config), library=known)
    best = result["best"]
    if best is not None:
        result["best"] = alpha.summary(factors.backtest(best["name"], best["code"], best.get("arguments")) | {"status": best["status"]})
    if config.get("use_alpha_library"):
        result["library_update"] = library.upsert(spark, own, result["accepted_factors"], metadata=lineage, key_metric=scoring.KEY_METRIC[mode])
    result |= {"catalog": fields.as_dict(), "metric_time_ranges": ranges(config)}
    for name in ("debate_rounds", "accepted_factors"):
        sinks.write_atomically(out / f"{name}.json", result[name])
    sinks.write_atomically(out / "factor_search_result.json", result)
    return result


def dry_run(spark: SparkSession, config: dict, out: Path) -> dict:
    """Inspect the data, build the catalog, score one fixed factor and write the result files; no proposer is asked."""
    source, fields, panel = prepare(spark, config)
    name, text = ("dry_run_hybrid_value_momentum", f"zscore({fields.fundamental[0]}) * pct_change(close, 5)") if fields.fundamental else ("dry_run_close_to_vwap_gap", "mean(close / (abs(vwap) + 0.00000001) - 1, 5, 2)")
    values = evaluate(panel, {"value": text}).agg(F.count("*").alias("rows"), F.count("value").alias("values")).first()
    record = {"name": name, "code": text, "hash": library.content_hash(text, {}), "status": "dry_run", "rows": values["rows"], "values": values["values"]}
    result = {"source": {"columns": source.columns, "rows": source.rows, "format": source.format}, "catalog": fields.as_dict(), "requirement": catalog.requirement(fields), "accepted_factors": [record], "debate_rounds": [], "metric_time_ranges": ranges(config)}
    for key in ("debate_rounds", "accepted_factors"):
        sinks.write_atomically(out / f"{key}.json", result[key])
    sinks.write_atomically(out / "factor_search_result.json", result)
    return result


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quantloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("search", help="search factors as a configuration says")
    run.add_argument("--input", required=True, type=Path)
    run.add_argument("--output")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--proposals", type=Path, help="JSON list of {name, expression} to replay")
    keep = commands.add_parser("filter-library", help="write a filtered factor library and its audit manifest")
    keep.add_argument("--input", required=True, type=Path)
    keep.add_argument("--output", required=True, type=Path)
    keep.add_argument("--manifest", type=Path)
    keep.add_argument("--min-o-hybrid-icir", type=float, default=0.2)
    keep.add_argument("--max-decay", type=float)
    keep.add_argument("--allow-inconsistent-direction", action="store_true")
    one = commands.add_parser("evaluate", help="evaluate an expression over market data into CSV")
    one.add_argument("--data", required=True)
    one.add_argument("--expression", required=True)
    one.add_argument("--output", required=True)
    args = parser.parse_args(arguments)
    spark = session()
    if args.command == "search":
        config = sinks.read_json(args.input)
        for key in ("market_data_path", "market_data_csv_path", "market_data_manifest_path", "alpha_library_path", "seed_factors_json_path", "seed_alphas_json_path"):
            if config.get(key):
                config[key] = resolve(config[key], args.input)
        out = sinks.output_dir(config, args.output)
        result = dry_run(spark, config, out) if args.dry_run else search(spark, config, out, json.loads(args.proposals.read_text()) if args.proposals else None)
        print(json.dumps({"output": str(out), "accepted": len(result["accepted_factors"])}))
    elif args.command == "filter-library":
        how = library.LibraryFilter(args.min_o_hybrid_icir, args.max_decay, not args.allow_inconsistent_direction)
        audit = library.filter_library(spark, args.input, args.output, how, manifest=args.manifest)
        print(json.dumps({k: audit[k] for k in ("source_count", "kept_count", "rejected_count", "rejection_reasons")}))
    else:
        panel = P.densify(market.load_market(spark, args.data, need_bars=False))
        sinks.write_csv(evaluate(panel, {"value": args.expression}).select(DATE, SYMBOL, "value"), args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
