"""Sinks: partitioned panels published atomically, tables, CSV and JSON files with unique names."""

from __future__ import annotations

import json
import os
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import DATE, SYMBOL
from ..plans.library import write_atomically


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(frame: DataFrame, path: str, *, partition_by: list[str] | None = None, compression: str = "zstd") -> str:
    """Write to a staging folder beside ``path`` and rename it there; an existing ``path`` is an error, a failed write leaves nothing."""
    spark = frame.sparkSession
    target, fs = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.tmp-{os.getpid()}-{time.time_ns()}"
    staging = spark._jvm.org.apache.hadoop.fs.Path(staged)
    try:
        writer = frame.write.option("compression", compression)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
        if not fs.rename(staging, target):
            raise OSError(f"{staged} could not be renamed to {path}")
    except BaseException:
        fs.delete(staging, True)
        raise
    return path


def write_panel(panel: DataFrame, path: str, *, compression: str = "zstd") -> DataFrame:
    """``year=/month=`` partitions, sorted by date and symbol; returns their rows, files, bytes and SHA-256. A month is dealt over several files if it is large."""
    dated = panel.withColumns({"year": F.year(DATE), "month": F.month(DATE)})
    # rebalancing splits large months and joins small ones
    dated = dated.hint("rebalance", "year", "month").sortWithinPartitions("year", "month", DATE, SYMBOL)
    publish(dated, path, partition_by=["year", "month"], compression=compression)
    rows = panel.sparkSession.read.parquet(path).groupBy("year", "month").agg(F.count("*").alias("rows"))
    return rows.join(file_digests(panel.sparkSession, path, ["year", "month"]), ["year", "month"]).orderBy("year", "month")


def file_digests(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Files, bytes and SHA-256 of the partitions of a table; of several files the digest is that of their sorted digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(*by, "length", F.sha2("content", 256).alias("own"))
    many = F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("own"))).cast("binary"), 256)
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.when(F.count("*") == 1, F.max("own")).otherwise(many).alias("sha256"))


def write_table(frame: DataFrame, path: str) -> str:
    """One unpartitioned table, for small reports."""
    return publish(frame.coalesce(1), path)


def output_dir(config: dict | None = None, explicit: str | None = None, environment: str = "QUANTLOOM_OUTPUT_DIR") -> Path:
    """The explicit folder, else the one configured, else the environment's, else a new one named by the time."""
    path = explicit or (config or {}).get("output_dir") or os.environ.get(environment)
    out = Path(path) if path else Path(".outputs") / time.strftime("%Y%m%d_%H%M%S")
    out.mkdir(parents=True, exist_ok=True)
    return out


def unique_path(folder: Path, prefix: str, suffix: str) -> Path:
    """The first free name of prefix.suffix, prefix_2.suffix, ..."""
    n = 1
    while (out := folder / (f"{prefix}{suffix}" if n == 1 else f"{prefix}_{n}{suffix}")).exists():
        n += 1
    return out


def write_csv(frame: DataFrame, path: str) -> str:
    frame.write.option("header", True).csv(path)
    return path


def write_json(payload, folder: Path, prefix: str) -> Path:
    return write_atomically(unique_path(folder, prefix, ".json"), payload)


def write_text(text: str, folder: Path, prefix: str, suffix: str = ".txt") -> Path:
    out = unique_path(folder, prefix, suffix)
    out.write_text(text, encoding="utf-8")
    return out


def manifest(panel: DataFrame, path: str, field_groups: dict[str, list[str]], *, calendar: str = "next trading date", partitions: DataFrame | None = None) -> dict:
    """Counts and contract of a panel, in the form that ``plans.catalog`` reads; ``partitions`` is what ``write_panel`` returned."""
    r = panel.agg(F.count("*").alias("rows"), F.count_distinct(SYMBOL).alias("symbols"), F.min(DATE).alias("a"), F.max(DATE).alias("b")).first()
    return {
        "rows": r["rows"], "symbols": r["symbols"], "date_range": {"panel_start": str(r["a"]), "panel_end": str(r["b"])}, "field_groups": field_groups, "artifacts": {"panel_root": path},
        "point_in_time_contract": {"activation_policy": calendar, "fill_policy": "backward as-of", "future_backfill": False},
        "partitions": [] if partitions is None else [x.asDict() for x in partitions.collect()],
    }


def first_setting(*names: str, dotenv: str | Path | None = None) -> str | None:
    """The first of the variables that is not empty in the environment, else in a ``NAME=value`` file."""
    here = dict(os.environ)
    if dotenv and Path(dotenv).is_file():
        for line in Path(dotenv).read_text(encoding="utf-8").splitlines():
            name, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and not name.startswith("#") and not here.get(name.strip(), "").strip():
                here[name.strip()] = value.strip().strip("\"'")
    return next((v for n in names if (v := here.get(n, "").strip())), None)


def remove(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def read_json(path: str | Path) -> dict:
    out = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(out, dict):
        raise ValueError(f"{path} holds no object")
    return out
