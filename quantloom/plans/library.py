"""Factor libraries: records as rows, with identity, admission, de-duplication, filtering, and JSON files.

A record has name, code, hash, arguments (map of JSON text), metric (map of numbers), status and source.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "seq long, name string, code string, hash string, arguments map<string,string>, metric map<string,double>, status string, source string, direction_consistent boolean, extra string"
REQUIRED = ("ICIR", "RankICIR", "O-ICIR", "O-RankICIR", "O-HybridICIR")
#: Slack of the comparison with the decay limit.
SLACK = 1e-12
_OWN = ("name", "code", "factor_code", "hash", "arguments", "factor_arguments", "metric", "status", "source", "direction_consistent")


def content_hash(code: str, arguments: dict) -> str:
    """First 8 hex digits of the MD5 of code and arguments."""
    return hashlib.md5((code + json.dumps(arguments, sort_keys=True, default=str)).encode()).hexdigest()[:8]


def metric(name: str) -> Column:
    """A metric's value; NULL if it is missing or not finite."""
    value = F.try_element_at("metric", F.lit(name))
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def effective(records: DataFrame, *, with_seeds: bool = False) -> DataFrame:
    """Records with status effective and finite IC and ICIR; seeds (``seed_``) are left out."""
    keep = (F.lower(F.trim("status")) == "effective") & metric("IC").isNotNull() & metric("ICIR").isNotNull()
    return records.where(keep if with_seeds else keep & ~F.coalesce(F.col("name").startswith("seed_"), F.lit(False)))


def best_of_each(records: DataFrame, key_metric: str = "ICIR") -> DataFrame:
    """Of records with one hash the one with the best metric, the first of equals."""
    order = Window.partitionBy("hash").orderBy(metric(key_metric).desc_nulls_last(), "seq")
    return records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ranked(records: DataFrame, key_metric: str = "ICIR") -> DataFrame:
    return records.orderBy(metric(key_metric).desc_nulls_last(), "seq")


def best(records: DataFrame, n: int = 1, key_metric: str = "ICIR") -> DataFrame:
    return ranked(records, key_metric).limit(n)


@dataclass(frozen=True)
class Admission:
    """Least ICIR and RankICIR, and the correlation beyond which a factor counts as known."""

    icir: float = 0.2
    rank_icir: float = 0.2
    similar: float = 0.8
    mode: str = "pearson_ic"

    def passes(self) -> Column:
        a = F.coalesce(metric("ICIR") >= self.icir, F.lit(False))
        b = F.coalesce(metric("RankICIR") >= self.rank_icir, F.lit(False))
        if self.mode == "hybrid":
            return a & b & F.coalesce("direction_consistent", F.lit(False))
        return a if self.mode == "pearson_ic" else b


def admission_status(records: DataFrame, similar: DataFrame, how: Admission) -> DataFrame:
    """``records`` with ``verdict``: invalid (below the thresholds), similar (to an accepted one), or effective. similar: a, b, corr."""
    near = similar.where(F.col("corr") > how.similar).select(F.col("a").alias("name")).distinct().withColumn("_near", F.lit(True))
    out = records.join(near, "name", "left")
    return out.withColumn("verdict", F.when(~how.passes(), "invalid").when(F.col("_near"), "similar").otherwise("effective")).drop("_near")


@dataclass(frozen=True)
class LibraryFilter:
    min_o_hybrid: float = 0.2
    max_decay: float | None = None
    direction_consistent: bool = True

    def __post_init__(self):
        if not math.isfinite(self.min_o_hybrid):
            raise ValueError("min_o_hybrid must be finite")
        if self.max_decay is not None and not 0 <= self.max_decay <= 1:
            raise ValueError("max_decay must be between 0 and 1")


def judged(records: DataFrame, how: LibraryFilter | None = None) -> DataFrame:
    """``records`` with pearson, rank and worst retention, decay, and the reasons to reject each (none: kept)."""
    how = how or LibraryFilter()
    raw = lambda n: F.try_element_at("metric", F.lit(n))
    has = F.col("metric").isNotNull()
    numbers = [metric(n) for n in ("ICIR", "RankICIR", "O-ICIR", "O-RankICIR")]
    icir, rank_icir, o_icir, o_rank = numbers
    all_there = icir.isNotNull() & rank_icir.isNotNull() & o_icir.isNotNull() & o_rank.isNotNull()
    positive = all_there & (icir > 0) & (rank_icir > 0)
    out = records.withColumns({"pearson_retention": F.when(positive, F.try_divide(o_icir, icir)), "rank_retention": F.when(positive, F.try_divide(o_rank, rank_icir))})
    out = out.withColumn("worst_retention", F.least("pearson_retention", "rank_retention")).withColumn("decay", 1 - F.col("worst_retention"))
    reasons = [F.when(~has, "missing_metric_object")]
    for n in REQUIRED:
        reasons += [F.when(has & raw(n).isNull(), f"missing_or_invalid_metric:{n}"), F.when(raw(n).isNotNull() & metric(n).isNull(), f"nonfinite_metric:{n}")]
    reasons.append(F.when(F.lower(F.trim(F.coalesce("status", F.lit("")))) != "effective", "status_not_effective"))
    if how.direction_consistent:
        reasons.append(F.when(~F.coalesce("direction_consistent", F.lit(False)), "direction_inconsistent"))
    reasons.append(F.when(metric("O-HybridICIR") < how.min_o_hybrid, "o_hybrid_icir_below_threshold"))
    reasons += [F.when(all_there & (x <= 0), f"nonpositive_insample_metric:{n}") for n, x in (("ICIR", icir), ("RankICIR", rank_icir))]
    if how.max_decay is not None:
        reasons.append(F.when(F.col("worst_retention") < 1 - how.max_decay - SLACK, "decay_above_threshold"))
    return out.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("kept", F.size("reasons") == 0)


def reason_counts(judgement: DataFrame) -> DataFrame:
    return judgement.select(F.explode("reasons").alias("reason")).groupBy("reason").count().orderBy("reason")


# files


def as_record(raw: dict, seq: int) -> tuple | None:
    """A row of SCHEMA from a JSON record with current or older field names; None if it has no code."""
    code = str(raw.get("factor_code") or raw.get("code") or "").strip() if isinstance(raw, dict) else ""
    if not code:
        return None
    arguments = raw.get("factor_arguments", raw.get("arguments"))
    arguments = arguments if isinstance(arguments, dict) else {}
    values = None
    if isinstance(raw.get("metric"), dict):
        values = {}
        for k, v in raw["metric"].items():
            try:
                values[str(k)] = float(v)
            except (TypeError, ValueError):
                continue
    name = str(raw.get("name") or raw.get("entry_function") or "factor").strip()
    consistent = raw.get("direction_consistent")
    return (
        seq, name, code, str(raw.get("hash") or content_hash(code, arguments)), {k: json.dumps(v, default=str) for k, v in arguments.items()}, values, str(raw.get("status") or "effective"),
        str(raw.get("source") or "quantloom"), consistent if isinstance(consistent, bool) else None, json.dumps({k: v for k, v in raw.items() if k not in _OWN}, sort_keys=True, default=str),
    )


def read_json(path: str | Path, *, strict: bool = False) -> list[dict]:
    """The records of a library file: a list, or an object with ``factors``. Broken files are empty unless ``strict``."""
    try:
        loaded = json.loads(Path(path).read_text(encoding="utf-8") or "[]")
    except json.JSONDecodeError:
        if strict:
            raise ValueError(f"{path} is not JSON") from None
        return []
    loaded = loaded.get("factors") if isinstance(loaded, dict) else loaded
    if not isinstance(loaded, list) or strict and not all(isinstance(x, dict) for x in loaded):
        if strict:
            raise ValueError(f"{path} holds no list of factors")
        return []
    return [x for x in loaded if isinstance(x, dict)]


def load(spark: SparkSession, path: str | Path, *, strict: bool = False) -> DataFrame:
    rows = [r for i, x in enumerate(read_json(path, strict=strict)) if (r := as_record(x, i))]
    return spark.createDataFrame(rows, SCHEMA)


def to_json(row) -> dict:
    extra = json.loads(row["extra"] or "{}")
    own = {"name": row["name"], "code": row["code"], "hash": row["hash"], "arguments": {k: json.loads(v) for k, v in (row["arguments"] or {}).items()}, "metric": dict(row["metric"] or {}), "status": row["status"], "source": row["source"]}
    return own | ({"direction_consistent": row["direction_consistent"]} if row["direction_consistent"] is not None else {}) | extra


def write_atomically(path: str | Path, payload) -> Path:
    """JSON put in place by a rename."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, default=str)
        f.write("\n")
    os.replace(name, path)
    return path


def save(records: DataFrame, path: str | Path, *, key_metric: str = "ICIR") -> Path:
    """Records are few (one per factor), so the file is written by the driver, best first."""
    return write_atomically(path, [to_json(r) for r in ranked(best_of_each(records, key_metric), key_metric).collect()])


def upsert(spark: SparkSession, path: str | Path, incoming: list[dict], *, metadata: dict | None = None, key_metric: str = "ICIR", now: str | None = None) -> dict:
    """Merge effective records into a library file; counts before, after, candidates and additions."""
    now = now or datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    old = effective(load(spark, path)) if Path(path).is_file() else spark.createDataFrame([], SCHEMA)
    stamped = [{"created_at": now} | x | {k: v for k, v in (metadata or {}).items() if v not in (None, "")} | {"updated_at": now} for x in incoming if isinstance(x, dict)]
    new = effective(spark.createDataFrame([r for i, x in enumerate(stamped) if (r := as_record(x, 1_000_000 + i))], SCHEMA))
    old, before = old.persist(), {r["hash"] for r in old.select("hash").collect()}
    save(old.unionByName(new), path, key_metric=key_metric)
    after = {r["hash"] for r in effective(load(spark, path)).select("hash").collect()}
    old.unpersist()
    return {"library_path": str(path), "before_count": len(before), "after_count": len(after), "candidate_count": new.count(), "added_count": len(after - before)}


def file_sha256(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def filter_library(spark: SparkSession, source: str | Path, target: str | Path, how: LibraryFilter | None = None, *, manifest: str | Path | None = None) -> dict:
    """Write the kept records unchanged, and an audit manifest; the source must not change meanwhile."""
    how, source, target = how or LibraryFilter(), Path(source).resolve(), Path(target).resolve()
    manifest = Path(manifest).resolve() if manifest else target.with_suffix(".manifest.json")
    if len({source, target, manifest}) < 3:
        raise ValueError("source, target and manifest must be different files")
    before, raw = file_sha256(source), read_json(source, strict=True)
    rows = [as_record(x, i) or (i, x.get("name"), "", x.get("hash"), {}, None, str(x.get("status") or ""), "", None, "{}") for i, x in enumerate(raw)]
    rows = [(*r[:6], str(raw[r[0]].get("status") or ""), *r[7:]) for r in rows]
    judgement = judged(spark.createDataFrame(rows, SCHEMA), how).persist()
    details = judgement.orderBy("seq").collect()
    counts = {r["reason"]: r["count"] for r in reason_counts(judgement).collect()}
    judgement.unpersist()
    if file_sha256(source) != before:
        raise RuntimeError("the source library changed while it was filtered")
    write_atomically(target, [raw[r["seq"]] for r in details if r["kept"]])
    audit = {
        "source": str(source), "source_sha256": before, "target": str(target), "target_sha256": file_sha256(target),
        "parameters": {"min_o_hybrid_icir": how.min_o_hybrid, "max_decay": how.max_decay, "minimum_retention": None if how.max_decay is None else 1 - how.max_decay, "require_direction_consistent": how.direction_consistent},
        "source_count": len(raw), "kept_count": sum(r["kept"] for r in details), "rejected_count": sum(not r["kept"] for r in details), "rejection_reasons": counts,
        "decisions": [{k: r[k] for k in ("name", "hash", "kept", "reasons", "pearson_retention", "rank_retention", "worst_retention", "decay")} for r in details],
    }
    write_atomically(manifest, audit)
    return audit


def select(payload: dict, how: str = "best", top_n: int | None = None, key_metric: str = "ICIR") -> list[dict]:
    """Records of a result file from its most refined collection: the best, the effective, or all of them."""
    records = next((payload[k] for k in ("debugged_factors", "accepted_factors", "generated_factors", "candidate_factors") if payload.get(k)), [])

    def value(x: dict) -> float:
        try:
            v = float((x.get("metric") or {}).get(key_metric))
        except (TypeError, ValueError):
            return -math.inf
        return v if math.isfinite(v) else -math.inf

    records = sorted(records, key=value, reverse=True)
    if how == "best":
        records = records[:1]
    elif how == "effective":
        records = [x for x in records if str(x.get("status", "")).lower() == "effective"]
    elif how != "all":
        raise ValueError(f"selection {how!r} is none of best, effective, all")
    return records[:top_n] if top_n else records
