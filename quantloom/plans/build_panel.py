"""The point-in-time panel: market, daily fundamentals, statements, forecasts and announcements, as known on each date."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import DATE, SYMBOL
from ..operators import panel as P
from ..operators import pit
from ..sources import market as M
from ..sources import sinks
from .catalog import field_groups


@dataclass
class Inputs:
    """Tables of a build; those not given are left out."""

    market: DataFrame
    calendar: DataFrame
    statements: DataFrame
    statements_extended: DataFrame | None = None
    daily: DataFrame | None = None
    shares: DataFrame | None = None
    forecasts: DataFrame | None = None
    performance: DataFrame | None = None
    end: str | None = None


@dataclass
class Panel:
    frame: DataFrame
    snapshots: DataFrame
    alignment: DataFrame | None = None
    groups: dict[str, list[str]] = field(default_factory=dict)


def known_by(frame: DataFrame, end: str | None) -> DataFrame:
    return frame.where(F.col("available_date") <= F.to_date(F.lit(end))) if end else frame


def build(x: Inputs) -> Panel:
    """One lazy plan: equi-joins for daily tables, one linear as-of pass for each event stream."""
    merged, alignment = x.statements, None
    if x.statements_extended is not None:
        merged = pit.merge_statements(x.statements, x.statements_extended)
        alignment = pit.alignment(merged)
        merged = merged.drop("in_base", "in_extended", "conflict")
    merged = known_by(pit.check_quarters(merged), x.end)
    flows, balances = M.statement_fields(merged.columns)
    events = pit.activate(merged, x.calendar).withColumn("report_ordinal", pit.report_ordinal(F.col("quarter")))
    state = pit.snapshots(events, flows, balances)
    meta = {"event_available_date": "fund_event_available_date", "report_available_date": "fund_statement_available_date", "report_ordinal": "fund_report_ordinal", "report_year": "fund_report_year", "report_quarter": "fund_report_quarter"}
    named = state.select(SYMBOL, "activation_date", F.col("activation_date").alias("fund_statement_activation_date"), *(F.col(c).alias(meta.get(c, f"fund_{c}")) for c in state.columns if c not in (SYMBOL, "activation_date")))
    out = x.market
    for table in (x.daily, x.shares):
        if table is not None:
            out = out.join(P.require_unique(table, [DATE, SYMBOL], "daily table"), [DATE, SYMBOL], "left")
    streams = [("statement", merged, named, "fund_statement_available_date")]
    for name, table, fields in (("forecast", x.forecasts, M.forecasts), ("performance", x.performance, M.performance)):
        if table is not None:
            known = known_by(table, x.end)
            streams.append((name, known, fields(pit.activate(known, x.calendar)), f"fund_{name}_available_date"))
    for name, known, events, available in streams:
        out = pit.asof_attach(out, events, source=known)
        if available in out.columns:
            own = f"fund_{name}_activation_date"
            out = out.withColumnRenamed("activation_date", own) if own not in out.columns else out.drop("activation_date")
            out = pit.age_features(out, f"fund_{name}", available, own)
    out = pit.ratio_features(out)
    return Panel(out, state, alignment, field_groups(out.columns))


def check(panel: Panel, market: DataFrame) -> dict[str, bool]:
    """The quality gate; ValueError if a check fails."""
    gate = pit.quality_gate(panel.frame, market, "fund_statement_activation_date", ["fund_report_ordinal"]).first().asDict()
    if bad := [k for k, v in gate.items() if not v]:
        raise ValueError(f"the panel fails {bad}")
    return gate


def write(panel: Panel, market: DataFrame, folder: str) -> dict:
    """Check the panel and publish it with snapshots, coverage, manifest and quality report under ``folder``."""
    panel.frame = panel.frame.persist()
    try:
        gate = check(panel, market)
        months = sinks.write_panel(panel.frame, f"{folder}/panel").collect()
        sinks.write_table(panel.snapshots, f"{folder}/snapshots")
        covered = pit.coverage(panel.frame).orderBy(F.desc("nonnull_rate"), "field")
        sinks.write_table(covered, f"{folder}/field_coverage")
        sinks.write_table(pit.coverage_by_year(panel.frame), f"{folder}/field_coverage_by_year")
        manifest = sinks.manifest(panel.frame, f"{folder}/panel", panel.groups)
    finally:
        panel.frame.unpersist()
    manifest["artifacts"] |= {"field_coverage": f"{folder}/field_coverage", "field_coverage_by_year": f"{folder}/field_coverage_by_year", "snapshots": f"{folder}/snapshots"}
    manifest["partitions"] = [r.asDict() for r in months]
    sinks.write_atomically(f"{folder}/manifest.json", manifest)
    sinks.write_atomically(f"{folder}/quality.json", gate | ({"alignment": panel.alignment.first().asDict()} if panel.alignment is not None else {}))
    return manifest
