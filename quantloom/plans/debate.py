"""Factor search: proposers take turns, every proposal is validated, scored and admitted to a factor set.

A proposer is any object with ``propose(context) -> dict | None`` (name and expression, or None to pass), so a language
model, a replayed list or a person can stand behind it. One that also has ``repair(proposal, error) -> dict | None`` is
asked to mend a proposal that fails. Nothing here calls a network.

The text of a factor is an expression, or the code of a Python function with ``arguments``.
"""

from __future__ import annotations

import json
import logging
import random
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import core
from ..functions.core import DATE, SYMBOL
from . import factor_code
from .alpha import repaired
from .expression import ExpressionError, evaluate, fields_of, parse
from .factors import FACTORS
from .library import content_hash
from .scoring import KEY_METRIC, Samples, bundle, daily_ic, evaluation_mode, long_factors


class Proposer(Protocol):
    def propose(self, context: dict) -> dict | None: ...


class Replay:
    """Proposals from a list, in order."""

    def __init__(self, proposals: Iterable[dict]):
        self.rest = list(proposals)

    def propose(self, context: dict) -> dict | None:
        return self.rest.pop(0) if self.rest else None


#: Factors that a search starts from if no examples are given.
SEEDS = tuple({"name": f"seed_{n}", "expression": FACTORS[n]} for n in ("macd", "price_volume_correlation", "volatility", "volume_spike", "price_drawdown", "amplitude"))


def as_proposal(raw: dict, name: str) -> dict | None:
    """Name, expression and arguments of a record with current or older field names; None if it has no text."""
    text = raw.get("expression") or raw.get("factor_code") or raw.get("code")
    arguments = raw.get("arguments") or raw.get("factor_arguments") or {}
    if not text or not isinstance(arguments, dict):
        return None
    return {"name": str(raw.get("name") or name), "expression": str(text), "arguments": arguments}


def seeds_of(config: dict) -> list[dict]:
    """The configuration's ``examples``, else those of its seed file (a list, or an object with ``alphas``), else SEEDS."""
    raw = config.get("examples")
    path = str(config.get("seed_factors_json_path") or config.get("seed_alphas_json_path") or "").strip()
    if not (isinstance(raw, list) and raw) and path:
        try:
            raw = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            logging.warning("seeds are not read from %s: %s", path, e)
            raw = []
        raw = raw.get("alphas", []) if isinstance(raw, dict) else raw
    raw = raw if isinstance(raw, list) else []
    found = [p for i, x in enumerate(raw, 1) if isinstance(x, dict) and (p := as_proposal(x, f"seed_{i}"))]
    return found or [*SEEDS]


@dataclass(frozen=True)
class Thresholds:
    seed_stop: float = 0.3
    icir: float = 0.2
    rank_icir: float = 0.2
    similar: float = 0.8


def similar_series(series: DataFrame, new: str, others: list[str], threshold: float) -> DataFrame:
    """(factor, corr, pairs) of the columns whose signed correlation with ``new`` is above the threshold, the closest first. Two common values at least make a correlation."""
    x = F.col(new).cast("double")
    each = [F.struct(F.lit(c).alias("factor"), core.corr_of(x, F.col(c).cast("double")).alias("corr"), F.count(core.both(x, F.col(c), x)).alias("pairs")) for c in others]
    return series.agg(F.array(*each).alias("x")).select(F.inline("x")).where(F.col("corr") > threshold).orderBy(F.desc("corr"), "factor")


@dataclass
class FactorSet:
    """Accepted, similar and invalid factors of one search."""

    panel: DataFrame
    labels: DataFrame
    samples: Samples
    thresholds: Thresholds = field(default_factory=Thresholds)
    mode: str = "pearson_ic"
    symbol: str | None = None
    #: Seconds that scoring one factor may take.
    seconds: float = 600.0
    #: What every record says about the data: profile, mode, manifest.
    lineage: dict = field(default_factory=dict)
    accepted: list[dict] = field(default_factory=list)
    similar: list[dict] = field(default_factory=list)
    invalid: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.mode = evaluation_mode(self.mode)
        there = self.panel.agg(F.min(SYMBOL).alias("first"), F.max(F.col(SYMBOL) == F.lit(self.symbol)).alias("own")).first()
        # a demo symbol that the panel lacks gives way to the first one
        self.symbol = self.symbol if there["own"] else there["first"]

    def values(self, text: str, arguments: dict | None = None) -> DataFrame:
        """(date, symbol, value) of a factor's text over the whole panel."""
        if factor_code.is_code(text):
            return factor_code.run(self.panel, text, arguments=arguments)
        return evaluate(self.panel, {"_factor": text}).select(DATE, SYMBOL, F.col("_factor").alias("value"))

    def fields(self, text: str) -> list[str]:
        """Fields of the panel that a factor's text reads."""
        return sorted(factor_code.referenced(text) - {"time", SYMBOL} if factor_code.is_code(text) else fields_of(parse(text)))

    def score(self, name: str, expression: str, arguments: dict | None = None) -> dict:
        """The record of a factor with its metrics and where they come from; TimeoutError if it takes too long."""
        arguments = arguments or {}
        values = self.values(expression, arguments).withColumnRenamed("value", "_factor")
        with factor_code.job_limit(self.panel.sparkSession, self.seconds):
            found = bundle(daily_ic(long_factors(values, ["_factor"]), self.labels), self.samples).first()
        metric = {k.replace("O_", "O-"): found[k] for k in found.__fields__ if k[0].isupper()} if found else {}
        directions = {k: found[k] for k in ("direction", "rank_direction", "direction_consistent")} if found else {"direction_consistent": True}
        about = {"evaluation_mode": self.mode, "insample_time_range": [*self.samples.inside], "outsample_time_range": [*self.samples.outside], "referenced_fields": self.fields(expression)}
        return {"name": name, "code": expression, "hash": content_hash(expression, arguments), "arguments": arguments, "metric": metric, **directions, **about, **self.lineage}

    def backtest(self, name: str, expression: str, arguments: dict | None = None) -> dict:
        """The complete record of a factor: ``score`` with the demo symbol's series in date order."""
        record = self.score(name, expression, arguments)
        series = self.values(expression, arguments).where(F.col(SYMBOL) == self.symbol).orderBy(DATE).collect()
        return record | {"demo_symbol": self.symbol, "dates": [str(r[DATE]) for r in series], "value": [r["value"] for r in series]}

    def key(self, record: dict) -> float:
        value = record["metric"].get(KEY_METRIC[self.mode])
        return float("-inf") if value is None else value

    def passes(self, record: dict) -> bool:
        at = lambda k, least: (record["metric"].get(k) is not None) and record["metric"][k] >= least
        a, b = at("ICIR", self.thresholds.icir), at("RankICIR", self.thresholds.rank_icir)
        return {"pearson_ic": a, "rank_ic": b, "hybrid": a and b and bool(record.get("direction_consistent"))}[self.mode]

    def similar_to(self, record: dict) -> list[tuple[str, float]]:
        """Accepted factors whose series of the demo symbol correlate above the threshold, the closest first; one pass for all of them."""
        if not self.accepted:
            return []
        texts = {"_new": record} | {f"_a{i}": r for i, r in enumerate(self.accepted)}
        # over all symbols, as ranks and scales across them need the whole panel
        plain = {c: r["code"] for c, r in texts.items() if not factor_code.is_code(r["code"])}
        own = evaluate(self.panel, plain).where(F.col(SYMBOL) == self.symbol).select(DATE, *plain)
        for c, r in texts.items():
            if c not in plain:
                own = own.join(self.values(r["code"], r.get("arguments")).where(F.col(SYMBOL) == self.symbol).select(DATE, F.col("value").alias(c)), DATE, "left")
        found = similar_series(own, "_new", [c for c in texts if c != "_new"], self.thresholds.similar).collect()
        return [(self.accepted[int(r["factor"].removeprefix("_a"))]["name"], r["corr"]) for r in found]

    def admit(self, record: dict, *, seed: bool = False) -> dict:
        """Put a scored record among the accepted, similar or invalid ones; seeds are accepted unchecked."""
        if not seed and not self.passes(record):
            record["status"] = "invalid"
            self.invalid.append(record)
        elif not seed and (near := self.similar_to(record)):
            record |= {"status": "similar", "similar_to": [n for n, _ in near]}
            self.similar.append(record)
        else:
            record["status"] = "effective"
            self.accepted.append(record)
        return record

    def add(self, proposal: dict, *, seed: bool = False, repair=None, repairs: int = 2) -> dict:
        """Score and admit a proposal; one that fails may be repaired ``repairs`` times, and the attempts are in its record."""
        scored: dict = {}

        def check(own: dict) -> str | None:
            try:
                scored["record"] = self.score(own["name"], own["expression"], own.get("arguments"))
            except (ExpressionError, TimeoutError) as e:
                return f"TIME: {e}" if isinstance(e, TimeoutError) else str(e)
            return None

        good, trace = repaired(proposal, check, repair or (lambda *_: None), repairs)
        if good is None:
            last = trace[-1]
            record = {"name": proposal.get("name"), "code": last["proposal"].get("expression", ""), "metric": {}, "status": "invalid", "error": last["error"]}
            self.invalid.append(record)
        else:
            record = self.admit(scored["record"], seed=seed)
        return record | ({"repairs": trace} if len(trace) > 1 else {})

    def best(self) -> dict | None:
        return max(self.accepted, key=self.key, default=None)

    def examples(self, k: int, seed: int = 0) -> list[dict]:
        """Up to k accepted factors, drawn by a seed."""
        return random.Random(seed).sample(self.accepted, min(k, len(self.accepted)))


def run(factors: FactorSet, proposers: list[Proposer], *, rounds: int = 4, seeds: Iterable[dict] = SEEDS, library: Iterable[dict] = (), few_shot: int = 3, repairs: int = 2) -> dict:
    """Seeds and the factors of a library first; if one is good enough the search ends there, else proposers take turns for so many rounds.

    Library factors are scored anew over this panel; those that can't be computed are reported and left out.
    """
    log = [{"round": 0, "proposer": "seed", **factors.add(s, seed=True)} for s in seeds]
    failed = []
    for raw in library:
        proposal = as_proposal(raw, "library")
        record = factors.add(proposal, seed=True) if proposal else {"status": "invalid", "name": raw.get("name"), "error": "no text"}
        log.append({"round": 0, "proposer": "library", **record})
        if record["status"] == "invalid":
            failed.append({"name": record["name"], "error": record["error"]})
    best = factors.best()
    stopped = best is not None and factors.key(best) >= factors.thresholds.seed_stop
    for i in range(1, rounds + 1 if proposers and not stopped else 1):
        n = (i - 1) % len(proposers)
        context = {"round": i, "examples": factors.examples(few_shot, i), "last": log[-1] if log else None, "invalid": factors.invalid[-few_shot:]}
        proposal = proposers[n].propose(context)
        if proposal is None:
            break
        log.append({"round": i, "proposer": n, **factors.add(proposal, repair=getattr(proposers[n], "repair", None), repairs=repairs)})
    return {
        "debate_rounds": log, "stopped_at_seeds": stopped, "accepted_factors": factors.accepted, "similar_factors": factors.similar, "invalid_factors": factors.invalid, "library_failures": failed, "best": factors.best(),
    }


__all__ = ["SEEDS", "FactorSet", "Proposer", "Replay", "Thresholds", "as_proposal", "run", "seeds_of"]
