"""Wide outputs of many factors, and what a search needs around them: names, errors, repairs, costs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import DATE, SYMBOL
from .expression import ExpressionError, Stages, parse

DIGITS = 8


def slug(name: str) -> str:
    """Lower-case letters and digits joined by underscores."""
    return re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower() or "factor"


def unique_names(names: Iterable[str], prefix: str = "alpha") -> list[str]:
    """prefix_001_slug, ...; repeated slugs get _2, _3."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names, 1):
        own = slug(name)
        seen[own] = seen.get(own, 0) + 1
        out.append(f"{prefix}_{i:03d}_{own}" + (f"_{seen[own]}" if seen[own] > 1 else ""))
    return out


@dataclass
class Wide:
    """(date, symbol, a column for each factor); names by factor; errors of those that could not be computed."""

    frame: DataFrame
    names: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def missing(self) -> DataFrame:
        """One row: rows, and missing values of each column."""
        return self.frame.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in self.names.values()))


def compute_wide(panel: DataFrame, factors: list[tuple[str, str]], prefix: str = "alpha") -> Wide:
    """All factors (name, expression) in one plan that shares windows; a broken one costs only itself."""
    stages, names, errors = Stages(panel, "_w"), {}, {}
    fields = set(panel.columns)
    for column, (name, text) in zip(unique_names((n for n, _ in factors), prefix), factors, strict=True):
        try:
            node = parse(text, fields)
        except ExpressionError as e:
            errors[name] = str(e)
            continue
        stages.add(column, node)
        names[name] = column
    out = stages.frame.select(DATE, SYMBOL, *(F.bround(F.col(c), DIGITS).alias(c) for c in names.values()))
    return Wide(out, names, errors)


def json_of(text: str, key: str | None = None):
    """The first JSON value in a text, fenced or bare; its ``key`` if given. ValueError if there is none."""
    candidates = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S) + [text]
    decoder = json.JSONDecoder()
    for part in candidates:
        for m in re.finditer(r"[\[{]", part):
            try:
                value, _ = decoder.raw_decode(part, m.start())
            except json.JSONDecodeError:
                continue
            if key is None or isinstance(value, dict) and key in value:
                return value if key is None else value[key]
    raise ValueError("no JSON in the text" + (f" with {key!r}" if key else ""))


def compact_error(trace: str, file: str = "<factor>") -> str:
    """First line, the last line of the factor's own code, and the error itself."""
    lines = [x.strip() for x in trace.strip().splitlines() if x.strip()]
    own = [x for x in lines if file in x]
    return "\n".join(dict.fromkeys([*lines[:1], *own[-1:], *lines[-1:]]))


def repaired(proposal: dict, check: Callable[[dict], str | None], repair: Callable[[dict, str], dict | None], most: int = 2) -> tuple[dict | None, list[dict]]:
    """A proposal that passes ``check`` after at most so many repairs, and the trace; None if it never does."""
    trace = []
    for i in range(most + 1):
        error = check(proposal)
        trace.append({"attempt": i, "proposal": proposal, "error": error})
        if error is None:
            return proposal, trace
        if i == most or (proposal := repair(proposal, error)) is None:
            break
    return None, trace


@dataclass
class Costs:
    """Tokens used and what they cost at prices per million tokens."""

    prices: dict[str, tuple[float, float]] = field(default_factory=dict)
    tokens: dict[str, list[int]] = field(default_factory=dict)

    def add(self, model: str, read: int, written: int) -> None:
        own = self.tokens.setdefault(model, [0, 0])
        own[0] += read
        own[1] += written

    def total(self) -> float:
        return sum(n * p / 1e6 for model, counts in self.tokens.items() for n, p in zip(counts, self.prices.get(model, (0.0, 0.0)), strict=True))


def summary(record: dict, values: int = 5) -> dict:
    """A record without its series: count, missing values and the first few instead."""
    out = {k: v for k, v in record.items() if k != "value"}
    if (series := record.get("value")) is not None:
        out["value"] = {"count": len(series), "missing": sum(v is None for v in series), "preview": list(series)[:values]}
    return out
