"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow random trees are grown on a bounded sample of labelled texts. Every path from a root is a rule, a conjunction of
bounds on statistics. A logistic model with an L1 penalty weighs the rules, which drives most weights to zero, and the
rest are compiled into one Spark column expression over a literal table of rules.

Statistics are taken over whole texts in numpy. Null and empty texts have zero statistics and get a score like others.
Without labelled texts of both kinds the score of every text is the share of label 1, or 0.5 without any. Repeated rows
are scored alike; an empty table gives no rows. Columns but the text are not read; the statistics' own columns are named
``_stat_...``, and columns by such names or by that of the score are replaced.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, chunks, code_points, mix
from .storage import bounded, map_arrow

STATISTICS = ("n_words", "word_length", "distinct_words", "repeated_next", "upper", "digits", "symbols", "pipes", "exclamations", "stops", "line_words", "distinct_lines")
PREFIX = "_stat_"


def _class_table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_CLASSES = {
    "upper": _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _class_table("0123456789"), "symbols": _class_table("#*$%&<>"),
    "pipes": _class_table("|"), "exclamations": _class_table("!"), "stops": _class_table(".,;:?"),
}


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    keys = np.sort(hashes ^ mix(owner.astype(np.uint64)))
    # the owner goes with the key, as a text's words stay together only before sorting
    order = np.argsort(hashes ^ mix(owner.astype(np.uint64)))
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return np.bincount(owner[order][fresh], minlength=n)


def statistics(texts: Texts) -> np.ndarray:
    """A row for each text, a column for each of STATISTICS."""
    n = len(texts)
    words = texts.words("space")
    owner = np.repeat(np.arange(n), words.counts)
    points = code_points(texts.data)
    chars = (points[texts.offsets[1:]] - points[texts.offsets[:-1]]).astype(float)
    count = words.counts.astype(float)
    per_word, per_char = np.maximum(count, 1), np.maximum(chars, 1)
    out = {"n_words": count, "word_length": np.bincount(owner, weights=points[words.ends] - points[words.starts], minlength=n) / per_word}
    out["distinct_words"] = _distinct(owner, words.hashes, n) / per_word
    same = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    out["repeated_next"] = np.bincount(owner[1:][same], minlength=n) / per_word
    for name, table in _CLASSES.items():
        running = np.concatenate([[0], np.cumsum(table[texts.data])])
        out[name] = (running[texts.offsets[1:]] - running[texts.offsets[:-1]]) / per_char
    newline = np.flatnonzero(texts.data == 10)
    lines = np.diff(np.searchsorted(newline, texts.offsets)) + 1.0
    out["line_words"] = count / lines
    # a line is the words between two newlines, folded into one hash
    if len(words.hashes):
        line_of = np.searchsorted(newline, words.starts)
        first = np.flatnonzero(np.concatenate([[True], (line_of[1:] != line_of[:-1]) | (owner[1:] != owner[:-1])]))
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        folded = np.add.reduceat(mix(words.hashes + mix(place.astype(np.uint64))), first)
        full = np.bincount(owner[first], minlength=n)
        out["distinct_lines"] = _distinct(owner[first], folded, n) / np.maximum(full, 1)
    else:
        out["distinct_lines"] = np.zeros(n)
    return np.stack([out[s] for s in STATISTICS], axis=1)


def with_statistics(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with one column for each statistic."""
    docs = docs.select(*(c for c in docs.columns if not c.startswith(PREFIX))) if keep is None else docs.select(*keep, *([] if text_column in keep else [text_column]))
    names = docs.columns
    out = names if keep is None else keep
    place = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch.column(place)):
                values = statistics(texts)
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in out), *(pa.array(v) for v in values.T)], [*out, *(PREFIX + s for s in STATISTICS)])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out), *(f"{PREFIX}{s} double" for s in STATISTICS)])
    return map_arrow(docs, run, fields)


Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1 from the statistics' columns.

        The rules are one literal that the expression walks, so that its plan stays small whatever their number.
        """
        table = json.dumps([{"weight": w, "conditions": [{"feature": f, "above": above, "cut": cut} for f, above, cut in rule]} for rule, w in self.rules])
        rules = F.from_json(F.lit(table), "array<struct<weight:double,conditions:array<struct<feature:int,above:boolean,cut:double>>>>")
        values = F.array(*(F.col(PREFIX + s) for s in STATISTICS))

        def holds(c: Column) -> Column:
            value = F.get(values, c["feature"])
            return F.when(c["above"], value > c["cut"]).otherwise(value <= c["cut"])

        total = F.aggregate(rules, F.lit(self.bias), lambda t, r: F.when(F.forall(r["conditions"], holds), t + r["weight"]).otherwise(t))
        return 1 / (1 + F.exp(-total))


@dataclass(frozen=True)
class RuleFit:
    #: Labelled texts that the model is fitted on, at most about.
    sample_rows: int = 20_000
    #: Texts that each tree is grown on, drawn from these with replacement.
    tree_rows: int = 4_000
    trees: int = 60
    depth: int = 3
    leaf: int = 10
    cuts: int = 32
    penalty: float = 0.002
    steps: int = 600
    seed: int = 7


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, above, cut in rule:
        out &= (x[:, feature] > cut) if above else (x[:, feature] <= cut)
    return out


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, path: Rule, how: RuleFit, draw: np.random.Generator, out: dict[Rule, None]) -> None:
    if path:
        out[tuple(sorted(path))] = None
    if len(path) == how.depth or len(rows) < 2 * how.leaf or y[rows].min() == y[rows].max():
        return
    best = None
    for f in draw.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        values = x[rows, f]
        cuts = np.unique(np.quantile(values, draw.random(how.cuts)))
        left = values[None, :] <= cuts[:, None]
        n_left = left.sum(axis=1)
        ones = (left * y[rows][None, :]).sum(axis=1)
        n, all_ones = len(rows), y[rows].sum()
        n_right = n - n_left
        fine = (n_left >= how.leaf) & (n_right >= how.leaf)
        if not fine.any():
            continue
        gini = lambda a, b: a * (b - a) / np.maximum(b, 1)
        impurity = np.where(fine, gini(ones, n_left) + gini(all_ones - ones, n_right), np.inf)
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0]:
            best = (impurity[i], int(f), float(cuts[i]))
    if best is None:
        return
    _, f, cut = best
    left = x[rows, f] <= cut
    _grow(x, y, rows[left], (*path, (f, False, cut)), how, draw, out)
    _grow(x, y, rows[~left], (*path, (f, True, cut)), how, draw, out)


def fit_rules(x: np.ndarray, y: np.ndarray, how: RuleFit | None = None) -> RuleModel:
    """Trees, their rules, and lasso logistic weights by accelerated proximal gradient steps."""
    how = how or RuleFit()
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return RuleModel(math.log(share / (1 - share)), [])
    draw = np.random.default_rng(how.seed)
    rules: dict[Rule, None] = {}
    for _ in range(how.trees):
        _grow(x, y, draw.choice(len(y), min(len(y), how.tree_rows), replace=True), (), how, draw, rules)
    kept: dict[bytes, Rule] = {}
    for rule in rules:
        held = _holds(x, rule)
        if 0 < held.mean() < 1:
            kept.setdefault(np.packbits(held).tobytes(), rule)
    chosen = [*kept.values()]
    if not chosen:
        share = float(y.mean())
        return RuleModel(math.log(share / (1 - share)), [])
    # texts that the same rules hold for are one row with a weight and a share of label 1, which changes no sum
    held = np.stack([_holds(x, r) for r in chosen], axis=1)
    _, first, which, times = np.unique(np.packbits(held, axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    which = which.ravel()
    mass, ones = times / len(y), np.bincount(which, weights=y) / times
    often = held.mean(axis=0)
    spread = np.sqrt(np.maximum(often * (1 - often), 1e-3))
    a = held[first] / spread
    share = float(y.mean())
    weights, bias = np.zeros(a.shape[1]), math.log(share / (1 - share))
    # power iteration for the step size
    v = np.ones(a.shape[1]) / math.sqrt(a.shape[1])
    for _ in range(20):
        v = a.T @ (mass * (a @ v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 / (norm + 1)
    at, at_bias, t = weights.copy(), bias, 1.0
    for _ in range(how.steps):
        gap = mass * (1 / (1 + np.exp(-(a @ at + at_bias))) - ones)
        new = at - step * (a.T @ gap)
        new = np.sign(new) * np.maximum(np.abs(new) - step * how.penalty, 0)
        new_bias = at_bias - step * gap.sum()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        at, at_bias = new + (t - 1) / t_new * (new - weights), new_bias + (t - 1) / t_new * (new_bias - bias)
        weights, bias, t = new, new_bias, t_new
    return RuleModel(float(bias), [(r, float(w / s)) for r, w, s in zip(chosen, weights, spread, strict=True) if abs(w) > 1e-6])


def fit_quality(docs: DataFrame, labels: DataFrame, how: RuleFit | None = None, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> RuleModel:
    """Fit on the labelled ``docs``. Of an id's labels the largest counts; null ids and labels are left out.

    ``sample_rows`` bounds the sample; its ids are drawn by hash; one with several texts counts once.
    """
    how = how or RuleFit()
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("label_id")).agg(F.max(label_column).alias("label"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, how.sample_rows / max(n, 1))))
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null")
    joined = narrow.join(bounded(drawn), F.col("id") == F.col("label_id")).select("id", "text", "label")
    # an id with several texts counts once, with the least of each statistic, so that the driver gets no more rows than ids were drawn
    least = with_statistics(joined, "text", ["id", "label"]).groupBy("id").agg(*(F.min(c).alias(c) for c in ("label", *(PREFIX + s for s in STATISTICS))))
    table = least.toPandas().sort_values("id")
    return fit_rules(table[[PREFIX + s for s in STATISTICS]].to_numpy(float), table["label"].to_numpy(float), how)


def score_quality(docs: DataFrame, model: RuleModel, *, text_column: str = "text", keep: list[str] | None = None, score_column: str = "score") -> DataFrame:
    """The ``keep`` columns (all by default) with the score."""
    scored = with_statistics(docs, text_column, keep).withColumn(score_column, model.score())
    return scored.drop(*(PREFIX + s for s in STATISTICS))


def accepted(docs: DataFrame, model: RuleModel, cut: float, *, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``cut`` or more, their columns unchanged."""
    own = docs.withColumnsRenamed({c: f"kept{c}" for c in docs.columns if c.startswith(PREFIX)})
    kept = with_statistics(own, text_column).where(model.score() >= cut)
    return kept.select(*(F.col(f"`kept{c}`").alias(c) if c.startswith(PREFIX) else F.col(f"`{c}`") for c in docs.columns))
