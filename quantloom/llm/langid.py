"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree is counted on a bounded sample of labelled texts. A symbol that a
context has not seen costs an escape, whose probability mass is spread over the unseen symbols as the next shorter
context ranks them; order -1 is uniform. The statistics are then frozen, and a text's code length under each language
is exact: the sum of -log2 of these probabilities over all its bytes. The shortest code wins.

Bytes are folded before coding: A-Z to a-z, digits to 0, white space to a space. Every byte that a training text holds is
a symbol; those that none holds share one. Only what was seen is stored: pairs of context and symbol with their code
lengths, and the escapes of contexts, so that a model is bounded by its training texts, whatever the alphabet.

Null and empty text, and text without a letter: ``und`` with score 0. No labelled texts at all: ``und`` for every text.
Long texts are coded whole. Ties go to the language that sorts first. Repeated rows are predicted alike, an empty table
gives no rows, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks
from .storage import map_arrow

#: Bytes coded at once; a longer text is coded in parts.
PART = 1 << 18
#: Tables of pairs up to this many entries are addressed directly, others searched.
DIRECT = 1 << 20


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[48:58] = 48
    table[9:14] = 32
    return table


FOLD = _fold()


@dataclass
class Order:
    """Contexts of one length: pairs (context x size + symbol) seen in any language, sorted, and escapes by context."""

    pairs: np.ndarray
    bits: np.ndarray  # pair x language: code length of the symbol
    context: np.ndarray  # pair -> row of escapes
    escapes: np.ndarray  # context x language: bits before the symbol's code in the shorter context, 0 where a language has not seen the context

    def found(self, pairs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each pair, whether it is there, and the row of its context, -1 for one not seen."""
        at = np.searchsorted(self.pairs, pairs)
        here, before = np.minimum(at, len(self.pairs) - 1), np.maximum(at - 1, 0)
        own = pairs // size
        context = np.where(self.pairs[here] // size == own, self.context[here], np.where(self.pairs[before] // size == own, self.context[before], -1))
        return here, self.pairs[here] == pairs, context


@dataclass
class LanguageModel:
    languages: list[str]
    symbols: np.ndarray  # byte -> symbol
    size: int
    orders: list[Order]

    def __post_init__(self):
        self.direct: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"direct": {}}

    def _found(self, k: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = self.orders[k]
        if self.size ** (k + 1) > DIRECT:
            return order.found(pairs, self.size)
        if k not in self.direct:
            self.direct[k] = order.found(np.arange(self.size ** (k + 1)), self.size)
        return tuple(x[pairs] for x in self.direct[k])

    def code(self, pairs: list[np.ndarray], known: list[np.ndarray]) -> np.ndarray:
        """Bits of symbols under each language, from their pairs at every order up to one, where such a context is known."""
        out = np.full((len(pairs[0]), len(self.languages)), np.log2(self.size), np.float32)
        for k, (own, inside) in enumerate(zip(pairs, known, strict=True)):
            if not len(self.orders[k].pairs):
                break
            row, there, context = self._found(k, own)
            there, escaped = there & inside, ~there & (context >= 0) & inside
            out[escaped] += self.orders[k].escapes[context[escaped]]
            out[there] = self.orders[k].bits[row[there]]
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        top, size = len(self.orders) - 1, self.size
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        for low in range(0, len(data), PART):
            high, begin = min(low + PART, len(data)), max(low - top, 0)
            s = self.symbols[data[begin:high]].astype(np.int64)
            first = np.searchsorted(offsets, low, side="right") - 1
            # texts that begin before the part's end, and where each byte's text begins
            bounds = np.clip(offsets[first : np.searchsorted(offsets, high) + 1], low, high)
            depth = np.arange(low, high) - np.repeat(offsets[first : first + len(bounds) - 1], np.diff(bounds))
            here = s[low - begin :]
            pairs, known, context = [here], [np.ones(len(here), bool)], np.zeros(len(here), np.int64)
            padded = np.concatenate([np.zeros(top - (low - begin), np.int64), s])
            for k in range(1, top + 1):
                context = context + padded[top - k : top - k + len(here)] * size ** (k - 1)
                pairs.append(context * size + here)
                known.append(depth >= k)
            bits = self.code(pairs, known)
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                total[first + full] += np.add.reduceat(bits, bounds[full] - low, axis=0, dtype=np.float64)
        return total


def train(samples: list[tuple[str, np.ndarray]], order: int = 3) -> LanguageModel | None:
    """samples: language and folded bytes of a text."""
    if not samples:
        return None
    languages = sorted({lang for lang, _ in samples})
    seen = np.flatnonzero(sum(np.bincount(data, minlength=256) for _, data in samples))
    size = len(seen) + 1
    symbols = np.full(256, size - 1, np.uint8)
    symbols[seen] = np.arange(len(seen))
    model = LanguageModel(languages, symbols[FOLD], size, [])
    for k in range(order + 1):
        counts = []
        for lang in languages:
            parts = [np.zeros(0, np.int64)]
            for own, data in samples:
                if own == lang and len(data) > k:
                    s = symbols[data].astype(np.int64)
                    parts.append(s[k:] + sum(s[k - j : len(s) - j] * size**j for j in range(1, k + 1)))
            counts.append(np.unique(np.concatenate(parts), return_counts=True))
        pairs = np.unique(np.concatenate([c[0] for c in counts]))
        contexts, context = np.unique(pairs // size, return_inverse=True)
        # the same symbols after the shorter contexts
        below = [pairs % size + pairs // size % size**j * size for j in range(k)]
        lower = model.code(below, [np.ones(len(pairs), bool)] * k) if k else np.full((len(pairs), len(languages)), np.log2(size))
        bits, escapes = np.empty((len(pairs), len(languages)), np.float32), np.zeros((len(contexts), len(languages)), np.float32)
        for i, (own, times) in enumerate(counts):
            count = np.zeros(len(pairs))
            count[np.searchsorted(pairs, own)] = times
            by_context = lambda values: np.bincount(context, weights=values, minlength=len(contexts))
            n, distinct = by_context(count), by_context(count > 0)
            left = 1 - by_context(np.where(count > 0, np.exp2(-lower[:, i].astype(float)), 0))
            # with every symbol seen there is nothing to escape to
            escape = np.where(distinct == size, 0, distinct)
            all_ = np.maximum(n + escape, 1)
            spent = np.where((n > 0) & (escape > 0), -np.log2(np.maximum(escape, 1) / all_ / np.maximum(left, 1e-9)), 0)
            escapes[:, i] = spent
            bits[:, i] = np.where(count > 0, -np.log2(np.maximum(count, 1) / all_[context]), lower[:, i] + spent[context])
        model.orders.append(Order(pairs, bits, context, escapes))
    return model


def fit_language_model(labelled: DataFrame, *, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", rows_per_language: int = 300, bytes_per_language: int = 1 << 20, order: int = 3) -> LanguageModel | None:
    """Count the trees on about ``rows_per_language`` texts and ``bytes_per_language`` bytes of each language at most, picked by a hash of the id.

    The bounds keep driver memory fixed for each language; ``order`` symbols of context are kept.
    """
    known = labelled.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"), F.col(id_column).alias("id")).where("text is not null and lang is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, rows_per_language / r["n"], bytes_per_language / max(r["bytes"], 1))))])
    drawn = known.where(F.octet_length("text") <= bytes_per_language).where((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000.0) < share[F.col("lang")])
    samples = sorted((r["lang"], r["text"]) for r in drawn.select("lang", "text").collect())
    return train([(lang, FOLD[np.frombuffer(text.encode(), np.uint8)]) for lang, text in samples if text], order)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lower = data | 0x20
    letter = (lower >= 97) & (lower <= 122)
    running = np.concatenate([[0], np.cumsum(letter)])
    found = running[offsets[1:]] > running[offsets[:-1]]
    for i in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
    return found


def identify_language(docs: DataFrame, model: LanguageModel | None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ``lang_pred``, ``score`` (posterior of the winner under equal priors), ``bits_per_byte`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, texts in chunks(batch.column(1)):
                known = _has_letter(texts.data, texts.offsets) & (model is not None)
                lang, score, rate = np.full(len(texts), "und", object), np.zeros(len(texts)), np.full(len(texts), np.nan)
                if model is not None:
                    bits = model.bits(texts.data, texts.offsets)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(best)), best]
                    posterior = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    lang[known] = np.array(model.languages, object)[best[known]]
                    score[known] = posterior[known]
                    rate = least / np.maximum(np.diff(texts.offsets), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rate, mask=~known)],
                    ["id", "lang_pred", "score", "bits_per_byte"],
                )

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return map_arrow(narrow, run, f"id {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_column)
