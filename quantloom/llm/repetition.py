"""Quality rules on repetition: characters inside duplicated word n-grams and duplicated lines.

Rolling hashes of several n-gram lengths are taken over all words of a batch at once in numpy. Long n-grams (5 to 10) are
measured by the characters inside any that occur twice or more. Short ones (2 to 4) repeat in all prose; of these the one
that fills most of the text counts, if it occurs ``top_times`` or more, which catches a phrase that comes back between
other words, where no long n-gram does. A text is judged on its own, so there is no shuffle and memory is bounded by one
Arrow batch.

Null text is the empty text: all counts 0, ``base_failed`` true. Repeated rows are judged alike; an empty table gives no
rows; long texts are measured whole. Only ``id_column`` and ``text_column`` are read, so further columns, whatever their
names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, chunks, code_points, mix
from .storage import map_arrow

SYMBOLS = "#*$%&|<>"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ngram_coverage array<double>, top_coverage array<double>, line_coverage double, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class RepetitionRules:
    """Largest shares of a text's word characters."""

    #: Inside n-grams found twice or more, by n.
    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.30, 7: 0.25, 10: 0.20})
    #: In the occurrences of one n-gram found ``top_times`` or more, by n.
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    top_times: int = 4
    #: Inside repeated lines.
    lines: float = 0.30
    min_words: int = 10
    repeat_window: int = 5
    repeat_percent: int = 20


def _covered(words, text_of_word: np.ndarray, n: int, texts: int) -> np.ndarray:
    """Which words lie in an n-word window that occurs twice or more in its text."""
    hashes, at, _ = words.windows(n)
    out = np.zeros(len(words.hashes) + 1, np.int64)
    if len(hashes):
        keys = hashes ^ mix(text_of_word[at].astype(np.uint64))
        ordered = np.sort(keys)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            hit = at[np.isin(keys, np.unique(again))]
            np.add.at(out, hit, 1)
            np.subtract.at(out, hit + n, 1)
    return np.cumsum(out[:-1]) > 0


def _most(words, text_of_word: np.ndarray, sizes: np.ndarray, n: int, times: int, texts: int) -> np.ndarray:
    """Per text: characters in all occurrences of the n-gram that has most of them, of those that occur ``times`` or more."""
    hashes, at, _ = words.windows(n)
    out = np.zeros(texts, np.int64)
    if len(hashes):
        keys = hashes ^ mix(text_of_word[at].astype(np.uint64))
        order = np.argsort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        count = np.diff(np.append(first, len(keys)))
        one = at[order[first]]
        running = np.concatenate([[0], np.cumsum(sizes)])
        often = count >= times
        np.maximum.at(out, text_of_word[one[often]], (count * (running[one + n] - running[one]))[often])
    return out


def _lines(texts: Texts, words, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line; characters of words in any line that occurs twice or more."""
    data, offsets = texts.data, texts.offsets
    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], cuts + 1]))
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    repeats, chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if not len(starts):
        return repeats, chars
    owner = np.searchsorted(offsets[1:], starts, side="right")
    ends = np.append(starts[1:], len(data))
    ends = np.minimum(ends, offsets[owner + 1])
    has_newline = data[ends - 1] == 10
    ends = ends - has_newline
    low, high = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    full = high > low
    starts, ends, owner, low, high = (x[full] for x in (starts, ends, owner, low, high))
    seen: dict[tuple[int, bytes], int] = {}
    raw = data.tobytes()
    word_points = np.concatenate([[0], np.cumsum(points[words.ends] - points[words.starts])])
    first: dict[tuple[int, bytes], int] = {}
    for i, (a, b, d) in enumerate(zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True)):
        key = (d, raw[a:b])
        count = seen.get(key, 0)
        seen[key] = count + 1
        size = int(word_points[high[i]] - word_points[low[i]])
        if count:
            repeats[d] += 1
            chars[d] += size + (first[key] if count == 1 else 0)
        else:
            first[key] = size
    return repeats, chars


def measure(texts: Texts, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """All counts and verdicts of a run of texts."""
    words = texts.words("space")
    points = code_points(texts.data)
    sizes = points[words.ends] - points[words.starts]
    owner = np.repeat(np.arange(len(texts)), words.counts)
    total = lambda values: np.bincount(owner, weights=values, minlength=len(texts)).astype(np.int64)
    n_words, word_chars = words.counts.astype(np.int64), total(sizes)
    symbol = np.zeros(256, np.int64)
    symbol[[ord(c) for c in SYMBOLS]] = 1
    running = np.concatenate([[0], np.cumsum(symbol[texts.data])])
    n_symbols = running[texts.offsets[1:]] - running[texts.offsets[:-1]]
    n_dup_lines, line_chars = _lines(texts, words, points)
    covered = {n: _covered(words, owner, n, len(texts)) for n in {*rules.ngrams, rules.repeat_window}}
    n_repeat_words = total(covered[rules.repeat_window])
    base_failed = (n_words < rules.min_words) | (100 * n_repeat_words > rules.repeat_percent * n_words)
    share = lambda chars: chars / np.maximum(word_chars, 1)
    coverage = np.stack([share(total(covered[n] * sizes)) for n in rules.ngrams], axis=1) if rules.ngrams else np.zeros((len(texts), 0))
    top = np.stack([share(_most(words, owner, sizes, n, rules.top_times, len(texts))) for n in rules.top], axis=1) if rules.top else np.zeros((len(texts), 0))
    line_coverage = share(line_chars)
    bad = (coverage > np.array([*rules.ngrams.values()])).any(axis=1) | (top > np.array([*rules.top.values()])).any(axis=1) | (line_coverage > rules.lines)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
        "ngram_coverage": coverage, "top_coverage": top, "line_coverage": line_coverage, "base_failed": base_failed, "kept": ~base_failed & ~bad,
    }


def repetition_rules(docs: DataFrame, rules: RepetitionRules | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the counts, the coverages and whether it is kept."""
    rules = rules or RepetitionRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch.column(1)):
                out = measure(texts, rules)
                columns = [batch.column(0)[rows]]
                for name, values in out.items():
                    columns.append(pa.array(list(values), pa.list_(pa.float64())) if values.ndim == 2 else pa.array(values))
                yield pa.RecordBatch.from_arrays(columns, ["id", *out])

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return map_arrow(narrow, run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_column)
