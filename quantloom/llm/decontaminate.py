"""Benchmark decontamination by greedy string tiling.

Tokens are case-folded runs of letters and digits of any script, in compatibility form; each CJK character is a token of
its own, as such scripts put no spaces between words. Runs of ``min_match`` tokens that a text shares with a benchmark
passage are seeds, found by Karp-Rabin hashes of all its windows. For a text and a passage with enough seeds, the longest
matches are marked first, none overlapping a marked one on either side, until no match of ``min_match`` tokens is left.
A text is contaminated by a passage of which the marked tokens cover ``coverage`` or more, in whatever order they stand.
Passages with fewer tokens than ``min_match`` must occur whole; passages without a token match nothing.

The benchmark is taken in blocks of bounded bytes, each broadcast to one pass over the documents, so no documents are
shuffled. What many passages share (a common opening, a licence) is not expanded to all of them: a passage is met through
its own windows, or, if those common to more than ``common`` passages alone cover enough of it, as the shortest of the
passages with the same common parts, which is the most covered one of them. The result has one row for each contaminated
id, with its most covered passage; it doesn't grow with the number of passages that a text holds.

Null and empty texts are never contaminated; long ones are read whole. Rows that share an id give one row, of the more
contaminated text. Repeated passages count once. Without documents or passages the result is empty. Other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernels import Words, chunks
from .storage import map_arrow

_ASCII = {i: " " for i in range(128) if not chr(i).isalnum()}
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_BETWEEN = re.compile(r"[\W_]+")
#: Texts are folded in runs of so many rows.
_ROWS = 256


@dataclass(frozen=True)
class Tiling:
    min_match: int = 5
    coverage: float = 0.5
    #: Bytes of passages broadcast at once, about.
    block_bytes: int = 8 << 20
    #: Windows of more passages than this are common.
    common: int = 64


def fold(text: str) -> str:
    """The tokens of a text, lower-case, with spaces between them."""
    if text.isascii():
        return text.lower().translate(_ASCII)
    return _BETWEEN.sub(" ", _CJK.sub(r" \g<0> ", unicodedata.normalize("NFKC", text).casefold()))


def token_runs(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """Tokens of runs of texts, with the row that each run begins at."""
    for at in range(0, len(column), _ROWS):
        folded = pa.array([fold(x.as_py() or "") for x in column.slice(at, _ROWS)], pa.large_string())
        for rows, texts in chunks(folded):
            yield at + rows.start, texts.words("space")


class Passages:
    """A block of passages, and an index of the windows through which they are met."""

    def __init__(self, items: list[tuple[object, str]], how: Tiling):
        self.ids: list[object] = []
        self.tokens: list[np.ndarray] = []
        self.windows: list[np.ndarray] = []
        for at, words in token_runs(pa.array([t for _, t in items], pa.string())):
            own = {k: words.windows(k) for k in {min(how.min_match, int(n)) for n in words.counts if n}}
            for d, n in enumerate(words.counts):
                if n:
                    hashes, _, bounds = own[min(how.min_match, int(n))]
                    self.ids.append(items[at + d][0])
                    self.tokens.append(words.hashes[words.bounds[d] : words.bounds[d + 1]].copy())
                    self.windows.append(hashes[bounds[d] : bounds[d + 1]].copy())
        sizes = np.array([min(how.min_match, len(t)) for t in self.tokens], np.int64)
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == k)
            found = np.concatenate([np.unique(self.windows[i]) for i in own])
            item = np.repeat(own, [len(np.unique(self.windows[i])) for i in own])
            values, times = np.unique(found, return_counts=True)
            often = values[times > how.common]
            rare = ~np.isin(found, often)
            met = [(found[rare], item[rare])]
            if len(often):
                stand_ins = self._of_common_parts(own.tolist(), often, k, how)
                met.append((found[~rare & np.isin(item, stand_ins)], item[~rare & np.isin(item, stand_ins)]))
            hashes, at = np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met])
            order = np.lexsort((at, hashes))
            self.index[k] = hashes[order], at[order]

    def _of_common_parts(self, own: list[int], often: np.ndarray, k: int, how: Tiling) -> list[int]:
        """Of the passages that common windows cover enough of: the shortest of those with the same common parts."""
        groups: dict[bytes, list[int]] = defaultdict(list)
        for i in own:
            covered = spread(np.flatnonzero(np.isin(self.windows[i], often)), len(self.tokens[i]), k)
            if covered.sum() >= how.coverage * len(self.tokens[i]) and covered.any():
                # parts are told apart by a zero between them
                parts = np.where(covered, self.tokens[i], 0)
                parts = parts[covered | np.concatenate([[False], covered[:-1]])]
                groups[parts.tobytes()].append(i)
        return [min(g, key=lambda i: (len(self.tokens[i]), _order(self.ids[i]))) for g in groups.values()]


def _order(item: object) -> tuple:
    return item is None, item if item is not None else 0


def spread(at: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n tokens the windows of k tokens at the given places cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + k, -1)
    return np.cumsum(edges[:-1]) > 0


def tile(text: np.ndarray, passage: np.ndarray, seeds: np.ndarray, k: int) -> int:
    """Tokens of the passage that greedy tiles cover. seeds: rows of (place in the text, place in the passage)."""
    diagonal = seeds[:, 0] - seeds[:, 1]
    order = np.lexsort((seeds[:, 0], diagonal))
    seeds, diagonal = seeds[order], diagonal[order]
    fresh = np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (seeds[1:, 0] != seeds[:-1, 0] + 1)])
    firsts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(firsts, len(seeds))) + k - 1
    heap = [(-int(n), int(p), int(t)) for n, (t, p) in zip(lengths, seeds[firsts], strict=True)]
    heapq.heapify(heap)
    in_text, in_passage = np.zeros(len(text), bool), np.zeros(len(passage), bool)
    while heap:
        n, p, t = heapq.heappop(heap)
        n = -n
        free = ~(in_text[t : t + n] | in_passage[p : p + n])
        if free.all():
            in_text[t : t + n] = in_passage[p : p + n] = True
        elif free.sum() >= k:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a >= k:
                    heapq.heappush(heap, (int(a - b), p + int(a), t + int(a)))
    return int(in_passage.sum())


def _best(tokens: np.ndarray, windows: np.ndarray, candidates: np.ndarray, passages: Passages, k: int, how: Tiling) -> tuple[object, float] | None:
    """The passage that covers most, of those that cover enough; of equal ones the first id."""
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    bounds = []
    for i in candidates.tolist():
        own = passages.windows[i]
        low = np.searchsorted(ordered, own)
        there = (low < len(ordered)) & (ordered[np.minimum(low, len(ordered) - 1)] == own)
        most = int(spread(np.flatnonzero(there), len(passages.tokens[i]), k).sum())
        if most >= how.coverage * len(passages.tokens[i]):
            bounds.append((-most / len(passages.tokens[i]), _order(passages.ids[i]), i, np.flatnonzero(there), low[there]))
    best = None
    for least, _, i, spots, low in sorted(bounds, key=lambda x: x[:3]):
        # tiles cover no more than all seeds do
        if best is not None and -least <= best[1]:
            break
        times = np.searchsorted(ordered, passages.windows[i][spots], side="right") - low
        place = order[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        covered = tile(tokens, passages.tokens[i], np.stack([place, np.repeat(spots, times)], axis=1), k) / len(passages.tokens[i])
        if covered >= how.coverage and (best is None or covered > best[1]):
            best = passages.ids[i], covered
    return best


def _matches(words: Words, passages: Passages, how: Tiling) -> dict[int, tuple[object, float]]:
    """By text of a run: the passage that contaminates it most, and its coverage."""
    out: dict[int, tuple[object, float]] = {}
    for k, (hashes, items) in passages.index.items():
        windows, at, bounds = words.windows(k)
        if not len(windows) or not len(hashes):
            continue
        low = np.searchsorted(hashes, windows)
        hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == windows))
        owner = np.searchsorted(bounds, hit, side="right") - 1
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(hit) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            d = int(owner[a])
            seen = np.unique(windows[hit[a:b]])
            first, last = np.searchsorted(hashes, seen), np.searchsorted(hashes, seen, side="right")
            candidates = np.unique(np.concatenate([items[x:y] for x, y in zip(first, last, strict=True)]))
            best = _best(words.hashes[words.bounds[d] : words.bounds[d + 1]], windows[bounds[d] : bounds[d + 1]], candidates, passages, k, how)
            if best is not None and (d not in out or (-best[1], _order(best[0])) < (-out[d][1], _order(out[d][0]))):
                out[d] = best
    return out


def _blocks(benchmark: DataFrame, how: Tiling, item_column: str, text_column: str) -> Iterator[Passages]:
    items = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(size / how.block_bytes))
    for i in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield Passages(sorted(((r["item"], r["text"]) for r in own.collect()), key=lambda x: (_order(x[0]), x[1])), how)


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Tiling | None = None, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """(id, item_id, coverage) of every contaminated id of ``docs``: its most covered passage, of equal ones the smallest."""
    how = how or Tiling()
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kinds = docs.schema["id"].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_column].dataType)

    def over(passages: Passages) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, words in token_runs(batch.column(1)):
                    found = [(begin + d, i, c) for d, (i, c) in _matches(words, shared.value, how).items()]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], item_type), pa.array([x[2] for x in found], pa.float64())],
                        ["id", "item_id", "coverage"],
                    )

        return map_arrow(docs, run, f"id {kinds[0]}, item_id {kinds[1]}, coverage double")

    found = reduce(DataFrame.union, [over(p) for p in _blocks(benchmark, how, item_column, "text")])
    best = found.groupBy("id").agg(F.min_by(F.struct("item_id", "coverage"), F.struct(-F.col("coverage"), F.col("item_id").isNull(), "item_id")).alias("best"))
    return best.select(F.col("id").alias(id_column), "best.item_id", "best.coverage")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, how: Tiling | None = None, *, text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """``docs`` without the contaminated rows, its columns unchanged."""
    how = how or Tiling()
    names, schema = docs.columns, docs.schema
    for passages in _blocks(benchmark, how, item_column, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for begin, words in token_runs(batch.column(names.index(text_column))):
                    keep[[begin + d for d in _matches(words, shared.value, how)]] = False
                yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, run, schema)
    return docs
