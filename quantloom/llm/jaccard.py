"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A text is the set of its 5-word shingles. Shingles are ordered by how often they were seen in the corpus, rarest first,
so that a set's prefix holds its rarest shingles. With prefixes of any lengths p and q, two sets of n and m shingles
share at most max(n - p, m - q) ones beyond those that are in both prefixes; so sets with a Jaccard similarity of t or
more, which share a = ceil(t / (1 + t) (n + m)) at least, have a - max(n - p, m - q) shingles in both prefixes. A prefix
of n - ceil(t n) + 1 asks for one at least. A text whose prefix meets frequent shingles takes a longer one, as the
estimated cost of its candidates says, and is asked for correspondingly more. Order and lengths steer cost only, never
the result.

Copies never meet pairwise:

1. Equal sets become one node, found by hashes of the whole set.
2. Every shingle's list of nodes is tied to the one whose shingles are the best known in the corpus (a star), the best
   tie of each node is verified, and the verified ties give first groups. A list within one group is done.
3. In the other lists all pairs between different groups are counted, but only by joining the nodes outside of a list's
   largest group with the list, and only on shingles that can be the first of those that both prefixes share. Pairs
   whose prefixes share enough are verified on the whole sets.

Every link between different groups is so found, which makes the components those of the full link graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import connected_components
from .kernels import Texts, chunks, mix, signed
from .storage import bounded, free, map_arrow, materialise


@dataclass(frozen=True)
class JaccardJoin:
    words: int = 5
    percent: int = 80
    #: Shingles that a prefix may be longer than the shortest valid one.
    longer_by: tuple[int, ...] = (0, 1, 3, 7)
    #: How many shingles' frequencies steer the order; the others count as rare.
    frequent_shingles: int = 200_000
    #: Shingles of a run of texts in which repeated ones are counted at once.
    counted_shingles: int = 2_000_000
    #: Nodes of one frequent shingle that one task should meet at most, by estimate, in the first tie.
    list_rows: int = 20_000
    #: Cost of verifying a candidate, in list entries read.
    verify_cost: float = 20.0


def shingle_sets(texts: Texts, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: k-word windows, or the whole sequence of fewer words."""
    words = texts.words("space", lower=True)
    hashes, _, bounds = words.windows(k)
    short = {}
    for d in np.flatnonzero((words.counts > 0) & (words.counts < k)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in words.hashes[words.bounds[d] : words.bounds[d + 1]]:
                h = h * np.uint64(0x9E3779B97F4A7C15) + x
        short[d] = mix(np.array([h], np.uint64) + np.uint64(words.counts[d]))
    for d in range(len(texts)):
        yield short[d] if d in short else np.unique(hashes[bounds[d] : bounds[d + 1]])


def fingerprint(shingles: np.ndarray) -> int:
    """Order-free hash of a set."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ np.uint64(0xA5A5A5A5C3C3C3C3)).sum(dtype=np.uint64)
    return int(total.view(np.int64))


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _profile(docs: DataFrame, how: JaccardJoin) -> DataFrame:
    """Rows of kind 0: id, n, fp of each text. Kind 1: shingles seen in several texts of a run of texts, with how many."""
    kind = docs.schema["id"].dataType.simpleString()

    def repeated(sets: list[np.ndarray], ids: pa.DataType) -> pa.RecordBatch:
        every = np.concatenate(sets)
        sets.clear()
        every.sort()
        same = every[1:] == every[:-1]
        edge = np.concatenate([[False], same]) != np.concatenate([same, [False]])
        # runs of one shingle begin and end in turn
        bounds = np.flatnonzero(edge)
        tokens, times = every[bounds[::2]], bounds[1::2] - bounds[::2] + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(tokens), np.int8)), pa.nulls(len(tokens), ids), pa.array(times.astype(np.int64)), pa.array(signed(tokens))], ["kind", "id", "n", "fp"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, ids = [], 0, None
        for batch in batches:
            n, fp, ids = [], [], batch.schema.field(0).type
            for _, texts in chunks(batch.column(1)):
                for s in shingle_sets(texts, how.words):
                    n.append(len(s))
                    fp.append(fingerprint(s))
                    sets.append(s)
                    held += len(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n), np.int8)), batch.column(0), pa.array(np.array(n, np.int64)), pa.array(np.array(fp, np.int64))], ["kind", "id", "n", "fp"]
            )
            if held >= how.counted_shingles:
                yield repeated(sets, ids)
                held = 0
        if held:
            yield repeated(sets, ids)

    return map_arrow(docs, run, f"kind tinyint, id {kind}, n long, fp long")


def _prefixes(docs: DataFrame, how: JaccardJoin, tokens: np.ndarray, times: np.ndarray) -> DataFrame:
    """(token, pos, salt, fp, n, rest, known): each node's prefix, once for each task that meets the node.

    pos: place of the shingle in the prefix.     salt: part of a long list, -1 for a list in one part. rest: shingles beyond the prefix. known: thousandths of the set's shingles that are frequent ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokens, times))

    def length(n: int, cost: np.ndarray) -> int:
        shortest = n - _least_overlap(n, how.percent) + 1
        best, least = shortest, None
        for more in how.longer_by:
            size = min(n, shortest + more)
            seen = float(cost[:size].sum())
            now = seen + how.verify_cost * seen / (1 + more) + size
            if least is None or now < least:
                best, least = size, now
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, times = shared.value
        met: set[tuple[int, int]] = set()
        for batch in batches:
            for _, texts in chunks(batch.column(1)):
                parts = []
                for s in shingle_sets(texts, how.words):
                    n = len(s)
                    key = (fingerprint(s), n) if n else None
                    if not n or key in met:
                        continue
                    met.add(key)
                    often = np.zeros(n, np.int64)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        often = np.where(tokens[at] == s, times[at], 0)
                        if often.any():
                            order = np.argsort(often, kind="stable")
                            s, often = s[order], often[order]
                    size = length(n, often)
                    salts = 1 + often[:size] // how.list_rows
                    parts.append((s[:size], np.where(salts > 1, key[0] % salts, -1), key, int(1000 * np.count_nonzero(often) / n)))
                if parts:
                    sizes = [len(p[0]) for p in parts]
                    each = lambda values, kind: pa.array(np.repeat(np.array(values, kind), sizes))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(np.concatenate([p[0] for p in parts]))), pa.array(np.concatenate([np.arange(size) for size in sizes]).astype(np.int32)), pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)),
                            each([p[2][0] for p in parts], np.int64), each([p[2][1] for p in parts], np.int32),
                            each([p[2][1] - size for p, size in zip(parts, sizes, strict=True)], np.int32), each([p[3] for p in parts], np.int16),
                        ],
                        ["token", "pos", "salt", "fp", "n", "rest", "known"],
                    )

    return map_arrow(docs.select("id", "text"), run, "token long, pos int, salt int, fp long, n int, rest int, known smallint")


def _frequent(profile: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ``most`` at most, sorted, with how often they were seen; ties at the end are left out.

    A count by frequency gives the least frequency that counts, so that no more than ``most`` rows ever meet in the driver.
    """
    counted = materialise(profile.where("kind = 1").groupBy("fp").agg(F.sum("n").alias("times")), "counted")
    # frequencies are told apart up to 10,000 and by their leading digits beyond
    step = F.pow(10.0, F.greatest(F.length(F.col("times").cast("string")) - 4, F.lit(0)))
    level = (F.floor(F.col("times") / step) * step).cast("long")
    levels = counted.groupBy(level.alias("level")).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect()
    least, held = None, 0
    for row in levels:
        held += row["c"]
        if held > most:
            break
        least = row["level"]
    if least is None:
        free(counted)
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    often = counted.where(F.col("times") >= least).toPandas()
    free(counted)
    tokens = often["fp"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], often["times"].to_numpy(np.int64)[order]


#: Columns of a prefix entry.
ENTRY = ("token", "pos", "salt", "fp", "n", "rest", "known")


def _met(entries: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of entries sorted by token and salt: those of lists with several nodes, and of all parts of long ones, each node once, with the list's best-known node."""
    fresh = lambda *keys: np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]) if len(keys[0]) else np.zeros(0, bool)
    run = np.cumsum(fresh(entries["token"], entries["salt"]))
    several = (np.bincount(run)[run] > 1) | (entries["salt"] >= 0) if len(run) else np.zeros(0, bool)
    entries, run = {k: v[several] for k, v in entries.items()}, run[several]
    # copies met in several tasks are one node; the last one of each run is the best known
    order = np.lexsort((entries["fp"], entries["n"], entries["known"], run))
    entries, run = {k: v[order] for k, v in entries.items()}, run[order]
    first = fresh(run, entries["fp"], entries["n"])
    entries, run = {k: v[first] for k, v in entries.items()}, run[first]
    size = np.bincount(run)[run] if len(run) else run
    last = np.flatnonzero(np.append(run[1:] != run[:-1], True)) if len(run) else run
    pivot = np.repeat(last, np.diff(np.append(-1, last)))
    keep = (size > 1) | (entries["salt"] >= 0)
    out = {k: entries[k] for k in ("token", "pos", "fp", "n", "rest")} | {f"{k}2": entries[k][pivot] for k in ("fp", "n", "rest")}
    return {k: v[keep] for k, v in out.items()}


def _lists(dealt: DataFrame) -> DataFrame:
    """(token, pos, fp, n, rest, fp2, n2, rest2): entries of the shingles that several nodes have in their prefixes, with the best-known node of the list.

    Entries are dealt out and sorted by shingle; most shingles stand in one prefix only and go as they stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "pos", "fp", "n", "rest", "fp2", "n2", "rest2")
        held: list[dict[str, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            met = _met({c: np.concatenate([h[c] for h in held]) for c in ENTRY})
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(met[c]) for c in names], [*names])

        for batch in batches:
            own = {c: batch.column(c).to_numpy() for c in ENTRY}
            if not batch.num_rows:
                continue
            # the last list may go on in the next batch
            edge = np.flatnonzero((own["token"][1:] != own["token"][:-1]) | (own["salt"][1:] != own["salt"][:-1])) + 1
            last = [h[c][-1] for h in held[-1:] for c in ("token", "salt")]
            if held and last != [own["token"][0], own["salt"][0]]:
                yield out()
            if len(edge):
                held.append({c: v[: edge[-1]] for c, v in own.items()})
                yield out()
                own = {c: v[edge[-1] :] for c, v in own.items()}
            held.append(own)
        if held:
            yield out()

    return map_arrow(dealt.repartition("token", "salt").sortWithinPartitions("token", "salt"), run, "token long, pos int, fp long, n int, rest int, fp2 long, n2 int, rest2 int")


def _least_shared(n, m, rest, rest2, percent: int):
    """Shingles that the prefixes of two similar sets share at least."""
    overlap = F.call_function("div", percent * (n + m).cast("long") + (99 + percent), F.lit(100 + percent)).cast("int")
    return F.greatest(overlap - F.greatest(rest, rest2), F.lit(1))


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``wanted`` (rep, fp, n, and further columns) with the shingles of the text that stands for each node."""
    more = [c for c in wanted.columns if c not in ("rep", "fp", "n")]
    joined = docs.join(bounded(wanted), docs["id"] == wanted["rep"]).select("text", "fp", "n", "rep", *more)
    rest = joined.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            for rows, texts in chunks(batch.column(0)):
                sets = [*shingle_sets(texts, k)]
                # of rows that share an id only one with the node's own set counts
                right = []
                for s, *key in zip(sets, *(batch.column(c)[rows].to_pylist() for c in rest), strict=True):
                    right.append((len(s), fingerprint(s)) == (key[1], key[0]) and (*key,) not in met)
                    if right[-1]:
                        met.add((*key,))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                values = pa.array(signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64))
                out = pa.RecordBatch.from_arrays([*(batch.column(c)[rows] for c in rest), pa.ListArray.from_arrays(offsets, values)], [*rest, "shingles"])
                yield out.filter(pa.array(right, pa.bool_()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name != "text")
    return map_arrow(joined, run, f"{fields}, shingles array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, how: JaccardJoin, *, once: bool) -> DataFrame:
    """(u, v): ids that stand for the two nodes of each pair (fp, n, fp2, n2) whose whole sets are similar enough.

    ``once``: every node is in one pair at most on the left. Otherwise a node's set is made once and then met by its pairs.
    """
    named = pairs.join(nodes, ["fp", "n"]).join(nodes.select(F.col("fp").alias("fp2"), F.col("n").alias("n2"), F.col("rep").alias("rep2")), ["fp2", "n2"])
    named = materialise(named.where("rep is not null and rep2 is not null").select("rep", "fp", "n", "rep2", "fp2", "n2"), "pairs")
    if once:
        left = _sets_of(docs, named, how.words)
    else:
        left = named.join(_sets_of(docs, named.select("rep", "fp", "n").distinct(), how.words).select("fp", "n", "shingles"), ["fp", "n"])
    right = _sets_of(docs, named.select(F.col("rep2").alias("rep"), F.col("fp2").alias("fp"), F.col("n2").alias("n")).distinct(), how.words)
    right = right.select(F.col("fp").alias("fp2"), F.col("n").alias("n2"), F.col("shingles").alias("other"))
    both = left.join(right, ["fp2", "n2"]).withColumn("common", F.size(F.array_intersect("shingles", "other")))
    return both.where(100 * F.col("common") >= how.percent * (F.col("n") + F.col("n2") - F.col("common"))).select(F.col("rep").alias("u"), F.col("rep2").alias("v"))


def jaccard_components(docs: DataFrame, how: JaccardJoin | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ``n_shingles``, ``component_id`` for every row of ``docs``.

    Null and word-less texts have no shingles and are linked with nothing. Rows with the same id are one document of
    the link graph. A row with a null id cannot name a component: its ``component_id`` is the one of the texts with an
    equal set, or null. Repeated rows get equal results, an empty table gives no rows, long texts count whole. Other
    columns are not read.
    """
    how = how or JaccardJoin()
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    profile = materialise(_profile(docs, how), "profile")
    rows = profile.where("kind = 0").select("id", F.col("n").cast("int").alias("n"), "fp")
    tokens, times = _frequent(profile, how.frequent_shingles)
    nodes = materialise(rows.where("n > 0").groupBy("fp", "n").agg(F.min("id").alias("rep")), "nodes")
    lists = materialise(_lists(_prefixes(docs, how, tokens, times)), "lists")

    def near(n, m):
        return 100 * F.least(n, m) >= how.percent * F.greatest(n, m)

    ties = lists.where(((F.col("fp") != F.col("fp2")) | (F.col("n") != F.col("n2"))) & near("n", "n2"))
    ties = ties.groupBy("fp", "n", "fp2", "n2").agg(F.count("*").alias("shared"), F.min("rest").alias("rest"), F.min("rest2").alias("rest2"))
    ties = ties.where(F.col("shared") >= _least_shared(F.col("n"), F.col("n2"), F.col("rest"), F.col("rest2"), how.percent))
    best = ties.groupBy("fp", "n").agg(F.max(F.struct("shared", "fp2", "n2")).alias("b"))
    first = materialise(_verified(docs, best.select("fp", "n", "b.fp2", "b.n2"), nodes, how, once=True), "links")

    groups = materialise(connected_components(first), "groups")
    named = nodes.join(groups.withColumnRenamed("vertex", "rep"), "rep", "left").select("fp", "n", "rep", F.coalesce("component", "rep").alias("group"))
    named = materialise(named, "named")
    # k: lists that a node stands in, the most that it can share with another
    placed = lists.select("token", "pos", "fp", "n", "rest").join(named.select("fp", "n", "group"), ["fp", "n"])
    placed = placed.withColumn("k", F.count("*").over(Window.partitionBy("fp", "n")).cast("int"))
    shares = placed.groupBy("token", "group").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "group")).alias("m"), F.count("*").alias("g"), F.sum("c").alias("size")).where("g > 1")
    # a long list is met in parts: its nodes outside of the main group are dealt out, the whole list goes to each part
    shares = shares.select("token", F.col("m.group").alias("main"), F.ceil(F.col("size") / how.list_rows).cast("int").alias("parts"))
    open_lists = materialise(placed.join(shares, "token"), "open")
    a = open_lists.where("group <> main").withColumn("part", F.pmod(F.xxhash64("fp", "n"), F.col("parts")).cast("int")).alias("a")
    b = open_lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    least = _least_shared(F.col("a.n"), F.col("b.n"), F.col("a.rest"), F.col("b.rest"), how.percent)
    met = a.join(
        b,
        (F.col("a.token") == F.col("b.token")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.group") != F.col("b.group")) & near(F.col("a.n"), F.col("b.n")) & (F.least("a.k", "b.k") >= least)
        # the first shingle that two similar sets share has the others behind it in both prefixes
        & (F.col("a.pos") <= F.col("a.n") - F.col("a.rest") - least) & (F.col("b.pos") <= F.col("b.n") - F.col("b.rest") - least)
        & ((F.col("b.group") == F.col("b.main")) | (F.col("a.group") < F.col("b.group"))),
    )
    # a pair may be met from either side in different lists
    both = [F.when(F.col("a.group") < F.col("b.group"), F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(f"{c}{i}") for x, y, i in (("a", "b", ""), ("b", "a", "2")) for c in ("fp", "n")]
    pairs = met.select(*both).distinct()
    # count what the whole prefixes share before whole sets are met
    prefixes = lists.groupBy("fp", "n").agg(F.collect_list("token").alias("t"), F.min("rest").alias("rest"))
    pairs = pairs.join(prefixes, ["fp", "n"]).join(prefixes.select(*(F.col(c).alias(f"{c}2") for c in prefixes.columns)), ["fp2", "n2"])
    pairs = pairs.where(F.size(F.array_intersect("t", "t2")) >= _least_shared(F.col("n"), F.col("n2"), F.col("rest"), F.col("rest2"), how.percent))
    second = _verified(docs, pairs.select("fp", "n", "fp2", "n2"), nodes, how, once=False)

    # texts under one id are one document
    with_rep = rows.join(named, ["fp", "n"], "left")
    twice = with_rep.where("id is not null and rep is not null").groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v")
    same = with_rep.join(twice.select("id"), "id").where("rep <> id").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    # the links found last are between groups
    between = _of_groups(_of_groups(second.union(same), groups, "u"), groups, "v")
    component = connected_components(between)
    free(nodes, lists, open_lists, first)
    done = named.join(component.withColumnRenamed("vertex", "group"), "group", "left").select("fp", "n", F.coalesce("component", "group").alias("component_id"))
    out = rows.join(done, ["fp", "n"], "left")
    return out.select(F.col("id").alias(id_column), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("id"))).alias("component_id"))


def _of_groups(edges: DataFrame, groups: DataFrame, end: str) -> DataFrame:
    """``edges`` with the group that the vertex at ``end`` is in, if any."""
    return edges.join(groups.withColumnRenamed("vertex", end), end, "left").withColumn(end, F.coalesce("component", end)).select("u", "v")


def _with_set(docs: DataFrame, text_column: str, k: int) -> DataFrame:
    """``docs`` with the hash and size of each text's set."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch.column(at)):
                sets = [*shingle_sets(texts, k)]
                own = [pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(c[rows] for c in batch.columns), *own], [*batch.schema.names, "_fp", "_n"])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField("_fp", LongType()), StructField("_n", LongType())]))


def _first_row(rows: DataFrame, keys: list[str], columns: list[str], text_column: str) -> DataFrame:
    """One row of each key, combined before the shuffle; a text with words comes before one without."""
    order = F.struct(~F.coalesce(F.col(text_column).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.xxhash64(text_column), F.xxhash64(*columns))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")


def one_of_each(docs: DataFrame, components: DataFrame, how: JaccardJoin | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component: of the smallest id, and of its rows one with shingles, the first by hash.

    Rows with a null id go if a row with an id has an equal set, else one of each set stays; word-less ones, which are
    linked with nothing, stay. An empty table gives an empty one; columns come back as they were.
    """
    how, names = how or JaccardJoin(), docs.columns
    own = {c: f"kept{c}" for c in names if c in ("_fp", "_n")}
    out = _one_of_each(docs.withColumnsRenamed(own), components, how, id_column, text_column)
    return out.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in names))


def _one_of_each(docs: DataFrame, components: DataFrame, how: JaccardJoin, id_column: str, text_column: str) -> DataFrame:
    named, unnamed = docs.where(F.col(id_column).isNotNull()), docs.where(F.col(id_column).isNull())
    gone = components.where(F.col("component_id") != F.col(id_column)).select(F.col(id_column)).distinct()
    named = named.join(bounded(gone), id_column, "left_anti").select(docs.columns)
    twice = materialise(components.where(F.col("component_id") == F.col(id_column)).groupBy(id_column).count().where("count > 1").select(id_column), "twice")
    out = named
    if not twice.isEmpty():
        again = named.join(bounded(twice), id_column, "left_semi").select(docs.columns)
        out = named.join(bounded(twice), id_column, "left_anti").select(docs.columns).unionByName(_first_row(again, [id_column], docs.columns, text_column))
    if unnamed.isEmpty():
        return out
    hashed = materialise(_with_set(unnamed, text_column, how.words), "unnamed")
    wanted = bounded(hashed.where("_n > 0").select("_fp", "_n").distinct())
    known = materialise(_with_set(docs.where(F.col(id_column).isNotNull()).select(text_column), text_column, how.words).select("_fp", "_n").join(wanted, ["_fp", "_n"], "left_semi").distinct(), "known")
    new = hashed.where("_n > 0").join(bounded(known), ["_fp", "_n"], "left_anti")
    return out.unionByName(_first_row(new, ["_fp", "_n"], docs.columns, text_column)).unionByName(hashed.where("_n = 0").select(docs.columns))
