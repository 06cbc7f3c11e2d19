"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target share of all words, at most ``cap`` times its own, with the excess reshared by weight. Its
documents all want the same fractional number of copies. Whole copies are given to each; the fractional rests are
rounded in pairs: mass moves at random from one document to the other, their words' sum unchanged, until one of the two
is integral. Expectations are kept, and a source misses its target by less than the one document left over.

So that this is a short one, the documents of more than ``long_share`` of their source's target are settled first, the
longest first, each against all shorter ones as its pair: it is rounded at random and the difference moves to the others'
common rest. Where they can't take it up (less than no copy or more than ``cap`` of each), the other way is taken, which
keeps the target rather than the expectation. The last of a source of long documents only is rounded to the nearest.

The other documents are paired in buckets of a bounded number of one source's documents, whose one fractional rest each
goes on to the next level of a reduction tree, until one rest per source is left and drawn. No level meets more rows in
one task than ``bucket_rows`` and no text is shuffled. Draws depend on the seed and the documents only, so reruns agree.

Null text has size 0; such documents are taken 0 times. A null source is a source like others, last in order. Rows that
are repeated are drawn one by one. An empty table gives an empty result. Other columns are not read; long texts count by
their words like others. One row per source is collected by the driver.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded, materialise


@dataclass(frozen=True)
class Mixture:
    #: Weights of the sources in code point order, repeating; null comes last.
    weights: tuple[float, ...] = (5, 2, 1)
    cap: float = 3.0
    seed: int = 20240607
    bucket_rows: int = 2_000
    fan_in: int = 64
    #: Share of its source's target that a document may have to be rounded in the tree.
    long_share: float = 0.005


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")


def targets(sizes: dict[str | None, int], how: Mixture) -> dict[str | None, float]:
    """Words that the mix should take of each source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: how.weights[i % len(how.weights)] for i, s in enumerate(order)}
    total, out, free = float(sum(sizes.values())), {}, list(order)
    while free:
        all_weight, left = sum(weight[s] for s in free), total - sum(out.values())
        over = [s for s in free if left * weight[s] / all_weight > how.cap * sizes[s]]
        if not over:
            return {s: out[s] if s in out else left * weight[s] / all_weight for s in order}
        out |= {s: how.cap * sizes[s] for s in over}
        free = [s for s in free if s not in out]
    return out


def pivotal(p: list[float], words: list[int], draw: random.Random) -> tuple[list[int | None], int | None, float]:
    """Rounded copies (0 or 1), the place of the one that stays fractional (if any), and its rest."""
    out: list[int | None] = [0] * len(p)
    held, rest = None, 0.0
    for i, (q, size) in enumerate(zip(p, words, strict=True)):
        if q <= 0 or size <= 0:
            continue
        if q >= 1:
            out[i] = 1
            continue
        if held is None:
            held, rest = i, q
            continue
        a, b = words[held], size
        # words that can move from i to the held one, and back
        up, down = min((1 - rest) * a, q * b), min(rest * a, (1 - q) * b)
        if draw.random() * (up + down) < down:
            full, empty = (1 - rest) * a <= up, q * b <= up
            rest, q = (1.0 if full else rest + up / a), (0.0 if empty else q - up / b)
        else:
            full, empty = (1 - q) * b <= down, rest * a <= down
            rest, q = (0.0 if empty else rest - down / a), (1.0 if full else q + down / b)
        if 0 < rest < 1:
            out[i] = round(q)
        else:
            out[held] = round(rest)
            held, rest = (i, q) if 0 < q < 1 else (None, 0.0)
            if held is None:
                out[i] = round(q)
    return out, held, rest


def settle(sizes: list[int], left: float, pool: int, cap: float, draw: random.Random) -> tuple[list[int], float]:
    """Copies of long documents, the longest first, and the words that the ``pool`` of the shorter ones should give."""
    out = []
    rest = sum(sizes) + pool
    for size in sizes:
        rate = min(max(left / rest, 0.0), cap)
        rest -= size
        low = math.floor(rate)

        def misses(c: int, size: int = size, rest: int = rest) -> float:
            """Words that the shorter documents can't take up."""
            return max(c * size - left, left - c * size - cap * rest, 0.0)

        ways = [low, low + 1] if low + 1 <= cap else [low]
        chosen = ways[-1] if rest and draw.random() < rate - low else ways[0]
        best = min(ways, key=lambda c: (misses(c), abs(left - c * size) if not rest else 0))
        if not rest or misses(chosen) > misses(best):
            chosen = best
        out.append(chosen)
        left -= chosen * size
    return out, left


def _settler(how: Mixture) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Settles one source's long documents; ``left`` is what remains for the others."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "id", "i"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        draw = random.Random(f"{how.seed}|long|{pdf['source'].iloc[0]}")
        pool = int(pdf["source_size"].iloc[0]) - int(pdf["size"].sum())
        copies, left = settle([int(x) for x in pdf["size"]], float(pdf["target"].iloc[0]), pool, how.cap, draw)
        return pdf.assign(copies=copies, left=left, pool=pool)

    return run


def _rounder(seed: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rounds one source's documents of one bucket; a rest that goes on to the next level has ``add`` -1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "id", "i"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        draw = random.Random(f"{seed}|{level}|{pdf['source'].iloc[0]}|{int(pdf['bucket'].iloc[0])}")
        add, held, rest = pivotal(pdf["p"].tolist(), pdf["size"].tolist(), draw)
        fraction = [0.0] * len(pdf)
        if held is not None and int(pdf["buckets"].iloc[0]) == 1:
            add[held] = int(draw.random() < rest)
        elif held is not None:
            add[held], fraction[held] = -1, rest
        return pdf.assign(p=fraction, add=add)

    return run


def allocate(docs: DataFrame, how: Mixture | None = None, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """id, source, size, source_size, target, copies, taken of every row of ``docs``."""
    return _allocated(docs, how or Mixture(), id_column, text_column, source_column).drop("i")


def _allocated(docs: DataFrame, how: Mixture, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """The columns of ``allocate``, and i, which tells repeated rows of one id, source and size apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"))
    rows = materialise(rows.groupBy("id", "source", "size").agg(F.count("*").alias("m")), "sizes")
    # one row per source
    by_source = {r["source"]: (r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.sum("m").alias("n")).collect()}
    want = targets({s: size for s, (size, _) in by_source.items()}, how)
    kind = rows.schema["source"].dataType.simpleString()
    shares = [(s, size, float(want[s]), max(1, math.ceil(n / how.bucket_rows))) for s, (size, n) in by_source.items()]
    plan = bounded(spark.createDataFrame(shares, f"own_source {kind}, source_size long, target double, buckets int"))
    units = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).drop("m")
    units = units.join(plan, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source").withColumn("h", F.xxhash64("id", "size", "i"))
    is_long = F.col("size") > how.long_share * F.col("target")

    fields = {f.name: f.dataType.simpleString() for f in units.schema}
    written = lambda names: ", ".join(f"{c} {fields[c]}" for c in names)
    columns = ["id", "source", "size", "i", "source_size", "target", "buckets", "h"]
    long_ones = materialise(units.where(is_long).select(*columns).groupBy("source").applyInPandas(_settler(how), f"{written(columns)}, copies int, left double, pool long"), "long")
    rests = bounded(long_ones.select(F.col("source").alias("own_source"), "left", "pool").distinct())
    short = units.where(~is_long).join(rests, F.col("source").eqNullSafe(F.col("own_source")), "left").drop("own_source")
    rate = F.greatest(F.least(F.coalesce("left", "target") / F.coalesce("pool", "source_size"), F.lit(float(how.cap))), F.lit(0.0))
    short = short.withColumn("rate", F.when(F.coalesce("pool", "source_size") > 0, rate).otherwise(0.0))
    short = short.withColumns({"whole": F.floor("rate").cast("int"), "p": F.col("rate") - F.floor("rate"), "bucket": F.pmod("h", F.col("buckets")).cast("int"), "add": F.lit(0)})
    fields |= {"whole": "int", "p": "double", "bucket": "int", "add": "int"}
    columns += ["whole", "p", "bucket", "add"]
    done = [long_ones.select("id", "source", "size", "i", "source_size", "target", "copies")]
    level, most = 0, max((x[3] for x in shares), default=1)
    while True:
        short = materialise(short.select(*columns).groupBy("source", "bucket").applyInPandas(_rounder(how.seed, level), written(columns)), "rounded")
        done.append(short.where("add >= 0").select("id", "source", "size", "i", "source_size", "target", (F.col("whole") + F.col("add")).cast("int").alias("copies")))
        if most == 1:
            break
        level, most = level + 1, -(-most // how.fan_in)
        short = short.where("add < 0").withColumn("buckets", F.ceil(F.col("buckets") / how.fan_in).cast("int")).withColumn("bucket", F.pmod(F.col("bucket"), F.col("buckets")).cast("int"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(0)
    return out.select(F.col("id").alias(id_column), F.col("source").alias(source_column), "i", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


#: What ``mix`` adds to a document.
MIXED = ("size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, how: Mixture | None = None, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents that the mix takes, with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``; those taken 0 times go.

    Columns of ``docs`` by one of these names, or beginning with ``_mix_``, are replaced. Rows with the same id, source and size are numbered, so that
    each gets the copies drawn for it; only such rows are shuffled with their texts.
    """
    drawn = materialise(_allocated(docs, how or Mixture(), id_column, text_column, source_column), "drawn")
    key = {f"_mix_{c}": F.col(c) for c in (id_column, source_column)} | {"_mix_size": F.col("size"), "_mix_i": F.col("i")}
    own = drawn.where("copies > 0").select(*(c.alias(k) for k, c in key.items()), *(F.col(c).alias(f"_mix_own_{c}") for c in MIXED[1:]))
    here = docs.select(*(c for c in docs.columns if c in (id_column, text_column, source_column) or c not in MIXED and not c.startswith("_mix_"))).withColumn("_mix_words", word_count(F.col(text_column)))
    same = F.col(id_column).eqNullSafe(F.col(f"_mix_{id_column}")) & F.col(source_column).eqNullSafe(F.col(f"_mix_{source_column}")) & (F.col("_mix_words") == F.col("_mix_size"))
    twice = materialise(drawn.where("i = 2").select(*(c.alias(f"_mix_twice{i}") for i, c in enumerate([F.col(id_column), F.col(source_column), F.col("size")]))).distinct(), "twice")
    if twice.isEmpty():
        joined = here.join(own, same)
    else:
        repeated = F.col(id_column).eqNullSafe(F.col("_mix_twice0")) & F.col(source_column).eqNullSafe(F.col("_mix_twice1")) & (F.col("_mix_words") == F.col("_mix_twice2"))
        numbered = here.join(twice, repeated, "left_semi").withColumn("_mix_row", F.row_number().over(Window.partitionBy(id_column, source_column, "_mix_words").orderBy(F.xxhash64(*here.columns))))
        joined = here.join(twice, repeated, "left_anti").withColumn("_mix_row", F.lit(1)).unionByName(numbered).join(own, same & (F.col("_mix_row") == F.col("_mix_i"))).drop("_mix_row")
    joined = joined.withColumn("size", F.col("_mix_words")).withColumns({c: F.col(f"_mix_own_{c}") for c in MIXED[1:]})
    return joined.drop("_mix_words", *key, *(f"_mix_own_{c}" for c in MIXED[1:]))
