"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import free, materialise


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """Join each vertex's neighbours to the least vertex among them and itself: the larger ones, or the smaller ones."""
    both = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
    both = both.union(edges.select("v", F.col("u").alias("w"))) if large else edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("w"))
    least = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
    joined = both.join(least, "v")
    if large:
        out = joined.where(F.col("w") > F.col("v")).select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("w").alias("u"), F.col("m").alias("v")).union(least.select(F.col("v").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (u long, v long); a component is named by its least vertex.

    Every round is written to the shared folder, so a lost executor costs one round. A vertex with many neighbours is
    met by a map-side combined minimum and by a join that adaptive execution can split. Null ends are ignored.
    """
    current = materialise(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        last, current = current, materialise(_star(_star(current, large=True), large=False), "edges")
        free(last)
        # xor and count tell whether anything moved
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = current.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
