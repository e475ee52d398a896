"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import staged


def _stars(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Link each node's neighbours (the larger or the smaller ones) to its least neighbour.

    The least neighbour is a partial minimum, so a star that a third of all nodes belong to
    is combined before the shuffle; joining it back is a join that Spark may split.
    """
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = edges.join(least, "a")
    if keep_larger:
        return linked.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v")
    rest = linked.select(F.col("b").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select(F.col("a").alias("u"), F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for each node of the edges (a, b); long ids.

    Each round writes its edges to the shared folder, which keeps the lineage short and lets a
    lost executor's part be read again. Rows with a null end and loops have no effect; an empty
    table gives an empty result.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        large = _stars(both, True).distinct()
        small = _stars(large.select(F.col("u").alias("a"), F.col("v").alias("b")), False)
        e = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
