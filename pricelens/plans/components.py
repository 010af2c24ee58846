"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.session import discard, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list.

    ``root`` is the smallest node of the component, so it does not depend on row
    order or partitioning.  The large star hangs every node's larger neighbours on
    its smallest neighbour, the small star its smaller ones; the edges shrink to one
    star a component.  Minima are pre-aggregated and joined back, so a node with very
    many edges is not gathered in one task.  A round writes its edges once to the
    shared folder and drops those of the round before: lineage stays short and a
    lost executor costs one round.
    """
    spark = edges.sparkSession
    state, path = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
        after, next_path = staged(small.where("u <> v").distinct())
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        state, path = after, next_path
        if now == before:
            hung = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return hung.unionAll(hung.select("root", "root").distinct())
        before = now
