"""Connected components of a graph held as a table of edges.

Alternating large and small stars: each round re-hangs neighbours under the
smallest node seen, in aggregations and joins by node. Only minima per node are
aggregated, so a node with very many neighbours is never gathered; Spark splits
its rows in the joins. Lineage is cut with a reliable checkpoint each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuskit.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    near = both.unionByName(turned) if large else both.where("v < u").unionByName(turned.where("v < u"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over `edges` (a, b), for every
    node on an edge between different nodes. Repeated edges, both directions and
    loops are allowed; an empty table gives an empty result."""
    spark = edges.sparkSession
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    current = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        current = cut_lineage(_star(_star(current, large=True), large=False))
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = state
