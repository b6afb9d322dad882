"""Connected components of an edge list, as joins and aggregations of DataFrames.

Alternating large-star and small-star steps: every step groups the edges by a node, takes the
smallest neighbour (a partial aggregation, so a hub's edges aren't gathered) and hooks the
others to it. After each round the edges are written to shared storage, so lineage stays short.
The number of rounds is logarithmic in practice, and it is bounded only by convergence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchspark.llm.common import broadcast_if_small, cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of an edge: component is the smallest node reachable.

    Edges may repeat, point either way, or loop (a loop makes its node known). Edges with a
    null end are no edges. An empty list gives an empty table. Nodes may be of any type with an
    order.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n, signature = e.count(), None
    while n:
        e = cut(_small_star(_large_star(e, n), n), "edges")
        # the sum of hashes of the distinct edges: two rounds alike mean that nothing moves any more
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        n = row["n"]
        if (n, row["s"]) == signature:
            break
        signature = (n, row["s"])
    parts = broadcast_if_small(e.select(F.col("u").alias("node"), F.col("v").alias("component")), n)
    return nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are hooked to its smallest neighbour (or itself). n: edges."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(broadcast_if_small(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are hooked to the smallest of these. e holds edges
    from larger to smaller nodes."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    hooked = e.join(broadcast_if_small(least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hooked.union(least.select("u", F.col("m").alias("v"))).distinct()
