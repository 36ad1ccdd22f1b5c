"""Connected components of a large graph: alternating large-star and small-star rounds.

Each round moves every edge to the smallest neighbour of one of its ends, first for neighbours above a
node, then for those below. After few rounds each component is a star around its smallest node. Minima
combine before the shuffle; a node with very many edges only meets its minimum in a join whose large
partitions adaptive execution splits. Each round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import stored


def _star(edges: DataFrame) -> DataFrame:
    """One large and one small star round over edges (u > v)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # every neighbour above u now points at the smallest node around u
    large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    # every neighbour below u, and u itself, points at the smallest of them
    moved = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long, not null) -> (node, root): root is the smallest node that can be reached.
    Nodes without an edge to another are not listed."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (sums.n, sums.s) == seen or not sums.n:
            break
        seen = (sums.n, sums.s)
        now = stored(_star(now), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
