"""Connected components of an edge table, by alternating large and small stars.

Every node is led to the smallest node that it reaches.  A round joins the edges
with the smallest neighbour of each node; sums and minima combine map-side and
the joins are plain equi-joins that adaptive execution splits where a node is
hot.  No neighbour list is ever gathered.  Each round is written to the shared
folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import forget, written


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """The new edges, and a written table that they read.  Large: each node's greater neighbours move to its smallest neighbour (or itself); small: the node and its smaller ones do."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # written, so that the join reads two plain exchanges and a hot node can be split
    least = written(least, "least")
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct(), least


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: u, v (long).  Returns node, component for every node of an edge to another node; component is the smallest node reachable."""
    spark = edges.sparkSession
    now = written(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())  # no number of edges overflows

    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        grown, first = _star(now, True)
        shrunk, second = _star(grown, False)
        after = written(shrunk, "edges")
        for table in (now, first, second):
            forget(table)
        now, at = after, state(after)
        if at == before:
            break
        before = at
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return out if before[0] else spark.createDataFrame([], "node long, component long")
