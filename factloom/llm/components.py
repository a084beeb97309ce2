"""Connected components of a distributed edge list, by alternating large-star and small-star rounds.

Edges never leave the executors. A round is two aggregations by node with map-side minimum and two joins on the node, whose
large keys adaptive execution may split; each round is written to the shared checkpoint folder, in as many files as its
rows ask for, so lineage stays short and a lost executor costs a round at most. The number of rounds grows with the
logarithm of the longest chain.

Defined results: self-loops, repeated edges and edges with a null are ignored; no edges give no rows; of a component, the
least node is the root of all, itself included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import kept, release

#: Edges in a file.
EDGES = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (smallest node reachable) for every node of an edge; self-loops and repeated edges are harmless, nulls are ignored."""
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    files = max(1, -(-edges.count() // EDGES))
    links = kept(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(high.alias("u"), low.alias("v")).where("u <> v").distinct().coalesce(files))
    state = None
    while True:
        # large-star: every neighbour above u moves to the least of u and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: every neighbour below u, and u itself, moves to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        links = kept(joined.select("e.u", "e.v").where("u <> v").distinct().coalesce(files))
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        # stars: every node has one link, to a root that has none
        if (now.n, now.h) == state or now.n == 0:
            break
        state = (now.n, now.h)
        release(edges.sparkSession)
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
