"""Connected components of an edge list, by alternating large and small stars.

Every round is two aggregations and two joins on the edges; the number of
rounds grows with the logarithm of the longest chain.  A node of very many
edges is one partial aggregate per task, and its edges are split by skewed-join
handling.  Each round is written to the shared folder, which cuts the lineage.
Edges are counted after each round; no more of them than ``FEW`` stay in one
partition, which saves the shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stash


#: edges that need no more than one partition
FEW = 1 << 17


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hooks the neighbours of each node (the larger ones, or the smaller and itself) to its least neighbour."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hooked = both.join(least, "a")
    if large:
        hooked = hooked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hooked = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return hooked.filter("a != b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root for every node of ``edges`` (columns a and b): root is the least node of its component.

    Self-loops and repeated edges are harmless; an empty list gives no rows.
    """
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = stash(edges.filter("a != b").distinct(), label)
    seen = mark(edges)
    while seen[0]:
        near = edges.coalesce(1) if seen[0] <= FEW else edges
        before, edges = edges, stash(_star(_star(near, True), False), label)
        discard(before)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    near = edges.coalesce(1) if seen[0] <= FEW else edges
    roots = near.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = stash(near.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), label)
    discard(edges)
    return out
