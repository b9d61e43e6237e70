"""Connected components of an edge table, by label propagation with shortcuts over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import discard, written


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps: every round rewrites edges so that nodes
    hang on ever smaller neighbours; a star forest is the fixed point, reached in
    logarithmically many rounds in practice. Each round is one table written to the shared
    folder, so a lost executor costs one round, and deleted when the next one is. Nothing but a count comes to the driver.
    A hub's edges meet in aggregations with partial sums and in joins AQE can split.

    Defined results: edges with a null end, loops and repeated edges add nothing; a node without an edge is not in the
    result; an empty table gives an empty one. Further columns are not read.
    """
    e = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    e = written(e, "edges")
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u hangs on u's smallest neighbour (or u itself).
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours hang on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        nxt = written(small, "edges")
        # Done when every node has one edge and no root hangs on another node.
        stats = nxt.groupBy("u").agg(F.count("*").alias("c")).agg(F.max("c").alias("c")).first()
        deeper = nxt.join(nxt.select(F.col("u").alias("r")), F.col("v") == F.col("r"), "left_semi").limit(1).count()
        discard(e)
        e = nxt
        if (stats["c"] or 0) <= 1 and not deeper:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = written(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    discard(e)
    return out
