"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import discard, materialise


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node of it) for every node of an edge (a, b).

    a and b have one orderable type. Edges with a null, loops and repeated edges do not matter; without edges
    the result is empty. A round links each node's larger neighbours to its smallest one, then its smaller
    ones; the number of rounds grows with the logarithm of a component's size. Each node's smallest neighbour
    is written before it is joined, so that a hub's edges can be split over tasks.
    """
    pairs = materialise(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    before = _sum(pairs)
    if not before[0]:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.where("b > a").join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), name)
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, pairs = pairs, materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        discard(old, nearest, large, least)
        after = _sum(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _sum(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
