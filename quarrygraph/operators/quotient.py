"""Graph quotients: edges grouped by the units of their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dominant_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, dominant, weight, kinds) of edges (a, b, kind): pairs of different units, the most frequent kind (ties: smallest), edges and kinds.

    Two aggregations, the second on the pair alone over at most one row a kind, so a hot pair is reduced before it is shuffled.
    """
    by_kind = edges.where("a <> b").groupBy("a", "b", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("kind", F.struct(-F.col("n"), "kind"))
    return by_kind.groupBy("a", "b").agg(best.alias("dominant"), F.sum("n").alias("weight"), F.count(F.lit(1)).alias("kinds"))
