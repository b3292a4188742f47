"""Keyed merges and tallies with total orders, so results don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_upsert(rows: DataFrame, keys: list[str], order: list[str], first: list[str], override: list[str], union: list[str]) -> DataFrame:
    """One row a key: first writer's scalars, last non-null writer's overrides, sorted distinct values of unions."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(
        *[F.min_by(c, at).alias(c) for c in first],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in override],
        *[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in union],
        F.count(F.lit(1)).alias("writes"),
    )


def strongest(rows: DataFrame, key: str, status: str, ranks: dict[str, int], none: str = "unknown") -> DataFrame:
    """(key, strongest, weakest): statuses of least and greatest rank; none where no status is known."""
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(status)]
    x = rows.withColumn("__r", rank)
    pick = lambda f: F.coalesce(f(F.when(F.col("__r").isNotNull(), F.col(status)), F.col("__r")), F.lit(none))
    return x.groupBy(key).agg(pick(F.min_by).alias("strongest"), pick(F.max_by).alias("weakest"))


def degrees(edges: DataFrame) -> DataFrame:
    """(v, degree): ends of edges (src, dst); a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def single_owner(rows: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Keys whose rows have exactly one distinct owner; min and max tell, so no set is gathered."""
    return rows.groupBy(*keys).agg(F.min(owner).alias(owner), F.max(owner).alias("__o")).where(f"{owner} = __o").drop("__o")


def tally(rows: DataFrame, by: Column, name: str) -> DataFrame:
    return rows.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def groups_of_at_least(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of keys with at least n rows: the keys' counts are joined back, so that no key's rows need one task."""
    return rows.join(rows.groupBy(key).count().where(F.col("count") >= n).select(key), key, "left_semi")


def slots(rows: DataFrame, part: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
