"""Table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a folder by name: Tables(spark, dir).lineitem."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over as many tasks as shuffles have. A small packed file is one task, however much is made of each of its rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism), *keys)
