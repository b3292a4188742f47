"""Rules over tables: each is a query of (severity, rule, entity), and a check is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(severity: str, name: str, rows: DataFrame, entity: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), entity.cast("string").alias("entity"))


def check(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
