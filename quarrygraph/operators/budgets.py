"""Rolling budgets over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_counts(rows: DataFrame, at_micros: str, window_s: int, part: list[str] | None = None) -> DataFrame:
    """rows with used: the rows in (t - window, t], the row itself and others at its time included. Running sums count them, so that a row costs no more where many share its window. Rows without a time are left out.

    Time is cut into blocks as long as the window, and a block is what a task orders: what came in the block before has
    all entered there and leaves here, a window later.
    """
    width = window_s * 1_000_000
    keys = [*(part or []), "__block"]
    come = rows.where(F.col(at_micros).isNotNull()).withColumns({"__block": F.floor(F.col(at_micros) / width), "__at": F.col(at_micros)})
    both = F.explode(F.array(F.lit(1), F.lit(-1))).alias("__step")
    x = come.select("*", both).withColumns({"__at": F.when(F.col("__step") < 0, F.col("__at") + width).otherwise(F.col("__at")), "__block": F.when(F.col("__step") < 0, F.col("__block") + 1).otherwise(F.col("__block"))})
    so_far = Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(F.when(F.col("__step") < 0, 1).otherwise(0)).over(Window.partitionBy(*keys))
    return x.withColumn("used", before + F.sum("__step").over(so_far)).where("__step > 0").select(*rows.columns, "used")


def streaks(rows: DataFrame, key: str, order: list[str], failed: Column, base: int = 30, cap: int = 900) -> DataFrame:
    """rows with the number of failures in a row up to each, and the backoff min(cap, base * 2^(n - 1)) that follows; 0 after a success."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    x = rows.withColumn("__i", island)
    n = F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(key, "__i").orderBy(*order))
    x = x.withColumn("streak", n)
    return x.withColumn("backoff", F.when(F.col("streak") > 0, F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.col("streak") - 1))).otherwise(0.0)).drop("__i")
