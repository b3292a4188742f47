"""Snapshots of a table: what changed, what a change touches, how a plan meets a stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, change): added, modified or deleted; only keys and hashes are shuffled."""
    a = old.select(key, F.sha2(content, 256).alias("__a"))
    b = new.select(key, F.sha2(content, 256).alias("__b"))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "deleted").when(F.col("__a") != F.col("__b"), "modified")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change is not null")


def reconcile(plan: DataFrame, state: DataFrame) -> DataFrame:
    """(id, status) of plan (id, hash) against state (id, hash, status).

    New ids are pending; an equal hash keeps its status, but an obsolete one is placed again; a changed one is stale if it was
    placed or verified, deferred if generated, else pending; ids gone from the plan are obsolete.
    """
    p, s = plan.select("id", F.col("hash").alias("ph")), state.select("id", F.col("hash").alias("sh"), "status")
    same = F.when(F.col("status") == "obsolete", "placed").otherwise(F.col("status"))
    changed = F.when(F.col("status").isin("placed", "verified", "obsolete"), "stale").when(F.col("status") == "generated", "deferred").otherwise("pending")
    out = F.when(F.col("sh").isNull(), "pending").when(F.col("ph").isNull(), "obsolete").when(F.col("ph") == F.col("sh"), same).otherwise(changed)
    return p.join(s, "id", "full_outer").select("id", out.alias("status"))
