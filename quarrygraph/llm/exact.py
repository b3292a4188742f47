"""Operator 3: exact duplicates by progressive refinement, in built-in functions only.

Length, then a hash of the text's beginning, then a hash of all of it; each step looks only at rows whose group of the
step before had more than one row. Which groups those are goes from step to step as a bitmap of fixed size, so neither
texts nor keys of all rows are shuffled; a bit that is on by chance only sends a row to the next step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import bits_for, cut, hot_join, table, with_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 64


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Columns that exact_groups adds.
ADDED = ("__sha", "keep_id", "group_size", "kept")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, bits: int | None = None) -> DataFrame:
    """docs with __sha (null for a text known to be unique, unless digest_all), keep_id, group_size and kept.

    Texts are equal when identical after lower-casing A-Z; null is empty. Of equal texts the largest id stays. Rows that
    repeat an id count in group_size each and share one decision; a null id stays only if its group has no other. An
    empty table gives no rows. Other columns pass through under any name but those four, which are refused. bits sets
    the size of the filters, else the number of their keys does.
    """
    own = docs.columns
    if taken := set(own) & set(ADDED):
        raise ValueError(f"columns {sorted(taken)} are those that exact_groups adds")
    x = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(own)])
    key, text = (f"__c{own.index(c)}" for c in (id_col, text_col))
    x = x.withColumn("__len", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    lengths = cut(x.groupBy("__len").count().where("count > 1").select("__len"), "exact-lengths")
    start = F.xxhash64(F.col("__len"), normalised(F.substring(F.col(text), 1, PREFIX)))
    by_length = with_filter(x, lengths, "__len", "__more", bits or bits_for(lengths.count())).withColumn("__head", F.when(F.col("__more"), start))
    heads = cut(by_length.where("__more").groupBy("__head").count().where("count > 1").select("__head"), "exact-heads")
    full = F.sha2(normalised(F.col(text)), 256)
    y = with_filter(by_length, heads, "__head", "__same", bits or bits_for(heads.count())).drop("__len", "__more", "__head")
    y = y.withColumn("__sha", full if digest_all else F.when(F.col("__same"), full))
    groups = y.where("__same").groupBy("__sha").agg(F.max(key).alias("__keep"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.where("n > 1"), "exact-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # rows without a partner need no join; of the others a hot group's rows take its one row from a broadcast
    alone = y.where("not __same").select(*y.columns, F.lit(None).cast(docs.schema[id_col].dataType).alias("__keep"), F.lit(None).cast("long").alias("__n"))
    met = hot_join(y.where("__same"), groups.select("__sha", "__keep", F.col("n").alias("__n")), "__sha", groups.select("__sha", "n"), total)
    z = alone.union(met.select(alone.columns))
    keep = F.when(F.col("__n").isNull(), F.col(key)).otherwise(F.col("__keep"))
    z = z.withColumns({"keep_id": keep, "group_size": F.coalesce(F.col("__n"), F.lit(1)).cast("long")})
    return z.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(own)], "__sha", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col(key)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """The rows of docs that stay, with docs' own columns.

    Only ids and hashes of rows that go are gathered; a row whose id cannot be among them stays without any join, so its
    text is not shuffled. A row goes if its id and its text's hash both are those of a row that goes.
    """
    own = [c for c in docs.columns]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(own)])
    key, text = (f"__c{own.index(c)}" for c in (id_col, text_col))
    gone = exact_groups(inner.select(key, text), key, text, bits=bits).where("not kept").select(F.col(key).alias("__id"), F.col("__sha").alias("__s"))
    gone = cut(gone.distinct().withColumn("__h", F.xxhash64("__id")), "exact-gone")
    x = with_filter(inner.withColumn("__h", F.xxhash64(key)), gone.select("__h"), "__h", "__may", bits or bits_for(gone.count()))
    y = gone.select("__id", "__s")
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.sha2(normalised(F.col(text)), 256) == F.col("__s"))
    stay = x.where("not __may").select(*inner.columns).union(x.where("__may").join(y, same, "left_anti").select(*inner.columns))
    return stay.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(own)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs, digest_all=True).select("doc_id", "keep_id", "group_size", "kept", F.col("__sha").alias("text_sha256"))


SQL = f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, text_sha256
FROM n JOIN g USING (text_sha256)
"""
