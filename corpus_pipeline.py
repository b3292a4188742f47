"""A corpus pipeline from the operators of quarrygraph.llm: each stage works on all that the one before kept.

Rows with null, empty or repeated texts pass like others; columns beside text and doc_id go along untouched; an empty
table stays empty. Where several rows repeat a doc_id, a stage that decides by doc_id decides for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrygraph.llm import exact, jaccard, leaks, packing, toxic
from quarrygraph.llm.common import Held, cut, fresh_path, table, without


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 stay."""
    model = toxic.fitted(docs, table(spark, sf_dir, "labels"))
    return toxic.score(docs, model, out="__score").where("__score < 0.5").drop("__score")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest doc_id stays."""
    groups = jaccard.similar_groups(docs, 5, 80)
    drop = cut(groups.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-near")
    return without(docs, drop, "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = leaks.contaminated(docs, table(spark, sf_dir, "benchmark"))
    drop = cut(found.select("doc_id").distinct(), "pipeline-leaks")
    return without(docs, drop, "doc_id")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of 2048-token sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact_duplicates), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("packing", pack)]

#: A classifier and a tokenizer are no SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        with Held() as own:  # the stage's own tables
            stage(spark, docs, sf_dir).write.parquet(at)
        own.drop(spark)
        docs = spark.read.parquet(at)
    return docs
