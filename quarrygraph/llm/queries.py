"""The training-data queries of __spark_entry__.py and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrygraph.llm import divergence, exact, jaccard, language, leaks, packing, passages, private, repeats, spelling, tokens, toxic, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.query,
    "op2_personal_data": private.query,
    "op3_exact_dedup": exact.query,
    "op4_decontamination": leaks.query,
    "op5_toxicity": toxic.query,
    "op6_language": language.query,
    "op7_jaccard_join": jaccard.query,
    "op8_warc": warc.query,
    "op9_repeats": repeats.query,
    "op10_token_files": tokens.query,
    "op11_divergence": divergence.query,
    "op12_passages": passages.query,
    "op13_spelling": spelling.query,
}

SQL = {"op3_exact_dedup": exact.SQL, "op8_warc": warc.SQL, "op11_divergence": divergence.SQL, "op12_passages": passages.SQL, "op13_spelling": spelling.SQL}
