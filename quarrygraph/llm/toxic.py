"""Operator 5: a toxicity classifier regularised by counterfactuals.

A logistic model over the presence of words. Words are chosen by how far they tell the labels apart; identity terms are
always among them. Each training text with an identity term has a twin in which the terms are swapped for others of the
family, and the squared change of the score is part of the loss: a neutral mention of a group moves no score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarrygraph.llm.common import bounded_batches, chunks, cut, table

_WORD = re.compile(r"[^\W\d_]+")
#: Families of identity terms; a term is swapped for the next of its family.
FAMILIES = [
    "women men girls boys".split(), "woman man girl boy".split(), "christian muslim jewish hindu buddhist atheist".split(), "christians muslims jews hindus buddhists atheists".split(),
    "black white asian latino african european".split(), "gay straight lesbian bisexual transgender".split(), "immigrants natives refugees citizens".split(), "disabled deaf blind elderly young".split(),
    "frauen männer mädchen jungen".split(), "christen muslime juden".split(), "femmes hommes filles garçons".split(), "chrétiens musulmans juifs".split(), "mujeres hombres niñas niños".split(), "cristianos musulmanes judíos".split(),
]
SWAP = {a: f[(i + 1) % len(f)] for f in FAMILIES for i, a in enumerate(f)}
#: Rows that the classifier is fitted on at most (about; half of them toxic if there are so many), words that it has at most, and the chi-square that a word needs.
MAX_TRAIN, MAX_WORDS, MIN_CHI2 = 20_000, 2048, 15.0


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _word_rows(batches):
    for batch, data, offs in chunks(batches):
        raw = data.tobytes()
        w = [sorted(words(raw[a:b].decode("utf-8", "replace"))) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(w, pa.list_(pa.string()))], names=["y", "weight", "words"])


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(y, weight, words) of labelled texts: a sample by a hash of doc_id, of bounded size by class, weighted back to all."""
    bounded_batches(docs.sparkSession)
    y = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("y"))
    n = {r.y: r["count"] for r in y.groupBy("y").count().collect()}
    share = {c: min(1.0, max_train / 2 / k) for c, k in n.items()}
    roll = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    of = lambda c: F.lit(share.get(c, 1.0))
    picked = y.where(roll < F.when(F.col("y") == 1, of(1.0)).otherwise(of(0.0))).withColumn("weight", F.when(F.col("y") == 1, 1 / of(1.0)).otherwise(1 / of(0.0))).orderBy(roll, "doc_id").limit(2 * max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * max_train rows are broadcast
    return cut(rows.select("text", "y", "weight").mapInArrow(_word_rows, "y double, weight double, words array<string>"), "toxic-rows")


def fit(rows: DataFrame, penalty: float = 5.0, ridge: float = 1.0) -> dict[str, float]:
    """Word weights, the bias under "". What reaches the driver is bounded: MAX_WORDS words, and the sampled rows' selected words."""
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.col("weight") * F.col("y")), F.lit(0.0)).alias("p")).first()
    n, p = total.n, total.p
    if not n or not p or p == n:
        return {"": -3.0 if not n or not p else 3.0}
    w = rows.select("y", "weight", F.explode("words").alias("word")).groupBy("word").agg(F.sum("weight").alias("a"), F.sum(F.col("weight") * F.col("y")).alias("b"), F.count(F.lit(1)).alias("rows"))
    a, b, N, P = F.col("a"), F.col("b"), F.lit(n), F.lit(p)
    chi2 = (b * N - a * P) ** 2 * N / (a * (N - a) * P * (N - P) + 1e-9)
    top = w.where("rows >= 3").withColumn("chi2", chi2).where((F.col("chi2") >= MIN_CHI2) & (a < N)).orderBy(F.desc("chi2"), "word").limit(MAX_WORDS).select("word").collect()
    vocab = {x: i for i, x in enumerate(dict.fromkeys([r.word for r in top] + sorted(SWAP)))}

    def select(batches):
        for batch in batches:
            ids, twins = [], []
            for ws in batch.column(2).to_pylist():
                ids.append([vocab[x] for x in ws if x in vocab])
                twins.append([vocab[y] for x in ws if (y := SWAP.get(x, x)) in vocab] if any(x in SWAP for x in ws) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(twins, pa.list_(pa.int32()))], names=["y", "weight", "ids", "twin"])

    got = rows.mapInArrow(select, "y double, weight double, ids array<int>, twin array<int>").groupBy("y", "ids", "twin").agg(F.sum("weight").alias("weight")).toPandas().sort_values(["y", "weight"], kind="stable")
    y, c = got.y.to_numpy(float), got.weight.to_numpy(float)
    row = lambda col: (np.repeat(np.arange(len(got)), got[col].map(len)), np.concatenate([np.asarray(x, np.int64) for x in got[col]] or [np.zeros(0, np.int64)]).astype(np.int64))
    (r, i), (r2, i2) = row("ids"), row("twin")
    has = np.bincount(r2, minlength=len(got)) > 0
    k, m = len(vocab), len(got)
    wt, bias = np.zeros(k), float(np.log(p / (n - p)))
    grad2, gb2 = np.full(k, 1e-8), 1e-8
    for step in range(400):
        z = np.bincount(r, weights=wt[i], minlength=m)
        s = 1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))
        e = c * (s - y)
        d = np.where(has, z - np.bincount(r2, weights=wt[i2], minlength=m), 0.0) * c * penalty
        g = np.bincount(i, weights=(e + d)[r], minlength=k) - np.bincount(i2, weights=d[r2], minlength=k) + ridge * wt
        gb = e.sum()
        grad2, gb2 = grad2 + g * g, gb2 + gb * gb
        rate = 0.5
        wt, bias = wt - rate * g / np.sqrt(grad2), bias - rate * gb / gb2**0.5
    return {x: float(wt[j]) for x, j in vocab.items()} | {"": float(bias)}


def score(docs: DataFrame, model: dict[str, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 behind its own columns, none of which may have its name; null and empty texts have the bias's; any doc_id, repeated rows and an empty table pass."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out} already: name another with out")
    weights, bias = {k: v for k, v in model.items() if k}, model[""]
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        import math

        known = weights.keys()
        for batch in batches:
            found = []
            for _, data, offs in chunks([pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])]):
                raw = data.tobytes()
                for a, b in zip(offs[:-1], offs[1:], strict=True):
                    z = bias + sum(weights[x] for x in sorted(known & words(raw[a:b].decode("utf-8", "replace"))))
                    found.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def fitted(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict[str, float]:
    """A model of the labels outside the held-out fold (crc32 of doc_id as text, mod 5, is 0)."""
    learn = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return fit(training_rows(docs, learn, max_train))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
