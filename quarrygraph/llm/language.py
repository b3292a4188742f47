"""Operator 6: language by compression. Each language has a raw-content dictionary of its own text; a text, in blocks, is
compressed with every dictionary, and the language whose dictionary gives the fewest bytes wins. Narrow margins are rejected."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import bounded_batches, chunks, table

#: Bytes of a language's dictionary, of the excerpt that one document gives, and of a block that is compressed by itself.
DICTIONARY, EXCERPT, BLOCK = 96 << 10, 1024, 2048
UNKNOWN = "und"


def dictionaries(docs: DataFrame, size: int = DICTIONARY) -> dict[str, bytes]:
    """Excerpts of distinct texts of documents (text, lang) chosen by a hash of the text, as many as fill size bytes a language; shorter ones are repeated to the longest's size.

    The sample is bounded by a documented parameter; counts of distinct texts by language (sketches, for a share with
    room to spare) set its share, so no language's rows are sorted whole. Rows with null language, null or empty text, or a text without a letter teach nothing.
    """
    x = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    want = 2 * size // EXCERPT + 20
    h = F.xxhash64("text", F.lit(6))
    n = {r.lang: max(1, r.n) for r in x.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()}  # one row a language
    if not n:
        return {}
    share = F.create_map(*[F.lit(v) for k, c in n.items() for v in (k, min(1.0, 3.0 * want / c))])
    x = x.withColumn("h", h).where(F.pmod("h", F.lit(1 << 24)) / F.lit(float(1 << 24)) <= share[F.col("lang")])
    begin = 1 + F.pmod(F.shiftright("h", 24), F.greatest(F.lit(1), F.length("text") - EXCERPT))
    x = x.select("lang", "h", F.lower(F.substring("text", begin.cast("int"), F.lit(EXCERPT))).alias("t")).groupBy("lang", "h").agg(F.min("t").alias("t"))
    top = x.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("k") <= want).orderBy("lang", "k")
    out: dict[str, bytes] = {}
    for r in top.collect():
        out[r.lang] = (out.get(r.lang, b"") + b"\n" + r.t.encode())[:size]
    most = max(map(len, out.values()), default=0)  # the same size for all, none cut: a rare language takes nothing from others
    return {k: (v * -(-most // len(v)))[:most] for k, v in out.items()}


def predict(docs: DataFrame, known: dict[str, bytes], margin: float = 0.01, level: int = 3) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text.

    und with score 0 where a text is null or has no letter, or nothing was learned. Ties go to the language first in
    order. rejected says that the second-best dictionary needs less than margin more bytes; lang_pred is the best even so.
    """
    langs = sorted(known)

    def run(batches):
        coders = []
        for k in langs:
            d = zstd.ZstdCompressionDict(known[k], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstd.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False))
        for batch, data, offs in chunks(batches):
            raw, out = data.tobytes(), []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                text = raw[a:b].decode("utf-8", "replace").lower()
                if not langs or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                text, size = text.encode(), np.zeros(len(langs))
                for i in range(0, len(text), BLOCK):
                    part = text[i : i + BLOCK]
                    size += [len(c.compress(part)) for c in coders]
                best = int(size.argmin())
                second = float(np.delete(size, best).min()) if len(langs) > 1 else 2 * size[best]
                p = 1 / sum(math.exp(-min(50.0, (s - size[best]) / 4)) for s in size)
                out.append((langs[best], p, second < (1 + margin) * size[best]))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = predict(docs, dictionaries(docs.where(~held)))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
