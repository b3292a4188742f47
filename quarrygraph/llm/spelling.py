"""Operator 13: spelling variants by an even-partition pigeonhole join.

A word is cut into two even segments, by its length alone. One edit leaves one of them whole, so each word is indexed by
both of its segments under its length, and probes the words one letter shorter with the substrings that their segments
would be in it: the front one at its own place, the back one a letter further. Words of equal length meet in the index
itself. A segment that very many words have is no place to compare them: there the rest of the word, which holds the
edit, is cut into two even segments again, and so on. Candidates are verified by one edit and met once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import LOWERED, bounded_batches, byte_values, chunks, cut, hot_join, prefix_hash, runs, span_hash, strings, table

#: Letters that a word has at least, occurrences, how much more frequent its form must be, of how many runs one loses a letter.
LEAST, OFTEN, TIMES, CUT = 7, 2, 10, 31
#: Entries of a segment that are compared with one another; where there are more, the rest of the word is cut again.
CROWD = 40
#: Bytes of a run from which its checksum is taken by itself.
_LONG = 64
_INSIDE = np.zeros(256, bool)
_INSIDE[65:91] = _INSIDE[97:123] = True


def _crc_table() -> np.ndarray:
    """The table of the CRC-32 of zlib (polynomial 0xEDB88320) for one byte."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), np.uint32(0xEDB88320) ^ (x >> np.uint32(1)), x >> np.uint32(1))
    return x


_CRC = _crc_table()


def checksums(data: np.ndarray, s: np.ndarray, e: np.ndarray, start: np.ndarray) -> np.ndarray:
    """CRC-32 of each span [s, e) of data, continued from start."""
    size = e - s
    order = np.argsort(-size, kind="stable")
    by, state = size[order], ~start[order].astype(np.uint32)
    first = s[order]
    tall = int(np.searchsorted(-by, -_LONG, "left"))  # spans longer than _LONG come first
    for i in range(tall):
        state[i] = ~np.uint32(zlib.crc32(data[first[i] : first[i] + by[i]].tobytes(), int(start[order[i]])))
    for k in range(int(by[tall]) if tall < len(by) else 0):
        m = int(np.searchsorted(-by, -k, "left"))  # spans of more than k bytes
        x = state[tall:m]
        state[tall:m] = _CRC[(x ^ data[first[tall:m] + k]) & np.uint32(255)] ^ (x >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = ~state
    return out


def _words(batches):
    """The words of each chunk and how often they occur there."""
    for batch, data, offs in chunks(batches):
        low = LOWERED[data]
        lead = low == 0xC3  # of U+00C0 to U+00FF
        tail = np.append(False, lead[:-1])[: len(low)]
        s, e = runs(_INSIDE[low] | lead | tail, offs)
        tails = np.concatenate([[0], np.cumsum(tail)])
        letters = e - s - (tails[e] - tails[s])
        on = letters >= LEAST
        s, e, letters = s[on], e[on], letters[on]
        if not len(s):
            continue
        doc = np.searchsorted(offs, s, "right") - 1
        ids = batch.column(0).to_pylist()
        start = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        crc = checksums(low, s, e, start[doc])
        hit = crc % np.uint32(CUT) == 0
        changed: dict[str, int] = {}
        for i in np.flatnonzero(hit & (letters > LEAST)).tolist():
            run, k = low[s[i] : e[i]].tobytes().decode(), int(crc[i]) % int(letters[i])
            run = run[:k] + run[k + 1 :]
            changed[run] = changed.get(run, 0) + 1
        s, e = s[~hit], e[~hit]
        _, first, n = np.unique(span_hash(prefix_hash(byte_values(low)), s, e), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([strings(low, s[first], e[first]), pa.array(n)], names=["word", "n"])
        if changed:
            yield pa.RecordBatch.from_arrays([pa.array(list(changed), pa.string()), pa.array(list(changed.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the lower-cased runs of letters of docs (doc_id, text), of some one letter cut out, with their occurrences."""
    bounded_batches(docs.sparkSession)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return x.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def _segments(entries: DataFrame) -> DataFrame:
    """Each entry under both segments of its rest [a, a + size) in letters; a probe's rest is one letter longer.

    What a segment leaves is the rest from then on. The key holds all segments so far; equal keys of unlike segments
    (64-bit hashes) only add candidates.
    """
    half, back = F.expr("size div 2"), F.expr("size - size div 2")
    front = F.struct(F.xxhash64("key", F.lit(0), F.substring(F.col("word"), F.col("a") + 1, half)).alias("key"), (F.col("a") + half).alias("a"), back.alias("size"))
    behind = F.struct(F.xxhash64("key", F.lit(1), F.substring(F.col("word"), F.col("a") + half + F.col("probe") + 1, back)).alias("key"), F.col("a"), half.alias("size"))
    x = entries.select("word", "n", "probe", F.explode(F.array(front, behind)).alias("x"))
    return x.select("x.key", "x.a", "x.size", "word", "n", "probe")


def near_pairs(words: DataFrame) -> DataFrame:
    """(x, nx, y, ny): each pair of words (word, n) that differ by one letter more, less or other, once."""
    length = F.char_length("word")
    own = words.select(F.xxhash64(length).alias("key"), F.lit(0).alias("a"), length.alias("size"), "word", "n", F.lit(0).alias("probe"))
    probe = words.select(F.xxhash64(length - 1).alias("key"), F.lit(0).alias("a"), (length - 1).alias("size"), "word", "n", F.lit(1).alias("probe"))
    rest, pairs = own.union(probe).where("size > 0"), None
    while rest is not None:
        entries = cut(_segments(rest), "spelling-entries")
        counts = entries.groupBy("key").agg(F.sum(1 - F.col("probe")).alias("own"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
        crowd = (F.col("n") > CROWD) & (F.col("size") > 1)  # a rest of one letter is no longer than the alphabet
        counts = cut(counts.where("own > 0 and n > 1").select("key", "n", crowd.alias("crowd")), "spelling-segments")
        total = entries.count()
        met = hot_join(entries, counts.select("key", "crowd"), "key", counts, total).where("crowd is not null")
        met = cut(met, "spelling-met")
        left = met.where("not crowd and probe = 0").select("key", F.col("word").alias("x"), F.col("n").alias("nx"))
        right = met.where("not crowd").select("key", F.col("word").alias("y"), F.col("n").alias("ny"), "probe")
        found = left.join(right, "key").where("(probe = 1 or x < y) and levenshtein(x, y, 1) = 1").select("x", "nx", "y", "ny")
        pairs = found if pairs is None else pairs.union(found)
        rest = met.where("crowd").select("key", "a", "size", "word", "n", "probe")
        if not counts.where("crowd").limit(1).count():
            rest = None
    return cut(pairs.distinct(), "spelling-pairs")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): forms followed to the last. Each is ten times as frequent as the word, so there are few steps."""
    forms = cut(forms, "spelling-forms")
    done, going = None, forms.select("word", F.col("form").alias("root"))
    while True:
        nxt = going.join(forms.select(F.col("word").alias("root"), "form"), "root", "left").select("word", "root", "form")
        nxt = cut(nxt, "spelling-steps")
        ended = nxt.where("form is null").select("word", "root")
        done = ended if done is None else done.union(ended)
        going = nxt.where("form is not null").select("word", F.col("form").alias("root"))
        if not going.limit(1).count():
            return done


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text).

    Words are as word_counts makes them, of at least LEAST letters and OFTEN occurrences. Two are near if one edit parts
    them. form is the most frequent near word (of several the first in code-point order), if it occurs TIMES as often;
    root the last of the forms that follow, or the word. Null and empty texts have no words; a null doc_id counts as ''
    in the checksum; repeated rows count each. An empty table gives no rows; other columns are not read.
    """
    words = cut(word_counts(docs), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("x").alias("word"), "nx", F.col("y").alias("near"), F.col("ny").alias("m")).union(pairs.select("y", "ny", "x", "nx"))
    best = F.min_by(F.struct("near", "m"), F.struct(-F.col("m"), F.col("near"))).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("nx").alias("own"), best)
    near = cut(near.select("word", "n_near", F.when(F.col("best.m") >= TIMES * F.col("own"), F.col("best")).alias("best")), "spelling-near")
    roots = _roots(near.where("best is not null").select("word", F.col("best.near").alias("form")))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.m").alias("form_n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def _nibbles() -> list[int]:
    """The CRC-32 table for four bits."""
    return [int(x) for x in _CRC[np.arange(16) * 16]]


SQL = rf"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
u AS (SELECT run, hex(id || ':' || run) AS x, count(*) AS k FROM r WHERE length(run) >= {LEAST} GROUP BY ALL),
b AS (SELECT run, k, list_transform(range(0, len(x)), lambda j: strpos('0123456789ABCDEF', substr(x, j + 2 - 2 * (j % 2), 1)) - 1) AS x FROM u),
h AS (SELECT run, k, xor(list_reduce(x, lambda a, v: xor(list_extract({_nibbles()}, (xor(a, v) & 15) + 1), a >> 4), 4294967295), 4294967295) AS h FROM b),
c AS (SELECT CASE WHEN h % {CUT} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, length(word) AS l, sum(k)::BIGINT AS n FROM c WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {OFTEN}),
i AS (SELECT word, l, unnest(range(1, l + 1)) AS i FROM w),
d AS (SELECT word, l, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM i),
p AS (SELECT a.word AS x, b.word AS y FROM d a JOIN d b ON a.l = b.l AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, d.word FROM w JOIN d ON w.word = d.rest UNION SELECT d.word, w.word FROM w JOIN d ON w.word = d.rest),
m AS (SELECT x, y, a.n AS nx, b.n AS ny, row_number() OVER (PARTITION BY x ORDER BY b.n DESC, y) AS k FROM p JOIN w a ON a.word = x JOIN w b ON b.word = y),
f AS (SELECT x AS word, y AS form, ny AS form_n FROM m WHERE k = 1 AND ny >= {TIMES} * nx),
s AS (SELECT word, form AS root, 1 AS step FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON f.word = s.root),
t AS (SELECT word, arg_max(root, step) AS root FROM s GROUP BY word),
q AS (SELECT x AS word, count(*) AS n_near FROM m GROUP BY x)
SELECT w.word, f.form, coalesce(t.root, w.word) AS root, w.n, coalesce(q.n_near, 0)::BIGINT AS n_near, f.form_n
FROM w LEFT JOIN f USING (word) LEFT JOIN t USING (word) LEFT JOIN q USING (word)
"""
