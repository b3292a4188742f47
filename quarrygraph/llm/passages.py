"""Operator 12: removal of passages that an earlier document has too, by seeds and their extension.

A seed is a run of 16 words, the smallest by hash of all that lie in a window of 50 words (winnowing), so equal windows
have equal seeds at equal places, and a run of windows with one seed is a block. Documents meet by seeds: those of one
document alone end there, equal blocks are one with the smallest document, and a seed's different blocks go to one task.
There each is extended left and right from its seed, word by word, as far as another document agrees; windows that lie
within both extensions are looked up, and runs of those that a smaller document has are the maximal repeats. A seed with
very many different blocks isn't taken to one task: its blocks' windows are counted by hash over all tasks instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import bits_for, bounded_batches, byte_values, chunks, cut, hot_join, in_filter, key_filter_array, mix, prefix_hash, runs, span_hash, table, with_filter
from quarrygraph.llm.repeats import blocks

#: Words of a window, words of a seed.
WIDTH, SEED = 50, 16
#: Bytes of a text whose words are hashed together, words that are looked at together.
_PIECE, _WORDS = 4 << 20, 1 << 20
#: Different blocks from which a seed's windows are counted over all tasks, bytes of blocks that are extended together.
CROWD, SHARD = 2_000, 8 << 20
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
#: What a null doc_id counts as: smaller than all others.
FIRST = -(1 << 63)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and each text's first word. A text beyond 4 MB is hashed in parts that end between words."""
    if len(offs) == 2 and len(data) > _PIECE:
        ends, at = [], 0
        while at < len(data):
            gap = np.flatnonzero(~_WORD[data[at + _PIECE : at + 2 * _PIECE]])
            stop = at + _PIECE + int(gap[0]) if len(gap) else None
            if stop is None:  # a word of 4 MB: to the next gap, wherever it is
                gap = np.flatnonzero(~_WORD[data[at + _PIECE :]])
                stop = at + _PIECE + int(gap[0]) if len(gap) else len(data)
            ends.append((at, stop))
            at = stop
        w = np.concatenate([word_hashes(data[a:b], np.array([0, b - a]))[0] if b - a <= _PIECE else _hashed(data[a:b], np.array([0, b - a]))[0] for a, b in ends])
        return w, np.array([0, len(w)])
    return _hashed(data, offs)


def _hashed(data, offs):
    s, e = runs(_WORD[data], offs)
    return span_hash(prefix_hash(byte_values(data)), s, e), np.searchsorted(s, offs)


def _pieces(batches, width: int):
    """Chunks of texts as word hashes; a text of very many words comes in pieces that overlap by width - 1 words: (doc, text hash, word hashes, bounds, where each piece starts)."""
    for batch, data, offs in chunks(batches):
        w, at = word_hashes(data, offs)
        ids, rids = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        if len(w) <= _WORDS or len(at) > 2:
            yield ids, rids, w, at, np.zeros(len(at) - 1, np.int64)
        else:
            for a in range(0, max(1, len(w) - width + 1), _WORDS):
                part = w[a : a + _WORDS + width - 1]
                yield ids, rids, part, np.array([0, len(part)]), np.array([a])


def _runs_of_windows(w, at, width):
    h = prefix_hash(w)
    return h, blocks(w, at, width, SEED, h)


def _seeds(width):
    """Each chunk's seeds with the documents that have them."""

    def run(batches):
        for ids, _, w, at, _ in _pieces(batches, width):
            doc, _, _, _, seed, _, _ = _runs_of_windows(w, at, width)[1]
            own = ids[doc]
            _, i = np.unique(mix(seed ^ mix(own.view(np.uint64))), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(seed[i].view(np.int64)), pa.array(own[i])], names=["h", "doc"])

    return run


def _places(doc, rid, start):
    return mix(mix(mix(doc.view(np.uint64)) ^ rid.view(np.uint64)) + start.astype(np.uint64))


def _blocks(width, wanted, bits):
    """Blocks whose seed more than one document has: where they are, their windows."""

    def run(batches):
        for ids, rids, w, at, base in _pieces(batches, width):
            doc, start, count, _, seed, block, _ = _runs_of_windows(w, at, width)[1]
            on = in_filter(wanted.value, seed, bits)
            doc, start, count, seed, block = (v[on] for v in (doc, start, count, seed, block))
            start, d, r = start + base[doc], ids[doc], rids[doc]
            cols = [seed.view(np.int64), block.view(np.int64), d, r, start, count, _places(d, r, start).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "block", "doc", "rid", "s", "n", "w"])

    return run


def _words(width, wanted, bits, crowded, crowd_bits):
    """The word hashes of the wanted blocks, the seed's place in them, and whether their seed may be a crowded one."""

    def run(batches):
        for ids, rids, w, at, base in _pieces(batches, width):
            _, (doc, start, count, place, seed, block, lo) = _runs_of_windows(w, at, width)
            on = in_filter(wanted.value, _places(ids[doc], rids[doc], start + base[doc]), bits)
            doc, count, place, seed, block, lo = (v[on] for v in (doc, count, place, seed, block, lo))
            size = count - 1 + width
            begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            flat = w[np.arange(begin[-1]) + np.repeat(lo - begin[:-1], size)]
            held = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat.view(np.int64)))
            cols = [pa.array(c) for c in (seed.view(np.int64), block.view(np.int64), ids[doc], place)]
            yield pa.RecordBatch.from_arrays([*cols, held, pa.array(in_filter(crowded.value, seed, crowd_bits))], names=["h", "block", "doc", "place", "words", "crowd"])

    return run


def spread(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest and the largest document of the rows that have its h."""
    if not len(h):
        return doc, doc
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    first = np.flatnonzero(new)
    where = np.empty(len(h), np.int64)
    where[order] = np.cumsum(new) - 1
    return np.minimum.reduceat(doc[order], first)[where], np.maximum.reduceat(doc[order], first)[where]


def extended(words: np.ndarray, offs: np.ndarray, place: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, end): of the rows' blocks the maximal runs of windows that a row with a smaller document has at the same place of an equal seed.

    Each seed is extended to either side while a row of another document agrees; only windows within both are compared.
    """
    h, seed, size = prefix_hash(words), offs[:-1] + place, np.diff(offs)
    most = width - SEED

    def reach(room, span):
        far, alive = np.zeros(len(doc), np.int64), np.arange(len(doc))
        for k in range(1, most + 1):
            alive = alive[room[alive] >= k]
            low, high = spread(span(alive, k), doc[alive])
            alive = alive[low < high]
            far[alive] = k
        return far

    low, high = spread(span_hash(h, seed, seed + SEED), doc)
    left = reach(np.where(low < high, place, 0), lambda r, k: span_hash(h, seed[r] - k, seed[r] + SEED))
    right = reach(np.where(low < high, size - place - SEED, 0), lambda r, k: span_hash(h, seed[r], seed[r] + SEED + k))
    rows, firsts = [], []
    for k in range(most + 1):  # words in front of the seed
        r = np.flatnonzero((left >= k) & (right >= most - k) & (low < high))
        begin = seed[r] - k
        least, _ = spread(span_hash(h, begin, begin + width), doc[r])
        r = r[least < doc[r]]
        rows.append(r)
        firsts.append(place[r] - k)
    row, first = np.concatenate(rows), np.concatenate(firsts)
    order = np.lexsort((first, row))
    row, first = row[order], first[order]
    new = np.append(True, (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1))[: len(row)]
    last = np.append(new[1:], True)[: len(row)]
    return row[new], first[new], first[last] + 1


def _extended(width):
    """Blocks by seed to (block, doc, a, b), the repeats in words from the block's start. Memory holds the blocks of some seeds, of which each has at most about CROWD."""

    def found(batches):
        rows = pa.Table.from_batches(batches).combine_chunks()
        block, doc, place = (rows.column(i).combine_chunks().to_numpy().astype(np.int64) for i in (1, 2, 3))
        col = rows.column(4).combine_chunks()
        offs = col.offsets.to_numpy().astype(np.int64)
        words = col.values.to_numpy()[offs[0] : offs[-1]].view(np.uint64)
        row, a, b = extended(words, offs - offs[0], place, doc, width)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (block[row], doc[row], a, b - 1 + width)], names=["block", "doc", "a", "b"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            change = np.flatnonzero(np.append(last is not None and key[0] != last, key[1:] != key[:-1]))
            last, j = key[-1], int(change[-1]) if len(change) else 0
            if len(change) and size + batch.nbytes * j // len(key) >= SHARD:
                yield found([*held, batch.slice(0, j)])
                held, size, batch = [], 0, batch.slice(j)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield found(held)

    return run


def _windows(width):
    """Every window of a block by its hash."""

    def run(batches):
        for batch in batches:
            block, doc = (batch.column(i).to_numpy() for i in (1, 2))
            offs = batch.column(4).offsets.to_numpy().astype(np.int64)
            words = batch.column(4).values.to_numpy()[offs[0] : offs[-1]].view(np.uint64)
            count = np.diff(offs) - width + 1
            row = np.repeat(np.arange(len(count)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = (offs[:-1] - offs[0])[row] + k
            w = span_hash(prefix_hash(words), begin, begin + width)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(block[row]), pa.array(doc[row]), pa.array(k)], names=["w", "block", "doc", "a"])

    return run


def repeated_passages(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, rid, a, b): runs of words of docs (doc, rid, text) covered by windows that a document with a smaller doc has too; they may overlap."""
    spark = docs.sparkSession
    seeds = docs.mapInArrow(_seeds(width), "h long, doc long").groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h")
    seeds = cut(seeds, "passages-seeds")
    bits = bits_for(seeds.count())
    wanted = spark.sparkContext.broadcast(key_filter_array(seeds, "h", bits))  # at most MOST_BITS
    found = cut(docs.mapInArrow(_blocks(width, wanted, bits), "h long, block long, doc long, rid long, s long, n long, w long"), "passages-blocks")
    by_block = found.groupBy("block").agg(F.first("h").alias("h"), F.min(F.struct("doc", "rid", "s", "w")).alias("first"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("m"))
    by_block = cut(by_block, "passages-classes")
    total = found.count()
    # blocks that a smaller document has as they are
    later = by_block.where("first.doc < hi").select("block", F.col("first.doc").alias("lo"), "m")
    again = with_filter(found, later, "block", "maybe", bits_for(later.count())).where("maybe").select("block", "doc", "rid", "s", "n")
    again = hot_join(again, later.select("block", "lo"), "block", later.select("block", F.col("m").alias("n")), total)
    whole = again.where("lo < doc").select("doc", "rid", F.col("s").alias("a"), (F.col("s") + F.col("n") - 1 + width).alias("b"))
    # one block of each kind, where a seed has several
    kinds = by_block.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("first.doc").alias("lo"), F.max("first.doc").alias("hi")).where("lo < hi")
    kinds = cut(kinds.select("h", "k"), "passages-kinds")
    n_kinds = kinds.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    mixed = with_filter(by_block, kinds, "h", "maybe", bits_for(kinds.count())).where("maybe").select(F.col("first.w").alias("w"))
    bits, crowds = bits_for(n_kinds), kinds.where(F.col("k") > CROWD).select("h")
    wanted = spark.sparkContext.broadcast(key_filter_array(mixed, "w", bits))
    n_crowds = crowds.count()
    crowd_bits = bits_for(n_crowds)
    crowded = spark.sparkContext.broadcast(key_filter_array(crowds, "h", crowd_bits))
    parts = docs.mapInArrow(_words(width, wanted, bits, crowded, crowd_bits), "h long, block long, doc long, place long, words array<long>, crowd boolean")
    if n_crowds:
        parts = cut(parts, "passages-words")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = parts.where("not crowd").repartition(n, "h").sortWithinPartitions("h").drop("crowd")
    repeats = few.mapInArrow(_extended(width), "block long, doc long, a long, b long")
    if n_crowds:
        w = cut(parts.where("crowd").drop("crowd").mapInArrow(_windows(width), "w long, block long, doc long, a long"), "passages-windows")
        least = cut(w.groupBy("w").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi"), "passages-least")
        met = hot_join(w, least.select("w", "lo"), "w", least.select("w", "n"), w.count()).where("lo < doc")
        repeats = repeats.union(met.select("block", "doc", "a", (F.col("a") + width).alias("b")))
    # all blocks of that kind in that document
    repeats = repeats.withColumn("key", F.xxhash64("block", "doc")).groupBy("key").agg(F.collect_set(F.struct("block", "doc", "a", "b")).alias("parts"))
    repeats = cut(repeats, "passages-repeats")
    held = with_filter(found.select(F.xxhash64("block", "doc").alias("key"), "block", "doc", "rid", "s"), repeats, "key", "maybe", bits_for(repeats.count())).where("maybe").drop("maybe")
    per = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    held = hot_join(held, repeats, "key", per, total).where("parts is not null").select("block", "doc", "rid", "s", F.explode("parts").alias("p"))
    held = held.where("p.block = block and p.doc = doc").select("doc", "rid", (F.col("s") + F.col("p.a")).alias("a"), (F.col("s") + F.col("p.b")).alias("b"))
    return whole.union(held)


def _kept(row):
    """For each document: its words without those that the marks cover."""

    def run(batches):
        for batch, data, offs in chunks(batches):
            out = []
            for i, marks in enumerate(batch.column(2).to_pylist()):
                words = data[offs[i] : offs[i + 1]].tobytes().split()  # at the six bytes that end words
                n = len(words)
                if marks:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [m["a"] for m in marks], 1)
                    np.add.at(edge, [m["b"] for m in marks], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                out.append(row(n, words))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, row.types, strict=True))], names=["doc_id", *row.names])

    return run


class _Digest:
    names, types, schema = ("n_words", "n_removed", "kept_sha256"), (pa.int64(), pa.int64(), pa.string()), "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def __call__(self, n, kept):
        return n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


class _Text:
    names, types, schema = ("text", "n_removed"), (pa.string(), pa.int64()), "doc_id long, text string, n_removed long"

    def __call__(self, n, kept):
        return b" ".join(kept).decode(), n - len(kept)


def without_passages(docs: DataFrame, width: int = WIDTH, row=None) -> DataFrame:
    """(doc_id, text, n_removed), or row's columns, of each row of docs (doc_id, text) without passages of width words that a document with a smaller doc_id has.

    Kept words are joined by one space. Null and empty texts have no words; texts of under width words lose nothing.
    Rows that share a doc_id are one document for the order and keep what only they have; a null doc_id is smaller than
    all others. The same text under several ids stays under the smallest alone. An empty table gives no rows, other
    columns are not read. Words, windows and blocks are compared by 64-bit hashes.
    """
    row = row or _Text()
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(FIRST)), "rid": F.xxhash64("text")})
    long = docs.where(F.octet_length("text") >= 2 * width - 1)
    spans = repeated_passages(long.select("doc", "rid", "text"), width)
    marks = spans.distinct().groupBy("doc", "rid").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    marks = cut(marks.withColumn("of", F.xxhash64("doc", "rid")), "passages-marks")
    docs = with_filter(docs.withColumn("of", F.xxhash64("doc", "rid")), marks.select("of"), "of", "maybe", bits_for(marks.count()))
    none = F.lit(None).cast("array<struct<a: bigint, b: bigint>>")
    free = docs.where("not maybe").select("doc_id", "text", none.alias("marks"))
    touched = docs.where("maybe").join(marks.drop("of"), ["doc", "rid"], "left").select("doc_id", "text", "marks")
    return free.mapInArrow(_kept(row), row.schema).union(touched.mapInArrow(_kept(row), row.schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(table(spark, sf_dir, "documents"), WIDTH, _Digest())


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
x AS (SELECT doc_id, w[k] AS word, k, CASE WHEN k + 49 <= len(w) THEN array_to_string(w[k : k + 49], ' ') END AS win FROM i),
h AS (SELECT doc_id, word, k, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS hit FROM x),
c AS (SELECT doc_id, word, k, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h),
s AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY k) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
