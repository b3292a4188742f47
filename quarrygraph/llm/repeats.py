"""Operator 9: removal of repeated 100-byte strings, exactly, over all documents, by external induced sorting of suffixes.

Shards: of each window of 100 bytes its smallest 32-gram is the anchor, so equal windows have equal anchors at equal
places, and a run of windows with one anchor is a block of at most 168 bytes. Blocks whose anchor occurs once hold no
repeat. Equal blocks are one row before anything is sorted (the later ones go whole), and the distinct blocks of an
anchor go to one shard; an anchor with very many is split by the bytes that its windows share. Each task then sorts all
suffixes of its shards' blocks (induced.py): suffixes whose common prefix with the one before reaches 100 bytes form a
class, of which the earliest window stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import HOT_ROWS, HOT_SHARE, bits_for, bounded_batches, byte_values, chunks, cut, hot_join, in_filter, key_filter_array, mix, powers, prefix_hash, span_hash, table, with_filter
from quarrygraph.llm.induced import repeated

#: Bytes of an anchor; bytes of a text that are looked at together; bytes of blocks that are sorted together (more only where one key holds more).
ANCHOR, _PIECE, SHARD = 32, 4 << 20, 4 << 20
#: Places of the anchor in a window that go together where an anchor is split.
PLACES = 9

def blocks(data: np.ndarray, offs: np.ndarray, width: int = 100, q: int = ANCHOR, h: np.ndarray | None = None):
    """(document, first window's start in it, windows, anchor's place in the first window, anchor hash, block hash, absolute start), all arrays. h: prefix hashes of the data, where it is not bytes."""
    n = len(data)
    out = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64)]
    if n < width:
        return out
    h = prefix_hash(byte_values(data)) if h is None else h
    _, down = powers(n + 1)
    low = np.uint64((1 << 24) - 1)
    x = mix((h[q:] - h[: n - q + 1]) * down[: n - q + 1])
    x |= low
    x ^= low - np.arange(n - q + 1, dtype=np.uint64)  # ties go to the left: the place is in the low bits
    w, k = width - q + 1, 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    if w > k:
        x = np.minimum(x[: len(x) - (w - k)], x[w - k :])
    p = (x & low).astype(np.int64)  # of each window its anchor
    size = np.diff(offs)
    edge = np.zeros(len(p) + 1, np.int8)  # windows within one document
    long = size >= width
    np.add.at(edge, offs[:-1][long], 1)
    np.add.at(edge, offs[1:][long] - width + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    new = np.empty(len(p), bool)
    new[0] = True
    np.not_equal(p[1:], p[:-1], out=new[1:])
    new |= edge[:-1] != 0
    turn = np.append(np.flatnonzero(new), len(p))
    count = np.diff(turn)
    lo = turn[:-1]
    on = valid[lo]
    lo, count = lo[on], count[on]
    if not len(lo):
        return out
    anchor = p[lo]
    doc = np.searchsorted(offs, lo, "right") - 1
    key = span_hash(h, anchor, anchor + q)
    block = mix(span_hash(h, lo, lo + count - 1 + width) + (anchor - lo).astype(np.uint64))
    return [doc, lo - offs[doc], count, anchor - lo, key, block, lo]


def _pieces(batches, width: int):
    """Chunks of text; a text beyond 4 MB comes in pieces that overlap by width - 1 bytes: (doc_id, text hash, bytes, offsets, where each piece starts)."""
    for batch, data, offs in chunks(batches):
        ids, rids = batch.column(0), batch.column(1)
        if len(data) <= _PIECE or len(offs) > 2:
            yield ids, rids, data, offs, np.zeros(len(offs) - 1, np.int64)
        else:
            for a in range(0, max(1, len(data) - width + 1), _PIECE):
                part = data[a : a + _PIECE + width - 1]
                yield ids, rids, part, np.array([0, len(part)]), np.array([a])


def _anchors(width):
    def run(batches):
        for _, _, data, offs, _ in _pieces(batches, width):
            h, k = np.unique(blocks(data, offs, width)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k, pa.int32())], names=["h", "k"])

    return run


def _places(ids, rids, doc, start):
    """A 64-bit number of each (document, text hash, start)."""
    i = ids.take(pa.array(doc)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    r = rids.take(pa.array(doc)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix(mix(mix(i) ^ r) + start.astype(np.uint64))


def _blocks(width, wanted, bits):
    """Blocks with a repeated anchor: the anchor, the block's hash (of bytes and anchor's place), where it is, its windows."""

    def run(batches):
        for ids, rids, data, offs, base in _pieces(batches, width):
            doc, start, count, _, key, block, _ = blocks(data, offs, width)
            on = in_filter(wanted.value, key, bits)
            doc, start, count, key, block = (v[on] for v in (doc, start, count, key, block))
            start = start + base[doc]
            at = pa.array(doc)
            cols = [pa.array(key.view(np.int64)), pa.array(block.view(np.int64)), ids.take(at), rids.take(at), pa.array(start), pa.array(count, pa.int32()), pa.array(_places(ids, rids, doc, start).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "block", "doc", "rid", "s", "n", "w"])

    return run


def _bytes(width, wanted, bits, hot):
    """The bytes of the wanted blocks, by shard key: the anchor, or where it is hot also some of its places and the bytes that windows with these places share."""

    def run(batches):
        for ids, rids, data, offs, base in _pieces(batches, width):
            doc, start, count, place, key, block, lo = blocks(data, offs, width)
            on = in_filter(wanted.value, _places(ids, rids, doc, start + base[doc]), bits)
            doc, start, count, place, key, block, lo = (v[on] for v in (doc, start, count, place, key, block, lo))
            split = np.isin(key, hot.value)
            if split.any():
                # window k of a block has its anchor at place - k; windows of one group of places lie together
                first = place // PLACES
                parts = np.where(split, first - (place - count + 1) // PLACES + 1, 1)
                row = np.repeat(np.arange(len(doc)), parts)
                g = first[row] - (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
                on = split[row]
                begin = np.where(on, np.maximum(place[row] - (g * PLACES + PLACES - 1), 0), 0)
                stop = np.where(on, np.minimum(place[row] - g * PLACES, count[row] - 1), count[row] - 1)
                h = prefix_hash(byte_values(data))
                anchor = lo[row] + place[row]
                core = span_hash(h, np.where(on, anchor - g * PLACES, anchor), np.where(on, anchor - (g * PLACES + PLACES - 1) + width, anchor + ANCHOR))
                doc, start, lo, count, place, key, block = doc[row], start[row] + begin, lo[row] + begin, stop - begin + 1, place[row] - begin, key[row], block[row]
                key = np.where(on, mix(core + g.astype(np.uint64)), key)
                own = mix(span_hash(h, lo, lo + count - 1 + width) + place.astype(np.uint64))
                block, split = np.where(on, own, block), on
            total = count - 1 + width
            begin = np.cumsum(total) - total
            flat = data[np.arange(int(total.sum())) + np.repeat(lo - begin, total)]
            at = pa.array(doc)
            cut_ = pa.py_buffer(np.append(begin, total.sum()).astype(np.int32))
            held = pa.Array.from_buffers(pa.binary(), len(lo), [None, cut_, pa.py_buffer(flat)])
            cols = [pa.array(key.view(np.int64)), pa.array(block.view(np.int64)), ids.take(at), rids.take(at), pa.array(start + base[doc]), pa.array(count, pa.int32()), pa.array(place, pa.int32()), held, pa.array(split)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "block", "doc", "rid", "s", "n", "place", "bytes", "split"])

    return run


def may_repeat(key: np.ndarray, data: np.ndarray, offs: np.ndarray, count: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the windows of each block that may equal a window of another block of its key: a window has at least half of its other bytes on one side of the anchor, so that half and the anchor must occur twice."""
    h = prefix_hash(byte_values(data))
    half = (width - ANCHOR) // 2
    anchor = offs[:-1] + place
    split = np.clip(place - half, 0, count)  # windows before it have more than half in front

    def twice(has, begin, end):
        on = np.flatnonzero(has)
        x = mix(span_hash(h, begin[on], end[on]) ^ mix(key[on].view(np.uint64)))
        _, where, k = np.unique(x, return_inverse=True, return_counts=True)
        out = np.zeros(len(has), bool)
        out[on] = k[where] > 1
        return out

    front = twice(split > 0, anchor - half, anchor + ANCHOR)
    behind = twice(split < count, anchor, anchor + width - half)
    return np.where(front, 0, split), np.where(behind, count, split)


def _sorted(width):
    """Blocks by shard key to the intervals of windows that an earlier block of the key has. Memory holds the blocks of one sort, and of these suffixes beyond induced.MEMORY wait on disk."""

    def found(batches):
        rows = pa.Table.from_batches(batches).combine_chunks()
        doc, rid, s = (rows.column(i).combine_chunks() for i in (1, 2, 3))
        key, count, place = (rows.column(i).combine_chunks().to_numpy().astype(np.int64) for i in (0, 4, 5))
        col = rows.column(6).combine_chunks()
        data, offs = np.frombuffer(col.buffers()[2], np.uint8), np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset).astype(np.int64)
        data, offs = data[offs[0] : offs[-1]], offs - offs[0]
        first, end = may_repeat(key, data, offs, count, place, width)
        kept = np.flatnonzero(first < end)
        size = end[kept] - first[kept] - 1 + width
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(kept)), size)
        k = np.arange(len(row)) - begin[row]
        data = data[(offs[:-1][kept] + first[kept])[row] + k]
        take = pa.array(kept)
        doc, rid, s = doc.take(take), rid.take(take), s.to_numpy(zero_copy_only=False)[kept] + first[kept]
        where = [x.to_numpy(zero_copy_only=False) for x in (rid, doc.fill_null(0), doc.is_valid())]
        by = np.lexsort(where)
        new = np.append(False, np.any([x[by][1:] != x[by][:-1] for x in where], axis=0))[: len(by)]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new)
        dup = repeated(data, np.append(begin, len(data)), (rank[row] << 40) + s[row] + k, width) if len(kept) else np.zeros(0, bool)
        edge = np.flatnonzero(dup & ((k == 0) | ~np.append(False, dup[:-1])[: len(dup)]))
        stop = np.flatnonzero(dup & np.append(~dup[1:] | (k[1:] == 0), True)[: len(dup)])
        r = pa.array(row[edge])
        return pa.RecordBatch.from_arrays([doc.take(r), rid.take(r), pa.array(s[row[edge]] + k[edge]), pa.array(s[row[edge]] + k[stop] + width)], names=["doc", "rid", "a", "b"])

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


def _later(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """rows with first, the place of the first of their class (block) if it has several."""
    several = classes.where("m > 1")
    return hot_join(rows, several.select("block", "first"), "block", several.select("block", F.col("m").alias("n")), total)


def _not_first(rows: DataFrame, width: int) -> DataFrame:
    here = F.struct("doc", "rid", "s").eqNullSafe(F.struct("first.doc", "first.rid", "first.s"))
    return rows.where(F.col("first").isNotNull() & ~here).select("doc", "rid", F.col("s").alias("a"), (F.col("s") + F.col("n") - 1 + width).alias("b"))


def repeated_spans(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc, rid, a, b): byte intervals of docs (doc_id, rid, text) covered by a string of width bytes that also starts earlier; they may overlap."""
    spark = docs.sparkSession
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "rid", "text")
    counts = x.mapInArrow(_anchors(width), "h long, k int").groupBy("h").agg(F.sum("k").alias("k")).where("k > 1").select("h")
    counts = cut(counts, "repeats-anchors")
    bits = bits_for(counts.count())
    wanted = spark.sparkContext.broadcast(key_filter_array(counts, "h", bits))
    found = cut(x.mapInArrow(_blocks(width, wanted, bits), "h long, block long, doc long, rid long, s long, n int, w long"), "repeats-blocks")
    by_block = found.groupBy("block").agg(F.first("h").alias("h"), F.min(F.struct("doc", "rid", "s", "w")).alias("first"), F.count(F.lit(1)).alias("m"))
    by_block = cut(by_block, "repeats-classes")
    total = found.count()
    several = by_block.where("m > 1").select("block")
    again = with_filter(found, several, "block", "maybe", bits_for(several.count())).where("maybe").select("block", "doc", "rid", "s", "n")
    whole = _not_first(_later(again, by_block, total), width)
    # distinct blocks of anchors that have several
    kinds = cut(by_block.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats-kinds")
    n_kinds = kinds.agg(F.sum("n")).first()[0] or 0
    hot = [r.h for r in kinds.where(F.col("n") > max(HOT_ROWS, n_kinds // HOT_SHARE)).select("h").collect()]  # fewer than HOT_SHARE
    mixed = with_filter(by_block, kinds, "h", "maybe", bits_for(kinds.count())).where("maybe").select(F.col("first.w").alias("w"))
    bits = bits_for(n_kinds)
    wanted = spark.sparkContext.broadcast(key_filter_array(mixed, "w", bits))
    hot = spark.sparkContext.broadcast(np.array(hot, np.int64).view(np.uint64))
    parts = x.mapInArrow(_bytes(width, wanted, bits, hot), "key long, block long, doc long, rid long, s long, n int, place int, bytes binary, split boolean")
    if len(hot.value):
        parts = cut(parts, "repeats-parts")
        again = parts.where("split")
        classes = cut(again.groupBy("block").agg(F.min(F.struct("doc", "rid", "s")).alias("first"), F.count(F.lit(1)).alias("m")), "repeats-split")
        again = cut(_later(again, classes, again.count()), "repeats-again")
        whole = whole.union(_not_first(again, width))
        firsts = again.where(F.col("first").isNull() | F.struct("doc", "rid", "s").eqNullSafe(F.col("first"))).select(parts.columns)
        parts = parts.where("not split").union(firsts)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.select("key", "doc", "rid", "s", "n", "place", "bytes").repartition(n, "key").sortWithinPartitions("key")
    return whole.union(parts.mapInArrow(_sorted(width), "doc long, rid long, a long, b long"))


def _removed(row):
    """For each document: what is left of its bytes without the intervals, how many bytes and runs went."""

    def run(batches):
        for batch, data, offs in chunks(batches):
            out = []
            marks = batch.column(2).to_pylist()
            for i, m in enumerate(marks):
                text = data[offs[i] : offs[i + 1]]
                if m:
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, [x["a"] for x in m], 1)
                    np.add.at(edge, [x["b"] for x in m], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append(row(text.size, text[~gone], runs))
                else:
                    out.append(row(text.size, text, 0))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, row.types, strict=True))], names=["doc_id", *row.names])

    return run


class _Digest:
    names, types, schema = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), (pa.int64(), pa.int64(), pa.int64(), pa.string()), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def __call__(self, size, kept, runs):
        return size, size - kept.size, runs, hashlib.sha256(kept.tobytes()).hexdigest()


class _Text:
    names, types, schema = ("text", "n_removed"), (pa.string(), pa.int64()), "doc_id long, text string, n_removed long"

    def __call__(self, size, kept, runs):
        return kept.tobytes().decode("utf-8", "replace"), size - kept.size


def remove_repeats(docs: DataFrame, width: int = 100, row=None) -> DataFrame:
    """(doc_id, text, n_removed), or row's columns, of each row of docs (doc_id, text) without repeated bytes.

    Null and empty texts stay empty; texts under width bytes lose nothing. Documents come in doc_id order, null first;
    rows with one doc_id are ordered by a hash of their text, and the same row repeated is not a repeat of itself. An
    empty table gives no rows. Windows are compared by 64-bit hashes. Removal may cut a character in two; text then
    shows the replacement character, the digest row has the bytes.
    """
    row = row or _Text()
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("text"))
    spans = repeated_spans(docs.where(F.octet_length("text") >= width), width)
    marks = cut(spans.groupBy("doc", "rid").agg(F.collect_list(F.struct("a", "b")).alias("marks")), "repeats-marks")
    docs = with_filter(docs, marks.select("rid"), "rid", "maybe", bits_for(marks.count()))
    none = F.lit(None).cast("array<struct<a: bigint, b: bigint>>")
    free = docs.where("not maybe").select("doc_id", "text", none.alias("marks"))
    touched = docs.where("maybe").join(marks.withColumnRenamed("rid", "r"), F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("rid")), "left").select("doc_id", "text", "marks")
    return free.mapInArrow(_removed(row), row.schema).union(touched.mapInArrow(_removed(row), row.schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 100, _Digest())
