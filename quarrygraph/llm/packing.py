"""Operator 1: sequences of a fixed length from pieces of documents by minimum bin slack.

Each task packs what it reads, block by block, and needs no shuffle: a block of a million tokens holds enough
lengths to fill every window, and what is left of the last window goes on to the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarrygraph.llm.common import bounded_batches, table
from quarrygraph.llm.tokens import crc, encoded

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Tokens that a task gathers before it packs them, and bytes of text that it encodes at once; both bound its memory, whatever the partition holds.
BLOCK_TOKENS = 1 << 20
ENCODE_BYTES = 1 << 19


def best_fill(room: int, lengths: list[int], counts: list[int]) -> dict[int, int]:
    """How many of each length (falling, with counts) come closest to room together, never beyond it.

    Bit s of the set is on if some multiset sums to s. Counts are split into powers of two, so that a length costs few
    shifts; going back through the sets before each shift gives the counts.
    """
    mask, reach, past = (1 << (room + 1)) - 1, 1, []
    for length, n in zip(lengths, counts, strict=True):
        n, k = min(n, room // length) if length else 0, 1
        while n:
            t = min(k, n)
            past.append((length, t, reach))
            reach |= (reach << (length * t)) & mask
            if reach >> room & 1:
                break
            n, k = n - t, 2 * k
        if reach >> room & 1:
            break
    s, out = reach.bit_length() - 1, {}
    for length, t, before in reversed(past):
        if not before >> s & 1:
            out[length] = out.get(length, 0) + t
            s -= length * t
    return out


def pack_pieces(pieces: list[tuple[int, int, int]], size: int, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows of (document, start, length), and what is left: less than a window, or with last nothing.

    Where the best multiset leaves slack, one further piece is cut to fill it, so every window but the last is full.
    The last window is cut at powers of two, which need no padding.
    """
    windows: list[list[tuple[int, int, int]]] = []
    pool: dict[int, list[tuple[int, int, int]]] = {}
    for doc, start, n in pieces:
        while n >= size:
            windows.append([(doc, start, size)])
            start, n = start + size, n - size
        if n:
            pool.setdefault(n, []).append((doc, start, n))
    for x in pool.values():
        x.reverse()
    left = sum(n * len(x) for n, x in pool.items())
    order = sorted(pool, reverse=True)
    while left >= size:
        order = [n for n in order if pool.get(n)]
        top = order[0]
        fit = [n for n in order if n <= size - top]
        chosen = best_fill(size - top, fit, [len(pool[n]) - (n == top) for n in fit])
        chosen[top] = chosen.get(top, 0) + 1
        slack = size - sum(n * k for n, k in chosen.items())
        repeats = 1 if slack else min(len(pool[n]) // k for n, k in chosen.items())
        for _ in range(repeats):
            window = [pool[n].pop() for n, k in chosen.items() for _ in range(k)]
            if slack:
                n = next(n for n in order if pool[n] and n > slack)
                doc, start, _ = pool[n].pop()
                window.append((doc, start, slack))
                pool.setdefault(n - slack, []).append((doc, start + slack, n - slack))
                if n - slack not in order:
                    order = sorted([*order, n - slack], reverse=True)
            windows.append(window)
            left -= size
    rest = [x for n in sorted(pool, reverse=True) for x in reversed(pool[n])]
    if not last:
        return windows, rest
    while left:
        want, window = 1 << (left.bit_length() - 1), []
        left -= want
        while want:
            doc, start, n = rest.pop(0)
            if n > want:
                rest.insert(0, (doc, start + want, n - want))
                n = want
            window.append((doc, start, n))
            want -= n
        windows.append(window)
    return windows, []


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece of each document (doc_id, text), with the sequence and offset where it lies.

    Null or empty text is one piece of the end id alone; documents longer than a window are cut at windows; repeated
    rows are packed as often as they come; null doc_id stays null; an empty table gives no rows; other columns are not
    read. sequence_id is the partition's number * 2^32 and a count, so it is unique.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        keys: dict[int, object] = {}
        docs: dict[int, np.ndarray] = {}
        pieces: list[tuple[int, int, int]] = []
        held = n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, pieces, held, keys, docs
            windows, pieces = pack_pieces(pieces, size, last)
            for i in range(0, len(windows), 4000):
                rows = []
                for window in windows[i : i + 4000]:
                    offset = 0
                    for doc, start, length in window:
                        ids = docs[doc]
                        rows.append((keys[doc], start, length, crc(ids[start : start + length]), len(ids), base + made, offset))
                        offset += length
                    made += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            keep = {doc for doc, _, _ in pieces}
            keys, docs, held = {d: keys[d] for d in keep}, {d: docs[d] for d in keep}, 0

        for got, parts in encoded(batches, path, end_id, ENCODE_BYTES):
            for key, ids in zip(got, parts, strict=True):
                keys[n], docs[n] = key, ids
                pieces.append((n, 0, len(ids)))
                held, n = held + len(ids), n + 1
            if held >= block_tokens:
                yield from flush(False)
        if pieces:
            yield from flush(True)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
