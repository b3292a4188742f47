"""Token ids of whole texts by a file of the tokenizers library, and a frequency-ranked file format for them.

A byte-level BPE merges inside pre-tokens only, so a text's ids are its pre-tokens' ids end to end. The encoder finds
pre-tokens with array operations and gives each distinct one to the library once; most words of a corpus repeat.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import CHUNK_BYTES, bounded_batches, chunks, cut, fresh_path, mix, prefix_hash, span_hash, table

OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
#: What the pre-tokenizer's pattern calls white space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Distinct pre-tokens that a worker remembers; then it starts anew.
MEMO = 1_500_000


@functools.cache
def _classes() -> np.ndarray:
    """Each code point's class; UNSURE where Unicode versions disagree: such texts go to the library whole."""
    now, old = unicodedata.category, unicodedata.ucd_3_2_0.category
    kind = {"L": LETTER, "N": NUMBER}
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        a = now(c)[0]
        out[i] = kind.get(a, OTHER) if a == old(c)[0] else UNSURE
    out[WHITE] = SPACE
    return out


class Encoder:
    """Ids by the tokenizer file at path, no special tokens added; texts that contain an added token's content go to the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each keep memory
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.len, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 4096) for e in self.tok.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids end to end, and how many each text has."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cls = _classes()[cp]
        unsure = np.arange(len(texts))
        if self.plain:
            special = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
            unsure = np.union1d(np.searchsorted(ends, np.flatnonzero(cls == UNSURE), "right"), np.array(special, np.int64))
        starts = self._starts(cp, cls, ends - size, size)
        ids, per_word, words = self._words(cp, starts, texts, ends, size)
        doc = np.searchsorted(ends, starts, "right")
        counts = np.bincount(doc, weights=per_word, minlength=len(texts)).astype(np.int64)
        if not len(unsure):
            return ids, counts
        at = np.concatenate([[0], np.cumsum(counts)])
        own = dict(zip(unsure.tolist(), self._library([texts[i] for i in unsure]), strict=True))
        parts = [np.asarray(own[i], np.uint32) if i in own else ids[at[i] : at[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _starts(self, cp, cls, doc_start, doc_size) -> np.ndarray:
        """Where pre-tokens begin: a letter, number or other run takes one plain space before it; of a longer white run the last character stays apart."""
        n = len(cp)
        first = np.zeros(n + 1, bool)
        first[doc_start[doc_size > 0]] = True
        run = first[:n].copy()
        run[1:] |= cls[1:] != cls[:-1]
        rs = np.flatnonzero(run)
        rl = np.diff(np.append(rs, n))
        rc, rfirst = cls[rs], first[rs]
        white = rc == SPACE
        last = rs + rl - 1
        followed = np.append(~rfirst[1:], False)
        takes = white & followed & (cp[last] == 32)  # its last character goes to the next run
        start = np.zeros(n + 1, bool)
        after = np.concatenate([[False], takes[:-1]])
        start[rs[~white & ~after]] = True
        start[rs[after] - 1] = True
        start[rs[white & (~takes | (rl > 1))]] = True
        start[last[white & followed & ~takes]] = True
        # contractions: a lone apostrophe straight after other text, and the letters that belong to it
        q = np.flatnonzero((rc == OTHER) & (rl == 1) & (cp[rs] == 39) & ~after & followed)
        q = q[rc[np.minimum(q + 1, len(rc) - 1)] == LETTER] if len(q) else q
        for i in q:
            s, m = rs[i] + 1, rl[i + 1]
            two = "".join(map(chr, cp[s : s + min(2, m)]))
            k = 2 if two in ("re", "ve", "ll") else 1 if two[:1] in ("s", "t", "m", "d") else 0
            if k:
                start[s] = False
                if k < m:
                    start[s + k] = True
        return np.flatnonzero(start[:n])

    def _words(self, cp, starts, texts, ends, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stop = np.append(starts[1:], len(cp))
        h = span_hash(prefix_hash(mix(cp.astype(np.uint64) + np.uint64(0x51ED27))), starts, stop)
        uniq, where, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > MEMO:
            self._forget()
        pos = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        if len(self.keys):
            known = self.keys[np.minimum(pos, len(self.keys) - 1)] == uniq
        if not known.all():
            new = np.flatnonzero(~known)
            w = where[new]
            doc = np.searchsorted(ends, starts[w], "right")
            base = (ends - size)[doc]
            got = self._library([texts[d][a:b] for d, a, b in zip(doc.tolist(), (starts[w] - base).tolist(), (stop[w] - base).tolist(), strict=True)])
            n = np.fromiter(map(len, got), np.int64, len(got))
            at = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, np.fromiter((i for g in got for i in g), np.uint32, int(n.sum()))])
            self.keys, self.at, self.len = (np.insert(old, pos[new], x) for old, x in ((self.keys, uniq[new]), (self.at, at), (self.len, n)))
            pos = np.searchsorted(self.keys, uniq)
        at, n = self.at[pos][inv], self.len[pos][inv]
        total = int(n.sum())
        begin = np.cumsum(n) - n
        return self.ids[np.arange(total) - np.repeat(begin - at, n)], n, uniq


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[np.ndarray]]]:
    """doc_ids and each document's ids with end_id behind them, a chunk of text at a time."""
    enc = encoder(path)
    for batch, data, offs in chunks(batches, limit=limit):
        ids, counts = enc.encode(data, offs)
        at = np.concatenate([[0], np.cumsum(counts)])
        yield batch.column(0).to_pylist(), [np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)) for i in range(len(counts))]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


# ---- operator 10: ranked ids in byte-aligned variable-length coding --------------------------------------------
#
# A shard: 8 bytes magic; then for each document a header of 5 little-endian int64 (doc_id, 1 if doc_id is null, ids,
# control bytes, data bytes), its control bytes and its data bytes. A control byte has four 2-bit lengths less one, the
# first in the low bits; a value is the id's frequency rank in so many little-endian bytes. The rank table is a file.

MAGIC = b"QGTOKS01"
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    n = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = n - 1
    c = code.reshape(-1, 4)
    control = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    data = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), data[np.arange(4) < n[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again: one table lookup gives the lengths of four, offsets follow by summing."""
    n = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    raw = np.zeros((count, 4), np.uint8)
    raw[np.arange(4) < n[:, None]] = np.frombuffer(data, np.uint8)
    return raw.view("<u4").reshape(-1)


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _encode_shard(out: str, path: str, end_id: int):
    """Encode a partition once: ids of each document to a compressed file, the partition's counts of ids as rows."""

    def run(batches):
        task, enc = TaskContext.get(), encoder(path)
        wide = "<u2" if max(enc.vocab, end_id + 1) <= 1 << 16 else "<u4"
        fs, root = _fs(out)
        name = f"{root}/shard-{task.partitionId():06d}"
        n_docs = n_ids = 0
        total = np.zeros(max(enc.vocab, end_id + 1), np.int64)
        with fs.open_output_stream(tmp := f"{name}.{task.taskAttemptId()}.ids") as f, zstd.ZstdCompressor(level=1).stream_writer(f, closefd=False) as z:
            for keys, docs in encoded(batches, path, end_id):
                for key, ids in zip(keys, docs, strict=True):
                    z.write(np.array([key or 0, key is None, len(ids)], "<i8").tobytes() + ids.astype(wide).tobytes())
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids)
                total += np.bincount(np.concatenate(docs), minlength=len(total))
        fs.move(tmp, f"{name}.ids")
        seen = np.flatnonzero(total)
        first = np.zeros(len(seen) + 1, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(first + task.partitionId(), pa.int32()), pa.array(first + n_docs), pa.array(first + n_ids), pa.array([None, *seen.tolist()], pa.int64()), pa.array([0, *total[seen].tolist()], pa.int64())],
            names=["shard", "docs", "ids", "id", "n"],
        )

    return run


def _rank_shard(out: str, path: str, end_id: int, ranks):
    """Turn a shard's compressed ids into the file format. If a task runs again, the shard may have its name already."""

    def run(batches):
        fs, root = _fs(out)
        rank_of = np.zeros(int(ranks.value.max(initial=0)) + 1, np.uint32)
        rank_of[ranks.value] = np.arange(len(ranks.value), dtype=np.uint32)
        wide = "<u2" if max(encoder(path).vocab, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                name = f"{root}/shard-{shard:06d}"
                if fs.get_file_info(f"{name}.ids").type != pafs.FileType.NotFound:
                    tmp = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                    with fs.open_output_stream(tmp) as f, fs.open_input_stream(f"{name}.ids") as g, zstd.ZstdDecompressor().stream_reader(g) as z:
                        f.write(MAGIC)
                        while head := _exactly(z, 24):
                            key, null, count = np.frombuffer(head, "<i8").tolist()
                            control, data = pack_ranks(rank_of[np.frombuffer(_exactly(z, count * int(wide[2])), wide)])
                            f.write(np.array([key, null, count, len(control), len(data)], "<i8").tobytes() + control + data)
                    fs.move(tmp, f"{name}.qgt")
                    fs.delete_file(f"{name}.ids")
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    return run


def _exactly(stream, n: int) -> bytes:
    parts = []
    while n and (got := stream.read(n)):
        parts.append(got)
        n -= len(got)
    return b"".join(parts)


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = 2, shards: int | None = None) -> list[dict]:
    """Write all documents (doc_id, text) in ascending doc_id order as shards under the URI out; return one entry a shard.

    Null text is empty (only the end id), null doc_id sorts first, rows with one doc_id stay together, an empty table
    writes the rank table alone. Files are written under a name of the attempt and then moved, so a task may run again.
    Ids get ranks by falling count over all documents, then by id; at most one row for each id of the vocabulary and one
    for each shard reach the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    fs, root = _fs(out)
    fs.create_dir(root, recursive=True)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_docs = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    counts = cut(sorted_docs.mapInArrow(_encode_shard(out, path, end_id), "shard int, docs long, ids long, id long, n long"), "token-counts")
    got = [r.asDict() for r in counts.where("id is null and docs > 0").select("shard", "docs", "ids").orderBy("shard").collect()]
    top = counts.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r.id for r in sorted(top, key=lambda r: (-r.n, r.id))], np.uint32)
    with fs.open_output_stream(f"{root}/ranks.u4") as f:
        f.write(by_rank.astype("<u4").tobytes())
    ranks = spark.sparkContext.broadcast(by_rank)  # at most one entry for each id of the vocabulary
    if got:
        spark.createDataFrame([(r["shard"],) for r in got], "shard int").repartition(len(got), "shard").mapInArrow(_rank_shard(out, path, end_id, ranks), "shard int").count()
    return [r | {"file": f"shard-{r['shard']:06d}.qgt"} for r in got]


def read_token_files(spark: SparkSession, at: str, shards: list[dict]) -> DataFrame:
    """(doc_id, start, ids array) read from the shards, one document in memory at a time."""
    return _read(spark, at, shards, "doc_id long, start long, ids array<int>", lambda key, start, ids: (key, start, ids.astype(np.int32)))


def _read(spark: SparkSession, at: str, shards: list[dict], schema: str, row) -> DataFrame:
    base = np.cumsum([0] + [s["ids"] for s in shards])
    rows = [(s["file"], int(b)) for s, b in zip(shards, base, strict=False) if s["docs"]]
    if not rows:
        return spark.createDataFrame([], schema)
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches):
        fs, root = _fs(at)
        with fs.open_input_file(f"{root}/ranks.u4") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                with fs.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as f:
                    if f.read(8) != MAGIC:
                        raise ValueError(f"{name} is no token file")
                    while head := f.read(40):
                        key, null, count, c, d = np.frombuffer(head, "<i8").tolist()
                        ids = by_rank[unpack_ranks(f.read(c), f.read(d), count)]
                        out.append(row(None if null else key, start, ids))
                        start += count
                        if len(out) >= 2000:
                            yield pa.RecordBatch.from_pydict({k: list(v) for k, v in zip(names, zip(*out, strict=True), strict=True)}, schema=_arrow(schema))
                            out = []
                if out:
                    yield pa.RecordBatch.from_pydict({k: list(v) for k, v in zip(names, zip(*out, strict=True), strict=True)}, schema=_arrow(schema))

    return spark.createDataFrame(rows, "file string, base long").repartition(len(rows)).mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    at = fresh_path(spark, "tokens")
    shards = write_token_files(table(spark, sf_dir, "documents"), at, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return _read(spark, at, shards, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda key, start, ids: (key, start, len(ids), crc(ids)))
