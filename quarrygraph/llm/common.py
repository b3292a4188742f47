"""What the training-data operators share: the shared folder, Arrow text buffers, hashing, fixed-size key filters, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step holds as arrays at once; longer single texts are taken alone.
CHUNK_BYTES = 1 << 20
#: Bytes of text after which a Python step gives freed memory back to the system.
RELEASE_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most 1,000 rows and about 4 MB, whatever their lengths: Arrow's buffers stay small on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new temporary one only where that is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quarrygraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where the tables that cut writes are noted, oldest first: with whoever holds them, else in one list of the process.
_holder: ContextVar[list[str]] = ContextVar("holder")
_holder.set([])


class Held:
    """The tables that cut writes within this context, and no others: with Held() as own: ...; own.drop(spark)."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Held:
        self._before = _holder.set(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _holder.reset(self._before)

    def drop(self, spark: SparkSession) -> None:
        """Delete them: only once what was made from them is itself written. Shuffle files that nothing refers to any more go with them."""
        _delete(spark, self.paths)
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # Spark's cleaner removes a shuffle's files once its plan is collected; by itself that is every half hour


def _delete(spark: SparkSession, paths: list[str], mark: int = 0) -> None:
    jvm = spark.sparkContext._jvm
    for at in paths[mark:]:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del paths[mark:]


def _held() -> list[str]:
    held = _holder.get(None)
    if held is None:  # another thread
        _holder.set(held := [])
    return held


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from a table written to the shared folder: lineage ends there, and lost executors lose nothing."""
    at = fresh_path(df.sparkSession, name)
    _held().append(at)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def written() -> int:
    """How many tables whoever holds the next ones has written so far: what drop_since takes."""
    return len(_held())


def drop_since(spark: SparkSession, mark: int) -> None:
    """Delete the holder's tables since: only once what was made from them is itself written."""
    _delete(spark, _held(), mark)


def text_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and their n + 1 offsets; null is empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col, wide = col.cast(pa.large_string()), True
    _, offs, data = col.buffers()  # no copy of the bytes
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offs, kind, len(col) + 1, kind().itemsize * col.offset).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offs - offs[0]


@functools.cache
def _trim():
    """glibc's malloc_trim, or nothing where the C library has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give freed memory back: workers serve many tasks and stages, and both allocators would keep their peaks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most limit bytes of text (one text at least), each with its bytes and offsets."""
    release()
    done = 0
    for batch in batches:
        data, offs = text_arrays(batch.column(batch.schema.get_field_index(text)))
        done += len(data)
        if done >= RELEASE_BYTES:
            release()
            done = 0
        i, n = 0, len(offs) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j
    release()


# ---- hashing -------------------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE, _INVERSE = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[0] = 0 and H[i] the polynomial hash of the first i values."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) under the prefix hashes h, alike wherever a span lies."""
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


# ---- runs of bytes -------------------------------------------------------------------------------------------

#: A-Z in lower case, every other byte as it is.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; none crosses the bounds offs of a text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offs] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans [start, end) of UTF-8 bytes as an array of strings."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])


# ---- key filters ---------------------------------------------------------------------------------------------

#: Bits of a key filter: at least 2^23 (1 MB), 16 for each key up to 2^27 (16 MB, the most that is ever broadcast).
FILTER_BITS, MOST_BITS = 1 << 23, 1 << 27


def bits_for(count: int, least: int = FILTER_BITS, most: int = MOST_BITS) -> int:
    """Bits of a filter of count keys. A filter at its largest lets more keys through, never fewer."""
    return min(most, max(least, 1 << (16 * max(count, 1) - 1).bit_length()))


def bit_of(key: Column, bits: int = FILTER_BITS) -> Column:
    return F.pmod(key, F.lit(bits))


def key_filter_rows(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """At most bits / 32768 rows (bucket, bitmap of 4 KB) that hold each key's bit; built-in functions only."""
    at = bit_of(F.col(key), bits) + 1  # positions count from 1: bucket b holds bits (b - 1) * 32768 to b * 32768 - 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def key_filter_array(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """The same as one byte array on the driver, of bits / 8 bytes however many keys there are."""
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for bucket, bitmap in key_filter_rows(keys, key, bits).toLocalIterator():
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(bitmap)] = np.frombuffer(bytes(bitmap), np.uint8)
    return out


def in_filter(bitmap: np.ndarray, keys: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Which 64-bit keys (read as signed, as Spark's bigint) may be in the filter."""
    at = np.mod(keys.astype(np.uint64).view(np.int64), np.int64(bits))
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def with_filter(df: DataFrame, keys: DataFrame, key: str, flag: str, bits: int) -> DataFrame:
    """df and whether each row's key may be among keys; at most bits / 8 bytes are broadcast."""
    at = bit_of(F.col(key), bits)
    rows = F.broadcast(key_filter_rows(keys, key, bits).select((F.col("bucket") - 1).alias("__b"), F.col("bitmap").alias("__m")))
    byte = F.conv(F.hex(F.expr(f"substring(__m, cast(pmod({key}, {bits}) % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    on = F.expr(f"shiftright(__y, cast(pmod({key}, {bits}) % 8 as int)) & 1 = 1")
    joined = df.join(rows, F.floor(at / 32768) == F.col("__b"), "left").withColumn("__y", byte)
    return joined.withColumn(flag, F.coalesce(on, F.lit(False))).drop("__b", "__m", "__y")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose 64-bit key is not among ids (key); only rows that may be are shuffled. Null keys stay."""
    marked = with_filter(df, ids, key, "__may", bits_for(ids.count()))
    return marked.where("not __may").select(df.columns).union(marked.where("__may").select(df.columns).join(ids.select(key), key, "left_anti").select(df.columns))


# ---- hot keys ------------------------------------------------------------------------------------------------

#: A key is hot from this many rows on, if they are also more than one in HOT_SHARE of all: under HOT_SHARE keys can be.
HOT_ROWS, HOT_SHARE = 500, 1000


def hot_join(left: DataFrame, right: DataFrame, on: str, counts: DataFrame, total: int) -> DataFrame:
    """left with right's columns by the key on (right has one row a key; rows without one get nulls).

    counts (on, n) tells left's rows of each key, of total rows. Hot keys, fewer than HOT_SHARE by their definition, get
    right's row by broadcast; only the others' rows are shuffled, so no task takes a hot key's rows.
    """
    others = [c for c in right.columns if c != on]
    row = right.select(on, F.struct(*others).alias("__r"))
    hot = counts.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select(on)
    hot = F.broadcast(row.join(F.broadcast(hot), on, "left_semi").withColumn("__hot", F.lit(True)))
    x = left.join(hot, on, "left")
    cold = x.where("__hot is null").select(*left.columns).join(row, on, "left")
    both = x.where("__hot").select(*left.columns, "__r").union(cold.select(*left.columns, "__r"))
    return both.select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in others])


# ---- components ----------------------------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(v, c): each vertex of edges (a, b) with the smallest vertex that it reaches.

    Large-star and small-star contraction: each round replaces the links by links to the smallest neighbour and
    writes them to the shared folder; it ends once every link is a star's. Links and labels never reach the driver.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    for _ in range(rounds):
        total = 2 * e.count()
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), name)
        large = hot_join(both, low.select("a", "m"), "a", low, total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = cut(large.where("a <> b").distinct(), name)
        low = cut(small.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), name)
        nxt = hot_join(small, low.select("a", "m"), "a", low, total)
        nxt = nxt.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        nxt = cut(nxt, name)
        multi = nxt.groupBy("a").count().where("count > 1").limit(1).count()
        inner = nxt.join(nxt.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() if not multi else 1
        e = nxt
        if not multi and not inner:
            break
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    return e.select(F.col("a").alias("v"), F.col("b").alias("c")).union(e.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
