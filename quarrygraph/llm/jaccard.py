"""Operator 7: n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the product are distinct sets (equal sets are one vertex). Its blocks come from the sizes: two sets that reach
the threshold differ in at most D n-grams, D fixed by their sizes, so of D + 1 + e column slices (n-grams dealt by hash)
they agree entirely in at least 1 + e. Sets that agree in a slice form a block. As 1 + e slices agree, each set may leave
out its e slices with the largest blocks, under one order for all sets, and no pair is lost; slices that are empty or
hold one frequent n-gram alone leave that way. A block is multiplied against one row of it (its pivot): the overlap
counts accumulate slice by slice of the columns, and a row whose count and what it has left can't reach the bound that
the two sizes give is discarded. Pairs that sizes or parity maps rule out are discarded before that. Blocks that lie in
one component are done, so a large group of near copies costs products in proportion to its size; rounds of other pivots
follow for the rest, and then all remaining pairs of different components.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import Held, bits_for, bounded_batches, byte_values, chunks, components, cut, hot_join, in_filter, key_filter_array, mix, prefix_hash, span_hash, table, with_filter

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x2545F4914F6CDD1D)
#: Columns of a set's 1,024-bit parity map. Two sets differ in at least as many n-grams as their maps do in bits: a bound
#: that discards pairs before they are multiplied. Maps of 256 bits let through pairs that differ in half as much again as they may.
MAPS = tuple(f"m{i}" for i in range(16))
#: Rows of a block whose pairs are all formed at once, and rounds of pivots for larger ones before all remaining pairs of different components are formed.
SMALL, ROUNDS = 8, 2
#: Rows that one task multiplies with a pivot, and rows of a block from which its remaining pairs are spread over tasks.
STRIP = 256
#: Column slices of a product, after each of which rows are discarded (a power of two).
SLICES = 4


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-word shingles as sorted 64-bit hashes; with fewer words the whole sequence is one; without words none."""
    low = _LOWER[data]
    word = ~_SPACE[low]
    begin = word.copy()
    first = np.zeros(len(low) + 1, bool)
    first[offs[:-1]] = True
    begin[1:] &= ~word[:-1] | first[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | first[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    w = span_hash(prefix_hash(byte_values(low)), s, e)
    at = np.searchsorted(s, offs)
    h = w.copy()
    for k in range(1, n):
        h = mix(h[: len(w) - k] * _STEP + w[k:]) if len(w) > k else h[:0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(h[a : b - n + 1])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for i in range(a, b):
                x = mix(x * _STEP + w[i : i + 1])
            yield x
        else:
            yield w[:0]


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets).view(np.int64) if len(sets) and size.sum() else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))


def _parity(mixed: np.ndarray, bits: int = 10) -> np.ndarray:
    """The set's parity map of 2^bits bits: how often each place is hit, modulo 2."""
    hit = np.bincount((mixed >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.packbits(hit.astype(np.uint8) & 1).view(np.int64)


@functools.lru_cache(maxsize=64)
def size_classes(percent: int, most: int) -> np.ndarray:
    """First sizes of the classes up to size most: partners of a set lie in its class or the next one, up or down."""
    first = [1, 2]
    while first[-1] <= most:
        first.append(max(first[-1] + 1, 100 * (first[-1] - 1) // percent + 1))
    return np.array([*first, max(first[-1] + 1, 100 * (first[-1] - 1) // percent + 1)])


def slices(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(tag, column slices, how many of them may be left out) for a set's own class and the next: a pair meets under the larger set's class."""
    first = size_classes(percent, 1 << (size + 2).bit_length())
    own = int(np.searchsorted(first, size, "right")) - 1
    out = []
    for tag in (own, own + 1):
        most = 2 * (int(first[tag + 1]) - 1) * (100 - percent) // (100 + percent)
        if most:  # else only equal sets could link under this tag
            spare = -(-(most + 1) // 4)
            out.append((tag, most + 1 + spare, spare))
    return out


def slice_keys(mixed: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """For each tag of slices: how many keys may be left out, and the slices' keys, alike for sets that agree in a slice."""
    out = []
    for tag, m, spare in slices(len(mixed), percent):
        total = np.zeros(m, np.uint64)
        np.add.at(total, ((mixed >> np.uint64(24)) % np.uint64(m)).astype(np.int64), mixed)
        out.append((spare, mix(total ^ mix((np.uint64(tag) << np.uint64(40)) + np.arange(1, m + 1, dtype=np.uint64)))))
    return out


def _vertex(mixed: np.ndarray) -> int:
    return int(mix(mix(mixed.sum(dtype=np.uint64, keepdims=True)) ^ np.bitwise_xor.reduce(mixed, keepdims=True) ^ np.uint64(len(mixed))).view(np.int64)[0])


_ROW = "doc_id long, v long, n long, e1 int, k1 array<long>, e2 int, k2 array<long>"
_SET = "v long, n long, " + ", ".join(f"{m} long" for m in MAPS) + ", s array<long>"


def _rows(n: int, percent: int):
    def run(batches):
        for batch, data, offs in chunks(batches):
            v, size, spare, keys = [], [], ([], []), ([], [])
            for x in shingle_sets(data, offs, n):
                m = mix(x)
                size.append(len(x))
                v.append(_vertex(m) if len(x) else None)
                got = slice_keys(m, percent) if len(x) else []
                for i in (0, 1):
                    e, k = got[i] if i < len(got) else (0, m[:0])
                    spare[i].append(e)
                    keys[i].append(k)
            cols = [batch.column(0), pa.array(v, pa.int64()), pa.array(size, pa.int64()), pa.array(spare[0], pa.int32()), _lists(keys[0]), pa.array(spare[1], pa.int32()), _lists(keys[1])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "v", "n", "e1", "k1", "e2", "k2"])

    return run


def _sets(n: int, wanted, bits: int):
    def run(batches):
        for batch, data, offs in chunks(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.flatnonzero(in_filter(wanted.value, ids, bits))
            if len(keep):
                parts = [data[offs[i] : offs[i + 1]] for i in keep]
                at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                sets = [x for x in shingle_sets(np.concatenate(parts), at, n) if len(x)]
                mixed = [mix(x) for x in sets]
                maps = np.array([_parity(m) for m in mixed], np.int64).reshape(-1, len(MAPS)).T.copy()
                cols = [pa.array([_vertex(m) for m in mixed], pa.int64()), pa.array([len(m) for m in mixed], pa.int64()), *map(pa.array, maps), _lists(sets)]
                yield pa.RecordBatch.from_arrays(cols, names=["v", "n", *MAPS, "s"])

    return run


def overlaps(pivot: np.ndarray, flat: np.ndarray, row: np.ndarray, rows: int, percent: int) -> np.ndarray:
    """Overlap counts of the incidence rows (flat: n-grams, row: which row each is of) with the pivot's row; -1 where a row was discarded.

    Counts accumulate over SLICES column slices by hash. A row is discarded once its count and the smaller of what both
    have left fall short of the least overlap that their sizes need.
    """
    shift = np.uint64(64 - (SLICES.bit_length() - 1))
    part = (flat >> shift).astype(np.int64)
    left = np.bincount(row * SLICES + part, minlength=rows * SLICES).reshape(rows, SLICES)
    size = left.sum(axis=1)
    need = -(-percent * (size + len(pivot)) // (100 + percent))
    left_p = np.bincount((pivot >> shift).astype(np.int64), minlength=SLICES)
    count, alive = np.zeros(rows, np.int64), np.minimum(size, len(pivot)) >= need
    rest, rest_p = size.copy(), len(pivot)
    for i in range(SLICES):
        on = (part == i) & alive[row]
        x = flat[on]
        at = np.minimum(np.searchsorted(pivot, x), len(pivot) - 1)
        count += np.bincount(row[on][pivot[at] == x], minlength=rows)
        rest, rest_p = rest - left[:, i], rest_p - left_p[i]
        alive &= count + np.minimum(rest, rest_p) >= need
    return np.where(alive, count, -1)


def _product(percent: int):
    """Strips (pivot's row first, then its block's rows) to linked pairs (a, b, overlap)."""

    def run(batches):
        strip = pivot = None
        for batch in batches:
            if not batch.num_rows:
                continue
            p, salt, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            head = batch.column(2).to_numpy(zero_copy_only=False) == 0
            col = batch.column(4)
            offs = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset).astype(np.int64)
            flat = col.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].view(np.uint64)
            offs = offs - offs[0]
            new = np.flatnonzero((p[1:] != p[:-1]) | (salt[1:] != salt[:-1])) + 1
            for i, j in zip(np.append(0, new).tolist(), np.append(new, len(p)).tolist(), strict=True):
                if (p[i], salt[i]) != strip:
                    strip, pivot = (p[i], salt[i]), None
                while i < j and head[i]:
                    pivot = flat[offs[i] : offs[i + 1]].copy()
                    i += 1
                if i < j and pivot is not None:
                    row = np.repeat(np.arange(j - i), np.diff(offs[i : j + 1]))
                    k = overlaps(pivot, flat[offs[i] : offs[j]], row, j - i, percent)
                    size = np.diff(offs[i : j + 1])
                    on = np.flatnonzero((k > 0) & (100 * k >= percent * (size + len(pivot) - k)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), p[i])), pa.array(v[i:j][on]), pa.array(k[on])], names=["a", "b", "overlap"])

    return run


def _close(percent: int) -> str:
    """What the sets a and b must meet: sizes within the threshold, and parity maps that differ in no more bits than it lets the sets differ."""
    differ = " + ".join(f"bit_count({m}a ^ {m}b)" for m in MAPS)
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb) and (100 + {percent}) * ({differ}) <= (100 - {percent}) * (na + nb)"


def _multiplied(pairs: DataFrame, attributes: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """The pairs (p, v) that link, as (a, b, overlap), by products of strips of rows with their pivot p."""
    pairs = cut(pairs.distinct(), "jaccard-pairs")
    per = cut(pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")), "jaccard-pivots")
    names = ("n", *MAPS)
    side = lambda k, e: attributes.select(F.col("v").alias(k), *[F.col(c).alias(c + e) for c in names])
    of_pivot = per.select("p", F.ceil(F.col("n") / STRIP).alias("strips")).join(side("p", "a"), "p")
    x = hot_join(pairs.join(side("v", "b"), "v").select("p", "v", *[c + "b" for c in names]), of_pivot, "p", per, pairs.count())
    x = cut(x.where(_close(percent)).select("p", F.pmod(F.xxhash64("v"), "strips").alias("salt"), "v"), "jaccard-strips")
    rows = x.join(sets, "v").select("p", "salt", F.lit(1).alias("role"), "v", "s")
    heads = x.select("p", "salt").distinct().join(sets.withColumnRenamed("v", "p"), "p").select("p", "salt", F.lit(0).alias("role"), F.col("p").alias("v"), "s")
    strips = heads.union(rows).repartition(parts, "p", "salt").sortWithinPartitions("p", "salt", "role")
    return cut(strips.mapInArrow(_product(percent), "a long, b long, overlap long").distinct(), "jaccard-links")


def _labelled(entries: DataFrame, links: DataFrame) -> DataFrame:
    label = components(links.select("a", "b"), "jaccard-cc")
    return entries.select("h", "v", "s").join(label, "v", "left").select("h", "v", "s", F.coalesce("c", "v").alias("c"))


def _blocks(entries: DataFrame, turn: int, name: str) -> DataFrame:
    """entries (h, v, s, c) of blocks that span several components, with their block's rows k and its pivot o, oc of this turn: first the set that shares most slices, later any."""
    order = [-F.col("s"), "v"] if turn == 0 else [F.xxhash64("v", F.lit(turn)), "v"]
    pivot = F.min_by(F.struct("v", "c"), F.struct(*order)).alias("o")
    stats = entries.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), pivot)
    stats = cut(stats.where("lo <> hi").select("h", "n", F.col("o.v").alias("o"), F.col("o.c").alias("oc")), name + "-blocks")
    x = hot_join(entries, stats.withColumn("k", F.col("n")).drop("n"), "h", stats.select("h", "n"), entries.count())
    return cut(x.where("k is not null"), name)


def shared_slices(rows: DataFrame) -> DataFrame:
    """(h, v, s): the keys h of slices in which another set may agree, without those that set v may leave out, of s shared ones."""
    tags = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(f"e{i}").alias("e"), F.col(f"k{i}").alias("k")) for i in (1, 2)])).alias("x")
    keys = rows.select("v", tags).select("v", "x.t", "x.e", F.explode("x.k").alias("h"))
    counts = cut(keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-keys")
    held = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    keys = with_filter(keys, counts, "h", "maybe", bits_for(held[0])).where("maybe").drop("maybe")
    keys = hot_join(keys, counts.withColumn("k", F.col("n")).drop("n"), "h", counts, held[1] or 0).where("k is not null")
    lists = keys.groupBy("v", "t", "e").agg(F.sort_array(F.collect_list(F.struct("k", "h")), asc=False).alias("l")).where("size(l) > e")
    left = F.expr("slice(l, e + 1, size(l) - e)")
    return lists.select("v", F.size("l").cast("long").alias("s"), F.explode(left).alias("x")).select(F.col("x.h").alias("h"), "v", "s")


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their distinct n-word shingles; component_id is the
    smallest doc_id that links reach. Null or empty texts and those without words have no shingles and no links. Rows
    with null doc_id have themselves (null) as component; repeated rows share theirs, and rows that repeat a doc_id with
    other texts are each judged by their own text. An empty table gives no rows; other columns are left out. Shingles
    are 64-bit hashes, and equal hashes count as equal shingles. Pairs inside a component are not counted, so the number
    of links is not given.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Held() as keyed:  # rows with their keys, of which only the entries and the rows without keys stay
        every = cut(docs.mapInArrow(_rows(n, percent), _ROW), "jaccard-rows")
    rows = cut(every.select("doc_id", "v", "n"), "jaccard-slim")
    firsts = rows.where("v is not null and doc_id is not null").groupBy("v").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts, "jaccard-firsts")
    # one row a set: rows whose set is single pass by; the others' copies are met once, before they are shuffled
    own = [c for c in every.columns if c != "doc_id"]
    several = firsts.where("n > 1").select("v")
    with keyed:
        marked = with_filter(every.where("v is not null and doc_id is not null"), several, "v", "maybe", bits_for(several.count()))
        copies = marked.where("maybe").groupBy("v").agg(F.first(F.struct(*own[1:])).alias("x")).select("v", *[f"x.{c}" for c in own[1:]])
        single = marked.where("not maybe").select(*own).union(cut(copies, "jaccard-copies"))
        shared = shared_slices(single).withColumn("c", F.col("v"))
    entries = cut(shared, "jaccard-entries")
    del every, marked, copies, single, shared
    keyed.drop(spark)
    blocks = _blocks(entries, 0, "jaccard-round")
    found = cut(blocks.select("v").distinct(), "jaccard-found")
    ids = found.join(firsts, "v").select("doc")
    bits = bits_for(found.count())
    wanted = spark.sparkContext.broadcast(key_filter_array(ids, "doc", bits))  # at most MOST_BITS
    sets = docs.where("doc_id is not null").mapInArrow(_sets(n, wanted, bits), _SET)
    sets = cut(sets.join(found, "v", "left_semi").dropDuplicates(["v"]), "jaccard-sets")
    attributes = cut(sets.select("v", "n", *MAPS), "jaccard-attributes")
    # small blocks: all pairs; larger ones: each row with the pivot
    lists = blocks.where(f"k <= {SMALL}").groupBy("h").agg(F.sort_array(F.collect_list("v")).alias("l"))
    two = F.explode(F.expr("flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x as p, y as v))))")).alias("t")
    pairs = lists.select(two).select("t.p", "t.v").union(blocks.where(f"k > {SMALL} and v <> o").select(F.col("o").alias("p"), "v"))
    links = _multiplied(pairs, attributes, sets, percent, parts)
    entries = blocks.where(f"k > {SMALL}")
    for turn in range(1, ROUNDS):
        entries = _blocks(_labelled(entries, links), turn, "jaccard-round")
        pairs = entries.where("c <> oc").select(F.col("o").alias("p"), "v")
        if not pairs.limit(1).count():
            break
        links = links.union(_multiplied(pairs, attributes, sets, percent, parts))
    rest = _blocks(_labelled(entries, links), ROUNDS, "jaccard-rest")
    if rest.limit(1).count():
        spread = F.ceil(F.col("k") / STRIP).cast("int")
        side = lambda k, e: attributes.select(F.col("v").alias(k), *[F.col(c).alias(c + e) for c in ("n", *MAPS)])
        # one side lies outside the pivot's component, which may hold nearly all of a block; a row gets its maps before it is repeated for the strips
        x = rest.where("c <> oc").join(side("v", "a"), "v").withColumn("salt", F.explode(F.sequence(F.lit(0), spread - 1)))
        y = rest.select(F.col("h").alias("g"), F.col("v").alias("w"), F.col("c").alias("d"), F.pmod(F.xxhash64("v"), spread).cast("int").alias("at")).join(side("w", "b"), "w")
        x = x.select("h", "salt", "v", "c", "oc", *[c + "a" for c in ("n", *MAPS)])
        on = (F.col("h") == F.col("g")) & (F.col("salt") == F.col("at")) & (F.col("c") != F.col("d")) & ((F.col("d") == F.col("oc")) | (F.col("v") < F.col("w")))
        pairs = x.join(y, on & F.expr(_close(percent))).select(F.col("v").alias("p"), F.col("w").alias("v"))
        links = links.union(_multiplied(pairs, attributes, sets, percent, parts))
    label = components(links.select("a", "b"), "jaccard-cc")
    group = firsts.join(label, "v", "left").select("v", "doc", F.col("n").alias("size"), F.coalesce("c", "v").alias("c"))
    least = cut(group.groupBy("c").agg(F.min("doc").alias("component"), F.count(F.lit(1)).alias("n")), "jaccard-least")
    group = cut(group, "jaccard-groups")
    group = hot_join(group, least.select("c", "component"), "c", least, firsts.count())
    group = cut(group.select("v", "component", "size"), "jaccard-named")
    # sets of one document keep its id or take a component's; copies of one text may hold a third of all rows
    out = hot_join(rows.select("doc_id", "n", "v"), group.select("v", "component"), "v", group.select("v", F.col("size").alias("n")), rows.count())
    owned = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), owned.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), 3, 90)
