"""Joins beyond equality: prefixes, intervals, as-of, bands, unique and ordered matches. Each keeps an equality key, so Spark deals rows by it and needs no cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(rows: DataFrame, key: str, path: str, prefixes: DataFrame, prefix: str, value: str, sep: str = "/") -> DataFrame:
    """(key, value) by the longest prefix of path that ends at a separator or is the path; ties: smallest value. No match: no row."""
    parts = F.split(F.col(path), sep)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    x = rows.select(key, F.explode(ancestors).alias(prefix)).join(prefixes.select(prefix, value), prefix)
    return x.groupBy(key).agg(F.min_by(value, F.struct(-F.length(prefix), value)).alias(value))


def innermost_span(points: DataFrame, point_id: str, at: str, spans: DataFrame, span_id: str, start: str, end: str, on: str, width: int | None = None) -> DataFrame:
    """(point_id, span_id, depth): of the spans of the same group that contain the point, the one that starts last (ties: smallest id), and how many contain it.

    With width, groups are cut at its multiples and a span takes part in each piece that it touches, so a large group is
    many keys: choose about the length of a usual span.
    """
    piece = lambda c: F.floor(c / F.lit(width)) if width else F.lit(0).cast("long")
    s = spans.select(F.col(on).alias("__on"), F.col(span_id).alias("__span"), F.col(start).alias("__s"), F.col(end).alias("__e")).where("__e >= __s")
    s = s.withColumn("__p", F.explode(F.sequence(piece(F.col("__s")), piece(F.col("__e")))))
    x = points.join(s, (F.col(on) == F.col("__on")) & (piece(F.col(at)) == F.col("__p")) & F.col(at).between(F.col("__s"), F.col("__e")))
    best = F.max_by("__span", F.struct("__s", -F.col("__span")))
    return x.groupBy(point_id).agg(best.alias(span_id), F.count(F.lit(1)).alias("depth"))


def contained(rows: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item: str, words: int = 8) -> DataFrame:
    """(key, item_key) where the text contains the item, as contains() says; empty and null items are in none.

    An item's words but for its first and last stand whole in a text that contains it, so up to eight of them in a row
    are the key that both sides join by. Items of one or two words join by their first three characters (one, if they
    are shorter). Both only find pairs; containment decides.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    i = items.select(F.col(item_key).alias("__i"), F.col(item).alias("__t")).where("__t <> ''").withColumn("__w", split(F.col("__t")))
    inner = i.where("size(__w) > 2").withColumn("__n", F.least(F.size("__w") - 2, F.lit(words)))
    inner = inner.select("__i", "__n", F.xxhash64(F.array_join(F.slice("__w", 2, F.col("__n")), " ")).alias("__k"))
    short = i.where("size(__w) <= 2").select("__i", F.substring("__t", 1, F.when(F.length("__t") > 2, 3).otherwise(1)).alias("__k"))
    d = rows.select(F.col(key).alias("__d"), F.col(text).alias("__x")).where("__x is not null")
    lengths = F.broadcast(inner.select("__n").distinct())  # at most words rows
    w = d.select("__d", split(F.col("__x")).alias("__w"))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - F.col("__n") + 1, F.lit(1))), lambda p: F.xxhash64(F.array_join(F.slice("__w", p, F.col("__n")), " ")))
    long_hits = w.join(lengths, F.size("__w") >= F.col("__n")).select("__d", "__n", F.explode(F.array_distinct(windows)).alias("__k")).join(inner, ["__n", "__k"]).select("__d", "__i")
    grams = F.concat(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__x") - 2, F.lit(1))), lambda p: F.substring(F.col("__x"), p, 3)), F.split("__x", ""))
    short_hits = d.join(F.broadcast(short.select(F.lit(1).alias("__any")).limit(1))).select("__d", F.explode(F.array_distinct(grams)).alias("__k")).join(short, "__k").select("__d", "__i")
    hits = long_hits.union(short_hits).distinct()
    both = hits.join(d, "__d").join(i.select("__i", "__t"), "__i").where("contains(__x, __t)")
    return both.select(F.col("__d").alias(key), F.col("__i").alias(item_key)).distinct()


def asof_or_first(left: DataFrame, right: DataFrame, on: str, at: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, matched): the last right row at or before each left row, else the group's first one.

    One union and two running windows: no join, so a group is read once; a right row at the same place counts as before.
    """
    both = left.select(on, at, F.col(left_id).alias("__l"), F.lit(None).cast("long").alias("__r"), F.lit(1).alias("__o")).union(right.select(on, at, F.lit(None).cast("long"), F.col(right_id), F.lit(0)))
    order = Window.partitionBy(on).orderBy(at, "__o", "__r")
    last = F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = both.withColumns({"__last": last, "__first": first}).where("__l is not null")
    return x.select(F.col("__l").alias(left_id), F.coalesce("__last", "__first").alias(right_id), F.col("__last").isNotNull().alias("matched"))


def nearest_pairs(a: DataFrame, b: DataFrame, on: str, at: str, key: str, within: int) -> DataFrame:
    """(a_id, b_id, gap) of rows of one group at most within apart that are each other's nearest (ties: smallest id)."""
    x = a.select(on, F.col(at).alias("ta"), F.col(key).alias("a_id"), F.floor(F.col(at) / within).alias("__w"))
    y = b.select(on, F.col(at).alias("tb"), F.col(key).alias("b_id"), F.explode(F.array(*[F.floor(F.col(at) / within) + d for d in (-1, 0, 1)])).alias("__w"))
    z = x.join(y, [on, "__w"]).withColumn("gap", F.abs(F.col("ta") - F.col("tb"))).where(F.col("gap") <= within)
    rank = lambda k, o: F.row_number().over(Window.partitionBy(k).orderBy("gap", o))
    return z.withColumns({"__a": rank("a_id", "b_id"), "__b": rank("b_id", "a_id")}).where("__a = 1 and __b = 1").select("a_id", "b_id", "gap")


def consumed_pairs(rows: DataFrame, on: list[str], at: str, role: str, first: str, within, tie: list | None = None) -> DataFrame:
    """rows with pair (null or the number of the pair in its group) and mate: the row's partner as a struct of rows' columns.

    Rows of a group come in order of at (then tie); each role has one waiting place, which the newest row of the role
    takes; when both are taken at most within apart, they pair and both places are empty. A row that waits while others
    of the other role come too far away for it is too far for all that follow, so a pair is always two rows next to each
    other: of unlike roles, near, the former not paired itself. In a run of such steps every other one pairs, so two
    passes of windows over the sorted group say it all, and no task holds a group.
    """
    order = Window.partitionBy(*on).orderBy(at, *(tie or []))
    is_first = F.col(role) == first
    own = F.struct(*rows.columns)
    x = rows.withColumns({"__before": F.lag(own).over(order), "__k": F.row_number().over(order), "__f": is_first})
    step = (F.lag("__f").over(order) != F.col("__f")) & (F.abs(F.col(at) - F.lag(at).over(order)) <= within)
    x = x.withColumn("__step", F.coalesce(step, F.lit(False)))
    # a run of steps begins behind the last row that is none
    x = x.withColumn("__start", F.max(F.when(~F.col("__step"), F.col("__k"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__pair", F.col("__step") & ((F.col("__k") - F.col("__start")) % 2 == 1))
    x = x.withColumns({"__next": F.lead("__pair").over(order), "__after": F.lead(own).over(order)})
    number = F.sum(F.col("__pair").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    pair = F.when(F.col("__pair"), number).when(F.col("__next"), number + 1)
    mate = F.when(F.col("__pair"), F.col("__before")).when(F.col("__next"), F.col("__after"))
    return x.withColumns({"pair": pair, "mate": mate}).select(*rows.columns, "pair", "mate")


def unique_match(rows: DataFrame, dim: DataFrame, id_col: str, value: str, *stages: list[str]) -> DataFrame:
    """(id_col, value, stage): the first stage (list of key columns) under which exactly one row of dim matches; else null and 0."""
    out = rows
    for i, keys in enumerate(stages, 1):
        one = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias(f"__v{i}")).where("__n = 1").drop("__n")
        out = out.join(one, keys, "left")
    values = [F.col(f"__v{i}") for i in range(1, len(stages) + 1)]
    stage = F.coalesce(*[F.when(v.isNotNull(), i) for i, v in enumerate(values, 1)], F.lit(0))
    return out.select(id_col, F.coalesce(*values).alias(value), stage.alias("stage"))


def ordered_candidates(rows: DataFrame, id_col: str, candidates: Column, known: DataFrame, path: str) -> DataFrame:
    """(id_col, path, place): the first of each row's candidates that is known."""
    x = rows.select(id_col, F.posexplode(candidates).alias("place", path)).join(known.select(path).distinct(), path)
    return x.groupBy(id_col).agg(F.min_by(path, "place").alias(path), F.min("place").alias("place"))


def through_channel(edges: DataFrame) -> DataFrame:
    """(src, dst, channels): producers and consumers of edges (src, chan) and (chan, dst) of a bipartite table (src, chan), minus self pairs."""
    x, y = edges.select("chan", F.col("src").alias("a")).distinct(), edges.select("chan", F.col("src").alias("b")).distinct()
    return x.join(y, "chan").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("channels"))


def dangling(edges: DataFrame, columns: dict[str, str], nodes: DataFrame, key: str) -> DataFrame:
    """Edges of which a column has no node, and which: (edge columns, missing)."""
    out = None
    for column in columns:
        x = edges.join(nodes.select(F.col(key).alias(column)), column, "left_anti").select(*edges.columns).withColumn("missing", F.lit(columns[column]))
        out = x if out is None else out.union(x)
    return out


def one_hop(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(v): neighbours in either direction of the vertices inside (v), without those."""
    out = edges.join(inside.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("dst").alias("v"))
    back = edges.join(inside.select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v"))
    return out.union(back).distinct().join(inside, "v", "left_anti")
