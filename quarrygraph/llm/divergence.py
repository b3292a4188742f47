"""Operator 11: how far the sources of a language diverge in their terms, by inclusion and exclusion over supports.

A term's smoothed share in a group is a function of its count, so the distance of two groups of one language falls into
terms that only one of them has, terms of both, and terms of neither. Terms of one side are priced from that group's
histogram of counts alone, by running sums over it at the other groups' price of nothing. Terms of both were priced
twice that way: posting lists joined by term give the correction. Terms of neither are a constant times their number.
So no group is ever spread over the vocabulary, and no pair of groups over terms that it doesn't share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import LOWERED, bounded_batches, byte_values, chunks, cut, mix, prefix_hash, runs, span_hash, strings, table

#: Documents of its language that a kept term is in, occurrences added to each count, what shares are multiplied with, terms named for a group.
LEAST, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
_INSIDE = np.ones(256, bool)
for _a, _b in ((0x00, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
    _INSIDE[_a:_b] = False


def _counted(batches):
    """Terms of each group of a chunk: occurrences, documents."""
    for batch, data, offs in chunks(batches):
        low = LOWERED[data]
        s, e = runs(_INSIDE[low], offs)
        if not len(s):
            continue
        doc = np.searchsorted(offs, s, "right") - 1
        sides = [batch.column(i).dictionary_encode() for i in (1, 2)]
        code = [x.indices.to_numpy().astype(np.int64) for x in sides]
        group = code[0] * len(sides[1].dictionary) + code[1]
        key = mix(span_hash(prefix_hash(byte_values(low)), s, e) ^ mix(group.astype(np.uint64) + np.uint64(1))[doc])
        order = np.argsort(key)
        held = key[order]
        first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        n = np.diff(np.append(first, len(key)))
        rank = np.repeat(np.arange(len(first)), n)
        pair = np.sort(rank * len(offs) + doc[order])  # documents of each term
        new = pair[np.append(True, pair[1:] != pair[:-1])] // len(offs)
        at = order[first]
        d = doc[at]
        names = [x.dictionary.take(pa.array(c[d])) for x, c in zip(sides, code, strict=True)]
        yield pa.RecordBatch.from_arrays([*names, strings(low, s[at], e[at]), pa.array(n), pa.array(np.bincount(new, minlength=len(first)))], names=["lang", "source", "term", "n", "df"])


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), in whole numbers of up to 38 digits."""
    return F.expr(f"1 + cast({SCALE} as decimal(10, 0)) * cast({n} + {PRIOR} as decimal(20, 0)) div cast({total} + {PRIOR} * {terms} as decimal(20, 0))")


def group_terms(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(groups, postings): groups (lang, source, terms, total, z, held) with the language's number of kept terms, the
    group's occurrences of these, the share of a term that it doesn't have and how many it has; postings (lang, term,
    source, n, p, z, q) of each kept term that occurs in a group, q its share in the language."""
    bounded_batches(docs.sparkSession)
    x = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = x.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    counts = cut(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df")
    kept = cut(kept, "divergence-kept")
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("of_lang").alias("lang_total"))
    hits = cut(counts.join(kept, ["lang", "term"]).select("lang", "term", "source", "n", "of_lang"), "divergence-hits")
    sums = hits.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = x.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).join(sums, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.fillna(0, ["total", "held", "terms", "lang_total"])
    groups = groups.withColumn("z", F.when(F.col("terms") > 0, share("0L", "total", "terms")).otherwise(F.lit(0)))
    groups = cut(groups, "divergence-groups")
    postings = hits.join(groups, ["lang", "source"])
    postings = postings.select("lang", "term", "source", "n", share("n", "total", "terms").alias("p"), "z", share("of_lang", "lang_total", "terms").alias("q"))
    return groups, cut(postings, "divergence-postings")


def _one_sided(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, other, price): sum over the source's terms of the distance of its share from the other's share of a term that it doesn't have."""
    histogram = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    histogram = histogram.select("lang", "source", F.lit(None).cast("string").alias("other"), F.col("p").alias("at"), "m")
    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("at"))
    asked = groups.select("lang", "source").join(other, "lang").where("source <> other").select("lang", "source", "other", "at", F.lit(0).cast("long").alias("m"))
    whole = Window.partitionBy("lang", "source")
    below = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s = {"mb": F.sum("m").over(below), "pb": F.sum(F.col("m") * F.col("at")).over(below), "ma": F.sum("m").over(whole), "pa": F.sum(F.col("m") * F.col("at")).over(whole)}
    x = histogram.union(asked).withColumns(s).where("other is not null")
    # shares up to the asked one lie below it, the others above
    return x.select("lang", "source", "other", F.expr("at * mb - pb + (pa - pb) - at * (ma - mb)").alias("price"))


def distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, other, value) of each ordered pair of a language's sources: the sum of the distances of their shares over all kept terms."""
    side = lambda c: postings.select("lang", "term", F.col("source").alias(c), F.col("p").alias("p" + c), F.col("z").alias("z" + c))
    fix = F.expr("abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb)")
    both = side("a").join(side("b"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(fix).alias("price"))
    one = _one_sided(groups, postings).select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), "price")
    summed = one.union(both).groupBy("lang", "a", "b").agg(F.sum("price").alias("price"))
    of = lambda c: groups.select("lang", F.col("source").alias(c), F.col("held").alias("h" + c), F.col("z").alias("z" + c), "terms")
    x = summed.join(of("a"), ["lang", "a"]).join(of("b").drop("terms"), ["lang", "b"])
    x = x.select("lang", "a", "b", F.expr("price + (terms - ha - hb) * abs(za - zb)").alias("value"))
    x = cut(x, "divergence-pairs")
    return x.select("lang", F.col("a").alias("source"), F.col("b").alias("other"), "value").union(x.select("lang", "b", "a", "value"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    pair: each other source of the language with its distance from the source, all ranks. term: the kept terms that the
    source has a larger share of than its language has, the top ranks. Ranks go by value, largest first, then by item
    in UTF-8 order. Null text, lang or source is ''. A group without terms has only its prior; where a language keeps no
    term, distances are 0. A language of one source has no pairs; an empty table gives no rows. Equal texts and repeated
    rows count each. Other columns are not read. All figures are whole numbers.
    """
    groups, postings = group_terms(docs, least)
    pair = distances(groups, postings).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    term = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pair.withColumn("rank", F.row_number().over(order)).union(term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(t) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(df) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
full_counts AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS ln, l.v, l.n AS lt FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p, 1 + (1000000000::HUGEINT * (ln + 5)) // (lt + 5 * v) AS q FROM full_counts),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""
