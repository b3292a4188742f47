"""Redaction, inventories, traces, impact, subsumption and rendering bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions.redaction import redacted
from quarrygraph.operators import graphs, joins
from quarrygraph.plans.flagship import PAIR_SQL, TRADE_SQL, pair_rollup, trade_edges
from quarrygraph.plans.registry import query
from quarrygraph.plans.relational import _HIERARCHY, events, hierarchy
from quarrygraph.sources import inventory as I
from quarrygraph.sources.tables import Tables


@query(f"WITH k AS (SELECT a, kind, count(*) AS n FROM ({TRADE_SQL}) GROUP BY ALL) SELECT a, kind, n FROM k QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, kind) = 1")
def dominant_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent kind of each nation's edges; ties go to the smallest."""
    k = trade_edges(Tables(spark, sf_dir)).groupBy("a", "kind").agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("a").agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("kind"), F.max("n").alias("n"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE sha256(text) END AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("""WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list_sort(list_distinct(list(event_type))) AS t FROM events GROUP BY 1, 2)
SELECT a.user_id, a.day AS day_a, b.day AS day_b, list_has_all(b.t, a.t) AS a_in_b, list_has_all(a.t, b.t) AS b_in_a
FROM s a JOIN s b ON a.user_id = b.user_id AND CAST(b.day AS DATE) = CAST(a.day AS DATE) + 1""")
def subsumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the event types of a user's day are all among the next day's, and the other way round."""
    s = events(spark, sf_dir).groupBy("user_id", "day").agg(F.collect_set("event_type").alias("t"))
    b = s.select("user_id", F.col("day").alias("day_b"), F.date_format(F.date_sub("day", 1), "yyyy-MM-dd").alias("day"), F.col("t").alias("u"))
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    return s.join(b, ["user_id", "day"]).select("user_id", F.col("day").alias("day_a"), "day_b", within("t", "u").alias("a_in_b"), within("u", "t").alias("b_in_a"))


@query(f"""WITH e AS ({_HIERARCHY}), d AS (SELECT DISTINCT 'c' || o_custkey AS v FROM orders WHERE o_orderpriority = '1-URGENT'),
n AS (SELECT b AS v FROM e WHERE a IN (FROM d) UNION SELECT a FROM e WHERE b IN (FROM d))
SELECT v, 'direct' AS impact FROM d UNION ALL SELECT v, 'near' FROM n WHERE v NOT IN (FROM d)""")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with urgent orders, and what is one edge away from them."""
    urgent = Tables(spark, sf_dir).orders.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), "o_custkey").alias("v")).distinct()
    near = joins.one_hop(hierarchy(spark, sf_dir), urgent)
    return urgent.withColumn("impact", F.lit("direct")).union(near.withColumn("impact", F.lit("near")))


@query(f"""SELECT a AS view, string_agg('  ' || replace(a, ' ', '_') || ' -->|' || dominant || ' ' || weight || '| ' || replace(b, ' ', '_'), chr(10) ORDER BY weight DESC, b) AS text, count(*) AS edges
FROM ({PAIR_SQL}) GROUP BY a""")
def render_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flowchart's lines for each nation, heaviest edges first; a nation has at most as many as there are nations."""
    mark = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    line = F.concat(F.lit("  "), mark("a"), F.lit(" -->|"), "dominant", F.lit(" "), F.col("weight").cast("string"), F.lit("| "), mark("b"))
    row = F.struct((-F.col("weight")).alias("w"), "b", line.alias("line"))
    x = pair_rollup(spark, sf_dir).groupBy("a").agg(F.array_sort(F.collect_list(row)).alias("l"), F.count(F.lit(1)).alias("edges"))
    return x.select(F.col("a").alias("view"), F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("text"), "edges")


@query(f"""WITH e AS ({_HIERARCHY}), t AS (SELECT 'r' || r_regionkey AS root, 0 AS level, 'r' || r_regionkey AS v, -1 AS p FROM region),
n AS (SELECT a AS root, 1 AS level, b AS v, row_number() OVER (PARTITION BY a ORDER BY b) AS p FROM e WHERE a LIKE 'r%'),
c AS (SELECT n.root, 2 AS level, e.b AS v, row_number() OVER (PARTITION BY n.root ORDER BY n.p, e.b) AS p FROM n JOIN e ON n.v = e.a),
u AS (SELECT * FROM t UNION ALL SELECT * FROM n UNION ALL SELECT * FROM c)
SELECT root, v, level, row_number() OVER (PARTITION BY root ORDER BY level, p) - 1 AS place FROM u QUALIFY place < 25""")
def bfs_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 nodes of a breadth-first trace from each region: the cap is the operator's feature."""
    t = Tables(spark, sf_dir)
    roots = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("v"))
    nodes, _ = graphs.bounded_trace(hierarchy(spark, sf_dir).select("src", "dst", F.lit("has").alias("kind"), F.lit(0).alias("at")), roots, 6, 25)
    return nodes.select("root", "v", "level", "place")


@query()
def redact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after all steps of redaction, and what was found."""
    x = Tables(spark, sf_dir).documents.select("doc_id", redacted(F.coalesce("text", F.lit(""))).alias("r"))
    return x.select("doc_id", F.sha2("r.clean", 256).alias("clean_sha256"), F.array_join("r.categories", ",").alias("categories"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '[^/]\.([^./]+)$', 1)) AS ext, regexp_matches(url, '(^|/)(test|tests|__tests__|spec)/') AS test FROM pages""")
def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).pages
    return p.select("page_id", I.extension(F.col("url")).alias("ext"), I.is_test(F.col("url")).alias("test"))
