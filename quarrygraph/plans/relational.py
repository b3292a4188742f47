"""Joins, aggregates, windows, sets, snapshots and rules bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import text as T
from quarrygraph.operators import aggregates as A
from quarrygraph.operators import budgets, graphs, joins, rules, snapshots
from quarrygraph.plans.flagship import TRADE_SQL, trade_edges
from quarrygraph.plans.registry import query
from quarrygraph.sources.tables import Tables

MICROS = "unix_micros(cast(ts as timestamp))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.withColumn("us", F.expr(MICROS)).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


@query("""
WITH e AS (SELECT * FROM (""" + TRADE_SQL + """) WHERE a <> b), s AS (SELECT DISTINCT a, b FROM e WHERE kind <> 'R'),
w AS (SELECT DISTINCT a, b FROM e WHERE kind = 'R'),
l AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE (s.a = w.a AND s.b = w.b) OR (s.a = w.b AND s.b = w.a)))
SELECT a, b, false AS weak FROM s UNION ALL
SELECT a, b, true FROM l WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.a = l.b AND m.b = l.a) OR a < b""")
def import_fallback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.quotient_fallback(trade_edges(Tables(spark, sf_dir)), "R")


@query("""SELECT l_suppkey, coalesce(min_by(l_returnflag, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END), 'unknown') AS strongest,
coalesce(max_by(l_returnflag, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END), 'unknown') AS weakest FROM lineitem GROUP BY 1""")
def strongest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.strongest(Tables(spark, sf_dir).lineitem, "l_suppkey", "l_returnflag", {"R": 0, "A": 1})


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_min(event_type, (ts, event_id)) AS event_type,
arg_max(props, (ts, event_id)) AS props, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(*) AS writes
FROM events GROUP BY 1, 2""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = events(spark, sf_dir).withColumn("types", F.col("event_type"))
    return A.keyed_upsert(x, ["user_id", "day"], ["ts", "event_id"], ["event_type"], ["props"], ["types"])


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
d AS (SELECT 's' || s AS v FROM e UNION ALL SELECT 'p' || p FROM e)
SELECT v, count(*) AS degree FROM d GROUP BY v""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    return A.degrees(e)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
d AS (SELECT 's' || s AS v FROM e UNION ALL SELECT 'p' || p FROM e)
SELECT v, count(*) AS degree FROM d GROUP BY v ORDER BY degree DESC, v LIMIT 15""")
def degree_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 hubs: a top-k report."""
    return degrees(spark, sf_dir).orderBy(F.desc("degree"), "v").limit(15)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicates(Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, o_custkey, 'customer' AS missing FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return joins.dangling(t.orders.select("o_orderkey", "o_custkey"), {"o_custkey": "customer"}, t.customer.where("c_mktsegment <> 'BUILDING'"), "c_custkey")


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query("""WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS parts FROM pages),
a AS (SELECT page_id, array_to_string(parts[1:n], '/') AS prefix FROM p, generate_series(1, len(parts)) AS g(n)),
d AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS prefix FROM pages UNION
      SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*/[^/?#]+)', 1) FROM pages WHERE page_id % 2 = 0)
SELECT page_id, max_by(prefix, len(prefix)) AS area FROM a JOIN d USING (prefix) WHERE prefix <> '' GROUP BY 1""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the longest known prefix of host and path; half of the pages make two-segment prefixes known."""
    p = Tables(spark, sf_dir).pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://([^/?#]*/[^/?#]+)", 1).alias("two"))
    known = p.select(F.col("host").alias("prefix")).union(p.where("page_id % 2 = 0").select("two")).distinct().where("prefix <> ''").withColumn("area", F.col("prefix"))
    return joins.longest_prefix(p, "page_id", "path", known, "prefix", "area")


@query("""SELECT e.event_id, max_by(s.event_id, (s.ts, -s.event_id)) AS span_id, count(*) AS depth FROM events e JOIN events s
ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 DAY GROUP BY 1""")
def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "us")
    s = e.select("user_id", F.col("event_id").alias("span_id"), F.col("us").alias("s"), (F.col("us") + 86_400_000_000).alias("e"))
    return joins.innermost_span(e, "event_id", "us", s, "span_id", "s", "e", "user_id", width=86_400_000_000)


@query("""WITH v AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT p.event_id AS purchase_id, coalesce((SELECT max_by(event_id, (ts, event_id)) FROM v WHERE v.user_id = p.user_id AND v.ts <= p.ts),
 (SELECT min_by(event_id, (ts, event_id)) FROM v WHERE v.user_id = p.user_id)) AS view_id,
 EXISTS (SELECT 1 FROM v WHERE v.user_id = p.user_id AND v.ts <= p.ts) AS matched FROM p""")
def asof_prior_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    p, v = (e.where(F.col("event_type") == k).select("user_id", "us", F.col("event_id").alias(n)) for k, n in (("purchase", "purchase_id"), ("view", "view_id")))
    return joins.asof_or_first(p, v, "user_id", "us", "purchase_id", "view_id")


@query("""WITH z AS (SELECT v.event_id AS a_id, c.event_id AS b_id, abs(epoch_us(v.ts) - epoch_us(c.ts)) AS gap FROM events v JOIN events c USING (user_id)
WHERE v.event_type = 'view' AND c.event_type = 'click' AND abs(epoch_us(v.ts) - epoch_us(c.ts)) <= 900000000),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY gap, b_id) AS x, row_number() OVER (PARTITION BY b_id ORDER BY gap, a_id) AS y FROM z)
SELECT a_id, b_id, gap FROM r WHERE x = 1 AND y = 1""")
def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return joins.nearest_pairs(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "us", "event_id", 900_000_000)


@query("""WITH b AS (SELECT p_name, p_brand, min(p_partkey) AS k FROM part GROUP BY ALL HAVING count(*) = 1),
t AS (SELECT p_name, p_type, min(p_partkey) AS k FROM part GROUP BY ALL HAVING count(*) = 1)
SELECT p.p_partkey AS id, coalesce(b.k, t.k) AS hit, CASE WHEN b.k IS NOT NULL THEN 1 WHEN t.k IS NOT NULL THEN 2 ELSE 0 END AS stage
FROM part p LEFT JOIN b USING (p_name, p_brand) LEFT JOIN t ON p.p_name = t.p_name AND p.p_type = t.p_type""")
def unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).part
    return joins.unique_match(p.withColumn("id", F.col("p_partkey")), p.withColumn("hit", F.col("p_partkey")), "id", "hit", ["p_name", "p_brand"], ["p_name", "p_type"])


@query("""WITH e AS (SELECT DISTINCT c_nationkey AS src, l_partkey AS chan FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT x.src AS a, y.src AS b, count(*) AS channels FROM e x JOIN e y USING (chan) WHERE x.src <> y.src GROUP BY 1, 2""")
def channel_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that bought the same parts; a part is a channel, and at most 25 nations meet in one."""
    t = Tables(spark, sf_dir)
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joins.through_channel(x.select(F.col("c_nationkey").alias("src"), F.col("l_partkey").alias("chan")))


_BOUGHT = "SELECT DISTINCT 'c' || o_custkey AS a, 'p' || l_partkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def bought_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts that they bought, from all line items."""
    t = Tables(spark, sf_dir)
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def _least_label_sql(rounds: int) -> str:
    """Components by the smallest label of the neighbours, round by round: as many rounds as the graph's diameter suffice."""
    steps = [f"l{i} AS (SELECT u.a AS v, min(l.c) AS c FROM u JOIN l{i - 1} l ON u.b = l.v GROUP BY 1)" for i in range(1, rounds + 1)]
    return f"WITH e AS ({_BOUGHT}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e), l0 AS (SELECT DISTINCT a AS v, a AS c FROM u), {', '.join(steps)} SELECT v, c AS component FROM l{rounds}"


@query(_least_label_sql(12))
def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.weak_components(bought_edges(spark, sf_dir))


_FUNCTIONAL = f"""SELECT a, min_by(b, (-n, b)) AS b FROM (SELECT a, b, count(*) AS n FROM ({TRADE_SQL}) WHERE a <> b GROUP BY ALL) GROUP BY a"""


@query(f"""WITH RECURSIVE e AS ({_FUNCTIONAL}), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT x.a AS v, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trade_edges(Tables(spark, sf_dir)).where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return graphs.strong_components(graphs.functional_graph(e))


_HIERARCHY = "SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    e = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return e(t.nation, "r", "n_regionkey", "n", "n_nationkey").union(e(t.customer, "n", "c_nationkey", "c", "c_custkey"))


@query(f"""WITH RECURSIVE e AS ({_HIERARCHY}), r AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS v, 0 AS level FROM region
UNION ALL SELECT r.root, e.b, r.level + 1 FROM r JOIN e ON r.v = e.a WHERE r.level < 6) SELECT root, v, min(level) AS level FROM r GROUP BY 1, 2""")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = Tables(spark, sf_dir).region.select(F.concat(F.lit("r"), "r_regionkey").alias("v"))
    return graphs.bounded_levels(hierarchy(spark, sf_dir), roots, 6)


@query(f"""WITH RECURSIVE e AS ({_HIERARCHY}), f AS (SELECT a, b FROM e UNION SELECT 'n0', a FROM e WHERE b = 'n0'),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), q AS (SELECT a, b FROM f UNION SELECT q.a, f.b FROM q JOIN f ON q.b = f.a)
SELECT NOT EXISTS (SELECT 1 FROM r WHERE a = b) AS hierarchy, NOT EXISTS (SELECT 1 FROM q WHERE a = b) AS with_cycle""")
def dag_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = hierarchy(spark, sf_dir)
    back = e.where("dst = 'n0'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return spark.createDataFrame([(graphs.is_acyclic(e), graphs.is_acyclic(e.union(back)))], "hierarchy boolean, with_cycle boolean")


@query()
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.label_communities(bought_edges(spark, sf_dir))


@query()
def first_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = graphs.weak_components(bought_edges(spark, sf_dir)).groupBy(F.col("component").alias("grp")).agg(F.count(F.lit(1)).alias("members"))
    return graphs.first_fit(sizes, 20)


@query(f"""WITH e AS ({_BOUGHT}), i AS (SELECT min(a) AS v FROM e),
n AS (SELECT b AS v FROM e WHERE a IN (FROM i) UNION SELECT a FROM e WHERE b IN (FROM i)) SELECT v FROM n WHERE v NOT IN (FROM i)""")
def onehop_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bought_edges(spark, sf_dir)
    return joins.one_hop(e, e.agg(F.min("src").alias("v")))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(event_type) AS event_type FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 1")
def single_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.single_owner(events(spark, sf_dir), ["user_id", "day"], "event_type")


@query("""SELECT lang, count(*) AS total, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*), 6) AS ratio
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    x = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.lit(1).alias("l")).distinct(), "doc_id", "left")
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count("l").alias("labelled"), F.round(F.count("l") / F.count(F.lit(1)), 6).alias("ratio"))


@query("""WITH c AS (SELECT event_id, ts, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND CURRENT ROW) AS used FROM events)
SELECT event_id, used, CASE WHEN used > 25 THEN 'deny' ELSE 'allow' END AS decision FROM c""")
def rolling_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One global log: hours are blocks, so each task counts an hour with what leaves from the hour before it, and no task orders the whole log."""
    x = budgets.rolling_counts(events(spark, sf_dir).select("event_id", "us"), "us", 3600)
    return x.select("event_id", "used", F.when(F.col("used") > 25, "deny").otherwise("allow").alias("decision"))


@query("""SELECT o_orderkey, slot, slot < 100 AS kept FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1 AS slot FROM orders)""")
def slots_and_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.capped(Tables(spark, sf_dir).orders, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 100).select("o_orderkey", F.col("slot").cast("long").alias("slot"), "kept")


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
s AS (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS n FROM i)
SELECT event_id, CAST(n AS BIGINT) AS streak, CASE WHEN n > 0 THEN least(900.0, 30 * pow(2.0, n - 1)) ELSE 0.0 END::DOUBLE AS backoff FROM s""")
def streak_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets.streaks(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "streak", "backoff")


@query("""WITH s AS (SELECT user_id, day, list_sort(list(DISTINCT event_type)) AS t FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY ALL)
SELECT a.user_id, a.day AS day_a, b.day AS day_b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
FROM s a JOIN s b ON a.user_id = b.user_id AND CAST(b.day AS DATE) = CAST(a.day AS DATE) + 1""")
def jaccard_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user's days beside those of the next day."""
    s = events(spark, sf_dir).groupBy("user_id", "day").agg(F.collect_set("event_type").alias("t"))
    b = s.select("user_id", F.col("day").alias("day_b"), F.date_format(F.date_sub("day", 1), "yyyy-MM-dd").alias("day"), F.col("t").alias("u"))
    x = s.join(b, ["user_id", "day"])
    return x.select("user_id", F.col("day").alias("day_a"), "day_b", F.round(F.size(F.array_intersect("t", "u")) / F.size(F.array_union("t", "u")), 6).alias("jaccard"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 2) b
USING (doc_id) WHERE a.text IS DISTINCT FROM b.text""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of one table: remainders of doc_id say which rows are new, gone and changed."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    new = d.where("doc_id % 10 <> 2").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return snapshots.changes(d.where("doc_id % 10 <> 1"), new, "doc_id", F.col("text"))


_STATES = "pending generated placed verified obsolete".split()


@query(f"""WITH p AS (SELECT p_partkey AS id, p_brand AS hash FROM part WHERE p_partkey % 7 <> 1),
s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE p_brand END AS hash, {_STATES}[p_partkey % 5 + 1] AS status FROM part WHERE p_partkey % 11 <> 1)
SELECT coalesce(p.id, s.id) AS id, CASE WHEN s.hash IS NULL THEN 'pending' WHEN p.hash IS NULL THEN 'obsolete'
WHEN p.hash = s.hash THEN CASE status WHEN 'obsolete' THEN 'placed' ELSE status END
WHEN status IN ('placed', 'verified', 'obsolete') THEN 'stale' WHEN status = 'generated' THEN 'deferred' ELSE 'pending' END AS status FROM p FULL JOIN s USING (id)""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("hash"))
    status = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("id") % 5 + 1).cast("int"))
    s = p.where("id % 11 <> 1").select("id", F.when(F.col("id") % 3 == 0, "other").otherwise(F.col("hash")).alias("hash"), status.alias("status"))
    return snapshots.reconcile(p.where("id % 7 <> 1"), s)


@query("""SELECT 'error' AS severity, 'unique line' AS rule, CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber AS entity FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'error', 'customer exists', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'warning', 'balance not negative', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'error', 'known flag', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')""")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rules.check(
        rules.rule("error", "unique line", A.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"]), F.concat_ws(":", "l_orderkey", "l_linenumber")),
        rules.rule("error", "customer exists", joins.dangling(t.orders.select("o_orderkey", "o_custkey"), {"o_custkey": "customer"}, t.customer, "c_custkey"), F.col("o_orderkey")),
        rules.rule("warning", "balance not negative", t.customer.where("c_acctbal < 0"), F.col("c_custkey")),
        rules.rule("error", "known flag", t.lineitem.where("l_returnflag not in ('A', 'R')"), F.col("l_orderkey")),
    )


@query(r"""SELECT n_nationkey, CASE WHEN s = '' THEN 'x' ELSE s END AS slug, sha256(n_name) AS digest FROM
(SELECT *, regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM nation)""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).nation.select("n_nationkey", T.slug(F.col("n_name")).alias("slug"), F.sha2("n_name", 256).alias("digest"))


_HOLES = ["/users/{id}", "/u/<int:n>/x//y/", "/v/:name?q=1", "/w/${key}"]
_PATH_SQL = "regexp_replace(url, '^[a-z]+://[^/?#]*', '') || CASE page_id % 4 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HOLES)) + " END"


@query(rf"""SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS route FROM (SELECT page_id, regexp_replace(regexp_replace('/' ||
regexp_replace(regexp_replace({_PATH_SQL}, '\?.*$', ''), '\{{[^}}]*\}}|<[^>]*>|:\w+|\$\{{[^}}]*\}}', '{{}}', 'g'), '/+', '/', 'g'), '/$', '') AS p FROM pages)""")
def route_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all pages, each with a placeholder of one of four forms behind it."""
    path = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
    hole = F.element_at(F.array(*map(F.lit, _HOLES)), (F.col("page_id") % 4 + 1).cast("int"))
    return Tables(spark, sf_dir).pages.select("page_id", T.route(F.concat(path, hole)).alias("route"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<!--[^>]*-->', ' ', 'g'), '</?[a-zA-Z][^>]*>|<![^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS plain FROM pages""")
def html_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).pages.select("page_id", T.plain(F.col("html")).alias("plain"))


@query(f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{T.EMAIL}', '[email]', 'g'), '{T.HEX}', '[hex]', 'g'), '{T.PRIVATE_IP}', '[ip]', 'g')) AS redacted,
len(regexp_extract_all(text, '{T.EMAIL}')) AS emails, len(regexp_extract_all(text, '{T.HEX}')) AS hexes FROM documents""")
def redact_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    y = T.redact(T.redact(T.redact(x, T.EMAIL, "email"), T.HEX, "hex"), T.PRIVATE_IP, "ip")
    return Tables(spark, sf_dir).documents.select("doc_id", F.sha2(y, 256).alias("redacted"), F.regexp_count(x, F.lit(T.EMAIL)).cast("long").alias("emails"), F.regexp_count(x, F.lit(T.HEX)).cast("long").alias("hexes"))


@query("""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark), n AS (SELECT item_id, c, count(*) AS k FROM c GROUP BY ALL),
t AS (SELECT item_id, sum(k) AS n FROM n GROUP BY 1) SELECT item_id, round(-sum(k / n * log2(k / n)), 6) AS entropy FROM n JOIN t USING (item_id) GROUP BY 1""")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).benchmark.select("item_id", F.round(T.entropy(F.col("text")), 6).alias("entropy"))


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> ''")
def evidence_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages cited in documents."""
    t = Tables(spark, sf_dir)
    return joins.contained(t.documents, "doc_id", "text", t.benchmark.withColumnRenamed("text", "item"), "item_id", "item")


@query("""WITH n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
t AS (SELECT DISTINCT role AS a, nxt AS b FROM n WHERE nxt IS NOT NULL), s AS (SELECT a AS v FROM t UNION SELECT b FROM t)
SELECT v AS role, v NOT IN (SELECT a FROM t) AS final, (SELECT count(*) FROM n WHERE role = v AND nxt IS NOT NULL) AS transitions FROM s""")
def role_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and transitions of all turns; a state that nothing follows is final."""
    from pyspark.sql import Window

    n = Tables(spark, sf_dir).conversations.withColumn("nxt", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt is not null")
    counts = n.groupBy("role", "nxt").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.select(F.explode(F.array(F.struct("role", "n"), F.struct(F.col("nxt").alias("role"), F.lit(0).cast("long").alias("n")))).alias("s")).select("s.*")
    return ends.groupBy("role").agg((F.sum("n") == 0).alias("final"), F.sum("n").alias("transitions"))


@query("""SELECT conv_id, string_agg(role || '->' || length(text), '\n' ORDER BY turn) AS messages, count(*) AS n FROM conversations GROUP BY conv_id""")
def sequence_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("turn", F.concat("role", F.lit("->"), F.length("text").cast("string")).alias("m"))
    x = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("l"), F.count(F.lit(1)).alias("n"))
    return x.select("conv_id", F.array_join(F.transform("l", lambda r: r["m"]), "\n").alias("messages"), "n")


@query("""SELECT doc_id, CAST(count(*) FILTER (contains(line, chr(96))) AS BIGINT) AS backticks, CAST(count(*) FILTER (contains(line, '"')) AS BIGINT) AS quotes,
CAST(count(*) FILTER (regexp_matches(line, '<[a-zA-Z/]')) AS BIGINT) AS html, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def lint_universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Tables(spark, sf_dir).documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hit = lambda cond, name: F.count_if(cond).alias(name)
    return x.groupBy("doc_id").agg(hit(F.col("line").contains("`"), "backticks"), hit(F.col("line").contains('"'), "quotes"), hit(F.col("line").rlike("<[a-zA-Z/]"), "html"), F.count(F.lit(1)).alias("lines"))


_MESSAGES = ["Rate limit hit, retry after 30 seconds", "HTTP 401 unauthorized", "file not found", "connection timed out, try again in 500 ms", "Internal Server Error 503", "order 14290 ok", "too many requests: Retry-After: 2 minutes", "parse error near line 400", "no such tool", "quota of 12 files", "HTTP 404", "retry-after=7"]


def _first_class_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN '{k}'" for k, p in T.ERRORS.items()) + " ELSE 'unknown' END"


def _wait_sql(x: str) -> str:
    p = [w.replace("'", "''") for w in T.WAITS]
    n = [f"TRY_CAST(nullif(regexp_extract(lower({x}), '{w}', 1), '') AS DOUBLE)" for w in p]
    u = [f"regexp_extract(lower({x}), '{w}', 2)" for w in p]
    each = [f"CASE WHEN regexp_matches({b}, '^(ms|milli)') THEN {a} / 1000 WHEN starts_with({b}, 'm') THEN {a} * 60 ELSE {a} END" for a, b in zip(n, u, strict=True)]
    return f"coalesce({', '.join(each)})"


_SAID = "list_extract([" + ", ".join("'" + m + "'" for m in _MESSAGES) + f"], CAST(event_id % {len(_MESSAGES)} AS INTEGER) + 1) || ' ' || event_type || ' ' || user_id"


@query(f"SELECT event_id, {_first_class_sql('m')} AS error_class, {_wait_sql('m')} AS wait FROM (SELECT event_id, {_SAID} AS m FROM events)")
def classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for every event, of one of twelve kinds, with what the event says behind it."""
    kind = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    x = Tables(spark, sf_dir).events.select("event_id", F.concat_ws(" ", kind, "event_type", F.col("user_id").cast("string")).alias("m"))
    return x.select("event_id", T.error_class(F.col("m")).alias("error_class"), T.retry_after(F.col("m")).alias("wait"))
