"""Evidence, labels, fitting, runs, code facts and trees bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import names as N
from quarrygraph.operators import evidence as E
from quarrygraph.operators import runs, views
from quarrygraph.plans.flagship import TRADE_SQL, trade_edges
from quarrygraph.plans.registry import query
from quarrygraph.sources import trees
from quarrygraph.sources.tables import Tables


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, count(*) AS m FROM l GROUP BY 1), d AS (SELECT doc_id, text, 1 + doc_id % 3 AS s, 1 + doc_id % 3 + doc_id % 2 AS e, CASE WHEN doc_id % 4 = 0 THEN 'zzqx' ELSE 'e' END AS sym FROM documents),
h AS (SELECT DISTINCT d.doc_id FROM d JOIN l USING (doc_id) WHERE l.n BETWEEN d.s - 3 AND d.e + 3 AND contains(l.t, d.sym))
SELECT d.doc_id AS id, CASE WHEN d.doc_id % 7 = 0 THEN 'not in inventory' WHEN d.text IS NULL THEN 'not readable' WHEN d.e > c.m THEN 'lines out of range' WHEN h.doc_id IS NULL THEN 'symbol not found' END AS reason,
d.s AS line_start, d.e AS line_end FROM d LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id)""")
def admit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cites lines of itself for a symbol; a seventh is not in the inventory."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", F.col("doc_id").cast("string").alias("path"))
    start = F.col("doc_id") % 3 + 1
    cited = d.select(F.col("doc_id").alias("id"), F.col("path").alias("file"), F.concat(start.cast("string"), F.lit("-"), (start + F.col("doc_id") % 2).cast("string")).alias("lines"), F.when(F.col("doc_id") % 4 == 0, "zzqx").otherwise("e").alias("symbol"), F.lit("confirmed").alias("status"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("kind"))
    lines = d.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line_no"), "text")
    return E.admit(cited, d.where("doc_id % 7 <> 0"), lines).select("id", "reason", "line_start", "line_end")


@query("SELECT doc_id, 'ev:' || substr(sha1(concat_ws('|', coalesce(source, ''), 'None', coalesce(CAST(n_chars AS VARCHAR), 'None'), coalesce(lang, ''), 'doc', '')), 1, 12) AS evidence_id FROM documents")
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda c: F.coalesce(c, F.lit(""))
    return Tables(spark, sf_dir).documents.select("doc_id", E.evidence_id(none("source"), F.lit(None), F.col("n_chars"), none("lang"), F.lit("doc"), F.lit("")).alias("evidence_id"))


def _label_sql(rounds: int) -> str:
    n = "SELECT p_partkey, p_brand AS grp, string_split(p_type || '/' || replace(p_name, ' ', '/'), '/') AS w, 1 AS n FROM part"
    label = "array_to_string(w[greatest(len(w) - n + 1, 1):], '/')"
    for _ in range(rounds - 1):
        n = f"SELECT p_partkey, grp, w, CASE WHEN count(*) OVER (PARTITION BY grp, label) > 1 THEN n + 1 ELSE n END AS n FROM (SELECT *, {label} AS label FROM ({n}))"
    return f"SELECT grp, p_partkey, {label} AS label FROM ({n})"


@query(_label_sql(8))
def unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand by the shortest suffix of type and name that tells them apart."""
    p = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("grp"), "p_partkey", F.concat("p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/"))).alias("path"))
    return views.suffix_labels(p, "grp", "p_partkey", "path")


_FIT_EDGES = f"SELECT kind AS view, a AS src, b AS dst, count(*) AS weight, count(*) < 3 AS weak FROM ({TRADE_SQL}) WHERE a <> b GROUP BY ALL"
_FIT_SQL = f"""WITH e AS ({_FIT_EDGES}), d AS (SELECT view, id, count(*) AS deg FROM (SELECT view, src AS id FROM e UNION ALL SELECT view, dst FROM e) GROUP BY ALL),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY view ORDER BY deg DESC, id) <= 10),
i AS (SELECT e.* FROM e JOIN u s ON e.view = s.view AND e.src = s.id JOIN u t ON e.view = t.view AND e.dst = t.id)
SELECT view, src, dst, weight FROM i QUALIFY row_number() OVER (PARTITION BY view ORDER BY weak, weight DESC, src DESC, dst DESC) <= 30"""


@query(_FIT_SQL)
def readability_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations, a view for each kind, within 10 units and 30 edges: the limits are the operator's feature."""
    t = trade_edges(Tables(spark, sf_dir)).where("a <> b")
    e = t.groupBy(F.col("kind").alias("view"), F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("weight")).withColumn("weak", F.col("weight") < 3)
    u = e.select("view", F.col("src").alias("id")).union(e.select("view", F.col("dst").alias("id"))).distinct().select("view", "id", F.lit("unit").alias("kind"), F.col("id").alias("label"), F.lit(False).alias("pinned"))
    return views.fit(u, e, 10, 30)[1].select("view", "src", "dst", "weight")


_TURNS = "SELECT conv_id, role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations"


@query(f"""WITH l AS (SELECT DISTINCT conv_id, src, dst FROM ({_TURNS}) WHERE dst IS NOT NULL), n AS (SELECT conv_id, src AS node FROM l UNION SELECT conv_id, dst FROM l),
o AS (SELECT DISTINCT conv_id, src AS node FROM l WHERE src <> dst), i AS (SELECT DISTINCT conv_id, dst AS node FROM l WHERE src <> dst)
SELECT n.conv_id AS view, n.node, CASE WHEN i.node IS NULL AND o.node IS NOT NULL THEN 'source' WHEN o.node IS NULL AND i.node IS NOT NULL THEN 'sink' ELSE 'process' END AS role
FROM n LEFT JOIN o USING (conv_id, node) LEFT JOIN i USING (conv_id, node)""")
def flow_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which roles begin and end each conversation's flow of turns."""
    from pyspark.sql import Window

    t = Tables(spark, sf_dir).conversations
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return views.flow_ends(t.select(F.col("conv_id").alias("view"), F.col("role").alias("src"), nxt.alias("dst")).where("dst is not null").distinct())


@query("""WITH v AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS want FROM events GROUP BY 1), f AS (SELECT user_id, string_agg(event_type, ' ') AS said FROM events WHERE event_id % 2 = 0 GROUP BY 1),
x AS (SELECT v.user_id AS view, want, said, list_filter(want, lambda w: NOT contains(coalesce(said, ''), w)) AS lost FROM v LEFT JOIN f USING (user_id))
SELECT view, CASE WHEN said IS NULL THEN 'missing' WHEN (len(want) - len(lost)) / len(want) >= 0.6 THEN 'ok' ELSE 'mismatch' END AS verdict, array_to_string(lost, ',') AS missing FROM x""")
def verify_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types of each user against those of their even events."""
    e = Tables(spark, sf_dir).events
    want = e.groupBy(F.col("user_id").alias("view")).agg(F.array_sort(F.collect_set("event_type")).alias("labels"))
    found = e.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("view")).agg(F.array_join(F.collect_list("event_type"), " ").alias("text"))
    return runs.verify(runs.expected_labels(want), found).select("view", "verdict", F.array_join("missing", ",").alias("missing"))


_FOLD = "CASE WHEN status = 'failed' THEN 'failed' WHEN bad THEN CASE WHEN tries + 1 >= 2 THEN 'failed' ELSE status END WHEN event_type = 'view' AND status = 'pending' THEN 'generated' WHEN event_type = 'click' AND status = 'generated' THEN 'placed' WHEN event_type = 'purchase' AND status = 'placed' THEN 'verified' ELSE status END"


@query(f"""WITH RECURSIVE l AS (SELECT user_id, event_type, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 'pending' AS status, 0 AS tries FROM l UNION ALL
SELECT l.user_id, l.k, {_FOLD}, CASE WHEN status = 'failed' THEN tries WHEN bad THEN tries + 1 ELSE 0 END FROM r JOIN l ON l.user_id = r.user_id AND l.k = r.k + 1)
SELECT user_id AS id, arg_max(status, k) AS status, arg_max(tries, k) AS attempts FROM r GROUP BY 1""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events read as actions: a view generates, a click places, a purchase verifies, an error fails."""
    e = Tables(spark, sf_dir).events
    action = F.when(F.col("event_type") == "view", "generate").when(F.col("event_type") == "click", "place").when(F.col("event_type") == "purchase", "verify").otherwise("other")
    log = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"))
    return runs.fold(log).select("id", "status", "attempts")


@query("""WITH c AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type IN ('view', 'click')), r AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS a FROM events WHERE event_type = 'purchase'),
k AS (SELECT r.user_id, r.a, list_sort(list(c.t) FILTER (WHERE c.t IS NOT NULL)) AS times FROM (SELECT DISTINCT user_id, a FROM r) r LEFT JOIN c ON c.user_id = r.user_id AND c.t > r.a - 86400 AND c.t <= r.a GROUP BY ALL)
SELECT user_id AS key, a AS at, coalesce(len(times), 0) AS used, round(CASE WHEN coalesce(len(times), 0) - 1 <= 0 THEN 0 ELSE times[len(times) - 1] + 86400 - a + 0.01 END, 2) AS wait FROM k""")
def admission_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each purchase waits when a user may have two views, clicks and purchases a day."""
    e = Tables(spark, sf_dir).events.select(F.col("user_id").alias("key"), (F.expr("unix_micros(cast(ts as timestamp))") / 1e6).alias("ts"), "event_type")
    log = e.where("event_type in ('view', 'click')").select("key", "ts", F.lit("attempt").alias("event"), F.lit(True).alias("counted"))
    asks = e.where("event_type = 'purchase'").select("key", F.col("ts").alias("at"), F.lit(1).alias("need")).distinct()
    return runs.admission(log, asks, 86_400, 2).select("key", "at", "used", F.round("wait", 2).alias("wait"))


@query(r"""SELECT page_id, regexp_replace(lower(trim(regexp_replace(url, '["''`]', '', 'g'))), '\s+', ' ', 'g') AS comparable, trim(regexp_replace(replace(replace(url, '#', ''), ':', ' -'), '\s+', ' ', 'g')) AS message FROM pages""")
def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).pages.select("page_id", N.comparable(F.col("url")).alias("comparable"), N.message(F.col("url")).alias("message"))


@query("""WITH t AS (SELECT array_to_string([CAST(r_regionkey AS VARCHAR), r_name], ':') AS id, r_name FROM region) SELECT id, sha256(id) AS signature FROM t""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = N.stable_id(F.col("r_regionkey").cast("string"), F.lit(""), F.col("r_name"))
    return Tables(spark, sf_dir).region.select(i.alias("id"), F.sha2(i, 256).alias("signature"))


@query("""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS doc, coalesce(html, '') AS html FROM pages)
SELECT doc, 'all' AS id, 'SECTION' AS type, CAST(NULL AS VARCHAR) AS parent, true AS top FROM p
UNION ALL SELECT DISTINCT doc, replace(id, '&amp;', '&'), 'A', 'all', false FROM (SELECT doc, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS id FROM p)""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's markup in a section, its links' addresses as ids, read tolerantly."""
    text = F.concat(F.lit('<section id="all">'), F.replace(F.coalesce("html", F.lit("")), F.lit("<a href="), F.lit("<a id=")), F.lit("</section>"))
    return trees.elements(Tables(spark, sf_dir).pages.select(F.col("page_id").cast("string").alias("doc"), text.alias("text"))).select("doc", "id", "type", "parent", "top")
