"""Projection, findings, impact and logs bound to a model of the test tables.

Nations are subsystems, suppliers modules, customers symbols of suppliers, parts what cuts across; line items are edges
whose kind their line number tells. All tables are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.operators import builders as B
from quarrygraph.operators import findings, graphs, impact, validator
from quarrygraph.operators import projection as P
from quarrygraph.plans.registry import query
from quarrygraph.sources import logs
from quarrygraph.sources.tables import Tables

_CUSTOMER_KINDS = ["function", "class", "ui_component", "api_endpoint"]
_PART_KINDS = ["datastore", "event_channel", "external_service", "deployment_unit", "config"]
_TAGS = ["entrypoint", "algorithm", "error", "ui"]
_LINE_KINDS = ["db_read", "calls", "publishes", "imports", "external_call", "triggers", "depends_on"]


def _pick_sql(values: list[str], n: str) -> str:
    return "CASE " + n + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


NODES_SQL = f"""SELECT 's' || s_suppkey AS id, s_name AS name, 'module' AS kind, 'sub:' || s_nationkey AS subsystem, CAST(NULL AS VARCHAR) AS parent, CAST([] AS VARCHAR[]) AS tags, 'n' || s_nationkey || '/' || s_suppkey || '.py' AS file FROM supplier
UNION ALL SELECT 'c' || c_custkey, c_name, {_pick_sql(_CUSTOMER_KINDS, 'c_custkey % 4')}, 'sub:' || c_nationkey, 's' || (c_custkey % 10 + 1), CASE WHEN c_custkey % 7 < {len(_TAGS)} THEN [{_pick_sql(_TAGS, 'c_custkey % 7')}] ELSE [] END, NULL FROM customer
UNION ALL SELECT 'p' || p_partkey, p_name, {_pick_sql(_PART_KINDS, 'p_partkey % 5')}, NULL, NULL, CAST([] AS VARCHAR[]), NULL FROM part"""
EDGES_SQL = f"""SELECT kind, src, dst, max(label) AS label, max(status) AS status, 'e:' || kind || ':' || src || '>' || dst AS id, min(line) AS line FROM (
SELECT {_pick_sql(_LINE_KINDS, '(l_linenumber - 1)')} AS kind, 'c' || o_custkey AS src, CASE WHEN l_linenumber % 2 = 1 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS dst, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE '' END AS label, CASE WHEN l_linestatus = 'O' THEN 'confirmed' ELSE 'static_inferred' END AS status, l_orderkey AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'handles', 'c' || c_custkey, 's' || (c_custkey % 10 + 1), '', 'confirmed', 0 FROM customer WHERE c_custkey % 4 = 3) GROUP BY ALL"""
EDGES_SQL = EDGES_SQL.replace("GROUP BY ALL", "GROUP BY kind, src, dst")
_MODEL = f"n AS ({NODES_SQL}), e AS ({EDGES_SQL})"


def _pick(values: list[str], n) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and subsystems."""
    t = Tables(spark, sf_dir)
    none = F.lit(None).cast("string")
    text = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    no_tags = F.array().cast("array<string>")
    s = t.supplier.select(text("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("module").alias("kind"), text("sub:", "s_nationkey").alias("subsystem"), none.alias("parent"), no_tags.alias("tags"), F.concat(text("n", "s_nationkey"), text("/", "s_suppkey"), F.lit(".py")).alias("file"))
    home = F.concat(F.lit("s"), (F.col("c_custkey") % 10 + 1).cast("string"))
    c = t.customer.select(text("c", "c_custkey"), "c_name", _pick(_CUSTOMER_KINDS, F.col("c_custkey") % 4), text("sub:", "c_nationkey"), home, F.array_compact(F.array(_pick(_TAGS, F.col("c_custkey") % 7))), none)
    p = t.part.select(text("p", "p_partkey"), "p_name", _pick(_PART_KINDS, F.col("p_partkey") % 5), none, none, no_tags, none)
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # grouped as numbers, so that nothing is sorted for it; words are put to the groups
    n, odd = F.col("l_linenumber"), F.col("l_linenumber") % 2 == 1
    lines = lines.groupBy(F.when(n.between(1, len(_LINE_KINDS)), n.cast("int") - 1).alias("k"), odd.alias("odd"), F.col("o_custkey").alias("c"), F.when(odd, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("to"))
    lines = lines.agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.max(F.when(F.col("l_linestatus") == "O", 0).otherwise(1)).alias("inferred"), F.min("l_orderkey").alias("line"))
    lines = lines.select(_pick(_LINE_KINDS, F.col("k")).alias("kind"), text("c", "c").alias("src"), F.when(F.col("odd"), text("p", "to")).otherwise(text("s", "to")).alias("dst"), F.when(F.col("returned") == 1, "returned").otherwise("").alias("label"), F.when(F.col("inferred") == 1, "static_inferred").otherwise("confirmed").alias("status"), "line")
    handled = t.customer.where("c_custkey % 4 = 3").select(F.lit("handles"), text("c", "c_custkey"), home, F.lit(""), F.lit("confirmed"), F.lit(0).cast("long")).distinct()
    e = lines.union(handled)
    e = e.withColumns({"id": F.concat(F.lit("e:"), "kind", F.lit(":"), "src", F.lit(">"), "dst"), "file": F.lit("orders"), "phase": F.lit("unknown")})
    subs = t.nation.select(text("sub:", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(text("n", "n_nationkey")).alias("paths"))
    return s.union(c).union(p), e, subs


_MODULE_SQL = "SELECT x.id, CASE WHEN x.kind = 'module' THEN x.id ELSE coalesce(m.id, x.id) END AS module FROM n x LEFT JOIN n m ON x.parent = m.id AND m.kind = 'module'"
_OWN = "kind IN ('datastore', 'event_channel', 'external_service', 'deployment_unit', 'config')"
_UNIT_SQL = f"""b AS (SELECT n.id, n.kind, CASE WHEN {_OWN} THEN n.id WHEN n.subsystem IS NOT NULL THEN n.subsystem ELSE m.module END AS sub, CASE WHEN {_OWN} OR kind = 'api_endpoint' THEN n.id ELSE m.module END AS module FROM n JOIN ({_MODULE_SQL}) m USING (id)),
h AS (SELECT src AS id, min_by(dst, id) AS handler FROM e WHERE kind = 'handles' GROUP BY src),
u AS (SELECT b.id, CASE WHEN b.kind = 'api_endpoint' THEN coalesce(t.module, b.module) ELSE b.module END AS module, CASE WHEN b.kind = 'api_endpoint' THEN coalesce(t.sub, b.sub) ELSE b.sub END AS sub FROM b LEFT JOIN h USING (id) LEFT JOIN b t ON h.handler = t.id)"""


@query(f"WITH {_MODEL}, {_UNIT_SQL} SELECT id, module, sub AS subsystem FROM u")
def model_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units at both levels: handlers for endpoints, parents for symbols."""
    n, e, _ = model(spark, sf_dir)
    return P.units(n, e, "module").withColumnRenamed("unit", "module").join(P.units(n, e, "subsystem").withColumnRenamed("unit", "subsystem"), "id")


@query(f"WITH {_MODEL}, {_UNIT_SQL} SELECT sub AS unit, CAST(count(DISTINCT id) AS BIGINT) AS n, md5(string_agg(DISTINCT id, ',' ORDER BY id)) AS ids FROM u GROUP BY sub")
def unit_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = model(spark, sf_dir)
    x = P.members(P.units(n, e, "subsystem"))
    return x.select("unit", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids"))


_VERBS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.VERBS.items()) + " END"


@query(f"""WITH {_MODEL}, {_UNIT_SQL}, x AS (SELECT a.sub AS src, b.sub AS dst, e.kind, nullif(e.label, '') AS label, CASE e.status WHEN 'confirmed' THEN 0 ELSE 2 END AS r FROM e JOIN u a ON e.src = a.id JOIN u b ON e.dst = b.id WHERE a.sub <> b.sub AND e.kind NOT IN ('inherits', 'config_dependency')),
k AS (SELECT src, dst, kind, count(*) AS n, min(r) AS r, min(label) AS label FROM x GROUP BY 1, 2, 3),
p AS (SELECT src, dst, arg_min({{'k': kind, 'l': label}}, (kind = 'imports', -n, kind)) AS top, sum(CASE WHEN kind <> 'imports' THEN n ELSE 0 END) AS strong, sum(n) AS n, min(CASE WHEN kind <> 'imports' THEN r END) AS r, min(r) AS any_r, bool_and(kind IN ('imports', 'publishes', 'subscribes', 'spawns', 'triggers', 'external_call')) AS quiet FROM k GROUP BY 1, 2)
SELECT p.src, p.dst, coalesce(p.top.l, {_VERBS.replace('CASE kind', 'CASE p.top.k')}, p.top.k) AS label, CAST(CASE WHEN p.strong = 0 THEN p.n ELSE p.strong END AS BIGINT) AS weight, p.strong = 0 AS weak,
CASE coalesce(p.r, p.any_r) WHEN 0 THEN 'confirmed' ELSE 'static_inferred' END AS status, p.quiet AND p.strong > 0 AS async
FROM p LEFT JOIN p q ON p.src = q.dst AND p.dst = q.src AND q.strong > 0 WHERE p.strong > 0 OR q.src IS NULL""")
def unit_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrows of an overview before it is fitted: pairs of subsystems and what cuts across, imports only where nothing else links a pair."""
    n, e, _ = model(spark, sf_dir)
    return B.arrows(e, P.units(n, e, "subsystem"))


@query(f"WITH {_MODEL} SELECT id FROM n WHERE id IN (SELECT src FROM e WHERE kind NOT IN ('imports', 'inherits', 'config_dependency') UNION SELECT dst FROM e WHERE kind NOT IN ('imports', 'inherits', 'config_dependency'))")
def model_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = model(spark, sf_dir)
    return P.significant(n, e).select("id")


@query(f"""WITH {_MODEL}, s AS (SELECT id FROM n WHERE subsystem IN ('sub:1', 'sub:2', 'sub:3') OR kind = 'datastore'), t AS (SELECT id FROM n WHERE subsystem = 'sub:1')
SELECT id FROM e WHERE kind IN ('db_read', 'calls', 'handles', 'imports') AND kind NOT IN ('imports') AND src IN (FROM s) AND dst IN (FROM s) AND (src IN (FROM t) OR dst IN (FROM t))""")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = model(spark, sf_dir)
    scope = n.where("subsystem in ('sub:1', 'sub:2', 'sub:3') or kind = 'datastore'")
    return P.kept_edges(e, scope, ["db_read", "calls", "handles", "imports"], ["imports"], n.where("subsystem = 'sub:1'")).select("id")


@query(f"""WITH {_MODEL}, m AS (SELECT n.id FROM n JOIN nation ON n.subsystem = 'sub:' || n_nationkey WHERE contains(lower(n_name), 'a') OR contains(n.subsystem, 'a')),
g AS (SELECT id FROM n WHERE contains(lower(name), 'a') OR contains(lower(id), 'a')), f AS (SELECT id FROM m UNION ALL SELECT id FROM g WHERE NOT EXISTS (FROM m)),
o AS (SELECT dst AS id FROM e WHERE src IN (FROM f) UNION SELECT src FROM e WHERE dst IN (FROM f)) SELECT id, true AS matched FROM f UNION ALL SELECT id, false FROM o WHERE id NOT IN (FROM f) AND id IN (SELECT id FROM n)""")
def focus_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, s = model(spark, sf_dir)
    return P.focus(n, s, e, "A")


_CATEGORY_SQL = "CASE WHEN list_contains(tags, 'error') THEN 'error' WHEN list_contains(tags, 'algorithm') THEN 'processing' WHEN kind = 'datastore' THEN 'data' WHEN kind = 'event_channel' THEN 'messaging' WHEN kind = 'external_service' THEN 'external' WHEN kind IN ('config', 'deployment_unit') THEN 'infra' ELSE 'app' END"


@query(f"WITH {_MODEL} SELECT id, {_CATEGORY_SQL} AS category, CASE kind WHEN 'datastore' THEN 'cylinder' WHEN 'event_channel' THEN 'lean_r' WHEN 'api_endpoint' THEN 'stadium' WHEN 'config' THEN 'odd' WHEN 'deployment_unit' THEN 'rounded' ELSE 'rect' END AS shape FROM n")
def node_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir)[0].select("id", P.category().alias("category"), P.shape().alias("shape"))


@query(f"""WITH {_MODEL} SELECT subsystem, count(*) AS members, CASE WHEN bool_or(list_contains(tags, 'algorithm')) AND 3 * count(*) FILTER (kind = 'algorithm') >= count(*) THEN 'processing' ELSE 'app' END AS category,
2 * count(*) FILTER (kind = 'ui_component' OR list_contains(tags, 'ui')) >= count(*) FILTER (kind IN ('module', 'class', 'function', 'ui_component')) AS ui FROM n WHERE subsystem IS NOT NULL GROUP BY 1""")
def subsystem_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.subsystem_traits(model(spark, sf_dir)[0])


@query(f"""WITH {_MODEL}, t AS (SELECT * FROM n WHERE list_contains(tags, 'entrypoint') OR id = 's2'), f AS (SELECT parent AS id FROM t WHERE kind <> 'module') SELECT id FROM t WHERE kind <> 'module' OR id NOT IN (FROM f)""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _, _ = model(spark, sf_dir)
    tagged = n.withColumn("tags", F.when(F.col("id") == "s2", F.array(F.lit("entrypoint"))).otherwise(F.col("tags")))
    return P.entry_points(tagged).select("id")


@query(f"""WITH {_MODEL}, o AS (SELECT subsystem, count(*) AS components FROM n WHERE subsystem IS NOT NULL AND id IN (SELECT src FROM e WHERE kind <> 'imports' UNION SELECT dst FROM e WHERE kind <> 'imports') GROUP BY 1 HAVING count(*) >= 2),
x AS (SELECT a.subsystem AS s, b.subsystem AS d FROM e LEFT JOIN n a ON e.src = a.id LEFT JOIN n b ON e.dst = b.id WHERE a.subsystem IS DISTINCT FROM b.subsystem), c AS (SELECT v, count(*) AS crossing FROM (SELECT s AS v FROM x UNION ALL SELECT d FROM x) GROUP BY v),
r AS (SELECT o.subsystem, components, coalesce(crossing, 0) AS crossing FROM o LEFT JOIN c ON o.subsystem = c.v) SELECT *, row_number() OVER (ORDER BY -(components + crossing), subsystem) - 1 AS place, row_number() OVER (ORDER BY -(components + crossing), subsystem) <= 10 AS drawn FROM r""")
def subsystem_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = model(spark, sf_dir)
    return P.ranked_subsystems(n, e, 10)


@query(f"""WITH {_MODEL} SELECT id, CASE WHEN kind = 'datastore' THEN 'datastore' WHEN kind = 'external_service' THEN 'external' WHEN kind = 'event_channel' THEN 'async' WHEN kind = 'ui_component' THEN 'client' WHEN kind = 'deployment_unit' AND regexp_matches(lower(name), '{"|".join(P.GATEWAYS)}') THEN 'gateway' ELSE 'service' END AS lane FROM n""")
def node_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _, _ = model(spark, sf_dir)
    return P.lanes(n.select("id", "kind", F.col("name").alias("label"), "tags"), P.subsystem_traits(n)).select("id", "lane")


@query(f"WITH {_MODEL} SELECT id, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN kind = 'triggers' THEN 1 ELSE 0 END, CASE WHEN kind = 'triggers' THEN 0 ELSE line END, id) - 1 AS place FROM e")
def edge_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each source in the order of their first evidence; those of one kind have none."""
    _, e, _ = model(spark, sf_dir)
    return P.edge_order(e, e.where("kind <> 'triggers'").select("id", "file", "line")).select("id", F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey, string_agg(o_orderpriority, ', ' ORDER BY k) AS label FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY 1".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def joined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    first = P.ordered_distinct(t.orders.select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])
    return P.joined_labels(first.withColumnRenamed("o_orderpriority", "label"), ["o_custkey"], "label", "o_orderkey")


@query(f"""WITH {_MODEL} SELECT id FROM n WHERE kind IN ('module', 'class', 'datastore') AND id NOT IN (SELECT src FROM e WHERE kind IN ('triggers', 'depends_on') UNION SELECT dst FROM e WHERE kind IN ('triggers', 'depends_on')) AND id NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL) AND id NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 25)""")
def orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = model(spark, sf_dir)
    """Nodes that nothing triggers or depends on, that hold nothing and that no large part names."""
    named = Tables(spark, sf_dir).part.where("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return findings.orphans(n, e.where("kind in ('triggers', 'depends_on')"), named, ["module", "class", "datastore"]).select("id")


@query("""WITH r AS (SELECT 'c' || o_custkey AS id, o_orderkey AS source, CASE WHEN o_orderstatus = 'F' THEN 'class' WHEN o_orderstatus = 'O' THEN 'function' END AS kind, o_orderpriority AS name FROM orders)
SELECT id, arg_min(kind, source) FILTER (kind IS NOT NULL) AS kind, arg_max(name, source) AS name, count(DISTINCT kind) > 1 AS kind_conflict FROM r GROUP BY id""")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order tells something about its customer: the first kind wins, the last name."""
    none = F.lit(None).cast("string")
    kind = F.when(F.col("o_orderstatus") == "F", "class").when(F.col("o_orderstatus") == "O", "function")
    r = Tables(spark, sf_dir).orders.select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.col("o_orderkey").alias("source"), kind.alias("kind"), F.col("o_orderpriority").alias("name"), none.alias("subsystem"), none.alias("parent"), none.alias("file"), F.array("o_orderstatus").alias("tags"), F.array().cast("array<string>").alias("evidence"))
    return findings.merged_nodes(r).select("id", "kind", "name", "kind_conflict")


@query(f"""WITH {_MODEL}, f AS (SELECT l_orderkey, l_linenumber, 'c' || o_custkey AS src, 'p' || l_suppkey AS dst, CASE WHEN l_linenumber = 7 THEN 'odd' ELSE {_pick_sql(_LINE_KINDS, '(l_linenumber - 1)')} END AS kind, l_tax > 0.04 AS cited FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN f.kind = 'odd' THEN 'unknown kind' WHEN a.id IS NULL OR b.id IS NULL THEN 'end is no node' WHEN k.id IS NULL AND NOT cited THEN 'new edge without accepted evidence' END AS reason
FROM f LEFT JOIN n a ON f.src = a.id LEFT JOIN n b ON f.dst = b.id LEFT JOIN e k ON f.src = k.src AND f.dst = k.dst AND f.kind = k.kind""")
def admitted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings: edges from customers to parts numbered like their suppliers."""
    n, e, _ = model(spark, sf_dir)
    t = Tables(spark, sf_dir)
    kind = F.when(F.col("l_linenumber") == 7, "odd").otherwise(_pick(_LINE_KINDS, F.col("l_linenumber") - 1))
    f = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_suppkey").alias("dst"), kind.alias("kind"), F.lit(None).cast("string").alias("phase"), F.when(F.col("l_tax") > 0.04, F.array(F.lit("ev"))).alias("evidence"))
    return findings.admitted_edges(f, n, e).select("l_orderkey", "l_linenumber", "reason")


@query("""WITH e AS (SELECT 'n' || n_nationkey AS id, n_name AS name, n_nationkey AS pos FROM nation UNION ALL SELECT 'r' || r_regionkey, lower(r_name) || 's', 100 + r_regionkey FROM region),
a AS (SELECT 'c' || c_custkey AS entity, 'home' AS via, n_name AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, 'home', lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, 'within', lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || n_nationkey, 'heir', n_name FROM nation)
SELECT min_by(id, pos) AS src, entity AS dst, via FROM a JOIN e ON name IN (ref, lower(ref), ref || 's') GROUP BY entity, via""")
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers refer to nations by name, suppliers by lower-case names, which none has, nations to regions without their s and to themselves."""
    t = Tables(spark, sf_dir)
    name = lambda c, k: F.concat(F.lit(c), k)
    e = t.nation.select(name("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("pos"))
    e = e.union(t.region.select(name("r", "r_regionkey"), F.concat(F.lower("r_name"), F.lit("s")), F.lit(100) + F.col("r_regionkey")))
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name("c", "c_custkey").alias("entity"), F.lit("home").alias("name"), F.col("n_name").alias("references"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(name("s", "s_suppkey"), F.lit("home"), F.lower("n_name"))
    w = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(name("n", "n_nationkey"), F.lit("within"), F.lower("r_name"))
    h = t.nation.select(name("n", "n_nationkey"), F.lit("heir"), "n_name")
    return findings.foreign_keys(e, c.union(s).union(w).union(h))


@query("""SELECT changed, files, round(changed / files, 3) AS churn, false AS build, CASE WHEN changed = 0 THEN 'none' WHEN round(changed / files, 3) >= 0.4 THEN 'full' ELSE 'partial' END AS mode
FROM (SELECT count(*) FILTER (o_orderstatus = 'F') AS changed, count(*) AS files FROM orders)""")
def change_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).orders.select(F.concat(F.lit("orders/"), "o_orderkey").alias("path"), "o_orderstatus")
    return impact.mode(o.where("o_orderstatus = 'F'"), o)


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderpriority AS hash, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'pending' WHEN 2 THEN 'generated' WHEN 3 THEN 'placed' ELSE 'verified' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE o_orderpriority END AS was FROM orders),
p AS (SELECT CASE WHEN status IS NULL OR status = 'pending' THEN 'generate' WHEN was IS DISTINCT FROM hash THEN 'regenerate' WHEN status = 'generated' THEN 'place' WHEN status = 'placed' THEN 'verify' END AS purpose FROM x) SELECT purpose, count(*) AS calls FROM p WHERE purpose IS NOT NULL GROUP BY 1""")
def call_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("hash"))
    status = _pick(["", "pending", "generated", "placed", "verified"], F.col("id") % 5)
    state = o.where("id % 5 <> 0").select("id", status.alias("status"), F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return impact.call_estimate(o, state)


@query("""WITH x AS (SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS t, event_type, event_id FROM events)
SELECT event_id FROM x a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND abs(a.t - b.t) <= 86400)""")
def estimates_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of users without a purchase within a day around them."""
    e = Tables(spark, sf_dir).events.select("event_id", F.col("user_id").cast("string").alias("action_id"), (F.expr("unix_micros(cast(ts as timestamp))") / 1_000_000).alias("ts"), "event_type")
    log = e.where("event_type = 'purchase'").select("action_id", "ts", F.lit("attempt").alias("event"))
    return logs.estimated(log, e.where("event_type = 'view'").select("event_id", "action_id", "ts"), 86_400).select("event_id")


@query(f"""WITH RECURSIVE {_MODEL}, w AS (SELECT id, id AS above, 0 AS steps FROM n UNION ALL SELECT w.id, n.parent, steps + 1 FROM w JOIN n ON w.above = n.id WHERE n.parent IS NOT NULL AND steps < 8) SELECT above AS id, count(*) AS below, max(steps) AS depth FROM w GROUP BY above""")
def subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _, _ = model(spark, sf_dir)
    return impact.subtree(n, 8).groupBy(F.col("above").alias("id")).agg(F.count(F.lit(1)).alias("below"), F.max("steps").alias("depth"))


@query(f"""WITH {_MODEL} SELECT 'unknown-parent' AS rule, 'error' AS severity, count(*) AS n FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n) HAVING count(*) > 0
UNION ALL SELECT 'unknown-end', 'error', count(*) FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) WHERE v NOT IN (SELECT id FROM n WHERE kind <> 'config') HAVING count(*) > 0
UNION ALL SELECT 'unknown-subsystem', 'error', count(*) FROM n WHERE kind <> 'config' AND subsystem IN ('sub:3', 'sub:7') HAVING count(*) > 0
UNION ALL SELECT 'node-without-evidence', 'warning', count(*) FROM n WHERE kind <> 'config' HAVING count(*) > 0 UNION ALL SELECT 'edge-without-evidence', 'warning', count(*) FROM e HAVING count(*) > 0""")
def model_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules broken by the model without its settings and two of its subsystems, and with no evidence at all."""
    n, e, s = model(spark, sf_dir)
    none = F.array().cast("array<string>")
    parts = {"nodes": n.where("kind <> 'config'").withColumn("evidence", none), "edges": e.withColumn("evidence", none), "subsystems": s.where("id not in ('sub:3', 'sub:7')")}
    return validator.summary(validator.problems(parts))


def held_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The model as written tables: builders look at it many times."""
    return tuple(graphs.cut(x, "model") for x in model(spark, sf_dir))


def _drawn(view: B.View) -> DataFrame:
    """A view's boxes and arrows as rows of one table."""
    none = F.lit(None).cast("string")
    boxes = view.boxes.select("view", F.lit("box").alias("what"), F.col("id").alias("a"), none.alias("b"), "label", F.col("category").alias("mark"), F.lit(None).cast("long").alias("weight"))
    return boxes.union(view.arrows.select("view", F.lit("arrow"), "src", "dst", "label", "status", "weight"))


@query()
def overview_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(B.overview(*held_model(spark, sf_dir))[0])


@query()
def subsystem_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(B.subsystem_views(*held_model(spark, sf_dir)))


@query()
def data_flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(B.data_flow(*held_model(spark, sf_dir))[0])


@query()
def execution_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, s = model(spark, sf_dir)
    return _drawn(B.executions(graphs.cut(n, "model"), e, graphs.cut(s, "model")))  # edges are read once, and only the kinds that are followed


@query()
def infrastructure_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(B.infrastructure(*held_model(spark, sf_dir)))


@query()
def dependency_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(B.dependencies(*held_model(spark, sf_dir)))


@query()
def request_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = held_model(spark, sf_dir)
    return B.request_chains(n, e)[0]


@query("""WITH RECURSIVE m AS (SELECT 'n' || n_nationkey AS id, n_nationkey AS k FROM nation UNION ALL SELECT 'c' || c_custkey, c_nationkey FROM customer),
g AS (SELECT id, min(id) OVER (PARTITION BY k) AS grp, (row_number() OVER (PARTITION BY k ORDER BY id) - 1) // 20 * 20 AS start FROM m), q AS (SELECT grp, start, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT *, row_number() OVER (ORDER BY n DESC, grp, start) AS i FROM q),
s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS rooms, NULL::BIGINT AS bin
  UNION ALL SELECT i, CASE WHEN b IS NULL THEN list_append(rooms, 20 - n) ELSE list_concat(list_slice(rooms, 1, b - 1), [rooms[b] - n], list_slice(rooms, b + 1, len(rooms))) END, coalesce(b - 1, len(rooms))
  FROM (SELECT p.i, p.n, s.rooms, nullif(coalesce(list_position(list_transform(s.rooms, lambda r: r >= p.n), true), 0), 0) AS b FROM s JOIN p ON p.i = s.i + 1))
SELECT id, bin AS part FROM g JOIN p USING (grp, start) JOIN s USING (i)""")
def entity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their customers as entities in parts of at most 20."""
    t = Tables(spark, sf_dir)
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    ids = c.select(F.col("src").alias("id")).union(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id")))
    return B.entity_parts(ids, c)[0]


@query()
def rendered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the overview, the infrastructure and the data flow, through their own check."""
    from quarrygraph.functions import diagrams

    m = held_model(spark, sf_dir)
    specs = [B.assembled(v, "flowchart") for v in (B.overview(*m)[0], B.infrastructure(*m), B.data_flow(*m)[0])]
    return diagrams.gated(specs[0].union(specs[1]).union(specs[2]))
