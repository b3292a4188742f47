"""Runs derived from customers and orders: what each does next, and their states in two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.operators import actions
from quarrygraph.plans.registry import query
from quarrygraph.sources.tables import Tables

_STATUS = ["pending", "stale", "generated", "placed", "verified", "obsolete", "failed"]


@query("""WITH r AS (SELECT c_custkey AS run, c_custkey % 11 <> 0 AS confirmed, c_custkey % 5 <> 0 AS file, c_custkey % 2 = 0 AS keyed, (c_custkey % 3)::INT AS choices, c_custkey % 13 = 0 AS unsure,
  CASE WHEN c_custkey % 17 = 0 THEN 'auth' WHEN c_custkey % 19 = 0 THEN 'budget' END AS stopped, c_custkey % 23 = 0 AS asked FROM customer),
v AS (SELECT o_custkey AS run, o_orderkey AS id, left(o_orderpriority, 1) AS p, o_orderkey % 7 AS s, o_orderkey % 4 AS tries FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 > 2),
f AS (SELECT run, arg_min(id, (p, id)) FILTER (s = 2) AS place, arg_min(id, (p, id)) FILTER (s < 2 AND tries < 2) AS draw, count(*) FILTER (s IN (3, 4)) > 0 AS shown, count(*) FILTER (s = 5) > 0 AS gone FROM v GROUP BY run),
a AS (SELECT r.run, stopped, CASE WHEN stopped = 'auth' THEN 'stop' WHEN asked THEN 'ask_plan' WHEN unsure THEN CASE WHEN file THEN 'reconcile_generate' ELSE 'ask_file_url' END WHEN NOT confirmed THEN 'confirm' WHEN place IS NOT NULL THEN 'place'
  WHEN draw IS NOT NULL AND NOT keyed THEN CASE WHEN choices > 1 THEN 'ask_plan' ELSE 'whoami' END WHEN draw IS NOT NULL THEN 'generate' WHEN shown AND file THEN 'legend' WHEN gone AND file THEN 'delete' WHEN shown THEN 'verify' ELSE 'done' END AS purpose,
  place, draw FROM r LEFT JOIN f USING (run)),
e AS (SELECT user_id AS run, epoch_us(ts) / 1000000.0 AS ts FROM events), n AS (SELECT max(ts) AS now FROM e), d AS (SELECT run, count(*) AS day FROM e, n WHERE ts > now - 86400 GROUP BY run),
g AS (SELECT a.*, CASE purpose WHEN 'generate' THEN 2 WHEN 'stop' THEN 0 WHEN 'done' THEN 0 WHEN 'whoami' THEN 0 WHEN 'confirm' THEN 0 WHEN 'ask_plan' THEN 0 WHEN 'ask_file_url' THEN 0 ELSE 1 END AS need, coalesce(day, 0) AS day FROM a LEFT JOIN d USING (run))
SELECT run, purpose, CASE purpose WHEN 'place' THEN place::VARCHAR WHEN 'generate' THEN draw::VARCHAR WHEN 'reconcile_generate' THEN 'v' WHEN 'ask_file_url' THEN 'v' END AS view,
  CASE WHEN purpose = 'stop' OR (need > 0 AND day + need > 3) THEN 'stop' WHEN purpose IN ('ask_plan', 'ask_file_url', 'confirm') THEN 'ask' ELSE 'act' END AS decision,
  CASE WHEN purpose = 'stop' THEN stopped WHEN need > 0 AND day + need > 3 THEN 'budget' END AS reason FROM g""")
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, their orders as views, users' events as calls; a day has room for three."""
    t = Tables(spark, sf_dir)
    k = F.col("c_custkey")
    text = lambda c: F.lit(c).cast("string")
    calls = t.events.select(F.col("user_id").alias("run"), (F.expr("unix_micros(cast(ts as timestamp))") / 1_000_000).alias("ts"))
    last = calls.agg(F.max("ts")).first()[0]
    stop = F.when(k % 17 == 0, "auth").when(k % 19 == 0, "budget")
    asked = k % 23 == 0
    runs = t.customer.select(k.alias("run"), F.lit(last).alias("now"), (k % 11 != 0).alias("confirmed"), F.lit(False).alias("auto"), F.lit(False).alias("visual"), F.when(k % 5 != 0, "key").alias("file_key"), text("r1").alias("revision"), F.when(k % 2 == 0, "plan").alias("plan_key"), F.lit(False).alias("plan_checked"), (k % 3).cast("int").alias("plan_choices"), F.when(k % 13 == 0, "v").alias("uncertain"), F.when(asked, "ask_user").alias("pending_kind"), F.when(asked, "ask_plan").alias("pending_purpose"), text(None).alias("pending_view"), stop.alias("stop_reason"), text(None).alias("legend_hash"), text(None).alias("legend_failed_hash"), text(None).alias("verify_sig"), text(None).alias("verify_status"))
    o = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, _STATUS)), (o % 7).cast("int"))
    views = t.orders.where("o_orderkey % 3 = 0 or o_orderkey % 7 > 2").select(F.col("o_custkey").alias("run"), o.alias("id"), F.substring("o_orderpriority", 1, 1).alias("priority"), status.alias("status"), (o % 4).alias("attempts"), o.cast("string").alias("section"), text("flow").alias("type"), text("t").alias("title"), F.array(F.lit("app")).alias("categories"), text(None).alias("check"), F.lit(False).alias("looked"), F.lit(False).alias("delete_failed"))
    return actions.next_actions(runs, views, calls, per_day=3, max_wait=1e9).select("run", "purpose", "view", "decision", "reason")


@query("""WITH v AS (SELECT o_custkey AS run, count(*) AS views, sum(CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_orderkey % 4 END) AS attempts FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1)
SELECT c_custkey AS run, c_custkey % 7 <> 0 AS known, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'pending' ELSE 'done' END END AS phases_publish_status,
CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 2 END END AS ignored, CASE WHEN c_custkey % 7 <> 0 THEN 'key' || c_custkey END AS figma_file_key, coalesce(views, 0) AS views, coalesce(attempts, 0)::BIGINT AS attempts
FROM customer LEFT JOIN v ON run = c_custkey""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of an older form (even customers), of a newer one with more fields, and of a version that isn't known, by one read."""
    t = Tables(spark, sf_dir)
    k = F.col("c_custkey")
    old = F.struct((F.col("o_orderkey") % 7).cast("string").alias("content_hash"))
    new = F.struct((F.col("o_orderkey") % 7).cast("string").alias("content_hash"), (F.col("o_orderkey") % 4).alias("attempts"), F.lit("x").alias("colour"))
    pair = lambda value: F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('":'), F.to_json(value))
    held = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.collect_list(F.when(F.col("o_custkey") % 2 == 0, pair(old)).otherwise(pair(new))), ",").alias("views"))
    x = t.customer.select("c_custkey").join(held, "c_custkey", "left")
    views = F.concat(F.lit('"diagrams":{'), F.coalesce("views", F.lit("")), F.lit("}"))
    key = F.concat(F.lit('"file_key":"key'), k.cast("string"), F.lit('"'))
    version = F.concat(F.lit('{"schema_version":'), F.when(k % 7 == 0, "2").otherwise("1"), F.lit(","))
    text = F.when(k % 2 == 0, F.concat(version, F.lit('"figma":{'), key, F.lit("},"), views, F.lit("}"))).otherwise(F.concat(version, F.lit('"figma":{"ignore_ids":["a","b"],'), key, F.lit('},"phases":{"publish":{"status":"done","at":"now"}},"later":{"x":1},'), views, F.lit("}")))
    states, views = actions.states(x.select(k.alias("run"), text.alias("state")))
    per = views.groupBy("run").agg(F.count(F.lit(1)).alias("views"), F.sum("attempts").cast("long").alias("attempts"))
    out = states.join(per, "run", "left")
    return out.select("run", "known", "phases_publish_status", F.when(F.col("known"), F.size("figma_ignore_ids")).alias("ignored"), "figma_file_key", F.coalesce("views", F.lit(0)).cast("long").alias("views"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"))
