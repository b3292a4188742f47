"""Graph and sequence operators over all line items and events: many small graphs of uneven size, and order that decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrygraph.operators import graphs, joins, lint
from quarrygraph.plans.registry import query
from quarrygraph.plans.relational import events
from quarrygraph.sources.tables import Tables

# a customer's line items in order: from each one's brand to the next one's
_MOVES = """SELECT o_custkey AS view, row_number() OVER w AS pos, p_brand AS src, lead(p_brand) OVER w AS dst, l_returnflag AS flag, lead(l_returnflag) OVER w AS next_flag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_returnflag)"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view, pos, src, dst, flag, next_flag): each customer's line items in order, from brand to next brand."""
    t = Tables(spark, sf_dir)
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    x = x.select(F.col("o_custkey").alias("view"), F.row_number().over(w).cast("long").alias("pos"), F.col("p_brand").alias("src"), F.lead("p_brand").over(w).alias("dst"), F.col("l_returnflag").alias("flag"), F.lead("l_returnflag").over(w).alias("next_flag"))
    return x.where("dst is not null")


def linked_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a customer's brands, linked where neighbouring line items have one return flag: some graphs a customer, of uneven sizes."""
    name = lambda c: F.concat_ws(":", F.col("view"), c)
    return moves(spark, sf_dir).where("flag = next_flag").select(name("src").alias("src"), name("dst").alias("dst"))


_LINKED = f"SELECT DISTINCT view || ':' || src AS a, view || ':' || dst AS b, view FROM ({_MOVES}) WHERE dst IS NOT NULL AND flag = next_flag"


@query(f"""WITH RECURSIVE m AS (SELECT view, pos, src, dst FROM ({_MOVES}) WHERE dst IS NOT NULL),
n AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS i FROM (SELECT DISTINCT p_brand FROM part)),
e AS (SELECT view, pos, x.i AS a, y.i AS b FROM m JOIN n x ON src = x.p_brand JOIN n y ON dst = y.p_brand),
s AS (SELECT view, 0::BIGINT AS pos, NULL::BOOLEAN AS back, []::BIGINT[] AS held FROM (SELECT DISTINCT view FROM e)
  UNION ALL SELECT view, pos, back, CASE WHEN back THEN held ELSE list_distinct(list_concat(held, flatten(list_transform(list_append(list_transform(list_filter(held, lambda p: p % 1000 = a), lambda p: p // 1000), a),
    lambda f: list_transform(list_append(list_transform(list_filter(held, lambda p: p // 1000 = b), lambda p: p % 1000), b), lambda t: f * 1000 + t))))) END
  FROM (SELECT e.view, e.pos, e.a, e.b, s.held, e.a = e.b OR list_contains(s.held, e.b * 1000 + e.a) AS back FROM s JOIN e ON e.view = s.view AND e.pos = s.pos + 1))
SELECT view, pos, back FROM s WHERE pos > 0""")
def backward_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a customer's moves between brands turn back; the SQL keeps each customer's closure as a list."""
    return graphs.backward_arrows(moves(spark, sf_dir).select("view", "pos", "src", "dst"))


@query(f"""WITH RECURSIVE e AS ({_LINKED}), r AS (SELECT view, a, b FROM e UNION SELECT r.view, r.a, e.b FROM r JOIN e ON r.view = e.view AND r.b = e.a)
SELECT x.a AS v, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.view = y.view AND x.a = y.b AND x.b = y.a GROUP BY x.a""")
def strong_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of all line items' brand graph: each customer's part of it by itself, as no edge leaves it."""
    x = graphs.strong_by_view(moves(spark, sf_dir).where("flag = next_flag").select("view", "src", "dst"))
    return x.select(*[F.concat_ws(":", F.col("view"), c).alias(c) for c in ("v", "component")])


@query(f"""WITH RECURSIVE e AS ({_LINKED}), u AS (SELECT view, a, b FROM e UNION SELECT view, b, a FROM e), r AS (SELECT view, a, a AS b FROM u UNION SELECT r.view, r.a, u.b FROM r JOIN u ON r.view = u.view AND r.b = u.a)
SELECT a AS v, min(b) AS component FROM r GROUP BY a""")
def weak_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak components of the same graph: thousands, of one to twenty-five vertices."""
    return graphs.weak_components(linked_brands(spark, sf_dir))


_DAY = 86_400_000_000


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('view', 'click')),
s AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS v, NULL::BIGINT AS vt, NULL::BIGINT AS c, NULL::BIGINT AS ct, NULL::BIGINT AS view_id, NULL::BIGINT AS click_id FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, k, CASE WHEN hit THEN NULL ELSE v END, CASE WHEN hit THEN NULL ELSE vt END, CASE WHEN hit THEN NULL ELSE c END, CASE WHEN hit THEN NULL ELSE ct END, CASE WHEN hit THEN v END, CASE WHEN hit THEN c END
  FROM (SELECT *, coalesce(abs(vt - ct) <= {_DAY}, false) AS hit FROM (SELECT e.user_id, e.k, CASE WHEN event_type = 'view' THEN event_id ELSE v END AS v, CASE WHEN event_type = 'view' THEN us ELSE vt END AS vt,
    CASE WHEN event_type = 'click' THEN event_id ELSE c END AS c, CASE WHEN event_type = 'click' THEN us ELSE ct END AS ct FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
SELECT view_id, click_id FROM s WHERE view_id IS NOT NULL""")
def consumed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks of a user that use each other up within a day; the SQL is the state machine itself, one event a step."""
    e = events(spark, sf_dir).where("event_type in ('view', 'click')").select("user_id", "event_id", "event_type", "us")
    x = joins.consumed_pairs(e, ["user_id"], "us", "event_type", "view", _DAY, ["event_id"]).where("pair is not null and event_type = 'view'")
    return x.select(F.col("event_id").alias("view_id"), F.col("mate.event_id").alias("click_id"))


@query(f"""WITH RECURSIVE g AS (SELECT view, src AS grp, count(*) AS m FROM ({_MOVES}) GROUP BY view, src),
c AS (SELECT view, grp, m, unnest(range(0, m, 4)) AS start FROM g), q AS (SELECT view, grp, start, least(4, m - start) AS n FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY n DESC, grp, start) AS k FROM q),
s AS (SELECT view, 0::BIGINT AS k, []::BIGINT[] AS rooms, NULL::BIGINT AS bin FROM (SELECT DISTINCT view FROM p)
  UNION ALL SELECT view, k, CASE WHEN b IS NULL THEN list_append(rooms, 4 - n) ELSE list_concat(list_slice(rooms, 1, b - 1), [rooms[b] - n], list_slice(rooms, b + 1, len(rooms))) END, coalesce(b - 1, len(rooms))
  FROM (SELECT p.view, p.k, p.n, s.rooms, nullif(coalesce(list_position(list_transform(s.rooms, lambda r: r >= p.n), true), 0), 0) AS b FROM s JOIN p ON p.view = s.view AND p.k = s.k + 1))
SELECT view, grp, start, n AS members, bin FROM p JOIN s USING (view, k)""")
def packed_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's line items by brand, packed first-fit into bins of four; the SQL keeps each customer's rooms as a list."""
    t = Tables(spark, sf_dir)
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return graphs.first_fit_by(x.groupBy(F.col("o_custkey").alias("view"), F.col("p_brand").alias("grp")).agg(F.count(F.lit(1)).alias("members")), 4)


@query()
def brand_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of each customer's brand graph, all customers at once; tested against a plain loop."""
    return graphs.communities(None, moves(spark, sf_dir).select("view", "src", "dst"), size=6)


@query(f"""WITH m AS (SELECT view, pos, replace(src, 'Brand#', CASE WHEN view % 5 = 0 THEN 'B_' ELSE 'B' END) AS a, replace(dst, 'Brand#', CASE WHEN view % 5 = 0 THEN 'B_' ELSE 'B' END) AS b FROM ({_MOVES}) WHERE dst IS NOT NULL),
n AS (SELECT view, name, min(pos) AS pos FROM (SELECT view, a AS name, pos FROM m UNION ALL SELECT view, b, pos FROM m) GROUP BY ALL)
SELECT view::VARCHAR AS view, 'warning' AS severity, 'duplicate-edge' AS rule, (pos + 1)::INTEGER AS line FROM (SELECT *, row_number() OVER (PARTITION BY view, a, b ORDER BY pos) AS k FROM m) WHERE k > 1
UNION ALL SELECT DISTINCT view::VARCHAR, 'error', 'underscore-id', (pos + 1)::INTEGER FROM n WHERE name LIKE '%\\_%' ESCAPE '\\'
UNION ALL SELECT view::VARCHAR, 'warning', 'density', 0 FROM (SELECT view, count(*) AS e FROM m GROUP BY view) JOIN (SELECT view, count(*) AS k FROM n GROUP BY view) USING (view) WHERE e > 30 OR k > 25""")
def flow_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's moves between brands as a flow text, and what is wrong with it."""
    name = lambda c: F.regexp_replace(c, "Brand#", F.when(F.col("view") % 5 == 0, "B_").otherwise("B"))
    line = F.concat(F.lit("  "), name(F.col("src")), F.lit(" --> "), name(F.col("dst")))
    texts = moves(spark, sf_dir).groupBy("view").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return lint.linted(texts.select(F.col("view").cast("string").alias("view"), F.lit("flowchart").alias("renderer"), text.alias("text")))
