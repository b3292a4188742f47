"""The flagship plan: a property graph's edges rolled up to pairs of coarser units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.operators.quotient import dominant_pairs
from quarrygraph.plans.registry import query
from quarrygraph.sources.tables import Tables

TRADE_SQL = """
SELECT cn.n_name AS a, sn.n_name AS b, l_returnflag AS kind
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
"""

PAIR_SQL = f"""
WITH e AS ({TRADE_SQL}), k AS (SELECT a, b, kind, count(*) AS n FROM e WHERE a <> b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, kind) AS p, sum(n) OVER (PARTITION BY a, b) AS weight,
      count(*) OVER (PARTITION BY a, b) AS kinds FROM k)
SELECT a, b, kind AS dominant, CAST(weight AS BIGINT) AS weight, kinds FROM r WHERE p = 1
"""


def trade_edges(t: Tables) -> DataFrame:
    """Edges (a, b, kind): customer nation, supplier nation, return flag of each line item."""
    nation = t.nation.select("n_nationkey", "n_name")
    customer = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("a"))
    supplier = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("b"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("a", "b", F.col("l_returnflag").alias("kind"))


@query(PAIR_SQL)
def pair_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_pairs(trade_edges(Tables(spark, sf_dir)))


@query(f"SELECT * FROM ({PAIR_SQL}) ORDER BY weight DESC, a, b LIMIT 30")
def pair_rollup_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable form keeps the 30 heaviest pairs: a top-k report."""
    return pair_rollup(spark, sf_dir).orderBy(F.desc("weight"), "a", "b").limit(30)
