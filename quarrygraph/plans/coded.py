"""Resolution of names over code that is derived from the tables (a module for each nation, and one for each customer that uses it), and a log made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.operators import graphs, receivers, resolution
from quarrygraph.plans.registry import query
from quarrygraph.sources import eventlog, pycode
from quarrygraph.sources.tables import Tables

_NATION = """class Base:
    def act(self):
        pass

class Tool(Base):
    def use(self, x):
        pass
    def run(self, x):
        pass

def make() -> 'Tool':
    return Tool()

tool = Tool()
"""
_CUSTOMER = """from functools import partial
from n%s import make, tool, Tool

class C:
    kept: Tool

    def __init__(self):
        self.spare = make()

    def go(self, %s):
        self.kept.use(1)
        self.spare.act()
        %s
        tool.run(2)
        timer.add(self.spare.act, partial(self.go, 3), key=make, other=Tool)
"""


def code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(facts, modules) of the files: a customer's parameter may hide or type what it imports, and a local name may replace it."""
    t = Tables(spark, sf_dir)
    k = F.col("c_custkey")
    parameter = F.when(k % 3 == 0, "tool").when(k % 3 == 1, "tool: Tool").otherwise("x")
    local = F.when(k % 5 == 0, "tool = object()").otherwise("pass")
    one = t.nation.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".py")).alias("path"), F.lit(_NATION).alias("text"))
    two = t.customer.select(F.concat(F.lit("c"), k, F.lit(".py")).alias("path"), F.format_string(_CUSTOMER, F.col("c_nationkey").cast("string"), parameter, local).alias("text"))
    files = one.union(two)
    facts = receivers.cut(pycode.facts(files), "code-facts")
    return facts, receivers.cut(resolution.modules(files), "code-modules")


@query("""WITH c AS (SELECT 'c' || c_custkey AS m, 'n' || c_nationkey AS n, c_custkey AS k FROM customer)
SELECT m || '.C.__init__' AS src, n || '.make' AS dst, 'calls' AS kind, 'confirmed' AS status FROM c
UNION ALL SELECT m || '.C.go', n || '.Tool.use', 'calls', 'static_inferred' FROM c UNION ALL SELECT m || '.C.go', n || '.Base.act', 'calls', 'static_inferred' FROM c
UNION ALL SELECT m || '.C.go', n || '.Tool.run', 'calls', 'static_inferred' FROM c WHERE k % 3 <> 0 AND k % 5 <> 0
UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey || '.Tool', 'instantiates', 'confirmed' FROM nation UNION ALL SELECT 'n' || n_nationkey || '.make', 'n' || n_nationkey || '.Tool', 'instantiates', 'confirmed' FROM nation""")
def call_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by their receivers' types: annotations, factories, imported instances, and what hides them."""
    return receivers.call_targets(*code(spark, sf_dir))


@query("""WITH c AS (SELECT 'c' || c_custkey AS m, 'n' || c_nationkey AS n FROM customer)
SELECT m || '.py' AS path, '0' AS slot, n || '.Base.act' AS symbol FROM c UNION ALL SELECT m || '.py', '1', m || '.C.go' FROM c UNION ALL SELECT m || '.py', 'key', n || '.make' FROM c""")
def callback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions handed to calls: through an attribute's type, through partial, by name."""
    return receivers.callback_targets(*code(spark, sf_dir)).select("path", "slot", "symbol")


@query("SELECT event_id::VARCHAR AS id, epoch_us(ts) / 1000000.0 AS ts, event_type = 'error' AS limited FROM events WHERE epoch_us(ts) >= (SELECT median(epoch_us(ts)) FROM events)")
def recent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events appended to a log by type, and the later half read back: files that end before are not opened."""
    import uuid

    e = Tables(spark, sf_dir).events.select(F.col("event_id").cast("string").alias("tool_use_id"), (F.expr("unix_micros(cast(ts as timestamp))") / 1_000_000).alias("ts"), F.col("event_type").alias("event"), (F.col("event_type") == "error").alias("rate_limited"))
    at = f"{graphs.shared(spark)}/log-{uuid.uuid4().hex}"
    eventlog.append(e.repartitionByRange(8, "ts"), at)
    since = e.agg(F.median("ts")).first()[0]
    return eventlog.read(spark, at, since).select(F.col("tool_use_id").alias("id"), "ts", F.col("rate_limited").alias("limited"))
