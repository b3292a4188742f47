"""What a change of files touches, and how a run goes on after it: impact, churn, modes, actions and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import text as T
from quarrygraph.operators import joins
from quarrygraph.operators.projection import is_build_file

# From which share of changed files on a whole new analysis is due; what an error's class does to an action.
CHURN = 0.4
POLICY = {"denied": "stop", "rate_limit": "wait", "auth": "stop", "network": "retry", "not_found": "fail", "invalid_request": "fail", "unknown": "retry"}


def touched(changes: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, how): nodes with evidence (id, file) in changed files (path) are direct, their neighbours near."""
    direct = evidence.join(changes.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("id").distinct()
    near = joins.one_hop(edges, direct.select(F.col("id").alias("v"))).select(F.col("v").alias("id"))
    return direct.withColumn("how", F.lit("direct")).union(near.withColumn("how", F.lit("near")))


def touched_subsystems(changes: DataFrame, subsystems: DataFrame) -> DataFrame:
    """(path, subsystem): changed files by the longest path of a subsystem that holds them."""
    paths = subsystems.select(F.col("id").alias("subsystem"), F.explode("paths").alias("__p")).select("subsystem", F.regexp_replace("__p", "/+$", "").alias("__p"))
    return joins.longest_prefix(changes.select("path").distinct(), "path", "path", paths, "__p", "subsystem")


def touched_views(shown: DataFrame, ids: DataFrame) -> DataFrame:
    """(view, hits): views with how many of their members (view, id) are touched (id)."""
    return shown.join(ids.select("id").distinct(), "id").groupBy("view").agg(F.count(F.lit(1)).alias("hits"))


def mode(changes: DataFrame, files: DataFrame) -> DataFrame:
    """One row (changed, files, churn, build, mode): none without changes, full from a share of CHURN or where a file of the build changed, else partial."""
    c = changes.agg(F.count(F.lit(1)).alias("changed"), F.coalesce(F.bool_or(is_build_file(F.col("path"))), F.lit(False)).alias("build"))
    n = files.agg(F.count(F.lit(1)).alias("files"))
    x = c.join(F.broadcast(n))  # one row each
    share = F.round(F.col("changed") / F.greatest("files", F.lit(1)), 3)
    return x.select("changed", "files", share.alias("churn"), "build", F.when(F.col("changed") == 0, "none").when((share >= CHURN) | F.col("build"), "full").otherwise("partial").alias("mode"))


def areas(stale: DataFrame, subsystems: DataFrame) -> DataFrame:
    """(area): stale findings files and touched subsystems, each once."""
    return stale.select(F.col("file").alias("area")).union(subsystems.select(F.col("subsystem").alias("area"))).distinct()


def carried(state: DataFrame, how: str) -> DataFrame:
    """State rows (id, status, attempts, ...) at the start of a run: fresh forgets all, resume keeps all, update keeps what is placed or verified and sets the rest back to pending."""
    if how == "fresh":
        return state.where("false")
    if how == "resume":
        return state
    keep = F.col("status").isin("placed", "verified")
    return state.withColumns({"status": F.when(keep, F.col("status")).otherwise("pending"), "attempts": F.when(keep, F.col("attempts")).otherwise(0)})


def outcome(error: Column, attempts: Column, retries: int = 2) -> Column:
    """What follows an error message: wait, retry (fail after the retries), fail or stop, by its class; nothing for no error."""
    policy = F.create_map(*[F.lit(x) for kv in POLICY.items() for x in kv])
    kind = F.when(F.lower(error).rlike(r"\bdenied by\b|budget exhausted"), "denied").otherwise(T.error_class(error))
    what = policy[kind]
    return F.when(error.isNull(), None).when((what == "retry") & (attempts >= retries), "fail").otherwise(what)


def subtree(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """(id, above, steps): each node (id, parent) with all that lie above it, itself first, at most depth steps; doubling, so rounds are the logarithm of the depth. Circles end at the depth."""
    near = nodes.select("id", F.col("id").alias("above"), F.lit(0).alias("steps"))
    ways = nodes.where("parent is not null").select("id", F.col("parent").alias("above"), F.lit(1).alias("steps"))
    span = 1
    while span < depth:
        far = ways.join(ways.select(F.col("id").alias("above"), F.col("above").alias("__a"), F.col("steps").alias("__s")), "above").select("id", F.col("__a").alias("above"), (F.col("steps") + F.col("__s")).alias("steps"))
        ways = ways.union(far).where(F.col("steps") <= depth).groupBy("id", "above").agg(F.min("steps").alias("steps"))
        span *= 2
    return near.union(ways.where("id <> above"))


def subtree_text(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """(id, text): the texts of a node (id, parent, text) and of all below it, by depth and id."""
    said = subtree(nodes.select("id", "parent"), depth).join(nodes.select("id", "text"), "id").where("text <> ''")
    x = said.groupBy("above").agg(F.array_sort(F.collect_list(F.struct("steps", "id", "text"))).alias("l"))
    return x.select(F.col("above").alias("id"), F.array_join(F.transform("l", lambda r: r["text"]), " ").alias("text"))


def answers(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """rows with found: all distinct matches of a pattern's first group in a result's text, in order."""
    return rows.withColumn("found", F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))))


def board_key(url: Column) -> Column:
    """The key of a board's address."""
    return F.nullif(F.regexp_extract(url, r"/(?:board|file|design)/([A-Za-z0-9]+)", 1), F.lit(""))


def call_estimate(plan: DataFrame, state: DataFrame) -> DataFrame:
    """(purpose, calls): views (id, hash) that are still to draw, to change, to place and to verify against the state (id, status, hash)."""
    s = state.select("id", F.col("status").alias("__s"), F.col("hash").alias("__h"))
    x = plan.join(s, "id", "left")
    purpose = (
        F.when(F.col("__s").isNull() | F.col("__s").isin("pending", "failed"), "generate")
        .when(~F.col("__h").eqNullSafe(F.col("hash")), "regenerate")
        .when(F.col("__s") == "generated", "place")
        .when(F.col("__s") == "placed", "verify")
    )
    return x.where(purpose.isNotNull()).groupBy(purpose.alias("purpose")).agg(F.count(F.lit(1)).alias("calls"))


def upgraded(state: DataFrame, defaults: dict) -> DataFrame:
    """State of an older form: columns that it lacks are added and nulls filled with their defaults."""
    for name, value in defaults.items():
        state = state.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in state.columns else F.lit(value))
    return state
