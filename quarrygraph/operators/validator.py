"""Rules of a whole model: each is a query for what breaks it, (severity, rule, entity, message); the result is their union.

A rule reads only the tables that it names; tables that a model lacks are left out of the dictionary and their rules with them.
nodes (id, name, kind, subsystem, parent, evidence), edges (id, src, dst, kind, phase, evidence), evidence (id, file,
line_start, line_end, status, source), subsystems (id, name), steps (flow, pos, src, dst, kind), stages (flow, node,
role), algorithm_stages (algorithm, id, kind), algorithm_links (algorithm, src, dst), states (machine, state, initial),
transitions (machine, src, dst), entities (id), relations (src, dst).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.operators.evidence import STATUSES
from quarrygraph.operators.projection import EDGE_KINDS, NODE_KINDS, PHASES

# Words that fields of a model may hold.
SOURCES = ["ast", "regex", "manifest", "claude", "doc", "runtime"]
STEP_KINDS = ["call", "return", "async", "event", "decision", "loop", "error", "io"]
ROLES = ["input", "transform", "intermediate", "storage", "output"]
STAGE_KINDS = ["step", "decision", "loop", "io", "terminal", "error"]


def _issue(df: DataFrame, severity: str, rule: str, entity: Column, message: Column | str) -> DataFrame:
    said = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), said.alias("message"))


def _word(df: DataFrame, column: str, words: list[str], entity: Column, what: str, null_ok: bool = False) -> DataFrame:
    known = F.coalesce(F.col(column).isin(words), F.lit(null_ok))
    return _issue(df.where(~known), "error", f"unknown-{what}", entity, F.concat(F.lit(f"{what} "), F.coalesce(column, F.lit("none")), F.lit(" is not known")))


def _twice(df: DataFrame, key: str, what: str) -> DataFrame:
    return _issue(df.groupBy(key).count().where("count > 1"), "error", f"duplicate-{what}", F.col(key), F.concat(F.col("count").cast("string"), F.lit(f" {what}s have this id")))


def _refers(df: DataFrame, column: str, known: DataFrame, key: str, entity: Column, rule: str, severity: str = "error") -> DataFrame:
    """Values of a column that no known row has."""
    to = known.select(F.col(key).alias("__k")).distinct()
    x = df.where(F.col(column).isNotNull()).withColumn("__k", F.col(column)).join(to, "__k", "left_anti")
    return _issue(x, severity, rule, entity, F.concat(F.lit(f"{column} "), F.col(column).cast("string"), F.lit(" does not exist")))


def _empty(df: DataFrame, column: str, entity: Column, what: str) -> DataFrame:
    return _issue(df.where(F.coalesce(F.col(column), F.lit("")) == ""), "error", f"{what}-without-{column}", entity, f"{column} is empty")


def problems(model: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """(severity, rule, entity, message) of all rules; strict makes missing evidence an error."""
    found: list[DataFrame] = []
    has = lambda *names: all(n in model for n in names)
    t, ident = model, F.col("id")
    miss = "error" if strict else "warning"
    if has("nodes"):
        n = t["nodes"]
        found += [_empty(n, "id", F.col("name"), "node"), _empty(n, "name", ident, "node"), _word(n, "kind", NODE_KINDS, ident, "node-kind"), _twice(n, "id", "node"), _refers(n, "parent", n, "id", ident, "unknown-parent")]
        found += [_issue(n.where("parent = id"), "error", "own-parent", ident, "a node is its own parent"), _issue(n.where(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) == 0), miss, "node-without-evidence", ident, "no evidence")]
    if has("nodes", "subsystems"):
        found += [_refers(t["nodes"], "subsystem", t["subsystems"], "id", ident, "unknown-subsystem"), _empty(t["subsystems"], "name", ident, "subsystem"), _twice(t["subsystems"], "id", "subsystem")]
    if has("edges"):
        e = t["edges"]
        found += [_word(e, "kind", EDGE_KINDS, ident, "edge-kind"), _word(e, "phase", PHASES, ident, "phase", True), _twice(e, "id", "edge")]
        found += [_issue(e.where("src = dst and kind in ('imports', 'inherits')"), "error", "edge-to-itself", ident, "an edge of this kind leads to itself"), _issue(e.where(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) == 0), miss, "edge-without-evidence", ident, "no evidence")]
        found += [_issue(e.where(ident != F.concat(F.lit("e:"), "kind", F.lit(":"), "src", F.lit(">"), "dst")), "error", "edge-id", ident, "the id does not tell kind and ends")]
    if has("edges", "nodes"):
        found += [_refers(t["edges"], end, t["nodes"], "id", ident, "unknown-end") for end in ("src", "dst")]
    if has("evidence"):
        v = t["evidence"]
        found += [_word(v, "status", STATUSES, ident, "status"), _word(v, "source", SOURCES, ident, "source"), _empty(v, "file", ident, "evidence"), _twice(v, "id", "evidence")]
        found += [_issue(v.where("line_start < 1 or line_end < line_start"), "error", "line-range", ident, "lines are out of order")]
        for owner in ("nodes", "edges"):
            if has(owner):
                found.append(_refers(t[owner].select("id", F.explode("evidence").alias("evidence_id")), "evidence_id", v, "id", ident, "unknown-evidence"))
    if has("steps"):
        found.append(_word(t["steps"], "kind", STEP_KINDS, F.col("flow"), "step-kind"))
        if has("nodes"):
            found += [_refers(t["steps"], end, t["nodes"], "id", F.col("flow"), "step-of-no-node") for end in ("src", "dst")]
    if has("stages"):
        found.append(_word(t["stages"], "role", ROLES, F.col("flow"), "role"))
        if has("nodes"):
            found.append(_refers(t["stages"], "node", t["nodes"], "id", F.col("flow"), "stage-of-no-node"))
    if has("algorithm_stages"):
        found.append(_word(t["algorithm_stages"], "kind", STAGE_KINDS, F.col("algorithm"), "stage-kind"))
        if has("algorithm_links"):
            s = t["algorithm_stages"].select(F.concat_ws("\u0001", "algorithm", "id").alias("k"))
            for end in ("src", "dst"):
                link = t["algorithm_links"].withColumn(f"stage_{end}", F.concat_ws("\u0001", "algorithm", end))
                found.append(_refers(link, f"stage_{end}", s, "k", F.col("algorithm"), "transition-of-no-stage"))
    if has("states", "transitions"):
        s = t["states"].select(F.concat_ws("\u0001", "machine", "state").alias("k"))
        for end in ("src", "dst"):
            found.append(_refers(t["transitions"].withColumn(f"state_{end}", F.concat_ws("\u0001", "machine", end)), f"state_{end}", s, "k", F.col("machine"), "transition-of-no-state"))
        none = t["states"].groupBy("machine").agg(F.count_if("initial").alias("n")).where("n <> 1")
        found.append(_issue(none, "error", "initial-state", F.col("machine"), "a machine needs one initial state"))
    if has("entities", "relations"):
        found += [_refers(t["relations"], end, t["entities"], "id", F.concat(F.col("src"), F.lit(">"), F.col("dst")), "relation-of-no-entity") for end in ("src", "dst")]
        found.append(_twice(t["entities"], "id", "entity"))
    return reduce(DataFrame.unionByName, found)


def summary(issues: DataFrame) -> DataFrame:
    """(rule, severity, n): how often each rule is broken."""
    return issues.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
