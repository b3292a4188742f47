"""Findings joined to a scanned model: admission with reasons, merges of several sources, pruning, relations of tables, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.operators import joins
from quarrygraph.operators.projection import EDGE_KINDS, NODE_KINDS, PHASES, climbed


def sources_in_order(files: DataFrame, scan: str) -> DataFrame:
    """(file, source): the scan is source 0, findings follow by file name."""
    row = F.row_number().over(Window.orderBy(F.col("file") != scan, "file")) - 1  # one row a file
    return files.select("file").distinct().withColumn("source", row)


def admitted_nodes(found: DataFrame, known: DataFrame) -> DataFrame:
    """found (id, source, kind, name, evidence) with reason (null: admitted): new nodes need a known kind, a name and accepted evidence; known ones may come without."""
    x = found.join(known.select("id", F.lit(True).alias("__known")).distinct(), "id", "left")
    new, said = F.col("__known").isNull(), F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0
    reason = (
        F.when(F.coalesce("id", F.lit("")) == "", "missing id")
        .when(F.col("kind").isNotNull() & ~F.col("kind").isin(NODE_KINDS), "unknown kind")
        .when(new & F.col("kind").isNull(), "new node without kind")
        .when(new & (F.coalesce("name", F.lit("")) == ""), "new node without name")
        .when(new & ~said, "new node without accepted evidence")
    )
    return x.select(*found.columns, reason.alias("reason"))


def admitted_edges(found: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """found (src, dst, kind, source, phase, evidence) with reason: kinds and phases are known words, ends are nodes, new edges have accepted evidence."""
    x = found.join(known.select("src", "dst", "kind", F.lit(True).alias("__known")).distinct(), ["src", "dst", "kind"], "left")
    for end in ("src", "dst"):
        x = x.join(nodes.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")).distinct(), end, "left")
    said = F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(EDGE_KINDS), F.lit(False)), "unknown kind")
        .when(F.col("phase").isNotNull() & ~F.col("phase").isin(PHASES), "unknown phase")
        .when(F.col("__src").isNull() | F.col("__dst").isNull(), "end is no node")
        .when((F.col("src") == F.col("dst")) & F.col("kind").isin("imports", "inherits"), "edge to itself")
        .when(F.col("__known").isNull() & ~said, "new edge without accepted evidence")
    )
    return x.select(*found.columns, reason.alias("reason"))


def admitted_parts(parts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of structures (structure, source, pos, node, refused) that stay, and (structure, dropped): those whose evidence was refused or whose node is unknown. Of a structure given twice the last source's parts are meant."""
    last = parts.groupBy("structure").agg(F.max("source").alias("source"))
    x = parts.join(last, ["structure", "source"], "left_semi").join(nodes.select(F.col("id").alias("node"), F.lit(True).alias("__n")).distinct(), "node", "left")
    bad = F.coalesce("refused", F.lit(False)) | (F.col("node").isNotNull() & F.col("__n").isNull())
    marked = x.withColumn("__bad", bad)
    return marked.where("not __bad").select(parts.columns), marked.where("__bad").groupBy("structure").agg(F.count(F.lit(1)).alias("dropped"))


def _all(column: str) -> Column:
    empty = F.array().cast("array<string>")
    every = F.array_sort(F.collect_list(F.struct("source", F.coalesce(column, empty).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(every, lambda s: s.v))).alias(column)


def merged_nodes(rows: DataFrame) -> DataFrame:
    """One row an id of rows (id, source, kind, name, subsystem, parent, file, tags, evidence): the scan's kind wins, later sources refine name and move the subsystem, lists are joined in order of sources."""
    at = F.struct("source")
    last = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", at)).alias(c)
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", at)).alias(c)
    x = rows.groupBy("id").agg(first("kind"), last("name"), last("subsystem"), first("parent"), first("file"), _all("tags"), _all("evidence"), F.countDistinct("kind").alias("kinds"))
    return x.withColumns({"tags": F.array_sort("tags"), "kind_conflict": F.col("kinds") > 1}).drop("kinds")


def merged_edges(rows: DataFrame) -> DataFrame:
    """One row (src, dst, kind) of rows with source, label, phase, payload, evidence: the last given label, the last phase that is not unknown, lists joined; edges of a kind that can't turn back on itself are dropped."""
    at = F.struct("source")
    label = F.max_by("label", F.when(F.coalesce(F.col("label"), F.lit("")) != "", at)).alias("label")
    phase = F.coalesce(F.max_by("phase", F.when(F.coalesce(F.col("phase"), F.lit("unknown")) != "unknown", at)), F.lit("unknown")).alias("phase")
    x = rows.where(~((F.col("src") == F.col("dst")) & F.col("kind").isin("imports", "inherits")))
    x = x.groupBy("src", "dst", "kind").agg(label, phase, _all("payload"), _all("evidence"))
    return x.withColumns({"id": F.concat(F.lit("e:"), "kind", F.lit(":"), "src", F.lit(">"), "dst"), "payload": F.array_sort("payload")})


# Kinds that lie across subsystems and never take one from where they are.
ACROSS = ["topic", "event_channel", "datastore", "external_service", "tf_frame", "db_entity", "ros_service", "ros_action", "deployment_unit"]


def built_nodes(nodes: DataFrame, subsystems: DataFrame) -> DataFrame:
    """nodes with parents and subsystems that exist: unknown ones are nulled; then a node without a subsystem has its
    parent's, whatever that comes from, else that of the longest path that holds its file. Kinds that lie ACROSS neither
    take nor pass on one that isn't said. In a circle of parents each has its own file's."""
    n = nodes.join(nodes.select(F.col("id").alias("parent"), F.lit(True).alias("__p")), "parent", "left").withColumn("parent", F.when(F.col("__p"), F.col("parent")))
    n = n.join(subsystems.select(F.col("id").alias("subsystem"), F.lit(True).alias("__s")), "subsystem", "left").withColumn("subsystem", F.when(F.col("__s"), F.col("subsystem"))).select(nodes.columns)
    paths = subsystems.select(F.col("id").alias("__sub"), F.explode("paths").alias("__path")).select("__sub", F.regexp_replace("__path", "/+$", "").alias("__path"))
    across = F.col("kind").isin(ACROSS)
    by_path = joins.longest_prefix(n.where(F.col("subsystem").isNull() & ~across & F.col("file").isNotNull()), "id", "file", paths, "__path", "__sub")
    own = n.join(by_path, "id", "left").select("id", F.col("parent").alias("up"), (F.col("subsystem").isNotNull() | across | F.col("parent").isNull()).alias("ends"), F.coalesce("subsystem", "__sub").alias("val"))
    above = climbed(own).select("id", F.col("val").alias("__above"))
    return n.join(above, "id", "left").withColumn("subsystem", F.coalesce("subsystem", F.when(~across, F.col("__above")))).select(nodes.columns)


def renamed(edges: DataFrame, to: DataFrame, keys: list[str] = ("src", "dst", "kind")) -> DataFrame:
    """edges with ends rewritten by to (old, new), each pair of ends and kind once (the least other values stay), pairs that became loops left out."""
    x = edges
    for end in ("src", "dst"):
        x = x.join(to.select(F.col("old").alias(end), F.col("new").alias("__new")), end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    rest = [c for c in edges.columns if c not in keys]
    same = x.where("src <> dst").groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest])
    return same.select(edges.columns)


def orphans(nodes: DataFrame, edges: DataFrame, referred: DataFrame, kinds: list[str]) -> DataFrame:
    """nodes of kinds without an edge, a child and a reference (id) of a structure."""
    used = edges.select(F.explode(F.array("src", "dst")).alias("id")).union(nodes.where("parent is not null").select(F.col("parent").alias("id"))).union(referred.select("id"))
    return nodes.where(F.col("kind").isin(kinds)).join(used.distinct(), "id", "left_anti").select(nodes.columns)


def foreign_keys(entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """(src, dst, via): one-to-many relations from the entity that an attribute (entity, name, references) refers to, to the entity that has it.

    A reference names an entity (id, name, pos) as it is, in lower case or with an s; the first entity by pos is meant.
    An entity may refer to itself; unknown references give nothing, and the same relation said twice is one.
    """
    table = F.regexp_extract("references", r"^([^.(]+)", 1)
    a = attributes.where("references is not null").select("entity", F.col("name").alias("via"), "references", F.explode(F.array_distinct(F.array(table, F.lower(table), F.concat(table, F.lit("s"))))).alias("__name"))
    hit = a.join(entities.select(F.col("id").alias("src"), F.col("name").alias("__said"), "pos"), F.col("__name") == F.col("__said"))
    best = hit.groupBy("entity", "via", "references").agg(F.min_by("src", "pos").alias("src"))
    return best.select("src", F.col("entity").alias("dst"), "via").distinct()


def entities(scanned: DataFrame, given: DataFrame) -> DataFrame:
    """(id, name, attributes, from): entities of findings win over those of the scan."""
    s, g = (df.select("id", F.struct("name", "attributes").alias(c)) for df, c in ((scanned, "s"), (given, "g")))
    x = s.join(g, "id", "full")
    return x.select("id", F.coalesce("g.name", "s.name").alias("name"), F.coalesce("g.attributes", "s.attributes").alias("attributes"), F.when(F.col("g").isNotNull(), "findings").otherwise("scan").alias("from"))


def subsystem_id(name: Column) -> Column:
    """An id with its prefix."""
    return F.when(name.startswith("sub:"), name).otherwise(F.concat(F.lit("sub:"), name))


def template() -> dict:
    """The shape of a findings file: every list empty."""
    return {k: [] for k in ("subsystems", "nodes", "edges", "flows", "dataflows", "algorithms", "state_machines", "uncertainties")} | {"erd": {"entities": [], "relations": []}}
