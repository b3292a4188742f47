"""Robot nodes and their interfaces: topics, services, actions, timers, parameters and frames, from facts of Python and C++ files and of launch files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.names import topic
from quarrygraph.operators import joins
from quarrygraph.sources.scanner import scanned

# Calls that make interfaces: edge kind, kind of the other end, place of the name among the arguments, of the callback.
INTERFACES = {
    "create_publisher": ("publishes", "topic", 1, None),
    "create_subscription": ("subscribes", "topic", 1, 2),
    "create_service": ("service_provide", "ros_service", 1, 2),
    "create_client": ("service_call", "ros_service", 1, None),
    "ActionServer": ("action_provide", "ros_action", 2, 3),
    "ActionClient": ("action_call", "ros_action", 2, None),
    "declare_parameter": ("config_dependency", "config", 0, None),
    "create_timer": ("triggers", "timer", 0, 1),
}
# The forms of the same in C++.
_T = r"<\s*(?P<detail>[\w:]+)[^>]*>"
CPP = [
    (fact, re.compile(pattern))
    for fact, pattern in [
        ("node", r"(?::\s*|\b)(?:rclcpp::)?(?:Node|LifecycleNode)\s*\(\s*\"(?P<name>[^\"]+)\""),
        ("node", r"\bmake_shared\s*<\s*rclcpp::Node\s*>\s*\(\s*\"(?P<name>[^\"]+)\""),
        ("create_publisher", rf"\bcreate_publisher\s*{_T}\s*\(\s*\"(?P<name>[^\"]+)\""),
        ("create_subscription", rf"\bcreate_subscription\s*{_T}\s*\(\s*\"(?P<name>[^\"]+)\"[^;]*?(?:&\s*(?P<target>[\w:]+))?"),
        ("create_service", rf"\bcreate_service\s*{_T}\s*\(\s*\"(?P<name>[^\"]+)\""),
        ("create_client", rf"\bcreate_client\s*{_T}\s*\(\s*\"(?P<name>[^\"]+)\""),
        ("ActionServer", rf"\bcreate_server\s*{_T}\s*\(\s*[^,]*,\s*\"(?P<name>[^\"]+)\""),
        ("ActionClient", rf"\bcreate_client\s*{_T}\s*\(\s*[^\",]+,\s*\"(?P<name>[^\"]+)\""),
        ("declare_parameter", r"\bdeclare_parameter\s*(?:<[^>]*>)?\s*\(\s*\"(?P<name>[^\"]+)\""),
        ("parent_frame", r"(?P<target>\w+)(?:\.|->)header(?:\.|->)frame_id\s*=\s*\"(?P<name>[^\"]+)\""),
        ("child_frame", r"(?P<target>\w+)(?:\.|->)child_frame_id\s*=\s*\"(?P<name>[^\"]+)\""),
    ]
]


def _argument(place: str, kind: str) -> Column:
    args = "from_json(detail, 'array<struct<slot:string,kind:string,text:string>>')"
    return F.expr(f"get(filter({args}, x -> x.slot = '{place}' and x.kind in ({kind})), 0).text")


def declared(calls: DataFrame, cpp: DataFrame) -> DataFrame:
    """(path, line, name, cls): declarations of nodes: the name that a Python class hands up, with the class, or that C++ gives."""
    up = calls.where("fact = 'call' and target in ('super().__init__', 'Node.__init__', 'Node', 'rclpy.create_node', 'rclpy.node.Node')").withColumn("name", _argument("0", "'string'"))
    up = in_class(up.where("name is not null").select("path", "line", "name", "owner"), calls).select("path", "line", "name", "cls")
    return up.union(cpp.where("fact = 'node'").select("path", "line", "name", F.lit(None).cast("string"))).distinct()


def interfaces(calls: DataFrame, cpp: DataFrame) -> DataFrame:
    """(path, line, kind, other, name, callback, cls): calls that make interfaces, with the class that they are in, of facts of Python files (pycode) and C++ files (cpp_facts); names are absolute."""
    out = None
    for word, (kind, other, place, callback) in INTERFACES.items():
        py = calls.where((F.col("fact") == "call") & (F.substring_index("target", ".", -1) == word))
        name = _argument(str(place), "'string'") if other != "timer" else F.coalesce(_argument("0", "'value', 'name'"), F.lit("timer"))
        back = _argument(str(callback), "'name', 'call'") if callback is not None else F.lit(None).cast("string")
        rows = py.select("path", "line", F.lit(kind).alias("kind"), F.lit(other).alias("other"), name.alias("name"), back.alias("callback"), "owner")
        rows = rows.union(cpp.where(F.col("fact") == word).select("path", "line", F.lit(kind), F.lit(other), "name", "target", F.lit("")))
        out = rows if out is None else out.union(rows)
    out = in_class(out, calls).drop("owner")
    absolute = F.when(F.col("other").isin("topic", "ros_service", "ros_action"), topic(F.col("name"), F.lit(""))).otherwise(F.col("name"))
    return out.where("name is not null").withColumn("name", absolute)


def cpp_facts(files: DataFrame) -> DataFrame:
    return scanned(files, ["cc", "cpp", "cxx", "hpp", "hh", "h"], CPP)


def owned(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (path, line, ...) with node, the node that owns them; files without nodes give no rows.

    Where rows have a class (cls) and nodes say theirs, the node of that class owns the row; a class that is no node's
    owns nothing in a file of several nodes (node is null). Else the last node declared at or before the line, else the
    file's first.
    """
    own = F.col("cls") if "cls" in nodes.columns else F.lit(None).cast("string")
    n = nodes.select("path", "line", "name", own.alias("cls")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "cls"))).alias("__n"))  # declarations of one file
    before = F.filter("__n", lambda d: d["line"] <= F.col("line"))
    node = F.coalesce(F.try_element_at(before, F.lit(-1))["name"], F.try_element_at("__n", F.lit(1))["name"])
    if "cls" in rows.columns:
        same = F.try_element_at(F.filter("__n", lambda d: d["cls"] == F.col("cls")), F.lit(1))["name"]
        node = F.when(F.col("cls").isNull(), node).when(same.isNotNull(), same).when(F.size("__n") == 1, node)
    return rows.join(n, "path").withColumn("node", node).drop("__n")


def in_class(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """rows (path, owner, ...) with cls, the class of the file that owner is or lies in (null: none), of facts of Python files."""
    classes = calls.where("fact = 'class'").select("path", F.concat_ws(".", F.nullif("owner", F.lit("")), "name").alias("cls")).distinct()
    parts = F.split("owner", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    x = rows.select("path", "owner").distinct().select("path", "owner", F.explode(above).alias("cls"))
    deepest = x.join(classes, ["path", "cls"]).groupBy("path", "owner").agg(F.max_by("cls", F.length("cls")).alias("cls"))
    return rows.join(deepest, ["path", "owner"], "left")


def frames(rows: DataFrame, within: int = 15) -> DataFrame:
    """(path, parent, child, line): parent and child frames set on one variable at most within lines apart.

    By line (one line: parent first) each variable keeps its last parent and its last child that wait; as soon as both do, they pair, and both
    are used up. line is the earlier of the two. Names lose slashes in front.
    """
    x = rows.where("fact in ('parent_frame', 'child_frame') and name is not null").select("path", F.col("target").alias("var"), "line", "fact", F.regexp_replace("name", "^/+", "").alias("name"))
    x = joins.consumed_pairs(x, ["path", "var"], "line", "fact", "parent_frame", within, [F.desc("fact"), "name"])
    x = x.where("fact = 'child_frame' and pair is not null")
    return x.select("path", F.col("mate.name").alias("parent"), F.col("name").alias("child"), F.least("line", "mate.line").alias("line"))


def launched(calls: DataFrame, files: DataFrame) -> DataFrame:
    """(path, package, executable, name, line): nodes that Python and XML launch files start."""
    py = calls.where("fact = 'call' and path rlike '\\\\.launch\\\\.py$'").where(F.substring_index("target", ".", -1).isin("Node", "LifecycleNode", "ComposableNode"))
    text = lambda slot: _argument(slot, "'string'")
    py = py.select("path", text("package").alias("package"), F.coalesce(text("executable"), text("plugin")).alias("executable"), text("name").alias("name"), "line")
    node = r"<node\b[^>]*>"
    tags = files.where(F.col("path").rlike(r"\.launch(\.xml)?$")).select("path", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(node), F.lit(0))).alias("tag"))
    attr = lambda *names: F.coalesce(*[F.nullif(F.regexp_extract("tag", rf"\b{n}\s*=\s*[\"']([^\"']*)", 1), F.lit("")) for n in names])
    xml = tags.select("path", attr("pkg").alias("package"), attr("exec", "type").alias("executable"), attr("name").alias("name"), F.lit(None).cast("int").alias("line"))
    return py.union(xml).where("executable is not null")


def started(launches: DataFrame, executables: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, node): launched executables (package, executable) by the file that builds them (package, executable, file) and the node declared there; a given name stands for the node's own."""
    x = launches.join(executables.select("package", "executable", F.col("file").alias("__file")), ["package", "executable"], "left")
    own = nodes.groupBy(F.col("path").alias("__file")).agg(F.min_by("name", "line").alias("__own"))
    return x.join(own, "__file", "left").select("path", F.coalesce("__own", "name", "executable").alias("node")).distinct()


def edges(faces: DataFrame) -> DataFrame:
    """(src, dst, kind) of interfaces with their node: subscriptions lead from the topic to the node, all others from the node."""
    prefix = F.create_map(*[F.lit(x) for kv in {"topic": "topic:", "ros_service": "srv:", "ros_action": "action:", "config": "param:", "timer": "timer:"}.items() for x in kv])[F.col("other")]
    far, near = F.concat(prefix, "name"), F.concat(F.lit("ros:"), "node")
    back = F.col("kind").isin("subscribes", "triggers")
    return faces.select(F.when(back, far).otherwise(near).alias("src"), F.when(back, near).otherwise(far).alias("dst"), "kind").distinct()


