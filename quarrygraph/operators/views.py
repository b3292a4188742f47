"""Views of a graph within limits of readability: labels, fitting, finals, dependency cycles, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.operators import graphs


def suffix_labels(rows: DataFrame, group: str, key: str, path: str, rounds: int = 8) -> DataFrame:
    """(group, key, label): a path's last part, and one part more in each round for all that still clash within their group.

    Each round counts the labels of the round before, so members of a clash deepen together; the rounds are a fixed
    number of window counts, without a driver loop over data. What still clashes after the last round stays so.
    """
    parts = F.split(F.col(path), "/")
    deep = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.size(parts)), "/")
    x = rows.withColumn("__n", F.lit(1))
    for _ in range(rounds - 1):
        x = x.withColumn("label", deep(F.col("__n")))
        clash = F.count(F.lit(1)).over(Window.partitionBy(group, "label")) > 1
        x = x.withColumn("__n", F.when(clash, F.col("__n") + 1).otherwise(F.col("__n")))
    return x.select(group, key, deep(F.col("__n")).alias("label"))


def collapse_channels(edges: DataFrame, channels: DataFrame) -> DataFrame:
    """edges (view, src, dst, weight, weak) with channels (view, id) replaced by edges from each producer to each consumer, self pairs left out."""
    # both ends are marked once; all else tells by the marks
    e = edges.select("view", "src", "dst", "weight", "weak")
    for end in ("src", "dst"):
        e = e.join(channels.select("view", F.col("id").alias(end), F.lit(True).alias(f"__{end}")).distinct(), ["view", end], "left")
    e = graphs.cut(e.fillna(False, ["__src", "__dst"]), "marked")
    into = e.where("__dst and not __src").select("view", "src", F.col("dst").alias("ch"), "weight")
    through = into.join(e.where("__src and not __dst").select("view", F.col("src").alias("ch"), "dst"), ["view", "ch"])
    both = e.where("not __src and not __dst").select("view", "src", "dst", "weight", "weak").union(through.where("src <> dst").select("view", "src", "dst", "weight", F.lit(False)))
    return both.groupBy("view", "src", "dst").agg(F.sum("weight").alias("weight"), F.bool_and("weak").alias("weak"))


def _inside(edges: DataFrame, units: DataFrame) -> DataFrame:
    u = units.select("view", "id")
    for end in ("src", "dst"):
        edges = edges.join(u.withColumnRenamed("id", end), ["view", end], "left_semi")
    return edges.select("view", "src", "dst", "weight", "weak")


def fit(units: DataFrame, edges: DataFrame, max_nodes: int = 25, max_edges: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units (view, id, kind, label, pinned) and edges (view, src, dst, weight, weak) of many views within limits; (units, edges, notes).

    Each step acts only on views that are still too large: settings go, channels become direct edges, the units of least
    degree go (pinned first, then degree, label, id), then edges go, weak ones first, then by weight. notes: (view,
    step, n). The limits are the feature; what they leave out is counted.
    """
    notes = []

    def drop(kind: Column, step: str):
        nonlocal units
        # sizes by counts: a window over a view would put all of it into one task
        large = F.broadcast(units.groupBy("view").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_nodes).select("view", F.lit(True).alias("__large")))
        marked = units.join(large, "view", "left").withColumn("__drop", F.coalesce(F.col("__large") & kind & ~F.col("pinned"), F.lit(False))).drop("__large").select(*units.columns, "__drop")
        gone = marked.where("__drop").select("view", "id")
        notes.append(gone.groupBy("view").agg(F.count(F.lit(1)).alias("n")).select("view", F.lit(step).alias("step"), "n"))
        units = marked.where("not __drop").drop("__drop")
        return gone

    drop(F.col("kind") == "config", "settings left out")
    edges = edges.select("view", "src", "dst", "weight", "weak")
    channels = drop(F.col("kind") == "channel", "channels drawn as direct edges")
    edges = graphs.cut(_inside(collapse_channels(edges, channels), units), "inside")
    ends = edges.select("view", F.explode(F.array("src", "dst")).alias("id"))
    degree = ends.groupBy("view", "id").agg(F.count(F.lit(1)).alias("__deg"))
    ranked = units.join(degree, ["view", "id"], "left").fillna(0, ["__deg"])
    rank = F.row_number().over(Window.partitionBy("view").orderBy(F.desc("pinned"), F.desc("__deg"), "label", "id"))
    ranked = ranked.withColumn("__rank", rank)
    notes.append(ranked.where(F.col("__rank") > max_nodes).groupBy("view").agg(F.count(F.lit(1)).alias("n")).select("view", F.lit("least connected left out").alias("step"), "n"))
    units = ranked.where(F.col("__rank") <= max_nodes).select(*units.columns)
    order = Window.partitionBy("view").orderBy(F.col("weak").asc(), F.desc("weight"), F.desc("src"), F.desc("dst"))
    numbered = _inside(edges, units).withColumn("__rank", F.row_number().over(order))
    notes.append(numbered.where(F.col("__rank") > max_edges).groupBy("view").agg(F.count(F.lit(1)).alias("n")).select("view", F.lit("edges left out").alias("step"), "n"))
    edges = numbered.where(F.col("__rank") <= max_edges).drop("__rank")
    return units, edges, notes[0].union(notes[1]).union(notes[2]).union(notes[3])


def finals(transitions: DataFrame, initial: DataFrame) -> DataFrame:
    """(view, state): states without a way out that are not initial (view, state)."""
    states = transitions.select("view", F.col("dst").alias("state")).union(transitions.select("view", F.col("src").alias("state"))).distinct()
    return states.join(transitions.select("view", F.col("src").alias("state")), ["view", "state"], "left_anti").join(initial, ["view", "state"], "left_anti").select("view", "state")


def flow_ends(links: DataFrame) -> DataFrame:
    """(view, node, role) of data-flow links (view, src, dst): source without a way in, sink without a way out, else process; self links do not count."""
    l = links.where("src <> dst")
    n = links.select("view", F.col("src").alias("node")).union(links.select("view", F.col("dst").alias("node"))).distinct()
    outs, ins = (l.select("view", F.col(c).alias("node"), F.lit(True).alias(f"has_{c}")).distinct() for c in ("src", "dst"))
    role = F.when(F.col("has_dst").isNull() & F.col("has_src").isNotNull(), "source").when(F.col("has_src").isNull() & F.col("has_dst").isNotNull(), "sink").otherwise("process")
    return n.join(outs, ["view", "node"], "left").join(ins, ["view", "node"], "left").select("view", "node", role.alias("role"))


def import_cycles(edges: DataFrame) -> DataFrame:
    """edges (src, dst) with in_cycle: both ends lie in one strong component."""
    c = graphs.strong_components(edges)
    a, b = (c.select(F.col("v").alias(e), F.col("component").alias(f"__{e}")) for e in ("src", "dst"))
    return edges.join(a, "src", "left").join(b, "dst", "left").select(*edges.columns, F.coalesce(F.col("__src") == F.col("__dst"), F.lit(False)).alias("in_cycle"))


def subsumed(views: DataFrame, slack: int = 3) -> DataFrame:
    """(a, b): views (view, level, nodes, pairs) of which all nodes and undirected pairs are in b of the same level, which is at most slack larger.

    Views meet by the node of a that fewest views hold, so a node in all views makes no square of them.
    """
    n = views.select("view", F.explode("nodes").alias("node"))
    rare = n.join(n.groupBy("node").agg(F.count(F.lit(1)).alias("k")), "node").groupBy("view").agg(F.min_by("node", F.struct("k", "node")).alias("node"))
    a = views.join(rare, "view").select(F.col("view").alias("a"), "level", "node", F.col("nodes").alias("an"), F.col("pairs").alias("ap"))
    b = n.join(views, "view").select(F.col("view").alias("b"), "level", "node", F.col("nodes").alias("bn"), F.col("pairs").alias("bp"))
    within = (F.size(F.array_except("an", "bn")) == 0) & (F.size(F.array_except("ap", "bp")) == 0) & (F.size("bn") <= F.size("an") + slack)
    return a.join(b, ["level", "node"]).where("a <> b").where(within).select("a", "b")
