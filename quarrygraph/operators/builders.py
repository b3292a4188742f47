"""Views of a model as tables: each builder gives the boxes and arrows of all its views at once, keyed by view, and what it skipped.

A view is (boxes, arrows, skips): boxes (view, id, kind, label, shape, category, group, pinned), arrows (view, src, dst,
label, weight, weak, status, async), skips (view, reason). Views are small by their limits; what is made them from is
not, so all steps are joins and aggregates over whole tables, and only sequential walks of one view go to Python.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.operators import graphs, views
from quarrygraph.operators import projection as P

# Edge kinds that a view follows, shows as ends, or leaves to other views; shapes of stages and roles.
FOLLOWED = ["calls", "instantiates", "spawns", "triggers", "handles", "publishes", "api_request"]
ENDS = ["db_read", "db_write", "db_access", "external_call", "service_call", "action_call"]
DEPLOYMENT = ["depends_on", "launches"]
OVERVIEW_LEAVES_OUT = ["tf_transform", "config_dependency"]
ROBOT_EDGES = ["publishes", "subscribes", "service_call", "service_provide", "action_call", "action_provide"]
ROBOT_KINDS = ["ros_node", "topic", "ros_service", "ros_action"]
STAGE_SHAPES = {"decision": "diamond", "io": "lean_r", "terminal": "stadium", "loop": "hexagon", "error": "rect", "step": "rect"}
ROLE_SHAPES = {"input": "lean_r", "output": "lean_l", "storage": "cylinder", "intermediate": "lean_r", "transform": "rect"}
RANKS = {"confirmed": 0, "dynamic_observed": 1, "static_inferred": 2, "documented_only": 3, "unknown": 4}


class View(NamedTuple):
    boxes: DataFrame
    arrows: DataFrame
    skips: DataFrame


def skipped(df: DataFrame, view: Column, reason: str) -> DataFrame:
    return df.select(view.alias("view"), F.lit(reason).alias("reason"))


def arrows(edges: DataFrame, of: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, src, dst, label, weight, weak, status, async): edges by the units of their ends, pairs within a unit left out.

    Noise kinds draw no arrow, but imports do where no other edge links the pair either way; they are weak. The label is
    the payload-like label of the most frequent kind, the status the strongest.
    """
    u = lambda end: of.select(F.col("id").alias(end), F.col("unit").alias(f"__{end}"))
    x = edges.join(u("src"), "src").join(u("dst"), "dst")
    return linked(x.select(*by, F.col("__src").alias("src"), F.col("__dst").alias("dst"), "kind", "label", "status"), by)


#: What makes an edge between units an arrow.
DRAWN = "src <> dst and kind not in ('inherits', 'config_dependency')"


def linked(x: DataFrame, by: list[str] = ()) -> DataFrame:
    """arrows of edges (by, src, dst, kind, label, status) whose ends are units. Pairs are counted once, as a table; only weak ones look for a strong one the other way."""
    by = list(by)
    rank = P.looked_up({k: str(v) for k, v in RANKS.items()}, F.col("status"), "4").cast("int")
    x = x.where(DRAWN).select(*by, "src", "dst", "kind", F.nullif("label", F.lit("")).alias("label"), rank.alias("r"))
    # counts by hash, then each pair's few rows in one place and order for both steps over them
    x = x.groupBy(*by, "src", "dst", "kind", "label").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r")).repartition(*by, "src", "dst")
    kinds = x.groupBy(*by, "src", "dst", "kind").agg(F.sum("n").alias("n"), F.min("r").alias("r"), F.min("label").alias("label"))
    weak = F.col("kind") == "imports"
    pair = kinds.groupBy(*by, "src", "dst").agg(
        F.min(F.struct(weak.alias("weak"), (-F.col("n")).alias("few"), "kind", "label")).alias("top"), F.sum(F.when(~weak, F.col("n")).otherwise(0)).alias("strong"), F.sum("n").alias("n"), F.min(F.when(~weak, F.col("r"))).alias("r"), F.min("r").alias("any_r"), F.bool_and(weak | F.col("kind").isin(P.ASYNC)).alias("async")
    )
    pair = graphs.cut(pair, "pairs")
    back = pair.where("strong > 0").select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))
    soft = pair.where("strong = 0")
    back = back.join(soft.select(*by, "src", "dst"), [*by, "src", "dst"], "left_semi")
    y = pair.where("strong > 0").union(soft.join(back, [*by, "src", "dst"], "left_anti").select(pair.columns)).withColumn("weak", F.col("strong") == 0)
    status = F.element_at(F.array(*map(F.lit, RANKS)), F.coalesce("r", "any_r") + 1)
    label = F.coalesce("top.label", P.looked_up(P.VERBS, F.col("top.kind")), "top.kind")
    y = y.select(*by, "src", "dst", label.alias("label"), F.when(F.col("weak"), F.col("n")).otherwise(F.col("strong")).alias("weight"), "weak", status.alias("status"), (F.col("async") & ~F.col("weak")).alias("async"))
    return y


#: Edges on which a view's size is looked at first: what is beyond a limit there is beyond it on all edges.
SHOWN = 10_000


def drawn_units(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id): the units that arrows of edges have as their ends; a weak arrow that isn't drawn has the ends of the strong one."""
    u = lambda end: of.select(F.col("id").alias(end), F.col("unit").alias(f"__{end}"))
    x = edges.select("src", "dst", "kind").join(u("src"), "src").join(u("dst"), "dst").select("kind", F.col("__src").alias("src"), F.col("__dst").alias("dst"))
    return P.ends(x.where(DRAWN))


def beyond(edges: DataFrame, ids_of, most: int) -> bool:
    """Whether ids_of(edges) has more than most rows, where more edges never give fewer of them. All edges are asked only where some don't tell."""
    return any(ids_of(e).limit(most + 1).count() > most for e in (edges.limit(SHOWN), edges))


def boxes(ids: DataFrame, nodes: DataFrame, subsystems: DataFrame) -> DataFrame:
    """(view, id, kind, label, shape, category, group, pinned) of (view, id), pinned where they say so: modules by their shortest telling path."""
    modules = nodes.where("kind = 'module'").select(F.lit("m").alias("all"), "id", F.coalesce("file", "name").alias("path"))
    short = graphs.cut(views.suffix_labels(modules, "all", "id", "path").select("id", "label"), "labels")
    named = P.labels(ids.select("id").distinct(), nodes, subsystems, short)
    traits = P.subsystem_traits(nodes).select(F.col("subsystem").alias("id"), F.col("category").alias("__c"))
    own = nodes.select("id", "tags")
    x = ids.join(named, "id").join(own, "id", "left").join(traits, "id", "left")
    kind = F.when(F.col("kind").isin(P.CHANNELS), F.lit("channel")).otherwise(F.col("kind"))
    x = x.select("view", "id", kind.alias("kind"), "label", P.shape().alias("shape"), F.when(F.col("kind") == "subsystem", F.coalesce("__c", F.lit("app"))).otherwise(P.category()).alias("category"), P.looked_up(P.GROUPS, F.col("kind")).alias("group"), (F.col("pinned") if "pinned" in ids.columns else F.lit(False)).alias("pinned"))
    return graphs.cut(x, "boxes")


def fitted(box: DataFrame, arrow: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes and arrows within the limits, with their labels and marks, and notes of what was left out."""
    box, arrow = graphs.cut(box, "boxes"), graphs.cut(arrow, "arrows")
    u, e, notes = views.fit(box.select("view", "id", "kind", "label", "pinned"), arrow.select("view", "src", "dst", "weight", "weak"), max_nodes, max_edges)
    u, e = graphs.cut(u, "units"), graphs.cut(e, "edges")
    kept = box.join(u.select("view", "id"), ["view", "id"], "left_semi")
    more = arrow.select("view", "src", "dst", "label", "status", "async")
    drawn = e.join(more, ["view", "src", "dst"], "left").select("view", "src", "dst", F.coalesce("label", F.lit("")).alias("label"), "weight", "weak", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("async", F.lit(True)).alias("async"))
    return kept, drawn, notes


# ---- overview and subsystems ---------------------------------------------------------------------------------


def overview(nodes: DataFrame, edges: DataFrame, subsystems: DataFrame, low: int = 12, high: int = 20, max_edges: int = 30) -> tuple[View, str]:
    """The one view of everything, and its level: subsystems where at least three have relationships, else modules; the other level where that fits the target size better."""
    e = edges.where(~F.col("kind").isin(OVERVIEW_LEAVES_OUT))
    deployed = nodes.where("kind = 'deployment_unit'").limit(2).count()
    if deployed == 2:
        e = e.where(~F.col("kind").isin(DEPLOYMENT))
    inner = nodes.where(F.col("kind").isin(*P.SYMBOLS, "module") & F.col("subsystem").isNotNull())
    level = "subsystem" if beyond(edges, lambda x: P.significant(inner, x).select("subsystem").distinct(), 2) else "module"

    def at(name):
        a = arrows(e, P.units(nodes, edges, name)).withColumn("view", F.lit("overview"))
        return a, a.select("view", F.explode(F.array("src", "dst")).alias("id")).distinct()

    arrow, ids = at(level)
    n = ids.limit(high + 1).count()
    if level == "subsystem" and n < low:
        other = at("module")
        if other[1].limit(high + 1).count() <= high:
            level, (arrow, ids) = "module", other
    elif level == "module" and n > high and subsystems.limit(2).count() == 2:
        other = at("subsystem")
        if other[1].limit(3).count() == 3:
            level, (arrow, ids) = "subsystem", other
    box, arrow, notes = fitted(boxes(ids, nodes, subsystems), arrow, high, max_edges)
    box = P.without_bare_packages(box, arrow)
    arrow = arrow.join(box.select("view", F.col("id").alias("src")), ["view", "src"], "left_semi").join(box.select("view", F.col("id").alias("dst")), ["view", "dst"], "left_semi").select(arrow.columns)
    if level == "module":
        home = nodes.where("kind = 'module'").join(subsystems.select(F.col("id").alias("subsystem"), F.col("name").alias("__g")), "subsystem").select("id", "__g")
        box = box.join(home, "id", "left").withColumn("group", F.coalesce("group", "__g")).drop("__g").select(box.columns)
    # groups of what cuts across need two members
    alone = F.count(F.lit(1)).over(Window.partitionBy("view", "group")) < 2
    box = box.withColumn("group", F.when(F.col("group").isin(*P.GROUPS.values()) & alone, None).otherwise(F.col("group")))
    return View(box, arrow, skipped(notes, F.col("view"), "").limit(0)), level


def subsystem_views(nodes: DataFrame, edges: DataFrame, subsystems: DataFrame, cap: int = 10, max_nodes: int = 25, max_edges: int = 30) -> View:
    """A view of each of the cap first ranked subsystems: its symbols with what they talk to outside, or its modules where symbols are too many; modules beyond the limit in parts."""
    ranked = P.ranked_subsystems(nodes, edges, cap)
    few = subsystems.join(ranked.select(F.col("subsystem").alias("id")), "id", "left_anti")
    late = ranked.where("not drawn")
    drawn = ranked.where("drawn").select("subsystem", F.concat(F.lit("subsystem-"), F.regexp_replace("subsystem", "^sub:", "")).alias("view"))
    skips = skipped(few, F.col("id"), "fewer than two components with relationships").union(skipped(late, F.col("subsystem"), "beyond the limit of subsystem views"))
    home = nodes.select("id", "subsystem", "kind").join(drawn, "subsystem")

    # what both levels need of a node, put to the edges once: a node lies in one view at most
    symbols = P.significant(home.where(F.col("kind").isin(P.SYMBOLS)).select("id", "view"), edges).select("id", F.lit(True).alias("symbol"))
    own = F.col("kind").isin(*P.CROSS_CUTTING, "config")
    info = nodes.select("id", "kind", "subsystem").join(P.module_of(nodes), "id").join(P.units(nodes, edges, "module"), "id").join(home.select("id", "view"), "id", "left").join(symbols, "id", "left")
    info = graphs.cut(info.select("id", F.struct("view", "subsystem", F.coalesce("symbol", F.lit(False)).alias("symbol"), (F.col("view").isNotNull() & (F.col("kind") != "config")).alias("module"), "unit", F.when(own, F.col("id")).otherwise(F.coalesce("subsystem", "module")).alias("away")).alias("of")), "info")
    both = edges.select("src", "dst", "kind", "label", "status")
    for end in ("src", "dst"):
        both = both.join(info.select(F.col("id").alias(end), F.col("of").alias(f"{end}_of")), end)
    both = graphs.cut(both.where("src_of.view is not null or dst_of.view is not null"), "touched")

    def at(both: DataFrame, level: str) -> DataFrame:
        """Edges of each view (view, kind, label, status, src, dst, s_in, d_in) by the units of their ends at level."""
        inside = lambda end: F.col(f"{end}_of.{level}")
        view = lambda end: F.when(inside(end), F.col(f"{end}_of.view"))
        x = both.withColumn("view", F.explode(F.array_distinct(F.array_compact(F.array(view("src"), view("dst"))))))
        for end in ("src", "dst"):
            unit = F.col(end) if level == "symbol" else F.col(f"{end}_of.unit")
            x = x.withColumns({f"{end}_in": inside(end) & F.col(f"{end}_of.view").eqNullSafe(F.col("view")), f"{end}_unit": unit})
        # of the same subsystem but not drawn: left out
        x = x.where("(src_in and dst_in) or not (src_of.subsystem <=> dst_of.subsystem) or src_unit = src_of.away or dst_unit = dst_of.away")
        end = lambda e: F.when(F.col(f"{e}_in"), F.col(f"{e}_unit")).otherwise(F.col(f"{e}_of.away"))
        return x.select("view", "kind", "label", "status", end("src").alias("src"), end("dst").alias("dst"), F.col("src_in").alias("s_in"), F.col("dst_in").alias("d_in"))

    def drawn_ids(x: DataFrame) -> DataFrame:
        """(view, id, own) of the ends of arrows; own where any edge has it inside."""
        one = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("s_in").alias("own")), F.struct(F.col("dst").alias("id"), F.col("d_in").alias("own"))))
        x = x.select("view", F.expr(DRAWN).alias("shown"), one.alias("e"))
        return x.groupBy("view", F.col("e.id").alias("id")).agg(F.max(F.col("e.own")).alias("own"), F.max(F.coalesce("shown", F.lit(False))).alias("shown")).where("shown").select("view", "id", "own")

    # a view with too many symbols on a part of its edges has too many on all
    crowded = graphs.cut(drawn_ids(at(both.limit(SHOWN), "symbol")).groupBy("view").count().where(F.col("count") > max_nodes).select("view"), "crowded")
    x_s = at(both, "symbol").join(F.broadcast(crowded), "view", "left_anti")
    ids_s = graphs.cut(drawn_ids(x_s), "ids")
    fits = graphs.cut(ids_s.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own")).where(f"n <= {max_nodes} and own >= 2").select("view"), "fits")
    arrow_s = linked(x_s.join(F.broadcast(fits), "view", "left_semi"), ["view"])
    x_m = at(both, "module").join(F.broadcast(fits), "view", "left_anti")
    arrow = arrow_s.union(linked(x_m, ["view"]))
    ids = graphs.cut(ids_s.join(fits, "view", "left_semi").union(drawn_ids(x_m)), "ids")
    lone = ids.groupBy("view").agg(F.count_if("own").alias("own")).where("own < 2").select("view")
    skips = skips.union(skipped(drawn.join(ids.select("view").distinct(), "view", "left_anti").union(drawn.join(lone, "view", "left_semi").select("view", "subsystem")), F.col("view"), "fewer than two connected modules"))
    arrow, ids = arrow.join(lone, "view", "left_anti"), ids.join(lone, "view", "left_anti")
    arrow, ids = graphs.cut(arrow, "arrows"), graphs.cut(ids, "units")
    bases = drawn.join(subsystems.select(F.col("id").alias("subsystem"), F.get("paths", F.lit(0)).alias("base")), "subsystem").select("view", "base")
    parts = graphs.cut(module_parts(ids.where("own").select("view", "id"), nodes, max_nodes, arrow, bases), "parts")
    split = parts.groupBy("view").agg(F.max("part").alias("__last")).where("__last > 0").select("view")
    named = lambda v, p: F.concat(v, F.lit("-part-"), (p + 1).cast("string"))
    p_own = parts.join(split, "view", "left_semi")
    touch = arrow.join(p_own.select("view", F.col("id").alias("src"), F.col("part").alias("ps")), ["view", "src"], "left").join(p_own.select("view", F.col("id").alias("dst"), F.col("part").alias("pd")), ["view", "dst"], "left")
    cut = touch.where("ps is not null or pd is not null").withColumn("part", F.explode(F.array_distinct(F.array(F.coalesce("ps", "pd"), F.coalesce("pd", "ps"))))).select(named(F.col("view"), F.col("part")).alias("view"), *[c for c in arrow.columns if c != "view"])
    cut_ids = cut.select("view", F.explode(F.array("src", "dst")).alias("id")).distinct().join(p_own.select(named(F.col("view"), F.col("part")).alias("view"), "id", F.lit(True).alias("__own")), ["view", "id"], "left").select("view", "id", F.coalesce("__own", F.lit(False)).alias("own"))
    arrow = arrow.join(split, "view", "left_anti").select(cut.columns).union(cut)
    ids = ids.join(split, "view", "left_anti").union(cut_ids)
    box = boxes(ids.select("view", "id", F.col("own").alias("pinned")), nodes, subsystems)
    box = box.withColumn("category", F.when(~F.col("pinned") & ~F.col("kind").isin(*P.CROSS_CUTTING, "channel"), "context").otherwise(F.col("category")))
    box, arrow, _ = fitted(box, arrow, max_nodes, max_edges)
    return View(box, arrow, skips)


def module_parts(ids: DataFrame, nodes: DataFrame, size: int, arrows_: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """(view, id, part): modules (view, id) of views beyond size in parts, all views in one pass.

    A module's folder is the first below its view's base path (view, base). If a view has two folders or more and each
    fits, they are packed, larger ones first, each into the first part with room; else the parts are communities of the
    view's arrows (view, src, dst). Views within size are one part.
    """
    x = ids.select("view", "id").distinct().join(nodes.select("id", F.coalesce("file", "id").alias("file")), "id", "left")
    n = x.groupBy("view").agg(F.count(F.lit(1)).alias("n"))
    x = x.join(n, "view")
    x = (x if bases is None else x.join(bases.select("view", F.regexp_replace(F.coalesce("base", F.lit("")), "^/+|/+$", "").alias("base")), "view", "left")).withColumn("base", F.coalesce("base", F.lit("")) if bases is not None else F.lit(""))
    inside = (F.col("base") != "") & F.startswith("file", F.concat("base", F.lit("/")))
    rel = F.when(inside, F.expr("substring(file, length(base) + 2)")).otherwise(F.coalesce("file", "id"))
    x = graphs.cut(x.withColumn("folder", F.when(rel.contains("/"), F.substring_index(rel, "/", 1)).otherwise(".")).select("view", "id", "folder", "n"), "split")
    beyond = x.where(F.col("n") > size)
    folders = beyond.groupBy("view", "folder").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("grp"))
    even = folders.groupBy("view").agg(F.count(F.lit(1)).alias("k"), F.max("members").alias("most")).where((F.col("k") >= 2) & (F.col("most") <= size)).select("view")
    even = graphs.cut(even, "split")
    filled = graphs.first_fit_by(folders.join(even, "view", "left_semi").select("view", "grp", "members"), size)
    filled = filled.join(folders.select("view", "grp", "folder"), ["view", "grp"]).select("view", "folder", F.col("bin").alias("part"))
    by_folder = beyond.join(filled, ["view", "folder"]).select("view", "id", F.col("part").cast("int").alias("part"))
    rest = beyond.join(even, "view", "left_anti").select("view", F.col("id").alias("v"))
    out = x.where(F.col("n") <= size).select("view", "id", F.lit(0).alias("part")).union(by_folder)
    if not rest.limit(1).count():
        return out
    near = rest.select("view", F.col("v").alias("src")).limit(0).withColumn("dst", F.lit("")) if arrows_ is None else arrows_.select("view", "src", "dst")
    end = lambda c: rest.select("view", F.col("v").alias(c))
    near = near.join(end("src"), ["view", "src"], "left_semi").join(end("dst"), ["view", "dst"], "left_semi")
    return out.union(graphs.communities(rest, near, size).select("view", F.col("v").alias("id"), F.col("part").cast("int").alias("part")))


# ---- flows ---------------------------------------------------------------------------------------------------


def data_flow(nodes: DataFrame, edges: DataFrame, subsystems: DataFrame, max_nodes: int = 25, max_edges: int = 30) -> tuple[View, str]:
    """What moves data, in its direction (reads turned round), at the finest level that fits; ends without a way in or out are inputs and outputs."""
    kind = nodes.select(F.col("id").alias("src"), F.col("kind").alias("__k"))
    e = edges.where(F.col("kind").isin(P.DATA_KINDS)).join(kind, "src", "left").where(~((F.col("kind") == "triggers") & ~F.coalesce(F.col("__k").isin(P.CHANNELS), F.lit(False))))
    read = F.col("kind") == "db_read"
    e = e.select("id", F.when(read, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(read, F.col("src")).otherwise(F.col("dst")).alias("dst"), "kind", "label", "status")
    for level in ("symbol", "module", "subsystem"):
        of = graphs.cut(P.units(nodes, edges, level), "units")
        if level == "subsystem" or not beyond(e, lambda x: drawn_units(x, of), max_nodes):  # noqa: B023
            break
    arrow = arrows(e, of).withColumn("view", F.lit("dataflow"))
    ids = arrow.select("view", F.explode(F.array("src", "dst")).alias("id")).distinct()
    n = ids.limit(4).count()
    skips = skipped(ids.select("view").distinct().where(F.lit(n < 4)), F.col("view"), "fewer than four components move data")
    box, arrow, _ = fitted(boxes(ids.where(F.lit(n >= 4)), nodes, subsystems), arrow.where(F.lit(n >= 4)), max_nodes, max_edges)
    role = views.flow_ends(arrow.select("view", "src", "dst")).withColumnRenamed("node", "id")
    end = F.when(F.col("role") == "source", "lean_r").when(F.col("role") == "sink", "lean_l")
    box = box.join(role, ["view", "id"], "left").withColumn("shape", F.when(F.col("kind").isin(*P.CROSS_CUTTING, "channel"), F.col("shape")).otherwise(F.coalesce(end, "shape"))).drop("role").select(box.columns)
    return View(box, arrow, skips), level


def executions(nodes: DataFrame, edges: DataFrame, subsystems: DataFrame, limit: int = 1, depth: int = 6, max_nodes: int = 25, max_edges: int = 30) -> View:
    """What runs after entry points, breadth first; the limit's number of views with most components, at least four, none that overlaps an earlier one by more than 0.8."""
    entries = P.entry_points(nodes).select(F.col("id").alias("v"))
    e = edges.where(F.col("kind").isin(*FOLLOWED, *ENDS)).select("src", "dst", "kind", F.struct(F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "id").alias("at"))
    e = graphs.cut(e, "edges")
    seen = graphs.bounded_trace(e, entries, depth, max_nodes, ENDS)[0]  # a written table
    held = seen.groupBy(F.col("root").alias("view")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("v")).alias("ids"))
    few = skipped(held.where("n < 4"), F.col("view"), "fewer than four components")
    chosen = graphs.cut(distinct_views(held.where("n >= 4").withColumn("rank", F.struct(-F.col("n"), "view")), "ids", "rank"), "chosen")
    kept = graphs.cut(chosen.where("accepted").orderBy("rank").limit(limit).select("view"), "kept")
    late = chosen.where("accepted").join(kept, "view", "left_anti")
    skips = few.union(skipped(chosen.where("not accepted"), F.col("view"), "overlaps an earlier view")).union(skipped(late, F.col("view"), "beyond the limit of derived views"))
    drawn = graphs.cut(seen.join(F.broadcast(kept.withColumnRenamed("view", "root")), "root", "left_semi"), "seen")  # at most limit roots: only their edges are looked up
    out = graphs.trace_edges(e, F.broadcast(drawn), depth)
    box = boxes(drawn.select(F.col("root").alias("view"), F.col("v").alias("id")), nodes, subsystems)
    first = F.col("id") == F.col("view")
    box = box.withColumns({"pinned": first, "shape": F.when(first, "stadium").otherwise(F.col("shape"))})
    a = out.where("cut is null").groupBy(F.col("root").alias("view"), "src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.min("kind").alias("kind"), F.bool_and(F.col("kind").isin(P.ASYNC)).alias("async"))
    label = F.when(F.col("kind") == "calls", "").otherwise(P.looked_up(P.VERBS, F.col("kind"), ""))
    a = a.where("src <> dst").select("view", "src", "dst", label.alias("label"), "weight", F.lit(False).alias("weak"), F.lit("unknown").alias("status"), "async")
    box, a, _ = fitted(box, a, max_nodes, max_edges)
    return View(box, a, skips)


def distinct_views(rows: DataFrame, ids: str, rank: str, above: float = 0.8) -> DataFrame:
    """rows (one a view) with accepted: in order of rank, whether a view's ids overlap no accepted one's by a Jaccard above the bound.

    Views of equal ids are one with the first of them, and the later ones are out. Others meet by one of their rarest ids,
    so many that views above the bound can't miss each other there. Then rounds decide all views at once whose earlier
    neighbours are decided: one with an accepted neighbour is out, one without is accepted. No task sees all views.
    """
    x = rows.select("view", F.array_sort(F.array_distinct(F.col(ids))).alias("__ids"), F.col(rank).alias("__rank"))
    first = graphs.cut(x.groupBy("__ids").agg(F.min(F.struct("__rank", "view")).alias("f")).select(F.col("f.view").alias("view"), F.col("f.__rank").alias("__rank"), "__ids"), "views")
    one = first.select("view", F.explode("__ids").alias("id"), F.size("__ids").alias("n"))
    often = one.groupBy("id").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("view").orderBy("often", "id"))
    rare = one.join(often, "id").withColumn("p", place).where(F.col("p") <= F.col("n") - F.floor(above * F.col("n") - 1e-9)).select("view", "id", "n")
    meets = rare.select(F.col("view").alias("a"), "id", F.col("n").alias("na")).join(rare.select(F.col("view").alias("b"), "id", F.col("n").alias("nb")), "id").where((F.col("a") != F.col("b")) & (F.least("na", "nb") > above * F.greatest("na", "nb"))).select("a", "b").distinct()
    side = lambda c: first.select(F.col("view").alias(c), F.col("__ids").alias("i" + c), F.col("__rank").alias("r" + c))
    both = F.size(F.array_intersect("ia", "ib"))
    near = meets.join(side("a"), "a").join(side("b"), "b").where(both > above * (F.size("ia") + F.size("ib") - both)).where(F.struct("ra", "a") < F.struct("rb", "b"))
    near = graphs.cut(near.select("a", F.col("b").alias("view")), "overlaps")  # a before view
    state = graphs.cut(first.select("view", F.lit(None).cast("boolean").alias("accepted")), "accepted")
    while state.where("accepted is null").limit(1).count():
        before = near.join(state.select(F.col("view").alias("a"), F.col("accepted").alias("was")), "a").groupBy("view").agg(F.max("was").alias("any"), F.count_if(F.col("was").isNull()).alias("open"))
        x2 = state.join(before, "view", "left")
        verdict = F.when(F.coalesce("any", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = graphs.cut(x2.select("view", F.coalesce("accepted", verdict).alias("accepted")), "accepted")
    return rows.join(state, "view", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def flow_steps(steps: DataFrame, nodes: DataFrame, subsystems: DataFrame, max_nodes: int = 25, max_edges: int = 30) -> View:
    """Views of given flows: steps (view, pos, src, dst, kind, label, condition, phase) between known nodes; errors and decisions change what they lead to or come from."""
    known = nodes.select("id")
    s = steps.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    said = F.when((F.col("kind") == "loop") & F.col("condition").isNotNull(), F.concat(F.lit("loop: "), "condition")).otherwise(F.coalesce(F.nullif("label", F.lit("")), "condition", F.lit("")))
    s = s.withColumn("said", said)
    text = P.joined_labels(s, ["view", "src", "dst"], "said", "pos", " / ").withColumnRenamed("said", "label")
    quiet = F.bool_and(F.col("kind").isin("async", "event"))
    a = s.where("src <> dst").groupBy("view", "src", "dst").agg(F.count(F.lit(1)).alias("weight"), quiet.alias("async")).join(text, ["view", "src", "dst"], "left")
    a = a.select("view", "src", "dst", F.coalesce("label", F.lit("")).alias("label"), "weight", F.lit(False).alias("weak"), F.lit("unknown").alias("status"), "async")
    ids = s.select("view", "pos", F.posexplode(F.array("src", "dst")).alias("e", "id"), "kind", F.coalesce("phase", F.lit("unknown")).alias("phase"))
    traits = ids.groupBy("view", "id").agg(F.min_by("phase", F.struct("pos", "e")).alias("phase"), F.bool_or((F.col("kind") == "error") & (F.col("e") == 1)).alias("err"), F.bool_or((F.col("kind") == "decision") & (F.col("e") == 0)).alias("dec"))
    traits = P.phase_groups(traits).withColumnRenamed("group", "__g")
    box = boxes(traits.select("view", "id"), nodes, subsystems).join(traits, ["view", "id"])
    box = box.select("view", "id", "kind", "label", F.when(F.col("dec"), "diamond").otherwise(F.col("shape")).alias("shape"), F.when(F.col("err"), "error").otherwise(F.col("category")).alias("category"), F.col("__g").alias("group"), "pinned")
    n = box.groupBy("view").count().where("count < 2").select("view")
    box, a, _ = fitted(box.join(n, "view", "left_anti"), a.join(n, "view", "left_anti"), max_nodes, max_edges)
    return View(box, a, skipped(n, F.col("view"), "fewer than two steps"))


def stages(stage: DataFrame, transitions: DataFrame) -> View:
    """Views of algorithms: stages (view, id, name, kind) and transitions (view, src, dst, label); shapes by kind."""
    box = stage.select("view", "id", "kind", F.col("name").alias("label"), P.looked_up(STAGE_SHAPES, F.col("kind"), "rect").alias("shape"), F.when(F.col("kind") == "error", "error").otherwise("processing").alias("category"), F.lit(None).cast("string").alias("group"), F.lit(True).alias("pinned"))
    a = transitions.select("view", "src", "dst", F.coalesce("label", F.lit("")).alias("label"), F.lit(1).cast("long").alias("weight"), F.lit(False).alias("weak"), F.lit("unknown").alias("status"), F.lit(False).alias("async"))
    bad = P.missing_ends(a, box).select("view").distinct()
    few = box.groupBy("view").count().where("count < 2").select("view")
    gone = bad.union(few).distinct()
    return View(box.join(gone, "view", "left_anti"), a.join(gone, "view", "left_anti"), skipped(few, F.col("view"), "fewer than two stages").union(skipped(bad.join(few, "view", "left_anti"), F.col("view"), "a transition names no stage")))


def dependencies(nodes: DataFrame, edges: DataFrame, subsystems: DataFrame, max_nodes: int = 25, max_edges: int = 30) -> View:
    """Imports between modules, or between subsystems where modules are too many; arrows within a cycle are named so."""
    e = edges.where("kind = 'imports'")
    for level in ("module", "subsystem"):
        of = P.units(nodes, edges, level)
        u = lambda end: of.select(F.col("id").alias(end), F.col("unit").alias(f"__{end}"))  # noqa: B023, E731
        pair = e.join(u("src"), "src").join(u("dst"), "dst").where("__src <> __dst").groupBy(F.col("__src").alias("src"), F.col("__dst").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
        ids = P.ends(pair)
        if ids.limit(max_nodes + 1).count() <= max_nodes:
            break
    marked = views.import_cycles(pair.select("src", "dst", "weight"))
    a = marked.select(F.lit("dependency").alias("view"), "src", "dst", F.when(F.col("in_cycle"), "cycle").otherwise("").alias("label"), "weight", F.lit(False).alias("weak"), F.lit("confirmed").alias("status"), F.lit(False).alias("async"))
    box, a, _ = fitted(boxes(ids.withColumn("view", F.lit("dependency")), nodes, subsystems), a, max_nodes, max_edges)
    few = box.groupBy("view").count().where("count < 2").select("view")
    return View(box.join(few, "view", "left_anti"), a, skipped(few, F.col("view"), "fewer than two units import"))


def infrastructure(nodes: DataFrame, edges: DataFrame, subsystems: DataFrame, max_nodes: int = 25, max_edges: int = 30) -> View:
    """Deployment units and what they depend on or launch; at least two units."""
    e = edges.where(F.col("kind").isin(DEPLOYMENT))
    unit = nodes.where("kind = 'deployment_unit'").select("id")
    touched = P.kept_edges(e, touching=unit)
    ids = unit.union(P.ends(touched)).distinct().withColumn("view", F.lit("infrastructure"))
    a = touched.where("src <> dst").groupBy("src", "dst").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("weight"))
    a = a.select(F.lit("infrastructure").alias("view"), "src", "dst", P.looked_up(P.VERBS, F.col("kind")).alias("label"), "weight", F.lit(False).alias("weak"), F.lit("confirmed").alias("status"), F.lit(False).alias("async"))
    few = ids.join(unit, "id", "left_semi").groupBy("view").count().where("count < 2").select("view")
    box, a, _ = fitted(boxes(ids.join(few, "view", "left_anti"), nodes, subsystems), a.join(few, "view", "left_anti"), max_nodes, max_edges)
    return View(box, a, skipped(few, F.col("view"), "fewer than two deployment units"))


def entity_parts(entities: DataFrame, relations: DataFrame, size: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (id) in parts of at most size by their connected groups: (id, part), relations (src, dst, ...) inside a part with it, and (part, cut): relations that the parts cut."""
    comp = graphs.weak_components(relations.select("src", "dst"), entities.select(F.col("id").alias("v"))).select(F.col("v").alias("id"), F.col("component").alias("grp"))
    comp = comp.join(entities.select("id"), "id", "left_semi")
    row = F.row_number().over(Window.partitionBy("grp").orderBy("id")) - 1
    place = comp.withColumn("start", (F.floor(row / size) * size).cast("long"))
    packed = graphs.first_fit(comp.groupBy("grp").agg(F.count(F.lit(1)).alias("members")), size)
    part = place.join(packed.select("grp", "start", "bin"), ["grp", "start"]).select("id", F.col("bin").alias("part"))
    x = relations.join(part.select(F.col("id").alias("src"), F.col("part").alias("ps")), "src").join(part.select(F.col("id").alias("dst"), F.col("part").alias("pd")), "dst")
    cut = x.where("ps <> pd").select(F.explode(F.array("ps", "pd")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("cut"))
    return part, x.where("ps = pd").withColumn("part", F.col("ps")).select(*relations.columns, "part"), cut


def robot_graph(nodes: DataFrame, edges: DataFrame, subsystems: DataFrame, max_nodes: int = 25, max_edges: int = 30) -> View:
    """Robot nodes and the interfaces between them; who provides an interface is drawn behind it."""
    turn = F.col("kind").isin("service_provide", "action_provide")
    robots = nodes.where(F.col("kind").isin(ROBOT_KINDS)).select("id")
    e = P.kept_edges(edges.where(F.col("kind").isin(ROBOT_EDGES)), scope=robots)
    e = e.select("kind", F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), "label", "status")
    same = P.ends(e).withColumn("unit", F.col("id"))
    a = arrows(e, same).withColumn("view", F.lit("ros2-graph"))
    ids = P.ends(a).withColumn("view", F.lit("ros2-graph"))
    box, a, _ = fitted(boxes(ids, nodes, subsystems), a, max_nodes, max_edges)
    few = box.groupBy("view").count().where("count < 2").select("view")
    return View(box.join(few, "view", "left_anti"), a, skipped(few, F.col("view"), "fewer than two robot nodes"))


def frame_tree(nodes: DataFrame, edges: DataFrame, subsystems: DataFrame, max_nodes: int = 25, max_edges: int = 30) -> View:
    """Coordinate frames and the transforms from parents to children."""
    e = edges.where("kind = 'tf_transform' and src <> dst").groupBy("src", "dst").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("weight"))
    a = e.select(F.lit("ros2-tf").alias("view"), "src", "dst", F.coalesce("label", F.lit("transform")).alias("label"), "weight", F.lit(False).alias("weak"), F.lit("confirmed").alias("status"), F.lit(False).alias("async"))
    box, a, _ = fitted(boxes(P.ends(e).withColumn("view", F.lit("ros2-tf")), nodes, subsystems), a, max_nodes, max_edges)
    return View(box, a, skipped(box.limit(0), F.col("view"), ""))


def interface_parts(rows: DataFrame, size: int) -> DataFrame:
    """(view, node, part): nodes with their interfaces (view, package, node, interfaces) dealt to parts in order of package and node while nodes and their distinct interfaces stay within size."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        part, held, out = 0, set(), []
        for node, faces in pdf.sort_values(["package", "node"])[["node", "interfaces"]].itertuples(index=False):
            new = {("n", node), *(("i", f) for f in faces)}
            if held and len(held | new) > size:
                part, held = part + 1, set()
            held |= new
            out.append((pdf.view.iloc[0], node, part))
        return pd.DataFrame(out, columns=["view", "node", "part"])

    return rows.groupBy("view").applyInPandas(fill, "view string, node string, part int")


# ---- sequences -----------------------------------------------------------------------------------------------


def request_chains(nodes: DataFrame, edges: DataFrame, depth: int = 4, max_messages: int = 30) -> tuple[DataFrame, DataFrame]:
    """Messages of requests: (chain, pos, src, dst, label, kind), capped, and (chain, participants, messages, omitted).

    A chain starts at a request edge, or at an endpoint that none requests but that is handled; then it walks depth
    first from the handler over calls and the data edges of each function in order, to a depth. Participants are units
    at module level. Only what a handler reaches within the depth goes to its walk, which is joined to all that ask for it.
    """
    of = P.units(nodes, edges, "module")
    handled = P.handlers(edges)
    names = nodes.select("id", "name")
    asked = edges.where("kind = 'api_request'").select(F.col("src").alias("client"), F.col("dst").alias("endpoint"))
    quiet = handled.join(asked.select("endpoint").distinct(), "endpoint", "left_anti").join(nodes.where("kind = 'api_endpoint'").select(F.col("id").alias("endpoint")), "endpoint", "left_semi")
    starts = asked.join(handled, "endpoint", "left").select("client", "endpoint", "handler").union(quiet.select(F.lit(None).cast("string").alias("client"), "endpoint", "handler")).distinct()
    starts = starts.withColumn("chain", F.concat_ws(" ", F.coalesce("client", F.lit("")), "endpoint"))
    shown = [*ENDS, "api_request", "publishes", "calls"]
    walkable = edges.where(F.col("kind").isin(shown) & ~F.col("kind").isin("action_call")).select("src", "dst", "kind", "label", F.struct(F.coalesce("file", F.lit("")).alias("f"), F.coalesce("line", F.lit(0)).alias("l"), "id").alias("at"))
    reach = graphs.bounded_levels(walkable.where("kind = 'calls'").select("src", "dst"), starts.where("handler is not null").select(F.col("handler").alias("v")).distinct(), depth)
    unit = lambda k: of.select(F.col("id").alias(k), F.col("unit").alias(f"{k}_unit"))
    local = reach.select(F.col("root").alias("handler"), F.col("v").alias("src")).join(walkable, "src").join(unit("src"), "src").join(unit("dst"), "dst").join(names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    rows = local.groupBy("handler").agg(F.array_sort(F.collect_list(F.struct("src", "at", "dst", "kind", "label", "src_unit", "dst_unit", "dst_name"))).alias("edges"))
    # what a handler leads to is walked once, whoever asks for it
    told = graphs.cut(rows.mapInPandas(lambda it: _walked(it, depth), "handler string, pos int, src string, dst string, label string, kind string"), "walks")
    held = told.groupBy("handler").agg(F.max("pos").alias("last"))
    s = starts.join(held, "handler", "left").join(names.select(F.col("id").alias("endpoint"), F.col("name").alias("endpoint_name")), "endpoint")
    for end in ("client", "endpoint", "handler"):
        s = s.join(unit(end), end, "left")
    asks = F.col("client").isNotNull()
    caller = F.when(asks, F.col("client_unit")).otherwise(F.col("endpoint"))
    target = F.when(F.col("handler").isNotNull(), F.col("handler_unit")).when(asks, F.col("endpoint_unit")).otherwise(F.col("endpoint"))
    s = graphs.cut(s.select("chain", "handler", caller.alias("caller"), target.alias("target"), F.when(asks, F.col("endpoint_name")).otherwise("handled by").alias("said"), F.coalesce("last", F.lit(0)).alias("last")), "chains")
    messages = s.select("chain", F.lit(0).alias("pos"), F.col("caller").alias("src"), F.col("target").alias("dst"), F.col("said").alias("label"), F.lit("sync").alias("kind"))
    messages = messages.union(s.join(told, "handler").select("chain", "pos", "src", "dst", "label", "kind"))
    messages = messages.union(s.select("chain", F.col("last") + 1, "target", "caller", F.lit("response"), F.lit("reply")))
    total = messages.groupBy("chain").agg(F.count(F.lit(1)).alias("messages"), (F.size(F.array_union(F.collect_set("src"), F.collect_set("dst")))).alias("participants"))
    total = total.withColumn("omitted", F.greatest(F.col("messages") - max_messages, F.lit(0)))
    return messages.where(F.col("pos") < max_messages), total


def _walked(batches, depth: int):
    """The messages that follow a handler's call, from 1: calls and data edges in order, depth first, a function once."""
    for pdf in batches:
        out = []
        for handler, edges in zip(pdf.handler, pdf.edges, strict=True):
            told = []
            beside: dict = {}
            for e in edges:
                beside.setdefault(e["src"], []).append(e)
            seen: set = set()
            todo = [("visit", handler, 0)]
            while todo:  # a stack of visits and of messages that come after what a call leads to
                what, at, level = todo.pop()
                if what == "tell":
                    told.append(at)
                    continue
                if what == "visit" and (at in seen or level > depth):
                    continue
                if what == "visit":
                    seen.add(at)
                    todo += [("edge", e, level) for e in reversed(beside.get(at, []))]
                    continue
                me, you = at["src_unit"], at["dst_unit"]
                if at["kind"] == "calls":
                    if me != you:
                        told.append((me, you, at["dst_name"].rpartition(".")[2], "sync"))
                        todo.append(("tell", (you, me, "returns", "reply"), level))
                    todo.append(("visit", at["dst"], level + 1))
                    continue
                told.append((me, you, at["label"] or P.VERBS.get(at["kind"], at["kind"]), "async" if at["kind"] == "publishes" else "sync"))
                if at["kind"] in ("db_read", "external_call", "api_request", "service_call"):
                    told.append((you, me, "rows" if at["kind"] == "db_read" else "response", "reply"))
            out += [(handler, i, *m) for i, m in enumerate(told, 1)]
        yield pd.DataFrame(out, columns=["handler", "pos", "src", "dst", "label", "kind"])


def chosen_chains(total: DataFrame, limit: int = 1) -> DataFrame:
    """(chain, drawn, reason): chains with at least three participants, those with most participants and messages first."""
    first = total.where("participants >= 3").orderBy(F.desc("participants"), F.desc("messages"), "chain").limit(limit)
    x = total.join(first.select("chain", F.lit(True).alias("__first")), "chain", "left")
    reason = F.when(F.col("participants") < 3, "fewer than three participants").when(F.col("__first").isNull(), "beyond the limit of sequences")
    return x.select("chain", reason.isNull().alias("drawn"), reason.alias("reason"))


# ---- specs ---------------------------------------------------------------------------------------------------

#: How diagram texts call the shapes of boxes; others are plain units.
TEXT_SHAPES = {"cylinder": "store", "diamond": "decision", "stadium": "terminal", "lean_r": "channel", "lean_l": "channel", "circle": "external"}


def assembled(view: View, renderer: str, direction: str = "LR") -> DataFrame:
    """(view, spec): each view as the JSON that diagrams.render takes: boxes by id, arrows by ends; a view is bounded by its limits."""
    node = F.struct("id", "label", P.looked_up(TEXT_SHAPES, F.col("shape"), "unit").alias("shape"), "group")
    edge = F.struct("src", "dst", "label", "async")
    n = view.boxes.groupBy("view").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    e = view.arrows.groupBy("view").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    x = n.join(e, "view", "left").select("view", F.struct(F.lit(renderer).alias("renderer"), F.lit(direction).alias("direction"), "nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges")).alias("s"))
    return x.select("view", F.to_json("s").alias("spec"))


def signatures(specs: DataFrame) -> DataFrame:
    """(view, hash): content hashes of specs; what did not change keeps its hash."""
    return specs.select("view", F.sha2("spec", 256).alias("hash"))


def with_tiers(candidates: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (view, tier, order) within the cap by tier, order and view, and (view, reason) of the rest."""
    place = F.row_number().over(Window.orderBy("tier", "order", "view"))  # one row a view
    x = candidates.withColumn("__p", place)
    return x.where(F.col("__p") <= cap).drop("__p"), skipped(x.where(F.col("__p") > cap), F.col("view"), "beyond the limit of views")
