"""A model of nodes and edges seen at a level: units, scopes, categories, labels, lanes and the predicates that views are chosen by.

nodes: (id, name, kind, subsystem, parent, tags, file). edges: (id, src, dst, kind, label, phase, status, file, line).
subsystems: (id, name, paths). Null tags are none; repeated ids of nodes are not expected (aggregates.keyed_upsert merges them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.operators.graphs import cut, strong_components

# Kinds of nodes and edges, what they count as, and how they are drawn and named.
NODE_KINDS = ["module", "package", "class", "function", "service", "worker", "ros_node", "api_endpoint", "ui_component", "datastore", "db_entity", "event_channel", "topic", "ros_service", "ros_action", "tf_frame", "external_service", "library", "config", "algorithm", "data_artifact", "deployment_unit", "state"]
EDGE_KINDS = ["calls", "imports", "inherits", "instantiates", "data_flow", "publishes", "subscribes", "api_request", "handles", "db_read", "db_write", "db_access", "ipc", "state_transition", "config_dependency", "tf_transform", "service_call", "service_provide", "action_call", "action_provide", "external_call", "spawns", "triggers", "launches", "depends_on", "error_path"]
PHASES = ["init", "runtime", "shutdown", "error", "build", "unknown"]
CONFIDENCE = {"confirmed": "high", "dynamic_observed": "high", "static_inferred": "medium", "documented_only": "low", "unknown": "low"}
CODE_KINDS = ["module", "class", "function", "ui_component", "package"]
NOISE = ["imports", "inherits", "config_dependency"]
CROSS_CUTTING = ["datastore", "db_entity", "event_channel", "topic", "ros_service", "ros_action", "external_service", "library", "deployment_unit", "tf_frame"]
CHANNELS = ["event_channel", "topic"]
OWN_AT_MODULE = ["ros_node", "service", "worker", "algorithm", "data_artifact", "api_endpoint", "state"]
SYMBOLS = ["function", "class", "api_endpoint", "ros_node", "service", "worker", "algorithm", "ui_component", "state", "data_artifact"]
DATA_KINDS = ["publishes", "subscribes", "triggers", "db_read", "db_write", "api_request", "handles", "external_call", "data_flow"]
ASYNC = ["publishes", "subscribes", "spawns", "triggers", "external_call"]
CATEGORIES = {"algorithm": "processing", "datastore": "data", "db_entity": "data", "data_artifact": "data", "event_channel": "messaging", "topic": "messaging", "ros_service": "messaging", "ros_action": "messaging", "external_service": "external", "library": "external", "config": "infra", "deployment_unit": "infra", "tf_frame": "infra"}
SHAPES = {"datastore": "cylinder", "db_entity": "cylinder", "event_channel": "lean_r", "topic": "lean_r", "ros_service": "hexagon", "ros_action": "hexagon", "api_endpoint": "stadium", "algorithm": "subroutine", "data_artifact": "lean_r", "config": "odd", "deployment_unit": "rounded", "ros_node": "rounded", "subsystem": "rounded", "tf_frame": "circle"}
VERBS = {"calls": "calls", "imports": "imports", "inherits": "extends", "instantiates": "creates", "data_flow": "sends data", "publishes": "publishes", "subscribes": "delivers", "api_request": "requests", "handles": "handled by", "db_read": "reads", "db_write": "writes", "db_access": "uses", "ipc": "IPC", "state_transition": "transitions", "config_dependency": "configured by", "tf_transform": "transform", "service_call": "calls service", "service_provide": "serves", "action_call": "sends goal", "action_provide": "serves action", "external_call": "calls API", "spawns": "spawns", "triggers": "triggers", "launches": "launches", "depends_on": "depends on", "error_path": "on error"}
GROUPS = {"datastore": "Data stores", "db_entity": "Data stores", "event_channel": "Messaging", "topic": "Messaging", "ros_service": "Messaging", "ros_action": "Messaging", "external_service": "External services", "library": "External services"}
# Lanes of architecture diagrams, which may be joined, and names of gateways.
LANES = ["client", "gateway", "service", "datastore", "external", "async"]
LANE_PAIRS = [("client", "gateway"), ("gateway", "service"), ("service", "service"), ("service", "datastore"), ("service", "async"), ("async", "service"), ("service", "external")]
GATEWAYS = ["nginx", "gateway", "traefik", "envoy", "haproxy", "proxy", "ingress", "load-balancer", "loadbalancer"]
# Names of files that builds read.
BUILD_FILES = ["pyproject.toml", "setup.py", "setup.cfg", "requirements*.txt", "Pipfile", "poetry.lock", "package.json", "pnpm-workspace.yaml", "tsconfig*.json", "CMakeLists.txt", "*.cmake", "Makefile", "package.xml", "*.launch.py", "*.launch.xml", "*.launch", "Cargo.toml", "go.mod", "Dockerfile", "*.dockerfile", "docker-compose*.yml", "docker-compose*.yaml", "compose*.yml", "compose*.yaml"]


def looked_up(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    """A small fixed dictionary as an expression: no join."""
    got = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]
    return got if default is None else F.coalesce(got, F.lit(default))


def tagged(tag: str) -> Column:
    return F.coalesce(F.array_contains("tags", tag), F.lit(False))


# ---- structure -----------------------------------------------------------------------------------------------


def climbed(steps: DataFrame) -> DataFrame:
    """(id, at, val) of steps (id, up, ends, val), one row an id: the first on the way up from id, itself included, that
    ends it, and the last val on that way that isn't null.

    Ways double, so rounds are the logarithm of the longest, which has no bound. A way that runs out without an end, or
    in a circle, has a null at; in a circle val is the own one. An unknown up is no way.
    """
    x = cut(steps.select("id", F.when(F.col("ends"), F.col("id")).when(F.col("up") != F.col("id"), F.col("up")).alias("at"), F.coalesce("ends", F.lit(False)).alias("done"), "val", F.col("val").alias("own")), "climb")
    rounds = max(1, x.count()).bit_length() + 1
    for _ in range(rounds):
        open_ = x.where("not done and at is not null")
        if not open_.limit(1).count():
            break
        y = x.select(F.col("id").alias("at"), F.col("at").alias("__at"), F.col("done").alias("__done"), F.col("val").alias("__val"))
        far = open_.join(y, "at", "left").select("id", F.col("__at").alias("at"), F.coalesce("__done", F.lit(False)).alias("done"), F.coalesce("__val", "val").alias("val"), "own")
        x = cut(x.where("done or at is null").select("id", "at", "done", "val", "own").union(far), "climb")
    circle = ~F.col("done") & F.col("at").isNotNull()
    return x.select("id", F.when(F.col("done"), F.col("at")).alias("at"), F.when(circle, F.col("own")).otherwise(F.col("val")).alias("val"))


def module_of(nodes: DataFrame) -> DataFrame:
    """(id, module): the nearest module on the way up the parents, itself where there is none or the way is a circle."""
    none = F.lit(None).cast("string")
    up = climbed(nodes.select("id", F.col("parent").alias("up"), (F.col("kind") == "module").alias("ends"), none.alias("val")))
    return up.select("id", F.coalesce("at", "id").alias("module"))


def handlers(edges: DataFrame) -> DataFrame:
    """(endpoint, handler): what handles an endpoint first by edge id."""
    return edges.where("kind = 'handles'").groupBy(F.col("src").alias("endpoint")).agg(F.min_by("dst", "id").alias("handler"))


def units(nodes: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """(id, unit) at level subsystem, module or symbol. Above symbols an endpoint is what handles it, through as many endpoints as hand on; what cuts across stays itself; a module that is one robot node's file is that node."""
    n = nodes.select("id", "kind", "subsystem", "file").join(module_of(nodes), "id")
    if level == "symbol":
        return n.select("id", F.col("id").alias("unit"))
    robots = nodes.where("kind = 'ros_node' and file is not null").groupBy(F.concat(F.lit("mod:"), F.col("file")).alias("module")).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("robot")).where("c = 1").drop("c")
    n = n.join(robots, "module", "left")
    own = F.col("kind").isin(*CROSS_CUTTING, "config")
    at_module = F.when(own | F.col("kind").isin(OWN_AT_MODULE), F.col("id")).otherwise(F.coalesce("robot", "module"))
    at_subsystem = F.when(own, F.col("id")).otherwise(F.coalesce("subsystem", "module"))
    x = cut(n.select("id", "kind", (at_module if level == "module" else at_subsystem).alias("unit")), "units")
    by = x.select("id", (F.col("kind") == "api_endpoint").alias("api")).join(handlers(edges).select(F.col("endpoint").alias("id"), F.col("handler").alias("up")), "id", "left")
    last = climbed(by.select("id", "up", (~F.col("api") | F.col("up").isNull()).alias("ends"), F.lit(None).cast("string").alias("val")))
    to = last.where("at <> id").join(x.select(F.col("id").alias("at"), F.col("unit").alias("handled")), "at").select("id", "handled")
    x = x.join(to, "id", "left")
    return x.select("id", F.when(F.col("kind") == "api_endpoint", F.coalesce("handled", "unit")).otherwise(F.col("unit")).alias("unit"))


def members(of: DataFrame) -> DataFrame:
    """(unit, ids): sorted members of each unit of (id, unit)."""
    return of.groupBy("unit").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def file_of(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, file): a node's own file, else that of its first evidence (id, pos, file)."""
    first = evidence.groupBy("id").agg(F.min_by("file", "pos").alias("shown"))
    return nodes.select("id", "file").join(first, "id", "left").select("id", F.coalesce("file", "shown").alias("file"))


# ---- filters -------------------------------------------------------------------------------------------------


def ends(edges: DataFrame) -> DataFrame:
    """(id): vertices at either end, each once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def kept_edges(edges: DataFrame, scope: DataFrame | None = None, include: list[str] | None = None, exclude: list[str] = (), touching: DataFrame | None = None) -> DataFrame:
    """edges of given kinds with both ends in scope (id) and an end in touching (id); what is not given does not filter."""
    x = edges
    if include is not None:
        x = x.where(F.col("kind").isin(list(include)))
    if exclude:
        x = x.where(~F.col("kind").isin(list(exclude)))
    for end in ("src", "dst") if scope is not None else ():
        x = x.join(scope.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    if touching is not None:
        for end in ("src", "dst"):
            x = x.join(touching.select(F.col("id").alias(end)).distinct().withColumn(f"__{end}", F.lit(True)), end, "left")
        x = x.where("__src or __dst")
    return x.select(*edges.columns)


def significant(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with an edge of a kind that is no noise."""
    return nodes.join(ends(edges.where(~F.col("kind").isin(NOISE))), "id", "left_semi")


def in_scope(rows: DataFrame, ids: Column, scope: DataFrame | None) -> DataFrame:
    """rows of which any of the ids lies in scope (id); no scope is all. A row must be unique."""
    if scope is None:
        return rows
    x = rows.withColumn("__id", F.explode(ids)).join(scope.select(F.col("id").alias("__id")), "__id", "left_semi")
    return x.select(*rows.columns).distinct()


def focus(nodes: DataFrame, subsystems: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """(id, matched): nodes of subsystems whose id, name or a path holds the text, else nodes whose name or id does; and their neighbours."""
    said = F.lit(text.lower())
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), said)
    subs = subsystems.where(holds(F.col("id")) | holds(F.col("name")) | F.coalesce(F.exists("paths", holds), F.lit(False))).select(F.col("id").alias("subsystem"))
    by_sub = nodes.join(subs, "subsystem", "left_semi").select("id", F.lit(0).alias("way"))
    by_name = nodes.where(holds(F.col("name")) | holds(F.col("id"))).select("id", F.lit(1).alias("way"))
    both = by_sub.union(by_name)
    first = F.broadcast(both.agg(F.min("way").alias("way")))  # one row
    hit = both.join(first, "way").select("id").distinct()
    out = edges.join(hit.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(hit.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    near = out.union(back).distinct().join(hit, "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
    return hit.withColumn("matched", F.lit(True)).union(near.withColumn("matched", F.lit(False)))


def entry_points(nodes: DataFrame) -> DataFrame:
    """nodes tagged as entry points, without modules that hold another tagged node."""
    t = nodes.where(tagged("entrypoint"))
    held = module_of(nodes).join(t.where("kind <> 'module'").select("id"), "id", "left_semi").select(F.col("module").alias("id")).distinct()
    return t.where("kind <> 'module'").union(t.where("kind = 'module'").join(held, "id", "left_anti").select(*t.columns))


def without_bare_packages(units_: DataFrame, edges: DataFrame) -> DataFrame:
    """units (view, id, kind, ...) without package files that only imports (weak edges) link, unless fewer than two would stay in the view."""
    linked = edges.where("not weak").select("view", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("__linked", F.lit(True))
    bare = (F.col("kind") == "module") & F.col("id").endswith("__init__.py") & F.col("__linked").isNull()
    x = units_.join(linked, ["view", "id"], "left").withColumn("__bare", bare)
    stay = F.count_if(~F.col("__bare")).over(Window.partitionBy("view"))
    return x.withColumn("__stay", stay).where("not __bare or __stay < 2").select(*units_.columns)


def is_build_file(path: Column) -> Column:
    """Whether the name is one that builds read (* in a name is any run of characters)."""
    either = "|".join(b.replace(".", r"\.").replace("*", ".*") for b in BUILD_FILES)
    return F.substring_index(path, "/", -1).rlike(f"^({either})$")


def is_counted_tool(tool: Column, exempt: list[str]) -> Column:
    """Whether a tool's last name is none of the exempt ones."""
    return ~F.substring_index(F.coalesce(tool, F.lit("")), "__", -1).isin(exempt or [""]) if exempt else F.lit(True)


# ---- description ---------------------------------------------------------------------------------------------


def category() -> Column:
    """Of a node: error and algorithm by tags, else by kind."""
    return F.when(tagged("error"), "error").when(tagged("algorithm"), "processing").otherwise(looked_up(CATEGORIES, F.col("kind"), "app"))


def shape() -> Column:
    return looked_up(SHAPES, F.col("kind"), "rect")


def verb() -> Column:
    return F.coalesce(F.nullif("label", F.lit("")), looked_up(VERBS, F.col("kind")), F.col("kind"))


def subsystem_traits(nodes: DataFrame) -> DataFrame:
    """(subsystem, members, category, ui): processing where a node is an algorithm and a third of all are; ui where UI nodes are at least half of the code."""
    algorithm = F.count_if(looked_up(CATEGORIES, F.col("kind"), "app") == "processing")
    ui = F.count_if((F.col("kind") == "ui_component") | tagged("ui"))
    x = nodes.where("subsystem is not null").groupBy("subsystem").agg(F.count(F.lit(1)).alias("members"), F.bool_or(tagged("algorithm")).alias("__a"), algorithm.alias("__p"), ui.alias("__u"), F.count_if(F.col("kind").isin(CODE_KINDS)).alias("__c"))
    return x.select("subsystem", "members", F.when(F.col("__a") & (3 * F.col("__p") >= F.col("members")), "processing").otherwise("app").alias("category"), (2 * F.col("__u") >= F.col("__c")).alias("ui"))


def labels(ids: DataFrame, nodes: DataFrame, subsystems: DataFrame, module_labels: DataFrame) -> DataFrame:
    """(id, label, kind) of units (id): a subsystem's name, a module's short path (id, label), a node's name, else the id."""
    s = subsystems.select("id", F.col("name").alias("__s"))
    n = nodes.select("id", F.col("name").alias("__n"), F.col("kind").alias("__k"))
    x = ids.join(s, "id", "left").join(module_labels.select("id", F.col("label").alias("__m")), "id", "left").join(n, "id", "left")
    kind = F.when(F.col("__s").isNotNull(), "subsystem").otherwise(F.coalesce("__k", F.lit("unknown")))
    return x.select("id", F.coalesce("__s", "__m", "__n", "id").alias("label"), kind.alias("kind"))


def lanes(units_: DataFrame, traits: DataFrame) -> DataFrame:
    """units (id, kind, label, tags) with lane; subsystems that are mostly UI are clients."""
    x = units_.join(traits.where("ui").select(F.col("subsystem").alias("id"), F.lit(True).alias("__ui")), "id", "left")
    ui = F.coalesce("__ui", F.lit(False))
    hint = F.lower("label").rlike("|".join(GATEWAYS))
    k = F.col("kind")
    lane = (
        F.when(k == "subsystem", F.when(ui, "client").otherwise("service"))
        .when(k.isin("datastore", "db_entity"), "datastore")
        .when(k.isin("external_service", "library"), "external")
        .when(k.isin(CHANNELS), "async")
        .when((k == "ui_component") | ((k == "module") & tagged("ui")), "client")
        .when((k == "deployment_unit") & hint, "gateway")
        .otherwise("service")
    )
    return x.select(*units_.columns, lane.alias("lane"))


def lane_problems(laned: DataFrame, edges: DataFrame, max_edges: int = 20) -> DataFrame:
    """(view, reason, n): why views (view, id, lane) with edges (view, src, dst) are no architecture diagrams; a view without a row is one."""
    e = edges
    for end in ("src", "dst"):
        e = e.join(laned.select("view", F.col("id").alias(end), F.col("lane").alias(f"{end}_lane")), ["view", end])
    allowed = F.concat_ws(">", "src_lane", "dst_lane").isin([f"{a}>{b}" for a, b in LANE_PAIRS])
    quiet = F.array_contains(F.array("src_lane", "dst_lane"), "async")
    count = lambda x, reason: x.groupBy("view").agg(F.count(F.lit(1)).alias("n")).select("view", F.lit(reason).alias("reason"), "n")
    pair = e.groupBy("view", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.countDistinct("src").alias("ways"), F.bool_and(quiet).alias("quiet"))
    out = count(e.where(~allowed), "lane pair not allowed")
    out = out.union(count(pair.where("k > 1 and not (k = 2 and ways = 2 and quiet)"), "more than one edge between two units"))
    out = out.union(count(e, "too many edges").where(F.col("n") > max_edges))
    soft = F.col("src_lane").isin("async", "external") | F.col("dst_lane").isin("async", "external")
    at = lambda end: F.concat_ws("\u0001", "view", end)
    ring = strong_components(e.where(~soft).select(at("src").alias("src"), at("dst").alias("dst"))).select(F.split_part("v", F.lit("\u0001"), F.lit(1)).alias("view"))
    out = out.union(count(ring, "forward edges form a cycle"))
    served = laned.where("lane = 'service'").select("view").distinct()
    return out.union(laned.select("view").distinct().join(served, "view", "left_anti").select("view", F.lit("no service lane").alias("reason"), F.lit(1).cast("long").alias("n")))


def phase_groups(rows: DataFrame) -> DataFrame:
    """rows (view, id, phase) with group: Initialization and Runtime where a view has both, else null."""
    w = Window.partitionBy("view")
    both = F.bool_or(F.col("phase") == "init").over(w) & F.bool_or(F.col("phase") == "runtime").over(w)
    name = F.when(F.col("phase") == "init", "Initialization").when(F.col("phase") == "runtime", "Runtime")
    return rows.withColumn("group", F.when(F.coalesce(both, F.lit(False)), name))


# ---- ordered and set-like ------------------------------------------------------------------------------------


def edge_order(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """edges with place: by the first file and line of their evidence (id of the edge, file, line), edges without last, then by id; within src."""
    first = evidence.groupBy("id").agg(F.min(F.struct("file", "line")).alias("__at"))
    x = edges.join(first, "id", "left")
    row = F.row_number().over(Window.partitionBy("src").orderBy(F.col("__at").asc_nulls_last(), "id"))
    return x.withColumn("place", row - 1).drop("__at")


def ordered_distinct(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by order of each key, whole."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def joined_labels(rows: DataFrame, keys: list[str], label: str, order: str, sep: str = ", ") -> DataFrame:
    """(keys, label): distinct non-empty labels of each key in their order, as one text."""
    said = F.collect_list(F.struct(order, label))
    x = rows.where(F.coalesce(F.col(label), F.lit("")) != "").groupBy(*keys).agg(F.array_sort(said).alias("l"))
    return x.select(*keys, F.array_join(F.array_distinct(F.transform("l", lambda r: r[label])), sep).alias(label))


def completed(declared: DataFrame, implied: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """(group, key, place): declared members in their order, then those only implied in theirs."""
    both = declared.select(group, key, F.lit(0).alias("__p"), F.col(order).alias("__o")).union(implied.select(group, key, F.lit(1), F.col(order)))
    first = both.groupBy(group, key).agg(F.min(F.struct("__p", "__o")).alias("__f"))
    return first.select(group, key, (F.row_number().over(Window.partitionBy(group).orderBy("__f", key)) - 1).alias("place"))


def common_folder(rows: DataFrame, group: str, path: str) -> DataFrame:
    """(group, folder): the folder of all paths of a group where they share one, else null."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    x = rows.groupBy(group).agg(F.min(folder).alias("a"), F.max(folder).alias("b"))
    return x.select(group, F.when((F.col("a") == F.col("b")) & (F.col("a") != ""), F.col("a")).alias("folder"))


def adds_detail(views: DataFrame, overview: DataFrame, nodes: DataFrame) -> DataFrame:
    """(view, subsystem, own, shown, adds): boxes (view, subsystem, ids) that hold members of the view's subsystem against those of the overview (ids)."""
    inside = nodes.where("subsystem is not null").select("subsystem", F.col("id").alias("m"))
    own = views.withColumn("__b", F.monotonically_increasing_id()).select("view", "subsystem", "__b", F.explode("ids").alias("m")).join(inside, ["subsystem", "m"]).groupBy("view", "subsystem").agg(F.countDistinct("__b").alias("own"))
    shown = overview.withColumn("__b", F.monotonically_increasing_id()).select("__b", F.explode("ids").alias("m")).join(inside, "m").groupBy("subsystem").agg(F.countDistinct("__b").alias("shown"))
    return own.join(shown, "subsystem", "left").select("view", "subsystem", "own", F.coalesce("shown", F.lit(0)).alias("shown"), (F.col("own") > F.coalesce("shown", F.lit(0))).alias("adds"))


def missing_ends(edges: DataFrame, units_: DataFrame) -> DataFrame:
    """(view, id): ends of edges (view, src, dst) that are no unit (view, id); a sound view has none."""
    e = edges.select("view", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return e.join(units_.select("view", "id"), ["view", "id"], "left_anti")


def ranked_subsystems(nodes: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """(subsystem, components, crossing, place, drawn): by components with relationships and edges that cross, those with fewer than two components left out."""
    sub = lambda e: nodes.select(F.col("id").alias(e), F.col("subsystem").alias(f"{e}_sub"))
    x = edges.join(sub("src"), "src", "left").join(sub("dst"), "dst", "left").where("not (src_sub <=> dst_sub)")
    cross = x.select(F.explode(F.array("src_sub", "dst_sub")).alias("subsystem")).groupBy("subsystem").agg(F.count(F.lit(1)).alias("crossing"))
    own = significant(nodes.where("subsystem is not null"), edges).groupBy("subsystem").agg(F.count(F.lit(1)).alias("components")).where("components >= 2")
    y = own.join(cross, "subsystem", "left").select("subsystem", "components", F.coalesce("crossing", F.lit(0)).alias("crossing"))
    place = F.row_number().over(Window.orderBy(-(F.col("components") + F.col("crossing")), "subsystem")) - 1  # one row a subsystem
    return y.withColumn("place", place).withColumn("drawn", F.col("place") < cap)


def lane_styles(laned: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (view, src, dst) with style: dotted where an end is async or external, else solid; (view, id, lacks) is what one_sided tells of services."""
    x = edges
    for end in ("src", "dst"):
        x = x.join(laned.select("view", F.col("id").alias(end), F.col("lane").alias(f"__{end}")), ["view", end], "left")
    soft = F.col("__src").isin("async", "external") | F.col("__dst").isin("async", "external")
    return x.select(*edges.columns, F.when(F.coalesce(soft, F.lit(False)), "dotted").otherwise("solid").alias("style"))


def one_sided(laned: DataFrame, edges: DataFrame) -> DataFrame:
    """(view, id, lacks): services without an edge in or out."""
    s = laned.where("lane = 'service'").select("view", "id")
    for end, name in (("dst", "input"), ("src", "output")):
        s = s.join(edges.select("view", F.col(end).alias("id"), F.lit(True).alias(name)).distinct(), ["view", "id"], "left")
    lacks = F.array_compact(F.array(F.when(F.col("input").isNull(), F.lit("input")), F.when(F.col("output").isNull(), F.lit("output"))))
    return s.select("view", "id", lacks.alias("lacks")).where("size(lacks) > 0")


def nested_groups(groups: DataFrame, deepest: int = 2) -> DataFrame:
    """(view, id, parent, depth) of groups (view, id, parent) nested at most deepest: a deeper one hangs on its ancestor at that depth; unknown parents and circles are cut to the top."""
    g = groups.join(groups.select("view", F.col("id").alias("parent"), F.lit(True).alias("__known")), ["view", "parent"], "left")
    g = g.select("view", "id", F.when(F.col("__known") & (F.col("parent") != F.col("id")), F.col("parent")).alias("parent"))
    level = g.where("parent is null").select("view", "id", F.lit(None).cast("string").alias("parent"), F.lit(1).alias("depth"), F.array("id").alias("way"))
    placed = level
    while True:  # a circle is never reached from the top
        level = cut(g.join(level.select("view", F.col("id").alias("parent"), "depth", "way"), ["view", "parent"]).select("view", "id", F.get("way", F.least(F.size("way"), F.lit(deepest - 1)) - 1).alias("parent"), (F.col("depth") + 1).alias("depth"), F.slice(F.concat("way", F.array("id")), 1, deepest).alias("way")), "groups")
        if not level.limit(1).count():
            break
        placed = placed.union(level)
    rest = g.join(placed.select("view", "id"), ["view", "id"], "left_anti").select("view", "id", F.lit(None).cast("string").alias("parent"), F.lit(1).alias("depth"))
    return placed.select("view", "id", "parent", F.least("depth", F.lit(deepest)).alias("depth")).union(rest)


def view_slug(prefix: str, name: Column) -> Column:
    """A view's id: its prefix and the name without the prefixes that ids bear (sub:, flow-, algo-)."""
    bare = F.regexp_replace(F.lower(name), r"^(sub:|flow[-:]|algo[-:])", "")
    out = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.lit(f"{prefix}-"), F.when(out == "", "x").otherwise(out))


def long_labels(rows: DataFrame, most: int = 48) -> DataFrame:
    """(view, n): how many labels of a view are longer than most."""
    return rows.where(F.length("label") > most).groupBy("view").agg(F.count(F.lit(1)).alias("n"))


def sets_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, in_a, in_b) of two tables of ids: union, difference and intersection are filters of it."""
    x, y = (df.select("id").distinct().withColumn(c, F.lit(True)) for df, c in ((a, "in_a"), (b, "in_b")))
    return x.join(y, "id", "full").select("id", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
