"""Checks of diagram texts as tables: texts become statements, statements rows of what they name, rules joins and windows over these.

Statements of all texts are checked in one pass over their rows. What nests (groups, composite states, bodies of entities)
is a running balance: an end is one too many where the balance falls to a new low, and what is open at the end is the
balance above its lowest point. Names, styles, edges and repeats are joins by view and name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.diagrams import ATTRIBUTE_FORM, DIRECTIONS, ENTITY_FORM, ENTITY_NAME, HEADERS, LEFT_ENDS, NODE_NAME, RESERVED, RIGHT_ENDS, SEQUENCE_FORBIDDEN, STATE_FORM, STYLING, TRANSITION_FORM
from quarrygraph.operators.graphs import cut

#: Most nodes and edges of a readable diagram.
LIMITS = (25, 30)
#: A node as it is written, with its shape and class; a link with its text.
NODE = r"([A-Za-z][\w-]*)\s*(?:\[\[.*?\]\]|\[\(.*?\)\]|\(\[.*?\]\)|\(\(.*?\)\)|\[.*?\]|\{\{.*?\}\}|\{.*?\}|\(.*?\))?(?:::[\w:]+)?"
LINK = r"\s*(?:<?--+>|<?==+>|<?-\.+->|---+|===+|-\.+-|--[xo])\s*(?:\|[^|]*\|\s*)?"
MESSAGE = r"([^-:]+?)\s*(--?>>?|--?\)|--?x)\s*([+-]?)\s*([^:]+?)\s*(?::(.*))?"
RELATION = r"(\S+)\s+(\S*(?:--|\.\.)\S*)\s+(\S+)\s*(?::\s*(.*))?"


def _whole(text: Column, form: str) -> Column:
    return text.rlike(rf"\A(?:{form})\z")


def _group(text: Column, form: str, k: int) -> Column:
    """A group of a form that the whole text has, empty where it hasn't."""
    return F.regexp_extract(text, rf"\A(?:{form})\z", k)


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"\A\s+|\s+\z", "")


def _spoken(texts: DataFrame) -> DataFrame:
    """texts (view, renderer, text) with their statements l, an array of (line, said): nothing is shuffled to number them."""
    raw = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), _trim(F.regexp_replace(_trim(x), ";+\\z", "")).alias("said")))
    return texts.select("view", "renderer", F.filter(raw, lambda x: (x["said"] != "") & ~x["said"].startswith("%%")).alias("l"))


def statements(texts: DataFrame) -> DataFrame:
    """(view, renderer, line, n, said) of texts (view, renderer, text): lines from 1 without blanks around and ends of statements; comments and empty lines are none. n counts a text's statements from 1."""
    x = _spoken(texts).select("view", "renderer", F.posexplode("l").alias("at", "x"))
    return x.select("view", "renderer", "x.line", (F.col("at") + 1).alias("n"), "x.said")


def _issue(rows: DataFrame, severity: str, rule: str, line: Column | None = None) -> DataFrame:
    return rows.select("view", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), (F.col("line") if line is None else line).cast("int").alias("line"))


def _told(rows: DataFrame, *rules: tuple[str, str, Column]) -> DataFrame:
    """One row for each rule that holds on a row."""
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, when in rules]))
    return rows.select("view", "line", F.explode(found).alias("i")).select("view", "i.severity", "i.rule", F.col("line").cast("int").alias("line"))


def _nested(rows: DataFrame, step: Column, end: str, rule_end: str, rule_open: str) -> tuple[DataFrame, DataFrame]:
    """(rows with depth, issues): step is 1 where something opens and -1 where it ends; an end without an opening changes nothing."""
    order = Window.partitionBy("view").orderBy("line")
    x = rows.withColumn("step", step).withColumn("sum", F.sum("step").over(order))
    low = F.least(F.lit(0), F.coalesce(F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("low", low).withColumn("depth", F.col("sum") - F.least("low", "sum"))
    last = x.groupBy("view").agg((F.max_by("sum", "line") - F.least(F.lit(0), F.min("sum"))).alias("open"))
    bad = _issue(x.where((F.col("step") == -1) & (F.col("sum") < F.col("low"))), "error", rule_end)
    return x, bad.union(_issue(last.where("open > 0"), "error", rule_open, F.lit(0)))


def _dense(every: DataFrame, nodes: DataFrame, edges: DataFrame, limits: tuple[int, int]) -> DataFrame:
    """nodes (view, name), edges (view): views with more of either than can be read."""
    n = nodes.groupBy("view").agg(F.countDistinct("name").alias("n"))
    e = edges.groupBy("view").agg(F.count(F.lit(1)).alias("e"))
    x = every.join(n, "view", "left").join(e, "view", "left").where((F.coalesce("n", F.lit(0)) > limits[0]) | (F.coalesce("e", F.lit(0)) > limits[1]))
    return _issue(x, "warning", "density", F.lit(0))


def _headers(spoken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts whose statements can be checked (view, renderer, l), issues) by first statements."""
    words = F.split("said", r"\s+")
    expected = F.create_map(*[F.lit(x) for kv in HEADERS.items() for x in kv])[F.col("renderer")]
    head = spoken.where("size(l) > 0").select("view", "renderer", "l", F.col("l")[0]["line"].alias("line"), F.col("l")[0]["said"].alias("said")).withColumns({"w": words, "expected": expected})
    first, flow = F.get("w", F.lit(0)), F.col("expected") == "flowchart"
    old_state = (first == "stateDiagram") & (F.col("renderer") == "state")
    graph = (first == "graph") & flow
    front = F.col("said") == "---"
    other = ~front & ~old_state & ~graph & (first != F.col("expected"))
    right = ~front & ~old_state & ~graph & ~other
    wrong_way = right & flow & ((F.size("w") > 2) | ((F.size("w") == 2) & ~F.get("w", F.lit(1)).isin(*DIRECTIONS)))
    not_lr = right & flow & (F.col("renderer") == "architecture") & ~F.coalesce(F.get("w", F.lit(1)) == "LR", F.lit(False))
    issues = _told(head, ("error", "front-matter", front), ("warning", "header", old_state), ("error", "header", graph | other | wrong_way | (right & ~flow & (F.size("w") > 1))), ("error", "arch-direction", not_lr))
    return head.where(~front & ~other).select("view", "renderer", "l"), issues.union(_issue(spoken.where("size(l) = 0"), "error", "header", F.lit(0)))


def _flow(rows: DataFrame, every: DataFrame, limits: tuple[int, int]) -> DataFrame:
    word = F.lower(F.regexp_extract("said", r"\A\S*", 0))
    box = F.regexp_extract("said", r"\Asubgraph\s+([\w-]+)", 1)
    x = rows.withColumns({"word": word, "box": F.when(word == "subgraph", box)})
    ends = (F.col("said") == "end") & (F.col("word") != "subgraph")
    # what is no node or link is a small table of its own: rules over it don't read all statements again
    few = cut(x.where(F.col("word").isin("subgraph", "style", "class") | ends), "lint-groups")
    step = F.when(F.col("box") != "", 1).when(ends, -1).otherwise(0)
    _, nested = _nested(few.where(step != 0), step, "end", "unbalanced-end", "unclosed-subgraph")
    issues = [nested, _issue(few.where("box = ''"), "error", "subgraph")]
    boxes = cut(few.where("box <> ''").groupBy("view", F.col("box").alias("name")).agg(F.min("line").alias("at")), "lint-boxes")
    styled = few.where(F.col("word").isin("style", "class")).select("view", "line", F.explode(F.split(F.get(F.split("said", r"\s+"), F.lit(1)), ",")).alias("name"))
    # nodes and links, quoted texts aside
    said = x.where(~F.col("word").isin("subgraph", "style", "class", "direction", "classdef", "linkstyle", "click") & ~ends)
    # a line holds no line feed, so it can stand for what parts are split at: a form to split at is compiled anew for each text, one to replace once
    parts = F.split(F.regexp_replace(F.regexp_replace("said", '"[^"]*"', '""'), LINK, "\n"), "\n", -1)
    names = F.transform(parts, lambda p: F.transform(F.split(F.replace(p, F.lit(" & "), F.lit("\n")), "\n", -1), lambda q: _group(_trim(q), NODE, 1)))
    said = cut(said.select("view", "line", names.alias("ends")).withColumn("fine", ~F.exists("ends", lambda e: F.exists(e, lambda n: n == ""))), "lint-flow")
    issues.append(_issue(said.where("not fine"), "error", "flow-syntax"))
    seen = said.where("fine").select("view", "line", F.explode(F.flatten("ends")).alias("name"))
    nodes = seen.join(boxes, ["view", "name"], "left").where("at is null or at > line").groupBy("view", "name").agg(F.min("line").alias("line"))
    nodes = cut(nodes, "lint-nodes")
    links = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.flatten(F.transform(F.get("ends", i - 1), lambda a: F.transform(F.get("ends", i), lambda b: F.struct(a.alias("a"), b.alias("b")))))))
    edges = cut(said.where("fine and size(ends) > 1").select("view", "line", F.posexplode(links).alias("k", "l")).select("view", "line", "k", "l.a", "l.b"), "lint-edges")
    entries = nodes.select("view", "name", "line", F.lit(True).alias("node")).union(boxes.select("view", "name", "at", F.lit(False)))
    also = entries.join(nodes.select("view", "name", F.lit(True).alias("known")), ["view", "name"], "left")
    under = F.contains("name", F.lit("_"))
    issues.append(_told(also, ("error", "reserved-id", F.lower("name").isin(*RESERVED)), ("error", "underscore-id", under), ("warning", "id-format", ~under & F.col("known") & ~_whole(F.col("name"), NODE_NAME))))
    issues.append(_issue(nodes.join(boxes.select("view", "name"), ["view", "name"], "left_semi"), "error", "id-collision"))
    side = lambda c: boxes.select("view", F.col("name").alias(c))
    issues += [_issue(edges.join(side(c), ["view", c], "left_semi"), "warning", "edge-to-subgraph") for c in ("a", "b")]
    again = F.row_number().over(Window.partitionBy("view", "a", "b").orderBy("line", "k"))
    issues.append(_issue(edges.withColumn("again", again).where("again > 1"), "warning", "duplicate-edge"))
    issues.append(_issue(styled.join(entries.select("view", "name").distinct(), ["view", "name"], "left_anti"), "warning", "unknown-style-target"))
    issues.append(_dense(every, nodes, edges, limits))
    return reduce(DataFrame.union, issues)


def _sequence(rows: DataFrame, every: DataFrame, limits: tuple[int, int]) -> DataFrame:
    said = F.col("said")
    low = F.lower(F.substring_index(said, " ", 1))
    rest = F.when(F.contains(said, F.lit(" ")), F.expr("substring(said, instr(said, ' ') + 1)")).otherwise("")
    x = rows.withColumns({"low": low, "rest": _trim(rest)})
    x = x.withColumns({"name": _trim(F.substring_index("rest", " as ", 1)), "alias": F.contains("rest", F.lit(" as ")) & ~F.col("rest").endswith(" as ")})
    kind = F.when(F.col("low").isin(*SEQUENCE_FORBIDDEN), "forbidden").when(F.col("low").isin(*STYLING), "styling").when(F.col("low").isin("create", "destroy"), "life").when(F.col("low").isin("participant", "actor"), "person")
    kind = kind.when(F.col("low").isin("title", "alt", "else", "opt", "loop", "par", "and", "end", "critical", "option", "break"), "block").when(_whole(said, MESSAGE), "message").otherwise("unknown")
    x = cut(x.withColumn("kind", kind).withColumns({f"m{k}": F.when(F.col("kind") == "message", _trim(_group(said, MESSAGE, k))) for k in (1, 3, 4, 5)}), "lint-sequence")
    person, message = F.col("kind") == "person", F.col("kind") == "message"
    proper = _whole(F.col("name"), r"[A-Za-z][A-Za-z0-9_]*")
    issues = [
        _told(
            x,
            ("error", "seq-forbidden", F.col("kind") == "forbidden"),
            ("error", "styling-unsupported", F.col("kind") == "styling"),
            ("warning", "seq-lifecycle", F.col("kind") == "life"),
            ("error", "seq-alias", person & F.col("alias")),
            ("error", "seq-participant-id", person & ~proper),
            ("warning", "seq-cryptic-id", person & proper & _whole(F.col("name"), "[a-z][a-z0-9]?")),
            ("error", "seq-activation", message & (F.col("m3") != "")),
            ("warning", "seq-unlabeled", message & (F.col("m5") == "")),
            ("warning", "seq-semicolon", message & F.contains("m5", F.lit(";"))),
            ("warning", "seq-unparsed", F.col("kind") == "unknown"),
        )
    ]
    told = x.where(message)
    people = x.where(person).select("view", "name").union(told.select("view", "m1")).union(told.select("view", "m4"))
    issues.append(_issue(every.join(told.select("view"), "view", "left_anti"), "error", "seq-empty", F.lit(0)))
    return reduce(DataFrame.union, [*issues, _dense(every, people, told, limits)])


def _state(rows: DataFrame, every: DataFrame, limits: tuple[int, int]) -> DataFrame:
    said = F.col("said")
    word = F.lower(F.get(F.split(said, r"\s+"), F.lit(0)))
    kind = F.when(word.isin(*STYLING) | F.contains(said, F.lit(":::")), "styling").when((word == "note") | F.lower(said).startswith("end note"), "note").when((word == "direction") | (said == "--"), "skip").when(said == "}", "close")
    kind = kind.when((word == "state") & _whole(said, STATE_FORM), "state").when(word == "state", "bad").when(said == "[*]", "marker").when(_whole(said, TRANSITION_FORM), "move").when(said.rlike(r"[^-]->[^>]"), "arrow")
    kind = kind.when(said.rlike(r"\A[^\s:]+\s*:"), "label").when(_whole(said, r"[A-Za-z]\w*"), "plain").otherwise("unknown")
    x = rows.withColumn("kind", kind)
    opens = (F.col("kind") == "state") & _group(said, STATE_FORM, 2).endswith("{")
    x = x.withColumns({"opens": opens, "a": F.when(F.col("kind") == "move", _group(said, TRANSITION_FORM, 1)), "b": F.when(F.col("kind") == "move", _group(said, TRANSITION_FORM, 2))})
    x = cut(x, "lint-state")
    x, nested = _nested(x, F.when(F.col("opens"), 1).when(F.col("kind") == "close", -1).otherwise(0), "}", "unbalanced-brace", "unbalanced-brace")
    across = lambda c: (F.col(c) != "[*]") & F.contains(c, F.lit("."))
    is_ = lambda k: F.col("kind") == k
    issues = _told(
        x,
        ("error", "state-styling", is_("styling")),
        ("error", "state-note", is_("note")),
        ("error", "state-syntax", is_("bad")),
        ("warning", "nesting", F.col("opens") & (F.col("depth") > 2)),
        ("error", "state-bare-marker", is_("marker")),
        ("error", "state-cross-composite", is_("move") & (across("a") | across("b"))),
        ("error", "state-arrow", is_("arrow")),
        ("warning", "state-unparsed", is_("unknown")),
    )
    moves = x.where(is_("move"))
    named = F.when(is_("state"), _group(said, STATE_FORM, 1)).when(is_("label"), F.regexp_extract(said, r"\A([^\s:]+)\s*:", 1)).when(is_("plain"), said)
    states = x.select("view", named.alias("name")).where("name is not null").union(moves.select("view", "a")).union(moves.select("view", "b")).where("name <> '[*]'")
    empty = _issue(every.join(moves.select("view"), "view", "left_anti"), "error", "state-empty", F.lit(0))
    return reduce(DataFrame.union, [nested, issues, empty, _dense(every, states, moves, limits)])


def _erd(rows: DataFrame, every: DataFrame, limits: tuple[int, int]) -> DataFrame:
    said = F.col("said")
    word = F.lower(F.get(F.split(said, r"\s+"), F.lit(0)))
    kind = F.when(word.isin(*STYLING) | F.contains(said, F.lit(":::")), "styling").when(word == "note", "note").when(word.isin("direction", "title"), "skip").when(_whole(said, ENTITY_FORM), "entity").when(_whole(said, RELATION), "relation").otherwise("unknown")
    x = rows.withColumn("outside", kind)
    # a body lasts from a line that opens one to the next that is a bracket alone
    turn = F.when(said == "}", False).when((F.col("outside") == "entity") & (_group(said, ENTITY_FORM, 2) != "") & (_group(said, ENTITY_FORM, 3) == ""), True)
    order = Window.partitionBy("view").orderBy("line")
    x = x.withColumn("turn", turn).withColumn("inside", F.coalesce(F.last("turn", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    x = x.withColumn("kind", F.when(F.col("inside"), F.when(said == "}", "close").otherwise("attribute")).otherwise(F.col("outside")))
    relation = F.col("kind") == "relation"
    x = x.withColumns({f"m{k}": F.when(relation, _group(said, RELATION, k)) for k in (1, 2, 3, 4)}).withColumn("entity", F.when(F.col("kind") == "entity", _group(said, ENTITY_FORM, 1)))
    x = cut(x, "lint-erd")
    alias = relation & (F.contains("m1", F.lit("[")) | F.contains("m3", F.lit("[")))
    left, right = _group(F.col("m2"), r"(..)(?:--|\.\.)(..)", 1), _group(F.col("m2"), r"(..)(?:--|\.\.)(..)", 2)
    labelled = said.rlike(rf"\A(?:{RELATION.removesuffix('?')})\z")
    bare = _trim(F.col("m4")) == ""
    odd = lambda c: ~_whole(F.col(c), ENTITY_NAME)
    issues = _told(
        x,
        ("error", "erd-attribute", (F.col("kind") == "attribute") & ~_whole(said, ATTRIBUTE_FORM)),
        ("warning", "erd-styling", F.col("kind") == "styling"),
        ("error", "erd-note", F.col("kind") == "note"),
        ("error", "erd-entity-name", ((F.col("kind") == "entity") & odd("entity")) | (relation & ~alias & (odd("m1") | odd("m3")))),
        ("error", "erd-alias-in-relation", alias),
        ("error", "erd-cardinality", relation & ~(left.isin(*LEFT_ENDS) & right.isin(*RIGHT_ENDS))),
        ("error", "erd-relation-label", relation & bare & ~labelled),
        ("warning", "erd-relation-label", relation & bare & labelled),
        ("error", "erd-syntax", F.col("kind") == "unknown"),
    )
    named = x.where("entity is not null").select("view", F.col("entity").alias("name"))
    near = x.where(relation & ~alias)
    named = named.union(near.select("view", "m1")).union(near.select("view", "m3"))
    last = x.groupBy("view").agg(F.max_by(F.coalesce("turn", "inside"), "line").alias("open"))
    unclosed = _issue(last.where("open"), "error", "unbalanced-brace", F.lit(0))
    empty = _issue(every.join(named.select("view"), "view", "left_anti"), "error", "erd-empty", F.lit(0))
    return reduce(DataFrame.union, [issues, unclosed, empty, _dense(every, named, x.where(relation), limits)])


def linted(texts: DataFrame, limits: tuple[int, int] = LIMITS) -> DataFrame:
    """(view, severity, rule, line) of texts (view, renderer, text), one a view: each issue once; line 0 is the whole text. A null text is an empty one."""
    spoken = cut(_spoken(texts), "lint-texts")
    checked, issues = _headers(spoken)
    every = cut(checked.select("view", "renderer"), "lint-views")
    known = {r.renderer for r in every.where(F.col("renderer").isin(*HEADERS)).select("renderer").distinct().collect()}
    body = cut(checked.select("view", "renderer", F.posexplode("l").alias("at", "x")).where("at > 0").select("view", "renderer", "x.line", (F.col("at") + 1).alias("n"), "x.said"), "lint-bodies")
    out = [issues]
    for renderers, check in ((("flowchart", "architecture"), _flow), (("sequence",), _sequence), (("state",), _state), (("erd",), _erd)):
        if known.intersection(renderers):  # a check of no text at all still writes and reads its tables
            mine = F.col("renderer").isin(*renderers)
            out.append(check(body.where(mine), every.where(mine).select("view"), limits))
    return reduce(DataFrame.union, out).distinct()


def gate(tries: DataFrame, limits: tuple[int, int] = LIMITS) -> DataFrame:
    """(view, text, outcome) of tries (view, turn, renderer, text): the first text of a view without an error: ok, or fallback if it isn't the first; else no text and the rules that the last one broke. A null text was not made at all: dropped: unmade."""
    name = F.concat_ws("\u0001", F.col("view"), F.col("turn").cast("string"))
    x = cut(tries.withColumn("key", name), "gate-tries")
    errors = linted(x.where("text is not null").select(F.col("key").alias("view"), "renderer", "text"), limits).where("severity = 'error'").groupBy(F.col("view").alias("key")).agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    x = x.join(errors, "key", "left").withColumn("rules", F.when(F.col("text").isNull(), F.array(F.lit("unmade"))).otherwise(F.col("rules")))
    first = F.min_by(F.struct("turn", "text"), F.when(F.col("rules").isNull(), F.col("turn"))).alias("good")
    x = x.groupBy("view").agg(first, F.max_by("rules", "turn").alias("rules"))
    return x.select("view", "good.text", F.when(F.col("good.turn") == 0, "ok").when(F.col("good").isNotNull(), "fallback").otherwise(F.concat(F.lit("dropped: "), F.array_join("rules", ", "))).alias("outcome"))
