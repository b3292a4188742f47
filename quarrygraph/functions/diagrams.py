"""Diagram texts: rendering of views, each diagram on its own, and a check of one text.

A diagram is small by the limits of readability, so one Arrow UDF over whole specs is the right size to render it. Texts of
many diagrams are checked in tables (operators/lint.py); lint says the same of one text, without Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrygraph.functions.names import camel, pascal

#: Headers, reserved words, cardinalities and statement words of the diagram language.
HEADERS = {"flowchart": "flowchart", "architecture": "flowchart", "sequence": "sequenceDiagram", "state": "stateDiagram-v2", "erd": "erDiagram"}
DIRECTIONS = {"LR", "TD", "TB", "RL", "BT"}
RESERVED = {"end", "graph", "flowchart", "subgraph", "class", "classdef", "click", "style", "linkstyle", "direction", "default"}
SHAPES = {"unit": ("[", "]"), "store": ("[(", ")]"), "decision": ("{", "}"), "terminal": ("([", "])"), "channel": ("[[", "]]"), "external": ("((", "))")}
CARDINALITIES = {"one-one": "||--||", "one-many": "||--o{", "many-one": "}o--||", "many-many": "}o--o{"}
LEFT_ENDS, RIGHT_ENDS = {"||", "|o", "}o", "}|"}, {"||", "o|", "o{", "|{"}
SEQUENCE_FORBIDDEN = {"note", "box", "rect", "autonumber", "activate", "deactivate", "link", "links"}
STYLING = {"classdef", "class", "style", "linkstyle"}
#: Forms of a declared state, a transition, an entity's attribute, and names.
STATE_FORM = r'state\s+(?:"[^"]*"\s+as\s+)?([^\s{<]+)\s*(.*)'
TRANSITION_FORM = r"(\S+?)\s*-->\s*([^\s:]+)\s*(?::.*)?"
ATTRIBUTE_FORM = r'[A-Za-z_][\w\-\[\]()]*\s+\*?[A-Za-z_][\w\-\[\]().]*(\s+(PK|FK|UK)(\s*,\s*(PK|FK|UK))*)?(\s+"[^"]*")?'
ENTITY_FORM = r'([^\s{\["]+)\s*(?:\[\s*"[^"]*"\s*\])?\s*(\{)?\s*(\})?'
ENTITY_NAME, NODE_NAME = r"[A-Za-z_][A-Za-z0-9_-]*", r"[A-Za-z][A-Za-z0-9]*"


def _ids(things: list[dict], name=camel) -> dict[str, str]:
    """Ids by key: unique whatever their case, never reserved, in the order given."""
    used, out = set(RESERVED), {}
    for t in things:
        base, n = name(str(t.get("label") or t["id"])) or "N", 1
        at = base
        while at.lower() in used:
            n += 1
            at = f"{base}{n}"
        used.add(at.lower())
        out[t["id"]] = at
    return out


def _quote(x: str) -> str:
    return '"' + x.replace('"', "'") + '"'


def render(spec: dict) -> str:
    """The text of a spec {renderer, direction, nodes: [{id, label, shape, group, attributes}], edges: [{src, dst, label, async, cardinality}], initial, finals}.

    An edge with an end that is no node raises KeyError. Edges of one pair are drawn once, labels joined by a slash.
    """
    kind, nodes = spec["renderer"], spec.get("nodes", [])
    ids = _ids(nodes, pascal if kind in ("sequence", "erd") else camel)
    edges = [(ids[e["src"]], ids[e["dst"]], e.get("label") or "", e) for e in spec.get("edges", [])]
    if kind == "sequence":
        arrow = lambda e: "-)" if e.get("async") else "-->>" if e.get("reply") else "->>"
        return "\n".join(["sequenceDiagram", *(f"  participant {i}" for i in ids.values()), *(f"  {a}{arrow(e)}{b}: {label or 'calls'}" for a, b, label, e in edges)])
    merged: dict[tuple[str, str], list] = {}
    for a, b, label, e in edges:
        labels = merged.setdefault((a, b), [[], e])[0]
        if label and label not in labels:
            labels.append(label)
    pairs = [(a, b, " / ".join(labels), e) for (a, b), (labels, e) in merged.items()]
    if kind == "state":
        named = [f"  {ids[n['id']]} : {n['label']}" for n in nodes if n.get("label") and n["label"] != ids[n["id"]]]
        begin = [f"  [*] --> {ids[spec['initial']]}"] if spec.get("initial") else []
        moves = [f"  {a} --> {b}" + (f" : {label}" if label else "") for a, b, label, _ in pairs]
        return "\n".join(["stateDiagram-v2", *named, *begin, *moves, *(f"  {ids[f]} --> [*]" for f in spec.get("finals", []))])
    if kind == "erd":
        blocks = [line for n in nodes for line in ([f"  {ids[n['id']]} {{", *(f"    {a['type']} {a['name']}" + (f" {a['key']}" if a.get("key") else "") for a in n["attributes"]), "  }"] if n.get("attributes") else [f"  {ids[n['id']]}"])]
        return "\n".join(["erDiagram", *blocks, *(f"  {a} {CARDINALITIES.get(e.get('cardinality'), '||--o{')} {b} : {_quote(label or 'relates')}" for a, b, label, e in pairs)])

    def node(n: dict, pad: str) -> str:
        left, right = SHAPES.get(n.get("shape"), SHAPES["unit"])
        return f"{pad}{ids[n['id']]}{left}{_quote(n.get('label') or n['id'])}{right}"

    groups = sorted({n["group"] for n in nodes if n.get("group")})
    boxes = _ids([{"id": g, "label": f"{g} group"} for g in groups])
    lines = [f"flowchart {'LR' if kind == 'architecture' else spec.get('direction') or 'TD'}"]
    for g in groups:
        lines += [f"  subgraph {boxes[g]}[{_quote(g)}]", *(node(n, "    ") for n in nodes if n.get("group") == g), "  end"]
    lines += [node(n, "  ") for n in nodes if not n.get("group")]
    lines += [f"  {a} {'-.->' if e.get('async') else '-->'}" + (f"|{_quote(label)}|" if label else "") + f" {b}" for a, b, label, e in pairs]
    return "\n".join(lines)


def _statements(text: str) -> Iterator[tuple[int, str]]:
    for i, raw in enumerate(text.split("\n"), 1):
        said = raw.strip().rstrip(";").strip()
        if said and not said.startswith("%%"):
            yield i, said


Issue = tuple[str, str, int]
_NODE = r"([A-Za-z][\w-]*)\s*(?:\[\[.*?\]\]|\[\(.*?\)\]|\(\[.*?\]\)|\(\(.*?\)\)|\[.*?\]|\{\{.*?\}\}|\{.*?\}|\(.*?\))?(?:::[\w:]+)?"
_LINK = r"\s*(?:<?--+>|<?==+>|<?-\.+->|---+|===+|-\.+-|--[xo])\s*(?:\|[^|]*\|\s*)?"


def _ends(part: str) -> list[str] | None:
    found = [re.fullmatch(_NODE, p.strip()) for p in part.split(" & ")]
    return [m[1] for m in found] if all(found) else None


def _flow(rows: list[tuple[int, str]], limits: tuple[int, int]) -> Iterator[Issue]:
    nodes, boxes, styled, edges, open_boxes = {}, {}, [], [], []
    for line, said in rows:
        word = said.split()[0].lower()
        if word == "subgraph":
            m = re.match(r"subgraph\s+([\w-]+)", said)
            if not m:
                yield "error", "subgraph", line
                continue
            boxes.setdefault(m[1], line)
            open_boxes.append(m[1])
        elif said == "end":
            if not open_boxes:
                yield "error", "unbalanced-end", line
            else:
                open_boxes.pop()
        elif word in ("style", "class"):
            styled += [(line, t) for t in said.split()[1].split(",")] if len(said.split()) > 1 else []
        elif word not in ("direction", "classdef", "linkstyle", "click"):
            hidden = re.sub(r'"[^"]*"', '""', said)
            ends = [_ends(p) for p in re.split(_LINK, hidden)]
            if None in ends:
                yield "error", "flow-syntax", line
                continue
            for name in (n for part in ends for n in part):
                if name not in boxes:
                    nodes.setdefault(name, line)
            edges += [(line, a, b) for x, y in zip(ends, ends[1:]) for a in x for b in y]
    if open_boxes:
        yield "error", "unclosed-subgraph", 0
    for name, line in [*nodes.items(), *boxes.items()]:
        if name.lower() in RESERVED:
            yield "error", "reserved-id", line
        if "_" in name:
            yield "error", "underscore-id", line
        elif name in nodes and not re.fullmatch(NODE_NAME, name):
            yield "warning", "id-format", line
    for name in nodes.keys() & boxes.keys():
        yield "error", "id-collision", nodes[name]
    seen = set()
    for line, a, b in edges:
        if a in boxes or b in boxes:
            yield "warning", "edge-to-subgraph", line
        if (a, b) in seen:
            yield "warning", "duplicate-edge", line
        seen.add((a, b))
    yield from (("warning", "unknown-style-target", line) for line, t in styled if t not in nodes and t not in boxes)
    yield from _dense(len(nodes), len(edges), limits)


def _dense(nodes: int, edges: int, limits: tuple[int, int]) -> Iterator[Issue]:
    if nodes > limits[0] or edges > limits[1]:
        yield "warning", "density", 0


def _sequence(rows: list[tuple[int, str]], limits: tuple[int, int]) -> Iterator[Issue]:
    people, messages = set(), 0
    for line, said in rows:
        word, _, rest = said.partition(" ")
        low = word.lower()
        if low in SEQUENCE_FORBIDDEN:
            yield "error", "seq-forbidden", line
        elif low in STYLING:
            yield "error", "styling-unsupported", line
        elif low in ("create", "destroy"):
            yield "warning", "seq-lifecycle", line
        elif low in ("participant", "actor"):
            name, alias, _ = rest.strip().partition(" as ")
            if alias:
                yield "error", "seq-alias", line
            if not re.fullmatch(r"[A-Za-z]\w*", name.strip(), re.A):
                yield "error", "seq-participant-id", line
            elif re.fullmatch(r"[a-z][a-z0-9]?", name.strip()):
                yield "warning", "seq-cryptic-id", line
            people.add(name.strip())
        elif low in ("title", "alt", "else", "opt", "loop", "par", "and", "end", "critical", "option", "break"):
            continue
        elif m := re.fullmatch(r"([^-:]+?)\s*(--?>>?|--?\)|--?x)\s*([+-]?)\s*([^:]+?)\s*(?::(.*))?", said):
            messages += 1
            people |= {m[1].strip(), m[4].strip()}
            if m[3]:
                yield "error", "seq-activation", line
            if not (m[5] or "").strip():
                yield "warning", "seq-unlabeled", line
            elif ";" in m[5]:
                yield "warning", "seq-semicolon", line
        else:
            yield "warning", "seq-unparsed", line
    if not messages:
        yield "error", "seq-empty", 0
    yield from _dense(len(people), messages, limits)


def _state(rows: list[tuple[int, str]], limits: tuple[int, int]) -> Iterator[Issue]:
    depth, states, moves = 0, set(), 0
    for line, said in rows:
        word = said.split()[0].lower()
        if word in STYLING or ":::" in said:
            yield "error", "state-styling", line
        elif word == "note" or said.lower().startswith("end note"):
            yield "error", "state-note", line
        elif word == "direction" or said == "--":
            continue
        elif said == "}":
            if not depth:
                yield "error", "unbalanced-brace", line
            depth = max(depth - 1, 0)
        elif word == "state":
            m = re.fullmatch(STATE_FORM, said)
            if not m:
                yield "error", "state-syntax", line
                continue
            states.add(m[1])
            depth += m[2].endswith("{")
            if m[2].endswith("{") and depth > 2:
                yield "warning", "nesting", line
        elif said == "[*]":
            yield "error", "state-bare-marker", line
        elif m := re.fullmatch(TRANSITION_FORM, said):
            moves += 1
            states |= {m[1], m[2]} - {"[*]"}
            for end in (m[1], m[2]):
                if end != "[*]" and "." in end:
                    yield "error", "state-cross-composite", line
        elif re.search(r"[^-]->[^>]", said):
            yield "error", "state-arrow", line
        elif m := re.match(r"([^\s:]+)\s*:", said):
            states.add(m[1])
        elif re.fullmatch(r"[A-Za-z]\w*", said):
            states.add(said)
        else:
            yield "warning", "state-unparsed", line
    if depth:
        yield "error", "unbalanced-brace", 0
    if not moves:
        yield "error", "state-empty", 0
    yield from _dense(len(states), moves, limits)


def _erd(rows: list[tuple[int, str]], limits: tuple[int, int]) -> Iterator[Issue]:
    entities, relations, inside = set(), 0, False

    def named(*names: str) -> Iterator[Issue]:
        for name in names:
            entities.add(name)
            if not re.fullmatch(ENTITY_NAME, name):
                yield "error", "erd-entity-name", line

    for line, said in rows:
        word = said.split()[0].lower()
        if inside:
            inside = said != "}"
            if inside and not re.fullmatch(ATTRIBUTE_FORM, said):
                yield "error", "erd-attribute", line
        elif word in STYLING or ":::" in said:
            yield "warning", "erd-styling", line
        elif word == "note":
            yield "error", "erd-note", line
        elif word in ("direction", "title"):
            continue
        elif m := re.fullmatch(ENTITY_FORM, said):
            yield from named(m[1])
            inside = bool(m[2]) and not m[3]
        elif (m := re.fullmatch(r"(\S+)\s+(\S*(?:--|\.\.)\S*)\s+(\S+)\s*(?::\s*(.*))?", said)) is not None:
            relations += 1
            if "[" in m[1] + m[3]:
                yield "error", "erd-alias-in-relation", line
            else:
                yield from named(m[1], m[3])
            c = re.fullmatch(r"(..)(?:--|\.\.)(..)", m[2])
            if not c or c[1] not in LEFT_ENDS or c[2] not in RIGHT_ENDS:
                yield "error", "erd-cardinality", line
            if not (m[4] or "").strip():
                yield "error" if m[4] is None else "warning", "erd-relation-label", line
        else:
            yield "error", "erd-syntax", line
    if inside:
        yield "error", "unbalanced-brace", 0
    if not entities:
        yield "error", "erd-empty", 0
    yield from _dense(len(entities), relations, limits)


_CHECKS = {"flowchart": _flow, "architecture": _flow, "sequence": _sequence, "state": _state, "erd": _erd}


def lint(text: str, renderer: str, limits: tuple[int, int] = (25, 30)) -> list[Issue]:
    """Issues (severity, rule, line; line 0 is the whole text) of a text for a renderer, without repeats, by line, errors first."""
    rows = list(_statements(text))
    found: list[Issue] = []
    if not rows:
        return [("error", "header", 0)]
    (line, head), rest = rows[0], rows[1:]
    words = head.split()
    expected = HEADERS[renderer]
    if head == "---":
        return [("error", "front-matter", line)]
    if words[0] == "stateDiagram" and renderer == "state":
        found.append(("warning", "header", line))
    elif words[0] == "graph" and expected == "flowchart":
        found.append(("error", "header", line))
    elif words[0] != expected:
        return [("error", "header", line)]
    elif expected == "flowchart":
        if len(words) > 2 or len(words) == 2 and words[1] not in DIRECTIONS:
            found.append(("error", "header", line))
        if renderer == "architecture" and words[1:2] != ["LR"]:
            found.append(("error", "arch-direction", line))
    elif len(words) > 1:
        found.append(("error", "header", line))
    found += _CHECKS[renderer](rest, limits)
    return sorted(set(found), key=lambda i: (i[2], i[0] != "error", i[1]))


def gate(spec: dict) -> tuple[str | None, str, list[Issue]]:
    """(text, outcome, issues) of one spec, as gated says it of many."""
    tries = [spec] + ([{**spec, "renderer": "flowchart"}] if spec.get("renderer") == "architecture" else [])
    issues: list[Issue] = []
    for n, s in enumerate(tries):
        try:
            text = render(s)
        except (KeyError, TypeError) as e:
            return None, f"dropped: {type(e).__name__}", issues
        issues = lint(text, s["renderer"])
        if not any(i[0] == "error" for i in issues):
            return text, "fallback" if n else "ok", issues
    return None, "dropped: " + ", ".join(sorted({i[1] for i in issues if i[0] == "error"})), issues


@F.pandas_udf(StringType())
def rendered(specs: pd.Series) -> pd.Series:
    """The text of a spec as JSON; null where it lacks what a text needs."""

    def each(x):
        try:
            return render(json.loads(x))
        except (KeyError, TypeError):
            return None

    return specs.map(each, na_action="ignore")


def linted(texts: DataFrame) -> DataFrame:
    """(view, severity, rule, line) of texts (view, renderer, text), by the checks in tables (operators/lint.py)."""
    from quarrygraph.operators import lint as tables

    return tables.linted(texts)


def gated(specs: DataFrame) -> DataFrame:
    """(view, text, outcome) of specs (view, spec), spec as JSON: the text if it has no error, else that of the plain flowchart of an architecture, else none and why."""
    from quarrygraph.operators import lint as tables

    own = specs.select("view", "spec", F.get_json_object("spec", "$.renderer").alias("renderer"))
    plain = own.where("renderer = 'architecture'").select("view", F.lit(1).alias("turn"), F.lit("flowchart").alias("renderer"), F.regexp_replace("spec", r'"renderer"\s*:\s*"architecture"', '"renderer": "flowchart"').alias("spec"))
    tries = own.select("view", F.lit(0).alias("turn"), "renderer", "spec").union(plain)
    return tables.gate(tries.select("view", "turn", "renderer", rendered("spec").alias("text")))
