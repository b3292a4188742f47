"""Checks of diagram texts in tables against the check of one text, on made-up and broken texts."""

from __future__ import annotations

import random

import pytest

from quarrygraph.functions import diagrams as D
from quarrygraph.operators import lint

PIECES = {
    "flowchart": ['a[x] --> b["q --> r"]', "a --> b & c -.-> d", "subgraph g1 [Title]", "end", "g1 --> a", "style a fill:#fff", "class a,zz hot", "class", "x_y --> end", "%% note", "b -->|say| c;", "subgraph", "end", "a((r)) === b{{z}}", "a -- b", "direction LR", "g1", "A1B --> A1B", "graph --> a", "a:::hot --> b", "a &b"],
    "sequence": ["participant Web", "participant a as Alias", "actor a1", "participant 9x", "Web->>Api: get; it", "Web-->>Api:", "Api-)Web: +x", "Web->>+Api: go", "note over Web", "class x", "alt ok", "end", "create participant Z", "hello there", "A ->> B : hi", "title T"],
    "state": ["[*] --> on", "on --> off: press", 'state "Long" as long', "state big {", "}", "state deep {", "state <x", "note right", "on -> off", "[*]", "a.b --> c", "on : text", "plain", "classDef x", "--", "big:::x", "what is this", "state s <<fork>>"],
    "erd": ["USER {", "int id PK", "string name", "bad!", "}", "USER ||--o{ POST : writes", "USER ||--|{ POST", "USER x--o{ POST : y", "A[b] ||--|| C : z", "ORDER", "9BAD", "note x", "class x", "USER }o..o{ TAG :", 'E["Alias"] {', "E {}", "free words here now", "title T"],
}
HEADS = {"flowchart": ["flowchart LR", "flowchart", "graph TD", "flowchart XX", "---", "%% c\nflowchart TD;"], "architecture": ["flowchart LR", "flowchart TD"], "sequence": ["sequenceDiagram", "sequenceDiagram x", "flowchart"], "state": ["stateDiagram-v2", "stateDiagram", "state"], "erd": ["erDiagram", "erDiagram LR"]}


def texts(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        renderer = rng.choice(list(HEADS))
        some = PIECES["flowchart" if renderer == "architecture" else renderer]
        body = [("  " * rng.randrange(3)) + rng.choice(some) for _ in range(rng.choice([0, 1, 3, 8, 60 if i % 9 == 0 else 5]))]
        rows.append((f"v{i}", renderer, "\n".join([rng.choice(HEADS[renderer]), *body])))
    many = "\n".join(["flowchart LR", *(f"n{i} --> n{i + 1}" for i in range(40))])
    return [*rows, ("none", "erd", None), ("blank", "state", " \n;\n"), ("many", "flowchart", many)]


@pytest.mark.parametrize("seed", [1, 2])
def test_tables_say_what_one_text_says(spark, seed):
    rows = texts(150, seed)
    got: dict = {}
    for r in lint.linted(spark.createDataFrame(rows, "view string, renderer string, text string")).collect():
        got.setdefault(r.view, set()).add((r.severity, r.rule, r.line))
    for view, renderer, text in rows:
        assert got.get(view, set()) == set(D.lint(text or "", renderer)), text


def test_gate(spark):
    good, bad = "flowchart LR\na --> b", "flowchart LR\na_b --> end"
    rows = [("one", 0, "flowchart", good), ("two", 0, "architecture", bad), ("two", 1, "flowchart", good), ("three", 0, "architecture", good), ("three", 1, "flowchart", bad), ("four", 0, "flowchart", bad), ("five", 0, "erd", None)]
    got = {r.view: (r.text, r.outcome) for r in lint.gate(spark.createDataFrame(rows, "view string, turn int, renderer string, text string")).collect()}
    assert got == {"one": (good, "ok"), "two": (good, "fallback"), "three": (good, "ok"), "four": (None, "dropped: reserved-id, underscore-id"), "five": (None, "dropped: unmade")}
    assert lint.gate(spark.createDataFrame(rows, "view string, turn int, renderer string, text string").where("false")).count() == 0


def test_only_what_occurs_is_checked(spark, monkeypatch):
    """Checks of renderers without a text don't run; a statement's parts and numbers are told without numbering rows over a view."""
    ran = []
    for name in ("_flow", "_sequence", "_state", "_erd"):
        check = getattr(lint, name)
        monkeypatch.setattr(lint, name, lambda *a, check=check, name=name: ran.append(name) or check(*a))
    text = "%% note\nflowchart LR\n  A1 & B1 -->|said| C1;\n\n  subgraph S\n  C1 -- > D1\n  A1 --> C1\n  end\n  end"
    rows = [("a", "flowchart", text), ("b", "architecture", None), ("c", "flowchart", " ;\n%%")]
    df = spark.createDataFrame(rows, "view string, renderer string, text string")
    got = {tuple(r) for r in lint.linted(df).collect()}
    assert got == {("a", "error", "flow-syntax", 6), ("a", "warning", "duplicate-edge", 7), ("a", "error", "unbalanced-end", 9), ("b", "error", "header", 0), ("c", "error", "header", 0)}
    assert ran == ["_flow"]
    assert "Window" not in lint.statements(df)._jdf.queryExecution().toString()
