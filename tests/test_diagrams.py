"""Rendering and checking of diagram texts; what is rendered passes its own check."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrygraph.functions import diagrams as D

NODES = [{"id": "a", "label": "Auth server", "group": "G"}, {"id": "b", "label": "end", "shape": "store"}, {"id": "c", "label": 'say "hi"', "attributes": [{"type": "int", "name": "id", "key": "PK"}]}]
EDGES = [{"src": "a", "dst": "b", "label": "reads"}, {"src": "a", "dst": "b", "label": "writes"}, {"src": "b", "dst": "c", "async": True}]


@pytest.mark.parametrize("renderer", list(D.HEADERS))
def test_rendered_passes(renderer):
    spec = {"renderer": renderer, "nodes": NODES, "edges": EDGES, "initial": "a", "finals": ["c"]}
    text, outcome, issues = D.gate(spec)
    assert outcome == "ok" and not issues, (text, issues)
    assert D.gate({**spec, "edges": [{"src": "a", "dst": "gone"}]})[:2] == (None, "dropped: KeyError")


def test_flow_text():
    assert D.render({"renderer": "flowchart", "nodes": NODES, "edges": EDGES}).split("\n") == ["flowchart TD", '  subgraph gGroup["G"]', '    authServer["Auth server"]', "  end", '  end2[("end")]', '  sayHi["say \'hi\'"]', '  authServer -->|"reads / writes"| end2', "  end2 -.-> sayHi"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=12), st.sampled_from(["flowchart", "architecture", "erd"]))
def test_any_ids(labels, pairs, renderer):
    clean = ["".join(c for c in x if c.isprintable() and c not in '|"[](){}') for x in labels]
    nodes = [{"id": str(i), "label": x} for i, x in enumerate(clean)]
    edges = [{"src": str(a % len(nodes)), "dst": str(b % len(nodes))} for a, b in pairs]
    _, outcome, issues = D.gate({"renderer": renderer, "nodes": nodes, "edges": edges})
    assert outcome == "ok", issues


def rules(text, renderer):
    return [(r, n) for _, r, n in D.lint(text, renderer)]


def test_lint():
    assert rules("", "flowchart") == [("header", 0)] and rules("pie", "flowchart") == [("header", 1)] and rules("---\n", "erd") == [("front-matter", 1)]
    assert rules("graph LR\na-->b", "flowchart") == [("header", 1)] and rules("flowchart TD\na-->b", "architecture") == [("arch-direction", 1)]
    flow = "flowchart LR\n%% remark\na_b --> c\nc --> a_b\nc --> a_b\nsubgraph s\nd[x]\nend\nend\nc --> s\nstyle zz fill:#fff\nend1 & d --> e & f\n? ?"
    assert rules(flow, "flowchart") == [("underscore-id", 3), ("duplicate-edge", 5), ("unbalanced-end", 9), ("edge-to-subgraph", 10), ("unknown-style-target", 11), ("flow-syntax", 13)]
    assert ("density", 0) in rules("flowchart LR\n" + "\n".join(f"n{i} --> m{i}" for i in range(20)), "flowchart")
    seq = "sequenceDiagram\nparticipant A as Alpha\nparticipant x1\nNote over A: hi\nstyle A\nA->>+B: go\nA->>B\nA->>B: a;b\n???\nparticipant a b"
    assert rules(seq, "sequence") == [("seq-alias", 2), ("seq-cryptic-id", 3), ("seq-forbidden", 4), ("styling-unsupported", 5), ("seq-activation", 6), ("seq-unlabeled", 7), ("seq-semicolon", 8), ("seq-unparsed", 9), ("seq-participant-id", 10)]
    assert rules("sequenceDiagram\nparticipant Abc", "sequence") == [("seq-empty", 0)]
    state = "stateDiagram\n[*] --> A\nA -> B\nnote left\n[*]\nstate X {\nA.B --> C\n}\n}\nA:::k\nstate Y {"
    assert rules(state, "state") == [("unbalanced-brace", 0), ("header", 1), ("state-arrow", 3), ("state-note", 4), ("state-bare-marker", 5), ("state-cross-composite", 7), ("unbalanced-brace", 9), ("state-styling", 10)]
    erd = "erDiagram\nA {\n int id PK\n bad\n}\nA ||--o{ B : has\nA ||--|| C\nA xx--yy B : x\n1a\nA ||--o{ B[x] : y\nfoo bar baz\nD {"
    assert rules(erd, "erd") == [("unbalanced-brace", 0), ("erd-attribute", 4), ("erd-relation-label", 7), ("erd-cardinality", 8), ("erd-entity-name", 9), ("erd-alias-in-relation", 10), ("erd-syntax", 11)]


def test_frames(spark):
    t = spark.createDataFrame([("v", "state", None), ("w", "sequence", "sequenceDiagram\nA->>B: x")], "view string, renderer string, text string")
    assert [tuple(r) for r in D.linted(t).collect()] == [("v", "error", "header", 0)]
    s = spark.createDataFrame([("v", json.dumps({"renderer": "architecture", "nodes": NODES, "edges": EDGES}))], "view string, spec string")
    assert [r.outcome for r in D.gated(s).collect()] == ["ok"] and D.gated(s.where("false")).count() == 0
