"""Names, evidence, views and runs on small inputs with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygraph.functions import names as N
from quarrygraph.operators import evidence as E
from quarrygraph.operators import runs, views


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_names(spark):
    l = F.lit
    assert one(spark, N.stable_id(l("a"), l(""), l(None), l("b")), N.topic(l("x"), l("/n/")), N.topic(l("x"), l("")), N.topic(l("~x"), l("n")), N.topic(l(""), l("n"))) == ["a:b", "/n/x", "/x", "~x", ""]
    assert one(spark, N.remote(l("https://u:t@h/x")), N.dependency(l(" Foo_Bar[x]>=1")), N.comparable(l(" 'A'  b")), N.message(l("a: #b"))) == ["https://h/x", "foo-bar", "a b", "a - b"]
    assert one(spark, N.label(l('a "b"; <c> &amp; 5%')), N.label(l("  ")), N.label(l(None).cast("string")), N.label(l("x" * 90))) == ["a 'b' ‹c› 5％", "unnamed", "unnamed", "x" * 77 + "..."]
    assert one(spark, N.clearly_limited(l("Too many requests")), N.clearly_limited(l("x" * 400 + " 429")), N.clearly_limited(l(None).cast("string")), N.line_of(l("a\nb\nc"), l(2))) == [True, False, False, 2]
    assert [N.camel(x) for x in ("auth server", "Été_one", "9x", "", "!!")] == ["authServer", "eteOne", "n9x", "n", "n"]
    assert len(N.camel("long name " * 9)) == 32 and N.camel("long name " * 9) != N.camel("long name " * 8)
    assert [N.pascal(x) for x in ("service.py", "auth server", "9 lives", ".py", "a" * 30, "one two three four five six seven")] == ["Service", "AuthServer", "P9Lives", "Py", "A" + "a" * 23, "OneTwoThreeFourFiveSix"]
    df = spark.createDataFrame([(["a", "A", "a2", "end", "a"], ["end"]), ([], [])], "n array<string>, r array<string>")
    assert [r.x for r in df.select(N.allocated("n", "r").alias("x")).collect()] == [["a", "A2", "a22", "endNode", "a3"], []]
    code = 'x = "a\\"b // c"; // rest\ny /* in\nside */ \'q\' "open\nz'
    got = one(spark, N.blanked(l(code)))[0]
    assert len(got) == len(code) and got.count("\n") == code.count("\n") and "rest" not in got and "side" not in got and "open" not in got and got.endswith("\nz") and got.startswith('x = "')


def test_evidence(spark):
    cited = [(1, "./a.py", "2-3", "m.run()", None, None, "calls"), (2, "a.py", "2", "gone", "confirmed", None, None), (3, "../a.py", "1", None, None, None, None), (4, None, "1", None, None, None, None), (5, "b.py", "1", None, None, None, None), (6, "README.md", None, None, "confirmed", None, None), (7, "a.py", None, None, None, None, None), (8, "a.py", "9-12", None, None, None, None), (9, "a.py", "1", None, "sure", None, None), (10, "a.py", "1", None, "dynamic_observed", "", None), (11, "a.py", "1:2", "", "confirmed", "d" * 300, "calls"), (12, "c.py", "1", None, None, None, None), (13, "README.md", "1", None, "confirmed", None, None), (14, "a.py", "8", "run", None, None, None), (15, "a.py", "0", None, None, None, None)]
    c = spark.createDataFrame(cited, "id int, file string, lines string, symbol string, status string, detail string, kind string")
    files = spark.createDataFrame([("a.py",), ("c.py",)], "path string")
    lines = spark.createDataFrame([("a.py", i, "def run():" if i == 5 else "x") for i in range(1, 11)] + [("README.md", 1, "t")], "path string, line_no int, text string")
    got = {r.id: r for r in E.admit(c, files, lines).collect()}
    assert {i: r.reason for i, r in got.items()} == {1: None, 2: "symbol not found", 3: "file outside", 4: "missing file", 5: "not in inventory", 6: "missing lines", 7: "missing lines", 8: "lines out of range", 9: "invalid status", 10: "observation without detail", 11: None, 12: "not readable", 13: None, 14: None, 15: "lines out of range"}
    assert (got[1].line_start, got[1].line_end, got[1].status) == (2, 3, "static_inferred") and got[11].status == "static_inferred" and len(got[11].detail) == 200
    assert (got[13].status, got[13].source) == ("documented_only", "doc")
    assert E.admit(c.where("false"), files, lines).count() == 0
    parts = spark.createDataFrame([(1, "x", "y"), (2, "x", "no"), (3, None, "y")], "at int, src string, dst string")
    nodes = spark.createDataFrame([("x",), ("y",)], "id string")
    assert sorted(r.at for r in E.keep_whole(parts, nodes, ["src", "dst"]).collect()) == [1, 3]
    later = spark.createDataFrame([("k", 1, "a", 5), ("k", 2, None, 6)], "id string, o int, v string, w int")
    assert [tuple(r) for r in E.replace_later(later, "id", "o").collect()] == [("k", 2, None, 6)]


def test_suffix_labels(spark):
    rows = [("g", "1", "a/x/m.py"), ("g", "2", "b/x/m.py"), ("g", "3", "x/n.py"), ("h", "4", "a/x/m.py"), ("g", "5", "m.py"), ("g", "6", "same/p"), ("g", "7", "same/p")]
    got = {r.key: r.label for r in views.suffix_labels(spark.createDataFrame(rows, "grp string, key string, path string"), "grp", "key", "path").collect()}
    assert got == {"1": "a/x/m.py", "2": "b/x/m.py", "3": "n.py", "4": "m.py", "5": "m.py", "6": "same/p", "7": "same/p"}


def test_fit(spark):
    units = [("v", f"n{i}", "code", f"N{i}", False) for i in range(4)] + [("v", "cfg", "config", "C", False), ("v", "ch", "channel", "H", False), ("v", "pin", "code", "P", True), ("w", "cfg", "config", "C", False)]
    edges = [("v", "n0", "ch", 1, False), ("v", "ch", "n1", 1, False), ("v", "n0", "n2", 5, False), ("v", "n1", "n2", 1, True), ("v", "cfg", "n0", 1, False), ("v", "n0", "n0x", 1, False)]
    u = spark.createDataFrame(units, "view string, id string, kind string, label string, pinned boolean")
    e = spark.createDataFrame(edges, "view string, src string, dst string, weight int, weak boolean")
    a, b, notes = views.fit(u, e, 4, 2)
    assert {(r.view, r.id) for r in a.collect()} == {("v", "pin"), ("v", "n0"), ("v", "n1"), ("v", "n2"), ("w", "cfg")}
    assert {(r.src, r.dst, r.weight) for r in b.collect()} == {("n0", "n1", 1), ("n0", "n2", 5)}
    assert {(r.view, r.step, r.n) for r in notes.collect()} == {("v", "settings left out", 1), ("v", "channels drawn as direct edges", 1), ("v", "least connected left out", 1), ("v", "edges left out", 1)}
    a, b, notes = views.fit(u, e, 25, 30)
    assert a.count() == len(units) and b.count() == 5 and notes.count() == 0


def test_sizes_of_views_are_no_windows(spark):
    u = spark.createDataFrame([("v", "a", "code", "A", False)], "view string, id string, kind string, label string, pinned boolean")
    e = spark.createDataFrame([("v", "a", "a", 1, False)], "view string, src string, dst string, weight int, weak boolean")
    said = views.fit(u, e)[0]._jdf.queryExecution().analyzed().toString().lower()
    assert "row_number() windowspec" in said and "count(1) windowspec" not in said


def test_view_parts(spark):
    t = spark.createDataFrame([("v", "a", "b"), ("v", "b", "c"), ("v", "b", "b"), ("v", "d", "d")], "view string, src string, dst string")
    initial = spark.createDataFrame([("v", "a")], "view string, state string")
    assert {r.state for r in views.finals(t, initial).collect()} == {"c"}
    assert {r.node: r.role for r in views.flow_ends(t).collect()} == {"a": "source", "b": "process", "c": "sink", "d": "process"}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert {(r.src, r.dst): r.in_cycle for r in views.import_cycles(e).collect()} == {("a", "b"): True, ("b", "c"): True, ("c", "a"): True, ("c", "d"): False}
    v = spark.createDataFrame([("p", 1, ["a", "b"], ["a|b"]), ("q", 1, ["a", "b", "c"], ["a|b", "b|c"]), ("r", 1, ["a", "b", *"cdefg"], ["a|b", "b|c"]), ("s", 2, ["a", "b", "c"], ["a|b"])], "view string, level int, nodes array<string>, pairs array<string>")
    assert {(r.a, r.b) for r in views.subsumed(v).collect()} == {("p", "q")}


def test_runs(spark):
    log = [("a", 1, "begin", None), ("a", 2, "generate", "ok"), ("a", 3, "place", "ok"), ("a", 4, "verify", "ok"), ("b", 1, "generate", "error"), ("b", 2, "generate", "error"), ("b", 3, "generate", "ok"), ("c", 1, "begin", None), ("d", 1, "begin", None), ("d", 2, "reconcile", "landed"), ("e", 1, "place", "ok"), ("f", 1, "generate", "error"), ("f", 2, "generate", "ok")]
    df = spark.createDataFrame(log, "id string, seq int, action string, outcome string")
    assert {r.id: (r.status, r.attempts, r.uncertain) for r in runs.fold(df).collect()} == {"a": ("verified", 0, False), "b": ("failed", 2, False), "c": ("pending", 0, True), "d": ("generated", 0, False), "e": ("pending", 0, False), "f": ("generated", 0, False)}
    v = spark.createDataFrame([("a", ["One", "'Two'", "x", "one"]), ("b", ["One", "Two", "Three"]), ("c", []), ("d", ["One"])], "view string, labels array<string>")
    found = spark.createDataFrame([("a", "ONE  two"), ("b", "one"), ("c", "")], "view string, text string")
    got = {r.view: (r.verdict, r.ratio, r.missing) for r in runs.verify(runs.expected_labels(v), found).collect()}
    assert got == {"a": ("ok", 1.0, []), "b": ("mismatch", 0.33, ["two", "three"]), "c": ("unknown", 0.0, []), "d": ("missing", 0.0, ["one"])}
    c = spark.createDataFrame([("m", 0, "team::1", "Alpha"), ("m", 1, "team::2", "Alpha two"), ("m", 2, "team::3", "Beta")], "menu string, pos int, key string, name string")
    r = spark.createDataFrame([(1, "m", "use team::2"), (2, "m", "alpha"), (3, "m", "bet"), (4, "m", "a"), (5, "m", ""), (6, "z", "x")], "reply_id int, menu string, reply string")
    assert {x.reply_id: x.key for x in runs.choose(r, c).collect()} == {1: "team::2", 2: "team::1", 3: "team::3", 4: None, 5: None, 6: None}


def test_budget(spark):
    log = spark.createDataFrame([("k", 100.0 + i, "attempt", None) for i in range(8)] + [("k", 101.0, "outcome", None), ("k", 102.0, "attempt", False)], "key string, ts double, event string, counted boolean")
    assert list(runs.usage(log, 130.0).first()) == [8, 8, 0, 152]
    asks = spark.createDataFrame([("k", 130.0, 1), ("k", 160.5, 1), ("k", 130.0, 9), ("k", 99.0, 1), ("z", 1.0, 1)], "key string, at double, need int")
    got = {(r.key, r.at, r.need): (r.used, round(r.wait, 2)) for r in runs.admission(log, asks).collect()}
    assert got == {("k", 130.0, 1): (8, 30.01), ("k", 160.5, 1): (7, 0.0), ("k", 130.0, 9): (8, float("inf")), ("k", 99.0, 1): (0, 0.0), ("z", 1.0, 1): (0, 0.0)}
