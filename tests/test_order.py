"""Operators in which order decides, against plain loops: arrows that turn back, pairs that use each other up, strong components in tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import budgets, graphs, joins
from quarrygraph.sources import robots


def reaches(graph, start, goal):
    todo, seen = [start], set()
    while todo:
        v = todo.pop()
        if v == goal:
            return True
        if v not in seen:
            seen.add(v)
            todo += graph.get(v, [])
    return False


def plain_backward(rows):
    graph, out = {}, []
    for view, pos, a, b, anyway in sorted(rows):
        g = graph.setdefault(view, {})
        back = not anyway and reaches(g, b, a)
        if not back:
            g.setdefault(a, []).append(b)
        out.append((view, pos, back))
    return out


@pytest.mark.parametrize("large", [10_000, 25, 0])
def test_backward_arrows(spark, large):
    rng = random.Random(large)
    rows = []
    for view in ("a", "b", "c:d", "long"):
        n = {"a": 5, "long": 30}.get(view, 9)
        for pos in range(120 if view == "long" else 40):
            a, b = rng.randrange(n), rng.randrange(n)
            rows.append((view, pos, f"v{a}", f"v{b}", view == "c:d" and rng.random() < 0.2))
    df = spark.createDataFrame(rows, "view string, pos long, src string, dst string, anyway boolean").repartition(5)
    assert sorted(map(tuple, graphs.backward_arrows(df, large, 0).collect())) == plain_backward(rows)
    free = [r for r in rows if not r[4]]
    assert sorted(map(tuple, graphs.backward_arrows(df.where("not anyway").drop("anyway"), large).collect())) == plain_backward(free)
    assert graphs.backward_arrows(df.where("false"), large).count() == 0


def plain_pairs(rows, within):
    waiting, out = {}, []
    for group, at, role, i in sorted(rows, key=lambda r: (r[1], r[3])):
        mine = waiting.setdefault(group, {})
        mine[role] = (at, i)
        if len(mine) == 2 and abs(mine["p"][0] - mine["c"][0]) <= within:
            out.append((mine["p"][1], mine["c"][1]))
            mine.clear()
    return sorted(out)


def test_consumed_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.choice("xyz"), rng.randrange(300), rng.choice("pc"), i) for i in range(400)]
    df = spark.createDataFrame(rows, "grp string, at long, role string, id long").repartition(4)
    for within in (0, 2, 15, 1000):
        got = joins.consumed_pairs(df, ["grp"], "at", "role", "p", within, ["id"])
        assert got.count() == len(rows)
        pairs = got.where("pair is not null and role = 'p'").select("id", "mate.id").collect()
        assert sorted(map(tuple, pairs)) == plain_pairs(rows, within)
        numbers = got.where("pair is not null").groupBy("grp", "pair").agg(F.count("*").alias("n"), F.countDistinct("role").alias("k")).collect()
        assert all((r.n, r.k) == (2, 2) for r in numbers)


def test_frames_keep_the_newest_that_waits(spark):
    rows = [("a", "parent_frame", "t", 1, "map"), ("a", "parent_frame", "t", 5, "/odom"), ("a", "child_frame", "t", 6, "base"), ("a", "child_frame", "t", 7, "late"), ("a", "parent_frame", "u", 30, "base"), ("a", "child_frame", "u", 50, "far"), ("a", "parent_frame", "u", 60, "arm"), ("b", "parent_frame", "pose", 3, "map"), ("b", "child_frame", "v", 4, "x"), ("c", "child_frame", "t", 9, "hand"), ("c", "parent_frame", "t", 9, "arm")]
    df = spark.createDataFrame(rows, "path string, fact string, target string, line int, name string")
    assert {tuple(r) for r in robots.frames(df).collect()} == {("a", "odom", "base", 5), ("a", "arm", "far", 50), ("c", "arm", "hand", 9)}


def plain_strong(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    vertices = {v for p in pairs for v in p}
    out = set()
    for v in vertices:
        if any(reaches(near, w, v) for w in near.get(v, ())):
            out.add((v, min(u for u in vertices if reaches(near, v, u) and reaches(near, u, v))))
    return out


def test_strong_components_in_tables(spark):
    """Chains, chains that close on their end, long cycles, cycles with tails, loops, two cycles that share a vertex, dense parts."""
    rng = random.Random(4)
    cycle = lambda name, n: [(f"{name}{i}", f"{name}{(i + 1) % n}") for i in range(n)]
    path = lambda name, n: [(f"{name}{i}", f"{name}{i + 1}") for i in range(n)]
    pairs = [*cycle("a", 31), *cycle("b", 2), *path("t", 12), ("t12", "a0"), *cycle("c", 5), *cycle("d", 4), ("c0", "d0"), ("l", "l"), ("a3", "x0"), *path("x", 6), *cycle("e", 7), ("e0", "f1"), ("f1", "f2"), ("f2", "e0"), ("e3", "e3")]
    pairs += [(f"r{rng.randrange(40)}", f"r{rng.randrange(40)}") for _ in range(60)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    assert {tuple(r) for r in graphs.strong_components(df, 0).collect()} == plain_strong(pairs)
    assert graphs.strong_components(spark.createDataFrame(path("p", 20), "src string, dst string"), 0).count() == 0
    assert {tuple(r) for r in graphs.strong_components(spark.createDataFrame(cycle("q", 9), "src string, dst string"), 0).collect()} == {(f"q{i}", "q0") for i in range(9)}


def test_strong_components_of_views(spark):
    """Views of one another's names, walked or in tables; null views and ends count for nothing."""
    draw = random.Random(17)
    rows = [(k, f"n{draw.randrange(9)}", f"n{draw.randrange(9)}") for k in (1, 2, 12) for _ in range(12 * k)] + [(None, "a", "a"), (1, None, "n1"), (2, "n1", None), (3, "x", "y"), (4, "z", "z")]
    want = {(k, *x) for k in (1, 2, 12, 4) for x in plain_strong({(a, b) for v, a, b in rows if v == k and a and b})}
    df = spark.createDataFrame(rows, "view long, src string, dst string")
    for group in (0, 20, 1000):
        assert {tuple(r) for r in graphs.strong_by_view(df, group).collect()} == want


def test_strong_brands_walks_customers_apart(spark, monkeypatch):
    """No customer of the small tables has so many edges that its components are tables."""
    from quarrygraph.plans import graphical

    monkeypatch.setattr(graphs, "_strong_wide", None)
    assert graphical.strong_brands(spark, "/root/testdata/sf0.001").count() > 0



def test_ways_up_have_no_bound(spark):
    from quarrygraph.operators import findings
    from quarrygraph.operators import projection as P

    shape = "id string, name string, kind string, subsystem string, parent string, tags array<string>, file string"
    deep = [("m", "m", "module", None, None, None, "core/m.py")] + [(f"x{i}", "x", "function", None, f"x{i - 1}" if i else "m", None, None) for i in range(40)]
    odd = [("c1", "c", "class", None, "c2", None, "web/c.py"), ("c2", "c", "class", None, "c1", None, None), ("lone", "l", "function", None, "gone", None, None), ("db", "d", "datastore", None, "m", None, "core/m.py"), ("under", "u", "function", None, "db", None, "web/u.py")]
    n = spark.createDataFrame(deep + odd, shape)
    of = {r.id: r.module for r in P.module_of(n).collect()}
    assert all(of[f"x{i}"] == "m" for i in range(40)) and (of["c1"], of["c2"], of["lone"], of["under"]) == ("c1", "c2", "lone", "m")
    subs = spark.createDataFrame([("sub:core", ["core"]), ("sub:web", ["web/"])], "id string, paths array<string>")
    built = {r.id: r.subsystem for r in findings.built_nodes(n, subs).collect()}
    assert all(built[f"x{i}"] == "sub:core" for i in range(40)) and (built["db"], built["under"], built["c1"], built["c2"], built["lone"]) == (None, "sub:web", "sub:web", None, None)
    e = spark.createDataFrame([("api:1", "api:2", "handles", "e1"), ("api:2", "x9", "handles", "e2"), ("api:3", "api:4", "handles", "e3"), ("api:4", "api:3", "handles", "e4")], "src string, dst string, kind string, id string")
    apis = spark.createDataFrame([(f"api:{i}", "a", "api_endpoint", None, None, None, None) for i in range(1, 5)], shape)
    unit = {r.id: r.unit for r in P.units(n.union(apis), e, "module").collect()}
    assert [unit[f"api:{i}"] for i in range(1, 5)] == ["m", "m", "api:3", "api:4"]
    groups = spark.createDataFrame([("v", f"g{i}", f"g{i - 1}" if i else None) for i in range(30)], "view string, id string, parent string")
    assert {r.id: r.parent for r in P.nested_groups(groups).collect()} == {"g0": None} | {f"g{i}": "g0" for i in range(1, 30)}


def test_relations_run_from_what_is_referred_to(spark):
    from quarrygraph.operators import findings

    entities = spark.createDataFrame([("u", "users", 0), ("p", "posts", 1), ("p2", "posts", 2), ("e", "employee", 3)], "id string, name string, pos int")
    attributes = spark.createDataFrame([("p", "author_id", "users.id"), ("p", "post", "post"), ("e", "manager_id", "Employee"), ("e", "x", "none"), ("e", "y", None), ("e", "manager_id", "employee")], "entity string, name string, references string")
    assert {tuple(r) for r in findings.foreign_keys(entities, attributes).collect()} == {("u", "p", "author_id"), ("p", "p", "post"), ("e", "e", "manager_id")}


def test_owner_by_class(spark):
    nodes = spark.createDataFrame([("a", 1, "one", "A"), ("a", 9, "two", "B"), ("b", 5, "only", "C")], "path string, line int, name string, cls string")
    rows = spark.createDataFrame([("a", 20, "A"), ("a", 3, "B"), ("a", 20, "Helper"), ("a", 20, None), ("b", 1, "Helper"), ("c", 1, None)], "path string, line int, cls string")
    assert {(r.path, r.line, r.cls): r.node for r in robots.owned(rows, nodes).collect()} == {("a", 20, "A"): "one", ("a", 3, "B"): "two", ("a", 20, "Helper"): None, ("a", 20, None): "two", ("b", 1, "Helper"): "only"}


def test_rolling_counts_without_a_frame_that_slides(spark):
    """Ties, edges of windows, times before zero and parts against a plain loop; no frame is counted anew for each row."""
    rng = random.Random(3)
    times = [rng.randrange(-25, 60) * 500_000 for _ in range(120)] + [None]
    rows = [(i, "ab"[i % 2], t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id long, who string, us long")
    for part in (None, ["who"]):
        got = budgets.rolling_counts(df, "us", 5, part)
        want = {i: sum(u is not None and t - 5_000_000 < u <= t and (not part or w == v) for _, v, u in rows) for i, w, t in rows if t is not None}
        assert {r.id: r.used for r in got.collect()} == want and got.columns == ["id", "who", "us", "used"]
        assert "specifiedwindowframe(RangeFrame, -" not in got._jdf.queryExecution().toString()
