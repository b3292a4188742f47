"""Manifests and trees on small files with known rows."""

from __future__ import annotations

from quarrygraph.sources import manifests as M
from quarrygraph.sources import trees

COMPOSE = """services:
  web:
    build: .
    ports: ["80:80", '81:81']
    depends_on:
      - db
  # a remark
  api:
    image: "x/api:1"
    depends_on:
      db:
        condition: service_healthy
      bus:
        condition: service_started
  db:
    image: postgres:16
    ports:
    - 5432:5432
volumes:
  data:
"""


def test_compose(spark):
    df = spark.createDataFrame([("a/docker-compose.yml", COMPOSE), ("compose.yaml", "")], "path string, text string")
    rows = M.manifests(df).orderBy("line").collect()
    got = {r["name"]: r for r in rows}
    assert list(got) == ["web", "api", "db"]
    assert (got["web"]["target"], got["web"]["ports"], got["web"]["depends"], got["web"]["line"]) == (".", ["80:80", "81:81"], ["db"], 2)
    assert (got["api"]["image"], got["api"]["depends"]) == ("x/api:1", ["db", "bus"])
    assert (got["db"]["image"], got["db"]["ports"]) == ("postgres:16", ["5432:5432"])
    units, links = M.deployment_units(M.manifests(df))
    assert {(r.id, r.kind, r.name) for r in units.collect()} == {("deploy:web", "deployment_unit", "web"), ("deploy:api", "deployment_unit", "api"), ("store:postgresql", "datastore", "PostgreSQL")}
    assert {(r.src, r.dst) for r in links.collect()} == {("deploy:web", "store:postgresql"), ("deploy:api", "store:postgresql")}


def test_manifests(spark):
    files = {
        "pyproject.toml": '[project]\nname = "app"\ndependencies = ["Foo_Bar>=1", "flask[async]"]\n[project.scripts]\nrun = "app.cli:main"\n',
        "x/requirements-dev.txt": "pytest  # tests\n-r other.txt\ngit+https://h/x\n\nrich==1\n",
        "setup.py": "setup(install_requires=['a>1', \"b\"],\n entry_points={'console_scripts': ['go=pkg.m:f']})",
        "web/package.json": '{"name": "w",\n "main": "./index.js", "bin": "cli.js", "dependencies": {"React": "1"}, "scripts": {"dev": "vite"}}',
        "node_modules/y/package.json": '{"name": "no"}',
        "bad/package.json": "{",
        "cpp/CMakeLists.txt": "find_package(OpenCV REQUIRED)\nadd_executable(tool main.cpp util.h)\nadd_library(core a.cc)\n",
        "ros/package.xml": "<package><name>n</name><depend>rclcpp</depend></package>",
        "go.mod": "module m\nrequire (\n\tgithub.com/X/y v1.2.3\n)\n",
        "pom.xml": "<artifactId>Core-Lib</artifactId>",
        "Cargo.toml": '[dependencies]\nserde = "1"\n',
        "svc/Dockerfile": "FROM python:3.13 AS b\nEXPOSE 80 443/tcp\nCMD [\"run\"]\n",
        "deploy/a.yaml": "kind: Deployment\nmetadata:\n  name: one\n---\nkind: Service\nmetadata:\n  name: two\n---\nkind: ConfigMap\n",
        "plain.txt": "no manifest",
    }
    df = spark.createDataFrame([*files.items(), ("requirements.txt", None)], "path string, text string")
    rows = M.manifests(df).collect()
    facts = {(r.path, r.fact, r.kind, r.name, r.target) for r in rows}
    deps = {(r.kind, r.name) for r in rows if r.fact == "dependency"}
    assert deps == {("python", n) for n in ("foo-bar", "flask", "pytest", "rich", "a", "b")} | {("javascript", "react"), ("cmake", "opencv"), ("ros", "rclcpp"), ("go", "github.com/x/y"), ("java", "core-lib"), ("rust", "serde")}
    assert ("pyproject.toml", "entry_point", "console_script", "run", "app.cli:main") in facts
    assert ("setup.py", "entry_point", "console_script", "go", "pkg.m:f") in facts
    assert {(r.name, r.target) for r in rows if r.path == "web/package.json" and r.fact == "entry_point"} == {("main", "web/index.js"), ("w", "web/cli.js"), ("npm run dev", "vite")}
    assert ("cpp/CMakeLists.txt", "entry_point", "cmake_executable", "tool", "cpp/main.cpp") in facts
    docker = next(r for r in rows if r.kind == "dockerfile")
    assert (docker.name, docker.image, docker.ports, docker.target) == ("svc", "python:3.13", ["80", "443/tcp"], '["run"]')
    assert [(r.kind, r.name, r.line) for r in rows if r.path == "deploy/a.yaml"] == [("k8s_deployment", "one", 1), ("k8s_service", "two", 5)]
    assert not {p for p, *_ in facts} & {"node_modules/y/package.json", "bad/package.json", "plain.txt"}
    assert {r.framework for r in M.frameworks(M.manifests(df), {"flask": "Flask"}).collect()} == {"Flask", "ros2"}
    assert M.manifests(df.where("false")).count() == 0


def test_trees(spark):
    xml = '<board><section id="s" name="One &amp; two"><shape nodeId="a" type="sticky">hi <b>there</b></shape><line id="l"/></section></nothing><page id="p"><x id="y">t</page>'
    df = spark.createDataFrame([("d", xml), ("e", None)], "doc string, text string")
    got = {r.id: (r.type, r.parent, r.top, r.text) for r in trees.elements(df).collect()}
    assert got == {"s": ("SECTION", None, True, "One & two hi there"), "a": ("STICKY", "s", False, "hi there"), "l": ("LINE", "s", False, ""), "p": ("PAGE", None, False, "t"), "y": ("X", "p", True, "t")}


def test_entries_subsystems_and_brief(spark):
    files = [("pyproject.toml", '[project]\nname = "app"\n[project.scripts]\nrun = "app.cli:main"\nother = "app.none:f"\n'), ("pkg/package.json", '{"name": "w", "main": "i.js"}')]
    found = M.manifests(spark.createDataFrame(files, "path string, text string"))
    nodes = spark.createDataFrame([("fn:src/app/cli.py:main", "function"), ("mod:src/app/cli.py", "module"), ("mod:pkg/i.js", "module")], "id string, kind string")
    assert {(r.name, r.node) for r in M.entry_nodes(found, nodes).collect()} == {("run", "fn:src/app/cli.py:main"), ("main", "mod:pkg/i.js")}
    paths = spark.createDataFrame([(p,) for p in ["src/a/x.py", "src/a/y.py", "src/b/z.py", "src/b/c/d.py", "pkg/i.js", "pkg/in/j.js"]], "path string")
    got = {r.path: r.subsystem for r in M.subsystems(paths, found).collect()}
    assert got == {"src/a/x.py": "src/a", "src/a/y.py": "src/a", "src/b/z.py": "src/b", "src/b/c/d.py": "src/b", "pkg/i.js": "pkg", "pkg/in/j.js": "pkg"}
    edges = spark.createDataFrame([("mod:pkg/i.js", "mod:src/app/cli.py", "calls"), ("mod:pkg/i.js", "x", "imports")], "src string, dst string, kind string")
    b = {(r.section, r.name): r.n for r in M.brief(nodes, edges, found).collect()}
    assert b["node", "module"] == 2 and b["hub", "mod:pkg/i.js"] == 1 and b["build", "pyproject"] == 1


def test_tracked_pruned_revision(spark):
    from quarrygraph.sources import inventory as I

    f = spark.createDataFrame([("a.py",), ("web/node_modules/x/y.js",), ("web/node_modules/z.js",), ("dist/build/o.js",), ("b/test/c.go",)], "path string")
    assert {r.path for r in I.tracked(f, spark.createDataFrame([("a.py",), ("a.py",), ("gone.py",)], "path string")).collect()} == {"a.py"}
    assert {(r.folder, r.files) for r in I.pruned(f).collect()} == {("web/node_modules", 2), ("dist", 1)}
    r = I.revision(spark, "0123456789abcdef", "main", True, "https://u:p@h/x.git").first()
    assert r.short == "0123456789ab" and "u:p" not in r.remote and r.dirty
    rows = spark.createDataFrame([("x/conftest.py", 1, b"a"), ("p.proto", 1, b"a"), ("q_pb2_grpc.py", 1, b"a"), ("m.mts", 1, b"a"), ("k.go", 1, b"a"), ("a.test.tsx", 1, b"a")], "path string, size long, content binary")
    got = {r.path: (r.language, r.analyzed, r.test, r.reason) for r in I.inventory(rows).collect()}
    assert got == {"x/conftest.py": ("python", True, True, None), "p.proto": ("protobuf", False, False, None), "q_pb2_grpc.py": ("python", True, False, "generated"), "m.mts": ("typescript", True, False, None), "k.go": ("go", False, False, None), "a.test.tsx": ("typescript", True, True, None)}


def test_trees_hand_on_pieces_of_a_batch():
    """A batch of many documents comes out in pieces, with the same rows in order."""
    import pandas as pd

    pdf = pd.DataFrame({"doc": [str(i) for i in range(50)], "text": [f"<page id='p'>{''.join(f'<a id={k} name=n{i}>' for k in range(100))}</page>" for i in range(50)]})
    got = list(trees._elements([pdf, pdf[:0]]))
    assert max(map(len, got)) <= trees.PIECE + 101 and len(got) > 4
    assert [tuple(r) for r in pd.concat(got)[["doc", "id"]].values] == [(str(i), k) for i in range(50) for k in ("p", *map(str, range(100)))]
