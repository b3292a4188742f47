"""Manifest readers: packaging, build and deployment files become rows of one schema, in two stages.

Each file is flattened on its own into entries (keys, value, line) by its format: tables, documents, markup, outlines,
commands or instructions. What an entry means is one table of rules over the file's kind and its keys, evaluated as
column expressions in one projection; services and images are groups of entries. A file that does not parse has no
entries; a null text is an empty one.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, fact string, kind string, name string, target string, line int, image string, ports array<string>, depends array<string>"
ENTRY = "path string, file_kind string, keys array<string>, value string, line int"

# Names of manifest files, the first that fits; dependencies and the frameworks that they tell; kinds of cluster objects that deploy something.
FILES = [
    ("pyproject", r"(^|/)pyproject\.toml$", "toml"),
    ("requirements", r"(^|/)requirements[^/]*\.txt$", "lines"),
    ("setup", r"(^|/)setup\.py$", "call"),
    ("package_json", r"^(?!.*node_modules)(.*/)?package\.json$", "json"),
    ("cmake", r"(^|/)CMakeLists\.txt$", "commands"),
    ("package_xml", r"(^|/)package\.xml$", "xml"),
    ("go", r"(^|/)go\.mod$", "lines"),
    ("maven", r"(^|/)pom\.xml$", "xml"),
    ("gradle", r"(^|/)build\.gradle(\.kts)?$", "lines"),
    ("cargo", r"(^|/)Cargo\.toml$", "toml"),
    ("dockerfile", r"(^|/)(Dockerfile(\.[^/]+)?|[^/]+\.Dockerfile)$", "instructions"),
    ("compose", r"(^|/)(docker-)?compose(\.[\w-]+)?\.ya?ml$", "outline"),
    ("cluster", r"(k8s|kubernetes|deploy|helm).*\.ya?ml$", "outline"),
]
DEPLOYED = ["Deployment", "StatefulSet", "DaemonSet", "CronJob", "Job", "Service"]
SOURCES = r"\.(c|cc|cpp|cxx)$"

# ---- entries -------------------------------------------------------------------------------------------------


def _leaves(node, keys: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    """Leaves of nested tables and lists with their keys; list items have the key "-", and empty branches are leaves."""
    below = node.items() if isinstance(node, dict) else (("-", x) for x in node) if isinstance(node, (list, tuple)) else None
    if not below or not node:
        yield keys, "" if node is None or below is not None else str(node)
        return
    for key, x in below:
        yield from _leaves(x, (*keys, str(key)))


def _nested(node, text: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """Leaves with their lines: the first line that starts with the nearest key, else the first that holds it, else 1."""
    rows = text.splitlines()
    for keys, value in _leaves(node):
        key = next((k for k in reversed(keys) if k != "-"), "")
        starts = [i for i, r in enumerate(rows, 1) if r.lstrip(" \t\"'").startswith(key)]
        holds = starts or [i for i, r in enumerate(rows, 1) if key in r]
        yield keys, value, holds[0] if holds else 1


def _markup(element, keys: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str, int]]:
    keys = (*keys, element.tag.rpartition("}")[2])
    if (element.text or "").strip():
        yield keys, element.text.strip(), 1
    for x in element:
        yield from _markup(x, keys)


def _outline(text: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """Entries of an indented document; list items have the key "-", a document's number is the first key."""
    above: list[tuple[int, str]] = []
    part = 0
    for i, raw in enumerate(text.splitlines(), 1):
        said = raw.strip()
        if said.startswith("---"):
            part, above = part + 1, []
        elif said and not said.startswith("#"):
            item = said.startswith("- ")
            depth = 2 * (len(raw) - len(raw.lstrip())) + item  # an item may stand at its key's own indentation
            above = [(d, k) for d, k in above if d < depth]
            key, _, value = ("-", "", said[2:]) if item else said.partition(":")
            above.append((depth, key.strip(" \"'")))
            yield (str(part), *(k for _, k in above)), value.strip(" \"'"), i


def _call(text: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """Keyword arguments of setup() that are literals."""
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Call) and ast.unparse(node.func).rpartition(".")[2] == "setup":
            for k in node.keywords:
                try:
                    value = ast.literal_eval(k.value)
                except ValueError:
                    continue
                yield from ((keys, v, k.value.lineno) for keys, v in _leaves({k.arg: value}))


#: What turns a text of a format into entries.
FORMATS = {
    "toml": lambda text: _nested(tomllib.loads(text), text),
    "json": lambda text: _nested(json.loads(text), text),
    "xml": lambda text: _markup(ElementTree.fromstring(text)),
    "outline": _outline,
    "call": _call,
    "lines": lambda text: (((), r.partition("#")[0].strip(), i) for i, r in enumerate(text.splitlines(), 1)),
    "instructions": lambda text: (((r.split(None, 1)[0].upper(),), r.split(None, 1)[1].strip(), i) for i, r in enumerate(text.splitlines(), 1) if len(r.split(None, 1)) == 2),
    "commands": lambda text: (((m[1],), " ".join(m[2].split()), text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"(\w+)\s*\(([^)]*)\)", text)),
}


def entries(files: DataFrame) -> DataFrame:
    """Rows of ENTRY from files (path, text); each file that parses has one entry without keys and value 'file' besides."""

    def each(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf.path, pdf.text, strict=True):
                kind, _, form = next(f for f in FILES if re.search(f[1], path))
                try:
                    found = [(path, kind, list(keys), value, line) for keys, value, line in FORMATS[form](text)]
                except (ValueError, SyntaxError, ElementTree.ParseError, RecursionError):
                    continue
                rows += [(path, kind, ["file"], "", 1), *found]
            yield pd.DataFrame(rows, columns=["path", "file_kind", "keys", "value", "line"]).astype({"line": "Int32"})

    wanted = F.col("path").rlike("|".join(f"({p})" for _, p, _ in FILES))
    return files.where(wanted).select("path", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(each, ENTRY)


# ---- meaning -------------------------------------------------------------------------------------------------


def _value() -> Column:
    return F.col("value")


def _line() -> Column:
    return F.col("line")


def _folder() -> Column:
    return F.coalesce(F.nullif(F.regexp_replace("path", "/?[^/]*$", ""), F.lit("")), F.lit("."))



def key(n: int) -> Column:
    return F.get("keys", F.lit(n))


def requirement(spec: Column) -> Column:
    """A dependency's bare name: lower case, hyphens, without versions, extras and markers."""
    return F.nullif(F.translate(F.lower(F.regexp_extract(F.trim(spec), r"^([^\s<>=!~;\[(]*)", 1)), "_", "-"), F.lit(""))


def within(target: Column) -> Column:
    """A path beside the manifest."""
    bare = F.regexp_replace(target, r"^\./", "")
    return F.when(_folder() == ".", bare).otherwise(F.concat_ws("/", _folder(), bare))


def _is(kind: str, *path: str) -> Column:
    """Entries of a kind of file whose keys begin so; * is any key."""
    x = F.col("file_kind") == kind
    for i, k in enumerate(path):
        if k != "*":
            x &= key(i) == k
    return x & (F.size("keys") >= len(path))


def _row(fact: str, kind, when: Column, name: Column, target: Column | None = None, line: bool = False) -> Column:
    none = F.lit(None).cast("string")
    said = kind if isinstance(kind, Column) else F.lit(kind)
    return F.when(when & name.isNotNull(), F.struct(F.lit(fact).alias("fact"), said.alias("kind"), name.alias("name"), (none if target is None else target).alias("target"), (_line() if line else F.lit(None).cast("int")).alias("line")))


def _fact_of_file(fact: str, kind, when: Column) -> Column:
    none = F.lit(None).cast("string")
    said = kind if isinstance(kind, Column) else F.lit(kind)
    return F.when(when & (key(0) == "file"), F.struct(F.lit(fact).alias("fact"), said.alias("kind"), none.alias("name"), none.alias("target"), F.lit(None).cast("int").alias("line")))


def _rules() -> list[Column]:
    last = F.element_at("keys", -1)
    of = lambda *kinds: F.col("file_kind").isin(*kinds)
    listed = F.col("file_kind").isin("requirements") & (_value() != "") & ~_value().rlike("^(-|git[+]|http)")
    poetry = _is("pyproject", "tool", "poetry")
    command = F.split(_value(), " ")
    script = F.regexp_extract(_value(), r"^([\w.-]+)\s*=\s*[\w.]+:\w+$", 1)
    sources = F.array_join(F.transform(F.filter(F.slice(command, 2, F.size(command)), lambda s: s.rlike(SOURCES)), lambda s: within(s)), " ")
    module = F.nullif(F.regexp_extract(_value(), r"^(?:require\s+)?([\w./-]+)\s+v[\w.+-]+", 1), F.lit(""))
    artifact = F.nullif(F.regexp_extract(_value(), r"[\"'][\w.-]+:([\w.-]+):", 1), F.lit(""))
    return [
        _fact_of_file("build_system", F.when(of("setup"), "setuptools").when(of("go", "cmake", "pyproject", "maven", "gradle", "cargo"), F.col("file_kind")), of("setup", "go", "cmake", "pyproject", "maven", "gradle", "cargo")),
        _fact_of_file("package_manager", F.when(of("package_json"), "npm").when(of("package_xml"), "rosdep").otherwise("pip"), of("requirements", "package_json", "package_xml")),
        _row("dependency", "python", _is("pyproject", "project", "dependencies", "-"), requirement(_value())),
        _row("dependency", "python", poetry & (key(2) == "dependencies") & (key(3) != "python"), requirement(key(3))),
        _row("entry_point", "console_script", _is("pyproject", "project", "scripts", "*"), key(2), _value(), line=True),
        _row("entry_point", "console_script", poetry & (key(2) == "scripts"), key(3), _value(), line=True),
        _row("package", "python", _is("pyproject", "project", "name"), _value(), _folder()),
        _row("dependency", "python", listed, requirement(_value())),
        _row("dependency", "python", _is("setup", "install_requires", "-"), requirement(_value())),
        _row("entry_point", "console_script", _is("setup", "entry_points") & (script != ""), script, F.regexp_extract(_value(), r"=\s*(\S+)$", 1), line=True),
        _row("dependency", "javascript", _is("package_json", "*", "*") & key(0).isin("dependencies", "devDependencies"), F.lower(key(1))),
        _row("package", "node", _is("package_json", "name"), _value(), _folder()),
        _row("entry_point", "node_main", _is("package_json", "*") & key(0).isin("main", "module") & (F.size("keys") == 1), key(0), within(_value()), line=True),
        _row("entry_point", "node_bin", _is("package_json", "bin", "*"), last, within(_value()), line=True),
        _row("entry_point", "npm_script", _is("package_json", "scripts", "*") & key(1).isin("start", "dev", "serve"), F.concat(F.lit("npm run "), key(1)), _value(), line=True),
        _row("entry_point", "cmake_executable", _is("cmake", "add_executable"), command[0], sources, line=True),
        _row("package", "cmake_library", _is("cmake", "add_library"), command[0], _folder()),
        _row("dependency", "cmake", _is("cmake", "find_package"), F.lower(command[0])),
        _row("package", "ros2_package", _is("package_xml", "package", "name"), _value(), _folder()),
        _row("dependency", "ros", _is("package_xml", "package", "*") & key(1).isin("depend", "exec_depend", "build_depend"), F.lower(_value())),
        _row("dependency", "go", of("go"), F.lower(module)),
        _row("dependency", "java", of("maven") & (last == "artifactId"), F.lower(_value())),
        _row("dependency", "java", of("gradle"), F.lower(artifact)),
        _row("dependency", "rust", _is("cargo", "dependencies", "*"), F.lower(key(1))),
    ]


def _said_together(rows: DataFrame) -> DataFrame:
    """What several entries of a file tell: the manager of a Python project, the build of a robot package, a package's only binary."""
    e = rows.where("file_kind in ('pyproject', 'package_xml', 'package_json')").groupBy("path", "file_kind").agg(
        F.max(_is("pyproject", "tool", "poetry")).alias("poetry"), F.max(F.when(_is("package_xml", "package", "export", "build_type"), _value())).alias("build"), F.max(F.when(_is("package_json", "bin") & (F.size("keys") == 1), _value())).alias("bin"), F.max(F.when(_is("package_json", "name"), _value())).alias("name"), F.max(F.when(_is("package_json", "bin"), _line())).alias("line")
    )
    build = F.coalesce("build", F.lit("ament"))
    fact = F.when(F.col("file_kind") == "pyproject", F.struct(F.lit("package_manager").alias("fact"), F.when(F.col("poetry"), "poetry").otherwise("pip").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("line")))
    fact = fact.when(F.col("file_kind") == "package_xml", F.struct(F.lit("build_system").alias("fact"), F.when(build.startswith("ament"), "ament").otherwise(build).alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("line")))
    fact = fact.when(F.col("bin").isNotNull() & (F.col("bin") != ""), F.struct(F.lit("entry_point").alias("fact"), F.lit("node_bin").alias("kind"), F.coalesce("name", F.lit("bin")).alias("name"), within(F.col("bin")).alias("target"), F.col("line").alias("line")))
    return e.select("path", fact.alias("f")).where("f is not null").select("path", "f.*")


def _in_line_order(value: Column, when: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line", value.alias("v"))))), lambda s: s.v)


def _deployments(rows: DataFrame) -> DataFrame:
    """Images, services and cluster objects: one row each of their entries."""
    none = F.array().cast("array<string>")
    d = rows.where("file_kind = 'dockerfile'")
    d = d.groupBy("path").agg(
        F.min_by(F.when(key(0) == "FROM", F.split(_value(), r"\s+")[0]), F.when(key(0) == "FROM", _line())).alias("image"), F.min_by(F.when(key(0).isin("CMD", "ENTRYPOINT"), _value()), F.when(key(0).isin("CMD", "ENTRYPOINT"), _line())).alias("target"), F.flatten(_in_line_order(F.split(_value(), r"\s+"), key(0) == "EXPOSE")).alias("ports")
    )
    folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    d = d.select("path", F.lit("dockerfile").alias("kind"), F.coalesce(F.nullif(folder, F.lit("")), F.lit("app")).alias("name"), "target", F.lit(1).alias("line"), "image", "ports", none.alias("depends"))
    c = rows.where("file_kind = 'compose'").where(key(1) == "services").where("size(keys) >= 3")
    many = lambda field: (key(3) == field) & F.when(F.size("keys") == 4, _value().startswith("[")).otherwise(F.size("keys") == 5)
    inline = F.filter(F.transform(F.split(F.regexp_replace(_value(), r"[\[\]\"']", ""), ","), lambda v: F.trim(v)), lambda v: v != "")
    each = F.when(F.size("keys") == 4, inline).when(key(4) == "-", F.array(_value())).otherwise(F.array(key(4)))
    c = c.groupBy("path", key(2).alias("name")).agg(
        F.min("line").alias("line"), F.max(F.when((key(3) == "image") & (F.size("keys") == 4), _value())).alias("image"), F.max(F.when((key(3) == "build") & (F.size("keys") == 4), F.when(_value() == "", ".").otherwise(_value()))).alias("target"), F.flatten(_in_line_order(each, many("ports"))).alias("ports"), F.flatten(_in_line_order(each, many("depends_on"))).alias("depends")
    )
    c = c.select("path", F.lit("compose_service").alias("kind"), "name", "target", "line", "image", "ports", "depends")
    k = rows.where("file_kind = 'cluster'").groupBy("path", key(0).alias("part")).agg(F.max(F.when((key(1) == "kind") & (F.size("keys") == 2), F.struct(_value().alias("v"), "line"))).alias("k"), F.max(F.when((key(1) == "metadata") & (key(2) == "name") & (F.size("keys") == 3), _value())).alias("name")).where(F.col("k.v").isin(DEPLOYED))
    k = k.select("path", F.concat(F.lit("k8s_"), F.lower("k.v")).alias("kind"), F.coalesce("name", "path").alias("name"), F.lit(None).cast("string").alias("target"), F.col("k.line").alias("line"), F.lit(None).cast("string").alias("image"), none.alias("ports"), none.alias("depends"))
    return d.union(c).union(k).select("path", F.lit("deployment").alias("fact"), "kind", "name", "target", "line", "image", "ports", "depends")


def manifests(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA from files (path, text)."""
    rows = entries(files)
    empty = F.lit(None).cast("array<string>")
    plain = rows.select("path", F.explode(F.array_compact(F.array(*_rules()))).alias("f")).select("path", "f.*").distinct().union(_said_together(rows))
    plain = plain.select("path", "fact", "kind", "name", "target", "line", F.lit(None).cast("string").alias("image"), empty.alias("ports"), empty.alias("depends"))
    return plain.union(_deployments(rows))


def frameworks(found: DataFrame, known: dict[str, str]) -> DataFrame:
    """(framework): what the dependencies name, by a given dictionary, which becomes an expression."""
    by_name = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    named = found.where("fact = 'dependency'").select(by_name[F.col("name")].alias("framework"))
    ros = found.where("fact = 'package' and kind = 'ros2_package'").select(F.lit("ros2").alias("framework"))
    return named.where("framework is not null").union(ros).distinct()


# ---- what the manifests say about the model ------------------------------------------------------------------

# Parts of image names that tell stores and channels.
IMAGES = {"postgres": ("datastore", "PostgreSQL"), "mysql": ("datastore", "MySQL"), "mariadb": ("datastore", "MariaDB"), "mongo": ("datastore", "MongoDB"), "redis": ("datastore", "Redis"), "elasticsearch": ("datastore", "Elasticsearch"), "rabbitmq": ("event_channel", "RabbitMQ"), "kafka": ("event_channel", "Kafka"), "nats": ("event_channel", "NATS"), "mosquitto": ("event_channel", "MQTT broker")}


def deployment_units(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, name, path, line) of services and images, by image a store, a channel or a unit, and (src, dst): what services depend on in their file."""
    d = found.where("fact = 'deployment'")
    image = F.lower(F.coalesce("image", F.lit("")))
    service = F.col("kind") == "compose_service"
    kinds, names = (F.coalesce(*[F.when(service & image.contains(word), F.lit(v[i])) for word, v in IMAGES.items()], F.lit("deployment_unit") if i == 0 else F.col("name")) for i in (0, 1))
    prefix = F.when(kinds == "datastore", "store:").when(kinds == "event_channel", "chan:").otherwise("deploy:")
    ident = F.concat(prefix, F.when(kinds == "deployment_unit", F.col("name")).otherwise(F.lower(F.translate(names, " ", "-"))))
    units = d.select(ident.alias("id"), kinds.alias("kind"), names.alias("name"), "path", "line", F.col("name").alias("service"), "depends")
    to = units.select("path", F.col("service").alias("dep"), F.col("id").alias("dst"))
    links = units.select("path", F.col("id").alias("src"), F.explode("depends").alias("dep")).join(to, ["path", "dep"]).where("src <> dst").select("src", "dst").distinct()
    return units.select("id", "kind", "name", "path", "line"), links


def entry_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, name, node): entry points by the first of the nodes that their target can mean: module:function, the module, a file."""
    e = found.where("fact = 'entry_point'").select("path", "name", F.explode(F.split("target", " ")).alias("target")).where("target <> ''")
    module = F.regexp_replace(F.substring_index("target", ":", 1), r"\.", "/")
    function = F.when(F.col("target").contains(":"), F.substring_index("target", ":", -1))
    file = lambda base, tail: F.concat(base, F.lit(tail))
    bases = F.array(*[file(F.concat(F.lit(p), module), t) for p in ("", "src/") for t in (".py", "/__init__.py", "/__main__.py")])
    ids = F.concat(F.when(function.isNotNull(), F.transform(bases, lambda b: F.concat(F.lit("fn:"), b, F.lit(":"), function))).otherwise(F.array().cast("array<string>")), F.transform(bases, lambda b: F.concat(F.lit("mod:"), b)), F.array(F.concat(F.lit("mod:"), F.col("target"))))
    x = e.select("path", "name", F.posexplode(ids).alias("pos", "id")).join(nodes.select("id"), "id")
    return x.groupBy("path", "name").agg(F.min_by("id", "pos").alias("node"))


def subsystems(files: DataFrame, found: DataFrame, share: float = 0.8, depth: int = 3) -> DataFrame:
    """(path, subsystem): files (path) by the longest folder of a package, else by folders from the top: where one folder holds the share of the files, one level more, to a depth; files at the top are root."""
    homes = found.where("fact = 'package' and target <> '.'").select(F.col("target").alias("folder"), F.col("target").alias("subsystem")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = files.select("path", F.explode(above).alias("folder")).join(homes, "folder").groupBy("path").agg(F.max_by("subsystem", F.length("folder")).alias("subsystem"))
    rest = files.select("path").join(own, "path", "left_anti")
    at = lambda n: F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), "/")).when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise("root")
    level = 1
    while level < depth:
        top = rest.groupBy(at(level).alias("g")).count().agg(F.max("count").alias("m"), F.sum("count").alias("n")).first()
        deeper = rest.select(at(level + 1).alias("g")).distinct().limit(2).count()
        if not top.n or top.m < share * top.n or deeper < 2:
            break
        level += 1
    return own.union(rest.select("path", at(level).alias("subsystem")))


def brief(nodes: DataFrame, edges: DataFrame, found: DataFrame, hubs: int = 15) -> DataFrame:
    """(section, name, n) of a model: nodes and edges by kind, dependencies by ecosystem, build systems, and the hubs by degree without imports."""
    count = lambda df, section, name: df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "name", "n")
    ends = edges.where("kind <> 'imports'").select(F.explode(F.array("src", "dst")).alias("id"))
    top = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(hubs).select(F.lit("hub").alias("section"), F.col("id").alias("name"), "n")
    return count(nodes, "node", "kind").union(count(edges, "edge", "kind")).union(count(found.where("fact = 'dependency'"), "dependency", "kind")).union(count(found.where("fact = 'build_system'"), "build", "kind")).union(top)
