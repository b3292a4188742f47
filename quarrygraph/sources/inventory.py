"""File inventories: a listing of files becomes rows with language, test flag and the reason why a file is left out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file extension, and those whose code is analysed.
LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "java": "java", "kt": "kotlin", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "scala": "scala", "m": "objective-c", "lua": "lua", "r": "r", "jl": "julia", "dart": "dart", "ex": "elixir", "exs": "elixir", "sh": "shell", "bash": "shell", "sql": "sql", "proto": "protobuf", "msg": "ros-interface", "srv": "ros-interface", "action": "ros-interface", "vue": "vue", "svelte": "svelte"}
ANALYZED = ["python", "javascript", "typescript", "c", "cpp"]
# Folders, extensions and names that are left out; folders and names of tests.
EXCLUDED_DIRS = ".git .hg .svn node_modules bower_components vendor third_party __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox .nox .venv venv env .eggs dist build out target .next .nuxt .svelte-kit .turbo .cache coverage htmlcov .gradle .idea .vscode install log".split()
BINARY = "png jpg jpeg gif bmp ico svg webp pdf zip gz tgz bz2 xz 7z tar jar war so dylib dll exe o a lib pyc class bin dat db sqlite sqlite3 pt pth onnx h5 npy npz pkl parquet bag mcap pcd ply mp3 mp4 wav mov avi ttf otf woff woff2".split()
LOCKFILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "uv.lock"]
GENERATED = ["_pb2.py", "_pb2_grpc.py", ".min.js", ".bundle.js", ".generated."]
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs", "testing"]
TEST_NAMES = r"^test_|(_test\.py|\.test\.js|\.test\.ts|\.test\.tsx|\.spec\.js|\.spec\.ts|_test\.go|_test\.cpp)$|^conftest\.py$"


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of all files under a folder, by Spark's binary source; content is read only where it is used."""
    at = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    above = re.escape(root.split("://")[-1].rstrip("/"))
    return at.select(F.regexp_replace("path", f"^.*?{above}/", "").alias("path"), F.col("length").alias("size"), "content")


def glob_regex(glob: str) -> str:
    """A glob's pattern over whole paths: * and ? stay within a name, ** spans folders, a slash inside or in front anchors, one behind asks for a folder."""
    only_dir, g = glob.endswith("/"), glob.strip("/")
    anchored = glob.startswith("/") or "/" in g
    out, i = "", 0
    while i < len(g):
        if g[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif g[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(g[i], re.escape(g[i])), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if only_dir else '(?:/.*)?'}$"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a path ignores it; ! in front keeps. Rules are a parameter, so they become one expression and need no join."""
    out = F.lit(False)
    for rule in rules:
        keep = rule.startswith("!")
        out = F.when(path.rlike(glob_regex(rule[1:] if keep else rule)), F.lit(not keep)).otherwise(out)
    return out


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower case, empty without a dot behind the first character of the name."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Null where the extension is not known."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def is_test(path: Column) -> Column:
    """A folder above is a test folder, or the name starts or ends as tests' names do."""
    parts = F.split(path, "/")
    folder = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, TEST_DIRS)))
    return folder | name(path).rlike(TEST_NAMES)


def left_out(path: Column, size: Column, content: Column, rules: list[str] = (), max_bytes: int = 1_000_000, own: list[str] = ()) -> Column:
    """The first reason that applies, null for files that stay. own: folders that a run itself writes."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, [*EXCLUDED_DIRS, *own]))), "excluded directory")
        .when(ignored(path, list(rules)), "excluded by rule")
        .when(extension(path).isin(BINARY), "binary")
        .when(name(path).isin(LOCKFILES), "lockfile")
        .when(name(path).rlike("|".join(map(re.escape, GENERATED))), "generated")
        .when(content.isNull(), "unreadable")
        .when(size > max_bytes, "too large")
        .when(F.contains(F.substring(content, 1, 8192), F.lit(b"\x00")), "binary")
    )


def inventory(files: DataFrame, rules: list[str] = (), max_bytes: int = 1_000_000, own: list[str] = ()) -> DataFrame:
    """(path, size, language, analyzed, test, reason) of files (path, size, content)."""
    p = F.col("path")
    return files.select("path", "size", language(p).alias("language"), F.coalesce(language(p).isin(ANALYZED), F.lit(False)).alias("analyzed"), is_test(p).alias("test"), left_out(p, F.col("size"), F.col("content"), rules, max_bytes, own).alias("reason"))


def tracked(files: DataFrame, listed: DataFrame) -> DataFrame:
    """files that a listing of tracked and untracked paths (path) names; paths that are listed but gone have no row, and one listed twice is one file."""
    return files.join(listed.select("path").distinct(), "path", "left_semi")


def pruned(files: DataFrame, own: list[str] = ()) -> DataFrame:
    """(folder, files): folders that are left out by name, the topmost of a path, and how many files lie in them."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    first = F.filter(F.sequence(F.lit(1), F.greatest(F.size(folders), F.lit(1))), lambda i: F.get(folders, i - 1).isin([*EXCLUDED_DIRS, *own]))
    at = F.get(first, F.lit(0))
    return files.where(at.isNotNull()).groupBy(F.array_join(F.slice(parts, 1, at), "/").alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def revision(spark: SparkSession, commit: str, branch: str | None, dirty: bool, remote: str | None) -> DataFrame:
    """One row (revision, short, branch, dirty, remote) of what is known about a tree, the address without its login."""
    from quarrygraph.functions.names import remote as bare

    row = spark.createDataFrame([(commit, branch, dirty, remote)], "revision string, branch string, dirty boolean, remote string")
    return row.select("revision", F.substring("revision", 1, 12).alias("short"), "branch", "dirty", bare(F.col("remote")).alias("remote"))
