"""Names of code facts meet definitions: modules by package folders, imports by the longest known module, calls and bases by definition.

All of it is joins by equal names, so a name that many files use is one key: definitions are distinct rows by key, and
the using side is what the sizes of a join follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def modules(files: DataFrame) -> DataFrame:
    """(path, module, package): the dotted name of each .py file from its topmost package folder down; package: its folder's dotted name."""
    p = files.where(F.col("path").endswith(".py")).select("path").distinct()
    parts = F.split(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/")
    folders = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    prefix = lambda n: F.array_join(F.slice(folders, 1, n), "/")
    above = p.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.struct(n.alias("depth"), prefix(n).alias("folder")))).alias("a")).select("path", "a.*").where("folder <> ''")
    known = p.where(F.col("path").endswith("/__init__.py")).select(F.regexp_replace("path", "/__init__.py$", "").alias("folder"), F.lit(True).alias("is_package"))
    # the deepest folder that is no package; what lies below it is the name
    outside = above.join(known, "folder", "left").where("is_package is null").groupBy("path").agg(F.max("depth").alias("skip"))
    x = p.join(outside, "path", "left").withColumns({"parts": parts, "skip": F.coalesce("skip", F.lit(0))})
    name = F.array_join(F.slice("parts", F.least(F.col("skip") + 1, F.size("parts")), F.size("parts")), ".")
    own = F.when(F.col("path").endswith("__init__.py"), name).otherwise(F.regexp_replace(name, r"\.?[^.]*$", ""))
    return x.select("path", name.alias("module"), own.alias("package"))


def absolute(target: Column, package: Column) -> Column:
    """A target with dots in front, seen from a package: one dot is the package, each more goes one up."""
    dots = F.length(F.regexp_extract(target, r"^\.*", 0))
    parts = F.split(package, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots + 1, F.lit(0))), ".")
    rest = F.regexp_replace(target, r"^\.+", "")
    return F.when(dots == 0, target).when((base == "") | (rest == ""), F.concat(base, rest)).otherwise(F.concat_ws(".", base, rest))


def longest_module(rows: DataFrame, key: list[str], name: str, mods: DataFrame) -> DataFrame:
    """(key, module, file, rest): the longest known module that starts the dotted name, and what follows it. No match: no row."""
    parts = F.split(name, r"\.")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), ".").alias("module")))
    x = rows.select(*key, name, F.explode(cut).alias("c")).select(*key, name, "c.*")
    known = mods.groupBy("module").agg(F.min("path").alias("file"))
    best = x.join(known, "module").groupBy(*key, name).agg(F.max_by(F.struct("module", "file"), "n").alias("b"))
    return best.select(*key, "b.*", F.expr(f"substring({name}, length(b.module) + 2)").alias("rest"))


def symbols(facts: DataFrame, mods: DataFrame) -> DataFrame:
    """(symbol, path, kind): classes and functions by full dotted name; a repeated name keeps the first path."""
    d = facts.where("fact in ('class', 'function')").join(mods, "path")
    owner = F.when(F.col("owner") == "", F.col("module")).otherwise(F.concat_ws(".", "module", "owner"))
    return d.select(F.concat_ws(".", owner, F.col("name")).alias("symbol"), "path", F.col("fact").alias("kind")).groupBy("symbol").agg(F.min(F.struct("path", "kind")).alias("s")).select("symbol", "s.*")


def import_edges(facts: DataFrame, mods: DataFrame) -> DataFrame:
    """(src, dst, kind): files that import files, itself left out."""
    i = facts.where("fact = 'import'").join(mods, "path").select("path", absolute(F.col("target"), F.col("package")).alias("target")).distinct()
    hit = longest_module(i, ["path"], "target", mods)
    return hit.where("file <> path").select(F.col("path").alias("src"), F.col("file").alias("dst"), F.lit("imports").alias("kind")).distinct()


def external(facts: DataFrame, mods: DataFrame) -> DataFrame:
    """(path, package): first parts of imports that no known module starts."""
    i = facts.where("fact = 'import'").join(mods, "path").select("path", absolute(F.col("target"), F.col("package")).alias("target")).distinct()
    head = F.element_at(F.split("target", r"\."), 1)
    known = mods.select(F.element_at(F.split("module", r"\."), 1).alias("top")).distinct()
    return i.select("path", head.alias("top")).distinct().join(known, "top", "left_anti").select("path", F.col("top").alias("package"))


def _local_or_full(rows: DataFrame, name: str) -> Column:
    """Candidates for a name in a file in the order in which they are tried: of the class it is said in, of the module, as it is."""
    own = F.when(F.col(name).startswith("self."), F.concat_ws(".", "module", F.regexp_replace("owner", r"\.[^.]*$", ""), F.regexp_replace(name, r"^self\.", "")))
    return F.array(own, F.concat_ws(".", "module", name), absolute(F.col(name), F.col("package")))


def resolved(facts: DataFrame, fact: str, mods: DataFrame, known: DataFrame) -> DataFrame:
    """Facts (path, owner, name, target, line) with the symbol that their target names and its kind; no match: no row."""
    x = facts.where(F.col("fact") == fact).join(mods, "path")
    key = ["path", "module", "owner", "name", "target", "line"]
    c = x.select(*key, F.posexplode(_local_or_full(x, "target")).alias("pos", "symbol")).where("symbol is not null")
    hit = c.join(known.select("symbol", "kind", F.col("path").alias("file")), "symbol")
    return hit.groupBy(*key).agg(F.min_by(F.struct("symbol", "kind", "file"), "pos").alias("h")).select(*key, "h.*")


def inheritance(facts: DataFrame, mods: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, kind): classes and the known classes that they extend, itself left out."""
    src = F.when(F.col("owner") == "", F.concat_ws(".", "module", "name")).otherwise(F.concat_ws(".", "module", "owner", "name"))
    x = resolved(facts, "base", mods, known).where("kind = 'class'")
    return x.select(src.alias("src"), F.col("symbol").alias("dst"), F.lit("inherits").alias("kind")).where("src <> dst").distinct()


def calls(facts: DataFrame, mods: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, kind, status, calls): who calls or instantiates what; through self it is inferred, else confirmed."""
    x = resolved(facts, "call", mods, known)
    src = F.when(F.col("owner") == "", F.col("module")).otherwise(F.concat_ws(".", "module", "owner"))
    kind = F.when(F.col("kind") == "class", "instantiates").otherwise("calls")
    status = F.when(F.col("target").startswith("self."), "static_inferred").otherwise("confirmed")
    return x.select(src.alias("src"), F.col("symbol").alias("dst"), kind.alias("kind"), status.alias("status")).groupBy("src", "dst", "kind").agg(F.min("status").alias("status"), F.count(F.lit(1)).alias("calls"))


def inherited_method(bases: DataFrame, methods: DataFrame, wanted: DataFrame, depth: int = 5) -> DataFrame:
    """(cls, method, found): the class that defines a method, found from cls through bases (cls, base, pos), depth first, at most depth up.

    One join for each level; the path of base positions orders the finds as a depth-first search meets them.
    """
    level = wanted.select("cls", "method", F.col("cls").alias("at"), F.array().cast("array<int>").alias("way"))
    every = level
    up = bases.select(F.col("cls").alias("at"), F.col("base"), F.col("pos").cast("int").alias("pos"))
    for _ in range(depth):
        level = level.join(up, "at").select("cls", "method", F.col("base").alias("at"), F.concat("way", F.array("pos")).alias("way"))
        every = every.union(level)
    hit = every.join(methods.select(F.col("cls").alias("at"), "method"), ["at", "method"])
    return hit.groupBy("cls", "method").agg(F.min_by("at", "way").alias("found"))
