"""What calls and callbacks mean, by the types of their receivers: joins over typed names with their scopes.

A receiver's type is the text that made or annotated it: a class, or a function whose return annotation names one. The
name is looked up where it is used: a local name or parameter as it was last said before (an untyped one hides the rest),
else the module's, else that of the module it is imported from; self.x has what its class says of x. Methods are found
on the class, then on its bases depth first. Every step is a join by equal names over distinct keys, so its size follows
the uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.operators.projection import cut
from quarrygraph.operators.resolution import absolute, inherited_method, symbols

#: Bases that are climbed for a method.
DEPTH = 5


def _first_part(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def imported(facts: DataFrame) -> DataFrame:
    """(path, head, to): what the first part of a name means by a file's imports; the last import of a name counts."""
    i = facts.where("fact = 'import' and name <> '*'")
    to = F.when(F.col("name").contains(".") & (F.col("name") == F.col("target")), _first_part(F.col("name"))).otherwise(F.col("target"))
    return i.select("path", _first_part(F.col("name")).alias("head"), to.alias("to"), "line").groupBy("path", "head").agg(F.max_by("to", "line").alias("to"))


def named(texts: DataFrame, facts: DataFrame, mods: DataFrame, known: DataFrame) -> DataFrame:
    """(path, text, symbol, kind, file): the class or function that a name means in a file: one of the file's own, else one that its imports lead to. No match: no row."""
    x = texts.select("path", "text").distinct().join(mods, "path")
    x = x.withColumn("head", _first_part(F.col("text"))).join(imported(facts), ["path", "head"], "left")
    there = absolute(F.concat(F.col("to"), F.expr("substring(text, length(head) + 1)")), F.col("package"))
    x = x.select("path", "text", F.posexplode(F.array(F.concat_ws(".", F.nullif("module", F.lit("")), "text"), there)).alias("pos", "symbol")).where("symbol is not null")
    hit = x.join(known.select("symbol", "kind", F.col("path").alias("file")), "symbol")
    return hit.groupBy("path", "text").agg(F.min_by(F.struct("symbol", "kind", "file"), "pos").alias("h")).select("path", "text", "h.*")


def typed(texts: DataFrame, facts: DataFrame, mods: DataFrame, known: DataFrame) -> DataFrame:
    """(path, text, cls): the class that a constructor, an annotation or a factory's return annotation names."""
    hit = cut(named(texts, facts, mods, known), "receivers-named")
    full = F.concat_ws(".", F.nullif("module", F.lit("")), F.nullif("owner", F.lit("")), "name")
    returns = facts.where("fact = 'function'").join(mods, "path").select(full.alias("symbol"), F.regexp_replace(F.get_json_object("detail", "$.returns"), "^['\"]|['\"]$", "").alias("said")).where("said <> ''").groupBy("symbol").agg(F.min("said").alias("said"))
    made = hit.where("kind = 'function'").join(returns, "symbol").select(F.col("path").alias("p"), F.col("text").alias("t"), F.col("file").alias("path"), F.col("said").alias("text"))
    made = made.join(named(made, facts, mods, known).where("kind = 'class'"), ["path", "text"]).select(F.col("p").alias("path"), F.col("t").alias("text"), F.col("symbol").alias("cls"))
    return hit.where("kind = 'class'").select("path", "text", F.col("symbol").alias("cls")).union(made)


def _said(bindings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type): what is said of a name in the end: the last strong binding, else the first weak one."""
    strong = F.max_by("target", F.when(F.col("detail") == "strong", F.col("line")))
    weak = F.min_by("target", F.when(F.col("detail") == "weak", F.col("line")))
    return bindings.groupBy(*keys).agg(F.coalesce(strong, weak).alias("type"))


def _classes(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'class'").select("path", F.concat_ws(".", F.nullif("owner", F.lit("")), "name").alias("cls")).distinct()


def _local_types(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """refs (id, path, owner, head, line) that have a local binding of head before them: (id, local), by running windows over both in order of lines."""
    b = facts.where("fact = 'binding' and owner <> ''").select("path", "owner", F.col("name").alias("head"), "line", F.col("target").alias("type"), (F.col("detail") == "strong").alias("strong"), F.lit(None).cast("long").alias("id"))
    asked = refs.where("owner <> ''").select("path", "owner", "head", "line", F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("strong"), "id")
    asked = asked.join(b.select("path", "owner", "head").distinct(), ["path", "owner", "head"], "left_semi").select(b.columns)
    w = Window.partitionBy("path", "owner", "head").orderBy("line", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    strong = F.last(F.when(F.col("strong"), F.col("type")), ignorenulls=True).over(w)
    weak = F.first(F.when(~F.col("strong"), F.col("type")), ignorenulls=True).over(w)
    return b.union(asked).withColumn("local", F.coalesce(strong, weak)).where("id is not null and local is not null").select("id", "local")


def targets(refs: DataFrame, facts: DataFrame, mods: DataFrame) -> DataFrame:
    """(id, symbol, kind, status) of refs (id, path, owner, line, text), uses of a name in a file (owner: the definition they lie in), that mean a known function or class.

    self.m and self.x.m need a class around them; a name with one part in front goes by its receiver's type, and without
    one, or without such a method, by definitions and imports. What goes through a type is static_inferred, else
    confirmed. Calls on a call's result and through super mean nothing known.
    """
    known = cut(symbols(facts, mods), "receivers-symbols")
    module = mods.select("path", "module")
    x = refs.where("text is not null and text not like '%()%' and text not like 'super.%'").select("id", "path", "owner", "line", "text")
    cls = _classes(facts)
    around = x.select("path", "owner").distinct().select("path", "owner", F.explode(F.array(F.col("owner"), F.regexp_replace("owner", r"\.?[^.]*$", ""))).alias("cls")).join(cls, ["path", "cls"])
    around = around.groupBy("path", "owner").agg(F.max_by("cls", F.length("cls")).alias("cls"))
    parts = F.split("text", r"\.")
    x = x.join(around, ["path", "owner"], "left").join(module, "path")
    x = x.withColumns({"own": F.col("text").startswith("self.") & F.col("cls").isNotNull(), "n": F.size(parts), "p": parts})
    x = cut(x.withColumns({"head": F.when(~F.col("own") & (F.col("n") == 2), F.get("p", F.lit(0))), "meth": F.get("p", F.col("n") - 1), "mine": F.concat_ws(".", F.nullif("module", F.lit("")), "cls")}), "receivers-refs")
    # the receiver's type as a text and the file that says it
    attributes = _said(facts.where("fact = 'attribute'").select("path", F.col("owner").alias("cls"), F.expr("substring(name, 6)").alias("attr"), "target", "detail", "line"), ["path", "cls", "attr"])
    by_attribute = x.where("own and n = 3").select("id", "path", "cls", F.get("p", F.lit(1)).alias("attr")).join(attributes, ["path", "cls", "attr"]).select("id", "path", F.col("type").alias("text"))
    of_module = _said(facts.where("fact = 'binding' and owner = ''").select("path", F.col("name").alias("head"), "target", "detail", "line"), ["path", "head"]).where("type <> ''")
    plain = x.where("head is not null")
    local = cut(_local_types(plain, facts), "receivers-local")
    free = plain.join(local.select("id"), "id", "left_anti")
    by_module = free.join(of_module, ["path", "head"]).select("id", "path", F.col("type").alias("text"))
    far = free.join(of_module.select("path", "head"), ["path", "head"], "left_anti").join(imported(facts), ["path", "head"]).join(mods.select("path", "package"), "path")
    far = far.select("id", absolute(F.col("to"), F.col("package")).alias("full")).select("id", F.regexp_replace("full", r"\.?[^.]*$", "").alias("module"), F.substring_index("full", ".", -1).alias("head"))
    far = far.join(mods.groupBy("module").agg(F.min("path").alias("path")), "module").join(of_module, ["path", "head"]).select("id", "path", F.col("type").alias("text"))
    by_local = local.join(plain.select("id", "path"), "id").where("local <> ''").select("id", "path", F.col("local").alias("text"))
    texts = cut(by_attribute.union(by_local).union(by_module).union(far), "receivers-types")
    of_type = texts.join(typed(texts, facts, mods, known), ["path", "text"]).select("id", "cls")
    wanted = cut(of_type.join(x.select("id", "meth"), "id").withColumn("status", F.lit("static_inferred")).union(x.where("own and n = 2").select("id", F.col("mine").alias("cls"), "meth", F.lit("confirmed"))), "receivers-wanted")
    bases = facts.where("fact = 'base_order'").join(mods, "path").select("path", F.concat_ws(".", F.nullif("module", F.lit("")), F.nullif("owner", F.lit("")), "name").alias("cls"), F.col("target").alias("text"), F.col("detail").cast("int").alias("pos"))
    bases = bases.join(named(bases, facts, mods, known).where("kind = 'class'"), ["path", "text"]).select("cls", F.col("symbol").alias("base"), "pos").where("cls <> base")
    methods = known.where("kind = 'function'").select(F.regexp_replace("symbol", r"\.[^.]*$", "").alias("cls"), F.substring_index("symbol", ".", -1).alias("method"))
    found = inherited_method(bases, methods, wanted.select("cls", F.col("meth").alias("method")).distinct(), DEPTH)
    met = wanted.join(found, (wanted["cls"] == found["cls"]) & (wanted["meth"] == found["method"])).select("id", F.concat_ws(".", "found", "meth").alias("symbol"), F.lit("function").alias("kind"), "status")
    met = cut(met, "receivers-met")
    # callables by name: all that are neither self's nor met by a type
    rest = x.where("not own").join(met.select("id"), "id", "left_anti")
    by_name = rest.join(named(rest, facts, mods, known), ["path", "text"]).select("id", "symbol", "kind", F.lit("confirmed").alias("status"))
    return met.union(by_name).join(of_type.select("id", F.lit(True).alias("is_typed")).distinct(), "id", "left").select("id", "symbol", "kind", "status", F.coalesce("is_typed", F.lit(False)).alias("by_type"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with an id made from what they hold, so that it is the same in every attempt."""
    return cut(rows.distinct().withColumn("id", F.xxhash64("path", "owner", "line", "text")), "receivers-uses")


def call_targets(facts: DataFrame, mods: DataFrame) -> DataFrame:
    """(src, dst, kind, status): calls of known functions and classes, by the definition (or module) that calls; what is said about one pair is one row, inferred if any call of it is."""
    uses = _numbered(facts.where("fact = 'call'").select("path", "owner", "line", F.col("name").alias("text")))
    hit = targets(uses, facts, mods).drop("by_type")
    x = hit.join(uses, "id").join(mods.select("path", "module"), "path")
    src = F.concat_ws(".", F.nullif("module", F.lit("")), F.nullif("owner", F.lit("")))
    return x.select(src.alias("src"), F.col("symbol").alias("dst"), F.when(F.col("kind") == "class", "instantiates").otherwise("calls").alias("kind"), "status").groupBy("src", "dst", "kind").agg(F.max("status").alias("status"))


def callback_targets(facts: DataFrame, mods: DataFrame) -> DataFrame:
    """(path, owner, line, slot, text, symbol): the functions that names among the arguments of calls mean, through partial too; classes are no callbacks, and where a receiver has a type only its methods count."""
    args = F.explode(F.from_json("detail", "array<struct<slot:string,kind:string,text:string>>")).alias("a")
    calls = facts.where(F.col("fact") == "call").where(F.substring_index("name", ".", -1) != "partial")  # what partial wraps counts where it is handed on
    given = calls.select("path", "owner", "line", args).where("a.kind = 'name' and a.text <> ''")
    given = given.select("path", "owner", "line", F.regexp_replace("a.slot", r"\.partial$", "").alias("slot"), F.col("a.text").alias("text")).distinct()
    uses = _numbered(given.select("path", "owner", "line", "text"))
    hit = targets(uses, facts, mods).where("kind = 'function' and (not by_type or status = 'static_inferred')")
    return given.join(uses, ["path", "owner", "line", "text"]).join(hit.select("id", "symbol"), "id").select("path", "owner", "line", "slot", "text", "symbol")
