"""Facts of C and C++ files and their resolution: includes, classes, functions, calls of names that are defined once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.operators import joins
from quarrygraph.sources.tokens import Step, either, leading, matched, opened, perhaps, quoted, sign, upto, whole, word

ENDINGS = ["c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx"]
# Words in front of a bracket that are no calls.
KEYWORDS = "if for while switch return catch sizeof decltype static_assert dynamic_cast reinterpret_cast const_cast static_cast defined else do new delete".split()
#: Signs that a type in front of a function's name may have.
_TYPE = {"::", "<", ">", ",", "*", "&", "~"}


def _declared(into: str) -> Step:
    """A function's name, qualified or not, with nothing but a type in front of it on its line."""

    def step(ts, i, named):
        if ts[i].kind != "word" and ts[i].text != "~" or i and ts[i - 1].text in ("::", "~") and ts[i - 1].line == ts[i].line:
            return
        k = i
        while not ts[k].leads:
            k -= 1
            if ts[k].kind == "quoted" or ts[k].kind == "sign" and ts[k].text not in _TYPE:
                return
        j = i
        while j + 1 < len(ts) and ts[j].kind == "word" and ts[j + 1].text == "::":
            j += 2
        j += j < len(ts) and ts[j].text == "~"
        if j < len(ts) and ts[j].kind == "word" and not ts[j].text[0].isdigit():
            yield j + 1, named | {into: "".join(t.text for t in ts[i : j + 1]), f"at {into}": ts[i].line}

    return step


def _alone() -> Step:
    """Nothing in front says whose the next name is."""

    def step(ts, i, named):
        if not (i > 1 and ts[i - 1].text in (".", "->", "::") and ts[i - 2].kind == "word"):
            yield i, named

    return step


_bases = (sign(":"), upto("{", into="target"))
_behind = either(*[((word("const", "noexcept", "override", "final"),) * n) for n in (3, 2, 1, 0)])
RULES = [
    ("include", (leading(), sign("#"), word("include"), quoted("target"))),
    ("system", (leading(), sign("#"), word("include"), sign("<"), upto(">", into="target"))),
    ("class", (word("class", "struct"), either((word(into="name"), perhaps(word("final"))), (word(), word(into="name"), perhaps(word("final")))), perhaps(*_bases), opened())),
    ("function", (_declared("name"), whole("("), _behind, perhaps(sign("->"), upto("{", ":")), perhaps(sign(":"), upto("{")), opened())),
    ("call", (either((word(into="target"), sign(".", "->", "::", into="detail"), word(into="name")), (_alone(), word(into="name"))), sign("("))),
]


def facts(files: DataFrame) -> DataFrame:
    """Rows of scanner.SCHEMA; words of the language are neither functions nor calls."""
    x = matched(files, ENDINGS, RULES)
    system = F.col("fact") == "system"
    x = x.withColumns({"detail": F.when(system, "<").when(F.col("fact") == "include", '"').otherwise(F.col("detail")), "fact": F.when(system, "include").otherwise(F.col("fact"))})
    return x.where(~(F.col("fact").isin("call", "function") & F.substring_index("name", "::", -1).isin(KEYWORDS)))


def functions(found: DataFrame) -> DataFrame:
    """(id, path, name, class, line, end_line, entry): functions; one inside a class's span or qualified by one is its method; main is an entry point."""
    f = found.where("fact = 'function'").select("path", "name", "line", "end_line").distinct()
    f = f.withColumn("at", F.struct("path", "name", "line"))
    spans = found.where("fact = 'class'").select("path", F.col("name").alias("cls"), F.col("line").cast("long").alias("s"), F.col("end_line").cast("long").alias("e"))
    within = f.join(spans, "path").where("line > s and line <= e").groupBy("at").agg(F.max_by("cls", "s").alias("inside"))
    own = F.nullif(F.regexp_extract("name", r"(?:^|::)(\w+)::~?\w+$", 1), F.lit(""))
    x = f.join(within, "at", "left").withColumn("class", F.coalesce(own, "inside"))
    short = F.substring_index("name", "::", -1)
    ident = F.concat(F.lit("fn:"), "path", F.lit(":"), F.concat_ws("::", "class", short))
    return x.select(ident.alias("id"), "path", short.alias("name"), "class", "line", "end_line", (F.col("class").isNull() & (short == "main")).alias("entry"))


def owner_class(function_id):
    """The class in a function's id, null for a free one."""
    return F.nullif(F.regexp_extract(function_id, r":(?:\w+::)*?(\w+)::~?\w+$", 1), F.lit(""))


def includes(found: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): includes of known files: beside the file, as written, by the only path that ends so, by the only file of that name. System includes only as written."""
    i = found.where("fact = 'include'").select("path", "target", "detail").distinct()
    name = F.substring_index("target", "/", -1)
    i = i.withColumns({"id": F.struct("path", "target"), "beside": F.concat_ws("/", F.nullif(F.regexp_replace("path", "/?[^/]*$", ""), F.lit("")), "target"), "whole": F.col("target"), "tail": F.when(F.col("detail") == '"', F.col("target")), "base": F.when(F.col("detail") == '"', name)})
    f = files.where(F.col("path").rlike(r"\.(" + "|".join(ENDINGS) + ")$")).select(F.col("path").alias("file")).distinct()
    parts = F.split("file", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    hits = []
    for order, (key, dim) in enumerate([("beside", f.withColumn("k", F.col("file"))), ("whole", f.withColumn("k", F.col("file"))), ("tail", f.select("file", F.explode(tails).alias("k"))), ("base", f.withColumn("k", F.substring_index("file", "/", -1)))]):
        one = dim.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).where("n = 1")
        hits.append(i.select("id", F.col(key).alias("k")).join(one, "k").select("id", "file", F.lit(order).alias("o")))
    every = hits[0].union(hits[1]).union(hits[2]).union(hits[3])
    return every.groupBy("id").agg(F.min_by("file", "o").alias("dst")).select(F.col("id.path").alias("src"), "dst").where("src <> dst").distinct()


def inheritance(found: DataFrame) -> DataFrame:
    """(src, dst): classes and their bases whose short name one class alone has."""
    c = found.where("fact = 'class'").select("path", "name", "target").distinct()
    one = c.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("file")).where("n = 1")
    base = F.regexp_replace(F.trim(F.regexp_replace("base", r"\b(public|protected|private|virtual)\b", "")), r"<.*$", "")
    b = c.where("target is not null").select("path", F.col("name").alias("cls"), F.explode(F.split("target", r",(?![^<]*>)")).alias("base")).withColumn("name", F.substring_index(F.trim(base), "::", -1))
    ident = lambda path, name: F.concat(F.lit("cls:"), path, F.lit(":"), name)
    return b.join(one, "name").select(ident(F.col("path"), F.col("cls")).alias("src"), ident(F.col("file"), F.col("name")).alias("dst")).where("src <> dst").distinct()


def calls(found: DataFrame, defined: DataFrame) -> DataFrame:
    """(src, dst): calls in functions (functions) of names defined once: with . or -> of a method, with X:: of class X, else of a free function or one of the same class."""
    once = defined.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst"), F.min("class").alias("dst_class")).where("n = 1").drop("n")
    c = found.where("fact = 'call'").select(F.xxhash64("path", "line", "name", "target", "detail").alias("call"), "path", "name", "target", "detail", F.col("line").cast("long").alias("at")).distinct()
    spans = defined.select("path", F.xxhash64("id").alias("span"), "id", "class", F.col("line").cast("long").alias("s"), F.col("end_line").cast("long").alias("e"))
    c = c.join(once, "name")
    inside = joins.innermost_span(c.select("call", "at", "path"), "call", "at", spans, "span", "s", "e", "path", width=200)
    x = c.join(inside.select("call", "span"), "call").join(spans.select("span", F.col("id").alias("src"), F.col("class").alias("src_class")).distinct(), "span")
    fits = F.when(F.col("detail").isin(".", "->"), F.col("dst_class").isNotNull()).when(F.col("detail") == "::", F.col("dst_class").eqNullSafe(F.col("target"))).otherwise(F.col("dst_class").isNull() | F.col("dst_class").eqNullSafe(F.col("src_class")))
    return x.where(fits).where("src <> dst").select("src", "dst").distinct()
