"""Facts of JavaScript and TypeScript files, and what they meet: files that imports name, routes that requests ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.text import route
from quarrygraph.operators import joins
from quarrygraph.sources.tokens import dotted, either, last_argument, leading, matched, opened, perhaps, quoted, sign, upto, whole, word

# Endings in the order in which imports try them, server packages, methods, events that are no messages.
ENDINGS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "mts"]
SERVERS = ["express", "fastify", "koa", "@koa/router", "koa-router", "hono", "restify"]
BUILTIN_EVENTS = "data end error close finish connect connection open drain readable exit listening request upgrade uncaughtException unhandledRejection SIGINT SIGTERM click dblclick submit change input keydown keyup keypress mousedown mouseup mousemove mouseenter mouseleave focus blur load unload resize scroll ready touchstart touchend beforeunload hashchange popstate".split()
# Words that make routers, methods of routes and requests, words of messaging and storage libraries.
ROUTERS = ["express", "Router", "fastify", "Fastify", "Koa", "KoaRouter", "Hono"]
METHODS = ["get", "post", "put", "delete", "patch"]
PUBLISH = ["emit", "publish", "sendToQueue", "produce"]
SUBSCRIBE = ["on", "once", "subscribe", "addListener", "consume"]
PRISMA = ["findMany", "findUnique", "findFirst", "create", "update", "delete", "upsert", "count", "aggregate", "createMany", "updateMany", "deleteMany"]
_CHANNEL = r"[\w:./-]+"
_said = (perhaps(word("export", into="detail")), perhaps(word("default")))
_typed = perhaps(sign(":"), upto("=", "=>", "{"))
_asked = (sign("("), quoted("target"))
_topic = (sign("("), sign("{"), word("topic", "topics"), sign(":"), perhaps(sign("[")), quoted("name", _CHANNEL))
RULES = [
    ("import", (leading(), word("import", "export"), upto("from", never=(";", "(")), word("from"), quoted("target"))),
    ("import", (leading(), word("import"), quoted("target"))),
    ("import", (word("require", "import"), *_asked, sign(")"))),
    ("function", (leading(0), *_said, perhaps(word("async")), word("function"), perhaps(sign("*")), word(into="name"), whole("("), upto("{"), opened())),
    ("function", (leading(0), *_said, word("const", "let"), word(into="name"), _typed, sign("="), perhaps(word("async")), either((whole("("),), (word(),)), _typed, sign("=>"), perhaps(opened()))),
    ("class", (leading(0), *_said, perhaps(word("abstract")), word("class"), word(into="name"), perhaps(word("extends"), dotted("target")), upto("{"), opened())),
    ("router", (word("const", "let", "var"), word(into="name"), sign("="), perhaps(word("new")), dotted("detail", tuple(ROUTERS)), sign("("))),
    ("route", (dotted("detail", (*METHODS, "all")), sign("("), quoted("target", "/.*"), sign(","), last_argument("name"))),
    ("file_route", (leading(), word("export"), perhaps(word("async")), word("function", "const"), word(*map(str.upper, METHODS), into="name"))),
    ("request", (word("fetch"), *_asked, perhaps(sign(","), sign("{"), upto("method", never=("}",)), word("method"), sign(":"), quoted("name", r"\w+")))),
    ("request", (word("axios", "api", "client", "http"), sign("."), word(*METHODS, into="name"), *_asked)),
    ("publish", (sign("."), word(*PUBLISH, into="detail"), sign("("), quoted("name", _CHANNEL))),
    ("publish", (sign("."), word("send", into="detail"), *_topic)),
    ("subscribe", (sign("."), word(*SUBSCRIBE, into="detail"), sign("("), quoted("name", _CHANNEL), perhaps(sign(","), dotted("target")))),
    ("subscribe", (sign("."), word("subscribe", into="detail"), *_topic)),
    ("model", (word("mongoose"), sign("."), word("model"), sign("("), quoted("name", r"\w+"))),
    ("data", (word("prisma"), sign("."), word(into="name"), sign("."), word(*PRISMA, into="detail"))),
    ("sql", (sign("."), word("query", "execute"), sign("("), quoted("target", r"(?is)\s*(?:select|insert|update|delete)\b.*"))),
    ("state", (word("createSlice"), sign("("), sign("{"), word("name"), sign(":"), quoted("name", r"\w+"))),
    ("state", (word("const", "let"), word(into="name"), sign("="), perhaps(word("React"), sign(".")), word("createContext"), sign("("))),
    ("call", (dotted("name"), sign("("))),
]
KEYWORDS = "if for while switch return catch function await typeof new import require super constructor throw delete void".split()


def facts(files: DataFrame) -> DataFrame:
    """Rows of scanner.SCHEMA; calls are no keywords, handlers of browser and stream events are no messages, only functions with a capital in UI files are components (detail ui)."""
    x = matched(files, ENDINGS, RULES)
    head = F.substring_index("name", ".", 1)
    # statements in quotes: what they do, and the first table that they name
    verb, into = F.upper(F.regexp_extract("target", r"(\w+)", 1)), r"(?i)\b(?:from|into|^\s*update)\s+(\w+)"
    sql = F.col("fact") == "sql"
    x = x.withColumns({"fact": F.when(sql, "data").otherwise(F.col("fact")), "name": F.when(sql, F.nullif(F.regexp_extract("target", into, 1), F.lit(""))).otherwise(F.col("name")), "detail": F.when(sql, verb).otherwise(F.col("detail")), "target": F.when(~sql, F.col("target"))})
    x = x.where("fact <> 'data' or name is not null")
    x = x.where(~((F.col("fact") == "call") & head.isin(KEYWORDS))).where(~(F.col("fact").isin("publish", "subscribe") & F.col("name").isin(BUILTIN_EVENTS)))
    ui = (F.col("fact") == "function") & F.col("path").rlike(r"\.(jsx|tsx)$") & F.col("name").rlike("^[A-Z]")
    exported = F.col("fact").isin("function", "class")
    return x.withColumn("detail", F.when(ui, "ui").when(exported, F.when(F.col("detail").isNotNull(), "export")).otherwise(F.trim("detail"))).distinct()


def _normal(path):
    """Folders . and .. resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(up, "/")


def imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, spec): imports of known files: as written, with an ending, as a folder's index; names that begin with @/ or ~/ also below src. Others are packages."""
    i = found.where("fact = 'import'").select("path", F.col("target").alias("spec")).distinct()
    here = F.regexp_replace("path", "/?[^/]*$", "")
    near = F.when(F.col("spec").startswith("."), F.array(_normal(F.concat_ws("/", here, F.col("spec")))))
    alias = F.when(F.col("spec").rlike("^[@~]/"), F.array(*[F.concat(F.lit(b), F.substring("spec", 3, 10_000)) for b in ("src/", "")]))
    i = i.withColumn("base", F.coalesce(near, alias)).where("base is not null")
    tries = ["", *[f".{e}" for e in ENDINGS], *[f"/index.{e}" for e in ENDINGS]]
    candidates = F.flatten(F.transform("base", lambda b: F.array(*[F.concat(b, F.lit(t)) for t in tries])))
    x = i.withColumn("key", F.struct("path", "spec"))
    hit = joins.ordered_candidates(x.select("key", "base"), "key", candidates, files.select(F.col("path").alias("file")), "file")
    return hit.select(F.col("key.path").alias("src"), F.col("file").alias("dst"), F.col("key.spec").alias("spec")).where("src <> dst")


def packages(found: DataFrame) -> DataFrame:
    """(path, package): imports that name no file: the package, with its scope."""
    spec = F.col("target")
    name = F.when(spec.startswith("@"), F.regexp_extract(spec, "^(@[^/]+/[^/]+)", 1)).otherwise(F.substring_index(spec, "/", 1))
    return found.where("fact = 'import'").where(~spec.rlike(r"^(\.|[@~]/)")).select("path", name.alias("package")).distinct()


def routes(found: DataFrame) -> DataFrame:
    """(method, route, path, handler, line): routes of receivers that the file makes as routers, or of any receiver named app, router or server where it imports a server package; and files under api folders that export methods."""
    made = found.where("fact = 'router'").select("path", F.col("name").alias("receiver")).distinct().withColumn("__made", F.lit(True))
    serving = packages(found).where(F.col("package").isin(SERVERS)).select("path").distinct().withColumn("__server", F.lit(True))
    r = found.where("fact = 'route'").withColumns({"receiver": F.substring_index("detail", ".", 1), "method": F.upper(F.substring_index("detail", ".", -1))})
    r = r.join(made, ["path", "receiver"], "left").join(serving, "path", "left").where("__made or (__server and receiver in ('app', 'router', 'server'))")
    told = r.select(F.when(F.col("method") == "ALL", "ANY").otherwise(F.col("method")).alias("method"), route(F.col("target")).alias("route"), "path", F.col("name").alias("handler"), "line")
    at = F.regexp_extract("path", r"(?:^|/)(?:app|pages|src/app)(/api(?:/.*)?)/route\.[a-z]+$", 1)
    filed = found.where("fact = 'file_route'").withColumn("at", at).where("at <> ''").select(F.col("name").alias("method"), F.regexp_replace("at", r"\[[^\]]*\]", "{}").alias("route"), "path", F.col("name").alias("handler"), "line")
    return told.union(filed)


def requests(found: DataFrame) -> DataFrame:
    """(method, route, host, path, line): requests by method and normalised route; the host of addresses elsewhere, null for our own."""
    x = found.where("fact = 'request'").withColumn("method", F.upper(F.coalesce("name", F.lit("GET"))))
    host = F.regexp_extract("target", r"^\w+://([^/:?#]+)", 1)
    own = F.regexp_replace("target", r"^(\w+://[^/?#]*|\$\{[^}]*\}(?=/))", "")
    return x.select("method", route(own).alias("route"), F.when(~host.isin("", "localhost", "127.0.0.1", "0.0.0.0"), host).alias("host"), "path", "line")


def answered(asked: DataFrame, served: DataFrame) -> DataFrame:
    """(client, server, method, route): requests of one language that meet routes of any by method and route."""
    a = asked.where("host is null").select(F.col("path").alias("client"), "method", "route").distinct()
    s = served.select(F.col("path").alias("server"), "method", "route").distinct()
    exact = a.join(s, ["method", "route"])
    other = a.join(s.where("method = 'ANY'").drop("method"), "route")
    return exact.select("client", "server", "method", "route").union(other.select("client", "server", "method", "route")).distinct()
