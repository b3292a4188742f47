"""Operator 4: benchmark decontamination by template canonicalisation, in built-in functions only.

Numbers, units behind numbers, and names (capitalised words inside a sentence) become typed placeholders; other words
lose case and punctuation. A capitalised word at the beginning of a sentence may be a name or not: one form of the
template has it as a word, so that case may change, and one as a name unless it is a function word. Windows of five
words of both forms, one at each word, are hash-joined with the benchmark's. A window of placeholders alone says nothing
and isn't the benchmark's. As a document must share half of an item's windows, it shares one of the half that fewest
items have: only these find candidates. The candidates' windows are met with their places, each window of an item at its
first place there, and each goes with the place in the document that most others lie along with. Then slots are checked:
what one value of the item's placeholder became in the document must be one value throughout, and another value of the
kind another one, as in a re-parameterised question. An item without a window of its own (few words, or numbers alone)
is found word by word and value by value only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import bits_for, cut, hot_join, table, with_filter

#: Words of a window, the share of an item's windows that a document must have, and of slots that must agree.
SHINGLE, SHARE, AGREE = 5, 0.5, 0.8
#: The benchmark's rarest windows are broadcast up to so many; beyond, documents' windows that may be among them are shuffled to them.
MAX_BROADCAST = 500_000
#: Words from which an item without windows of its own is looked for inside of documents; shorter ones must be all that a document says.
LEAST = 3
PLACEHOLDERS = ["qname", "qnum", "qunit"]
UNITS = "mm cm km m kg mg g lbs lb oz ml l inches inch feet foot miles mile meters metres meter metre seconds second minutes minute hours hour days day weeks week years year dollars euros cents percent".split()
_NUMBER = r"[0-9][0-9.,:/]*"
# a capital first, then what stands in front of it: most places fail at once
_NAME = r"\p{Lu}(?<=[\p{Ll},] \p{Lu})\p{Ll}+"
#: Words that begin sentences and are no names.
FUNCTION = "A An The This That These Those He She It We You They I His Her Its Our Your Their My There Here If When While What Which Who Whom Whose Why Where How And But Or So Then Than As At By For From In Into Of On To With Without After Before Because Since Until Each Every All Some Any No Not One Both Is Are Was Were Do Does Did Has Have Had Can Could Should Would May Might Must".split()
_FIRST = rf"(?=\p{{Lu}})(?<![\p{{L}}\u0001])(?!(?:{'|'.join(FUNCTION)})(?!\p{{L}}))(\p{{Lu}}\p{{Ll}}+)"


def _marked(text: Column, values: bool) -> Column:
    """The text with placeholders, which hold their values between control characters if values."""
    v = "\u0001$0\u0002" if values else ""
    x = F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002", "  ")
    x = F.regexp_replace(x, _NAME, f" qname{v} ")
    x = F.regexp_replace(x, _FIRST, " qstart\u0001$1\u0002 " if values else " qstartx$1 ")
    x = F.regexp_replace(x, rf"({_NUMBER}) ?({'|'.join(UNITS)})\b", "$1 qunit ")
    return F.regexp_replace(x, _NUMBER, f" qnum{v} ")


def _tokens(template: Column) -> Column:
    return F.array_remove(F.split(template, r"[^\p{L}]+"), "")


def _window_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, h): hashes of all windows of both forms; form 2 where they are one. No array is looked at by a lambda: windows are zipped slices, hashed once they are rows."""
    marked = df.select(key, F.lower(_marked(F.col(text), False)).alias("m"))
    several = F.contains("m", F.lit("qstartx"))
    as_word = F.replace(F.col("m"), F.lit("qstartx"), F.lit(""))
    as_name = F.when(several, F.regexp_replace("m", r"qstartx\p{L}*", "qname"))
    one = marked.select(key, several.alias("two"), F.posexplode(F.array(as_word, as_name)).alias("form", "m")).where("m is not null")
    t = one.select(key, F.when(F.col("two"), F.col("form")).otherwise(2).alias("form"), _tokens(F.col("m")).alias("t"))
    n = F.greatest(F.size("t") - (SHINGLE - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("t", k + 1, n).alias(f"w{k}") for k in range(SHINGLE)])
    w = t.where(F.size("t") >= SHINGLE).select(key, "form", F.explode(zipped).alias("w"))
    return w.select(key, "form", F.xxhash64(*[F.col("w").getField(f"w{k}") for k in range(SHINGLE)]).alias("h"))


def words_and_values(text: Column) -> list[Column]:
    """Both forms as structs (w, v), v a placeholder's value or empty."""
    tokens = F.regexp_extract_all(F.lower(_marked(text, True)), F.lit("(q[a-z]+\u0001[^\u0002]*\u0002|\\p{L}+)"), F.lit(1))
    w, v = lambda t: F.split_part(t, F.lit("\u0001"), F.lit(1)), lambda t: F.regexp_extract(t, "\u0001([^\u0002]*)", 1)
    first = lambda t: t.startswith("qstart\u0001")
    as_word = F.transform(tokens, lambda t: F.struct(F.when(first(t), v(t)).otherwise(w(t)).alias("w"), F.when(first(t), "").otherwise(v(t)).alias("v")))
    return [as_word, F.transform(tokens, lambda t: F.struct(F.when(first(t), "qname").otherwise(w(t)).alias("w"), v(t).alias("v")))]


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, slots, agreeing) for each document that holds a benchmark item, verbatim or re-parameterised.

    share: of the item's distinct template windows that have a word, those in the document, at least SHARE, in the form that shares more. Of the item's
    placeholder values in shared windows (slots), at least AGREE became one value in the document each, and no two names or numbers one. Items of
    fewer than SHINGLE words or without a word are found where all their words and values stand as they are (share 1, no slots), those of fewer
    than LEAST words only as a whole document. Null and empty texts hold nothing and are held by nothing. Rows that repeat an id are taken
    together; rows with null ids are not reported. Empty tables give no rows; other columns are not read.
    """
    docs, items = _read(docs, items)
    both, own = _shared(docs, items)
    key = ["doc_id", "item_id", "form"]
    share = both.groupBy(*key).agg((F.countDistinct("ip") / F.first("all")).alias("share")).where(F.col("share") >= SHARE)
    # each window of the item at the place in the document that most of its windows lie along with
    along = both.withColumn("off", F.col("dp") - F.col("ip"))
    along = along.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key, "off")))
    best = along.groupBy(*key, "ip").agg(F.min_by(F.struct("iv", "dv"), F.struct(-F.col("n"), "off")).alias("x"))
    value = best.select(*key, F.explode(F.arrays_zip("x.iv", "x.dv")).alias("x")).where("x.iv.v <> ''").select(*key, F.col("x.iv.w").alias("kind"), F.col("x.iv.v").alias("iv"), F.col("x.dv.v").alias("dv"))
    slot = value.groupBy(*key, "kind", "iv").agg(F.min("dv").alias("dv"), (F.countDistinct("dv") == 1).alias("one"))
    # of several values of a kind that became one, one agrees
    slot = slot.groupBy(*key).agg(F.count(F.lit(1)).alias("slots"), F.countDistinct(F.when(F.col("one"), F.struct("kind", "dv"))).alias("agreeing"))
    out = share.join(slot, key, "left").fillna(0, ["slots", "agreeing"])
    out = out.where(F.col("agreeing") >= AGREE * F.col("slots")).groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "slots", "agreeing")).alias("b"))
    out = out.select("doc_id", "item_id", "b.share", "b.slots", "b.agreeing")
    rest = cut(items.join(own.select("item_id").distinct(), "item_id", "left_anti"), "leaks-literal")
    return out.union(_verbatim(docs, rest)) if rest.limit(1).count() else out


def _read(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return docs, cut(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text" if "text" in items.columns else "item").alias("item")).where("item_id is not null"), "leaks-items")


def _meet(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of which one form of the item shares enough windows with the document."""
    both, _ = _shared(*_read(docs, items))
    share = both.groupBy("doc_id", "item_id", "form").agg((F.countDistinct("ip") / F.first("all")).alias("share"))
    return share.where(F.col("share") >= SHARE).select("doc_id", "item_id").distinct()


def _listed(rows: DataFrame, right: DataFrame) -> DataFrame:
    """rows (h, ...), each once, with each of right's (h, ...) by h as x: right as one list a window, so that hot windows of rows stay where they are. Only rows whose h may be right's are shuffled."""
    lists = right.groupBy("h").agg(F.collect_list(F.struct(*[c for c in right.columns if c != "h"])).alias("l"))
    rows = cut(with_filter(rows, right, "h", "maybe", bits_for(right.count())).where("maybe").drop("maybe").distinct(), "leaks-rows")
    met = hot_join(rows, lists, "h", rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), rows.count()).where("l is not null")
    return met.select(*rows.columns, F.explode("l").alias("x"))


def _candidates(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that have one of an item's rarest windows (own: item_id, form, h), of which a document that shares enough can't miss all."""
    often = own.select("item_id", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("item_id", "form").orderBy("often", "h"))
    held = F.count(F.lit(1)).over(Window.partitionBy("item_id", "form"))
    rare = own.select("item_id", "form", "h").distinct().join(often, "h").withColumns({"rank": rank, "all": held})
    rare = cut(rare.where(F.col("rank") <= F.col("all") - F.ceil(SHARE * F.col("all")) + 1).select("h", "item_id").distinct(), "leaks-rare")
    w = _window_rows(docs, "doc_id", "text").select("doc_id", "h")
    if rare.count() <= MAX_BROADCAST:
        return w.join(F.broadcast(rare), "h").select("doc_id", "item_id").distinct()
    return _listed(w, rare).select("doc_id", "x.item_id").distinct()


def _shared(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shared, own): the windows that candidates share (doc_id, item_id, form, dp, dv, ip, iv, all), each at all its places in the document and its
    first one in the item, of all the item's; and the items' windows (item_id, form, h, ip, iv)."""
    words = F.filter("iv", lambda t: ~t["w"].isin(PLACEHOLDERS))
    own = _slots(items, "item_id", "item", "iv").where(F.size(words) > 0)
    own = cut(own.groupBy("item_id", "form", "h").agg(F.min_by(F.struct("pos", "iv"), "pos").alias("x")).select("item_id", "form", "h", F.col("x.pos").alias("ip"), "x.iv"), "leaks-own")
    pairs = cut(_candidates(docs, own), "leaks-candidates")
    ids = pairs.select("doc_id").distinct()
    found = with_filter(docs, ids, "doc_id", "maybe", bits_for(ids.count())).where("maybe").select("doc_id", "text").join(ids, "doc_id", "left_semi")
    held = own.groupBy("item_id", "form").agg(F.count(F.lit(1)).alias("all"))
    mine = own.join(pairs.select("item_id").distinct(), "item_id", "left_semi").join(held, ["item_id", "form"])
    mine = cut(mine.select(F.xxhash64("form", "h").alias("h"), "item_id", "ip", "iv", "all"), "leaks-item-windows")
    theirs = _slots(found, "doc_id", "text", "dv").select("doc_id", "form", F.xxhash64("form", "h").alias("h"), F.col("pos").alias("dp"), "dv")
    met = _listed(theirs, mine).select("doc_id", "x.item_id", "form", "dp", "dv", "x.ip", "x.iv", "x.all")
    return cut(met.join(pairs, ["doc_id", "item_id"], "left_semi"), "leaks-shared"), own


def _verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same columns for items that have no window of their own: all runs of their words and values, of SHINGLE or fewer, are the document's."""
    literal = lambda t: F.when(t["v"] != "", t["v"]).otherwise(t["w"])
    said = lambda c: F.transform(words_and_values(F.col(c))[0], literal)
    x = cut(items.select("item_id", said("item").alias("t")).where("size(t) > 0").withColumn("n", F.when(F.size("t") < LEAST, 0).otherwise(F.least(F.size("t"), F.lit(SHINGLE)))), "leaks-words")
    sizes = [r.n for r in x.select("n").distinct().collect()]  # 0 and LEAST to SHINGLE: four at most

    def runs(df, n):
        if not n:
            return df.select(df.columns[0], F.xxhash64(F.lit(n), "t").alias("h"))
        at = F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - n + 1)).otherwise(F.array().cast("array<int>"))
        return df.select(df.columns[0], F.explode(F.transform(at, lambda i: F.xxhash64(F.lit(n), F.slice("t", i, n)))).alias("h"))

    d = docs.select("doc_id", said("text").alias("t"))
    out = None
    for n in sizes:
        own = cut(runs(x.where(F.col("n") == n).select("item_id", "t"), n).distinct(), "leaks-runs")
        held = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("all"))
        hit = _listed(runs(d, n), own.join(held, "item_id").select("h", "item_id", "all"))
        got = hit.groupBy("doc_id", "x.item_id", "x.all").agg(F.countDistinct("h").alias("k")).where("k = all").select("doc_id", "item_id")
        out = got if out is None else out.union(got)
    zero = F.lit(0).cast("long")
    return out.distinct().select("doc_id", "item_id", F.lit(1.0).alias("share"), zero.alias("slots"), zero.alias("agreeing"))


def _slots(df: DataFrame, key: str, text: str, values: str) -> DataFrame:
    """(key, form, h, pos, values) of each window with its words' placeholders and values (w, v)."""
    x = df.select(key, F.posexplode(F.array(*words_and_values(F.col(text)))).alias("form", "t"))
    n = F.size("t")
    at = F.when(n >= SHINGLE, F.sequence(F.lit(1), n - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    words = lambda i: [F.get(F.col("t"), i + (k - 1)).getField("w") for k in range(SHINGLE)]
    x = x.select(key, "form", F.explode(F.transform(at, lambda i: F.struct(F.xxhash64(*words(i)).alias("h"), i.alias("pos"), F.slice("t", i, SHINGLE).alias(values)))).alias("p"))
    return x.select(key, "form", "p.h", "p.pos", f"p.{values}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
