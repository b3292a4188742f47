"""Runs that publish views: their state after a log of actions, verification of what was placed, choices and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.names import comparable

#: Tries after which a view has failed, the share of labels that verifies a view, labels compared at most.
MAX_ATTEMPTS, THRESHOLD, MAX_LABELS = 2, 0.6, 40


def fold(log: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(id, status, attempts, uncertain) of views after their log (id, seq, action, outcome).

    An action is begin, generate, place, verify or reconcile; an outcome ok, error, landed, none or null. begin marks a
    view uncertain until an outcome comes; an error counts as an attempt, and the view has failed when they are used up,
    which nothing undoes. generate, place and verify act only from pending, generated and placed. Repeated seq: by
    action. One ordered fold for each view, whose log is short: bounded by the attempts.
    """
    entry = F.struct("seq", "action", "outcome")
    x = log.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    zero = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(False).alias("uncertain"))
    moves = {("generate", "pending"): "generated", ("place", "generated"): "placed", ("verify", "placed"): "verified"}

    def step(s: Column, e: Column) -> Column:
        move = s["status"]
        for (action, before), after in moves.items():
            move = F.when((e["action"] == action) & (s["status"] == before), F.lit(after)).otherwise(move)
        tries = s["attempts"] + 1
        ok = F.struct(move.alias("status"), F.lit(0).alias("attempts"), F.lit(False).alias("uncertain"))
        bad = F.struct(F.when(tries >= attempts, F.lit("failed")).otherwise(s["status"]).alias("status"), tries.alias("attempts"), F.lit(False).alias("uncertain"))
        same = lambda flag: F.struct(s["status"].alias("status"), s["attempts"].alias("attempts"), F.lit(flag).alias("uncertain"))
        landed = F.struct(F.when(s["status"] == "pending", F.lit("generated")).otherwise(s["status"]).alias("status"), s["attempts"].alias("attempts"), F.lit(False).alias("uncertain"))
        return (
            F.when(s["status"] == "failed", same(False))
            .when(e["action"] == "begin", same(True))
            .when((e["action"] == "reconcile") & (e["outcome"] == "landed"), landed)
            .when(e["action"] == "reconcile", same(False))
            .when(e["outcome"] == "ok", ok)
            .when(e["outcome"] == "error", bad)
            .otherwise(s)
        )

    return x.select("id", F.aggregate("l", zero, step).alias("s")).select("id", "s.*")


def expected_labels(views: DataFrame) -> DataFrame:
    """(view, labels) of views (view, labels): comparable, distinct in order, of two characters or more, the first 40: the limit is the feature."""
    clean = F.array_distinct(F.filter(F.transform("labels", comparable), lambda l: F.length(l) >= 2))
    return views.select("view", F.slice(clean, 1, MAX_LABELS).alias("labels"))


def verify(expected: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(view, verdict, ratio, missing): expected (view, labels) against what stands there, found (view, text)."""
    x = expected.join(found.select("view", comparable(F.col("text")).alias("__text")), "view", "left")
    lost = F.filter("labels", lambda l: ~F.contains(F.coalesce("__text", F.lit("")), l))
    n = F.size("labels")
    ratio = F.when(n > 0, (n - F.size(lost)) / n).otherwise(0.0)
    verdict = F.when(F.col("__text").isNull(), "missing").when(n == 0, "unknown").when(ratio >= threshold, "ok").otherwise("mismatch")
    return x.select("view", verdict.alias("verdict"), F.round(ratio, 2).alias("ratio"), F.slice(lost, 1, 10).alias("missing"))


def choose(replies: DataFrame, choices: DataFrame) -> DataFrame:
    """(reply_id, key): the choice of the same menu that a reply names by key, else by its whole name, else by a unique part of one; null without.

    replies (reply_id, menu, reply), choices (menu, pos, key, name); menus are short lists.
    """
    x = replies.join(choices, "menu", "left")
    said, name = F.lower(F.trim("reply")), F.lower("name")
    key = F.min_by("key", F.when(F.contains("reply", "key"), F.col("pos")))
    sole = lambda hit: F.when(F.count_if(hit) == 1, F.min(F.when(hit, F.col("key"))))
    named = F.coalesce(name == said, F.lit(False))
    part = F.coalesce(F.contains(name, said) & (said != ""), F.lit(False))
    return x.groupBy("reply_id").agg(key.alias("k"), sole(named).alias("n"), F.count_if(named).alias("c"), sole(part).alias("p")).select("reply_id", F.coalesce("k", F.when(F.col("c") > 0, F.col("n")).otherwise(F.col("p"))).alias("key"))


def counted(log: DataFrame) -> DataFrame:
    """Log rows that use up the budget: attempts and estimates that are not marked as uncounted."""
    return log.where("event in ('attempt', 'driver_estimate') and coalesce(counted, true)")


def usage(log: DataFrame, now: float, minute_limit: int = 8, day_limit: int = 160) -> DataFrame:
    """One row: counts of the last minute and day at an instant, and what is left; a bare aggregate, so nothing is collected."""
    c = counted(log).where(F.col("ts") <= now)
    in_last = lambda s: F.count_if(F.col("ts") > now - s)
    return c.agg(in_last(60).alias("minute"), in_last(86_400).alias("day")).selectExpr("minute", "day", f"greatest({minute_limit} - minute, 0) as minute_left", f"greatest({day_limit} - day, 0) as day_left")


def admission(log: DataFrame, requests: DataFrame, window_s: int = 60, limit: int = 8) -> DataFrame:
    """requests (key, at, need) with their wait in seconds: until the oldest of the calls in the window that stand in the way have left it; infinite beyond the limit.

    A request sees only calls of its key in (at - window, at]; calls are dealt to the two windows that they can matter to.
    Each call carries the limit's number of latest call times, no more, so a busy key makes no long lists.
    """
    micros = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    slot = lambda c: F.floor(F.col(c) / window_s)
    part = Window.partitionBy("key", "__w")
    c = counted(log).select("key", "ts", F.explode(F.array(slot("ts"), slot("ts") + 1)).alias("__w"))
    c = c.withColumn("__last", F.collect_list("ts").over(part.orderBy("ts").rowsBetween(1 - limit, 0)))
    r = requests.select("key", F.col("at").alias("ts"), slot("at").alias("__w"), F.lit(None).cast("array<double>").alias("__last"), "need", F.lit(1).alias("__r"))
    both = c.select("key", "ts", "__w", "__last", F.lit(None).cast(requests.schema["need"].dataType).alias("need"), F.lit(0).alias("__r")).union(r)
    both = both.withColumn("__us", micros("ts"))
    recent = F.last("__last", ignorenulls=True).over(part.orderBy("__us", "__r").rowsBetween(Window.unboundedPreceding, 0))
    used = F.sum(1 - F.col("__r")).over(part.orderBy("__us").rangeBetween(1 - window_s * 1_000_000, 0))
    x = both.withColumns({"__seen": recent, "used": F.coalesce(used, F.lit(0)).cast("int")}).where("__r = 1").distinct()
    k = F.col("used") + F.col("need") - limit
    nth = F.get("__seen", F.size("__seen") - (limit - F.col("need") + 1))
    wait = F.when(F.col("need") > limit, F.lit(float("inf"))).when(k <= 0, 0.0).otherwise(nth + window_s - F.col("ts") + 0.01)
    return x.select("key", F.col("ts").alias("at"), "need", "used", wait.alias("wait"))


def remaining(state: DataFrame) -> DataFrame:
    """Views that still need work with their place: stale before pending ones by priority and id."""
    order = Window.partitionBy("row").orderBy("priority", "id")
    return state.where("status in ('pending', 'stale', 'generated')").withColumn("place", F.row_number().over(order) - 1)


def signature(rows: DataFrame, by: list[str], items: Column) -> DataFrame:
    """(by, signature): a hash of the sorted items of each group."""
    return rows.groupBy(*by).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(items))), 256).alias("signature"))
