"""The next action of every run at once, and run states that were written by older or newer versions.

What a run does next is the first of an ordered list of rules that holds for it. The rules look at one row a run: its own
flags, and what its views come to in one aggregation. An action that calls a counted tool then has to pass the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stops that are looked at again, statuses that are on the board, tools by purpose, those that count for nothing.
RETRIED = ["budget", "rate_limit"]
SHOWN = ["placed", "verified"]
TOOLS = {"reconcile_generate": "get_figjam", "verify": "get_figjam", "place": "use_figma", "legend": "use_figma", "delete": "use_figma", "generate": "generate_diagram", "screenshot": "get_screenshot", "whoami": "whoami"}
EXEMPT = ["whoami"]
#: Calls of a minute and of a day, tries of a view, what a generated view needs room for, seconds that may be waited.
PER_MINUTE, PER_DAY, MAX_ATTEMPTS, GENERATE_NEEDS, MAX_WAIT = 8, 160, 2, 2, 60.0


def _signature(value: Column) -> Column:
    return F.sha2(F.to_json(value), 256)


def facts(runs: DataFrame, views: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """runs with what their views (run, id, priority, status, attempts, section, type, title, categories, check, looked, delete_failed) come to.

    to_place, to_draw and to_look: the first view by priority and id that waits for it; obsolete: whether sections are to go;
    board and legend: signatures of what is shown, null where nothing is.
    """
    place = F.struct("priority", "id")
    first = lambda when: F.min(F.when(when, place))["id"]
    shown = F.col("status").isin(SHOWN) & F.col("section").isNotNull()
    item = F.struct("priority", "id", "title", "type", "section")
    look = shown & ~F.coalesce("looked", F.lit(False)) & ((F.col("check") == "mismatch") | (F.col("visual") & (F.col("check") == "ok")))
    x = views.join(runs.select("run", F.coalesce("visual", F.lit(False)).alias("visual")), "run").groupBy("run").agg(
        first(F.col("status") == "generated").alias("to_place"),
        first(F.col("status").isin("pending", "stale") & (F.col("attempts") < max_attempts)).alias("to_draw"),
        first(look).alias("to_look"),
        F.max((F.col("status") == "obsolete") & F.col("section").isNotNull() & ~F.coalesce("delete_failed", F.lit(False))).alias("obsolete"),
        F.sort_array(F.collect_list(F.when(shown, item))).alias("shown"),  # a run's views, bounded by its plan
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(shown, F.col("categories")))))).alias("cats"),
    )
    x = runs.join(x, "run", "left").withColumn("any", F.coalesce(F.size("shown"), F.lit(0)) > 0)
    named = F.transform("shown", lambda s: F.struct(s["id"], s["title"], s["type"]))
    sections = F.transform("shown", lambda s: F.struct(s["id"], s["section"]))
    return x.withColumns({"board": F.when(F.col("any"), _signature(sections)), "legend": F.when(F.col("any"), _signature(F.struct(F.col("cats"), named.alias("items"), F.col("revision"))))})


def next_actions(runs: DataFrame, views: DataFrame, calls: DataFrame | None = None, max_attempts: int = MAX_ATTEMPTS, per_minute: int = PER_MINUTE, per_day: int = PER_DAY, max_wait: float = MAX_WAIT) -> DataFrame:
    """(run, purpose, view, tool, decision, reason, wait): each run's next action.

    runs: run, now, confirmed, auto, visual, file_key, revision, plan_key, plan_checked, plan_choices, uncertain, pending_kind, pending_purpose,
    pending_view, stop_reason, legend_hash, legend_failed_hash, verify_sig, verify_status, and may have backoff_until. calls: (run, ts) of counted calls. decision: act;
    ask where a person answers; stop where the budget lacks room, for the reason, or an earlier stop holds. wait: seconds
    to sleep first. A pending question is asked again, a pending generation is uncertain, other pending actions are safe
    to repeat. Runs without views go on to done.
    """
    x = facts(runs, views, max_attempts)
    uncertain = F.coalesce(F.when((F.col("pending_purpose") == "generate") & (F.col("pending_kind") != "ask_user"), F.col("pending_view")), F.col("uncertain"))
    no_key = F.col("plan_key").isNull() & ~F.coalesce("plan_checked", F.lit(False))
    has_file = F.col("file_key").isNotNull()
    act = lambda purpose, view=None: F.struct((F.lit(purpose) if isinstance(purpose, str) else purpose).alias("purpose"), (F.lit(None) if view is None else view).cast("string").alias("view"))
    rules = [
        (F.col("stop_reason").isNotNull() & ~F.col("stop_reason").isin(RETRIED), act("stop")),
        (F.col("pending_kind") == "ask_user", act(F.col("pending_purpose"), F.col("pending_view"))),
        (uncertain.isNotNull() & has_file, act("reconcile_generate", uncertain)),
        (uncertain.isNotNull(), act("ask_file_url", uncertain)),
        (~F.coalesce("confirmed", F.lit(False)) & ~F.coalesce("auto", F.lit(False)), act("confirm")),
        (F.col("to_place").isNotNull(), act("place", F.col("to_place"))),
        (F.col("to_draw").isNotNull() & no_key & (F.coalesce("plan_choices", F.lit(0)) > 1), act("ask_plan")),
        (F.col("to_draw").isNotNull() & no_key, act("whoami")),
        (F.col("to_draw").isNotNull(), act("generate", F.col("to_draw"))),
        (F.col("any") & has_file & ~F.col("legend").eqNullSafe(F.col("legend_hash")) & ~F.col("legend").eqNullSafe(F.col("legend_failed_hash")), act("legend")),
        (F.col("obsolete") & has_file, act("delete")),
        (F.col("any") & ~(F.col("board").eqNullSafe(F.col("verify_sig")) & F.coalesce(F.col("verify_status").isin("done", "failed"), F.lit(False))), act("verify")),
        ((F.col("verify_status") == "done") & F.col("to_look").isNotNull(), act("screenshot", F.col("to_look"))),
    ]
    chosen = F.coalesce(*[F.when(when, then) for when, then in rules], act("done"))
    tool = F.create_map(*[F.lit(v) for kv in TOOLS.items() for v in kv])
    until = F.coalesce("backoff_until", F.lit(0.0)) if "backoff_until" in runs.columns else F.lit(0.0)
    x = x.select("run", "now", "stop_reason", until.alias("until"), chosen.alias("a")).select("run", "now", "stop_reason", "until", "a.*")
    x = x.withColumn("tool", tool[F.col("purpose")])
    x = x.withColumn("need", F.when(F.col("purpose") == "generate", GENERATE_NEEDS).when(F.col("tool").isNotNull() & ~F.col("tool").isin(EXEMPT), 1).otherwise(0))
    x = x.withColumn("need", F.least("need", F.lit(per_minute)))
    return _gated(x, calls, per_minute, per_day, max_wait)


def _gated(x: DataFrame, calls: DataFrame | None, per_minute: int, per_day: int, max_wait: float) -> DataFrame:
    """Actions with the decision of the budget: the day's room, then the wait until the oldest calls in the way have left the minute."""
    if calls is None:
        x = x.withColumns({"day": F.lit(0).cast("long"), "minute": F.array().cast("array<double>")})
    else:
        c = calls.join(x.select("run", "now"), "run").where("ts <= now and ts > now - 86400")
        c = c.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("ts"))))  # no more of a minute's calls matter than its limit
        c = c.groupBy("run").agg(F.count(F.lit(1)).alias("day"), F.sort_array(F.collect_list(F.when((F.col("k") <= per_minute) & (F.col("ts") > F.col("now") - 60), F.col("ts")))).alias("minute"))
        x = x.join(c, "run", "left").withColumns({"day": F.coalesce("day", F.lit(0)), "minute": F.coalesce("minute", F.array().cast("array<double>"))})
    counted = F.col("need") > 0
    excess = F.size("minute") + F.col("need") - per_minute
    room = F.when(excess <= 0, 0.0).otherwise(F.greatest(F.get("minute", excess - 1) + 60 - F.col("now"), F.lit(0.0)) + 0.01)
    backoff = F.greatest(F.col("until") - F.col("now"), F.lit(0.0))
    x = x.withColumn("wait", F.when(counted, F.round(F.greatest(room, backoff), 2)).otherwise(0.0))
    full = counted & (F.col("day") + F.col("need") > per_day)
    late = F.col("wait") > max_wait
    decision = F.when((F.col("purpose") == "stop") | full | late, "stop").when(F.col("purpose").startswith("ask") | (F.col("purpose") == "confirm"), "ask").otherwise("act")
    reason = F.when(F.col("purpose") == "stop", F.col("stop_reason")).when(full, "budget").when(late, F.when(backoff > 0, "rate_limit").otherwise("budget"))
    return x.select("run", "purpose", "view", "tool", decision.alias("decision"), reason.alias("reason"), F.when(decision == "act", F.col("wait")).otherwise(0.0).alias("wait"))


# ---- nested states -------------------------------------------------------------------------------------------

#: The version that is understood, phases of a run, fields by path with their kind and default.
VERSION = 1
STEPS = ["scan", "analysis", "merge", "plan", "publish"]
FIELDS = {
    "run_id": ("string", None), "revision": ("string", None), "confirmed": ("boolean", False), "action_seq": ("int", 0), "hooks_inactive": ("boolean", False), "uncertain": ("string", None), "plan_sig": ("string", None),
    "figma.file_key": ("string", None), "figma.file_url": ("string", None), "figma.legend_section_id": ("string", None), "figma.legend_hash": ("string", None), "figma.ignore_ids": ("array<string>", []),
    **{f"phases.{p}.status": ("string", "pending") for p in STEPS}, **{f"phases.{p}.at": ("string", None) for p in STEPS},
}
VIEW_FIELDS = {"title": ("string", None), "status": ("string", "pending"), "content_hash": ("string", None), "attempts": ("int", 0), "place_attempts": ("int", 0), "priority": ("int", 0), "section_id": ("string", None), "errors": ("array<variant>", [])}


def _field(doc: Column, path: str, kind: str, default) -> Column:
    """A field of a document; the default only where the document lacks it: a null that it says stays."""
    there = F.try_variant_get(doc, f"$.{path}", "variant")
    value = F.try_variant_get(doc, f"$.{path}", kind)
    fallback = F.array().cast(kind) if default == [] else F.lit(default).cast(kind)
    return F.when(there.isNull(), fallback).otherwise(value)


def _wide(doc: Column, fields: dict) -> list[Column]:
    return [_field(doc, path, kind, default).alias(path.replace(".", "_")) for path, (kind, default) in fields.items()]


def states(rows: DataFrame, key: str = "run", text: str = "state") -> tuple[DataFrame, DataFrame]:
    """(states, views) of JSON documents of any version of the form: typed columns by FIELDS, and one row (key, id, ...) a view by VIEW_FIELDS.

    Fields that an older document lacks have their defaults, those that a newer one has besides stay in doc. known: whether
    the document can be read and its version is the one that is understood; others have all fields null, and no views.
    """
    x = rows.select(key, F.try_parse_json(text).alias("doc"))
    known = F.coalesce(F.try_variant_get("doc", "$.schema_version", "int") == VERSION, F.lit(False))
    x = x.withColumn("known", known)
    own = F.when(F.col("known"), F.col("doc"))
    wide = x.select(key, "known", "doc", *[F.when(F.col("known"), c).alias(n.replace(".", "_")) for c, n in zip(_wide(own, FIELDS), FIELDS, strict=True)])
    held = x.where("known").select(key, F.try_variant_get("doc", "$.diagrams", "map<string, variant>").alias("m"))
    views = held.select(key, F.explode("m").alias("id", "view"))
    return wide, views.select(key, "id", *_wide(F.col("view"), VIEW_FIELDS))


def carried_states(old: DataFrame, new: DataFrame, key: str = "run") -> DataFrame:
    """new states with the board of the old ones of the same key (of any version, as states reads them): keys, addresses and marks stay with a run that begins anew."""
    kept = [c for c in new.columns if c.startswith("figma_")]
    x = new.join(old.where("known").select(key, *[F.col(c).alias(f"__{c}") for c in kept], F.col("revision").alias("previous_revision"), F.lit(True).alias("__old")), key, "left")
    return x.select(*[(F.when(F.col("__old"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c)) for c in new.columns], "previous_revision")
