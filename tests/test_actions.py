"""Next actions of runs, rule by rule, and states of several versions."""

from __future__ import annotations

import json

from quarrygraph.operators import actions

RUN = "run string, now double, confirmed boolean, auto boolean, visual boolean, file_key string, revision string, plan_key string, plan_checked boolean, plan_choices int, uncertain string, pending_kind string, pending_purpose string, pending_view string, stop_reason string, legend_hash string, legend_failed_hash string, verify_sig string, verify_status string, backoff_until double"
VIEW = "run string, id string, priority int, status string, attempts int, section string, type string, title string, categories array<string>, check string, looked boolean, delete_failed boolean"


def run(name, **more):
    base = dict(run=name, now=1000.0, confirmed=True, auto=False, visual=False, file_key="f", revision="r", plan_key="p", plan_checked=False, plan_choices=0, uncertain=None, pending_kind=None, pending_purpose=None, pending_view=None, stop_reason=None, legend_hash=None, legend_failed_hash=None, verify_sig=None, verify_status=None, backoff_until=None)
    return tuple((base | more).values())


def view(name, id_, status, priority=1, **more):
    base = dict(run=name, id=id_, priority=priority, status=status, attempts=0, section=None, type="flow", title="T", categories=["app"], check=None, looked=None, delete_failed=None)
    return tuple((base | more).values())


def test_next_actions(spark):
    runs = [run("stopped", stop_reason="auth"), run("again", stop_reason="budget"), run("asked", pending_kind="ask_user", pending_purpose="ask_plan"), run("lost", pending_kind="generate_diagram", pending_purpose="generate", pending_view="x"), run("lost2", uncertain="y", file_key=None), run("safe", pending_kind="use_figma", pending_purpose="place", pending_view="x"), run("new", confirmed=False), run("auto", confirmed=False, auto=True), run("key", plan_key=None), run("keys", plan_key=None, plan_choices=2), run("checked", plan_key=None, plan_checked=True), run("tired"), run("shown"), run("gone"), run("empty"), run("busy"), run("soon"), run("full"), run("back", backoff_until=1030.0), run("far", backoff_until=1500.0), run("nofile", file_key=None)]
    views = [view(r, "b", "pending") for r in ("again", "lost", "lost2", "new", "auto", "key", "keys", "checked", "busy", "soon", "full", "back", "far")]
    views += [view("auto", "a", "stale"), view("auto", "c", "pending", 0), view("safe", "z", "generated"), view("safe", "y", "generated", 2), view("safe", "a", "pending", 0), view("tired", "a", "pending", attempts=2), view("tired", "b", "failed"), view("shown", "a", "placed", section="s1"), view("gone", "a", "obsolete", section="s1"), view("gone", "b", "obsolete", section="s2", delete_failed=True), view("nofile", "a", "verified", section="s")]
    calls = [("busy", 1000.0 - i) for i in range(7)] + [("soon", 945.0)] * 7 + [("full", 500.0 + i) for i in range(159)] + [("busy", 2000.0), ("soon", 1000.0 - 90_000)]
    got = {r.run: (r.purpose, r.view, r.decision, r.reason, r.wait) for r in actions.next_actions(spark.createDataFrame(runs, RUN), spark.createDataFrame(views, VIEW), spark.createDataFrame(calls, "run string, ts double"), max_wait=20.0).collect()}
    assert got == {
        "stopped": ("stop", None, "stop", "auth", 0.0),
        "again": ("generate", "b", "act", None, 0.0),
        "asked": ("ask_plan", None, "ask", None, 0.0),
        "lost": ("reconcile_generate", "x", "act", None, 0.0),
        "lost2": ("ask_file_url", "y", "ask", None, 0.0),
        "safe": ("place", "z", "act", None, 0.0),
        "new": ("confirm", None, "ask", None, 0.0),
        "auto": ("generate", "c", "act", None, 0.0),
        "key": ("whoami", None, "act", None, 0.0),
        "keys": ("ask_plan", None, "ask", None, 0.0),
        "checked": ("generate", "b", "act", None, 0.0),
        "tired": ("done", None, "act", None, 0.0),
        "shown": ("legend", None, "act", None, 0.0),
        "gone": ("delete", None, "act", None, 0.0),
        "empty": ("done", None, "act", None, 0.0),
        "busy": ("generate", "b", "stop", "budget", 0.0),  # seven of a minute and two more: 54 seconds
        "soon": ("generate", "b", "act", None, 5.01),
        "full": ("generate", "b", "stop", "budget", 0.0),
        "back": ("generate", "b", "stop", "rate_limit", 0.0),
        "far": ("generate", "b", "stop", "rate_limit", 0.0),
        "nofile": ("verify", None, "act", None, 0.0),
    }


def test_a_board_goes_on_to_done(spark):
    """Legend, verification and looks follow one another as their signatures are recorded."""
    views = spark.createDataFrame([view("r", "a", "placed", section="s1", check="mismatch"), view("r", "b", "verified", section="s2", check="ok")], VIEW)
    facts = actions.facts(spark.createDataFrame([run("r")], RUN), views).first()
    step = lambda **more: actions.next_actions(spark.createDataFrame([run("r", **more)], RUN), views).first()
    assert step(legend_failed_hash=facts.legend).purpose == "verify"
    assert step(legend_hash=facts.legend, verify_sig="old", verify_status="done").purpose == "verify"
    look = step(legend_hash=facts.legend, verify_sig=facts.board, verify_status="done")
    assert (look.purpose, look.view, look.tool) == ("screenshot", "a", "get_screenshot")
    assert step(legend_hash=facts.legend, verify_sig=facts.board, verify_status="failed").purpose == "done"


def test_states(spark):
    old = {"schema_version": 1, "run_id": "r1", "revision": "abc", "figma": {"file_key": "k"}, "diagrams": {"a": {"title": "A"}, "b": {"status": "placed", "attempts": 1, "section_id": "s"}}}
    new = {"schema_version": 1, "run_id": "r2", "confirmed": True, "figma": {"file_key": None, "ignore_ids": ["x"]}, "phases": {"scan": {"status": "done", "at": "t"}, "merge": {"status": None}}, "diagrams": {}, "more": {"deep": [1]}}
    rows = [("old", json.dumps(old)), ("new", json.dumps(new)), ("two", '{"schema_version": 2}'), ("torn", '{"schema'), ("null", None)]
    states, views = actions.states(spark.createDataFrame(rows, "run string, state string"))
    got = {r.run: r for r in states.drop("doc").collect()}
    assert [k for k, r in got.items() if r.known] == ["old", "new"]
    assert (got["old"].figma_file_key, got["old"].figma_ignore_ids, got["old"].phases_publish_status, got["old"].action_seq, got["old"].confirmed) == ("k", [], "pending", 0, False)
    assert (got["new"].figma_ignore_ids, got["new"].phases_scan_status, got["new"].phases_merge_status, got["new"].phases_plan_status, got["new"].confirmed) == (["x"], "done", None, "pending", True)
    assert got["two"].action_seq is None and got["torn"].run_id is None
    assert {(r.run, r.id, r.title, r.status, r.attempts, r.place_attempts) for r in views.drop("errors").collect()} == {("old", "a", "A", "pending", 0, 0), ("old", "b", None, "placed", 1, 0)}
    fresh = states.where("run = 'new'").selectExpr("'old' as run", *[c for c in states.columns if c != "run"])
    kept = actions.carried_states(states, fresh).first()
    assert (kept.figma_file_key, kept.figma_ignore_ids, kept.previous_revision, kept.run_id) == ("k", [], "abc", "r2")
