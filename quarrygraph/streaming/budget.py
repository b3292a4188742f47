"""Budgets, rolling counts and retention as streams with transformWithState: lists of times as state, timers in event time that clear it.

The state of a key is what its window holds, and a key that is idle for longer has none: a timer goes off once the
watermark has passed the end of its window. State is kept by RocksDB (spark.sql.streaming.stateStore.providerClass).
Rows behind the watermark are dropped; rows late by less are counted among those that are known by then.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Microseconds that are slept beyond a wait.
SLACK = 50_000


def _rocks(df: DataFrame) -> None:
    held = df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if not held.endswith("RocksDBStateStoreProvider"):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Timed(StatefulProcessor):
    """One timer a key, in milliseconds of event time: the latest that was asked for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, ms: int) -> None:
        for old in list(self.handle.listTimers()):
            if old != ms:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)

    @staticmethod
    def ordered(rows: Iterator[pd.DataFrame], by: list[str], timerValues) -> pd.DataFrame:
        """A batch's rows in order, without those behind the watermark: Spark itself lets some pass for one batch more."""
        new = pd.concat(list(rows)).sort_values(by)
        return new[new.us >= timerValues.getCurrentWatermarkInMs() * 1000]


class _Counts(_Timed):
    def __init__(self, key: str, event: str, window: int):
        self.key, self.event, self.window = key, event, window

    def init(self, handle):
        super().init(handle)
        self.times = handle.getListState("times", "us long")

    def handleInputRows(self, key, rows, timerValues):
        new, times = self.ordered(rows, ["us", self.event], timerValues), sorted(int(t) for (t,) in self.times.get())
        if not len(new):
            return
        used = []
        for t in new.us.tolist():
            insort(times, t)
            used.append(bisect_right(times, t) - bisect_right(times, t - self.window))
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 - self.window  # what a late row may still count
        self.times.put([(t,) for t in times if t > oldest])
        self.wake((times[-1] + self.window) // 1000 + 1)
        yield pd.DataFrame({self.key: key[0], self.event: new[self.event].to_numpy(), "us": new.us.to_numpy(), "used": used})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.times.clear()
        return iter(())


def rolling_counts(log: DataFrame, key: str, at: str, event: str, window_s: int, late: str = "1 day") -> DataFrame:
    """(key, event, us, used) of a stream: the key's events in (t - window, t] that are known when the event comes, itself included; rows of one batch in order of time."""
    _rocks(log)
    kind = dict(log.dtypes)
    x = log.withWatermark(at, late).select(key, event, at, F.unix_micros(at).alias("us"))
    return x.groupBy(key).transformWithStateInPandas(_Counts(key, event, window_s * 1_000_000), f"{key} {kind[key]}, {event} {kind[event]}, us long, used long", "Append", "EventTime")


class _Admission(_Timed):
    def __init__(self, key: str, event: str, minute: tuple[int, int], day: tuple[int, int], most_sleep: int, base: int, cap: int):
        self.key, self.event, self.minute, self.day, self.most_sleep, self.base, self.cap = key, event, minute, day, most_sleep, base, cap

    def init(self, handle):
        super().init(handle)
        self.times = handle.getListState("times", "us long")
        self.seen = handle.getMapState("seen", "use string", "us long")
        self.failing = handle.getValueState("failing", "streak long, until long")

    def decide(self, at: int, times: list[int], until: int) -> tuple[str, int, int]:
        """(decision, microseconds slept, calls of the day)."""
        now, slept = at, 0
        held = lambda w: times[bisect_right(times, now - w[0]) : bisect_right(times, now)]
        while True:
            today = len(held(self.day))
            if today >= self.day[1]:
                return "deny: day", slept, today
            wait, recent = max(0, until - now), held(self.minute)
            excess = len(recent) + 1 - self.minute[1]
            if excess > 0:
                wait = max(wait, recent[excess - 1] + self.minute[0] - now)
            if wait <= 0:
                return "allow", slept, today
            if slept + wait > self.most_sleep:
                return ("deny: backoff" if until > now else "deny: minute"), slept, today
            now, slept = now + wait + SLACK, slept + wait + SLACK

    def handleInputRows(self, key, rows, timerValues):
        new, times = self.ordered(rows, ["us", self.event], timerValues), sorted(int(t) for (t,) in self.times.get())
        if not len(new):
            return
        streak, until = self.failing.get() if self.failing.exists() else (0, 0)
        out = []
        for e, us, kind, use in zip(new[self.event], new.us.tolist(), new.kind, new.use, strict=True):
            if kind == "limited":
                streak += 1
                until = us + min(self.cap, self.base * 2 ** min(streak - 1, 30))
            elif kind == "ok":
                streak, until = 0, 0
            elif kind == "request":
                if use is not None and self.seen.containsKey((use,)):
                    out.append((key[0], e, us, "known", 0, 0))
                    continue
                decision, slept, today = self.decide(us, times, until)
                if decision == "allow":
                    insort(times, us + slept)
                    if use is not None:
                        self.seen.updateValue((use,), (us + slept,))
                out.append((key[0], e, us, decision, slept, today))
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 - self.day[0]
        times = [t for t in times if t > oldest]
        for (use,), (us,) in list(self.seen.iterator()):
            if us <= oldest:
                self.seen.removeKey((use,))
        if times:
            self.times.put([(t,) for t in times])
        else:
            self.times.clear()
        self.failing.update((streak, until))
        last = max([int(new.us.max()), until, *times[-1:]])
        self.wake((last + self.day[0]) // 1000 + 1)
        yield pd.DataFrame(out, columns=[self.key, self.event, "us", "decision", "slept", "today"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.times.clear()
        self.seen.clear()
        self.failing.clear()
        return iter(())


def admissions(log: DataFrame, key: str, at: str, event: str, per_minute: int = 8, per_day: int = 160, most_sleep_s: float = 60, base_s: int = 30, cap_s: int = 900, late: str = "1 day") -> DataFrame:
    """(key, event, us, decision, slept, today) of the requests in a stream with columns kind (request, limited, ok) and use (a request's own id or null).

    A request is allowed if the day and the last 60 s have room and no backoff runs; else it sleeps until there may be
    room and asks again, and is denied where that would take longer than it may sleep, or the day is used up. An allowed
    request counts from when it has slept. A use that was allowed is known and counts once. Each limited outcome doubles
    the backoff from base to cap, an ok ends it. Rows of one batch are taken in order of time, then event.
    """
    _rocks(log)
    kind, s = dict(log.dtypes), 1_000_000
    x = log.withWatermark(at, late).select(key, event, at, "kind", F.col("use").cast("string").alias("use"), F.unix_micros(at).alias("us"))
    made = _Admission(key, event, (60 * s, per_minute), (86_400 * s, per_day), int(most_sleep_s * s), base_s * s, cap_s * s)
    return x.groupBy(key).transformWithStateInPandas(made, f"{key} {kind[key]}, {event} {kind[event]}, us long, decision string, slept long, today long", "Append", "EventTime")


class _Retention(_Timed):
    def __init__(self, key: str, event: str, keep: int):
        self.key, self.event, self.keep = key, event, keep

    def init(self, handle):
        super().init(handle)
        self.held = handle.getListState("held", f"us long, {self.event} string")

    def handleInputRows(self, key, rows, timerValues):
        new = self.ordered(rows, ["us", self.event], timerValues)
        if not len(new):
            return iter(())
        self.held.appendList([(int(u), str(e)) for u, e in zip(new.us, new[self.event], strict=True)])
        self.wake((min(int(u) for u, _ in self.held.get()) + self.keep) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep
        held = [(int(u), e) for u, e in self.held.get()]
        gone, rest = sorted(x for x in held if x[0] <= end), [x for x in held if x[0] > end]
        self.held.clear()
        if rest:
            self.held.put(rest)
            self.wake((min(rest)[0] + self.keep) // 1000 + 1)
        yield pd.DataFrame({self.key: [key[0]] * len(gone), self.event: [e for _, e in gone], "us": [u for u, _ in gone]})


def expired(log: DataFrame, key: str, at: str, event: str, keep_s: int = 172_800, late: str = "1 hour") -> DataFrame:
    """(key, event, us) of rows as they grow older than keep_s behind the watermark, each once: what a sink may delete. State holds the rows that are kept, and none of a key whose rows are all gone; event comes as a string."""
    _rocks(log)
    kind = dict(log.dtypes)
    x = log.withWatermark(at, late).select(key, event, at, F.unix_micros(at).alias("us"))
    return x.groupBy(key).transformWithStateInPandas(_Retention(key, event, keep_s * 1_000_000), f"{key} {kind[key]}, {event} string, us long", "Append", "EventTime")
