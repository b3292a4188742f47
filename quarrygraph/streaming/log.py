"""Streams over an append-only event log: idempotent intake, rolling admission and streaks, with state per key.

Spark has no range window on streams, so rolling counts keep the times of the window as state; it is bounded by the
events that one key has within a window, and a key's state goes when its window has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(log: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows of a stream without repeats of the keys within the watermark; rows with a null key all stay."""
    known = " and ".join(f"{k} is not null" for k in keys)
    first = log.where(known).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return first.unionByName(log.where(f"not ({known})").withWatermark(at, late))


def rolling_admission(log: DataFrame, key: str, at: str, event: str, window_s: int, limit: int, late: str = "1 day") -> DataFrame:
    """(key, event, at, used, admitted): events of the key in (t - window, t], and whether they are within the limit.

    A batch's rows are taken in the order of time, then id; a row older than rows of earlier batches counts those of its own window.
    """
    kind = dict(log.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).sort_values(["us", event])
        every = sorted([*times, *new.us.tolist()])
        s = pd.Series(every)
        used = s.searchsorted(new.us.to_numpy(), "right") - s.searchsorted(new.us.to_numpy() - window_s * 1_000_000, "right")
        state.update(([t for t in every if t > every[-1] - window_s * 1_000_000],))
        state.setTimeoutTimestamp(max(every[-1] // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], event: new[event].to_numpy(), "us": new.us.to_numpy(), "used": used, "admitted": used <= limit})

    x = log.withWatermark(at, late).select(key, event, at, F.unix_micros(at).alias("us"))
    return x.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {event} {kind[event]}, us long, used long, admitted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def streaks(log: DataFrame, key: str, at: str, event: str, failed: str, base: int = 30, cap: int = 900) -> DataFrame:
    """(key, event, streak, backoff): failures in a row up to each event of a key, and the seconds to wait then; rows come in order within a key."""
    kind = dict(log.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        new, out = pd.concat(list(batches)).sort_values(["us", event]), []
        for e, bad in zip(new[event], new.failed, strict=True):
            n = n + 1 if bad else 0
            out.append((k[0], e, n, float(min(cap, base * 2 ** min(n - 1, 30))) if n else 0.0))
        state.update((n,))
        yield pd.DataFrame(out, columns=[key, event, "streak", "backoff"])

    x = log.select(key, event, F.unix_micros(at).alias("us"), F.expr(failed).alias("failed"))
    return x.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {event} {kind[event]}, streak long, backoff double", "n long", "append", GroupStateTimeout.NoTimeout)
