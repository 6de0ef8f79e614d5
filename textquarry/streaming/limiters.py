"""Keyed state over time: token buckets, sliding windows, several scopes, blocks, TTL entries.

Each rule is a small state machine, `start()` and `step(state, t) -> (state, allowed, remaining, retry_after)`, that runs
on a batch (`replay`) and on a stream (`streamed`). In a batch, keys are spread over tasks and each task streams its rows
sorted by key and time, with the state of one key in memory, so a key may have any number of rows.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class TokenBucket:
    """capacity tokens at first, refill_rate tokens a second; a request takes `cost`."""

    capacity: float
    refill_rate: float
    cost: float = 1.0

    def start(self):
        return None

    def step(self, state, t):
        level = float(self.capacity) if state is None else min(float(self.capacity), state[0] + (t - state[1]) * self.refill_rate)
        allowed = level >= self.cost
        level -= self.cost if allowed else 0.0
        wait = 0 if level >= self.cost else int((self.cost - level) / self.refill_rate) + 1
        return [level, t], allowed, int(round(level)), 0 if allowed else wait


@dataclass(frozen=True)
class SlidingWindow:
    """At most `most` accepted requests in any window of `seconds`; those rejected aren't recorded."""

    most: int
    seconds: float

    def start(self):
        return []

    def step(self, state, t):
        kept = [x for x in state if x > t - self.seconds]
        if len(kept) >= self.most:
            return kept, False, 0, int(kept[0] - (t - self.seconds) + 1) if kept else 0
        return [*kept, t], True, self.most - len(kept) - 1, 0


@dataclass(frozen=True)
class Scopes:
    """Several rules: the first that refuses decides, and those before it have been charged."""

    rules: tuple

    def start(self):
        return [r.start() for r in self.rules]

    def step(self, state, t):
        state, least = list(state), None
        for i, rule in enumerate(self.rules):
            state[i], allowed, remaining, wait = rule.step(state[i], t)
            if not allowed:
                return state, False, remaining, wait
            least = remaining if least is None else min(least, remaining)
        return state, True, least or 0, 0


@dataclass(frozen=True)
class Blocking:
    """A rule whose refusals block the key for a time, during which nothing is charged."""

    rule: object
    seconds: float = 300.0

    def start(self):
        return [self.rule.start(), -math.inf]

    def step(self, state, t):
        inner, until = state
        if t < until:
            return state, False, 0, int(until - t)
        inner, allowed, remaining, wait = self.rule.step(inner, t)
        return [inner, until if allowed else t + self.seconds], allowed, remaining, wait if allowed else int(self.seconds)


@dataclass(frozen=True)
class TtlEntry:
    """A cache entry: a read is allowed (a hit) until the entry expires; a miss stores it again. Hits don't renew it."""

    seconds: float

    def start(self):
        return None

    def step(self, state, t):
        if state is not None and state >= t:
            return state, True, int(state - t), 0
        return t + self.seconds, False, 0, 0


@dataclass(frozen=True)
class ItemCache:
    """A cache of at most max_items entries of `seconds`: a read is allowed (a hit) while its entry lives. A miss stores it, after those
    that have expired went, or else the one that expires first. For `replay` with an item column.
    """

    seconds: float
    max_items: int = 256

    def start(self):
        return {}

    def step(self, state, t, item):
        until = state.get(item)
        if until is not None and until >= t:
            return state, True, len(state), 0
        state = {k: u for k, u in state.items() if u >= t and k != item}
        if len(state) >= self.max_items:
            del state[min(state, key=lambda k: (state[k], str(k)))]
        return state | {item: t + self.seconds}, False, len(state) + 1, 0


#: Named limits, requests and seconds; limits by address.
NAMED = {"search": (60, 60), "api": (100, 60), "ingest": (10, 3600)}
BY_ADDRESS = ((60, 60), (1000, 3600), (10000, 86400))


def address_limits() -> Scopes:
    return Scopes(tuple(SlidingWindow(n, s) for n, s in BY_ADDRESS))


def replay(events: DataFrame, key: str, time: str, event_id: str, rule, item: str | None = None) -> DataFrame:
    """(event_id, key, allowed, remaining, retry_after) of each event in time order, ties by id. item: a column that the rule is told too."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(batches):
        at, state = None, None
        for batch in batches:
            out = []
            more = [(x,) for x in batch.column(item).to_pylist()] if item else [()] * batch.num_rows
            for k, t, rest in zip(batch.column(key).to_pylist(), batch.column(time).to_pylist(), more, strict=True):
                if at is None or k != at[0]:
                    at, state = (k,), rule.start()
                state, allowed, remaining, wait = rule.step(state, t, *rest)
                out.append((allowed, remaining, wait))
            yield pa.RecordBatch.from_arrays([batch.column(event_id), batch.column(key), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.int64())))], names=[event_id, key, "allowed", "remaining", "retry_after"])

    ordered = events.select(event_id, key, time, *([item] if item else [])).repartition(key).sortWithinPartitions(key, time, event_id)
    return ordered.mapInArrow(run, f"`{event_id}` {kinds[event_id]}, `{key}` {kinds[key]}, allowed boolean, remaining long, retry_after long")


def streamed(events: DataFrame, key: str, time: str, rule, idle: str = "1 day") -> DataFrame:
    """The same rule on a stream of events: (key, time, allowed, retry_after); the state of an idle key is dropped."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def update(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else rule.start()
        rows = []
        for t in sorted(t for frame in frames for t in frame[time]):
            held, allowed, _, wait = rule.step(held, t)
            rows.append((k[0], t, allowed, wait))
        state.update((json.dumps(held),))
        state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(rows, columns=[key, time, "allowed", "retry_after"])

    return events.select(key, time).groupBy(key).applyInPandasWithState(update, f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, allowed boolean, retry_after long", "held string", "append", "ProcessingTimeTimeout")


class _InOrder(StatefulProcessor):
    """One key: requests wait until the watermark has passed them, then take the rule in the order of their times, ties by id.

    What came in one batch waits as one packed entry, and one timer, for the first of those that wait, takes all that are due at once.
    """

    def __init__(self, rule, idle_ms: int):
        self.rule, self.idle_ms = rule, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "requests binary")
        self.held = handle.getValueState("held", "state binary, ms long")
        self.upto, self.done = None, set()  # keys whose requests up to the watermark have been taken: their other timers find nothing

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = np.concatenate([frame[["ms", "id"]].to_numpy(np.int64) for frame in rows])
        self.done.discard(key[0])
        self.waiting.appendValue((came.tobytes(),))
        self.handle.registerTimer(int(came[:, 0].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if upto != self.upto:
            self.upto, self.done = upto, set()
        if key[0] in self.done:
            return
        held = self.held.get()
        entries = [np.frombuffer(x, np.int64).reshape(-1, 2) for (x,) in self.waiting.get()]
        waiting = np.concatenate([np.zeros((0, 2), np.int64), *entries])
        due, rest = waiting[waiting[:, 0] <= upto], waiting[waiting[:, 0] > upto]
        if len(due):
            due = due[np.lexsort((due[:, 1], due[:, 0]))]
            state = pickle.loads(held[0]) if held else self.rule.start()
            out = []
            for ms in (due[:, 0] / 1000).tolist():
                state, *answer = self.rule.step(state, ms)
                out.append(answer)
            last = int(due[-1, 0])
            if last + self.idle_ms > upto:
                self.held.update((pickle.dumps(state), last))
                self.handle.registerTimer(last + self.idle_ms)
            else:
                self.held.clear()
            self.waiting.clear()
            if len(rest):
                self.waiting.appendValue((rest.tobytes(),))
                self.handle.registerTimer(int(rest[:, 0].min()))
            yield pd.DataFrame({"key": key[0], "id": due[:, 1], "ms": due[:, 0], **dict(zip(("allowed", "remaining", "retry_after"), zip(*out, strict=True), strict=True))})
        elif held and held[1] + self.idle_ms <= upto:  # nothing came for so long: the key starts anew
            self.held.clear()
        self.done.add(key[0])

    def close(self) -> None:
        pass


#: What the state of a stream with timers is kept in.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_event_time(events: DataFrame, key: str, time: str, event_id: str, rule, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """(key, id, ms, allowed, remaining, retry_after) of a stream of requests, the same rows as `replay` gives whatever the order and the batches they come in.

    A request waits in the key's state until the watermark (the latest time less `late`) has passed it; later ones than that are dropped by Spark. A key's timer
    lets those due take the rule in order; after `idle` without a request the key's state goes (a rule forgets by then, if idle is its longest span at least).
    key: text, event_id: an integer, time: a timestamp, taken to the millisecond. The session needs the state store of `STATE_STORE`.
    """
    ms = (F.unix_micros(time) / 1000).cast("long")
    rows = events.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("id"), ms.alias("ms"), F.col(time).alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(
        _InOrder(rule, int(pd.Timedelta(idle).total_seconds() * 1000)), "key string, id long, ms long, allowed boolean, remaining long, retry_after long", "append", "EventTime"
    )


def with_limits(clients: DataFrame, custom: DataFrame, default: int) -> DataFrame:
    """Each client's own limit, or the default."""
    return clients.join(custom, "client_id", "left").withColumn("max_requests", F.coalesce("max_requests", F.lit(default)))
