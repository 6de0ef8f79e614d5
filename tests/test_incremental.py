"""Streams and stores that take each thing once: upserts with a ledger, reindexed partitions, limiters in event time, known keys."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textquarry import store
from textquarry.operators import keystore
from textquarry.operators.keystore import KeyStore
from textquarry.streaming import limiters, upserts
from textquarry.streaming.upserts import RunningTable

LOG = "user string, n long, total double, last long"
MERGES = {"n": "sum", "total": "sum", "last": "max"}


def log_rows(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, "hot", "hot", *"abcdefgh"]), 1, float(rng.randint(0, 9)), i) for i in range(n)]


def truth_of(rows):
    out = {}
    for user, n, total, last in rows:
        a = out.setdefault(user, [0, 0.0, -1])
        out[user] = [a[0] + n, a[1] + total, max(a[2], last)]
    return {k: tuple(v) for k, v in out.items()}


def table_of(t):
    return {r["user"]: tuple(r)[1:] for r in t.table().select("user", "n", "total", "last").collect()}


def test_a_batch_sent_twice_counts_once(spark):
    rows = log_rows(120)
    batches = [spark.createDataFrame(rows[i : i + 40], LOG) for i in (0, 40, 80)]
    t = RunningTable(spark, store.folder(spark), ["user"], MERGES, LOG, buckets=4)
    assert t.table().collect() == []
    assert [t.apply(b, i) for i, b in enumerate(batches)] == [True, True, True]
    assert not t.apply(batches[2], 2) and not t.apply(batches[0], 0)
    assert table_of(t) == truth_of(rows)
    assert t.apply(batches[0], 0, source="another stream")
    assert table_of(t) == truth_of([*rows, *rows[:40]])


def test_a_batch_lost_midway_is_written_anew(spark, monkeypatch):
    rows = log_rows(60)
    t = RunningTable(spark, store.folder(spark), ["user"], MERGES, LOG, buckets=4)
    t.apply(spark.createDataFrame(rows[:30], LOG), 0)
    whole = store.write_state
    monkeypatch.setattr(store, "write_state", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.apply(spark.createDataFrame(rows[30:], LOG), 1)
    assert table_of(t) == truth_of(rows[:30])
    monkeypatch.setattr(store, "write_state", whole)
    assert t.apply(spark.createDataFrame(rows[30:], LOG), 1) and table_of(t) == truth_of(rows)


def test_untouched_buckets_keep_their_files(spark):
    t = RunningTable(spark, store.folder(spark), ["user"], MERGES, LOG, buckets=8)
    t.apply(spark.createDataFrame(log_rows(200), LOG), 0)
    before = t._state()["buckets"]
    t.apply(spark.createDataFrame([("a", 1, 1.0, 999)], LOG), 1)
    after = t._state()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()


def test_a_stream_into_the_table_restarts(spark, tmp_path):
    rows = log_rows(90)
    t = RunningTable(spark, store.folder(spark), ["user"], MERGES, LOG, buckets=4)
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        t.sink(stream, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert table_of(t) == truth_of(rows)


def files(path):
    return {p: set(x for x in os.listdir(f"{path}/{p}") if x.endswith(".parquet")) for p in os.listdir(path) if p.startswith("source=")}


def test_only_touched_partitions_are_reindexed(spark, tmp_path):
    ddl = "doc_id long, source string, text string, version int, gone boolean"
    index = lambda df: df.withColumn("n", F.size(F.split("text", " "))).drop("text")
    runs = [
        [(1, "a", "one two", 1, False), (2, "b", "three", 1, False), (3, "c", "four five six", 1, False), (4, None, "x", 1, False)],
        [(2, "b", "three more words", 2, False), (5, "b", "new", 1, False), (5, "b", "new er", 2, False), (3, "c", "", 2, True)],
        [(2, "b", "older", 1, False)],
    ]
    seen = []
    for rows in runs:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        upserts.reindexer(stream, f"{tmp_path}/index", f"{tmp_path}/checkpoint", "source", "doc_id", "version", index).trigger(availableNow=True).start().awaitTermination()
        seen.append(files(f"{tmp_path}/index"))
    got = {r["doc_id"]: (r["source"], r["n"], r["version"]) for r in spark.read.parquet(f"{tmp_path}/index").where("NOT gone").collect()}
    assert got == {1: ("a", 2, 1), 2: ("b", 3, 2), 5: ("b", 2, 2), 4: (None, 1, 1)}
    assert seen[0]["source=a"] == seen[2]["source=a"] and seen[0]["source=b"] != seen[1]["source=b"] and seen[1]["source=c"] == seen[2]["source=c"]


def events_of(n, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "a", "b"]), 1_700_000_000 + rng.randint(0, 900)) for i in range(n)]


@pytest.mark.parametrize("rule", [limiters.SlidingWindow(5, 30), limiters.TokenBucket(4, 0.1), limiters.Blocking(limiters.SlidingWindow(3, 20), 60)])
def test_limiters_in_event_time_are_those_of_a_batch(spark, tmp_path, rule):
    rows = events_of(240)
    df = spark.createDataFrame(rows, "id long, who string, s long")
    truth = {r["id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in limiters.replay(df.withColumn("t", F.col("s").cast("double")), "who", "t", "id", rule).collect()}
    shuffled = random.Random(4).sample(rows, len(rows))
    timed = lambda part: spark.createDataFrame(part, "id long, who string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    for i in range(4):
        timed(shuffled[60 * i : 60 * i + 60]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    timed([(-1, "end", 1_700_100_000)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set(*limiters.STATE_STORE)
    try:
        stream = spark.readStream.schema("id long, who string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = limiters.in_event_time(stream, "who", "at", "id", rule, late="1 hour")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(limiters.STATE_STORE[0])
    assert {r["id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == truth


def test_requests_of_a_key_that_come_due_together_are_taken_at_once():
    class State:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def appendValue(self, row):  # noqa: N802
            self.rows.append(row)

        def clear(self):
            self.rows = []

    class Held(State):
        def get(self):
            return self.rows[0] if self.rows else None

        def update(self, row):
            self.rows = [row]

    class Handle:
        def __init__(self):
            self.timers, self.waiting, self.held = set(), State(), Held()

        def getListState(self, *_):  # noqa: N802
            return self.waiting

        def getValueState(self, *_):  # noqa: N802
            return self.held

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    handle, processor = Handle(), limiters._InOrder(limiters.SlidingWindow(2, 10), 60_000)
    processor.init(handle)
    for lo in (500, 0):
        frame = pd.DataFrame({"id": range(lo, lo + 500), "ms": range(1000 * lo, 1000 * (lo + 500), 1000)})
        list(processor.handleInputRows(("k",), iter([frame]), None))
    assert handle.timers == {0, 500_000}
    out = [list(processor.handleExpiredTimer(("k",), At(699_000), At(t))) for t in (0, 500_000)]
    assert [len(x) for x in out] == [1, 0] and handle.waiting.calls == 1
    assert out[0][0]["ms"].tolist() == list(range(0, 700_000, 1000)) and out[0][0]["allowed"].sum() == 140
    assert 700_000 in handle.timers and 759_000 in handle.timers
    rest = list(processor.handleExpiredTimer(("k",), At(10_000_000), At(700_000)))
    assert len(rest[0]) == 300 and not handle.held.rows and not handle.waiting.rows


def test_bloom_filters():
    rng = np.random.RandomState(1)
    h = rng.randint(-(1 << 62), 1 << 62, 5_000)
    f = keystore.bloom(h)
    assert keystore.passes(h, [f]).all() and len(f) * 8 <= 10 * len(h) + 64
    assert keystore.passes(rng.randint(-(1 << 62), 1 << 62, 20_000), [f]).mean() < 0.02
    assert not keystore.passes(h, []).any() and keystore.passes(h[:3], [keystore.bloom(h[3:]), keystore.bloom(h[:3])]).all()


def test_known_keys(spark, monkeypatch):
    monkeypatch.setattr(keystore, "BLOCK", 10)
    keys = lambda *r: spark.createDataFrame([(None if i is None else f"key{i}",) for x in r for i in x], "key string")
    s = KeyStore(spark, store.folder(spark))
    assert s.append(keys(range(300), range(10), [None]))["keys"] == 0
    report = s.append(keys(range(295, 330)))
    assert report["keys"] == 300 and 5 <= report["keys_read"] < 150 and report["buckets_read"] < report["buckets"]
    again = KeyStore(spark, s.folder)
    assert sorted(r["key"] for r in again.keys().collect()) == sorted(f"key{i}" for i in range(330))
    fresh, report = again.unknown(keys([5, 400, 401, 401]))
    assert sorted(r["key"] for r in fresh.collect()) == ["key400", "key401"] and report["buckets_read"] <= 3
    assert again.unknown(keys([]))[0].collect() == []
