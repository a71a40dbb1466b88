"""History fetched while live messages come in: order, retries, cursors, stored logs."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from engramlake.streaming import backfill

COLUMNS = ["conversation_id", "kind", "message_key", "ts", "role", "order"]
EVENTS = "conversation_id string, kind string, message_key string, ts long, role string, order long"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rows(events, conversation="c", start=0):
    """(kind, key, ts) in the order of their arrival."""
    return [(conversation, e[0], e[1] if len(e) > 1 else None, e[2] if len(e) > 2 else None, "user", start + i) for i, e in enumerate(events)]


def run(spark, events, **how):
    got = backfill.backfilled(spark.createDataFrame(rows(events), EVENTS), **how).collect()
    return [(r.kind, r.message_key, r.seq) for r in got]


def test_history_comes_before_what_waited(spark):
    got = run(spark, [("open",), ("live", "c", 3), ("history", "b", 2), ("history", "a", 1), ("history", "c", 3), ("live", "d", 4), ("live", "c", 3), ("fetched",), ("live", "a", 1), ("live", "e", 5)])
    assert got == [("fetch", None, None), ("message", "a", 1), ("message", "b", 2), ("message", "c", 3), ("message", "d", 4), ("message", "e", 5)]


def test_a_failed_fetch_keeps_what_waits_and_is_asked_for_again(spark):
    got = run(spark, [("open",), ("live", "x", 9), ("history", "lost", 1), ("failed",), ("live", "y", 10), ("live", "z", 11), ("history", "a", 2), ("fetched",), ("fetched",), ("history", "late", 3)])
    assert got == [("fetch", None, None), ("fetch", None, None), ("message", "a", 1), ("message", "x", 2), ("message", "y", 3), ("message", "z", 4)]


def test_cursors_are_resolved_after_the_fetch(spark):
    got = run(spark, [("open",), ("cursor", "first"), ("live", "x", 9), ("cursor", "second"), ("live", "y", 10), ("history", "a", 1), ("history", "b", 2), ("fetched",), ("cursor", "third"), ("live", "z", 11), ("cursor", "fourth")])
    assert [(k, s) for kind, k, s in got if kind == "cursor"] == [("first", 2), ("second", 3), ("third", 4), ("fourth", 5)]


def test_a_cursor_never_lies_before_what_is_held(spark):
    got = run(spark, [("open",), ("cursor", "n"), *[("live", f"l{i}", 10 + i) for i in range(5)], ("history", "a", 1), ("fetched",)], capacity=2)
    assert [(k, s) for kind, k, s in got if kind == "cursor"] == [("n", 4)]  # the numbers 5 and 6 are held


def test_clearing_forgets_what_waits_and_older_history(spark):
    got = run(spark, [("open",), ("live", "x", 5), ("cursor", "n"), ("clear", None, 6), ("live", "y", 7), ("history", "a", 4), ("history", "b", 8), ("fetched",)])
    assert got == [("fetch", None, None), ("message", "b", 1), ("message", "y", 2), ("cursor", "n", 1)]


def test_without_opening_a_log_is_ready_and_evicted_keys_come_again(spark):
    got = run(spark, [("cursor", "n"), ("live", "a", None), ("live", "b", 2), ("live", "c", 3), ("live", "a", 1), ("live", "c", 3), ("open",)], capacity=2)
    assert got == [("cursor", "n", 0), ("message", "a", 1), ("message", "b", 2), ("message", "c", 3), ("message", "a", 4)]


def test_no_events(spark):
    assert run(spark, []) == []


def test_timers_need_a_stream(spark):
    with pytest.raises(ValueError):
        run(spark, [("open",)], retry_ms=1)


def put(folder, batches):
    folder.mkdir()
    for n, part in enumerate(batches):
        pd.DataFrame(part, columns=COLUMNS).astype({"ts": "Int64"}).to_parquet(folder / f"{n}.parquet")
    return folder


def stream(spark, tmp_path, folder, name, until=None, **how):
    """until: a stream with timers never runs out of batches; it is stopped once this holds."""
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = backfill.backfilled(source, **how).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name))
    if until is None:
        assert out.trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)
    running, late = out.start(), time.monotonic() + 90
    while time.monotonic() < late and running.isActive and not until(spark.table(name)):
        time.sleep(0.5)
    running.stop()
    return spark.table(name)


def test_micro_batches_give_the_rows_of_the_table(spark, tmp_path):
    events = [*rows([("open",), ("live", "x", 9), ("cursor", "n"), ("history", "lost", 1), ("failed",), ("live", "y", 10), ("history", "a", 1), ("history", "x", 9), ("live", "x", 9), ("fetched",), ("live", "z", 11), ("live", "a", 1), ("cursor", "m")])]
    events += rows([("live", "q", 1), ("open",), ("live", "r", 2)], "d", 100)
    whole = backfill.backfilled(spark.createDataFrame(events, EVENTS), capacity=2).collect()
    cut = sorted(events, key=lambda e: (e[5] % 100, e[0]))
    folder = put(tmp_path / "in", [cut[i : i + 4] for i in range(0, len(cut), 4)])
    got = stream(spark, tmp_path, folder, "cut", capacity=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole)) and len(got) > 8


def test_a_stream_starts_from_a_stored_log_and_retries_by_timer(spark, tmp_path):
    stored = spark.createDataFrame([("c", f"k{i}", i + 1) for i in range(4)], "conversation_id string, message_key string, seq long")
    folder = put(tmp_path / "in", [rows([("open",), ("live", "k3", 3), ("live", "k0", 0)]) + rows([("open",), ("failed",)], "d"), rows([("live", "new", 9), ("cursor", "n")], start=9)])
    got = stream(spark, tmp_path, folder, "stored", lambda t: t.where("kind = 'fetch'").count() == 2 and t.where("kind = 'cursor'").count() == 1, stored=stored, capacity=3, retry_ms=0)
    assert [(r.kind, r.message_key, r.seq) for r in got.where("conversation_id = 'c'").orderBy("seq", F.col("kind").desc()).collect()] == [("message", "k0", 5), ("message", "new", 6), ("cursor", "n", 6)]
    assert [r.kind for r in got.where("conversation_id = 'd'").collect()] == ["fetch", "fetch"]
