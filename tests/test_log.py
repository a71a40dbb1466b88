"""Segments, chunk plans, the bounded log and its stream."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from engramlake.operators import log
from engramlake.streaming import log_stream


def chat(spark, roles, conv="c"):
    return spark.createDataFrame([(conv, i + 1, "assistant" if r == "a" else "user") for i, r in enumerate(roles)], "conversation_id string, seq long, role string")


def chunks(spark, roles, window, overheard):
    rows = log.plan_chunks(chat(spark, roles), window, overheard).orderBy("seq").collect()
    out = {}
    for r in rows:
        out.setdefault(r.chunk, []).append(r.seq)
    return [out[k] for k in sorted(out, reverse=True)]


def test_segments_close_after_the_last_assistant_message(spark):
    rows = log.segments(chat(spark, "uuaauau")).orderBy("seq").collect()
    assert [r.segment for r in rows] == [0, 0, 0, 0, 1, 1, 2] and [r.open for r in rows][-1]


@pytest.mark.parametrize(("roles", "window", "overheard", "want"), [
    ("", 3, False, []), ("uuu", 3, False, []), ("ua", 0, False, []),
    ("uaua", 4, False, [[1, 2, 3, 4]]),
    ("uuuuuua", 2, False, [[4, 5, 6, 7]]),  # the exchange and a window before it
    ("uaaa", 2, False, [[1, 2, 3, 4]]),
    ("uuuuuuau", 2, False, [[4, 5, 6, 7]]),  # the open end waits
    ("uuuuuuau", 4, True, [[1, 2, 3, 4, 5, 6], [7, 8]]),
    ("uuuuuuu", 2, True, [[1, 2, 3], [4, 5, 6], [7]]),
])
def test_plans(spark, roles, window, overheard, want):
    got = chunks(spark, roles, window, overheard)
    assert got == want


def test_long_conversations_are_cut_and_packed_without_groups_of_their_own(spark):
    """Every part of 6 and every chunk, over more messages than a batch holds and beside a conversation without a name."""
    roles = "uuuuuuua" * 2500 + "uaaaaaaaaaaaaa" * 10 + "u"
    rows = chat(spark, roles).unionByName(chat(spark, "ua", None))
    plan = rows.transform(lambda x: log.split_overheard(x, 4))
    assert "InPandas" not in plan._jdf.queryExecution().toString()
    parts = [r.part for r in plan.where("conversation_id = 'c'").orderBy("seq").collect()]
    assert parts[:8] == [0] * 6 + [1] * 2 and parts[20000:20014] == [0] * 6 + [1] * 6 + [2] * 2 and len(parts) == len(roles)
    sizes = ([6, 2] * 2500 + [6, 6, 2] * 10 + [1])[::-1]
    want, held, chunk = [], 0, -1
    for n in sizes:
        held, chunk = (held + n, chunk) if chunk >= 0 and held + n <= 6 else (n, chunk + 1)
        want.append(chunk)
    units = spark.createDataFrame([(k, -i, n) for k in ("c", "d") for i, n in enumerate(sizes)], "conversation_id string, unit long, size long").repartition(7)
    packed = log.pack(units, 4)
    assert "aggregate(" not in packed._jdf.queryExecution().toString()  # a fold that copies its list at each unit
    for k in ("c", "d"):
        assert [r.chunk for r in packed.where(F.col("conversation_id") == k).orderBy(F.col("unit").desc()).collect()] == want
    assert log.throttle(rows.where("conversation_id = 'c'"), 10).where("runs").count() > 1900


def test_throttle(spark):
    rows = log.throttle(chat(spark, "uuuauuuau"), 3).orderBy("seq").collect()
    assert [(r.seq, r.runs) for r in rows] == [(1, True), (2, False), (3, False), (5, True), (6, False), (7, False), (9, True)]


def test_history_before_the_last_occurrence(spark):
    rows = chat(spark, "uuuuuu").withColumns({"message_id": F.when(F.col("seq") % 2 == 0, "same"), "user_id": F.lit("u"), "timestamp": F.col("seq"), "content": F.lit("x")})
    cur = spark.createDataFrame([("c", "same", "u", 4, "x")], "conversation_id string, message_id string, user_id string, timestamp long, content string")
    assert sorted(r.seq for r in log.recall_history(rows, cur, 3).collect()) == [3, 4, 5]
    assert sorted(r.seq for r in log.recall_history(rows, cur.withColumn("message_id", F.lit("no")).withColumn("timestamp", F.lit(99).cast("long")), 2).collect()) == [5, 6]


def feed(spark, keys, role="user"):
    return spark.createDataFrame([("c", k, i, r if r else role, i) for i, (k, r) in enumerate(keys)], "conversation_id string, message_key string, ts long, role string, order long")


def test_bounded_log_in_one_append(spark):
    got = log_stream.numbered(feed(spark, [("a", None), ("b", None), ("a", None), ("c", None)]), capacity=2).orderBy("seq").collect()
    assert [(r.message_key, r.seq) for r in got] == [("a", 1), ("b", 2), ("c", 3)]


def test_clear_drops_older_messages(spark):
    rows = spark.createDataFrame([("c", "a", 1, "user", 0), ("c", "", 5, "clear", 1), ("c", "a", 3, "user", 2), ("c", "a", 6, "user", 3)], "conversation_id string, message_key string, ts long, role string, order long")
    assert [(r.ts, r.seq) for r in log_stream.numbered(rows).orderBy("seq").collect()] == [(1, 1), (6, 2)]


def test_stream_equals_table_and_readmits_evicted_keys(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, names = tmp_path / "in", "conversation_id string, message_key string, ts long, role string, order long"
    src.mkdir()
    batches = [["a", "b"], ["b", "c"], ["a"], ["d", "d"]]
    for n, keys in enumerate(batches):
        pd.DataFrame([("c", k, 10 * n + i, "user", 10 * n + i) for i, k in enumerate(keys)], columns=["conversation_id", "message_key", "ts", "role", "order"]).to_parquet(src / f"{n}.parquet")
    stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = log_stream.numbered(stream, capacity=2).writeStream.format("memory").queryName("log").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select message_key, seq from log order by seq").collect()
    # c pushed a out, so a comes in again
    assert [(r.message_key, r.seq) for r in got] == [("a", 1), ("b", 2), ("c", 3), ("a", 4), ("d", 5)]


def test_extraction_retries_then_skips(spark):
    from engramlake.streaming import trigger

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = ["message"] * 3 + ["failed", "failed", "message", "failed", "message", "message", "done"]
    rows, seq = [], 0
    for n, k in enumerate(kinds):
        seq += k == "message"
        rows.append(("c", k, seq, n))
    got = trigger.runs(spark.createDataFrame(rows, "conversation_id string, kind string, seq long, order int"), 3).collect()
    assert [(r.up_to, r.messages, r.action) for r in got] == [(3, 3, "run"), (3, 3, "run"), (3, 3, "run"), (3, 3, "skip"), (6, 3, "run")]


def outcomes(kinds, conversation="c"):
    rows, seq = [], 0
    for n, k in enumerate(kinds):
        seq += k == "message"
        rows.append((conversation, k, seq, f"boom {n}" if k == "failed" else None, n))
    return rows


def test_a_skipped_run_leaves_one_failed_job_and_moves_the_cursor(spark):
    from engramlake.streaming import trigger

    events = spark.createDataFrame(outcomes(["message"] * 2 + ["failed"] * 3 + ["message"] * 2 + ["failed", "done"]), "conversation_id string, kind string, seq long, error string, order int")
    decided = trigger.runs(events, 2)
    said = spark.createDataFrame([("c", i, f"m{i}" if i != 2 else None) for i in range(1, 5)] + [("d", 1, "other")], "conversation_id string, seq long, content string")
    assert [(r.from_seq, r.up_to, r.action, r.error) for r in decided.collect()] == [(1, 2, "run", None)] * 3 + [(1, 2, "skip", "boom 4"), (3, 4, "run", None), (3, 4, "run", None)]
    job = trigger.failed_jobs(decided, said).collect()
    assert [(j.conversation_id, j.kind, j.status, j.from_seq, j.up_to, j.messages, j.input, j.error) for j in job] == [("c", "extract", "failed", 1, 2, 2, "m1\n", "boom 4")]
    assert trigger.failed_jobs(decided, said.limit(0)).first()["input"] == "" and trigger.failed_jobs(decided.where("action = 'run'"), said).count() == 0


def test_a_batch_that_is_repeated_records_its_job_once(spark, tmp_path):
    from engramlake.streaming import trigger

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    said = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b")], "conversation_id string, seq long, content string")
    names, src, jobs = "conversation_id string, kind string, seq long, error string, order int", tmp_path / "in", str(tmp_path / "jobs")
    src.mkdir()
    rows = outcomes(["message", "failed", "failed", "failed", "message"])
    for n in range(0, len(rows), 2):
        pd.DataFrame(rows[n : n + 2], columns=["conversation_id", "kind", "seq", "error", "order"]).astype({"order": "int32", "error": "string"}).to_parquet(src / f"{n}.parquet")
    write, failed = trigger.recorder(jobs, said), []

    def unsteady(batch, number):
        write(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after writing")

    def go():
        stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = trigger.runs(stream, 1).writeStream.foreachBatch(unsteady).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        return q.awaitTermination(120)

    with pytest.raises(Exception, match="lost after writing"):
        go()
    assert go()
    assert [(j.from_seq, j.up_to, j.input, j.error) for j in trigger.recorded(spark, jobs).collect()] == [(1, 1, "a", "boom 3")]
