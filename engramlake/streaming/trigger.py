"""Count-triggered extraction as a keyed stream.

A conversation's backlog is what came after its cursor.  Once it reaches the
window and no run is under way, a run is asked for.  "done" moves the cursor to
the run's end, "failed" leaves it for another try; after FAILURE_LIMIT failures in
a row the run is skipped and the cursor moves on.  The state is a few numbers.

A skipped run leaves one failed job (:func:`failed_jobs`), whose id follows from the
messages it covers.  :func:`recorder` writes the jobs of a micro-batch to a place of that
batch's own, so a batch that Spark repeats writes the same place again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engramlake.functions import text
from engramlake.schema import FAILURE_LIMIT

COLUMNS = ["conversation_id", "from_seq", "up_to", "messages", "action", "error"]
OUTPUT = "conversation_id string, from_seq long, up_to long, messages long, action string, error string"
JOB = "job_id string, conversation_id string, kind string, status string, from_seq long, up_to long, messages long, input string, error string"


class Extraction(StatefulProcessor):
    """Input: conversation_id, kind ("message", "done", "failed"), seq, error (of a failure), order (arrival)."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last_seq long, waiting long, running_to long, running long, failures int, cursor long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last, waiting, to, running, failures, cursor = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, 0)
        out = []
        batch = pd.concat(list(rows)).sort_values("order", kind="stable")
        for kind, seq, error in zip(batch["kind"], batch["seq"], batch["error"]):
            if kind == "message":
                last, waiting = int(seq), waiting + 1
            elif running:
                failures = failures + 1 if kind == "failed" else 0
                if kind == "failed" and failures < FAILURE_LIMIT:
                    waiting += running  # to be tried again with what has come since
                elif kind == "failed":
                    out.append((key[0], cursor + 1, to, running, "skip", error))
                    failures = 0
                if not failures:
                    cursor = to
                running = 0
            if not running and waiting >= self.window:
                to, running, waiting = last, waiting, 0
                out.append((key[0], cursor + 1, to, running, "run", None))
        self.state.update((last, waiting, to, running, failures, cursor))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def runs(events: DataFrame, window: int) -> DataFrame:
    """(conversation_id, from_seq, up_to, messages, action, error): runs and skips of a stream, or of a table.  Events may come without an error column."""
    if "error" not in events.columns:
        events = events.withColumn("error", F.lit(None).cast("string"))
    events.sparkSession.streams.active  # starts the coordinator that state needs, also for a table
    return events.groupBy("conversation_id").transformWithStateInPandas(Extraction(window), OUTPUT, "Append" if events.isStreaming else "Update", "None")


def failed_jobs(decided: DataFrame, log: DataFrame) -> DataFrame:
    """The failed job of each skipped run, with the run's messages as its input, a line each in their order.

    log (conversation_id, seq, content).  A run is a few windows long, so its messages fit in a row.
    """
    # a row a number, so that a conversation's runs meet its messages by key and not each run all of them
    skipped = decided.where("action = 'skip'").select("conversation_id", "from_seq", "up_to", "messages", "error", F.explode(F.sequence("from_seq", "up_to")).alias("seq"))
    lines = log.select("conversation_id", F.col("seq").cast("long").alias("seq"), F.coalesce("content", F.lit("")).alias("content"))
    held = skipped.join(lines, ["conversation_id", "seq"], "left")
    rows = held.groupBy("conversation_id", "from_seq", "up_to", "messages", "error").agg(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("seq", "content")))).alias("said"))
    return rows.select(
        text.derived_id("conversation_id", F.col("from_seq").cast("string"), F.col("up_to").cast("string")).alias("job_id"), "conversation_id", F.lit("extract").alias("kind"), F.lit("failed").alias("status"),
        "from_seq", "up_to", "messages", F.array_join(F.transform("said", lambda x: x["content"]), "\n").alias("input"), F.coalesce("error", F.lit("")).alias("error"),
    )


def recorder(folder: str, log: DataFrame) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls to write the failed jobs of a stream of runs; batches without one write nothing."""

    def write(decided: DataFrame, number: int) -> None:
        skips = decided.where("action = 'skip'").persist()  # the state must not be advanced twice
        if not skips.isEmpty():
            failed_jobs(skips, log).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        skips.unpersist()

    return write


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """The failed jobs written so far, each once, also where a stream was begun anew."""
    return spark.read.schema(JOB).parquet(folder).dropDuplicates(["job_id"])
