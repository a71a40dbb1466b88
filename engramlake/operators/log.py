"""Message logs: reads, history, segments, extraction chunks, throttling.

A segment ends with the last message of an assistant run.  All of it is windows
over (conversation, seq); only packing and throttling depend on their own earlier
decisions and fold over a conversation's segments or messages as they pass in
order, whatever a conversation's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from engramlake.functions import text

KEY = "conversation_id"


def _by(*order):
    return Window.partitionBy(KEY).orderBy(*(order or ("seq",)))


def message_key(message_id, user_id, timestamp, content) -> Column:
    known = text.or_null(message_id)
    fallback = F.concat(F.lit("k:"), F.col(user_id), F.lit(":"), F.coalesce(F.col(timestamp).cast("string"), F.lit("")), F.lit(":"), F.col(content))
    return F.when(known.isNotNull(), F.concat(F.lit("id:"), known)).otherwise(fallback)


def last_n(log: DataFrame, n: int) -> DataFrame:
    return log.withColumn("_n", F.row_number().over(_by(F.col("seq").desc()))).where(F.col("_n") <= n).drop("_n")


def after_seq(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") > seq)


def tail_seq(log: DataFrame) -> DataFrame:
    return log.groupBy(KEY).agg(F.max("seq").alias("tail_seq"))


def after_epoch(log: DataFrame, cleared_at: Column, arrival: Column) -> DataFrame:
    """Messages after the clearing; those without a time count from their arrival."""
    return log.where(cleared_at.isNull() | (F.coalesce(F.col("timestamp"), arrival) > cleared_at))


def backfill(live: DataFrame, history: DataFrame) -> DataFrame:
    """History without what is live, oldest first, then the live messages, with new sequence numbers."""
    rows = live.select(KEY, "message_key", F.lit(1).alias("part"), "ts").unionByName(history.join(live.select(KEY, "message_key"), [KEY, "message_key"], "left_anti").where("ts is not null").select(KEY, "message_key", F.lit(0).alias("part"), "ts"))
    return rows.withColumn("seq", F.row_number().over(_by("part", "ts", "message_key")))


def recall_history(log: DataFrame, current: DataFrame, n: int) -> DataFrame:
    """The n messages before the last one that is the current message, or the last n.

    current: one row a conversation (message_id, user_id, timestamp, content).
    Equal by id where both have one, else by author, time and content.
    """
    c = current.select(KEY, *[F.col(x).alias(f"_{x}") for x in ("message_id", "user_id", "timestamp", "content")])
    has = lambda x: F.coalesce(F.length(x) > 0, F.lit(False))
    same = F.when(has("message_id") & has("_message_id"), F.col("message_id") == F.col("_message_id")).otherwise(
        F.col("user_id").eqNullSafe(F.col("_user_id")) & F.col("timestamp").eqNullSafe(F.col("_timestamp")) & F.col("content").eqNullSafe(F.col("_content")))
    at = log.join(c, KEY).where(same).groupBy(KEY).agg(F.max("seq").alias("_at"))
    return last_n(log.join(at, KEY, "left").where("_at is null or seq < _at").drop("_at"), n)


def segments(log: DataFrame) -> DataFrame:
    """log with segment (from 0) and open (the last segment, if no assistant run closed it)."""
    w = _by()
    closes = (F.col("role") == "assistant") & (F.coalesce(F.lead("role").over(w), F.lit("")) != "assistant")
    rows = log.withColumn("_closes", closes.cast("int"))
    rows = rows.withColumn("segment", F.coalesce(F.sum("_closes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("open", F.max("_closes").over(Window.partitionBy(KEY, "segment")) == 0).drop("_closes")


def exchange_lengths(segmented: DataFrame) -> DataFrame:
    """(conversation_id, segment, length, exchange): messages, and those from the last user message on (all of them without one)."""
    return segmented.groupBy(KEY, "segment").agg(
        F.count(F.lit(1)).alias("length"),
        F.coalesce(F.max("seq") - F.max(F.when(F.col("role") != "assistant", F.col("seq"))) + 1, F.count(F.lit(1))).alias("exchange"),
        F.max("open").alias("open"),
    )


def anchored_units(segmented: DataFrame, window: int) -> DataFrame:
    """(conversation_id, segment, length, keep): closed segments and the messages kept of their ends.

    The newest exchange and a window of messages before it are kept whole; older
    segments keep their exchange.
    """
    s = exchange_lengths(segmented.where("not open"))
    back = _by(F.col("segment").desc())
    later = F.coalesce(F.sum("length").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.first("exchange").over(back) + window
    covered = F.greatest(F.lit(0), F.least(budget - later, F.col("length")))
    return s.withColumn("keep", F.least(F.col("length"), F.greatest(covered, F.col("exchange"))).cast("long")).select(KEY, "segment", "length", "keep")


def _folded(rows: DataFrame, order: list[Column], values: list[str], start, step, out: str) -> DataFrame:
    """rows with what step(state, *values) -> (state, value) gives for each, in the order of its conversation; a conversation begins at start.

    Rows come sorted and are folded as they pass, so a long conversation takes a batch of memory and time in proportion.
    """
    kind = T.StructType([*rows.schema.fields, *T._parse_datatype_string(out).fields])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), start
        for x in batches:
            found = []
            for own, *v in zip(x.column(KEY).to_pylist(), *(x.column(c).to_pylist() for c in values)):
                if own != key:
                    key, state = own, start
                state, value = step(state, *v)
                found.append(value)
            columns = [c.cast(f.type) for c, f in zip(x.columns, arrow)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow.field(len(columns)).type)], schema=arrow)

    return rows.repartition(KEY).sortWithinPartitions(KEY, *order).mapInArrow(run, kind)


def pack(units: DataFrame, window: int) -> DataFrame:
    """units(conversation_id, unit, size) with chunk, from the newest (0): units join backwards while they fit, whole ones up to a window and a half."""
    limit = window + window // 2

    def step(state, size):
        chunk, held = state
        if chunk >= 0 and held is not None and size is not None and held + size <= limit:
            return (chunk, held + size), chunk
        return (chunk + 1, size), chunk + 1

    return _folded(units.select(KEY, "unit", F.col("size").cast("bigint").alias("size")), [F.col("unit").desc(), F.col("size").desc()], ["size"], (-1, 0), step, "chunk int").select(KEY, "unit", F.col("size").cast(units.schema["size"].dataType).alias("size"), "chunk")


def split_overheard(log: DataFrame, window: int) -> DataFrame:
    """(conversation_id, seq, role, segment, part): segments over a window and a half are cut after the last assistant message that fits, else at the limit.

    A segment's assistant messages are its last ones: if any fits, the one at the limit is of them, so both cuts are at the limit.
    """
    place = F.row_number().over(Window.partitionBy(KEY, "segment").orderBy("seq")) - 1
    rows = segments(log).select(KEY, "seq", "role", F.col("segment").cast("long").alias("segment"))
    return rows.withColumn("part", F.floor(place / (window + window // 2)).cast("int"))


def plan_chunks(log: DataFrame, window: int, overheard: bool = False) -> DataFrame:
    """(conversation_id, seq, chunk): messages to extract, chunks counted from the newest."""
    if window <= 0:
        return log.select(KEY, "seq", F.lit(0).alias("chunk")).where(F.lit(False))
    if overheard:
        rows = split_overheard(log, window).withColumn("unit", F.struct("segment", "part"))
    else:
        s = segments(log).where("not open")
        kept = s.join(anchored_units(segments(log), window), [KEY, "segment"])
        place = F.row_number().over(Window.partitionBy(KEY, "segment").orderBy(F.col("seq").desc()))
        rows = kept.withColumn("_n", place).where("_n <= keep").withColumn("unit", F.struct(F.col("segment").cast("long").alias("segment"), F.lit(0).alias("part")))
    sizes = rows.groupBy(KEY, "unit").agg(F.count(F.lit(1)).alias("size"))
    return rows.select(KEY, "seq", "unit").join(pack(sizes, window).select(KEY, "unit", "chunk"), [KEY, "unit"]).select(KEY, "seq", "chunk")


def throttle(log: DataFrame, interval: int, failed: DataFrame | None = None) -> DataFrame:
    """(conversation_id, seq, runs): whether a recall at each user message runs, at least interval messages after the last that did.

    failed (conversation_id, seq): recalls that failed; the next message runs, as if there had been none before.
    """
    asks = log.where("role = 'user'").select(KEY, "seq")
    asks = asks.withColumn("bad", F.lit(False)) if failed is None else asks.join(failed.select(KEY, "seq", F.lit(True).alias("bad")).distinct(), [KEY, "seq"], "left").fillna(False, ["bad"])

    def step(anchor, seq, bad):
        runs = anchor is None or (None if seq is None else seq - anchor >= interval)
        return (None if bad else seq) if runs else anchor, runs

    return _folded(asks, [F.col("seq"), F.col("bad")], ["seq", "bad"], None, step, "runs boolean").select(KEY, "seq", "runs")


def bot_run(log: DataFrame, focus: DataFrame) -> DataFrame:
    """The last unbroken assistant run after the focus message (conversation_id, focus_seq; none: from the start)."""
    rows = log.join(focus, KEY, "left").where("focus_seq is null or seq > focus_seq")
    last = rows.where("role = 'assistant'").groupBy(KEY).agg(F.max("seq").alias("_end"))
    rows = rows.join(last, KEY).where("seq <= _end")
    breaks = rows.groupBy(KEY).agg(F.coalesce(F.max(F.when(F.col("role") != "assistant", F.col("seq"))), F.lit(-1)).alias("_from"))
    return rows.join(breaks, KEY).where("seq > _from").drop("_end", "_from", "focus_seq")


def ingest(events: DataFrame, self_id: str) -> DataFrame:
    """Session events to log rows: own messages, commands and empty texts drop out; the name falls back to the id."""
    kept = events.where(text.or_null("user_id").isNotNull() & (text.trim("user_id") != self_id) & ~F.col("is_command") & (text.trim("content") != ""))
    return kept.withColumns({"user_id": text.trim("user_id"), "content": text.trim("content"), "name": F.coalesce(text.or_null("name"), text.trim("user_id")), "message_id": text.or_null("message_id")}).drop("is_command")


def transcript(log: DataFrame, platform: str, assistant: str) -> DataFrame:
    """(conversation_id, seq, role, speaker_key, speaker_label, lines, time_ms): rows with a time and a text."""
    rows = log.withColumns({
        "speaker_key": F.when(F.col("role") != "assistant", text.speaker_key(F.lit(platform), "user_id")),
        "speaker_label": F.when(F.col("role") == "assistant", assistant).otherwise(text.trim("name")), "lines": text.content_lines("content"),
    })
    ok = text.transcript_reason("timestamp", "speaker_label", F.col("lines")).isNull()
    return rows.where(ok).select(KEY, "seq", "role", "speaker_key", "speaker_label", "lines", F.col("timestamp").alias("time_ms"))


def allowed(is_direct, user_id, guild_id, users: list[str], guilds: list[str]) -> Column:
    """The whitelist: by user in private, by group elsewhere."""
    return F.when(F.col(is_direct), F.col(user_id).isin(users)).otherwise(F.col(guild_id).isin(guilds))


def origin_label(is_direct, label, user_id, guild_name, guild_id) -> Column:
    c = F.col
    private = F.concat(F.lit("来源于与"), c(label), F.lit("（用户 ID："), c(user_id), F.lit("）的私聊"))
    group = F.concat(F.lit("来源于「"), c(guild_name), F.lit("」（群聊 ID："), c(guild_id), F.lit("）的群聊"))
    return F.when(c(is_direct), private).otherwise(group)
