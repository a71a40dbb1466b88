"""Readers, and the views that the example tables stand in for.

Each view exists twice: as DataFrame expressions here and, for checking, as SQL
text in VIEW_SQL.
"""

from __future__ import annotations

import uuid
from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.functions import text
from engramlake.operators import index, log
from engramlake.schema import MAX_KEYWORDS
from engramlake.sources.kept import shared_dir


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An exported document, one JSON object a line; damaged lines come with their text in _corrupt."""
    schema = "version int, exported_at string, source_preset_id string, id string, type string, status string, content string, keywords array<string>, _corrupt string"
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


class Views:
    """The store's tables, derived from the example tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        rows = read(self.spark, self.folder, name)
        # times without a zone are UTC, as the session is
        return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})

    #: What was written of a folder's views, by application, folder and the state of the files they come from.
    _written: ClassVar[dict[tuple, str]] = {}

    def once(self, name: str, df: DataFrame, *sources: str) -> DataFrame:
        """df as a table of the shared folder, written once a run for the same source files."""
        state = []
        for source in sources:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{source}.parquet")
            found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p)
            state.append((source, found.getLen(), found.getModificationTime()))
        key = (self.spark.sparkContext.applicationId, self.folder, name, *state)
        if key not in Views._written:
            path = f"{shared_dir(self.spark)}/views-{uuid.uuid4().hex}/{name}"
            df.write.option("compression", "zstd").parquet(path)
            Views._written[key] = path
        return self.spark.read.schema(df.schema).parquet(Views._written[key])

    @cached_property
    def mem(self) -> DataFrame:
        """A memory a document; the vectors take turns."""
        return self.once("mem", self.rows, "documents", "embeddings")

    @cached_property
    def rows(self) -> DataFrame:
        """mem without being written: what a query takes of it is read, and no text for columns that come from numbers.  Keywords would be worked out at each look."""
        e, d = self.table("embeddings"), self.table("documents").select("doc_id", "text")
        i = F.col("doc_id")
        kind = F.element_at(F.array(*map(F.lit, ("identity", "preference", "fact", "plan", "context", "other"))), (i % 6 + 1).cast("int"))
        count = F.broadcast(e.agg((F.max("vec_id") + 1).alias("_vectors")))  # one row
        rows = d.crossJoin(count).join(e, F.col("vec_id") == i % F.col("_vectors"))
        # the shortest words of the whole text stand for its keywords; only those that may be among them are sorted.  Trimmed and distinct, at most one of them is empty
        few = lambda c: F.slice(F.sort_array(c), 1, MAX_KEYWORDS + 1)
        once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  (a column in a lambda would be computed for every word)
        trimmed = F.array_distinct(F.transform(F.array_distinct(F.split("text", " ")), text.trim))
        short = once(trimmed, lambda every: once(F.element_at(few(F.transform(every, F.length)), -1), lambda most: F.filter(every, lambda w: F.length(w) <= most)))
        words = F.transform(few(F.transform(short, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), lambda x: x["w"])
        return rows.select(
            i.alias("memory_id"), F.concat(F.lit("preset-"), (i % 4).cast("string")).alias("preset_id"),
            F.when(i % 5 != 0, F.concat(F.lit("conv-"), (i % 20).cast("string"))).alias("source_conversation_id"),
            F.when(i % 7 == 0, "archived").otherwise("active").alias("status"), kind.alias("type"),
            F.when(i % 11 != 0, (i % 10).cast("double") / F.lit(10.0)).alias("importance"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), i.cast("int"))).alias("updated_at"),
            (F.lit("2023-12-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (i % 97).cast("int"))).alias("created_at"),
            F.col("text").alias("content"), F.when(i % 3 != 0, F.element_at(F.split("text", "\n"), -1)).alias("summary"), F.when(i % 4 != 0, "calm").otherwise("glad").alias("sentiment"),
            F.when(i % 3 != 1, F.concat(F.lit("label-"), (i % 2).cast("string"))).alias("source_label"),
            text.speaker_keys(F.array(F.concat(F.lit("u"), (i % 15).cast("string")), F.concat(F.lit("u"), (i % 23).cast("string")))).alias("speaker_keys"),
            text.keywords(words).alias("keywords"), "embedding",
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """What the graph and the groups take of mem, written without its texts."""
        return self.once("vectors", self.rows.select("memory_id", "preset_id", "status", "embedding"), "documents", "embeddings")

    @cached_property
    def mem_kw(self) -> DataFrame:
        return self.once("mem_kw", index.keyword_rows(self.rows), "documents", "embeddings")

    @cached_property
    def mem_speaker(self) -> DataFrame:
        return index.speaker_rows(self.rows)

    @cached_property
    def qvec(self) -> DataFrame:
        return self.table("embeddings").where("vec_id in (0, 1, 2)").select(F.col("vec_id").alias("text_no"), F.col("embedding").alias("vector"))

    @cached_property
    def msglog(self) -> DataFrame:
        e = self.table("events")
        seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return e.select(
            F.concat(F.lit("c"), (F.col("user_id") % 50).cast("string")).alias("room"), F.col("user_id").cast("string").alias("conversation_id"), seq.cast("long").alias("seq"),
            F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("message_id"), F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string")).alias("user_id"),
            F.when(F.col("event_id") % 5 != 0, F.concat(F.lit(" name"), (F.col("event_id") % 7).cast("string"))).alias("name"),
            F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))).alias("content"), F.unix_millis("ts").alias("timestamp"),
            F.when(F.col("event_type").isin("click", "purchase"), "assistant").otherwise("user").alias("role"),
        )

    @cached_property
    def chat(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))

    @cached_property
    def job(self) -> DataFrame:
        e, i = self.table("events"), F.col("event_id")
        pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
        return e.select(
            i.alias("job_id"), F.concat(F.lit("preset-"), (i % 3).cast("string")).alias("preset_id"), F.col("user_id").cast("string").alias("conversation_id"),
            pick(("recall", "extract", "dream", "index"), i % 4).alias("kind"), pick(("pending", "running", "completed", "partial", "failed"), i % 5).alias("status"),
            F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.when(i % 5 >= 2, F.col("ts")).alias("finished_at"),
        )

    @cached_property
    def speaker(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            F.concat(F.lit("preset-"), (k % 4).cast("string")).alias("preset_id"), F.concat(F.lit("u"), (k % 40).cast("string")).alias("speaker_key"), F.col("c_name").alias("speaker_label"),
            F.array(F.concat(F.lit("Alias "), (k % 60).cast("string")), F.concat(F.lit("  alias  "), (k % 60).cast("string"))).alias("speaker_aliases"),
            F.when(k % 3 != 0, F.concat(F.lit("acc"), (k % 25).cast("string"))).alias("speaker_id"), F.when(k % 5 != 0, F.lit("qq")).alias("platform"), k.alias("place"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (k % 1000).cast("int"))).alias("created_at"),
        )

    @cached_property
    def profile(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("profile_id"), F.concat(F.lit("preset-"), (k % 4).cast("string")).alias("preset_id"), F.concat(F.lit("u"), (k % 30).cast("string")).alias("speaker_key"), F.col("c_name").alias("speaker_label"),
            F.when(k % 6 != 0, F.col("c_mktsegment")).otherwise(" ").alias("content"), F.array((k % 9), (k % 11)).alias("source_memory_ids"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (k % 500).cast("int"))).alias("created_at"),
            (F.lit("2024-02-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (k % 700).cast("int"))).alias("updated_at"),
        )


EDGE = r"'^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$'"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, {EDGE}, '', 'g')"


VIEW_SQL = {
    "mem": f"""mem0 AS (
  SELECT e.embedding, d.doc_id, d.text, list_filter(list_transform(list_sort(list_distinct(list_transform(list_transform(string_split(d.text, ' '), lambda x: {sql_trim('x')}), lambda t: {{'n': length(t), 'w': t}}))), lambda s: s.w), lambda x: x <> '') AS kw0
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT max(vec_id) + 1 FROM embeddings)),
mem AS (
  SELECT doc_id AS memory_id, 'preset-' || (doc_id % 4) AS preset_id, CASE WHEN doc_id % 5 <> 0 THEN 'conv-' || (doc_id % 20) END AS source_conversation_id,
    CASE WHEN doc_id % 7 = 0 THEN 'archived' ELSE 'active' END AS status,
    CASE doc_id % 6 WHEN 0 THEN 'identity' WHEN 1 THEN 'preference' WHEN 2 THEN 'fact' WHEN 3 THEN 'plan' WHEN 4 THEN 'context' ELSE 'other' END AS type,
    CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS importance,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS updated_at, TIMESTAMP '2023-12-01' + to_hours(CAST(doc_id % 97 AS INTEGER)) AS created_at,
    text AS content, CASE WHEN doc_id % 3 <> 0 THEN string_split(text, chr(10))[-1] END AS summary, CASE WHEN doc_id % 4 <> 0 THEN 'calm' ELSE 'glad' END AS sentiment,
    CASE WHEN doc_id % 3 <> 1 THEN 'label-' || (doc_id % 2) END AS source_label,
    list_sort(list_distinct(['u' || (doc_id % 15), 'u' || (doc_id % 23)])) AS speaker_keys,
    kw0[1:12] AS keywords, embedding
  FROM mem0)""",
    "mem_kw": f"mem_kw AS (SELECT DISTINCT memory_id, lower({sql_trim('k.w')}) AS keyword FROM mem, unnest(keywords) AS k(w))",
    "mem_speaker": "mem_speaker AS (SELECT preset_id, s.k AS speaker_key, memory_id FROM mem, unnest(speaker_keys) AS s(k) WHERE status = 'active')",
    "qvec": "qvec AS (SELECT vec_id AS text_no, embedding AS vector FROM embeddings WHERE vec_id IN (0, 1, 2))",
    "msglog": """msglog AS (
  SELECT 'c' || (user_id % 50) AS room, CAST(user_id AS VARCHAR) AS conversation_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) END AS message_id, 'u' || (event_id % 7) AS author,
    CASE WHEN event_id % 5 <> 0 THEN ' name' || (event_id % 7) END AS name, event_type || ' ' || coalesce(props, '') AS content, (epoch_us(ts) // 1000) AS ts,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'assistant' ELSE 'user' END AS role
  FROM events)""",
    "chat": "chat AS (SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turn AS seq, role, text AS content FROM conversations)",
    "job": """job AS (
  SELECT event_id AS job_id, 'preset-' || (event_id % 3) AS preset_id, CAST(user_id AS VARCHAR) AS conversation_id,
    ['recall', 'extract', 'dream', 'index'][event_id % 4 + 1] AS kind, ['pending', 'running', 'completed', 'partial', 'failed'][event_id % 5 + 1] AS status,
    ts AS created_at, ts AS updated_at, CASE WHEN event_id % 5 >= 2 THEN ts END AS finished_at
  FROM events)""",
    "speaker": """speaker AS (
  SELECT 'preset-' || (c_custkey % 4) AS preset_id, 'u' || (c_custkey % 40) AS speaker_key, c_name AS speaker_label,
    ['Alias ' || (c_custkey % 60), '  alias  ' || (c_custkey % 60)] AS speaker_aliases, CASE WHEN c_custkey % 3 <> 0 THEN 'acc' || (c_custkey % 25) END AS speaker_id,
    CASE WHEN c_custkey % 5 <> 0 THEN 'qq' END AS platform, c_custkey AS place, TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 1000 AS INTEGER)) AS created_at
  FROM customer)""",
    "profile": """profile AS (
  SELECT c_custkey AS profile_id, 'preset-' || (c_custkey % 4) AS preset_id, 'u' || (c_custkey % 30) AS speaker_key, c_name AS speaker_label,
    CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment ELSE ' ' END AS content, [c_custkey % 9, c_custkey % 11] AS source_memory_ids,
    TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 500 AS INTEGER)) AS created_at, TIMESTAMP '2024-02-01' + to_hours(CAST(c_custkey % 700 AS INTEGER)) AS updated_at
  FROM customer)""",
}
NEEDS = {"mem_kw": ["mem"], "mem_speaker": ["mem"]}


def with_views(names: str, body: str) -> str:
    """body as a query over the named views; body may start with its own named queries: "a AS (...), b AS (...) SELECT ..."."""
    wanted: list[str] = []
    for n in names.split():
        for m in [*NEEDS.get(n, []), n]:
            if m not in wanted:
                wanted.append(m)
    heads = ",\n".join(VIEW_SQL[n] for n in wanted)
    own = body.lstrip()
    if not heads:
        return own if own.upper().startswith("SELECT") else f"WITH {own}"
    return f"WITH {heads}{' ' if own.upper().startswith('SELECT') else ', '}{own}"
