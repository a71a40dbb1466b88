"""Entries and jobs as tables: every change is a function from old rows to new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import text
from engramlake.schema import DECAY_DAYS, DEFAULT_IMPORTANCE, JOB_DAYS, RETENTION_DAYS


def normalized(entries: DataFrame) -> DataFrame:
    """Trimmed content, optional texts or null, 12 keywords, sorted speakers, importance in 0..1."""
    return entries.withColumns({
        "content": text.trim("content"), "summary": text.or_null("summary"), "sentiment": text.or_null("sentiment"), "keywords": text.keywords("keywords"),
        "speaker_keys": text.speaker_keys("speaker_keys"), "importance": text.importance("importance"), "source_conversation_id": text.or_null("source_conversation_id"),
    })


def append(entries: DataFrame, extracted: DataFrame, now: Column) -> DataFrame:
    """entries with the extracted rows, which share one creation time and are active; rows with a known id replace it."""
    new = normalized(extracted).withColumns({"status": F.lit("active"), "created_at": now, "updated_at": now})
    return entries.join(new.select("memory_id"), "memory_id", "left_anti").unionByName(new, allowMissingColumns=True)


PATCHABLE = ("type", "status", "content", "summary", "sentiment", "importance", "keywords", "speaker_keys")


def apply_patch(entries: DataFrame, patch: DataFrame, now: Column) -> DataFrame:
    """entries with each patched field that is not null; content_changed tells whether a vector is due.

    Keywords and speakers are normalised as on creation; the links of the new rows are ``index.speaker_rows``.
    """
    p = patch.select("memory_id", *[F.col(c).alias(f"_{c}") for c in PATCHABLE if c in patch.columns], F.lit(True).alias("_hit"))
    rows = entries.join(p, "memory_id", "left")
    fields = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in PATCHABLE if c in patch.columns}
    if "content" in fields:
        fields["content"] = F.coalesce(text.trim("_content"), F.col("content"))
        changed = F.coalesce(text.trim("_content") != F.col("content"), F.lit(False))
    else:
        changed = F.lit(False)
    for name, clean in (("keywords", text.keywords), ("speaker_keys", text.speaker_keys)):
        if name in fields:
            fields[name] = F.when(F.col(f"_{name}").isNotNull(), clean(f"_{name}")).otherwise(F.col(name))
    out = rows.withColumn("content_changed", changed).withColumns(fields)
    return out.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).select(*entries.columns, "content_changed")


def archive(entries: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Active entries among ids become archived."""
    hit = ids.select("memory_id").distinct().withColumn("_hit", F.lit(True))
    rows = entries.join(hit, "memory_id", "left").withColumn("_hit", F.coalesce(F.col("_hit") & (F.col("status") == "active"), F.lit(False)))
    return rows.withColumns({"status": F.when(F.col("_hit"), "archived").otherwise(F.col("status")), "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}).drop("_hit")


def split(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """The children of split entries: (parent_id, part, content), at least two a parent; they inherit conversation, label and origins."""
    enough = parts.groupBy("parent_id").count().where("count >= 2").select("parent_id")
    parents = entries.where("status = 'active'").select(F.col("memory_id").alias("parent_id"), "preset_id", "source_conversation_id", "source_label")
    return parts.join(enough, "parent_id", "left_semi").join(parents, "parent_id").withColumn("status", F.lit("active"))


def archive_split(entries: DataFrame, parts: DataFrame, now: Column) -> DataFrame:
    """entries with the parents of :func:`split` archived."""
    return archive(entries, split(entries, parts).select(F.col("parent_id").alias("memory_id")), now)


def archive_merged(entries: DataFrame, groups: DataFrame, now: Column) -> DataFrame:
    """entries with the parents of :func:`merge` archived."""
    return archive(entries, merge(entries, groups).select(F.explode("parents").alias("memory_id")), now)


def _all_equal(c: Column) -> Column:
    """Every value the same, nulls equal to each other."""
    return (F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))) == 1


def merge(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a merge group (group_id, memory_id): conversation kept if all agree, label if conversation and label do."""
    members = groups.select("group_id", "memory_id").distinct().join(entries.where("status = 'active'"), "memory_id")
    conversation, label = F.col("source_conversation_id"), F.col("source_label")
    out = members.groupBy("group_id", "preset_id").agg(
        F.count(F.lit(1)).alias("members"), _all_equal(conversation).alias("one_conversation"), _all_equal(label).alias("one_label"),
        F.min(conversation).alias("c"), F.min(label).alias("l"), F.array_sort(F.collect_set("memory_id")).alias("parents"),
    )
    return out.where("members >= 2").select(
        "group_id", "preset_id", "parents", F.when(F.col("one_conversation"), F.col("c")).alias("source_conversation_id"),
        F.when(F.col("one_conversation") & F.col("one_label"), F.col("l")).alias("source_label"),
    )


def merge_origins(origins: DataFrame) -> DataFrame:
    """(group_id, place, messages) with a first occurrence of each origin of a group; transcript lines don't count for equality."""
    parts = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["speaker_label"], F.lit("")).alias("speaker_label"), F.coalesce(m["created_at"], F.lit("")).alias("created_at"), F.coalesce(m["content_lines"], F.array().cast("array<string>")).alias("content_lines"), m["content"].alias("content")))
    first = Window.partitionBy("group_id", "_print").orderBy("place")
    return origins.withColumn("_print", F.sha2(F.to_json(parts), 256)).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_print")


def merge_with_origins(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """:func:`merge`, each child with source_origins: its parents', by parent id and their own order, equal ones once (the first)."""
    merged = merge(entries, groups)
    key = F.struct("group_id", "preset_id").alias("group_id")
    parents = merged.select(key, F.explode("parents").alias("memory_id"))
    each = parents.join(entries.select("memory_id", "source_origins"), "memory_id").select("group_id", "memory_id", F.posexplode("source_origins").alias("_at", "_o"))
    each = each.select("group_id", F.struct("memory_id", "_at").alias("place"), F.col("_o.messages").alias("messages"))
    union = merge_origins(each).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", "messages"))).alias("_all"))
    union = union.select("group_id.*", F.transform("_all", lambda x: F.struct(x["messages"].alias("messages"))).alias("_all"))
    none = F.array().cast(entries.schema["source_origins"].dataType)
    return merged.join(union, ["group_id", "preset_id"], "left").withColumn("source_origins", F.coalesce(F.col("_all").cast(entries.schema["source_origins"].dataType), none)).drop("_all")


def delete(entries: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, links) without ids."""
    return entries.join(ids.select("memory_id"), "memory_id", "left_anti"), links.join(ids.select("memory_id"), "memory_id", "left_anti")


def expired(entries: DataFrame, now: Column) -> DataFrame:
    """Archived entries past their retention: a week, and up to half a year more by importance."""
    days = F.lit(RETENTION_DAYS) + F.coalesce("importance", F.lit(DEFAULT_IMPORTANCE)) * DECAY_DAYS
    age = F.unix_millis(now) - F.unix_millis("updated_at")
    # the plain comparison reaches the scan
    return entries.where((F.col("status") == "archived") & (F.col("updated_at") <= now - F.make_dt_interval(F.lit(RETENTION_DAYS))) & (age >= RETENTION_DAYS * 86_400_000) & (age >= days * 86_400_000))


def stale_jobs(jobs: DataFrame, now: Column, *, preset=None, kind=None) -> DataFrame:
    """Pending and running jobs [of a preset] [of a kind] fail."""
    hit = F.col("status").isin("pending", "running")
    if preset is not None:
        hit &= F.col("preset_id") == preset
    if kind is not None:
        hit &= F.col("kind") == kind
    return jobs.withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "finished_at": F.when(hit, now).otherwise(F.col("finished_at"))})


def new_jobs(requests: DataFrame, now: Column) -> DataFrame:
    """Pending jobs of requests (job_id, preset_id, conversation_id, kind)."""
    return requests.select("*", F.lit("pending").alias("status"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))


def advance_jobs(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """jobs after events (job_id, status, at): running sets the start, a final status the end; the latest event of a job wins."""
    last = latest(events.select("job_id", F.col("status").alias("_status"), F.col("at").alias("_at")), ["job_id"], F.col("_at").desc(), "_status")
    rows = jobs.join(last, "job_id", "left")
    final = F.col("_status").isin("completed", "partial", "failed")
    out = rows.withColumns({
        "started_at": F.when(F.col("_status") == "running", F.col("_at")).otherwise(F.col("started_at")), "finished_at": F.when(final, F.col("_at")).otherwise(F.col("finished_at")),
        "updated_at": F.coalesce("_at", "updated_at"), "status": F.coalesce("_status", "status"),
    })
    return out.drop("_status", "_at")


def unexpired_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(F.unix_millis("updated_at") >= F.unix_millis(now) - JOB_DAYS * 86_400_000)


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by order, which must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def migrate_conversations(entries: DataFrame) -> DataFrame:
    """Conversations of the former web console are none."""
    return entries.withColumn("source_conversation_id", F.when(F.col("source_conversation_id").startswith("webui:"), None).otherwise(F.col("source_conversation_id")))


def migrate_origins(entries: DataFrame) -> DataFrame:
    return entries.withColumn("source_origins", F.coalesce("source_origins", F.array().cast(entries.schema["source_origins"].dataType)))


def migrate_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots with an item that lacks its final text go."""
    return snapshots.where(F.forall("items", lambda i: i["final_text"].isNotNull()))


def drop_legacy_vectors(entries: DataFrame) -> DataFrame:
    """Vectors live in the index; those once kept with the entries are cleared."""
    return entries.withColumns({"embedding": F.lit(None).cast(entries.schema["embedding"].dataType), "embedding_model_id": F.lit(None).cast("string")})


def delete_snapshots(snapshots: DataFrame, *, id=None, conversation=None, preset=None) -> DataFrame:
    """snapshots without the one named, or those of a conversation or of a preset; rows without that field stay."""
    gone = [F.col(c).eqNullSafe(F.lit(x)) for c, x in (("id", id), ("conversation_id", conversation), ("preset_id", preset)) if x is not None]
    if len(gone) != 1:
        raise ValueError("name an id, a conversation or a preset")
    return snapshots.where(~gone[0])


def snapshot_text(items) -> Column:
    """Non-empty final texts, one a line."""
    return F.array_join(F.filter(F.transform(items, lambda i: text.trim(i["final_text"])), lambda t: t != ""), "\n")


def render_memories(entries: DataFrame) -> DataFrame:
    """memory_id, view: the fields a model reads, one a line; nulls are left out."""
    line = lambda name, c: F.concat(F.lit(f"{name}="), c)
    return entries.select("memory_id", F.concat_ws(
        "\n", line("id", F.col("memory_id").cast("string")), line("type", F.col("type")), line("importance", F.col("importance").cast("string")),
        line("keywords", F.array_join("keywords", "、")), line("source", F.col("source_label")), F.concat(F.lit("content:\n"), F.col("content")),
    ).alias("view"))
