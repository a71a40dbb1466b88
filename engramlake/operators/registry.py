"""Speakers, profiles, labels, personas, import and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import text
from engramlake.schema import DEFAULT_IMPORTANCE


def profile_groups(links: DataFrame, entries: DataFrame, *, least: int = 3, most: int = 20) -> DataFrame:
    """(preset_id, speaker_key, matched, selected, latest_ms, memory_ids): speakers with enough active memories and their foremost ones.

    Order: importance (unknown: the default), then newest, then id.
    """
    live = links.join(entries.where("status = 'active'").select("memory_id", "speaker_keys", "importance", "updated_at"), "memory_id").where(F.expr("array_contains(speaker_keys, speaker_key)"))
    key = ["preset_id", "speaker_key"]
    order = Window.partitionBy(*key).orderBy(F.coalesce("importance", F.lit(DEFAULT_IMPORTANCE)).desc(), F.col("updated_at").desc(), "memory_id")
    counts = live.groupBy(*key).agg(F.count(F.lit(1)).alias("matched")).where(F.col("matched") >= least)
    top = live.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    picked = top.groupBy(*key).agg(F.count(F.lit(1)).alias("selected"), F.max(F.unix_millis("updated_at")).alias("latest_ms"), F.array_sort(F.collect_list(F.struct("_n", "memory_id"))).alias("m"))
    return picked.join(counts, key).select(*key, "matched", "selected", "latest_ms", F.transform("m", lambda x: x["memory_id"]).alias("memory_ids"))


def profile_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("speakers"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"), F.coalesce(F.sum("selected"), F.lit(0)).alias("selected"))


def profile_fresh(groups: DataFrame, profiles: DataFrame) -> DataFrame:
    """groups with fresh: the profile names just these memories and is newer than all of them."""
    joined = groups.join(profiles.select("preset_id", "speaker_key", "source_memory_ids", F.unix_millis("updated_at").alias("_ms")), ["preset_id", "speaker_key"], "left")
    same = F.array_sort(F.array_distinct("memory_ids")) == F.array_sort(F.array_distinct("source_memory_ids"))
    return joined.withColumn("fresh", F.coalesce(same & (F.col("_ms") > F.col("latest_ms")), F.lit(False))).select(*groups.columns, "fresh")


def resolve_labels(wanted: DataFrame, speakers: DataFrame) -> DataFrame:
    """wanted(label) with speaker_key, over labels and aliases, blanks and case folded; the last registration (place) wins; null: unknown."""
    names = speakers.select("speaker_key", F.col("place"), F.posexplode(F.concat(F.array("speaker_label"), F.coalesce("speaker_aliases", F.array().cast("array<string>")))).alias("_at", "_name"))
    by_name = names.groupBy(text.alias_key("_name").alias("_key")).agg(F.max_by("speaker_key", F.struct("place", "_at")).alias("speaker_key"))
    return wanted.withColumn("_key", text.alias_key("label")).join(by_name, "_key", "left").drop("_key")


def register_missing(speakers: DataFrame, seen: DataFrame) -> DataFrame:
    """New rows for seen(preset_id, speaker_key, speaker_label, place) without one; the first label wins."""
    first = seen.groupBy("preset_id", "speaker_key").agg(F.min_by("speaker_label", "place").alias("speaker_label"))
    return first.join(speakers.select("preset_id", "speaker_key"), ["preset_id", "speaker_key"], "left_anti")


def coverage(links: DataFrame, speakers: DataFrame) -> DataFrame:
    """Synthetic rows for linked keys that nobody registered."""
    return links.select("preset_id", "speaker_key").distinct().join(speakers, ["preset_id", "speaker_key"], "left_anti").withColumn("speaker_label", text.synthetic_label("speaker_key"))


def canonical_profiles(profiles: DataFrame) -> DataFrame:
    """The earliest row of each speaker."""
    order = Window.partitionBy("preset_id", "speaker_key").orderBy("created_at", "profile_id")
    return profiles.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def reconcile_speakers(speakers: DataFrame, identities: DataFrame) -> DataFrame:
    """For each identity the merged row: same key, or same account on the same or no platform.

    The two ways of matching are two equi-joins, not one join on either.
    """
    who = identities.select("preset_id", F.col("speaker_key").alias("key"), F.col("speaker_label").alias("label"), F.col("speaker_id").alias("account"), F.col("platform").alias("where"))
    s = speakers.select("preset_id", "speaker_key", "speaker_label", "speaker_aliases", "speaker_id", "platform", "created_at")
    by_key = who.join(s.withColumn("key", F.col("speaker_key")), ["preset_id", "key"])
    by_account = who.join(s.withColumn("account", F.col("speaker_id")), ["preset_id", "account"]).where("platform is null or platform = where")
    cols = ["preset_id", "key", "speaker_key", "speaker_label", "speaker_aliases", "created_at"]
    found = by_key.select(*cols).unionByName(by_account.select(*cols)).distinct()
    merged = found.groupBy("preset_id", "key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "speaker_key", F.concat("speaker_aliases", F.array("speaker_label")).alias("a")))), lambda x: x["a"])).alias("a"),
        F.min("created_at").alias("created_at"), F.array_sort(F.collect_set("speaker_key")).alias("merged_keys"),
    )
    out = who.join(merged, ["preset_id", "key"], "left")
    names = F.concat(F.coalesce("a", F.array().cast("array<string>")), F.array("label"))
    return out.select("preset_id", F.col("key").alias("speaker_key"), F.col("label").alias("speaker_label"), text.aliases(names).alias("speaker_aliases"), "created_at", F.coalesce("merged_keys", F.array().cast("array<string>")).alias("merged_keys"))


def mark_reviewed(profiles: DataFrame, reviewed: DataFrame, now: Column) -> DataFrame:
    """profiles with sources and time of reviewed(profile_id, source_memory_ids) renewed; contents stay."""
    rows = profiles.join(reviewed.select("profile_id", F.col("source_memory_ids").alias("_sources")), "profile_id", "left")
    hit = F.col("_sources").isNotNull()
    return rows.withColumns({"updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "source_memory_ids": F.coalesce("_sources", "source_memory_ids")}).select(*profiles.columns)


def merge_profiles(profiles: DataFrame, keys: DataFrame) -> DataFrame:
    """(preset_id, speaker_key, profile_id, content, source_memory_ids): of all profiles of a merged speaker (keys: speaker_key, old_key) the freshest, with all sources."""
    rows = profiles.join(keys.select("preset_id", F.col("speaker_key").alias("_new"), F.col("old_key").alias("speaker_key")), ["preset_id", "speaker_key"])
    newest = F.struct("updated_at", F.struct(F.col("profile_id")))
    return rows.groupBy("preset_id", F.col("_new").alias("speaker_key")).agg(
        F.max_by("profile_id", newest).alias("profile_id"), F.max_by("content", newest).alias("content"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_memory_ids")))).alias("source_memory_ids"),
    )


def render_profiles(asked: DataFrame, profiles: DataFrame) -> DataFrame:
    """(request, rendered): profiles of the asked keys (request, place, preset_id, speaker_key), in order of first mention."""
    first = asked.groupBy("request", "preset_id", "speaker_key").agg(F.min("place").alias("place"))
    rows = first.join(profiles.where(text.trim("content") != ""), ["preset_id", "speaker_key"]).select("request", "place", F.concat("speaker_label", F.lit("的人物画像：\n"), "content").alias("block"))
    return rows.groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n\n").alias("rendered"))


def injection(profiles: Column, snapshot: Column) -> Column:
    """Both sections under their headings; blank ones are left out."""
    part = lambda head, c: F.when(text.trim(c) != "", F.concat(F.lit(head + "\n"), text.trim(c)))
    return F.concat_ws("\n\n", part("## 用户画像", profiles), part("## 短期记忆", snapshot))


def upsert_personas(stored: DataFrame, generated: DataFrame) -> DataFrame:
    """One row a preset: a manual card stays, else the generated one takes over."""
    new = generated.join(stored.where("source = 'manual'").select("preset_id"), "preset_id", "left_anti")
    return stored.join(new.select("preset_id"), "preset_id", "left_anti").unionByName(new)


def stale_personas(stored: DataFrame, raw: DataFrame) -> DataFrame:
    return stored.join(raw.select("preset_id", text.sha256("raw").alias("_now")), "preset_id").select("preset_id", "source", ((F.col("source") != "manual") & (F.col("raw_hash") != F.col("_now"))).alias("stale"))


def import_entries(target_preset: str, records: DataFrame, existing: DataFrame) -> DataFrame:
    """Imported entries under ids derived from the target and the source id, and whether they replace a row."""
    new = records.withColumn("import_id", text.derived_id(F.lit("import"), F.lit("entry"), F.lit(target_preset), F.col("memory_id").cast("string")))
    return new.join(existing.select("import_id", F.lit(True).alias("_there")), "import_id", "left").select("import_id", F.lit(target_preset).alias("preset_id"), "content", F.coalesce("_there", F.lit(False)).alias("replaces"))


def export_lines(entries: DataFrame) -> DataFrame:
    """One JSON document an entry; a preset's export is their union, written by Spark, never one giant string."""
    return entries.select("preset_id", "memory_id", F.to_json(F.struct(F.col("memory_id").alias("id"), "type", "status", "content", "keywords")).alias("document"))


def speakers_of_window(messages: DataFrame) -> DataFrame:
    """(conversation_id, speaker_keys): distinct non-empty keys of user messages in order of appearance."""
    rows = messages.where((F.col("role") == "user") & (F.coalesce(F.col("speaker_key"), F.lit("")) != ""))
    first = rows.groupBy("conversation_id", "speaker_key").agg(F.min("seq").alias("seq"))
    return first.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "speaker_key"))), lambda x: x["speaker_key"]).alias("speaker_keys"))


def payload_speakers(messages: DataFrame) -> DataFrame:
    """label -> key of each conversation; the last message wins."""
    return messages.where("speaker_key is not null").groupBy("conversation_id", "name").agg(F.max_by("speaker_key", "seq").alias("speaker_key"))


def set_personas(cards: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, refused): cards after changes (preset_id, card, raw_hash, source, epoch), as compare and set.

    cards have an epoch that counts their writings.  A generated card is written only if its epoch is
    that of the stored one (0: there is none) and what is stored was not written by hand; a manual card always
    is.  Of several changes of a preset a manual one goes first, then the one with the greatest raw_hash, so that the
    outcome does not depend on order.  refused has the changes that lost, with a reason: stale or manual.
    """
    old = cards.select("preset_id", F.col("source").alias("_source"), F.col("epoch").alias("_epoch"))
    asked = changes.join(old, "preset_id", "left").withColumn("_at", F.coalesce("_epoch", F.lit(0)).cast("long"))
    manual = F.col("source") == "manual"
    first = Window.partitionBy("preset_id").orderBy((F.col("reason").isNull()).desc(), manual.desc(), F.desc("raw_hash"), "card")
    reason = F.when(manual, F.lit(None).cast("string")).when(F.coalesce(F.col("_source") == "manual", F.lit(False)), "manual").when(F.col("epoch") != F.col("_at"), "stale")
    ranked = asked.withColumn("reason", reason).withColumn("_n", F.row_number().over(first))
    won = ranked.where("reason is null and _n = 1").select("preset_id", "card", "raw_hash", "source", (F.col("_at") + 1).alias("epoch"))
    lost = ranked.where("reason is not null or _n > 1").select("preset_id", "card", "source", F.coalesce("reason", F.lit("stale")).alias("reason"))
    kept = cards.join(won.select("preset_id"), "preset_id", "left_anti").select("preset_id", "card", "raw_hash", "source", F.col("epoch").cast("long").alias("epoch"))
    return kept.unionByName(won), lost


def delete_personas(cards: DataFrame, presets: DataFrame) -> DataFrame:
    return cards.join(presets.select("preset_id"), "preset_id", "left_anti")


def list_personas(cards: DataFrame, source: str | None = None) -> DataFrame:
    """By preset; of one source only if it is named."""
    return (cards if source is None else cards.where(F.col("source") == source)).orderBy("preset_id")
