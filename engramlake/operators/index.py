"""The derived index: build, diff, apply, inventory, states.

Changes are functional: every operation gives the new table.  Diffs over all
presets are one full outer join on the id, so nothing is paged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import vector
from engramlake.functions.text import content_hash, index_keywords, keywords_hash
from engramlake.schema import INDEX_SCHEMA_VERSION


def documents(entries: DataFrame) -> DataFrame:
    """What the index says of an entry, without its vector."""
    return entries.select(
        "memory_id", "preset_id", "source_conversation_id", "status", "type",
        content_hash("content").alias("content_hash"), keywords_hash("keywords").alias("keywords_hash"), F.unix_millis("updated_at").alias("updated_at"),
    )


def keyword_rows(entries: DataFrame) -> DataFrame:
    return entries.select("memory_id", F.explode(index_keywords("keywords")).alias("keyword"))


def speaker_rows(entries: DataFrame) -> DataFrame:
    """The inverted index speaker -> active memory."""
    return entries.where("status = 'active'").select("preset_id", F.explode("speaker_keys").alias("speaker_key"), "memory_id")


def embed(entries: DataFrame, legacy: DataFrame, model_id: str, dimension: int, embedder) -> DataFrame:
    """(memory_id, embedding, reused): a valid stored vector of the same model, else embedder(content).

    legacy: memory_id, embedding, embedding_model_id.  embedder: a Column function
    or pandas UDF from text to array<float>; only rows without a usable vector reach it.
    """
    joined = entries.select("memory_id", "content").join(legacy.select("memory_id", F.col("embedding").alias("_old"), "embedding_model_id"), "memory_id", "left")
    rows = joined.withColumn("reused", F.coalesce((F.col("embedding_model_id") == model_id) & vector.is_valid(F.col("_old"), dimension), F.lit(False)))
    old = rows.where("reused").select("memory_id", F.col("_old").alias("embedding"), "reused")
    return old.unionByName(rows.where("not reused").select("memory_id", embedder(F.col("content")).alias("embedding"), "reused"))


def build(entries: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """The index of all entries with a valid vector."""
    return documents(entries).join(vectors.where(vector.is_valid(F.col("embedding"), dimension)).select("memory_id", "embedding"), "memory_id")


METADATA = ("preset_id", "source_conversation_id", "status", "type", "keywords_hash", "updated_at")


def reconcile(entries: DataFrame, index: DataFrame) -> DataFrame:
    """(memory_id, preset_id, action): replace (new or other content), preserve (other metadata), noop, delete."""
    new, old = documents(entries).alias("n"), index.select("memory_id", "content_hash", *METADATA).alias("o")
    same = F.lit(True)
    for c in METADATA:
        same &= F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    action = F.when(F.col("n.memory_id").isNull(), "delete").when(F.col("o.memory_id").isNull() | (F.col("n.content_hash") != F.col("o.content_hash")), "replace").when(~same, "preserve").otherwise("noop")
    return new.join(old, F.col("n.memory_id") == F.col("o.memory_id"), "full").select(F.coalesce("n.memory_id", "o.memory_id").alias("memory_id"), F.coalesce("n.preset_id", "o.preset_id").alias("preset_id"), action.alias("action"))


def apply_mutation(index: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The index after deletes, replacements (with a vector) and metadata updates (vector null: the stored one stays and must exist)."""
    left = index.join(deletes.select("memory_id"), "memory_id", "left_anti")
    keep = left.join(upserts.select("memory_id"), "memory_id", "left_anti")
    stored = left.select("memory_id", F.col("embedding").alias("_stored"))
    changed = upserts.join(stored, "memory_id", "left")
    new = changed.withColumn("embedding", F.coalesce("embedding", "_stored", F.raise_error(F.lit("no vector to preserve")).cast("array<float>"))).drop("_stored")
    return keep.unionByName(new)


def snapshot(index: DataFrame, ids: DataFrame) -> DataFrame:
    """(memory_id, missing, content_hash) of each requested id, once."""
    return ids.select("memory_id").distinct().join(index.select("memory_id", "content_hash"), "memory_id", "left").select("memory_id", F.col("content_hash").isNull().alias("missing"), "content_hash")


def index_state(manifest_missing: Column, unavailable: Column, building: Column, states: Column) -> Column:
    """The roll-up of all presets' states, by precedence."""
    any_is = lambda s: F.array_contains(states, s)
    return F.when(unavailable, "unavailable").when(building | manifest_missing | any_is("building"), "building").when(any_is("unavailable"), "unavailable").when(any_is("dirty"), "dirty").otherwise("ready")


def roll_up(states: DataFrame, manifest_missing: bool = False, unavailable: bool = False, building: bool = False) -> DataFrame:
    """One row: state, presets, and the first error by preset."""
    rows = states.agg(F.coalesce(F.collect_set("state"), F.array()).alias("s"), F.count(F.lit(1)).alias("presets"), F.min_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("preset_id"))).alias("last_error"))
    return rows.select(index_state(F.lit(manifest_missing), F.lit(unavailable), F.lit(building), F.col("s")).alias("state"), "presets", "last_error")


def upsert_states(states: DataFrame, changes: DataFrame) -> DataFrame:
    """One row a preset; a changed one replaces the stored one."""
    return states.join(changes.select("preset_id"), "preset_id", "left_anti").unionByName(changes)


def require_ready(states: DataFrame, preset: str) -> None:
    """Fails unless the preset's index is ready."""
    row = states.where(F.col("preset_id") == preset).select("state", "last_error").first()
    if row is None or row["state"] != "ready":
        raise RuntimeError(f"index of {preset} is {row['state'] if row else 'missing'}" + (f": {row['last_error']}" if row and row["last_error"] else ""))


def rebuild_reason(manifests: DataFrame, *, engine: str, extension: str, model: str, dimension: int, upgrade: bool = False) -> DataFrame:
    """manifests (nullable row each) with the first reason for a rebuild, or null."""
    m = F.col
    reason = (
        F.when(m("schema_version").isNull(), "missing").when(m("storage_engine") != engine, "engine").when(~m("vector_extension_version").eqNullSafe(F.lit(extension)), "extension")
        .when((m("schema_version") != INDEX_SCHEMA_VERSION) & F.lit(not upgrade), "schema").when(m("embedding_model_id") != model, "model").when(m("dimension") != dimension, "dimension")
    )
    return manifests.withColumn("reason", reason)


def upgrade(index: DataFrame) -> DataFrame:
    """An older index in the present layout: conversation added, consolidation flag gone."""
    out = index if "source_conversation_id" in index.columns else index.withColumn("source_conversation_id", F.lit(None).cast("string"))
    return out.drop("is_consolidated")
