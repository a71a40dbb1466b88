"""Exports of a preset as documents, and their import.

A document is JSON text with a version, a source preset and the lists entries, userProfiles and
presetSpeakers.  An export has many small documents, one a record, so that Spark writes and reads them
in parallel; an import takes documents of any number of records.  Versions 1 and 2 know no speakers of
an entry, versions up to 3 no source label.  Records are read as VARIANT, so that a wrong type is a
fault with a path, not a cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engramlake.functions import text
from engramlake.schema import ENTRY_STATUSES, ENTRY_TYPES, MEMORY, PROFILE, SPEAKER
from engramlake.sources.versions import Version, Versions

# The stored format of a document.
FORMAT, OLDEST = 5, 1
LISTS = {"entry": "entries", "profile": "userProfiles", "speaker": "presetSpeakers"}
ROLES = ("user", "assistant", "system")
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(map(str.capitalize, rest))


def _renamed(value: Column, kind) -> Column:
    """value with the names of its fields as documents spell them."""
    if isinstance(kind, StructType):
        inner = F.struct(*[_renamed(value[f.name], f.dataType).alias(_camel(f.name)) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if kind.typeName() == "array":
        return F.transform(value, lambda x: _renamed(x, kind.elementType))
    return F.date_format(value, TIME) if kind.typeName() == "timestamp" else value


def export_documents(entries: DataFrame, profiles: DataFrame, speakers: DataFrame, exported_at: Column) -> DataFrame:
    """(preset_id, document): each record of each preset as a document of its own."""
    def lines(rows: DataFrame, layout: StructType, name: str, skip: tuple[str, ...] = ("preset_id",)):
        record = F.struct(*[_renamed(F.col(f.name), f.dataType).alias("id" if f.name == "memory_id" else _camel(f.name)) for f in layout.fields if f.name not in skip])
        head = [F.lit(FORMAT).alias("version"), F.date_format(exported_at, TIME).alias("exportedAt"), F.col("preset_id").alias("sourcePresetId")]
        lists = [(F.array(record) if other == name else F.from_json(F.lit("[]"), "array<string>")).alias(other) for other in LISTS.values()]
        return rows.select("preset_id", F.to_json(F.struct(*head, *lists), {"ignoreNullFields": "false"}).alias("document"))

    return lines(entries, MEMORY, "entries").unionByName(lines(profiles, PROFILE, "userProfiles")).unionByName(lines(speakers, SPEAKER, "presetSpeakers", ("id", "preset_id")))


def _kind(value: Column) -> Column:
    return F.coalesce(F.split(F.schema_of_variant(value), "<")[0], F.lit("VOID"))


def _get(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _strings(value: Column, name: str) -> Column:
    return F.coalesce(F.forall(_get(value, name, "array<variant>"), lambda x: _kind(x) == "STRING"), F.lit(False))


def _first(*tests: tuple[Column, Column]) -> Column:
    """Path of the first test that holds, else null."""
    return F.coalesce(*[F.when(bad, path) for bad, path in tests])


def _lacks(value: Column, name: str) -> Column:
    return ~_kind(_get(value, name)).isin("STRING", "VOID")


def _origin_fault(entry: Column) -> Column:
    origins = _get(entry, "sourceOrigins", "array<variant>")
    at = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def message(m, path):
        return _first(
            (_kind(m) != "OBJECT", path), (~F.coalesce(_get(m, "role", "string").isin(*ROLES), F.lit(False)), at(path, ".role")), (_kind(_get(m, "content")) != "STRING", at(path, ".content")),
            (_lacks(m, "speakerLabel"), at(path, ".speakerLabel")), (_lacks(m, "createdAt"), at(path, ".createdAt")), (~_strings(m, "transcriptLines"), at(path, ".transcriptLines")),
            ((_kind(_get(m, "contentLines")) != "VOID") & ~_strings(m, "contentLines"), at(path, ".contentLines")),
        )

    def origin(o, i):
        path = at("sourceOrigins[", i.cast("string"), "]")
        messages = _get(o, "messages", "array<variant>")
        inner = F.transform(messages, lambda m, j: message(m, at(path, ".messages[", j.cast("string"), "]")))
        return F.when(_kind(o) != "OBJECT", path).when(F.coalesce(F.size(messages), F.lit(0)) <= 0, at(path, ".messages")).otherwise(F.try_element_at(F.filter(inner, lambda x: x.isNotNull()), F.lit(1)))

    return F.when(_kind(_get(entry, "sourceOrigins")) != "ARRAY", "sourceOrigins").otherwise(F.try_element_at(F.filter(F.transform(origins, origin), lambda x: x.isNotNull()), F.lit(1)))


def records(documents: DataFrame) -> DataFrame:
    """(version, source, kind, place, record, fault): each record of the documents as VARIANT, with the path of its first fault; a damaged document is one row."""
    whole = documents.select(F.try_parse_json("document").alias("_d")).select("_d", F.when(_kind(_get(F.col("_d"), "version")) == "BIGINT", _get(F.col("_d"), "version", "int")).alias("version"), _get(F.col("_d"), "sourcePresetId", "string").alias("source"))
    lists = F.map_from_arrays(F.array(*map(F.lit, LISTS)), F.array(*[_get(F.col("_d"), name, "array<variant>") for name in LISTS.values()]))
    bad = F.coalesce(_first((F.col("_d").isNull(), F.lit("document")), (~F.coalesce(F.col("version").between(OLDEST, FORMAT), F.lit(False)), F.lit("version")), (F.col("source").isNull(), F.lit("sourcePresetId")), (_kind(_get(F.col("_d"), "entries")) != "ARRAY", F.lit("entries"))))
    damaged = whole.withColumn("fault", bad).where("fault is not null").select("version", "source", F.lit("document").alias("kind"), F.lit(0).alias("place"), F.lit(None).cast("variant").alias("record"), "fault")
    good = whole.where(bad.isNull()).select("version", "source", F.explode(lists).alias("kind", "_all")).select("version", "source", "kind", F.posexplode("_all").alias("place", "record"))
    r, lit = F.col("record"), F.lit
    no = lambda name: (_kind(_get(r, name)) != "STRING", lit(name))
    time = lambda name: (text.parse_time(_get(r, name, "string")).isNull(), lit(name))
    other = lambda name, known: (~F.coalesce(_get(r, name, "string").isin(*known), lit(False)), lit(name))
    entry = F.coalesce(_first(
        no("id"), no("content"), other("type", ENTRY_TYPES), other("status", ENTRY_STATUSES), (~_strings(r, "keywords"), lit("keywords")), time("createdAt"), time("updatedAt"),
        ((F.col("version") > 2) & ~_strings(r, "speakerKeys"), lit("speakerKeys")), ((_kind(_get(r, "importance")) != "VOID") & _get(r, "importance", "double").isNull(), lit("importance"))), _origin_fault(r))
    profile = _first(no("id"), no("speakerKey"), no("speakerLabel"), no("content"), (~_strings(r, "sourceMemoryIds"), lit("sourceMemoryIds")), time("createdAt"), time("updatedAt"))
    speaker = _first(no("speakerKey"), no("speakerLabel"), time("createdAt"), time("updatedAt"))
    kind = F.col("kind")
    return good.withColumn("fault", F.when(_kind(r) != "OBJECT", kind).when(kind == "entry", entry).when(kind == "profile", profile).otherwise(speaker)).unionByName(damaged)


def imported(found: DataFrame, target: str, now: Column, known: DataFrame) -> dict[str, DataFrame]:
    """entries, profiles and speakers of faultless records, as rows of the target preset.

    Ids are derived from the target and the old id, or kept if the records come from the target itself.  Of
    records with one id the one last updated stays, of equally old ones the one with the greatest text.  Active entries' speakers that neither
    the documents nor known (speaker_key) have are made up.
    """
    r, v = F.col("record"), F.col("version")
    get = lambda name, kind="string": _get(r, name, kind)
    time = lambda name: text.parse_time(get(name))
    moved = lambda kind, old: F.when(F.col("source") == target, old).otherwise(text.derived_id(F.lit("import"), F.lit(kind), F.lit(target), old))
    none = F.array().cast("array<string>")

    def last(rows, key):
        order = Window.partitionBy(key).orderBy(F.desc("updated_at"), F.desc("_text"))
        return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_text", "_known")

    message = lambda m: F.struct(*[_get(m, _camel(n), "array<string>" if n.endswith("lines") else "string").alias(n) for n in ("role", "speaker_label", "created_at", "content_lines", "content", "transcript_lines")])
    origins = F.transform(get("sourceOrigins", "array<variant>"), lambda o: F.struct(F.transform(_get(o, "messages", "array<variant>"), message).alias("messages")))
    whole = F.to_json(r).alias("_text")
    entries = last(found.where("kind = 'entry'").select(
        moved("entry", get("id")).alias("memory_id"), F.lit(target).alias("preset_id"), F.when(v > 2, get("speakerKeys", "array<string>")).otherwise(none).alias("speaker_keys"), get("type").alias("type"), get("status").alias("status"),
        get("content").alias("content"), get("keywords", "array<string>").alias("keywords"), get("summary").alias("summary"), get("sentiment").alias("sentiment"), get("importance", "double").alias("importance"),
        get("sourceConversationId").alias("source_conversation_id"), F.when(v > 3, get("sourceLabel")).alias("source_label"), origins.alias("source_origins"), time("createdAt").alias("created_at"), time("updatedAt").alias("updated_at"), whole), "memory_id")
    profiles = last(found.where("kind = 'profile'").select(
        moved("user-profile", get("id")).alias("id"), F.lit(target).alias("preset_id"), get("speakerKey").alias("speaker_key"), get("speakerLabel").alias("speaker_label"), get("content").alias("content"),
        F.transform(get("sourceMemoryIds", "array<string>"), lambda i: moved("entry", i)).alias("source_memory_ids"), time("createdAt").alias("created_at"), time("updatedAt").alias("updated_at"), whole), "id")
    row_id = lambda key: text.derived_id(F.lit(target), key)
    own = last(found.where("kind = 'speaker'").select(
        row_id(get("speakerKey")).alias("id"), F.lit(target).alias("preset_id"), get("speakerKey").alias("speaker_key"), get("speakerLabel").alias("speaker_label"), F.coalesce(get("speakerAliases", "array<string>"), F.array(get("speakerLabel"))).alias("speaker_aliases"),
        get("speakerId").alias("speaker_id"), get("platform").alias("platform"), time("createdAt").alias("created_at"), time("updatedAt").alias("updated_at"), whole), "speaker_key")
    keys = entries.where("status = 'active'").select(F.explode("speaker_keys").alias("speaker_key")).distinct()
    new = keys.join(own.select("speaker_key").unionByName(known.select("speaker_key")), "speaker_key", "left_anti").withColumn("speaker_label", text.synthetic_label("speaker_key"))
    made = new.select(row_id(F.col("speaker_key")).alias("id"), F.lit(target).alias("preset_id"), "speaker_key", "speaker_label", F.array("speaker_label").alias("speaker_aliases"), F.lit(None).cast("string").alias("speaker_id"), F.lit(None).cast("string").alias("platform"), now.alias("created_at"), now.alias("updated_at"))
    return {"entries": entries, "profiles": profiles, "speakers": own.unionByName(made)}


def import_documents(store: Versions, documents: DataFrame, target: str, now: Column) -> Version:
    """A new version of the store's entries, profiles and speakers with the documents in the target preset; all or nothing.

    A fault raises ValueError and publishes nothing.  Entries and speakers replace rows of their id, profiles those of
    their preset and speaker.  A store without versions starts empty.
    """
    found, base = records(documents), store.newest()
    if faults := found.where("fault is not null").orderBy("kind", "place", "fault").select("kind", "place", "fault").limit(5).collect():
        raise ValueError("; ".join(f"{f.kind} {f.place}: {f.fault}" for f in faults))
    layouts = {"entries": MEMORY, "profiles": PROFILE, "speakers": SPEAKER}
    old = {name: base.table(name) if base else documents.sparkSession.createDataFrame([], layout) for name, layout in layouts.items()}
    new = imported(found, target, now, old["speakers"].where(F.col("preset_id") == target))
    keys = {"entries": ["memory_id"], "profiles": ["preset_id", "speaker_key"], "speakers": ["preset_id", "speaker_key"]}
    kept = {n: old[n].join(new[n].select(*keys[n]).distinct(), keys[n], "left_anti") for n in layouts}
    return store.publish({n: kept[n].select(*layouts[n].names).unionByName(new[n].select(*layouts[n].names)) for n in layouts}, base=base)
