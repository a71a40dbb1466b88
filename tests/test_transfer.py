"""Export and import of presets."""

import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F

from engramlake.functions import text
from engramlake.operators import transfer
from engramlake.schema import MEMORY, PROFILE, SPEAKER
from engramlake.sources.versions import Versions


def now():
    return F.lit("2024-03-01").cast("timestamp")
ORIGIN = {"messages": [{"role": "user", "content": "x", "transcriptLines": ["a"], "speakerLabel": None}]}
ENTRY = {"id": "m1", "content": "c", "type": "fact", "status": "active", "keywords": ["k"], "speakerKeys": ["u1"], "sourceLabel": "l", "importance": 0.5, "sourceOrigins": [ORIGIN], "createdAt": "2024-01-01T00:00:00.000Z", "updatedAt": "2024-01-02T00:00:00.000Z"}


def document(version=5, entries=(ENTRY,), **more):
    return json.dumps({"version": version, "sourcePresetId": "p", "entries": list(entries), "userProfiles": [], "presetSpeakers": [], **more})


def frame(spark, *documents):
    return spark.createDataFrame([(d,) for d in documents], "document string")


def store(spark, tmp_path):
    return Versions(spark, f"{tmp_path}/{uuid.uuid4().hex}")


def rows(df):
    return sorted(map(repr, df.collect()))


def filled(spark):
    t = datetime.datetime(2024, 1, 1, 12, 0, 0, 5000)
    message = ("user", None, "2024", ["l1"], "said \"é\"", ["t1"])
    entries = [(f"m{i}", "p", [f"u{i % 3}"], "fact", "active" if i % 2 else "archived", f"c{i}\n", ["k", "K"], None, "calm", None if i % 3 else 0.25, "conv", "lab", [([message, message],)] if i % 2 else [], t, t) for i in range(20)]
    profiles = [(f"q{i}", "p", f"u{i}", f"L{i}", "text", ["m1", "m2"], t, t) for i in range(3)]
    speakers = [(f"s{i}", "p", f"u{i}", f"L{i}", ["A", "B"], None if i else "id", "qq", t, t) for i in range(2)]
    return spark.createDataFrame(entries, MEMORY), spark.createDataFrame(profiles, PROFILE), spark.createDataFrame(speakers, SPEAKER)


def test_export_then_import_gives_every_field(spark, tmp_path):
    entries, profiles, speakers = filled(spark)
    out = transfer.export_documents(entries, profiles, speakers, now())
    assert out.count() == 25
    v = transfer.import_documents(store(spark, tmp_path), out, "p", now())
    assert rows(v.table("entries")) == rows(entries) and rows(v.table("profiles")) == rows(profiles)
    # u2 has active entries and no registration
    got = v.table("speakers").drop("id").collect()
    assert rows(v.table("speakers").where("speaker_key <> 'u2'").drop("id")) == rows(speakers.drop("id")) and len(got) == 3
    assert [r.speaker_aliases for r in got if r.speaker_key == "u2"] == [["user:u2"]]


def test_import_into_another_preset(spark, tmp_path):
    entries, profiles, speakers = filled(spark)
    s, out = store(spark, tmp_path), transfer.export_documents(entries, profiles, speakers, now())
    first = transfer.import_documents(s, out, "p", now())
    v = transfer.import_documents(s, out, "z", now())
    again = transfer.import_documents(s, out, "z", now())
    assert rows(again.table("entries")) == rows(v.table("entries")) and v.counts == again.counts and v.counts["entries"] == 40
    ids = spark.createDataFrame([("m1",)], "i string").select(text.derived_id(F.lit("import"), F.lit("entry"), F.lit("z"), "i")).first()[0]
    assert v.table("entries").where(F.col("memory_id") == ids).first().content == "c1\n"
    assert all(ids in r.source_memory_ids for r in v.table("profiles").where("preset_id = 'z'").collect())
    assert rows(v.table("entries").where("preset_id = 'p'")) == rows(first.table("entries"))


@pytest.mark.parametrize(("version", "keys", "label"), [(1, [], None), (2, [], None), (3, ["u1"], None), (4, ["u1"], "l"), (5, ["u1"], "l")])
def test_versions(spark, tmp_path, version, keys, label):
    v = transfer.import_documents(store(spark, tmp_path), frame(spark, document(version)), "p", now())
    r = v.table("entries").first()
    assert (r.speaker_keys, r.source_label, r.memory_id) == (keys, label, "m1") and v.counts["speakers"] == len(keys)


def test_faults_leave_nothing_behind(spark, tmp_path):
    s = store(spark, tmp_path)
    before = transfer.import_documents(s, frame(spark, document()), "p", now())

    def origin(**m):
        return {**ENTRY, "sourceOrigins": [ORIGIN, {"messages": [{**ORIGIN["messages"][0], **m}]}]}

    path = "sourceOrigins[1].messages[0]"
    bad = {
        "{broken": "document", document(6): "version", document("5"): "version", document(entries=[{**ENTRY, "type": "x"}]): "type", document(entries=["text"]): "entry", document(entries=[{**ENTRY, "id": 7}]): "id",
        document(entries=[{**ENTRY, "createdAt": "soon"}]): "createdAt", document(entries=[{**ENTRY, "sourceOrigins": None}]): "sourceOrigins", document(entries=[{**ENTRY, "sourceOrigins": [{"messages": []}]}]): "sourceOrigins[0].messages",
        document(entries=[{**ENTRY, "sourceOrigins": [4]}]): "sourceOrigins[0]", document(entries=[origin(role="bot")]): f"{path}.role", document(entries=[origin(content=3)]): f"{path}.content",
        document(entries=[origin(transcriptLines=["a", 1])]): f"{path}.transcriptLines", document(entries=[origin(contentLines="a")]): f"{path}.contentLines", document(entries=[origin(createdAt=1)]): f"{path}.createdAt",
        document(userProfiles=[{"id": "q"}]): "speakerKey",
    }
    found = transfer.records(frame(spark, *bad)).where("fault is not null").collect()
    assert sorted(r.fault for r in found) == sorted(bad.values())
    with pytest.raises(ValueError, match="role"):
        transfer.import_documents(s, frame(spark, document(entries=[{**ENTRY, "id": "m2"}]), document(entries=[origin(role="bot")])), "p", now())
    assert s.newest().number == before.number and s.newest().counts == before.counts


def test_repeated_and_no_records(spark, tmp_path):
    later = {**ENTRY, "content": "later", "updatedAt": "2024-05-01T00:00:00.000Z"}
    s = store(spark, tmp_path)
    assert transfer.import_documents(s, frame(spark, document(entries=[later, ENTRY]), document()), "p", now()).table("entries").first().content == "later"
    assert transfer.import_documents(s, frame(spark), "p", now()).counts["entries"] == 1
