"""Text rules on single cases; the catalogue's queries hold them over whole tables."""

from pyspark.sql import functions as F

from engramlake.functions import text
from engramlake.operators import facts, registry


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_injection(spark):
    df = spark.createDataFrame([(" p", "s "), (" ", "s"), ("", "")], "p string, s string")
    assert [r.x for r in df.select(registry.injection(F.col("p"), F.col("s")).alias("x")).collect()] == ["## 用户画像\np\n\n## 短期记忆\ns", "## 短期记忆\ns", ""]


def test_normalized(spark):
    given = [("\t x　", " \n", [" A", "b", "a", "A ", " "], ["u2", " u1 ", "u2", ""], 1.5), (" y z", "s ", None, None, -0.5), ("k", "", [f"a{i}" for i in range(1, 20)], [], None)]
    df = spark.createDataFrame(given, "content string, summary string, keywords array<string>, speaker_keys array<string>, importance double").withColumns({"sentiment": F.lit(" "), "source_conversation_id": F.lit("")})
    got = rows(facts.normalized(df).select("content", "summary", "keywords", "speaker_keys", "importance", "sentiment"))
    assert got == [("x", None, ["A", "b", "a"], ["u1", "u2"], 1.0, None), ("y z", "s", [], [], 0.0, None), ("k", None, [f"a{i}" for i in range(1, 13)], [], None, None)]


def test_merge_origins(spark):
    given = spark.createDataFrame([(1, 0, "a", "t1"), (1, 1, "a", "t2"), (1, 2, "b", "t1"), (2, 0, "a", "t1"), (2, 1, "c", "t9"), (2, 2, "c", "t8")], "group_id int, place int, content string, line string")
    message = F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("speaker_label"), F.lit("2024").alias("created_at"), F.array("content").alias("content_lines"), "content", F.array("line").alias("transcript_lines"))
    got = facts.merge_origins(given.select("group_id", "place", F.array(message).alias("messages"))).select("group_id", "place", F.col("messages")[0]["content"])
    assert sorted(rows(got)) == [(1, 0, "a"), (1, 2, "b"), (2, 0, "a"), (2, 1, "c")]


def test_snapshots(spark):
    given = spark.createDataFrame([(1, [("  a ",), ("",), ("b",)]), (2, [(None,)]), (3, []), (4, [(" ",)])], "snapshot_id int, items array<struct<final_text:string>>")
    assert rows(facts.migrate_snapshots(given).select("snapshot_id", facts.snapshot_text("items"))) == [(1, "a\nb"), (3, ""), (4, "")]


def test_speaker_line(spark):
    given = [("[1, Ann] 说：hi ",), ("Bob说: x：y",), ("no speaker here",), ("[a，b ,] 说：t",), ("a b说：t",), ("Zoë 说：",)]
    df = spark.createDataFrame(given, "line string").select(text.speaker_line("line").alias("s"))
    assert rows(df.select("s.speaker", "s.content")) == [("Ann", "hi"), ("Bob", "x：y"), (None, None), ("b", "t"), (None, None), ("Zoë", "")]


def test_parse_time(spark):
    df = spark.createDataFrame([(" 1700000000000 ",), ("2024-01-02T03:04:05Z",), ("soon",), ("  ",), ("2024-01-01",), (None,)], "t string")
    assert [r[0] for r in rows(df.select(F.unix_millis(text.parse_time("t"))))] == [1700000000000, 1704164645000, None, None, 1704067200000, None]


def test_json_card(spark):
    df = spark.createDataFrame([('{"prompt":" see this ","meta":{"detail_1":{"title":"App","host":{"nick":"Ann"}}}}',), ('{"desc":"text"}',), ("{broken",), (None,)], "d string")
    assert [r[0] for r in rows(df.select(text.json_card("d")))] == ["[卡片:App] see this（分享者：Ann）", "[卡片消息] text", "[卡片消息]", "[卡片消息]"]


def test_lines(spark):
    df = spark.createDataFrame([("line one is long enough\ndrop\nline three stays", [1]), ("a\nb", [0]), ("kept as it is", [7])], "raw string, deleted array<int>")
    assert rows(df.select(text.prune_lines("raw", "deleted", 0.8, 20).alias("p")).select("p.*")) == [("line one is long enough\nline three stays", 3, 1, False), ("a\nb", 2, 0, True), ("kept as it is", 1, 0, False)]
    df = spark.createDataFrame([(["a", "b", "c"], {1: "B", 2: None}, ["new"]), (["x", "y"], {}, [])], "lines array<string>, changes map<int,string>, additions array<string>")
    assert [r[0] for r in rows(df.select(text.edit_lines("lines", "changes", "additions")))] == [["a", "B", "new"], ["x", "y"]]


def test_json_repair(spark):
    df = spark.createDataFrame([('{"m":["a","b"]}',), ('{"m":"[\\"c\\"]"}',), ('{"m":"no list"}',), ("{broken",)], "d string")
    assert [r[0] for r in rows(df.select(text.repaired_array("d", "m")))] == [["a", "b"], ["c"], None, None]
