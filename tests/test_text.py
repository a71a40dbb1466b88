"""Normalisation literals and message trees."""

from pyspark.sql import functions as F

from engramlake.functions import elements, text


def one(spark, column, **values):
    return spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_trim_all_blanks(spark):
    assert one(spark, text.trim("s"), s="\t　﻿ a b \n") == "a b" and one(spark, text.or_null("s"), s=" \t") is None


def test_trim_takes_both_ends_alone(spark):
    """Blanks inside stay; before a control character that is no blank they are no end."""
    assert one(spark, text.trim("s"), s="\u2003a \u3000 b\u2028\u00a0") == "a \u3000 b" and one(spark, text.trim("s"), s="a \u0085") == "a \u0085"


def test_keywords(spark):
    assert one(spark, text.keywords("k"), k=[" a", "A", "a", ""]) == ["a", "A"]
    assert len(one(spark, text.keywords("k"), k=[str(i) for i in range(20)])) == 12
    assert one(spark, text.index_keywords("k"), k=[" a", "A", "b"]) == ["a", "b"]
    assert one(spark, text.aliases("k"), k=["Ann ", "ANN", " Bob  B", "bob b"]) == ["Ann", "Bob  B"]


def test_importance(spark):
    assert [one(spark, text.importance("v"), v=v) for v in (-1.0, 0.4, 3.0)] == [0.0, 0.4, 1.0]


def test_speaker_key_is_stable(spark):
    import hashlib

    assert one(spark, text.speaker_key("p", "u"), p=" qq", u="7 ") == hashlib.sha256(b"qq\x007").hexdigest()


def e(kind, children=None, **attrs):
    return {"type": kind, "attrs": attrs, "children": children or []}


def test_elements():
    t = lambda s: e("text", content=s)
    assert elements.render([e("b", [t("Hello ")]), t("world")]) == "Hello world"
    assert elements.render([e("p", [t("a")]), e("p", [t("b")])]) == "a\nb"
    assert elements.render([t("a"), e("br"), t("b")]) == "a\nb"
    assert elements.render([e("at", id="7", name="card"), t(" hi")], {"7": "Ann"}) == "@Ann hi"
    assert elements.render([e("at", type="all")]) == "@全体成员" and elements.render([e("at")]) == "[非文本消息]"
    assert elements.render([e("img"), e("face", name="ok"), e("file"), e("sharp", id="3")]) == "[图片][表情:ok][文件]#3"
    assert elements.render([e("message", forward=True)]) == "[聊天记录]" and elements.render([e("message")]) == "[非文本消息]"
    assert elements.render([e("forward", title="T", summary="S")]) == "[聊天记录:T S]"
    assert elements.render([e("quote", [e("user", name="Ann"), t("old")]), t("new")]) == '[回复 "Ann：old"] new'
    assert elements.render([e("json", data='{"prompt":"p","meta":{"detail_1":{"title":"App","host":{"nick":"N"}}}}')]) == "[卡片:App] p（分享者：N）"
    assert elements.render([e("json", data="{bad")]) == "[卡片消息]" and elements.render([e("a", href="http://x")]) == "[链接:http://x]"
    assert elements.targets([e("b", [e("at", id="1")]), e("at", id="2"), e("at", id="1"), e("img", [e("at", id="9")])]) == ["1", "2"]


def test_element_column(spark):
    df = spark.createDataFrame([('[{"type":"text","attrs":{"content":"x"}}]',), ("{bad",), (None,)], "e string")
    assert sorted(r.t for r in df.select(elements.to_text("e").alias("t")).collect()) == ["", "", "x"]
