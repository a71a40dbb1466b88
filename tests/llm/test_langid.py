import numpy as np
from pyspark.sql import functions as F

from engramlake.llm import langid, queries
from cases import empty, odd

SMALL = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 100 and right / n > 0.98


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= max(1, code.shape[1] // 5) and (np.abs(code.sum(axis=0)) < n).all()


def test_decoding_corrects_a_wrong_bit():
    code = langid.codewords(4)
    bits = code[2].astype(float).copy()
    bits[0] = -bits[0]
    loss = np.log1p(np.exp(-2 * code * bits)).mean(axis=1)
    assert int(np.argmin(loss)) == 2


def test_odd_rows(spark):
    df = odd(spark)
    model = langid.train(df.where("text is not null").withColumn("lang", F.when(F.col("doc_id") == 7, "fr").otherwise("en")))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(got) == 13 and [got[i].lang_pred for i in (1, 2, 3, 5)] == ["und"] * 4 and got[7].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in langid.accepted(df, model).collect()} == {4, 6, 7, 8, 9, 10, None, 12, 13}
    assert langid.accepted(df, model).columns == df.columns


def test_nothing_learned(spark):
    model = langid.train(empty(spark))
    assert {r.lang_pred for r in langid.identify(odd(spark), model).collect()} == {"und"}
    one = langid.train(odd(spark).where("doc_id = 4"))
    assert {r.lang_pred for r in langid.identify(odd(spark).where("doc_id = 6"), one).collect()} == {"en"}
    assert langid.identify(empty(spark), one).count() == 0


def test_only_text_counts(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = queries.trained(df)
    a = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    b = {r.doc_id - 7: r.lang_pred for r in langid.identify(df.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "doc_id": F.col("doc_id") + 7}), model).collect()}
    assert a == b


def test_a_mixture_scores_alike_at_every_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and n_chars > 300")
    model, texts = queries.trained(docs), {}
    for r in docs.where(langid.held_out()).orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).append(r.text)
    for lang in sorted(texts):
        others = " ".join(" ".join(t[:3]) for o, t in sorted(texts.items()) if o != lang)
        own = " ".join(texts[lang])
        mixture = own + " " + (others * (len(own) // len(others) + 1))[: len(own) // 9] + " "
        short, long = model.predict(mixture), model.predict(mixture * (2_000_000 // len(mixture) + 1))
        assert short[0] == long[0] == lang and short[2] == long[2] and abs(short[1] - long[1]) < 0.01


def test_signs_that_are_no_letters_have_no_language(spark):
    model = langid.train(spark.createDataFrame([("one two three", "en"), ("un deux trois", "fr")], "text string, lang string"))
    assert {model.predict(t)[0] for t in ("½ ²", "Ⅷ ①", "12 ٣", "!? _", "😀")} == {"und"}
    assert "und" not in {model.predict(t)[0] for t in ("½ x", "中", "ª", "1é")}
    assert model.predict("½ ²")[1] == 0.0


def test_predictions_equal_the_definition(spark):
    """Margins, losses and scores worked out row by row with plain dictionaries."""
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = queries.trained(docs)

    def bucket(gram):
        h = len(gram)
        for b in gram:
            h = (h * 257 + b) & 0xFFFFFFFF
        return (h * 2654435761 & 0xFFFFFFFF) >> 19

    rows = docs.where("text is not null").orderBy("doc_id").collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for r in rows[:60]:
        if not any(c.isalpha() for c in r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        data = b" " + b" ".join(bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in r.text.lower().encode()).split()) + b" "
        counts = Counter(bucket(data[i : i + n]) for n in (1, 2, 3) for i in range(len(data) - n + 1))
        total, loss = sum(counts.values()), []
        trust = [h / sum(model.half) for h in model.half]
        margin = [max(-3, min(3, (sum(c * float(model.weights[g, b]) for g, c in counts.items()) / total - model.middle[b]) / model.half[b])) for b in range(model.code.shape[1])]
        for word in model.code:
            loss.append(sum(t * math.log1p(math.exp(-2 * int(w) * m)) for t, w, m in zip(trust, word, margin)))
        chance = [math.exp(-4 * (x - min(loss))) for x in loss]
        best = loss.index(min(loss))
        assert got[r.doc_id][0] == model.langs[best] and abs(got[r.doc_id][1] - chance[best] / sum(chance)) < 1e-6
