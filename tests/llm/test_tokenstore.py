import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from engramlake.llm import tokenstore
from cases import empty, odd, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def stream(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [tokenstore.END_ID]


def test_cuts_cover_and_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40_000, 20_000).astype("<u2")
    cut = lambda x: tokenstore.cuts(len(x), tokenstore.marks(x).tolist())
    ends = cut(ids)
    assert ends[-1] == len(ids) and all(b - a <= tokenstore.MOST for a, b in zip([0, *ends], ends)) and len(ends) > 30
    longer = np.concatenate([ids[:100], ids])
    moved = cut(longer)
    chunks = lambda x, e: {x[a:b].tobytes() for a, b in zip([0, *e], e)}
    assert len(chunks(ids, ends) & chunks(longer, moved)) > 0.9 * len(ends)
    assert cut(ids[:0]) == [] and cut(ids[:5]) == [5]
    assert cut(np.zeros(10_000, "<u2"))[-1] == 10_000


def test_joined_crc():
    parts = [b"abc", b"", b"defgh" * 100, b"x"]
    assert tokenstore.joined_crc((zlib.crc32(p), len(p)) for p in parts) == zlib.crc32(b"".join(parts))


def test_round_trip(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 10] + [odd_rows()[9]]
    df = spark.createDataFrame(rows, odd(spark).schema)
    folder = str(tmp_path / "store")
    tokenstore.store(df, PATH, folder)
    got = [tuple(r) for r in tokenstore.read_store(spark, folder).orderBy("doc_id").collect()]
    want, start = [], 0
    for r in sorted(rows, key=lambda r: r[0]):
        ids = stream(r[1])
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    ids = {r.doc_id: r.ids for r in tokenstore.ids_of(spark, folder, [4, 6]).collect()}
    assert ids == {4: stream("word"), 6: stream(rows[5][1])}
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("chunk").distinct().count()
    order = spark.read.parquet(f"{folder}/manifest").where("page = -1 and segment >= 0").orderBy("first_id").collect()
    assert all(a.last_id < b.first_id for a, b in zip(order, order[1:]))


def test_damage_is_found(spark, tmp_path):
    folder = str(tmp_path / "store")
    tokenstore.store(odd(spark).where("doc_id in (4, 6)"), PATH, folder)
    spark.read.parquet(f"{folder}/chunks").selectExpr("chunk", "cast(reverse(cast(hex(payload) as string)) as binary) payload").write.parquet(f"{folder}/bad")
    import shutil

    shutil.rmtree(f"{folder}/chunks")
    shutil.move(f"{folder}/bad", f"{folder}/chunks")
    with pytest.raises(Exception, match="content"):
        tokenstore.read_store(spark, folder).collect()


@pytest.mark.parametrize("what", ["lost", "swapped", "root"])
def test_changed_recipes_are_found(spark, tmp_path, what, monkeypatch):
    monkeypatch.setattr(tokenstore, "PAGE", 2)
    folder = str(tmp_path / "store")
    tokenstore.store(odd(spark), PATH, folder)
    assert tokenstore.read_store(spark, folder).count() == 14
    rows = spark.read.parquet(f"{folder}/recipes")
    if what == "lost":  # one of the files
        import glob
        import os

        os.remove(max(glob.glob(f"{folder}/recipes/part*"), key=os.path.getsize))
    else:
        changed = rows.withColumn("n_tokens", rows.n_tokens + (rows.doc_id == 6).cast("int")) if what == "swapped" else rows.where("segment >= 0 and (doc_id is null or doc_id <> 4)")
        changed.write.parquet(f"{folder}/new")
        import shutil

        shutil.rmtree(f"{folder}/recipes")
        shutil.move(f"{folder}/new", f"{folder}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        tokenstore.read_store(spark, folder)


def test_empty_table(spark, tmp_path):
    tokenstore.store(empty(spark), PATH, str(tmp_path / "store"))
    assert tokenstore.read_store(spark, str(tmp_path / "store")).count() == 0


def test_library_encoder_equals_the_library():
    enc = tokenstore.library_encoder(PATH)
    for text in ["Hello, World! it's 42", "a<|endoftext|>b", "é È ½ ª", "x" * 600, "中文 Σς\x1c", "a\x85b", None, ""]:
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == stream(text)[:-1]
