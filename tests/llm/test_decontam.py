import pytest
from pyspark.sql import functions as F

from engramlake.llm import decontam, queries
from cases import empty, odd, odd_rows, words
from compare import connect, same


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    same(queries.op10_decontamination(spark, d), connect(d), queries.DECONTAMINATION_SQL)


def grams(text):
    w = decontam.words_of(text)
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("n", [5, 6, 9, 10, 14, 40, 200])
def test_every_containment_is_found(n):
    """Whatever shingles are missing, as long as the share holds, the signature finds the item."""
    import random

    rng = random.Random(n)
    item = words(n, 17)
    index = decontam.Index([(1, item)])
    for _ in range(40):
        w = item.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "other"
        text = words(2000) + " . " + " ".join(w) + " " + words(100, 999)
        share = len(grams(item) & grams(text)) / len(grams(item))
        assert [i for i, _ in index.search(text)] == ([1] if share >= 0.8 else [])


def test_case_and_punctuation(spark):
    index = decontam.Index([(7, "One two, three four five six seven.")])
    assert index.search("x ONE TWO THREE -- four Five six; seven y") == [(7, 1.0)] and index.search("one two three four") == []


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    show = lambda df: sorted((r.doc_id, tuple(r["items"]), r.max_containment) for r in df.collect())
    want, kept = show(decontam.contaminated(docs, items)), decontam.without_contaminated(docs, items).count()
    real = decontam.blocks
    monkeypatch.setattr(decontam, "blocks", lambda d, i, t: real(d, i, t, 500))
    assert len(decontam.blocks(items, "item_id", "text")) > 1
    assert show(decontam.contaminated(docs, items)) == want and decontam.without_contaminated(docs, items).count() == kept < docs.count()


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "Same text here today again")], "item_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in decontam.contaminated(odd(spark), items).collect()}
    assert got[4] == [3] and got[9] == [4] and got[1] == [] and got[6] == []
    out = decontam.without_contaminated(odd(spark), items)
    assert out.columns == odd(spark).columns and out.count() == len(odd_rows()) - 4
    none = items.where("false")
    assert decontam.without_contaminated(odd(spark), none).count() == len(odd_rows()) and decontam.contaminated(empty(spark), items).count() == 0


def test_blocks_give_a_row_for_each_row(spark, monkeypatch):
    items = spark.createDataFrame([(i, words(30, 31 * i)) for i in range(40)], "item_id long, text string")
    held = f"{words(30, 31 * 3)} and {words(30, 31 * 17)}"
    docs = spark.createDataFrame([(1, held), (1, held), (1, "nothing"), (None, held), (None, "nothing"), (None, None)], "doc_id long, text string")
    real = decontam.blocks
    monkeypatch.setattr(decontam, "blocks", lambda d, i, t: real(d, i, t, 500))
    assert len(decontam.blocks(items, "item_id", "text")) > 1
    got = sorted((r.doc_id or 0, list(r["items"]), r.max_containment) for r in decontam.contaminated(docs, items).collect())
    assert got == [(0, [], 0.0), (0, [], 0.0), (0, [3, 17], 1.0), (1, [], 0.0), (1, [3, 17], 1.0), (1, [3, 17], 1.0)]


def test_items_that_share_an_id_or_have_none(spark):
    items = spark.createDataFrame([(1, words(9, 1)), (1, words(9, 500)), (None, words(9, 900)), (2, words(9, 1))], "item_id long, text string")
    docs = spark.createDataFrame([(1, words(9, 1)), (2, words(9, 500)), (3, words(9, 900)), (4, f"{words(9, 1)} and {words(9, 500)}")], "doc_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == {1: [1, 2], 2: [1], 3: [None], 4: [1, 2]}


def test_partitions_by_size_have_their_own_length():
    index = decontam.Index([(n, words(n + 4, 1000 * n)) for n in (1, 2, 3, 4, 7, 8, 100)])
    assert sorted(index.partitions) == [1, 2, 4, 8, 64]
    for low, part in index.partitions.items():
        assert part.length == (2 * low - 1) - decontam.needed(2 * low - 1) + 1 and max(map(len, part.items)) >= 1
    index.partitions.clear()
    assert index.search(words(11, 7000)) == []  # nothing is found but through a partition
