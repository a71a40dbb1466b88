from pyspark.sql import functions as F

import corpus_pipeline
from engramlake.llm import decontam, linededup
from cases import empty, odd
from test_similar import components

D = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    steps = []
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, D)
        steps.append((name, {r.doc_id: r for r in df.collect()}))
        if name != "tokens":
            assert df.columns == docs.columns
    language, lines, near, clean, tokens = (s for _, s in steps)
    assert set(language) == {i for i, r in rows.items() if any(c.isalpha() for c in r.text)}
    hosts = {}
    for r in language.values():
        hosts.setdefault(r.source, {})[r.text] = set(x.strip(" ") for x in r.text.split("\n"))
    for i, r in language.items():
        pages = hosts[r.source]
        bad = {x for x in pages[r.text] if x and (n := sum(x in p for p in pages.values())) >= 4 and n > linededup.RATIO * len(pages)}
        want = "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in bad)
        assert lines[i].text == want and lines[i].n_chars == (len(want) if want != r.text else r.n_chars)
    root = components({i: r.text for i, r in lines.items()})
    assert set(near) == {i for i in lines if root[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(w[k : k + 5]) for w in [decontam.words_of(t)] for k in range(max(1, len(w) - 4))}
    sets = [grams(t) for _, t in items]
    for i, r in near.items():
        own = grams(r.text)
        assert (i in clean) == (not any(5 * len(s & own) >= 4 * len(s) for s in sets))
    assert set(tokens) == set(clean)


def test_run_and_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "word")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [i for _, i in got] == [6, 7, 8, 9, 12, 13, 0]


def test_empty_run(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
