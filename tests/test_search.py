"""Literal cases of hybrid scoring: threshold, bonus, ties, blank keywords, filters before the cut."""

from pyspark.sql import functions as F

from engramlake.operators import browse, index, search


def at_angle(c):
    return [float(c), float((1 - c * c) ** 0.5)]


def make(spark, rows, words):
    mem = spark.createDataFrame([(i, at_angle(c)) for i, c in rows], "memory_id string, embedding array<float>").withColumns({"preset_id": F.lit("p"), "status": F.lit("active"), "type": F.lit("fact"), "source_conversation_id": F.lit(None).cast("string")})
    kw = spark.createDataFrame([(i, w) for i, ws in words.items() for w in ws], "memory_id string, keyword string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "text_no int, vector array<float>")
    return mem, kw, q


def test_scores_and_cut(spark):
    mem, kw, q = make(spark, [("semantic-alpha", 0.9), ("keyword-high", 0.7), ("keyword-low", 0.2), ("semantic-only", 0.6)], {"semantic-alpha": ["alpha", "beta"], "keyword-high": ["alpha"], "keyword-low": ["beta", "alpha"]})
    got = search.hybrid(mem, kw, q, [" Alpha ", "beta"], 2, 0.5).orderBy(F.col("boosted").desc()).collect()
    assert [(r.memory_id, round(r.cosine, 4), r.match_count, round(r.boosted, 4)) for r in got] == [("semantic-alpha", 0.9, 2, 1.2), ("keyword-high", 0.7, 1, 0.85)]


def test_below_threshold_scores_by_keyword_alone(spark):
    mem, kw, q = make(spark, [("a", 0.2), ("b", 0.1)], {"a": ["x", "y"]})
    got = search.hybrid(mem, kw, q, ["x", "y"], 5, 0.5).collect()
    assert [(r.memory_id, r.cosine, r.boosted) for r in got] == [("a", 0.0, 0.6)]


def test_zero_threshold_drops_negative_cosine_only_with_keywords(spark):
    mem, kw, q = make(spark, [("a", -0.5), ("b", 0.5)], {"b": ["x"]})
    assert search.hybrid(mem, kw, q, [" "], 5, 0.0).count() == 2
    assert search.hybrid(mem, kw, q, ["x"], 5, 0.0).count() == 1


def test_ties_by_id_and_empty_requests(spark):
    mem, kw, q = make(spark, [("c", 0.5), ("a", 0.5), ("b", 0.5)], {"a": ["x"]})
    assert sorted(r.memory_id for r in search.knn(mem, q, 2).collect()) == ["a", "b"]
    assert search.knn(mem, q, 0).count() == 0 and search.knn(mem, q, 5, types=[]).count() == 0
    assert search.knn(mem, q, 5, exclude=["a"]).count() == 2


def test_one_pass_equals_two_stages(spark):
    """Cutting the semantic side first, then joining keyword hits, gives the same rows."""
    mem, kw, q = make(spark, [(f"m{i:02d}", -1 + i / 20) for i in range(41)], {f"m{i:02d}": ["x"] * (i % 3 == 0) + ["y"] * (i % 5 == 0) for i in range(41)})
    for k in (1, 3, 8):
        for low in (0.0, 0.3):
            near = {r.memory_id: r.cosine for r in search.knn(mem, q, k).collect()}
            count = {r.memory_id: r.match_count for r in search.keyword_match(mem, kw, ["x", "y"]).collect()}
            cos = {r.memory_id: r.cosine for r in search.scored(mem, q).collect()}
            found = {}
            for i in {*near, *count}:
                n = count.get(i, 0)
                if cos[i] >= low:
                    found[i] = round(cos[i] + 0.15 * n, 6)
                elif n:
                    found[i] = round(0.3 * n, 6)
            want = sorted(found.items(), key=lambda p: (-p[1], p[0]))[:k]
            got = search.hybrid(mem, kw, q, ["x", "y"], k, low).orderBy(F.col("boosted").desc(), "memory_id").collect()
            assert [(r.memory_id, r.boosted) for r in got] == want


def test_filters_reach_the_scan(spark, tmp_path):
    mem, _, q = make(spark, [("a", 0.5), ("b", 0.1)], {})
    mem.write.parquet(str(tmp_path / "mem"))
    plan = search.knn(spark.read.parquet(str(tmp_path / "mem")), q, 2, preset="p", types=["fact"])._jdf.queryExecution().toString()
    assert "EqualTo(preset_id,p)" in plan and "EqualTo(status,active)" in plan


def test_missing_entry_fails(spark):
    import pytest

    mem, _, q = make(spark, [("a", 0.5)], {})
    hits = search.knn(mem, q, 1).withColumn("rank", F.lit(1))
    assert search.hydrate(hits, mem, "type").count() == 1
    with pytest.raises(Exception, match="no entry"):
        search.hydrate(hits, mem.where("false"), "type").collect()


def test_facets_and_pages(spark):
    rows = [(f"{i:03d}", "fact" if i % 3 == 0 else "preference", "active" if i < 90 else "archived", i) for i in range(150)]
    df = spark.createDataFrame(rows, "memory_id string, type string, status string, updated_at int").withColumns({"speaker_keys": F.array().cast("array<string>"), "content": F.lit("c"), "summary": F.lit(None).cast("string"), "sentiment": F.lit(None).cast("string"), "keywords": F.array(F.lit("K"))})
    f = {(r.status, r.type): r.n for r in browse.facets(df).collect()}
    assert (f["active", "all"], f["archived", "all"], f["all", "all"]) == (90, 60, 150)
    assert (f["active", "fact"], f["active", "preference"], f["archived", "fact"], f["archived", "preference"]) == (30, 60, 20, 40)
    assert len(f) == 21 and f["active", "plan"] == 0
    assert browse.list_memories(df, size=100_000).count() == 100 and browse.list_memories(df, page=0, size=0).count() == 20
    assert browse.list_memories(df, keyword="k", size=100).count() == 100 and browse.list_memories(df, keyword="zz").count() == 0


def test_preserve_needs_a_stored_vector(spark):
    import pytest

    idx = spark.createDataFrame([("a", "h", [1.0])], "memory_id string, content_hash string, embedding array<float>")
    none = idx.where("false")
    ups = spark.createDataFrame([("a", "n", None)], idx.schema)
    assert index.apply_mutation(idx, ups, none).first().embedding == [1.0]
    with pytest.raises(Exception, match="no vector"):
        index.apply_mutation(idx.where("false"), ups, none).collect()


def test_a_failing_reranker_costs_the_order_only(spark):
    """Three times as many candidates are asked for; rows without a score drop out; a raising model gives the hybrid rows."""
    mem, kw, q = make(spark, [(f"m{i:02d}", i / 20) for i in range(20)], {})
    content = mem.select("memory_id", F.col("memory_id").alias("content"))
    ask = lambda model: [(r.memory_id, r.relevance, r.failed) for r in search.reranked_search(mem, kw, q, [], 3, 0.0, model, content=content).orderBy("rank").collect()]
    assert ask(lambda texts: [None if t == "m12" else -int(t[1:]) for t in texts]) == [("m11", -11.0, False), ("m13", -13.0, False), ("m14", -14.0, False)]
    plain = [("m19", None, True), ("m18", None, True), ("m17", None, True)]

    def broken(texts):
        raise OSError("model is gone")

    assert ask(broken) == plain and ask(lambda texts: [1.0]) == plain


def test_hybrid_scans_each_table_once(spark, tmp_path):
    mem, kw, q = make(spark, [("a", 0.2), ("b", 0.9)], {"a": ["x"]})
    mem.write.parquet(str(tmp_path / "mem"))
    kw.write.parquet(str(tmp_path / "kw"))
    stored = [spark.read.parquet(str(tmp_path / n)) for n in ("mem", "kw")]
    plan = search.hybrid(*stored, q, ["x"], 5, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2
