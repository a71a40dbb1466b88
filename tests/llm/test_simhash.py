import numpy as np
import xxhash
from pyspark.sql import functions as F

from engramlake.llm import simhash
from cases import empty, odd


def slow(text):
    words = (text or "").encode().translate(simhash.LOWER).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(spark):
    texts = [None, "", "a", "A b", "x y z", "The quick  brown\tfox\njumps é É", "w " * 300]
    assert [simhash.fingerprint(t) & (2**64 - 1) for t in texts] == [slow(t) for t in texts]
    # Spark's xxhash64 is the same hash
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def check(spark, fps):
    from engramlake.llm.common import Tables, connected_components

    fps = np.unique(fps)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    tables = Tables(spark)
    found = {r.node: r.root for r in connected_components(simhash.links(df, tables), tables).collect()}
    got = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_links_of_random_clouds(spark):
    rng = np.random.default_rng(2)
    out = []
    for _ in range(40):
        c = rng.integers(0, 2**63, dtype=np.uint64)
        for _ in range(rng.integers(1, 8)):
            x = c
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            out.append(x)
    check(spark, np.array(out, dtype=np.uint64))


def test_crowded_variants_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 5)
    rng = np.random.default_rng(3)
    c, out = rng.integers(0, 2**63, dtype=np.uint64), []
    for _ in range(150):
        x = c
        for b in rng.choice(64, rng.integers(0, 8), replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        out.append(x)
    check(spark, np.array(out, dtype=np.uint64))


def test_nothing_that_grows_goes_through_the_driver(spark, monkeypatch):
    """Small as these tables are, no join sends fingerprints, points, labels or kept ids whole: at scale the driver has no room for them."""
    from engramlake.llm import common

    plans, written = [], common._written

    def recorded(df, path, *more):
        plans.append((path.rsplit("/", 1)[1], df._jdf.queryExecution().executedPlan().toString()))
        return written(df, path, *more)

    monkeypatch.setattr(common, "_written", recorded)
    monkeypatch.setattr(simhash, "CROWD", 2)
    words = "one two three four five six seven eight nine ten".split()
    docs = spark.createDataFrame([(i, " ".join(words * 40 + [words[i % 7]])) for i in range(30)], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 30 and simhash.one_of_each(docs).count() == 1
    assert {"points", "labels", "edges", "components", "kept", "one"} <= {name.split("-")[0] for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan and not name.startswith("sets")] == []


def test_odd_rows(spark):
    df = odd(spark).where("doc_id is not null")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 9, 10)] == [1, 1, 1, 9, 9] and got[1].fp == 0
    kept = simhash.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 9, 12, 13]
    assert kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0
