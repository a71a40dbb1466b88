import zlib

import pytest
from pyspark.sql import functions as F

from engramlake.llm import linededup, queries, sharding
from engramlake.sources.versions import Versions
from cases import empty, odd, odd_rows
from compare import connect, same


def test_lines_equal_sql(spark):
    d = "/root/testdata/sf0.01"
    same(queries.op8_line_dedup(spark, d), connect(d), linededup.SQL)


def pages(spark):
    rows = [(i, f"head\nbody {i}\n\nfoot", "h") for i in range(10)] + [(100 + i, "copied\nstory", "h") for i in range(50)] + [(200, "head\nother", "lone"), (201, None, "h")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_boilerplate_goes_and_copies_stay(spark):
    got = {r.doc_id: r for r in linededup.drop_lines(pages(spark)).collect()}
    assert got[3].text == "body 3\n" and got[3]._n_dropped == 2 and got[120].text == "copied\nstory" and got[200].text == "head\nother" and got[201].text is None


def test_join_without_broadcast(spark, monkeypatch):
    want = sorted(map(str, linededup.drop_lines(pages(spark)).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_LINES", -1)
    assert sorted(map(str, linededup.drop_lines(pages(spark)).collect())) == want


def test_odd_lines(spark):
    out = linededup.drop_lines(odd(spark))
    assert out.count() == len(odd_rows()) and out.columns[:-2] == odd(spark).columns
    assert linededup.digest(empty(spark)).count() == 0


def test_clashing_columns_pass_through(spark):
    names = ["_host", "_lines", "_kept", "_page", "_text", "_bhost", "_row", "_all"]
    rows = pages(spark).select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    got = {r.doc_id: r for r in linededup.drop_lines(rows).collect()}
    assert got[3].text == "body 3\n" and all(got[3][n] == f"own {n}" for n in names)
    with pytest.raises(ValueError, match="_n_lines"):
        linededup.drop_lines(rows.withColumn("_n_lines", F.lit(1)))


def test_shards(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op9_sharding(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    want = {r.doc_id: (len(r.text.encode()) + 8, zlib.crc32(r.text.encode())) for r in docs.itertuples()}
    assert len(got) == len(docs) and dict(zip(got["doc_id"], zip(got["size"], got["text_crc32"]))) == want
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    sizes = got.groupby("shard")["size"].sum()
    assert set(sizes.index) == set(range(24)) and sizes.max() - sizes.min() <= got["size"].median()


def test_rebalancing_edits_the_map(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = sharding.slot_map(sharding.slot_sizes(sharding.sized(d.where("doc_id < 500"))))
    records = sharding.slot_sizes(sharding.sized(d))
    second = sharding.slot_map(records, previous=first)
    a, b = ({r.vslot: r.shard for r in m.collect()} for m in (first, second))
    load = lambda m: [sum(r.bytes for r in records.collect() if m[r.vslot] == s) for s in range(24)]
    assert second.first().version == 2 and max(load(b)) - min(load(b)) < max(load(a)) - min(load(a))
    assert sum(a[s] == b[s] for s in a) > 0.8 * len(a)


def test_the_map_is_kept_and_edited(spark, tmp_path):
    d, folder = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tmp_path / "map")
    show = lambda df: {r.doc_id: (r.shard, r.map_version) for r in df.collect()}
    first = show(sharding.assign(d.where("doc_id < 600"), folder))
    assert show(sharding.assign(d.where("doc_id < 600"), folder)) == first and {v for _, v in first.values()} == {1}
    grown = sharding.assign(d, folder)
    second = show(grown)
    assert {v for _, v in second.values()} == {2} and sum(second[i][0] == s for i, (s, _) in first.items()) > 0.8 * len(first)
    sizes = [r["n"] for r in grown.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.1 * max(sizes)
    assert Versions(spark, folder).numbers() == [1, 2]


def test_lost_and_rival_writers(spark, tmp_path, monkeypatch):
    """A writer lost before its rename does not hinder the next run; of two runs at once the later one goes on from the other's version."""
    d, folder = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tmp_path / "map")
    sharding.assign(d.where("doc_id < 400"), folder)
    (tmp_path / "map" / "data-lost" / "map").mkdir(parents=True)
    (tmp_path / "map" / "unpublished-lost").write_text("{")
    assert {r.map_version for r in sharding.assign(d.where("doc_id < 600"), folder).collect()} == {2}
    publish, once = Versions.publish, []

    def late(self, tables, *, base, **more):
        if not once:
            once.append(1)
            publish(self, {"map": sharding.slot_map(sharding.slot_sizes(sharding.sized(d.where("doc_id < 700"))), previous=base.table("map"))}, base=base)
        return publish(self, tables, base=base, **more)

    monkeypatch.setattr(Versions, "publish", late)
    assert {r.map_version for r in sharding.assign(d, folder).collect()} == {4}


def test_fewer_shards(spark, tmp_path):
    """25 shards, then 24: the last one's slots go to the others, few of the rest move."""
    d, folder = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tmp_path / "map")
    many = {r.doc_id: r.shard for r in sharding.assign(d, folder, 25).collect()}
    got = sharding.assign(d, folder, 24)
    fewer = {r.doc_id: r.shard for r in got.collect()}
    assert set(many.values()) == set(range(25)) and set(fewer.values()) == set(range(24))
    assert sum(fewer[i] == s for i, s in many.items() if s < 24) > 0.5 * len(many)
    sizes = [r["n"] for r in got.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert max(sizes) - min(sizes) < 0.1 * max(sizes)


def test_odd_shards(spark, tmp_path):
    got = sharding.assign(odd(spark), str(tmp_path / "a")).collect()
    assert len(got) == len(odd_rows()) and {r.size for r in got if r.doc_id in (1, 2)} == {8} and sharding.assign(empty(spark), str(tmp_path / "b")).count() == 0
    assert {r.text_crc32 for r in got if r.doc_id == 1} == {0}


def test_plans_are_native(spark, tmp_path):
    plan = sharding.assign(odd(spark), str(tmp_path / "a"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
