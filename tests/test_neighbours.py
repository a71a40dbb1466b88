"""The persisted neighbour index against reading everything, and versions of tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramlake.operators import neighbours, search
from engramlake.sources.versions import Conflict, Versions


def made(spark, vectors, presets=2):
    rows = [(i, f"p{i % presets}", "active" if i % 9 else "archived", v.tolist() if v is not None else None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "memory_id long, preset_id string, status string, embedding array<float>")
    return df.withColumns({"type": F.lit("fact"), "source_conversation_id": F.lit(None).cast("string")}).repartition(4)


def clustered(rng, n, around, dim=16):
    centre = rng.normal(size=(around, dim))
    return centre[rng.integers(0, around, n)] + 0.03 * rng.normal(size=(n, dim))


def keeper(folder):
    at = iter(range(10**6))

    def stored(df, name):
        path = f"{folder}/tmp-{next(at)}-{name}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return stored


@pytest.mark.parametrize("kind", ["clustered", "uniform", "equal"])
def test_same_as_reading_everything(spark, tmp_path, kind):
    """Recall 1 on all; on clustered vectors at most a quarter of the cells is read."""
    rng = np.random.default_rng(4)
    vectors = {"clustered": lambda: clustered(rng, 3000, 40), "uniform": lambda: rng.normal(size=(1200, 16)), "equal": lambda: np.tile(rng.normal(size=16), (900, 1))}[kind]()
    df = made(spark, vectors)
    stored = keeper(tmp_path)
    version = neighbours.build(df, str(tmp_path / "ann"), stored, dimension=16, cell_rows=64)
    assert version.number == 1 and version.counts["rows"] == len(vectors)
    sizes = version.table("rows").groupBy("cell").count()
    cells = version.table("cells")
    assert sizes.agg(F.max("count")).first()[0] <= (64 if kind != "equal" else 128) and cells.count() == sizes.count() > 10
    queries = spark.createDataFrame([(t, [float(x) for x in vectors[i]]) for t, i in enumerate((0, 7, 500))], "text_no int, vector array<float>")
    for where in ({}, {"preset": "p1"}):
        got, read = neighbours.search(version, queries, 10, stored=stored, **where)
        want = search.knn(df, queries, 10, **where)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("text_no", "memory_id", "cosine").collect()))
        if kind == "clustered":
            assert read.count() <= 3 * cells.count() / 4


def test_radii_cover_their_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    version = neighbours.build(made(spark, rng.normal(size=(800, 8))), str(tmp_path / "ann"), keeper(tmp_path), dimension=8, cell_rows=50)
    about = {r.cell: r for r in version.table("cells").collect()}
    for r in version.table("rows").collect():
        c = about[r.cell]
        v = np.array(r.embedding) / np.linalg.norm(r.embedding)
        assert np.arccos(np.clip(v @ np.array(c.centre) / np.linalg.norm(c.centre), -1, 1)) <= c.radius + 1e-6


def test_ready_gate_and_pinned_readers(spark, tmp_path):
    """A preset without all its vectors is refused; a reader keeps its version while another is published."""
    rng = np.random.default_rng(1)
    vectors = list(rng.normal(size=(40, 8)))
    root, stored = str(tmp_path / "ann"), keeper(tmp_path)
    first = neighbours.build(made(spark, vectors), root, stored, dimension=8)
    vectors[3] = None  # of preset p1
    second = neighbours.build(made(spark, vectors), root, stored, dimension=8)
    assert (first.number, second.number, Versions(spark, root).newest().number) == (1, 2, 2)
    q = spark.createDataFrame([(0, [1.0] * 8)], "text_no int, vector array<float>")
    assert neighbours.search(first, q, 5, preset="p1", stored=stored)[0].count() == 5
    assert neighbours.search(second, q, 5, preset="p0", stored=stored)[0].count() == 5
    with pytest.raises(RuntimeError, match="dirty.*1 rows without a vector"):
        neighbours.search(second, q, 5, preset="p1", stored=stored)
    with pytest.raises(RuntimeError, match="missing"):
        neighbours.search(second, q, 5, preset="p7", stored=stored)


def test_empty(spark, tmp_path):
    version = neighbours.build(made(spark, []), str(tmp_path / "ann"), keeper(tmp_path), dimension=8)
    q = spark.createDataFrame([(0, [1.0] * 8)], "text_no int, vector array<float>")
    assert version.counts["rows"] == 0 and neighbours.search(version, q, 3)[0].count() == 0


def test_versions(spark, tmp_path):
    """Lost writers, two writers from one version, wrong counts, retired versions."""
    store = Versions(spark, str(tmp_path / "v"))
    assert store.newest() is None
    one = store.publish({"t": spark.range(5)}, base=None, facts={"model": "m"})
    (tmp_path / "v" / "data-lost" / "t").mkdir(parents=True)  # a writer that was lost before its manifest
    (tmp_path / "v" / "unpublished-lost").write_text("{")  # and one lost before its rename
    two = store.publish({"t": spark.range(6)}, base=store.newest(), expected={"t": 6})
    with pytest.raises(Conflict):
        store.publish({"t": spark.range(7)}, base=one)
    with pytest.raises(RuntimeError, match="has 8 rows, not 9"):
        store.publish({"t": spark.range(8)}, base=two, expected={"t": 9})
    assert store.numbers() == [1, 2] and one.table("t").count() == 5 and store.newest().table("t").count() == 6 and store.open(1).facts == {"model": "m"}
    three = store.publish({"t": spark.range(9)}, base=store.newest())
    store.retire(keep=2)
    assert store.numbers() == [2, 3] and three.table("t").count() == 9 and two.table("t").count() == 6
