import pytest

from engramlake.plans import catalogue
from engramlake.sources.tables import Views

from compare import connect, same
from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    same(catalogue.queries()[name](spark, SMALL), con, catalogue.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["text_no", "memory_id", "cosine", "match_count", "boosted"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "written"), [("speaker_links", set()), ("knn_exact", set()), ("neighbour_search", set()), ("hybrid_search", {"mem_kw"})])
def test_memories_are_not_written_whole_for_a_few_columns(spark, monkeypatch, name, written):
    monkeypatch.setattr(Views, "_written", {})
    assert catalogue.queries()[name](spark, SMALL).count() > 0
    assert {key[2] for key in Views._written} == written


@pytest.mark.parametrize("name", ["dream_bisect", "dream_clusters"])
def test_groups_take_no_texts(spark, monkeypatch, name):
    monkeypatch.setattr(Views, "_written", {})
    assert catalogue.queries()[name](spark, SMALL).count() > 0
    assert {key[2] for key in Views._written} == {"vectors"}
