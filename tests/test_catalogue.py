import pytest

from tidemark.plans import catalogue, histories, speech, state, texts, views  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(name, spark, same):
    own = catalogue.QUERIES[name](spark, SF)
    rows = same(own, catalogue.ORACLE_SQL[name], SF) if name in catalogue.ORACLE_SQL else own.count()
    assert rows, "no rows to compare"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "lang", "n_chars"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
