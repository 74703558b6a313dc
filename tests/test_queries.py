"""Every query against its SQL, and every other query for rows and a stable schema."""

import pytest
from conftest import DATA

from docloom.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(name, spark):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_long_texts_are_whole(spark, tmp_path):
    from docloom.plans.views import eis

    text = "".join(f"w{i} " for i in range(8000)) + "the very end"
    spark.createDataFrame([(1, text)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = eis(spark, str(tmp_path)).first().text
    assert text[:700] in got and text[700:1600] in got and text[1600:] in got
