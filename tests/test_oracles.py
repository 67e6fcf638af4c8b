"""Every query with an oracle gives the rows that DuckDB gives."""

import duckdb
import pytest

from lodestore import registry
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, sf, name):
    mine = registry.queries()[name](spark, sf)
    found = rows(mine.columns, [tuple(r) for r in mine.collect()])
    other = duck.execute(registry.oracle_sql()[name])
    assert found == rows([d[0] for d in other.description], other.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_hard_split_of_texts_without_a_word(spark, tmp_path):
    """They have no piece, as in the SQL; what is white space only for Java or Unicode is a word."""
    texts = [None, "", " ", "\n \t\f\r", " " * 5000, "\x0b", "\xa0", "\u2028", "\0 \0", "a", "\n a \r\n", " " + "a\n" * 100 + "\t", "a " * 101]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    mine = registry.queries()["hard_split_chk03"](spark, str(tmp_path))
    got = mine.collect()
    other = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").execute(registry.oracle_sql()["hard_split_chk03"])
    assert rows(mine.columns, [tuple(r) for r in got]) == rows([d[0] for d in other.description], other.fetchall())
    assert {r["doc_id"] for r in got} == set(range(5, len(texts)))
