import duckdb
import pytest

from mensura.llm import queries


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("p1_found", "p7_shares")])
def test_query_runs(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert df.count() > 0


def test_columns(spark, small):
    want = {"p3_found": ["row_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, small).columns == columns


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("extended_with_ocr", "paper_headers", "relation_methods", "variable_guide"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = sorted(con.execute(queries.ORACLES[name]).fetchall())
    assert want and sorted(map(tuple, queries.QUERIES[name](spark, small).collect())) == want


def test_small_tables_are_never_cut(spark, tmp_path, small):
    """A word list or a list of methods that is longer than it may be is an error, not a shorter list."""
    from mensura.llm import queries

    spark.range(10_001).selectExpr("'en' lang", "concat('w', id) word").write.parquet(f"{tmp_path}/common_words.parquet")
    with pytest.raises(ValueError, match="common_words"):
        queries._common_words(spark, str(tmp_path))
    spark.range(10_000).selectExpr("'en' lang", "concat('w', id) word").write.mode("overwrite").parquet(f"{tmp_path}/common_words.parquet")
    assert len(queries._common_words(spark, str(tmp_path)).hashes) == 10_000
