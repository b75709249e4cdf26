"""Registered queries against their SQL, on the given tables and on awkward rows."""

import compare
import duckdb
import pytest
from llm_tables import awkward

import __spark_entry__ as driver
from alarmloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    mine = QUERIES[name](spark, SF).toPandas()
    assert compare.difference(mine, compare.connect(SF).execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op3_decontamination", "op10_substring_dedup"])
def test_query_equals_sql_on_awkward_rows(spark, tmp_path, name):
    docs = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(1, "one"), (2, None), (3, "one, two"), (4, "")], "item_id long, text string")
    items.coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    mine = QUERIES[name](spark, str(tmp_path)).toPandas()
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        path = next((tmp_path / f"{table}.parquet").glob("*.parquet"))
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    assert compare.difference(mine, duck.execute(ORACLES[name]).df()) is None
