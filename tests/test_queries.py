"""Every registered query against its SQL, and all others for a stable schema."""

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from alarmloom.operators.ordering import number_rows
from alarmloom.registry import fixtures as fx

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine = QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    assert compare.difference(mine, theirs) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert len(rows) > 0


CUT = [
    "alarm_bands",
    "client_direction",
    "packets_with_features",
    "state_event_log",
    "event_durations",
    "unordered_capture_log",
    "unordered_event_durations",
    "directly_follows",
    "variant_filtered_log",
    "training_sync_moves",
    "state_similarity_timing",
    "capture_ingest",
]


@pytest.mark.parametrize("name", CUT)
def test_query_equals_sql_when_flows_are_cut(spark, duck, monkeypatch, name):
    """The layout for flows that are too long for one task gives the same results."""

    def cut_packets(session, sf_dir):
        raw = fx.raw_packets(session, sf_dir)
        return fx.Packets(number_rows(raw, fx.CASE, ["ts", "event_id"], "packet_no", limit=9), 9)

    def cut_unordered(session, sf_dir):
        raw = fx.raw_packets(session, sf_dir).withColumn("_place", F.md5(F.col("event_id").cast("string").cast("binary")))
        return fx.Packets(number_rows(raw, fx.CASE, ["_place", "event_id"], "packet_no", limit=9).drop("_place"), 9)

    monkeypatch.setattr(fx, "packets", cut_packets)
    monkeypatch.setattr(fx, "unordered_packets", cut_unordered)
    mine = QUERIES[name](spark, SF).toPandas()
    assert compare.difference(mine, duck.execute(ORACLES[name]).df()) is None


def test_entry(spark, duck):
    """The flagship query gives the five bands of its SQL."""
    mine = driver.entry(spark).toPandas()
    assert len(mine) == 5
    assert compare.difference(mine, duck.execute(ORACLES["alarm_bands"]).df()) is None
