"""The cut layout of ordered work gives the same rows as plain windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from alarmloom.operators import ordering, sizing

SPLIT = 10


@pytest.fixture(scope="module")
def rows(spark):
    """Group a holds most rows, c a single one; positions are unique but not dense."""
    picked = random.Random(3)
    data = []
    for key, n in (("a", 300), ("b", 12), ("c", 1)):
        for pos in sorted(picked.sample(range(1, 5 * n + 1), n)):
            stamp = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=pos)
            data.append((key, pos, f"v{pos:05d}", stamp, picked.random(), picked.randint(0, 3)))
    picked.shuffle(data)
    return spark.createDataFrame(data, "k string, pos long, name string, ts timestamp, x double, n int").repartition(5)


def same(one, other):
    assert sorted(one.columns) == sorted(other.columns)
    other = other.select(*one.columns)
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


@pytest.mark.parametrize("order", [["pos"], ["name"], ["ts"], ["x", "pos"], ["n", "pos"]])
def test_number_rows(rows, order):
    plain = ordering.number_rows(rows, ["k"], order, "no")
    cut = ordering.number_rows(rows, ["k"], order, "no", limit=SPLIT)
    same(plain, cut)
    assert plain.agg(F.max("no")).first()[0] == 300


def test_number_rows_with_missing_order_values(rows):
    holes = rows.withColumn("pos", F.when(F.col("pos") % 7 != 0, F.col("pos")))
    same(
        ordering.number_rows(holes, ["k"], ["pos", "name"], "no"),
        ordering.number_rows(holes, ["k"], ["pos", "name"], "no", limit=SPLIT),
    )


def test_running_total(rows):
    same(
        ordering.running_total(rows, ["k"], "pos", F.col("n"), "s"),
        ordering.running_total(rows, ["k"], "pos", F.col("n"), "s", SPLIT),
    )


def test_neighbours(rows):
    for step in (ordering.next_row, ordering.previous_row):
        same(step(rows, ["k"], "pos", ["ts", "n"], "o"), step(rows, ["k"], "pos", ["ts", "n"], "o", SPLIT))


def test_first_value(rows):
    same(
        ordering.first_value(rows, ["k"], "pos", F.col("name"), "f"),
        ordering.first_value(rows, ["k"], "pos", F.col("name"), "f", SPLIT),
    )


def test_join_per_group(rows):
    facts = rows.groupBy("k").agg(F.max("pos").alias("_last"), F.sum("n").alias("total")).where("k <> 'b'")
    for how in ("inner", "left", "left_semi"):
        same(
            ordering.join_per_group(rows, facts, ["k"], "pos", None, how),
            ordering.join_per_group(rows, facts, ["k"], "pos", SPLIT, how),
        )


def test_pieces_are_bounded(rows):
    cut = ordering._cut_long_groups(rows, ["k"], "pos", 30)
    sizes = cut.groupBy("k", "_piece").count()
    assert sizes.where("k = 'a'").agg(F.max("count")).first()[0] <= 60
    assert sizes.where("k <> 'a' and _piece <> 0").count() == 0


def test_small_side_is_checked(rows):
    small = sizing.small_side(rows, 1000)
    assert small is not rows and small.count() == rows.count()
    assert sizing.small_side(rows, 100) is rows


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_join_by_weight(rows, monkeypatch, how):
    monkeypatch.setattr(sizing, "GROUP_ROWS", 50)
    facts = rows.groupBy("k").agg(F.count("*").alias("w"), F.max("name").alias("top")).where("k <> 'c'")
    broadcast = sizing.join_by_weight(rows, facts, ["k"], "w", how)
    shuffled = sizing.join_by_weight(rows, facts, ["k"], "w", how, max_rows=1)
    same(broadcast, shuffled)
    assert broadcast.count() == 312


def test_cut_lineage_uses_the_named_folder(spark, rows):
    assert sizing.cut_lineage(rows).count() == 313
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()
