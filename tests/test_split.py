import math

import pytest
from pyspark.sql import functions as F

from alarmloom.operators import split


def members(df):
    return {r["id"] for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 1001])
@pytest.mark.parametrize("share", [0.4, 0.14])
def test_holdout_size_is_exact(spark, n, share):
    parts = split.holdout(spark.range(n).withColumnRenamed("id", "id"), "id", share)
    assert parts.where("part = 'test'").count() == math.ceil(round(n * share, 9)) == split.expected_size(n, share)
    assert parts.count() == n


def test_holdout_does_not_depend_on_partitions(spark):
    rows = spark.range(5000)
    one = members(split.holdout(rows.repartition(1), "id").where("part = 'test'"))
    many = members(split.holdout(rows.repartition(13), "id").where("part = 'test'"))
    assert one == many
    assert one != members(split.holdout(rows, "id", seed=43).where("part = 'test'"))


def test_detection_parts(spark):
    flows = spark.range(1000).withColumn("label", F.when(F.col("id") < 700, 1).otherwise(-1))
    counts = {
        (r["part"], r["label"]): r["count"] for r in split.detection_parts(flows, "id").groupBy("part", "label").count().collect()
    }
    assert counts == {("test", 1): 280, ("test", -1): 300, ("validation", 1): 59, ("train", 1): 361}


def test_trace_split_rounds_down(spark):
    rows = spark.createDataFrame(
        [("S0", f"c{i}") for i in range(9)] + [("S1", f"c{i}") for i in range(4)], "state string, case_id string"
    )
    parts = split.split_traces(rows, ["state"])
    held = {r["state"]: r["n"] for r in parts.groupBy("state").agg(F.count_if(F.col("part") == "validation").alias("n")).collect()}
    assert held == {"S0": 1, "S1": 0}


def test_repeated_split(spark):
    alarms = spark.createDataFrame([(f"f{i}", int(i < 7), int(i == 3), 0) for i in range(10)], "id string, a int, b int, c int")
    rated = spark.createDataFrame([("t1",), ("t2",)], "id string")
    rows = split.repeated_alarm_split(alarms, rated, ["a", "b", "c"])
    sizes = {
        (r["repetition"], r["detector"], r["phase"], r["label"]): r["count"]
        for r in rows.groupBy("repetition", "detector", "phase", "label").count().collect()
    }
    for r in range(1, 6):
        assert sizes[r, "a", "training", "FP"] == 3 and sizes[r, "a", "inference", "FP"] == 4
        assert sizes[r, "b", "training", "FP"] == 1 and (r, "b", "inference", "FP") not in sizes
        assert (r, "c", "training", "FP") not in sizes
        assert all(sizes[r, d, "inference", "TP"] == 2 for d in "abc")
    trained = [members(rows.where(f"repetition = {r} and detector = 'a' and phase = 'training'")) for r in range(1, 6)]
    assert len({frozenset(t) for t in trained}) > 1


@pytest.mark.parametrize("ranked,prefix", [(200_000, 4), (3, 1), (1, 2)])
def test_ranks_are_found_by_digits(spark, monkeypatch, ranked, prefix):
    monkeypatch.setattr(split, "RANKED_ROWS", ranked)
    monkeypatch.setattr(split, "PREFIX", prefix)
    rows = spark.range(500).selectExpr("id % 180 as id").repartition(3)
    hashed = rows.withColumn("_hash", split.rank_hash(7, F.col("id")))
    ordered = sorted((r["_hash"], r["id"]) for r in hashed.collect())
    wanted = [1, 2, 0, 77, 250, 251, 499, 500]
    found = split.rank_cuts(hashed, "id", lambda n: wanted if n == 500 else None)
    assert found == [ordered[r - 1] if r else None for r in wanted]
    assert split.rank_cuts(hashed.limit(0), "id", lambda n: [n, 0]) == [None, None]


def test_shares_follow_each_other(spark):
    rows = spark.range(1000)
    one, two, three = split.in_shares(rows, "id", [0.4, 0.14, 1.0], 42)
    counts = rows.select(*(F.count_if(c).alias(n) for c, n in ((one, "a"), (two, "b"), (three, "c"), (one & two, "both")))).first()
    assert tuple(counts) == (400, 84, 516, 0)
