import pytest
from pyspark.sql import functions as F

from alarmloom.operators import bands, profiles


@pytest.mark.parametrize(
    "tp,fp,recall,precision",
    [
        ((1009, 2694, 10433, 10, 0), (0, 0, 0, 24, 22), (0.0713, 0.2618, 0.9993, 1.0, 1.0), (1.0, 1.0, 1.0, 0.9983, 0.9968)),
        ((0, 106, 13658, 362, 20), (0, 0, 1, 17, 29), (0.0, 0.0075, 0.9730, 0.9986, 1.0), (0.0, 1.0, 0.9999, 0.9987, 0.9967)),
        ((1059, 66, 10474, 2547, 0), (0, 0, 0, 4, 9), (0.0749, 0.0795, 0.8199, 1.0, 1.0), (1.0, 1.0, 1.0, 0.9997, 0.9991)),
    ],
)
def test_published_band_counts(spark, tp, fp, recall, precision):
    inside = [0.005, 0.1, 0.5, 0.9, 0.999]
    rows = [("TP", i, n) for i, n in enumerate(tp)] + [("FP", i, n) for i, n in enumerate(fp)]
    cells = spark.createDataFrame([(label, inside[i], n) for label, i, n in rows], "label string, mean_similarity double, n int")
    traces = cells.where("n > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n"))))
    table = bands.band_table(bands.with_band(traces)).orderBy("cut").collect()
    assert [r["tp_count"] for r in table] == list(tp) and [r["fp_count"] for r in table] == list(fp)
    assert [round(r["recall"], 4) for r in table] == list(recall)
    assert [round(r["precision"], 4) for r in table] == list(precision)


def test_bounds_belong_to_the_lower_band(spark):
    values = [0.0, 0.01, 0.25, 0.75, 0.99, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "mean_similarity double")
    found = [r["band"] for r in bands.with_band(rows).orderBy("mean_similarity").collect()]
    assert found == ["BAND_0_1", "BAND_0_1", "BAND_1_25", "BAND_25_75", "BAND_75_99", "BAND_99_100"]


def test_empty_input_has_all_bands(spark):
    empty = spark.createDataFrame([], "label string, mean_similarity double")
    table = bands.band_table(bands.with_band(empty)).collect()
    assert len(table) == 5 and all(r["tp_count"] == 0 and r["recall"] == 0 and r["precision"] == 0 for r in table)
    assert bands.band_similarity_means(bands.with_band(empty)).count() == 10


def vectors(spark, rows):
    return spark.createDataFrame(rows, "case_id string, state string, activity string, value double")


def test_cosine(spark):
    profile = spark.createDataFrame([("S", "a", 3.0), ("S", "b", 4.0), ("Z", "a", 0.0)], "state string, activity string, value double")
    held = vectors(
        spark,
        [("same", "S", "a", 6.0), ("same", "S", "b", 8.0), ("half", "S", "a", 1.0), ("other", "S", "c", 5.0),
         ("zero", "Z", "a", 1.0), ("none", "Q", "a", 1.0)],
    )
    found = {r["case_id"]: r["similarity"] for r in profiles.cosine_to_profile(held, profile, ["case_id", "state"]).collect()}
    assert found == {"same": pytest.approx(1.0), "half": pytest.approx(0.6), "other": 0.0, "zero": 0.0}
    with pytest.raises(KeyError):
        profiles.require_profiles(held, profile)


def test_control_flow_profile_truncates_over_traces_with_the_activity(spark):
    counts = spark.createDataFrame(
        [("t1", "S", "a", 2), ("t2", "S", "a", 3), ("t1", "S", "b", 5)], "case_id string, state string, activity string, n long"
    )
    found = {r["activity"]: r["value"] for r in profiles.control_flow_profile(counts).collect()}
    assert found == {"a": 2.0, "b": 5.0}


def test_pooled_similarity_keeps_training_states(spark):
    one = spark.createDataFrame([("S", "a", 1.0), ("T", "a", 1.0)], "state string, activity string, value double")
    other = spark.createDataFrame([("S", "a", 9.0), ("U", "a", 1.0)], "state string, activity string, value double")
    found = {r["state"]: r["similarity"] for r in profiles.state_similarity_pooled(one, other).collect()}
    assert found == {"S": 1.0, "T": 0.0}


def test_alignment_level(spark):
    counts = spark.createDataFrame(
        [("TP", "t", "S0", "a", 2), ("TP", "t", "S1", "a", 4), ("TP", "t", "S0", "b", 9)],
        "label string, case_id string, state string, activity string, n long",
    )
    assert bands.alignment_levels(counts).first()["alignment_level"] == 6.0
