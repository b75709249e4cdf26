import pytest
from pyspark.sql import functions as F

from alarmloom.functions import numbers
from alarmloom.functions.packets import epoch_timestamp, ipv4_text, tcp_flag_names
from alarmloom.operators import clean, scale

INF, NAN = float("inf"), float("nan")


def test_zero_rows_are_dropped_and_missing_ones_kept(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (None,), (NAN,), (-0.0,)], "duration double")
    assert clean.drop_zero(rows, "duration").count() == 3


def test_numbers_are_cleaned(spark):
    rows = spark.createDataFrame([("1.5",), ("text",), (None,), ("Infinity",), ("-Infinity",), ("NaN",)], "x string")
    cleaned = clean.clean_numbers(clean.to_numbers(rows, ["x"]), ["x"])
    assert sorted(r["x"] for r in cleaned.collect()) == [0, 0, 0, 0, 0, 1.5]


def test_codes_follow_first_appearance(spark):
    rows = spark.createDataFrame([(1, "UDP"), (2, "TCP"), (3, "UDP"), (4, None), (5, "ICMP")], "no int, protocol string")
    encoded = clean.encode_by_appearance(rows, "protocol", ["no"])
    assert [r["protocol"] for r in encoded.orderBy("no").collect()] == [0, 1, 0, 2, 3]


def test_codes_per_group(spark):
    rows = spark.createDataFrame([(1, 1, "b"), (2, 1, "a"), (3, -1, "a"), (4, -1, "b")], "no int, label int, p string")
    encoded = clean.encode_by_appearance(rows, "p", ["no"], ["label"])
    assert [r["p"] for r in encoded.orderBy("no").collect()] == [0, 1, 0, 1]


def test_unknown_column_is_an_error(spark):
    with pytest.raises(KeyError):
        clean.drop_columns(spark.range(1), ["absent"])


@pytest.mark.parametrize("method,expected", [("zscore", -1.0690449676), ("min-max", 0.0)])
def test_scalers(spark, tmp_path, method, expected):
    rows = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "x double, c double")
    scaler = scale.fit_scaler(rows, ["x", "c"], method)
    first = scaler.transform(rows).orderBy("x").first()
    assert first["x"] == pytest.approx(expected) and first["c"] == 0
    unseen = spark.createDataFrame([(10.0, 9.0)], "x double, c double")
    assert scaler.transform(unseen).first()["c"] == 2.0
    scaler.save(spark, str(tmp_path / "scaler"))
    assert scale.Scaler.load(spark, str(tmp_path / "scaler")) == scaler


def test_unknown_scaler(spark):
    with pytest.raises(ValueError):
        scale.fit_scaler(spark.range(1), ["id"], "none")


def test_packet_expressions(spark):
    row = spark.range(1).select(
        tcp_flag_names(F.lit(0x12)).alias("a"),
        tcp_flag_names(F.lit(0x19)).alias("b"),
        tcp_flag_names(F.lit(0)).alias("c"),
        tcp_flag_names(F.lit(0x3F)).alias("d"),
        ipv4_text(F.lit(0xC0A80001)).alias("e"),
        F.unix_micros(epoch_timestamp(F.lit(1700000000.123456))).alias("f"),
    ).first()
    assert row["a"] == "SYN+ACK" and row["b"] == "ACK+FIN+PSH" and row["c"] == "OTHER"
    assert row["d"] == "SYN+ACK+FIN+RST+PSH+URG" and row["e"] == "192.168.0.1" and row["f"] == 1700000000123456


def test_thresholds(spark):
    rows = spark.createDataFrame([(0.1,), (0.2,), (0.9,)], "x double")
    row = rows.agg(numbers.robust_floor(F.col("x")).alias("low"), numbers.mean_plus(F.col("x"), 1).alias("high")).first()
    assert row["low"] == 0 and row["high"] == pytest.approx(0.4 + 0.3559026)
    labels = rows.select(numbers.label_by_threshold(F.col("x"), F.lit(0.2)).alias("l")).collect()
    assert [r["l"] for r in labels] == [1, 1, -1]
