"""Scores, alarm lists, reports, band results and split layouts on disk."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from alarmloom.schema import FALSE_ALARM, TRUE_ALARM


def write_scores(scored: DataFrame, path: str) -> None:
    """Anomaly score per flow, one folder per model."""
    rows = scored.select("model", F.col("id").alias("flow_id"), F.col("score").alias("anomaly_score"))
    rows.write.mode("overwrite").partitionBy("model").parquet(path)


def write_alarm_lists(alarms: DataFrame, path: str) -> None:
    """False positive and false negative ids; a list without ids has no folder."""
    alarms.write.mode("overwrite").partitionBy("model", "kind").parquet(path)


def read_alarm_list(spark: SparkSession, path: str, detector: str, kind: str = "false_positives") -> DataFrame:
    rows = spark.read.schema("id string, model string, kind string").parquet(path)
    return rows.where((F.col("model") == detector) & (F.col("kind") == kind)).select("id")


def write_membership(members: DataFrame, path: str) -> None:
    members.withColumnRenamed("id", "ID").write.mode("overwrite").option("header", True).csv(path)


def write_metrics_report(report: DataFrame, path: str) -> None:
    """Four decimals; an empty report is written as a header only."""
    measures = ["accuracy", "precision", "recall", "f1_score", "specificity", "fpr", "fnr"]
    shown = report.withColumns({c: F.format_string("%.4f", F.col(c)) for c in measures})
    shown.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def band_document(bands: DataFrame, levels: DataFrame, activities: DataFrame, means: DataFrame) -> DataFrame:
    """Nested result, one row per cut, as it is written to JSON.

    All inputs hold one row per band, label and activity at most.
    """
    per_band = F.map_from_entries(F.collect_list(F.struct("band", "v")))

    def by_label(table: DataFrame, value: str) -> DataFrame:
        pairs = F.map_from_entries(F.collect_list(F.struct("label", value)))
        return table.groupBy("band").agg(pairs.alias("v")).agg(per_band.alias(value))

    per_activity = activities.groupBy("band", "label").agg(
        F.map_from_entries(F.collect_list(F.struct("activity", "mean_alignments"))).alias("mean_alignments")
    )
    counts = bands.agg(
        F.map_from_entries(F.collect_list(F.struct("band", "tp_count"))).alias("tp_bands"),
        F.map_from_entries(F.collect_list(F.struct("band", "fp_count"))).alias("fp_bands"),
    )
    stats = [
        by_label(levels, "mean_total_alignments"),
        by_label(per_activity, "mean_alignments"),
        by_label(means, "mean_similarity"),
    ]
    one = F.lit(1).alias("_one")
    whole = counts.select("*", one)
    for table in stats:
        whole = whole.join(table.select("*", one), "_one")
    cuts = bands.select("cut", F.col("band").alias("band_threshold"), "recall", "precision", one)
    return cuts.join(whole, "_one").select(
        "cut",
        F.struct(
            "band_threshold",
            F.col("recall").alias("recall_sigma"),
            F.col("precision").alias("precision_sigma"),
            "tp_bands",
            "fp_bands",
            F.struct(
                "mean_total_alignments", F.col("mean_alignments").alias("mean_alignments_per_activity"), "mean_similarity"
            ).alias("band_stats"),
        ).alias("result"),
    )


def write_band_results(document: DataFrame, similarities: DataFrame, path: str) -> None:
    """Band results, and mean similarity per trace for either label, as JSON lines."""
    document.coalesce(1).write.mode("overwrite").json(f"{path}/results")
    for label, name in ((TRUE_ALARM, "tp_similarities"), (FALSE_ALARM, "fp_similarities")):
        chosen = similarities.where(F.col("label") == label).select("case_id", "mean_similarity")
        chosen.write.mode("overwrite").json(f"{path}/{name}")


def write_named_values(spark: SparkSession, values: dict[str, float], path: str) -> None:
    """Single numbers such as a fitness threshold, as rows of name and value."""
    rows = [(name, float(value)) for name, value in values.items()]
    spark.createDataFrame(rows, "name string, value double").coalesce(1).write.mode("overwrite").parquet(path)


def read_named_value(spark: SparkSession, path: str, name: str) -> float:
    row = spark.read.parquet(path).where(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    return row["value"]


def write_split(split: DataFrame, path: str) -> None:
    """Split members laid out by repetition, detector, phase and label."""
    split.write.mode("overwrite").partitionBy("repetition", "detector", "phase", "label").parquet(path)
