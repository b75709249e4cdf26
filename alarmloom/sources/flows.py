"""Flow tables and alarm lists from CSV files."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from alarmloom.functions.numbers import number_or_null
from alarmloom.operators.ordering import number_rows

FILE, BLOCK, LINE = "_file", "_block", "_line"


def read_flow_file(spark: SparkSession, path: str) -> DataFrame:
    """One CSV with a header; every column is text. A missing path is an error."""
    return spark.read.option("header", True).option("enforceSchema", False).csv(path)


def read_flows(spark: SparkSession, path: str, mixed: bool = False) -> DataFrame:
    """All `.csv` files of a folder with a `flow_identifier` of file stem and index.

    The index is the `index` column where there is one, else the row's place in
    its file, from 0. Files must share their header, which Spark checks, unless
    mixed is set: files are then read per header and united by column name.
    """
    if not mixed:
        return _with_identifier(_scan(spark, path))
    groups: dict[str, list[str]] = {}
    for row in _headers(spark, path):
        groups.setdefault(row["header"], []).append(row["file"])
    return union_flows([_with_identifier(_scan(spark, files)) for _, files in sorted(groups.items())])


def _scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.option("pathGlobFilter", "*.csv").csv(path)


def _headers(spark: SparkSession, path: str) -> list:
    """First line of every file: one short row per file."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path)
    opening = lines.where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("line")
    )
    return (
        opening.groupBy("file")
        .agg(F.min_by("value", "line").alias("header"))
        .orderBy("file")
        .collect()
    )


def _with_identifier(flows: DataFrame) -> DataFrame:
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.csv$", "")
    stem = F.url_decode(stem)
    if "index" in flows.columns:
        return flows.withColumn("flow_identifier", F.concat(stem, F.lit("_flow_"), F.col("index")))
    placed = flows.withColumns(
        {FILE: stem, BLOCK: F.col("_metadata.file_block_start"), LINE: F.monotonically_increasing_id()}
    )
    numbered = number_rows(placed, [FILE], [BLOCK, LINE], "_place")
    place = (F.col("_place") - 1).cast("string")
    return numbered.withColumn("flow_identifier", F.concat(FILE, F.lit("_flow_"), place)).drop(
        FILE, BLOCK, LINE, "_place"
    )


def union_flows(tables: list[DataFrame]) -> DataFrame:
    """Tables of unequal columns, united by name; missing columns are null."""
    if not tables:
        raise ValueError("no tables to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def numeric_columns(flows: DataFrame, kept: list[str]) -> DataFrame:
    """Every column but the kept ones as double; text that is no number becomes null."""
    return flows.withColumns({c: number_or_null(F.col(c)) for c in flows.columns if c not in kept})


def read_alarms(spark: SparkSession, path: str, detectors: list[str]) -> DataFrame:
    """Membership table: `id` and one 0/1 column per detector."""
    table = spark.read.option("header", True).csv(path)
    flags = [
        (F.coalesce(F.col(d).try_cast("bigint"), F.lit(0)) if d in table.columns else F.lit(0).cast("bigint")).alias(d)
        for d in detectors
    ]
    return table.select(F.col("ID").alias("id"), *flags)


def alarms_with_capture(alarms: DataFrame, packets: DataFrame, alarm_id: str = "id") -> DataFrame:
    """Alarms whose flow has packets."""
    captured = packets.select(F.col("case_id").alias(alarm_id)).distinct()
    return alarms.join(captured, alarm_id, "left_semi")


def captures_with_label(packets: DataFrame, label: str) -> DataFrame:
    """Ids of the captures that carry a label."""
    return packets.where(F.col("label") == label).select(F.col("case_id").alias("id")).distinct()
