"""Event logs, process models and training profiles on disk.

Parquet tables partitioned by label and state are the store. XES files, one
folder per label and state, are for exchange with other tools: every trace is one
`trace` element. A caller that knows its reader may ask for pieces, so that no row
has to hold a whole trace.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from alarmloom.operators.ordering import piece_column

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

_ATTRIBUTES = T.ArrayType(
    T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())])
)
_TRACE = T.StructType(
    [
        T.StructField("string", _ATTRIBUTES),
        T.StructField("int", _ATTRIBUTES),
        T.StructField(
            "event",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("string", _ATTRIBUTES),
                        T.StructField("date", _ATTRIBUTES),
                        T.StructField("int", _ATTRIBUTES),
                    ]
                )
            ),
        ),
    ]
)


def write_event_log(events: DataFrame, path: str) -> None:
    """Parquet, one folder per label and state; logs without events get none."""
    events.write.mode("overwrite").partitionBy("label", "state").parquet(path)


def read_event_log(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    events = spark.read.parquet(path)
    return events if label is None else events.where(F.col("label") == label)


def _attribute(key: str, value) -> Column:
    return F.array(F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value")))


def write_xes(events: DataFrame, path: str, piece: int | None = None) -> None:
    """One XES folder per label and state; with a piece length, longer traces are several elements of one name."""
    event = F.struct(
        F.col("event_no"),
        _attribute("concept:name", F.col("activity")).alias("string"),
        _attribute("time:timestamp", F.date_format("ts", STAMP)).alias("date"),
        _attribute("payload_size", F.col("payload_size")).alias("int"),
    )
    fields = ("string", "date", "int")
    held = F.transform(
        F.array_sort(F.collect_list(event)), lambda e: F.struct(*[e[name].alias(name) for name in fields])
    )
    traces = (
        events.withColumn("_piece", F.lit(0) if piece is None else piece_column("event_no", piece))
        .groupBy("label", "state", "case_id", "_piece")
        .agg(held.alias("event"))
        .select(
            "label",
            "state",
            _attribute("concept:name", F.col("case_id")).alias("string"),
            _attribute("piece", F.col("_piece")).alias("int"),
            "event",
        )
    )
    writer = traces.write.mode("overwrite").partitionBy("label", "state").format("xml")
    writer.option("rootTag", "log").option("rowTag", "trace").save(path)


def read_xes(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Events of XES folders; label and state come from the folder names."""
    traces = spark.read.format("xml").option("rowTag", "trace").schema(_TRACE).load(path)
    if label is not None:
        traces = traces.where(F.col("label") == label)

    def value(attributes: Column, key: str) -> Column:
        return F.element_at(F.filter(attributes, lambda a: a["_key"] == key), 1)["_value"]

    order = F.coalesce(value(F.col("int"), "piece").try_cast("bigint"), F.lit(0))
    rows = traces.select(
        "label",
        "state",
        value(F.col("string"), "concept:name").alias("case_id"),
        order.alias("_piece"),
        F.posexplode("event").alias("_at", "_event"),
    )
    return rows.select(
        "label",
        "state",
        "case_id",
        "_piece",
        F.col("_at").cast("bigint").alias("_at"),
        value(F.col("_event.string"), "concept:name").alias("activity"),
        F.to_timestamp(value(F.col("_event.date"), "time:timestamp"), STAMP).alias("ts"),
        value(F.col("_event.int"), "payload_size").try_cast("bigint").alias("payload_size"),
    )


def numbered_xes(events: DataFrame, piece: int | None = None) -> DataFrame:
    """Event numbers of a log written by write_xes with the same piece length."""
    first_piece_shift = F.when(F.col("_piece") == 0, F.lit(1)).otherwise(F.lit(0))
    number = F.col("_piece") * F.lit(piece or 0) + F.col("_at") + first_piece_shift
    return events.withColumn("event_no", number).drop("_piece", "_at")


def write_model(tree: DataFrame, nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    for name, table in (("tree", tree), ("nodes", nodes), ("arcs", arcs)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tree")


def read_net(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/arcs")


def write_profiles(profiles: dict[str, DataFrame], similarities: dict[str, DataFrame], path: str, digits=None) -> None:
    """Training profiles and state similarities by perspective; digits rounds the values."""

    def shown(table: DataFrame, column: str) -> DataFrame:
        return table if digits is None else table.withColumn(column, F.round(column, digits))

    for name, table in profiles.items():
        shown(table, "value").write.mode("overwrite").parquet(f"{path}/training_profile/perspective={name}")
    for name, table in similarities.items():
        shown(table, "similarity").write.mode("overwrite").parquet(f"{path}/training_similarity/perspective={name}")


def read_profile(spark: SparkSession, path: str, perspective: str) -> DataFrame:
    table = spark.read.parquet(f"{path}/training_profile")
    return table.where(F.col("perspective") == perspective).drop("perspective")


def read_similarity(spark: SparkSession, path: str, perspective: str) -> DataFrame:
    table = spark.read.parquet(f"{path}/training_similarity")
    return table.where(F.col("perspective") == perspective).drop("perspective")
