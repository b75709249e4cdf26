"""Size checks that decide how a plan is laid out."""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows of one ordered group that a single task is asked to sort.
GROUP_ROWS = 1_000_000
# Rows that may be held by the driver and sent to every executor.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after the row count is known to be small.

    At most max_rows + 1 rows reach the driver. A larger table is returned
    unhinted, so that Spark joins it by shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def held_side(df: DataFrame, n_rows: int) -> DataFrame:
    """Hint a broadcast for a table made from rows the driver holds, if they are few."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def held_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as part of the plan; no job and no Python worker reads them."""
    kind = StructType.fromDDL(schema)
    columns = zip(*rows) if rows else [[]] * len(kind)
    fields = to_arrow_schema(kind)
    table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields)
    return spark.createDataFrame(table, kind)


def join_by_weight(
    df: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Inner or left semi join with facts that hold one row per key.

    The weight column tells how many rows of df have the key. Small facts are
    broadcast. Large ones are joined by shuffle, except for their heavy keys:
    at most one key per GROUP_ROWS rows of df can be heavy, and those are
    broadcast, so no task gets all rows of a heavy key.
    """
    small = small_side(facts, max_rows)
    if small is not facts:
        return df.join(small.drop(weight), keys, how)
    heavy = small_side(facts.where(F.col(weight) > GROUP_ROWS), max_rows).drop(weight)
    light = facts.where(F.col(weight) <= GROUP_ROWS).drop(weight)
    rest = df.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how)
    return df.join(heavy, keys, how).unionByName(rest)


def longest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group; counts are combined before the shuffle."""
    top = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()
    return int(top["n"] or 0)


def split_rows(longest: int, limit: int = GROUP_ROWS) -> int | None:
    """Piece length for ordered work, or None when every group fits one task."""
    return None if longest <= limit else limit


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names, or one below its warehouse; never a machine-local one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables that a job writes and reads back."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
