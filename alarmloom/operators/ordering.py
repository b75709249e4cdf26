"""Ordered work inside groups (row numbers, running totals, next row, first row).

Every operator has two layouts. When no group is longer than one task should
sort, a plain window function is used. Otherwise a group is cut into pieces by
its order column, the window runs inside the pieces, and one small row per
piece carries the running state across the cut. Results are the same.
"""

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from alarmloom.operators.sizing import GROUP_ROWS, longest_group, small_side

MAX_PIECES = 4096
_PIECE = "_piece"


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str = "row_no",
    limit: int = GROUP_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Dense 1-based row number inside each group of keys, by the order columns."""
    if longest is None:
        longest = longest_group(df, keys)
    if longest <= limit:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(out, position.cast("bigint"))

    pieces = _cut_long_groups(df, keys, order[0], limit)
    piece_keys = [*keys, _PIECE]
    earlier = Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*piece_keys)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier))
        .where("_before > 0")
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*piece_keys).orderBy(*order))
    return (
        pieces.withColumn("_local", local.cast("bigint"))
        .join(offsets, piece_keys, "left")
        .withColumn(out, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop(_PIECE, "_local", "_before")
    )


def _cut_long_groups(df: DataFrame, keys: list[str], order_col: str, limit: int) -> DataFrame:
    """Add a piece number that follows order_col; short groups keep one piece.

    Cut points are quantiles of a sample of the long groups, so that a piece
    holds a bounded share of them however skewed the keys are.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    total = sizes.agg(F.sum("_n").alias("n")).first()["n"]
    long_keys = small_side(sizes.select(*keys))
    wanted = min(MAX_PIECES, math.ceil(2 * total / limit))
    share = min(1.0, 40 * wanted / total)
    # The share above fixes the expected sample size at 40 rows per piece.
    value = _comparable(df, order_col)
    sample = df.join(long_keys, keys, "left_semi").select(value.alias("v")).where("v is not null")
    values = sorted(row["v"] for row in sample.sample(share, seed=7).collect())
    step = max(1, len(values) // wanted)
    cuts = sorted(set(values[step::step]))
    marked = df.join(long_keys.withColumn("_long", F.lit(True)), keys, "left")
    if not cuts:
        return marked.withColumn(_PIECE, F.lit(0)).drop("_long")
    found = _interval(marked.withColumn("_value", F.coalesce(value, F.lit(cuts[0]))), cuts)
    piece = F.when(F.col("_long") & value.isNotNull(), F.col("_interval")).otherwise(F.lit(0))
    return found.withColumn(_PIECE, piece).drop("_long", "_value", "_interval")


def _interval(df: DataFrame, cuts: list) -> DataFrame:
    """Column `_interval`: how many cut points are not above `_value`."""
    if not isinstance(cuts[0], str):
        # Rounding to double keeps the order, so intervals still follow the values.
        splits = sorted({float(cut) for cut in cuts})
        bucketizer = Bucketizer(
            splits=[-math.inf, *splits, math.inf], inputCol="_number", outputCol="_interval"
        )
        numbers = df.withColumn("_number", F.col("_value").cast("double"))
        return bucketizer.transform(numbers).withColumn("_interval", F.col("_interval").cast("int")).drop("_number")
    bounds = np.array(cuts, dtype=object)

    @F.pandas_udf("int")
    def interval(held: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, held.to_numpy(), side="right").astype("int32"))

    return df.withColumn("_interval", interval("_value"))


def _comparable(df: DataFrame, name: str) -> Column:
    """The order column as a number or text, for comparison with cut points."""
    kind = df.schema[name].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind == "date":
        return F.unix_date(name)
    return F.col(name)


def piece_column(position: str, split: int) -> Column:
    return F.floor(F.col(position) / F.lit(split)).cast("bigint")


def running_total(
    df: DataFrame, keys: list[str], position: str, value: Column, out: str, split: int | None = None
) -> DataFrame:
    """Sum of value over the group up to and including the row, by position."""
    if split is None:
        so_far = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(so_far))
    pieces = df.withColumn(_PIECE, piece_column(position, split)).withColumn("_value", value)
    piece_keys = [*keys, _PIECE]
    inside = Window.partitionBy(*piece_keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*piece_keys)
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_before", F.sum("_sum").over(earlier))
        .drop("_sum")
    )
    return (
        pieces.withColumn("_local", F.sum("_value").over(inside))
        .join(offsets, piece_keys, "left")
        .withColumn(out, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop(_PIECE, "_local", "_before", "_value")
    )


def next_row(
    df: DataFrame, keys: list[str], position: str, columns: list[str], out: str, split: int | None = None
) -> DataFrame:
    """Struct of the columns of the next row in the group; null on the last row."""
    return _neighbour(df, keys, position, columns, out, split, F.lead, F.min_by)


def previous_row(
    df: DataFrame, keys: list[str], position: str, columns: list[str], out: str, split: int | None = None
) -> DataFrame:
    """Struct of the columns of the previous row in the group; null on the first row."""
    return _neighbour(df, keys, position, columns, out, split, F.lag, F.max_by)


def _neighbour(df, keys, position, columns, out, split, step, edge_row) -> DataFrame:
    held = F.struct(*columns)
    if split is None:
        return df.withColumn(out, step(held).over(Window.partitionBy(*keys).orderBy(position)))
    pieces = df.withColumn(_PIECE, piece_column(position, split))
    piece_keys = [*keys, _PIECE]
    across = (
        pieces.groupBy(*piece_keys)
        .agg(edge_row(held, position).alias("_edge"))
        .withColumn("_across", step("_edge").over(Window.partitionBy(*keys).orderBy(_PIECE)))
        .drop("_edge")
    )
    inside = Window.partitionBy(*piece_keys).orderBy(position)
    return (
        pieces.withColumn("_inside", step(held).over(inside))
        .join(across, piece_keys, "left")
        .withColumn(out, F.coalesce("_inside", "_across"))
        .drop(_PIECE, "_inside", "_across")
    )


def first_value(
    df: DataFrame, keys: list[str], position: str, value: Column, out: str, split: int | None = None
) -> DataFrame:
    """Value of the first row of the group, on every row."""
    if split is None:
        whole = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.first(value).over(whole))
    facts = df.groupBy(*keys).agg(F.min_by(value, position).alias(out), F.max(position).alias("_last"))
    return join_per_group(df, facts, keys, position, split, "left")


def join_per_group(
    df: DataFrame, facts: DataFrame, keys: list[str], position: str, split: int | None, how: str
) -> DataFrame:
    """Join rows to one fact row per group, without one task per long group.

    With a split, facts must hold the last position of the group in `_last`; the
    fact row is repeated once per piece, and the join runs per piece.
    """
    if split is None:
        return df.join(facts.drop("_last"), keys, how)
    numbers = F.sequence(F.lit(0).cast("bigint"), piece_column("_last", split))
    per_piece = facts.withColumn(_PIECE, F.explode(numbers)).drop("_last")
    pieces = df.withColumn(_PIECE, piece_column(position, split))
    return pieces.join(per_piece, [*keys, _PIECE], how).drop(_PIECE)
