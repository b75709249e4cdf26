"""Alarm bands over mean similarity, with cumulative precision and recall."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alarmloom.functions.numbers import ratio
from alarmloom.schema import BANDS, FALSE_ALARM, TRUE_ALARM

TRACE = ["label", "case_id"]


def band_of(similarity: Column, bands: list[tuple[str, float | None]] = BANDS) -> Column:
    """Name of the band; a value on a bound belongs to the lower band."""
    last = bands[-1][0]
    return reduce(
        lambda rest, band: F.when(similarity <= F.lit(band[1]), F.lit(band[0])).otherwise(rest),
        reversed(bands[:-1]),
        F.lit(last),
    )


def with_band(similarities: DataFrame, bands=BANDS) -> DataFrame:
    return similarities.withColumn("band", band_of(F.col("mean_similarity"), bands))


def band_table(banded: DataFrame, grid: list[str] = (), bands=BANDS) -> DataFrame:
    """Per cut k: counts per band, and recall and precision of the first k bands.

    All bands are present. One aggregate counts every band; the cumulative
    values are expressions over its single row per grid cell.
    """

    def counted(name: str, label: str) -> Column:
        return F.count_if((F.col("band") == name) & (F.col("label") == label))

    counts = [counted(n, TRUE_ALARM).alias(f"tp_{i}") for i, (n, _) in enumerate(bands)] + [
        counted(n, FALSE_ALARM).alias(f"fp_{i}") for i, (n, _) in enumerate(bands)
    ]
    all_tp = sum((F.col(f"tp_{i}") for i in range(1, len(bands))), F.col("tp_0"))
    rows, tp, fp = [], F.lit(0), F.lit(0)
    for i, (name, _) in enumerate(bands):
        tp, fp = tp + F.col(f"tp_{i}"), fp + F.col(f"fp_{i}")
        rows.append(
            F.struct(
                F.lit(i + 1).cast("bigint").alias("cut"),
                F.lit(name).alias("band"),
                F.col(f"tp_{i}").alias("tp_count"),
                F.col(f"fp_{i}").alias("fp_count"),
                ratio(tp, all_tp).alias("recall"),
                ratio(tp, tp + fp).alias("precision"),
            )
        )
    totals = banded.groupBy(*grid).agg(*counts) if grid else banded.agg(*counts)
    return totals.select(*grid, F.explode(F.array(*rows)).alias("_r")).select(*grid, "_r.*")


def alignment_levels(counts: DataFrame, trace: list[str] = TRACE, value: str = "n") -> DataFrame:
    """Mean over the activities of a trace of the mean count over its states."""
    per_activity = counts.groupBy(*trace, "activity").agg(F.avg(value).alias("_mean"))
    return per_activity.groupBy(*trace).agg(F.avg("_mean").alias("alignment_level"))


def band_alignment_levels(
    levels: DataFrame, banded: DataFrame, trace: list[str] = TRACE, grid: list[str] = ()
) -> DataFrame:
    """Mean alignment level by band and label."""
    joined = levels.join(banded, trace)
    return joined.groupBy(*grid, "band", "label").agg(F.avg("alignment_level").alias("mean_total_alignments"))


def band_activity_means(
    counts: DataFrame, banded: DataFrame, trace: list[str] = TRACE, grid: list[str] = (), value: str = "n"
) -> DataFrame:
    """Mean count per activity by band and label, over trace and state.

    Counts hold one row per trace, state and activity, so the join key of a
    trace repeats only as often as it has states and activities.
    """
    joined = counts.join(banded, trace)
    return joined.groupBy(*grid, "band", "label", "activity").agg(F.avg(value).alias("mean_alignments"))


def band_similarity_means(banded: DataFrame, grid: list[str] = (), bands=BANDS) -> DataFrame:
    """Mean similarity of every band and label, 0 where a band is empty."""

    def mean_of(name: str, label: str) -> Column:
        chosen = F.when((F.col("band") == name) & (F.col("label") == label), F.col("mean_similarity"))
        return F.coalesce(F.avg(chosen), F.lit(0.0))

    cells = [(name, label) for name, _ in bands for label in (TRUE_ALARM, FALSE_ALARM)]
    means = [mean_of(name, label).alias(f"m_{i}") for i, (name, label) in enumerate(cells)]
    totals = banded.groupBy(*grid).agg(*means) if grid else banded.agg(*means)
    rows = [
        F.struct(F.lit(name).alias("band"), F.lit(label).alias("label"), F.col(f"m_{i}").alias("mean_similarity"))
        for i, (name, label) in enumerate(cells)
    ]
    return totals.select(*grid, F.explode(F.array(*rows)).alias("_r")).select(*grid, "_r.*")


def similarities_of(similarities: DataFrame, label: str) -> DataFrame:
    return similarities.where(F.col("label") == label)
