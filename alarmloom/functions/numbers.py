"""Column expressions for guarded arithmetic and number cleaning."""

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, 0 where the denominator is 0 or missing."""
    share = numerator.cast("double") / denominator.cast("double")
    return F.when(denominator != 0, share).otherwise(F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    """Missing, NaN and infinite numbers become 0."""
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(number)


def number_or_null(value: Column) -> Column:
    """Text that is no number becomes null instead of an error."""
    return value.try_cast("double")


def mean_plus(value: Column, k: float) -> Column:
    """Aggregate: mean plus k population standard deviations."""
    return F.avg(value) + F.lit(float(k)) * F.stddev_pop(value)


def robust_floor(value: Column, k: float = 2.0) -> Column:
    """Aggregate: mean minus k population standard deviations, never below 0."""
    return F.greatest(F.lit(0.0), mean_plus(value, -k))


def label_by_threshold(score: Column, threshold: Column) -> Column:
    """-1 where the score lies strictly above the threshold, else 1."""
    return F.when(score > threshold, F.lit(-1)).otherwise(F.lit(1)).cast("int")
