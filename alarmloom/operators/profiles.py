"""Activity profiles of traces and states, and their cosine similarity."""

from pyspark.sql import DataFrame, functions as F

from alarmloom.functions.numbers import ratio
from alarmloom.functions.packets import payload_or_zero
from alarmloom.operators.sizing import small_side

STATE = ["state"]


def activity_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events per trace and activity."""
    return events.groupBy(*keys, "activity").agg(F.count("*").alias("n"))


def control_flow_profile(counts: DataFrame, state: list[str] = STATE, value: str = "n") -> DataFrame:
    """Whole part of the mean count per activity, over the traces that have the activity."""
    mean_floor = F.floor(F.sum(value) / F.count("*")).cast("double")
    return counts.groupBy(*state, "activity").agg(mean_floor.alias("value"))


def timing_profile(durations: DataFrame, state: list[str] = STATE, mean: bool = False) -> DataFrame:
    """Sum of durations per activity (or their mean)."""
    pooled = F.avg("duration") if mean else F.sum("duration")
    return durations.groupBy(*state, "activity").agg(pooled.alias("value"))


def payload_profile(events: DataFrame, state: list[str] = STATE) -> DataFrame:
    """Mean payload over all events of an activity."""
    return events.groupBy(*state, "activity").agg(F.avg(payload_or_zero(F.col("payload_size"))).alias("value"))


def trace_timings(durations: DataFrame, keys: list[str]) -> DataFrame:
    """Mean duration per trace and activity, with the number of durations."""
    return durations.groupBy(*keys, "activity").agg(
        F.avg("duration").alias("value"), F.count("*").alias("n")
    )


def trace_payloads(events: DataFrame, keys: list[str]) -> DataFrame:
    """Mean payload per trace and activity, with the number of events."""
    named = events.where(F.col("case_id").isNotNull())
    mean = F.avg(payload_or_zero(F.col("payload_size")))
    return named.groupBy(*keys, "activity").agg(mean.alias("value"), F.count("*").alias("n"))


def cosine_to_profile(
    vectors: DataFrame, profile: DataFrame, keys: list[str], value: str = "value", state: list[str] = STATE
) -> DataFrame:
    """Cosine of each keyed activity vector with the profile of its state.

    Vectors of a state without a profile are left out; an empty or zero vector
    gives 0. The profile holds one row per state and activity and is broadcast
    after its size is checked.
    """
    weights = profile.select(*state, "activity", F.col("value").alias("_weight"))
    known = small_side(weights)
    norms = known.groupBy(*state).agg(F.sqrt(F.sum(F.col("_weight") * F.col("_weight"))).alias("_norm"))
    if known is not weights:
        norms = F.broadcast(norms)
    mine = F.col(value).cast("double")
    sums = (
        vectors.join(known, [*state, "activity"], "left")
        .groupBy(*keys)
        .agg(
            F.sum(mine * F.coalesce("_weight", F.lit(0.0))).alias("_dot"),
            F.sqrt(F.sum(mine * mine)).alias("_own"),
        )
    )
    cosine = ratio(F.col("_dot"), F.col("_own") * F.col("_norm"))
    return sums.join(norms, state).select(*keys, cosine.alias("similarity"))


def without_profile(vectors: DataFrame, profile: DataFrame, state: list[str] = STATE) -> DataFrame:
    """States that have traces but no training profile."""
    known = small_side(profile.select(*state).distinct())
    return vectors.select(*state).distinct().join(known, state, "left_anti")


def require_profiles(vectors: DataFrame, profile: DataFrame, state: list[str] = STATE) -> None:
    """Raise when a state has traces but no training profile."""
    missing = without_profile(vectors, profile, state).limit(10).collect()
    if missing:
        raise KeyError(f"no training profile for {[tuple(row) for row in missing]}")


def state_similarity_of_traces(
    vectors: DataFrame, profile: DataFrame, keys: list[str], value: str = "n", state: list[str] = STATE
) -> DataFrame:
    """Mean cosine of the traces of a state with its profile."""
    per_trace = cosine_to_profile(vectors, profile, keys, value, state)
    return per_trace.groupBy(*state).agg(F.avg("similarity").alias("similarity"))


def state_similarity_pooled(profile: DataFrame, other: DataFrame, state: list[str] = STATE) -> DataFrame:
    """Cosine of two profiles per state; every state of the first is kept."""
    pooled = cosine_to_profile(other, profile, state, "value", state)
    return (
        profile.select(*state)
        .distinct()
        .join(pooled, state, "left")
        .select(*state, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    )


def mean_similarity(per_state: DataFrame, trace: list[str]) -> DataFrame:
    """Unweighted mean over the states of a trace."""
    return per_state.groupBy(*trace).agg(F.avg("similarity").alias("mean_similarity"))
