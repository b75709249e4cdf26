"""Traces, variants and directly-follows counts of event logs."""

from pyspark.sql import DataFrame, Window, functions as F

from alarmloom.operators.ordering import join_per_group, next_row, number_rows, running_total
from alarmloom.operators.sizing import GROUP_ROWS, join_by_weight, small_side

LOG = ["label", "state"]


def number_events(events: DataFrame, keys: list[str], split: int | None = None) -> DataFrame:
    """Dense 1-based event number inside each trace, in packet order."""
    one = F.lit(1).cast("bigint")
    return running_total(events, keys, "packet_no", one, "event_no", split)


def time_ordered(events: DataFrame, keys: list[str], split: int | None = None) -> DataFrame:
    """Number the events of each trace by timestamp, ties by packet number.

    Captures may be out of time order, so packet_no becomes the dense number in time
    order, and event_no is the same number. Without a split no trace is longer than a
    task should sort, and nothing is counted before the plan exists.
    """
    longest = 0 if split is None else None
    numbered = number_rows(events, keys, ["ts", "packet_no"], "_time_no", split or GROUP_ROWS, longest)
    return numbered.drop("packet_no").withColumnRenamed("_time_no", "packet_no").withColumn("event_no", F.col("packet_no"))


def traces(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per trace: length, time span and a signature of its activity sequence.

    The signature combines hashes of (event number, activity) pairs, so equal
    sequences get equal signatures by a plain aggregate that never holds a
    sequence in memory.
    """
    step = [F.col("event_no"), F.col("activity")]
    return events.groupBy(*keys).agg(
        F.count("*").alias("n_events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum("payload_size").alias("payload_total"),
        F.max("packet_no").alias("last_packet_no"),
        F.bit_xor(F.xxhash64(*step)).alias("signature_a"),
        F.bit_xor(F.xxhash64(F.lit("second"), *step)).alias("signature_b"),
    )


SIGNATURE = ["n_events", "signature_a", "signature_b"]


def variants(trace_rows: DataFrame, log: list[str] = LOG, ids: list[str] = ("case_id",)) -> DataFrame:
    """Traces grouped by activity sequence, with count, smallest case id and a first trace.

    The struct column `first` identifies one trace of the variant by ids.
    """
    return trace_rows.groupBy(*log, *SIGNATURE).agg(
        F.count("*").alias("n_traces"),
        F.min("case_id").alias("first_case"),
        F.min(F.struct(*ids)).alias("first"),
    )


def rank_variants(variant_rows: DataFrame, log: list[str] = LOG, limit: int = GROUP_ROWS) -> DataFrame:
    """Rank by frequency, ties by smallest case id, with the traces ranked before.

    Variants of equal frequency form a level. Ranks inside a level come from
    the group-safe row number; a log has few levels, so their running sums are
    small windows.
    """
    level = [*log, "n_traces"]
    above = Window.partitionBy(*log).orderBy(F.desc("n_traces")).rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("_in_level") * F.col("n_traces")
    levels = small_side(
        variant_rows.groupBy(*level)
        .agg(F.count("*").alias("_in_level"))
        .withColumn("_variants_above", F.coalesce(F.sum("_in_level").over(above), F.lit(0)))
        .withColumn("_traces_above", F.coalesce(F.sum(mass).over(above), F.lit(0)))
    )
    widest = levels.agg(F.max("_in_level").alias("n")).first()["n"] or 0
    ranked = number_rows(variant_rows, level, ["first_case"], "_rank", limit, widest)
    before = F.col("_traces_above") + (F.col("_rank") - 1) * F.col("n_traces")
    return (
        ranked.join(levels, level)
        .withColumn("variant_no", F.col("_variants_above") + F.col("_rank"))
        .withColumn("traces_before", before)
        .drop("_rank", "_in_level", "_variants_above", "_traces_above")
    )


def kept_variants(
    variant_rows: DataFrame, threshold: float, log: list[str] = LOG, limit: int = GROUP_ROWS
) -> DataFrame:
    """Variants kept by a threshold.

    Within 0.001 of 1: all. Below 1: the most frequent until their share of
    traces is reached, the crossing one included. Above 1: that many variants.
    """
    if abs(threshold - 1.0) < 0.001:
        return variant_rows
    ranked = rank_variants(variant_rows, log, limit)
    if threshold > 1.0:
        return ranked.where(F.col("variant_no") <= int(threshold))
    totals = variant_rows.groupBy(*log).agg(F.sum("n_traces").alias("_total"))
    wanted = F.col("_total") * F.lit(float(threshold))
    first_or_short = (F.col("variant_no") == 1) | (F.col("traces_before") < wanted)
    return ranked.join(small_side(totals), log).where(first_or_short).drop("_total")


def filter_variants(
    events: DataFrame,
    threshold: float,
    keys: list[str],
    log: list[str] = LOG,
    split: int | None = None,
) -> DataFrame:
    """Events of the traces whose variant is kept."""
    if abs(threshold - 1.0) < 0.001:
        return events
    trace_rows = traces(events, keys).persist()
    matched = [*log, *SIGNATURE]
    kept = kept_variants(variants(trace_rows, log), threshold, log).select(*matched, "n_traces")
    kept_traces = join_by_weight(trace_rows, kept, matched, "n_traces", "left_semi").select(
        *keys, F.col("last_packet_no").alias("_last")
    )
    return join_per_group(events, kept_traces, keys, "packet_no", split, "left_semi")


def variant_steps(
    events: DataFrame,
    variant_rows: DataFrame,
    log: list[str] = LOG,
    ids: list[str] = ("case_id",),
    split: int | None = None,
) -> DataFrame:
    """Activity sequence of each variant, read from its first trace, one row per step.

    The first traces can be many; Spark chooses the join, and a long trace is
    joined piece by piece.
    """
    chosen = variant_rows.select(*log, "first.*", "n_traces", F.col("n_events").alias("_last"))
    return join_per_group(events, chosen, [*log, *ids], "event_no", split, "inner")


def directly_follows(
    events: DataFrame, keys: list[str], log: list[str] = LOG, split: int | None = None
) -> DataFrame:
    """How often one activity directly follows another, per log."""
    pairs = next_row(events, keys, "packet_no", ["activity"], "_next", split)
    return (
        pairs.where(F.col("_next").isNotNull())
        .groupBy(*log, "activity", F.col("_next.activity").alias("next_activity"))
        .agg(F.count("*").alias("n"))
    )


def start_end_activities(
    events: DataFrame, keys: list[str], log: list[str] = LOG
) -> DataFrame:
    """Counts of first and last activities, per log."""
    ends = events.groupBy(*keys).agg(
        F.min_by("activity", "packet_no").alias("start"), F.max_by("activity", "packet_no").alias("end")
    )
    sides = F.expr("stack(2, 'start', start, 'end', `end`) as (position, activity)")
    return ends.select(*log, sides).groupBy(*log, "position", "activity").agg(F.count("*").alias("n"))
