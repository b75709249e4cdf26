"""Mixing sources to target weights by a curriculum that changes over training time.

Every source has a weight schedule over training time 0 to 1. Its integral, scaled to the
source's target, is the demand for the source's words up to that time. Documents stand in
a fixed random order in their source and are met once per pass over it; inverting the
demand at a document's place gives the time at which it is due, and the demand of all
sources up to that time its position in the training sequence. Ordering by position is a
range sort. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from alarmloom.operators.sizing import BROADCAST_ROWS, GROUP_ROWS, cut_lineage

WEIGHTS = (5, 2, 1)
# Weight over time of the sources of each weight, at knots of equal distance; scaled to mean 1.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
# Words of the mix for 100 words of the documents, and passes over a source at most.
PERCENT, PASSES = 150, 2
# Rows of a source that one task puts in order, and equal rows that go as one.
PIECE_ROWS, CHUNK_ROWS = 2_000, 1_024
# Bytes of source names that may be sent to every executor.
BROADCAST_BYTES = 8 << 20

WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Adds rank (from 1) and before_<c>, the sum of c over all earlier rows, in a global order.

    Rows are range-partitioned; only one row per partition meets in one task.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = (
        dealt.groupBy("_part")
        .agg(F.count("*").alias("_rows"), *(F.sum(c).alias(f"_{c}") for c in sums))
        .select("_part", *(F.coalesce(F.sum(c).over(earlier), zero).alias(f"_off{c}") for c in ("_rows", *(f"_{c}" for c in sums))))
    )
    # One row per partition of the shuffle.
    joined = dealt.join(F.broadcast(offsets), "_part")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_off_rows")
    before = [(F.coalesce(F.sum(c).over(inside), zero) + F.col(f"_off_{c}")).alias(f"before_{c}") for c in sums]
    return joined.select(*df.columns, rank.alias("rank"), *before)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, passes: int = PASSES) -> DataFrame:
    """Adds kind (place in weights), weight and target to rows key, source, source_size.

    Sources in code-point order, null last, get the weights in turn. They share percent of
    all words by weight; a target stops at `passes` times the source's words, and what is
    above goes to the others by weight. In order of words per weight, the stopped sources
    come first, so the level of the others follows from running sums.
    """
    cycle = F.array(*map(F.lit, weights))
    named = running(sizes, [F.col("source").asc_nulls_last()], [])
    named = named.withColumn("kind", ((F.col("rank") - 1) % len(weights)).cast("int")).drop("rank")
    named = named.withColumn("weight", cycle[F.col("kind")].cast("bigint"))
    named = cut_lineage(named.withColumn("most", F.col("source_size") * passes))
    total = named.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if total["weight"] is None:
        return named.withColumn("target", F.lit(0.0)).drop("most")
    budget = min(percent / 100, passes) * total["size"]
    ranked = running(named, [(F.col("most") / F.col("weight")).asc(), F.col("key").asc()], ["most", "weight"])
    level = (F.lit(budget) - F.col("before_most")) / (F.lit(total["weight"]) - F.col("before_weight"))
    held = ranked.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("most"))
    found = held.agg(F.min_by("level", "rank").alias("level")).first()["level"]
    share = F.col("most").cast("double") if found is None else F.least(F.col("most").cast("double"), F.col("weight") * F.lit(found))
    return named.withColumn("target", share).drop("most")


def demand(time: Column, knots: Sequence[float]) -> Column:
    """Share of a source's words that are due up to a time: the integral of its schedule."""
    out, slope = F.lit(0.0), len(knots) - 1
    for k, (low, high, _) in enumerate(_segments(knots)):
        x = F.greatest(F.least(time - k / slope, F.lit(1 / slope)), F.lit(0.0))
        out = out + x * low + x * x * ((high - low) * slope / 2)
    return out


def due(share: Column, knots: Sequence[float]) -> Column:
    """Time at which a share of a source's words is due; the inverse of demand()."""
    slope, out = len(knots) - 1, None
    for k, (low, high, start) in enumerate(_segments(knots)):
        rest = F.greatest(share - start, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(low * low) + rest * (2 * (high - low) * slope), F.lit(0.0)))
        x = F.when(rest > 0, rest * 2 / (root + low)).otherwise(0.0)
        time = F.least(x, F.lit(1 / slope)) + k / slope
        out = time if out is None else F.when(share > start, time).otherwise(out)
    return out


def _segments(knots: Sequence[float]) -> list[tuple[float, float, float]]:
    """(value at its start, value at its end, integral before it) of each segment, for a whole integral of 1."""
    if len(knots) < 2 or min(knots) < 0 or sum(knots) <= 0:
        raise ValueError("a schedule has two knots or more, none below zero and not all zero")
    width = 1 / (len(knots) - 1)
    area = [width * (a + b) / 2 for a, b in zip(knots, knots[1:])]
    out, start = [], 0.0
    for a, b, part in zip(knots, knots[1:], area):
        out.append((a / sum(area), b / sum(area), start))
        start += part / sum(area)
    return out


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their source; sources with many rows are joined by broadcast."""
    size = facts.agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), "key")
    # As many keys at most as rows hold GROUP_ROWS.
    heavy, light = (facts.where(c) for c in (F.col("units") > GROUP_ROWS, F.col("units") <= GROUP_ROWS))
    few = heavy.agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    if few["n"] > BROADCAST_ROWS or (few["bytes"] or 0) > BROADCAST_BYTES:
        return rows.join(facts, "key")
    many = rows.join(F.broadcast(heavy), "key")
    rest = rows.join(F.broadcast(heavy.select("key")), "key", "left_anti")
    return many.unionByName(rest.join(light, "key"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    percent: int = PERCENT,
    passes: int = PASSES,
) -> DataFrame:
    """The sources' targets and each document's places in the training sequence.

    Columns: doc_id, source, size (words), source_size, target (its source's words in the
    mix) and positions (array of bigint, one per time that the mix takes the document:
    words of the mix before the middle of the document). A document is taken in a pass if
    its middle lies within the target, so a source's taken words differ from the target by
    half a document at most. Documents of a source stand in the order of an md5 of doc_id.

    A missing text has no words, and documents without words are never taken. A missing
    source is a source of its own, the last. Missing and repeated doc_ids are allowed:
    equal rows follow each other by number, and get the same places in every run. No
    documents, no rows. Very long texts are counted whole; other columns are not looked at.
    """
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint")
    name = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), name.alias("source"), n_words.alias("size"))
    equal = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    chunk = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / CHUNK_ROWS))
    units = cut_lineage(
        equal.withColumn("chunk", F.explode(chunk))
        .withColumn("copies", F.least(F.lit(CHUNK_ROWS).cast("bigint"), F.col("copies") - F.col("chunk") * CHUNK_ROWS))
        .withColumn("key", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source"))))
        .withColumn("place", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "chunk").cast("binary")))
    )
    sizes = units.groupBy("key").agg(
        F.first("source").alias("source"), F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("units")
    )
    facts = cut_lineage(source_targets(sizes, weights, percent, passes))
    by_kind = {r["kind"]: r["target"] for r in facts.groupBy("kind").agg(F.sum("target").alias("target")).collect()}

    # Places are even, so their first digits cut a source into pieces of like size.
    share = F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint") / F.lit(1 << 32)
    piece = F.floor(share * F.ceil(F.col("units") / PIECE_ROWS)).cast("bigint")
    dealt = _with_facts(units.drop("source"), facts).withColumn("piece", piece).withColumn("words", F.col("size") * F.col("copies"))
    earlier = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("key", "piece").agg(F.sum("words").alias("sum"))
        .select("key", "piece", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("key", "piece").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.join(offsets, ["key", "piece"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
        .withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    )

    def position(lap: Column) -> Column:
        """Place in the training sequence of a document in one pass over its source."""
        middle = F.col("start") + lap * F.col("source_size") + F.col("size") / 2
        part = F.least(middle / F.col("target"), F.lit(1.0))
        time = F.lit(None).cast("double")
        for kind in range(len(weights)):
            time = F.when(F.col("kind") == kind, due(part, schedules[kind])).otherwise(time)
        so_far = F.lit(0.0)
        for kind, words in sorted(by_kind.items()):
            so_far = so_far + demand(time, schedules[kind]) * F.lit(float(words))
        return F.when((F.col("size") > 0) & (middle <= F.col("target")), F.round(so_far).cast("bigint"))

    laps = F.array(*(position(F.lit(lap)) for lap in range(passes)))
    return placed.select("doc_id", "source", "size", "source_size", "target", F.array_compact(laps).alias("positions"))


def sequence(mixed: DataFrame) -> DataFrame:
    """The training sequence: position, doc_id, source, size and lap, one row per taking, in order (a range sort)."""
    taken = mixed.select(F.posexplode("positions").alias("lap", "position"), "doc_id", "source", "size")
    return taken.orderBy("position", "source", "doc_id", "size", "lap").select("position", "doc_id", "source", "size", "lap")


def by_position(mixed: DataFrame) -> DataFrame:
    """One row per document with the words taken of it, in the order of first positions; the untaken follow, by doc_id."""
    first = F.get("positions", F.lit(0))
    return mixed.orderBy(first.asc_nulls_last(), "doc_id").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).cast("bigint").alias("taken")
    )
