"""How text filters overlap, for every order in which they can be applied.

A document is known by its mask, the set of filters that it fails. With the orders ranked
by their Lehmer codes (lexicographically), all orders that begin with the same filters
form one interval of ranks. So a mask is removed at a step by a few intervals: those whose
first filters it passes and whose next one it fails. Counts are added at the start of an
interval and taken off at its end, and a running sum over the ranks gives the removals of
every order at once.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from alarmloom.llm.shared import NO_ID

FILTERS = "ABCDE"
# The tables of intervals and orders grow with the factorial of the filters and are broadcast.
MOST_FILTERS = 6

WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Filters that look at one text: short, repetitive, shouting, odd signs."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.size(words)
    return [
        n_words < 50,
        F.size(F.array_distinct(words)) * 100 < n_words * 65,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5,
        text.rlike(r"[#$%&*|]"),
    ]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part (source) and mask: part, mask, n, good, toxic; one row each.

    Bit k of the mask is set where filter k fails. The last filter is failed by texts
    that a document with a smaller doc_id has too. Texts are compared by SHA-256. Rows
    that repeat in all that counts travel as one row with their number.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.shiftleft(failed.cast("int"), k) for k, failed in enumerate(text_failures(F.col("text")))]
    rows = (
        docs.select(
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            F.col("doc_id").cast("bigint").alias("doc_id"),
            text.alias("text"),
        )
        .select("part", "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
        .groupBy("part", "doc_id", "digest", "mask")
        .agg(F.count("*").alias("n"))
        # Rows without doc_id match no label; dealt by their text they stay apart.
        .withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    )
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    rated = rows.join(known.withColumn("salt", F.lit(0).cast("bigint")), ["doc_id", "salt"], "left").select(
        "part", "digest", "mask", "n", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic"))
    )
    firsts = rows.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id")).withColumn("first", F.lit(True))
    again = F.when(F.col("first"), 0).otherwise(1 << len(bits))
    return (
        rated.join(firsts, ["digest", "id"], "left")
        .groupBy("part", (F.col("mask") + again).alias("mask"))
        .agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")))
    )


def lehmer_rank(start: tuple[int, ...], n: int) -> int:
    """Lexicographic rank of the first order of n filters that begins with start."""
    rest, rank = list(range(n)), 0
    for k, item in enumerate(start):
        rank += rest.index(item) * factorial(n - 1 - k)
        rest.remove(item)
    return rank


def intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders that remove the mask at the step."""
    out = []
    for mask in range(1, 1 << n):
        passed = [k for k in range(n) if not mask >> k & 1]
        failed = [k for k in range(n) if mask >> k & 1]
        for step in range(1, len(passed) + 2):
            for before in permutations(passed, step - 1):
                for item in failed:
                    low = lehmer_rank((*before, item), n)
                    out.append((mask, step, low, low + factorial(n - step)))
    return out


def interactions(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Removals of every order and step, from rows part, mask, n, good, toxic.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. A part without failures has zeros; no part, no row.
    """
    n = len(filters)
    if n > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters, as the orders are listed")
    spark = found.sparkSession
    counts = ("n", "good", "toxic")
    cuts = F.broadcast(spark.createDataFrame(intervals(n), "mask int, step int, low int, high int"))
    orders = [
        (rank, step, "".join(filters[k] for k in order), item)
        for rank, order in enumerate(permutations(range(n)))
        for step, item in enumerate(order, 1)
    ]
    named = F.broadcast(spark.createDataFrame(orders, "rank int, step int, filter_order string, item int"))

    edges = F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign")))
    changes = (
        found.join(cuts, "mask")
        .select("part", "step", F.explode(edges).alias("edge"), *counts)
        .select("part", "step", "edge.rank", *((F.col(c) * F.col("edge.sign")).alias(c) for c in counts))
    )
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)) for k in range(n)]
    alone = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(n)]
    parts = found.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    grid = (
        parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .join(named, ["rank", "step"])
    )
    sums = changes.groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in counts))
    so_far = Window.partitionBy("part", "step").orderBy("rank")
    before = Window.partitionBy("part", "rank").orderBy("step")
    removed = F.sum(F.coalesce("n", F.lit(0))).over(so_far)
    return (
        grid.join(sums, ["part", "step", "rank"], "left")
        .repartition("part")
        .withColumn("removed", removed)
        .withColumn("good_lost", F.sum(F.coalesce("good", F.lit(0))).over(so_far))
        .withColumn("toxic_lost", F.sum(F.coalesce("toxic", F.lit(0))).over(so_far))
        .withColumn("kept", F.col("total") - F.sum("removed").over(before))
        .withColumn("redundant", F.col("fails")[F.col("item")] - F.col("removed"))
        .withColumn("unique_fails", F.col("alone")[F.col("item")])
        .withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "item")))
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters on whole texts, per source.

    A missing text is an empty one and a missing source the part ''. A missing doc_id
    counts as larger than any other and has no label. Rows with the same doc_id and text
    do not repeat each other, whatever their number, and each of them counts. A document
    with several labels is good, or toxic, if any of them says so. Very long texts are
    looked at whole. No documents, no rows; without labels nothing good or toxic is lost.
    Other columns of docs and labels are not looked at.
    """
    return interactions(masks(docs, labels))
