"""Exact, repeatable splits by ranked hash, without sorting the table.

A row's hash is md5 of seed and id. A histogram of hash prefixes shows in which
prefix the wanted ranks fall; one histogram serves all cuts of a table. Only the rows of
those prefixes are ranked, after histograms of longer prefixes where one holds many rows.
The split itself is a comparison with the hashes found, so rows are not shuffled.
Row ids are expected to be unique within a group; copies of an id stay together.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from alarmloom.operators.sizing import small_side

# Hex digits that a histogram looks at together, and rows of a prefix that are ranked in one task.
PREFIX, RANKED_ROWS = 4, 200_000


def rank_hash(seed: int | Column, row_id: Column) -> Column:
    seed_text = (F.lit(seed) if isinstance(seed, int) else seed).cast("string")
    return F.md5(F.concat(seed_text, F.lit(":"), row_id.cast("string")))


def _cuts(hashed: DataFrame, row_id: str, share: float, groups: list[str], rounding: str, lone_row: bool | None):
    """Per group, the last hash and id that belong to the share; no row where the share is empty.

    `hashed` holds the groups, `_hash` and the id. The share is n * share rounded
    by `ceil` or `floor`; with lone_row, a group of one row is in or out of it.
    """
    prefix = F.substring("_hash", 1, PREFIX)
    per_group = Window.partitionBy(*groups)
    # At most 16**PREFIX prefixes per group reach these windows.
    counts = (
        hashed.groupBy(*groups, prefix.alias("_prefix"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_until", F.sum("_n").over(per_group.orderBy("_prefix")))
        .withColumn("_total", F.sum("_n").over(per_group))
    )
    round_to = F.ceil if rounding == "ceil" else F.floor
    wanted = round_to(F.round(F.col("_total") * F.lit(float(share)), 9))
    if lone_row is not None:
        wanted = F.when(F.col("_total") == 1, F.lit(int(lone_row))).otherwise(wanted)
    boundary = small_side(
        counts.withColumn("_wanted", wanted)
        .where("_until >= _wanted and _until - _n < _wanted")
        .select(*groups, "_prefix", (F.col("_wanted") - (F.col("_until") - F.col("_n"))).alias("_rank"))
    )
    until = Window.partitionBy(*groups).orderBy("_hash", row_id).rowsBetween(Window.unboundedPreceding, 0)
    return small_side(
        hashed.withColumn("_prefix", prefix)
        .join(boundary, [*groups, "_prefix"])
        .groupBy(*groups, "_hash", row_id)
        .agg(F.count("*").alias("_n"), F.any_value("_rank").alias("_rank"))
        .withColumn("_until", F.sum("_n").over(until))
        .where("_until >= _rank and _until - _n < _rank")
        .select(*groups, F.col("_hash").alias("_cut_hash"), F.col(row_id).alias("_cut_id"))
    )


def _up_to(row_hash: Column, row_id: Column, cut_hash: Column, cut_id: Column) -> Column:
    return (row_hash < cut_hash) | ((row_hash == cut_hash) & (row_id <= cut_id))


def mark_share(
    df: DataFrame,
    row_id: str,
    share: float,
    seed: int | Column,
    out: str,
    groups: list[str],
    rounding: str = "ceil",
    lone_row: bool | None = None,
) -> DataFrame:
    """Add a boolean column that is true on exactly the wanted number of rows per group."""
    marked = df.withColumn("_hash", rank_hash(seed, F.col(row_id)))
    cuts = _cuts(marked.select(*groups, "_hash", row_id), row_id, share, groups, rounding, lone_row)
    inside = _up_to(F.col("_hash"), F.col(row_id), F.col("_cut_hash"), F.col("_cut_id"))
    return (
        marked.join(cuts, groups, "left")
        .withColumn(out, F.coalesce(inside, F.lit(False)))
        .drop("_hash", "_cut_hash", "_cut_id")
    )


def rank_cuts(hashed: DataFrame, row_id: str, ranks: Callable[[int], list[int]]) -> list[tuple[str, object] | None]:
    """Hash and id of the rows of some ranks, in the order of hash and id.

    `hashed` holds `_hash` and the id; ranks gives them (from 1) for a number of rows, and
    rank 0 has no row. A histogram of the first digits finds the prefix of every rank; a
    prefix of more than RANKED_ROWS rows gets a histogram of its next digits. So the table
    is read twice, and once more for every 65,536 times as many rows.
    """
    open_: dict[str, list[tuple[int, int]]] = {}
    found: list[tuple[str, object] | None] = []
    small: dict[str, list[tuple[int, int]]] = {}
    digits = 0
    while open_ or not digits:
        before = digits
        digits += PREFIX
        rows = hashed.where(F.substring("_hash", 1, before).isin(list(open_))) if before else hashed
        counts = sorted(rows.groupBy(F.substring("_hash", 1, digits).alias("p")).count().collect())
        if not before:
            wanted = ranks(sum(n for _, n in counts))
            found = [None] * len(wanted)
            open_ = {"": [(rank, k) for k, rank in enumerate(wanted) if rank > 0]}
        deeper: dict[str, list[tuple[int, int]]] = {}
        for prefix, held in open_.items():
            below = 0
            for longer, n in counts:
                if not longer.startswith(prefix):
                    continue
                inside = [(rank - below, k) for rank, k in held if below < rank <= below + n]
                below += n
                if inside:
                    (deeper if n > RANKED_ROWS and digits < 32 else small).setdefault(longer, []).extend(inside)
        open_ = deeper
    if not small:
        return found
    lengths = {len(p) for p in small}
    named = F.coalesce(*[F.when(F.substring("_hash", 1, n).isin([p for p in small if len(p) == n]), F.substring("_hash", 1, n)) for n in lengths])
    until = Window.partitionBy("_prefix").orderBy("_hash", row_id).rowsBetween(Window.unboundedPreceding, 0)
    same = hashed.withColumn("_prefix", named).where("_prefix is not null").groupBy("_prefix", "_hash", row_id).agg(F.count("*").alias("_n"))
    placed = same.withColumn("_until", F.sum("_n").over(until))
    hits = [(F.col("_prefix") == p) & (F.col("_until") >= rank) & (F.col("_until") - F.col("_n") < rank) for p, held in small.items() for rank, _ in held]
    rows = placed.where(F.array_contains(F.array(*hits), True)).collect()
    for prefix, held in small.items():
        for rank, k in held:
            row = next(r for r in rows if r["_prefix"] == prefix and r["_until"] - r["_n"] < rank <= r["_until"])
            found[k] = row["_hash"], row[row_id]
    return found


def in_shares(df: DataFrame, row_id: str, shares: list[float], seed: int, rounding: str = "ceil") -> list[Column]:
    """Conditions that hold on exactly the wanted number of rows of df.

    Every share is one of the rows that the shares before left over; together they take the
    first rows in the order of the hash. All cuts are found together.
    """
    row_hash = rank_hash(seed, F.col(row_id))

    def ranks(n: int) -> list[int]:
        out, taken = [], 0
        for share in shares:
            taken += expected_size(n - taken, share, rounding)
            out.append(taken)
        return out

    cuts = rank_cuts(df.select(row_hash.alias("_hash"), row_id), row_id, ranks)
    until = [F.lit(False) if cut is None else _up_to(row_hash, F.col(row_id), F.lit(cut[0]), F.lit(cut[1])) for cut in cuts]
    return [until[0], *(now & ~earlier for earlier, now in zip(until, until[1:]))]


def in_share(df: DataFrame, row_id: str, share: float, seed: int, rounding: str = "ceil") -> Column:
    """Condition that holds on exactly the wanted number of rows of df."""
    return in_shares(df, row_id, [share], seed, rounding)[0]


def holdout(df: DataFrame, row_id: str, share: float = 0.4, seed: int = 42) -> DataFrame:
    """Column `part`: `test` on ceil(n * share) rows, else `train`."""
    return df.withColumn("part", F.when(in_share(df, row_id, share, seed), "test").otherwise("train"))


def detection_parts(
    flows: DataFrame, row_id: str, label: str = "label", test: float = 0.4, validation: float = 0.14, seed: int = 42
) -> DataFrame:
    """Parts of a detection run: normal rows to train, validation and test, attacks to test.

    Both cuts are found first, from the same histogram; the rows are then labelled in place.
    """
    normal = flows.where(F.col(label) == 1)
    tested, validated = in_shares(normal, row_id, [test, validation], seed)
    part = F.when(F.col(label) == -1, "test").when(tested, "test").when(validated, "validation").otherwise("train")
    return flows.where(F.col(label).isin(1, -1)).withColumn("part", part)


def repeated_alarm_split(
    false_alarms: DataFrame,
    true_alarms: DataFrame,
    detectors: list[str],
    repetitions: int = 5,
    share: float = 0.5,
    first_seed: int = 42,
) -> DataFrame:
    """False alarms of each detector split anew in every repetition.

    false_alarms holds `id` and one 0/1 column per detector; true_alarms holds
    `id`. floor(n * share) false alarms train, a lone one trains, and every true
    alarm is for inference.
    """
    numbers = F.array(*[F.lit(r).cast("bigint") for r in range(1, repetitions + 1)])
    flags = F.array(*[F.struct(F.lit(d).alias("detector"), F.col(d).alias("flag")) for d in detectors])
    names = F.array(*[F.lit(d) for d in detectors])
    cells = (
        false_alarms.select("id", F.explode(flags).alias("_f"))
        .where("_f.flag = 1")
        .select("id", F.col("_f.detector").alias("detector"), F.explode(numbers).alias("repetition"))
    )
    seed = F.col("repetition") + F.lit(first_seed - 1)
    marked = mark_share(cells, "id", share, seed, "_train", ["repetition", "detector"], "floor", lone_row=True)
    phase = F.when(F.col("_train"), "training").otherwise("inference")
    split = marked.select("repetition", "detector", phase.alias("phase"), F.lit("FP").alias("label"), "id")
    rated = (
        true_alarms.select("id", F.explode(names).alias("detector"))
        .select("id", "detector", F.explode(numbers).alias("repetition"))
        .select("repetition", "detector", F.lit("inference").alias("phase"), F.lit("TP").alias("label"), "id")
    )
    return split.unionByName(rated)


def split_traces(trace_rows: DataFrame, log: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Column `part`: `validation` on int(n * share) traces of every log, else `training`."""
    marked = mark_share(trace_rows, "case_id", share, seed, "_validation", log, "floor")
    part = F.when(F.col("_validation"), "validation").otherwise("training")
    return marked.withColumn("part", part).drop("_validation")


def expected_size(n: int, share: float, rounding: str = "ceil") -> int:
    exact = round(n * share, 9)
    return math.ceil(exact) if rounding == "ceil" else math.floor(exact)
