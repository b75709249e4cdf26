"""Alignment of traces with process trees, replay, and fitness.

Only distinct variants are aligned; results are joined back to traces. A tree
is taken apart into its concurrent parts, and each variant is projected on each
part, so that a part has few markings. A part is aligned by carrying the
cheapest cost of every marking along the sequence. Long sequences are cut into
pieces: every piece is summed up as a marking-to-marking cost table, the tables
are chained, and the pieces are then aligned side by side. Parts with too many
markings for such tables are aligned over single moves, or by intervals of the trace,
each sequence whole.
"""

from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from alarmloom.operators.eventlog import SIGNATURE, traces, variant_steps, variants
from alarmloom.operators.sizing import held_side, join_by_weight, split_rows
from alarmloom.operators.trees import (
    LOG_MOVE,
    Intervals,
    Markings,
    Net,
    TooManyMarkings,
    Tree,
    Walks,
    advance,
    concurrent_parts,
    read_trees,
)
from alarmloom.shipping import ship_by_value

PART = "model_part"
# Events of a variant that one row may hold; longer variants are run in pieces.
SEQUENCE_EVENTS = 50_000
# Cells of the cost table that one batch of sequences may fill.
BATCH_CELLS = 20_000_000


class Models:
    """Compiled parts of every log's tree; small enough to travel with the tasks.

    Parts with many markings are held as Walks or Intervals, which give the same alignments.
    """

    def __init__(self, tree: DataFrame, log: list[str]):
        self.log = list(log)
        self.trees = read_trees([row.asDict() for row in tree.collect()], log)
        self.parts: dict[tuple, Markings | Walks | Intervals] = {}
        compiled: dict[str, Markings | Walks | Intervals] = {}
        for key, root in self.trees.items():
            for number, part in enumerate(concurrent_parts(root)):
                # Equal parts of several logs are one object, so that their sequences go side by side.
                name = repr(part)
                if name not in compiled:
                    compiled[name] = self._compiled(part)
                self.parts[(*key, number)] = compiled[name]
        self.spark = tree.sparkSession
        self.types = "".join(f"{c} {tree.schema[c].dataType.simpleString()}, " for c in log)

    @staticmethod
    def _compiled(part: Tree) -> Markings | Walks | Intervals:
        for kind in (Markings, Walks):
            try:
                return kind(part)
            except TooManyMarkings:
                continue
        return Intervals(part)

    def wide(self) -> DataFrame | None:
        """Keys of the parts that take one sequence at a time, if there are any."""
        rows = [key for key, part in self.parts.items() if not isinstance(part, Markings)]
        return held_side(self.spark.createDataFrame(rows, f"{self.types}{PART} int"), len(rows)) if rows else None

    def part_of(self) -> DataFrame:
        """Part number of every activity of every log; held by the driver already."""
        rows = [(*key, label) for key, part in self.parts.items() for label in part.labels]
        return held_side(self.spark.createDataFrame(rows, f"{self.types}{PART} int, activity string"), len(rows))

    def shortest(self) -> DataFrame:
        """Cost and visible moves of the cheapest run of every log's model, over all its parts."""
        sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
        for key, part in self.parts.items():
            sums[key[:-1]][0] += part.shortest
            sums[key[:-1]][1] += part.shortest // LOG_MOVE
        rows = [(*key, *pair) for key, pair in sums.items()]
        types = f"{self.types}model_cost bigint, model_moves bigint"
        return held_side(self.spark.createDataFrame(rows, types), len(rows))


def _sequences(steps: DataFrame, keys: list[str], split: int | None) -> DataFrame:
    """Activity arrays per sequence and piece; a piece holds at most `split` events, from 1 on."""
    piece = F.lit(0) if split is None else F.floor((F.col("event_no") - 1) / F.lit(split))
    ordered = F.array_sort(F.collect_list(F.struct("event_no", "activity")))
    return steps.groupBy(*keys, piece.cast("bigint").alias("piece")).agg(ordered["activity"].alias("activities"))


def _batches(batch: pd.DataFrame, keys: list[str], parts: dict) -> Iterator[tuple]:
    """Rows of one part at a time, as label numbers, in slices that fit the cost table; logs with equal parts go together."""
    batch = batch.dropna(subset=keys)
    alike: dict[int, list[int]] = defaultdict(list)
    held = [parts[key] for key in zip(*(batch[c] for c in keys))]
    for i, part in enumerate(held):
        alike[id(part)].append(i)
    for places in alike.values():
        part, rows = held[places[0]], batch.iloc[places]
        number = {label: i for i, label in enumerate(part.labels)}
        widest = max((len(before) for before, _ in part.moves), default=1)
        step = max(1, BATCH_CELLS // (part.size * max(widest, len(part.labels), 1)))
        for at in range(0, len(rows), step):
            chunk = rows.iloc[at : at + step]
            coded = [np.array([number[a] for a in acts], dtype=np.int64) for acts in chunk["activities"]]
            yield part, chunk, coded


def _distinct(coded: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sequences that occur, each once, and for every row the one that it has."""
    number: dict[bytes, int] = {}
    place = np.array([number.setdefault(c.tobytes(), len(number)) for c in coded], dtype=np.int64)
    _, first = np.unique(place, return_index=True)
    return [coded[i] for i in first], place


RESULT = "cost bigint, deviations bigint, n bigint, labels array<string>, synced array<bigint>"


def _beyond(deviations: int, part: Markings) -> int:
    """Deviations beyond those of the cheapest run of the part."""
    return int(deviations) - part.shortest // LOG_MOVE


def _align_whole(sequences: DataFrame, keys: list[str], model_keys: list[str], parts: dict) -> DataFrame:
    """Cost and synchronous moves of sequences that are held in one piece."""
    key_types = "".join(f"{c} {sequences.schema[c].dataType.simpleString()}, " for c in keys)

    def align(batches):
        for batch in batches:
            for part, rows, coded in _batches(batch, model_keys, parts):
                # Parts have few activities, so traces that differ are often alike in a part.
                once, place = _distinct(coded)
                start = np.repeat(part.cost[0][None, :], len(once), axis=0)
                cost, _, origin, synced, strayed = advance(part, start, once, track=True)
                # The marking come from was reached by model moves before the first event.
                total = strayed[:, part.final] + part.visible[0, origin[:, part.final]]
                yield rows[keys].assign(
                    cost=(cost[:, part.final] - part.shortest)[place],
                    deviations=[_beyond(d, part) for d in total[place]],
                    n=[len(c) for c in coded],
                    labels=[part.labels] * len(coded),
                    synced=list(synced[place, part.final, :]),
                )

    return sequences.select(*keys, "activities").mapInPandas(align, key_types + RESULT)


def _align_pieces(sequences: DataFrame, keys: list[str], model_keys: list[str], parts: dict) -> DataFrame:
    """As _align_whole, for sequences in several pieces, with the pieces run in parallel."""
    key_types = "".join(f"{c} {sequences.schema[c].dataType.simpleString()}, " for c in keys)
    far = np.int64(1 << 40)

    def tables(batches):
        for batch in batches:
            for part, rows, coded in _batches(batch, model_keys, parts):
                unit = np.full((part.size, part.size), far, dtype=np.int64)
                np.fill_diagonal(unit, 0)
                found = [advance(part, unit, [c] * part.size, track=False)[:2] for c in coded]
                yield rows[[*keys, "piece"]].assign(costs=[c.ravel() for c, _ in found], ties=[t.ravel() for _, t in found])

    def entries(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("piece")
        part = parts[tuple(held.iloc[0][model_keys])]
        now, light, starts, lights = part.cost[0], np.zeros(part.size, dtype=np.int64), [], []
        for costs, ties in zip(held["costs"], held["ties"]):
            starts.append(now)
            lights.append(light)
            ways = now[:, None] + np.asarray(costs).reshape(part.size, part.size)
            weights = light[:, None] + np.asarray(ties).reshape(part.size, part.size)
            now = ways.min(axis=0)
            light = np.where(ways == now, weights, np.iinfo(np.int64).max).min(axis=0)
            now = np.minimum(now, far)
        return held[[*keys, "piece"]].assign(start=starts, light=lights)

    def ways(batches):
        for batch in batches:
            for part, rows, coded in _batches(batch, model_keys, parts):
                start = np.stack([np.asarray(s) for s in rows["start"]])
                light = np.stack([np.asarray(s) for s in rows["light"]])
                cost, _, origin, synced, strayed = advance(part, start, coded, track=True, start_tie=light)
                yield rows[[*keys, "piece"]].assign(
                    cost=cost[:, part.final],
                    n=[len(c) for c in coded],
                    origin=list(origin),
                    strayed=list(strayed),
                    synced=[s.ravel() for s in synced],
                )

    def chain(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("piece", ascending=False)
        part = parts[tuple(held.iloc[0][model_keys])]
        at, deviations, total = part.final, 0, np.zeros(len(part.labels), dtype=np.int64)
        for origin, strayed, synced in zip(held["origin"], held["strayed"], held["synced"]):
            total += np.asarray(synced).reshape(part.size, -1)[at]
            deviations += int(strayed[at])
            at = int(origin[at])
        # The markings before the first event are reached by model moves only.
        deviations += int(part.visible[0, at])
        return held.iloc[:1][keys].assign(
            cost=int(held.iloc[0]["cost"]) - part.shortest,
            deviations=_beyond(deviations, part),
            n=int(held["n"].sum()),
            labels=[part.labels],
            synced=[total],
        )

    piece_types = f"{key_types}piece bigint, "
    table = sequences.mapInPandas(tables, f"{piece_types}costs array<bigint>, ties array<bigint>")
    started = table.groupBy(*keys).applyInPandas(entries, f"{piece_types}start array<bigint>, light array<bigint>")
    joined = sequences.join(started, [*keys, "piece"])
    way_types = "cost bigint, n bigint, origin array<bigint>, strayed array<bigint>, synced array<bigint>"
    run = joined.mapInPandas(ways, piece_types + way_types)
    return run.groupBy(*keys).applyInPandas(chain, key_types + RESULT)


def _align_wide(sequences: DataFrame, keys: list[str], model_keys: list[str], parts: dict) -> DataFrame:
    """As _align_whole, for parts that are held as Walks or Intervals."""
    key_types = "".join(f"{c} {sequences.schema[c].dataType.simpleString()}, " for c in keys)

    def align(batches):
        for batch in batches:
            for key, rows in batch.groupby(model_keys, sort=False):
                part = parts[key]
                number = {label: i for i, label in enumerate(part.labels)}
                found = [part.align(np.array([number[a] for a in acts], dtype=np.int64)) for acts in rows["activities"]]
                yield rows[keys].assign(
                    cost=[cost - part.shortest for cost, _, _ in found],
                    deviations=[_beyond(strayed, part) for _, strayed, _ in found],
                    n=[len(acts) for acts in rows["activities"]],
                    labels=[part.labels] * len(rows),
                    synced=[synced for _, _, synced in found],
                )

    return sequences.select(*keys, "activities").mapInPandas(align, key_types + RESULT)


def align_sequences(
    steps: DataFrame, models: Models, ids: list[str], split: int | None = None
) -> DataFrame:
    """Per sequence and part: cost and deviations beyond the cheapest run, and synchronous moves.

    steps holds the log columns, ids, event_no and activity.
    """
    log = models.log
    keys, model_keys = [*log, *ids, PART], [*log, PART]
    ship_by_value()
    parts = models.parts
    placed = steps.join(models.part_of(), [*log, "activity"])
    wide = models.wide()
    if wide is None:
        return _align_narrow(placed, keys, model_keys, parts, split)
    whole = _sequences(placed.join(wide, model_keys, "left_semi"), keys, None)
    narrow = placed.join(wide, model_keys, "left_anti")
    return _align_wide(whole, keys, model_keys, parts).unionByName(
        _align_narrow(narrow, keys, model_keys, parts, split)
    )


def _align_narrow(
    placed: DataFrame, keys: list[str], model_keys: list[str], parts: dict, split: int | None
) -> DataFrame:
    """Alignments with the parts that are held as Markings, long sequences in pieces."""
    sequences = _sequences(placed, keys, split)
    if split is None:
        return _align_whole(sequences, keys, model_keys, parts)
    # Pieces are counted without their activities, and joined per piece.
    numbers = placed.select(*keys, F.floor((F.col("event_no") - 1) / F.lit(split)).cast("bigint").alias("piece")).distinct()
    counted = numbers.withColumn("_pieces", F.count("*").over(Window.partitionBy(*keys)))
    sequences = sequences.join(counted, [*keys, "piece"]).persist()
    lone = sequences.where("_pieces = 1").drop("_pieces")
    cut = sequences.where("_pieces > 1").drop("_pieces")
    return _align_whole(lone, keys, model_keys, parts).unionByName(
        _align_pieces(cut, keys, model_keys, parts)
    )


def piece_length(trace_rows: DataFrame, split: int | None) -> int | None:
    """Piece length for variants, or None when each fits one row."""
    longest = trace_rows.agg(F.max("n_events").alias("n")).first()["n"] or 0
    limit = min(split or SEQUENCE_EVENTS, SEQUENCE_EVENTS)
    return split_rows(longest, limit)


class Alignments:
    """Variants aligned with their log's model.

    `traces` has one row per trace with its signature; `variants` one row per
    log and variant with cost, deviations, worst case, fitness and the
    synchronous moves as an array. Logs without a model are left out.
    """

    def __init__(
        self,
        events: DataFrame,
        tree: DataFrame,
        log: list[str],
        trace: list[str],
        split: int | None = None,
    ):
        ids = [c for c in trace if c not in log]
        by_id = [*log, *ids]
        models = Models(tree, log)
        self.log, self.trace = list(log), list(trace)
        self.matched = [*log, *SIGNATURE]
        self.traces = traces(events, trace).persist()
        rows = variants(self.traces, log, ids).join(models.shortest(), log)
        steps = variant_steps(events, rows, log, ids, split)
        piece = piece_length(self.traces, split)
        moves = F.arrays_zip(F.col("labels").alias("activity"), F.col("synced").alias("n"))
        aligned = align_sequences(steps, models, ids, piece).withColumn("_moves", moves)
        # One row per part of the model, at most one part per activity.
        per_first = aligned.groupBy(*by_id).agg(
            F.sum("cost").alias("_cost"),
            F.sum("deviations").alias("_deviations"),
            F.sum("n").alias("_known"),
            F.flatten(F.collect_list("_moves")).alias("moves"),
        )
        outside = F.col("n_events") - F.coalesce("_known", F.lit(0))
        deviations = F.col("model_moves") + F.coalesce("_deviations", F.lit(0)) + outside
        self.variants = (
            rows.select("*", "first.*")
            .drop("first", "first_case")
            .join(per_first, by_id, "left")
            .withColumn("cost", F.col("model_cost") + F.coalesce("_cost", F.lit(0)) + outside * LOG_MOVE)
            .withColumn("deviations", deviations)
            .withColumn("worst", F.col("n_events") + F.col("model_moves"))
            .withColumn("fitness", F.lit(1.0) - F.col("deviations") / F.col("worst"))
            .drop("_cost", "_deviations", "_known", "model_cost", "model_moves")
            .persist()
        )

    def sync_counts(self) -> DataFrame:
        """Synchronous moves per trace and activity; a trace without any has no row."""
        held = self.variants.select(*self.matched, "n_traces", "moves")
        named = self.traces.where(F.col("case_id").isNotNull())
        joined = join_by_weight(named, held, self.matched, "n_traces", "inner")
        return joined.select(*self.trace, F.inline("moves")).where("n > 0")

    def trace_fitness(self) -> DataFrame:
        """Fitness of each trace in its state."""
        facts = self.variants.select(*self.matched, "n_traces", "deviations", "worst", "fitness")
        joined = join_by_weight(self.traces, facts, self.matched, "n_traces", "inner")
        return joined.select(*self.trace, "n_events", "deviations", "worst", "fitness")

    def log_fitness(self) -> DataFrame:
        return log_fitness(self.variants, self.log)


def log_fitness(variant_rows: DataFrame, log: list[str]) -> DataFrame:
    """Fitness of a log: deviations of all traces over their worst case."""
    spent = F.sum(F.col("deviations") * F.col("n_traces"))
    worst = F.sum(F.col("worst") * F.col("n_traces"))
    return variant_rows.groupBy(*log).agg(
        F.sum("n_traces").alias("n_traces"), (F.lit(1.0) - spent / worst).alias("fitness")
    )


def mean_trace_fitness(fitness: DataFrame, trace: list[str]) -> DataFrame:
    """Mean fitness of a trace over its states, with the number of states."""
    return fitness.groupBy(*trace).agg(F.avg("fitness").alias("fitness"), F.count("*").alias("n_states"))


def min_trace_fitness(fitness: DataFrame, trace: list[str]) -> DataFrame:
    """Lowest fitness of a trace over its states; a missing one counts as 0."""
    return fitness.groupBy(*trace).agg(F.min(F.coalesce("fitness", F.lit(0.0))).alias("fitness"))


# Token replay


def _silent_path(net: Net, marking: Counter, wanted: tuple[int, ...]) -> list[int] | None:
    """Shortest list of silent transitions after which all wanted places hold a token."""

    def covered(tokens) -> bool:
        return all(tokens[p] >= 1 for p in wanted)

    start = tuple(sorted(marking.items()))
    queue, seen = deque([(marking, [])]), {start}
    while queue:
        tokens, path = queue.popleft()
        if covered(tokens):
            return path
        for number, (label, sources, targets) in enumerate(net.transitions):
            if label is None and all(tokens[p] >= 1 for p in sources):
                after = tokens.copy()
                after.subtract(sources)
                after.update(targets)
                after = +after
                mark = tuple(sorted(after.items()))
                if mark not in seen:
                    seen.add(mark)
                    queue.append((after, [*path, number]))
    return None


class _Replay:
    """Token counts of one sequence on one net; can stop and go on between pieces."""

    def __init__(self, net: Net, saved: list[int] | None, paths: dict):
        self.net, self.paths = net, paths
        self.by_label = {label: i for i, (label, _, _) in enumerate(net.transitions) if label is not None}
        if saved is None:
            self.tokens = Counter({net.source: 1})
            self.produced, self.consumed, self.missing = 1, 0, 0
        else:
            self.produced, self.consumed, self.missing = saved[:3]
            self.tokens = Counter({p: n for p, n in enumerate(saved[3:]) if n})

    def _fire(self, number: int) -> None:
        _, sources, targets = self.net.transitions[number]
        for place in sources:
            if self.tokens[place] < 1:
                self.missing += 1
                self.tokens[place] += 1
        self.tokens.subtract(sources)
        self.tokens.update(targets)
        self.tokens = +self.tokens
        self.consumed += len(sources)
        self.produced += len(targets)

    def _prepare(self, wanted: tuple[int, ...]) -> None:
        """Fire silent transitions towards the wanted places; paths are kept for later rows."""
        key = (wanted, tuple(sorted(self.tokens.items())))
        if key not in self.paths:
            # Without a silent path nothing fires, and the tokens that lack are counted as missing.
            self.paths[key] = _silent_path(self.net, self.tokens, wanted) or []
        for silent in self.paths[key]:
            self._fire(silent)

    def run(self, activities) -> None:
        for activity in activities:
            number = self.by_label.get(activity)
            if number is None:
                continue
            self._prepare(self.net.transitions[number][1])
            self._fire(number)

    def finish(self) -> tuple[int, int, int, int]:
        """Produced, consumed, missing and remaining tokens."""
        self._prepare((self.net.sink,))
        if self.tokens[self.net.sink] < 1:
            self.missing += 1
            self.tokens[self.net.sink] += 1
        self.consumed += 1
        self.tokens[self.net.sink] -= 1
        return self.produced, self.consumed, self.missing, sum((+self.tokens).values())

    def saved(self) -> list[int]:
        return [self.produced, self.consumed, self.missing, *(self.tokens[p] for p in range(self.net.n_places))]


def token_replay(
    events: DataFrame, tree: DataFrame, log: list[str], trace: list[str], split: int | None = None
) -> DataFrame:
    """Token counts and fitness per variant.

    A replay depends on all earlier events of its trace. Long traces are replayed
    piece by piece: each round runs the next piece of every variant from the
    token state the round before has left.
    """
    ids = [c for c in trace if c not in log]
    keys = [*log, *ids]
    spark = events.sparkSession
    nets = {key: Net(root) for key, root in read_trees([r.asDict() for r in tree.collect()], log).items()}
    ship_by_value()
    known = spark.createDataFrame(list(nets), "".join(f"{c} {tree.schema[c].dataType.simpleString()}, " for c in log)[:-2])
    trace_rows = traces(events, trace).persist()
    variant_rows = variants(trace_rows, log, ids).join(held_side(known, len(nets)), log, "left_semi").persist()
    steps = variant_steps(events, variant_rows, log, ids, split)
    piece = piece_length(trace_rows, split)
    sequences = _sequences(steps, keys, piece)
    key_types = "".join(f"{c} {steps.schema[c].dataType.simpleString()}, " for c in keys)
    rounds = 0
    if piece is None:
        sequences = sequences.withColumn("_last", F.col("piece"))
    else:
        # The last piece follows from the length of the variant, without its activities.
        numbers = steps.select(*keys, F.floor((F.col("event_no") - 1) / F.lit(piece)).cast("bigint").alias("piece")).distinct()
        lasts = numbers.withColumn("_last", F.max("piece").over(Window.partitionBy(*keys)))
        sequences = sequences.join(lasts, [*keys, "piece"]).persist()
        rounds = lasts.agg(F.max("piece")).first()[0] or 0

    def replay(batches):
        paths: dict[tuple, dict] = defaultdict(dict)
        for batch in batches:
            out = {"saved": [], "counts": []}
            for _, row in batch.iterrows():
                before = row["saved"]
                model = tuple(row[c] for c in log)
                run = _Replay(nets[model], None if before is None else list(before), paths[model])
                run.run(row["activities"])
                out["counts"].append(list(run.finish()) if row["piece"] == row["_last"] else None)
                out["saved"].append(None if row["piece"] == row["_last"] else run.saved())
            yield batch[keys].assign(**out)

    done, state = None, None
    for number in range(rounds + 1):
        now = sequences.where(F.col("piece") == number)
        if state is None:
            now = now.withColumn("saved", F.lit(None).cast("array<bigint>"))
        else:
            now = now.join(state, keys)
        ran = now.mapInPandas(replay, f"{key_types}saved array<bigint>, counts array<bigint>")
        if rounds:
            ran = ran.persist()
        finished = ran.where("counts is not null").select(*keys, "counts")
        done = finished if done is None else done.unionByName(finished)
        state = ran.where("saved is not null").select(*keys, "saved")
    names = ["produced", "consumed", "missing", "remaining"]
    counts = done.select(*keys, *[F.col("counts")[i].alias(name) for i, name in enumerate(names)])
    lost = F.col("missing") / F.col("consumed")
    left = F.col("remaining") / F.col("produced")
    return (
        variant_rows.select(*log, *SIGNATURE, "n_traces", "first.*")
        .join(counts, keys)
        .withColumn("fitness", F.lit(0.5) * (1 - lost) + F.lit(0.5) * (1 - left))
    )


def log_replay_fitness(replayed: DataFrame, log: list[str]) -> DataFrame:
    """Replay fitness of a log from its summed token counts."""
    sums = {c: F.sum(F.col(c) * F.col("n_traces")) for c in ("produced", "consumed", "missing", "remaining")}
    fitness = F.lit(0.5) * (1 - sums["missing"] / sums["consumed"]) + F.lit(0.5) * (
        1 - sums["remaining"] / sums["produced"]
    )
    return replayed.groupBy(*log).agg(fitness.alias("fitness"))

