"""Alarm rating from packets to bands: training on false alarms, then rating both kinds.

Grid columns (repetition, detector, window size, number of clusters) are part of
the keys: one job handles all cells, their clusterings included.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from alarmloom.operators import bands, cells, conformance, discovery, eventlog, profiles, split, windows
from alarmloom.operators.sizing import cut_lineage, small_side
from alarmloom.schema import FALSE_ALARM, TRUE_ALARM, WINDOW_FEATURES
from alarmloom.sources import logs

HELD = ["ts", "direction", "tcp_flag", "payload_size"]


@dataclass
class Trained:
    """What the training run hands to the rating run."""

    tree: DataFrame
    profiles: dict[str, DataFrame]
    similarities: dict[str, DataFrame]

    def save(self, path: str, digits: int | None = None) -> None:
        log = [c for c in self.tree.columns if c not in ("node", "parent", "position", "operator", "activity")]
        nodes, arcs = discovery.net_tables(self.tree, log)
        logs.write_model(self.tree, nodes, arcs, f"{path}/model")
        logs.write_profiles(self.profiles, self.similarities, path, digits)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Trained":
        names = ("control_flow", "timing", "payload")
        return Trained(
            logs.read_model(spark, f"{path}/model"),
            {n: logs.read_profile(spark, path, n) for n in names},
            {n: logs.read_similarity(spark, path, n) for n in names},
        )


def labels_for(mode: str) -> list[str]:
    """Training reads false alarms only, inference both kinds."""
    if mode not in ("training", "inference"):
        raise ValueError(f"mode must be training or inference, not {mode}")
    return [FALSE_ALARM] if mode == "training" else [FALSE_ALARM, TRUE_ALARM]


def window_rows(packets: DataFrame, size: int, keys: list[str], split_at: int | None = None) -> DataFrame:
    """Full windows with features and their packets."""
    return windows.full_windows(windows.with_first_sender(packets, keys, split_at), size, keys, HELD)


def state_events(
    labelled: DataFrame, keys: list[str], threshold: float = 1.0, split_at: int | None = None
) -> DataFrame:
    """Events of windows that carry a state, in time order, after variant filtering.

    Windows follow the order of capture; the log of a state follows time.
    """
    trace = [*keys[:-1], "state", keys[-1]]
    events = eventlog.time_ordered(windows.route_windows(labelled, F.col("state"), keys), trace, split_at)
    return eventlog.filter_variants(events, threshold, trace, trace[:-1], split_at)


def train(
    events: DataFrame,
    trace: list[str],
    model: list[str] = ("state",),
    noise: float = 0.0,
    validation: float = 0.2,
    split_at: int | None = None,
) -> Trained:
    """Models, profiles and similarities from the false alarms' events.

    model names the grid columns and the state: one model per value.
    """
    model = list(model)
    ids = [c for c in trace if c not in model]
    sizes = events.groupBy(*trace).agg(F.max("packet_no").alias("_last"))
    parts = split.split_traces(sizes, model, validation)
    marked = eventlog.join_per_group(events, parts, trace, "packet_no", split_at, "inner").persist()
    fitted, held_out = marked.where("part = 'training'"), marked.where("part = 'validation'")

    rows = eventlog.variants(eventlog.traces(fitted, trace), model, ids)
    sid = F.to_json(F.struct(*ids), {"ignoreNullFields": "false"})
    steps = eventlog.variant_steps(fitted, rows, model, ids, split_at).select(
        *model, sid.alias("sid"), F.col("event_no").alias("pos"), "activity", F.col("n_traces").alias("weight")
    )
    tree = discovery.discover_trees(steps, model, noise, split_at)

    # One pass aligns both parts: variants they share are aligned once.
    with_part = [*trace[:-1], "part", trace[-1]]
    synced = conformance.Alignments(marked, tree, model, with_part, split_at).sync_counts().persist()
    counts, held_counts = synced.where("part = 'training'"), synced.where("part = 'validation'")
    control = profiles.control_flow_profile(counts, model)
    durations = windows.event_durations(marked, trace, "packet_no", split_at)
    timing = profiles.timing_profile(durations.where("part = 'training'"), model)
    payload = profiles.payload_profile(fitted, model)
    held_timing = profiles.timing_profile(durations.where("part = 'validation'"), model)
    held_payload = profiles.payload_profile(held_out, model)
    return Trained(
        tree,
        {"control_flow": control, "timing": timing, "payload": payload},
        {
            "control_flow": profiles.state_similarity_of_traces(held_counts, control, trace, "n", model),
            "timing": profiles.state_similarity_pooled(timing, held_timing, model),
            "payload": profiles.state_similarity_pooled(payload, held_payload, model),
        },
    )


@dataclass
class Rated:
    """Rated alarms: counts per trace, mean similarity and band per trace, band table."""

    counts: DataFrame
    banded: DataFrame
    table: DataFrame
    errors: DataFrame | None = None


def rate(
    events: DataFrame,
    trained: Trained,
    trace: list[str],
    model: list[str] = ("state",),
    grid: list[str] = (),
    split_at: int | None = None,
    skip: bool = False,
) -> Rated:
    """Alarm bands of inference traces; a state without a training profile is an error.

    With skip, such a state takes its grid cell out: the cell has a row in errors.
    """
    model = list(model)
    alarm = [c for c in trace if c != "state"]
    counts = conformance.Alignments(events, trained.tree, model, trace, split_at).sync_counts().persist()
    control = trained.profiles["control_flow"].persist()
    errors = None
    if skip:
        lost = profiles.without_profile(counts, control, model)
        named = F.concat(F.lit("no training profile for "), F.array_join(F.array_sort(F.collect_set("state")), ", "))
        errors = cut_lineage(lost.groupBy(*grid).agg(named.alias("reason")))
        counts = counts.join(small_side(errors.drop("reason")), list(grid), "left_anti")
    else:
        profiles.require_profiles(counts, control, model)
    per_state = profiles.cosine_to_profile(counts, control, trace, "n", model)
    banded = bands.with_band(profiles.mean_similarity(per_state, alarm)).persist()
    return Rated(counts, banded, bands.band_table(banded, list(grid)), errors)


CELL = ["repetition", "detector", "window_size", "clusters"]


@dataclass
class Grid:
    """Band tables of all cells that could be rated, and why the others could not."""

    banded: DataFrame
    table: DataFrame
    errors: DataFrame


def grid_windows(packets: DataFrame, parts: DataFrame, sizes: list[int], clusters: list[int], split_at: int | None = None) -> DataFrame:
    """Windows of every cell.

    parts is the repeated split (repetition, detector, phase, label, id). The windows of a
    size are computed once; the split and the numbers of states repeat them.
    """
    keys = ["label", "case_id"]
    per_size = [
        window_rows(packets, size, keys, split_at).withColumn("window_size", F.lit(size).cast("bigint")) for size in sizes
    ]
    rows = reduce(lambda a, b: a.unionByName(b), per_size)
    # Cells multiply the rows, so before that they are dealt by number and not by their size. In the
    # order of the keys, Spark would take them as dealt already and put small partitions together.
    n = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *reversed(keys), *(["window_no"] if split_at else []))
    members = small_side(parts.withColumnRenamed("id", "case_id"))
    numbers = F.array(*[F.lit(k).cast("bigint") for k in clusters])
    return rows.join(members, keys).withColumn("clusters", F.explode(numbers))


def run_grid(
    packets: DataFrame,
    parts: DataFrame,
    sizes: list[int],
    clusters: list[int],
    normalization: str = "zscore",
    noise: float = 0.0,
    validation: float = 0.2,
    split_at: int | None = None,
) -> Grid:
    """Rating in every cell of repetition, detector, window size and number of states.

    All cells go through the same jobs, their columns being part of the keys. A cell whose
    states cannot be fitted, or that meets a state without a training profile, gives a row
    in errors and none in the table.
    """
    found = grid_windows(packets, parts, sizes, clusters, split_at)
    # The cells that the settings ask for: as many rows as the grid has.
    asked = parts.select("repetition", "detector").distinct()
    for name, values in (("window_size", sizes), ("clusters", clusters)):
        asked = asked.withColumn(name, F.explode(F.array(*[F.lit(v).cast("bigint") for v in values])))
    narrow = found.where("phase = 'training'").select(*CELL, *WINDOW_FEATURES)
    model = cells.fit_cells(narrow, CELL, "clusters", WINDOW_FEATURES, normalization, asked)
    keys = [*CELL, "label", "phase", "case_id"]
    trace, log = [*keys[:-1], "state", "case_id"], [*CELL, "state"]
    events = cut_lineage(state_events(model.transform(found), keys, split_at=split_at))
    trained = train(events.where("phase = 'training'"), trace, log, noise, validation, split_at)
    rated = rate(events.where("phase = 'inference'"), trained, trace, log, CELL, split_at, skip=True)
    return Grid(rated.banded, rated.table, model.failures.unionByName(rated.errors))
