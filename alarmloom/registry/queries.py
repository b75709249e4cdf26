"""One query per operator over the driver's tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from alarmloom.detectors.models import (
    Autoencoder,
    OneClassSvm,
    VariationalAutoencoder,
    reconstruction_threshold,
    score_statistics,
)
from alarmloom.functions import numbers, packets as px
from alarmloom.operators import (
    bands,
    cells,
    clean,
    conformance,
    discovery,
    eventlog,
    evaluate,
    profiles,
    scale,
    split,
    states,
    windows,
)
from alarmloom.operators.sizing import scratch_path
from alarmloom.plans import detection, triage
from alarmloom.registry import fixtures as fx
from alarmloom.schema import WINDOW_FEATURES
from alarmloom.sources import captures, flows as flow_files, logs, results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALARM = ["label", "case_id"]
TEXT_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(name: str):
    """Rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(name)


# Alarm bands


def _counts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Activity counts of inference traces, and the control-flow profile of training."""
    counts = profiles.activity_counts(fx.state_events(fx.packets(spark, sf_dir)), fx.TRACE)
    return fx.inference(counts), profiles.control_flow_profile(fx.training(counts))


def _banded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    counts, profile = _counts(spark, sf_dir)
    per_state = profiles.cosine_to_profile(counts, profile, fx.TRACE, "n")
    return counts, bands.with_band(profiles.mean_similarity(per_state, ALARM))


@query
def alarm_bands(spark, sf_dir):
    _, banded = _banded(spark, sf_dir)
    return bands.band_table(banded).select("cut", "band", "tp_count", "fp_count", r6("recall"), r6("precision"))


@query
def band_activity_stats(spark, sf_dir):
    counts, banded = _banded(spark, sf_dir)
    return bands.band_activity_means(counts, banded).select("band", "label", "activity", r6("mean_alignments"))


@query
def band_similarity_stats(spark, sf_dir):
    _, banded = _banded(spark, sf_dir)
    return bands.band_similarity_means(banded).select("band", "label", r6("mean_similarity"))


@query
def trace_alignment_level(spark, sf_dir):
    counts, _ = _counts(spark, sf_dir)
    return bands.alignment_levels(counts).select(*ALARM, r6("alignment_level"))


@query
def band_alignment_level(spark, sf_dir):
    counts, banded = _banded(spark, sf_dir)
    levels = bands.alignment_levels(counts)
    return bands.band_alignment_levels(levels, banded).select("band", "label", r6("mean_total_alignments"))


@query
def trace_similarity_by_label(spark, sf_dir):
    _, banded = _banded(spark, sf_dir)
    return bands.similarities_of(banded, "TP").unionByName(bands.similarities_of(banded, "FP")).select(
        *ALARM, r6("mean_similarity"), "band"
    )


@query
def trace_state_similarity(spark, sf_dir):
    counts, profile = _counts(spark, sf_dir)
    profiles.require_profiles(counts, profile)
    return profiles.cosine_to_profile(counts, profile, fx.TRACE, "n").select(*ALARM, "state", r6("similarity"))


# Packets, windows and states


@query
def client_direction(spark, sf_dir):
    source = fx.packets(spark, sf_dir)
    return windows.with_direction(source.rows.drop("direction"), fx.CASE, source.split).select(
        *ALARM, "packet_no", "client_ip", "direction"
    )


@query
def tcp_flag_names(spark, sf_dir):
    bits = (F.col("event_id") % 64).cast("int")
    return fx.table(spark, sf_dir, "events").select(
        "event_id", bits.alias("flag_bits"), px.tcp_flag_names(bits).alias("tcp_flag")
    )


@query
def activity_names(spark, sf_dir):
    return fx.raw_packets(spark, sf_dir).select(
        "event_id", px.activity_name(F.col("direction"), F.col("tcp_flag")).alias("activity")
    )


@query
def address_text(spark, sf_dir):
    packed = F.col("event_id") * F.lit(2654435761) % F.lit(4294967296)
    return fx.table(spark, sf_dir, "events").select(
        "event_id", packed.alias("packed"), px.ipv4_text(packed).alias("address")
    )


@query
def payload_values(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, "unreadable").when(F.col("event_id") % 11 != 0, F.col("value").cast("string"))
    return fx.table(spark, sf_dir, "events").select(
        "event_id", F.round(px.payload_or_zero(text), 6).alias("payload")
    )


@query
def epoch_to_timestamp(spark, sf_dir):
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    stamp = px.epoch_timestamp(epoch)
    return fx.table(spark, sf_dir, "events").select("event_id", F.date_format(stamp, TEXT_STAMP).alias("ts_text"))


@query
def packet_windows(spark, sf_dir):
    source = fx.packets(spark, sf_dir)
    held = fx.windows(source, ["ts"])
    return held.select(*ALARM, "window_no", F.explode("packets.packet_no").alias("packet_no"))


@query
def window_features(spark, sf_dir):
    return fx.windows(fx.packets(spark, sf_dir)).select(
        *ALARM, "window_no", r6("avg_payload"), *WINDOW_FEATURES[1:]
    )


@query
def packets_with_features(spark, sf_dir):
    source = fx.packets(spark, sf_dir)
    known = windows.with_first_sender(source.rows, fx.CASE, source.split)
    rows = windows.packets_with_features(known, fx.WINDOW, fx.CASE)
    return rows.select(
        *ALARM, "packet_no", "tcp_flag", "payload_size", "window_no", r6("avg_payload"), *WINDOW_FEATURES[1:]
    )


def _scaled_windows(spark, sf_dir, method):
    rows = fx.windows(fx.packets(spark, sf_dir)).persist()
    scaled = scale.fit_scaler(rows, WINDOW_FEATURES, method).transform(rows)
    return scaled.select(*ALARM, "window_no", *[r6(c) for c in WINDOW_FEATURES])


@query
def window_zscore(spark, sf_dir):
    return _scaled_windows(spark, sf_dir, "zscore")


@query
def window_minmax(spark, sf_dir):
    return _scaled_windows(spark, sf_dir, "min-max")


CENTROIDS = [[-1.0, 0.5, 0.0], [1.0, -0.5, 0.0], [0.0, 0.0, 1.5]]


@query
def state_assignment_fixed_centroids(spark, sf_dir):
    rows = fx.windows(fx.packets(spark, sf_dir)).persist()
    features = ["avg_payload", "n_ack", "n_syn"]
    scaled = list(scale.fit_zscore(fx.training(rows), features).expressions().values())
    state = states.state_name(states.nearest_centroid(scaled, CENTROIDS))
    return rows.select(*ALARM, "window_no", state.alias("state"))


def _clustered(spark, sf_dir, kind):
    rows = fx.windows(fx.packets(spark, sf_dir)).persist()
    if kind == "agglomerative":
        fitted = fx.training(rows)
        labelled = states.assign_states(states.fit_states(fitted, 2, kind), fitted, training=True)
    else:
        model = states.fit_states(fx.training(rows), 2, kind)
        path = scratch_path(spark, "states")
        model.save(spark, path)
        labelled = states.assign_states(states.StateModel.load(spark, path), rows, training=False)
    return labelled.select(*ALARM, "phase", "window_no", "state")


@query
def states_kmeans(spark, sf_dir):
    return _clustered(spark, sf_dir, "kmeans")


@query
def states_gmm(spark, sf_dir):
    return _clustered(spark, sf_dir, "gmm")


@query
def states_ward(spark, sf_dir):
    return _clustered(spark, sf_dir, "agglomerative")


# Event logs


@query
def state_event_log(spark, sf_dir):
    return fx.numbered_events(fx.packets(spark, sf_dir)).select(
        *ALARM, "state", "window_no", "event_no", "activity", "payload_size"
    )


@query
def time_ordered_log(spark, sf_dir):
    """The log renumbered by timestamp after its packet numbers were reversed."""
    source = fx.packets(spark, sf_dir)
    events = fx.state_events(source)
    shuffled = events.withColumn("packet_no", -F.col("packet_no"))
    ordered = eventlog.time_ordered(shuffled, fx.TRACE)
    return ordered.select(*ALARM, "state", F.col("packet_no").alias("event_no"), "activity", "payload_size")


def _unordered_log(spark, sf_dir) -> tuple[DataFrame, int | None]:
    """The product path on a capture out of time order, with states by rule."""
    source = fx.unordered_packets(spark, sf_dir)
    labelled = triage.window_rows(source.rows, fx.WINDOW, fx.CASE, source.split).withColumn("state", fx.rule_state())
    return triage.state_events(labelled, fx.CASE, split_at=source.split), source.split


@query
def unordered_capture_log(spark, sf_dir):
    events, _ = _unordered_log(spark, sf_dir)
    return events.select(*ALARM, "state", "event_no", "window_no", "activity", "payload_size")


@query
def unordered_event_durations(spark, sf_dir):
    events, split_at = _unordered_log(spark, sf_dir)
    rows = windows.event_durations(events, fx.TRACE, "packet_no", split_at)
    return rows.select(*ALARM, "state", "event_no", "activity", r6("duration"))


@query
def event_durations(spark, sf_dir):
    source = fx.packets(spark, sf_dir)
    rows = windows.event_durations(fx.state_events(source), fx.TRACE, "packet_no", source.split)
    return rows.select(*ALARM, "state", "packet_no", "activity", r6("duration"))


@query
def traces(spark, sf_dir):
    rows = eventlog.traces(fx.numbered_events(fx.packets(spark, sf_dir)), fx.TRACE)
    return rows.select(
        *ALARM,
        "state",
        "n_events",
        F.date_format("first_ts", TEXT_STAMP).alias("first_ts"),
        F.date_format("last_ts", TEXT_STAMP).alias("last_ts"),
        "payload_total",
    )


@query
def log_quality(spark, sf_dir):
    events = fx.state_events(fx.packets(spark, sf_dir))
    return states.state_quality(events, ["label", "state"]).select("label", "state", "n_traces", "n_events")


def _window_traces(spark, sf_dir) -> DataFrame:
    return eventlog.traces(fx.window_cases(fx.packets(spark, sf_dir)), fx.TRACE)


VARIANT = ["n_events", "n_traces", "first_case"]


@query
def variants(spark, sf_dir):
    return eventlog.variants(_window_traces(spark, sf_dir)).select("label", "state", *VARIANT)


@query
def variants_topk(spark, sf_dir):
    rows = eventlog.variants(_window_traces(spark, sf_dir)).persist()
    return eventlog.kept_variants(rows, 5).select("label", "state", "variant_no", *VARIANT)


@query
def variants_coverage(spark, sf_dir):
    rows = eventlog.variants(_window_traces(spark, sf_dir)).persist()
    return eventlog.kept_variants(rows, 0.6).select("label", "state", "variant_no", *VARIANT)


@query
def variant_filtered_log(spark, sf_dir):
    events = fx.window_cases(fx.packets(spark, sf_dir))
    kept = eventlog.filter_variants(events, 0.6, fx.TRACE)
    return kept.select(*ALARM, "state", "event_no", "activity")


@query
def variant_unfiltered_log(spark, sf_dir):
    """A threshold of 1 keeps every variant."""
    kept = eventlog.filter_variants(fx.window_cases(fx.packets(spark, sf_dir)), 1.0, fx.TRACE)
    return kept.select(*ALARM, "state", "event_no", "activity")


@query
def variant_sequences(spark, sf_dir):
    events = fx.window_cases(fx.packets(spark, sf_dir))
    rows = eventlog.variants(eventlog.traces(events, fx.TRACE))
    return eventlog.variant_steps(events, rows).select("label", "state", "case_id", "n_traces", "event_no", "activity")


@query
def conversation_variants(spark, sf_dir):
    log = ["log"]
    rows = eventlog.traces(fx.conversation_events(spark, sf_dir), ["log", "case_id"])
    kept = eventlog.kept_variants(eventlog.variants(rows, log), 10, log)
    return kept.select("variant_no", *VARIANT)


@query
def directly_follows(spark, sf_dir):
    source = fx.packets(spark, sf_dir)
    rows = eventlog.directly_follows(fx.state_events(source), fx.TRACE, ["label", "state"], source.split)
    return rows.select("label", "state", "activity", "next_activity", "n")


@query
def start_end_activities(spark, sf_dir):
    events = fx.state_events(fx.packets(spark, sf_dir))
    rows = eventlog.start_end_activities(events, fx.TRACE, ["label", "state"])
    return rows.select("label", "state", "position", "activity", "n")


@query
def frequent_pairs(spark, sf_dir):
    """Directly-follows pairs that pass a noise share of 0.5."""
    source = fx.packets(spark, sf_dir)
    pairs = eventlog.directly_follows(fx.state_events(source), fx.TRACE, ["label", "state"], source.split)
    named = pairs.select("label", "state", F.col("activity").alias("a"), F.col("next_activity").alias("b"), "n")
    return discovery.mark_frequent(named, 0.5, ["label", "state"]).where("kept").drop("kept")


# Discovery and conformance


def _discovered(spark, sf_dir) -> tuple[fx.Packets, DataFrame, DataFrame]:
    source = fx.packets(spark, sf_dir)
    events = fx.numbered_events(source).persist()
    return source, events, discovery.discover_trees(
        fx.model_steps(fx.training(events), source.split), ["state"], split=source.split
    )


@query
def discovered_model(spark, sf_dir):
    return _discovered(spark, sf_dir)[2]


@query
def discovered_model_noise(spark, sf_dir):
    source = fx.packets(spark, sf_dir)
    events = fx.numbered_events(source).persist()
    return discovery.discover_trees(
        fx.model_steps(fx.training(events), source.split), ["state"], noise=0.2, split=source.split
    )


@query
def model_arcs(spark, sf_dir):
    return discovery.net_tables(_discovered(spark, sf_dir)[2], ["state"])[1]


def _aligned(spark, sf_dir, phase) -> conformance.Alignments:
    source, events, tree = _discovered(spark, sf_dir)
    return conformance.Alignments(events.where(F.col("phase") == phase), tree, ["state"], fx.TRACE, source.split)


@query
def alignments(spark, sf_dir):
    return _aligned(spark, sf_dir, "inference").trace_fitness().select(
        *ALARM, "state", "n_events", "deviations", "worst", r6("fitness")
    )


@query
def sync_move_counts(spark, sf_dir):
    return _aligned(spark, sf_dir, "inference").sync_counts().select(*ALARM, "state", "activity", "n")


@query
def training_sync_moves(spark, sf_dir):
    """Every training trace fits, so its synchronous moves are its activity counts."""
    return _aligned(spark, sf_dir, "training").sync_counts().select(*ALARM, "state", "activity", "n")


@query
def log_fitness(spark, sf_dir):
    return _aligned(spark, sf_dir, "training").log_fitness().select("state", "n_traces", r6("fitness"))


@query
def inference_log_fitness(spark, sf_dir):
    return _aligned(spark, sf_dir, "inference").log_fitness().select("state", "n_traces", r6("fitness"))


@query
def token_replay(spark, sf_dir):
    source, events, tree = _discovered(spark, sf_dir)
    replayed = conformance.token_replay(fx.inference(events), tree, ["state"], fx.TRACE, source.split)
    return replayed.select(*ALARM, "state", "produced", "consumed", "missing", "remaining", r6("fitness"))


def _fixed(spark, sf_dir) -> conformance.Alignments:
    source = fx.packets(spark, sf_dir)
    return conformance.Alignments(fx.numbered_events(source), fx.fixed_model(spark), ["state"], fx.TRACE, source.split)


def _fitness(spark, sf_dir) -> DataFrame:
    return _fixed(spark, sf_dir).trace_fitness()


@query
def fixed_alignments(spark, sf_dir):
    """Alignments with models whose costs are known in closed form."""
    return _fitness(spark, sf_dir).select(*ALARM, "state", "n_events", "deviations", "worst", r6("fitness"))


@query
def fixed_sync_moves(spark, sf_dir):
    return _fixed(spark, sf_dir).sync_counts().select(*ALARM, "state", "activity", "n")


@query
def fixed_log_fitness(spark, sf_dir):
    return _fixed(spark, sf_dir).log_fitness().select("state", "n_traces", r6("fitness"))


@query
def trace_fitness_mean(spark, sf_dir):
    return conformance.mean_trace_fitness(_fitness(spark, sf_dir), ALARM).select(*ALARM, r6("fitness"), "n_states")


@query
def trace_fitness_min(spark, sf_dir):
    return conformance.min_trace_fitness(_fitness(spark, sf_dir), ALARM).select(*ALARM, r6("fitness"))


@query
def robust_threshold(spark, sf_dir):
    means = conformance.mean_trace_fitness(_fitness(spark, sf_dir), ALARM)
    return means.groupBy("label").agg(
        F.round(numbers.robust_floor(F.col("fitness")), 6).alias("threshold"), F.count("*").alias("n_traces")
    )


@query
def rated_alarms(spark, sf_dir):
    """The whole rating with clustered states, discovered models and alignments."""
    source = fx.packets(spark, sf_dir)
    rows = triage.window_rows(source.rows, fx.WINDOW, fx.CASE, source.split).persist()
    model = states.fit_states(fx.training(rows), 2)
    events = triage.state_events(model.transform(rows), fx.CASE, split_at=source.split).persist()
    trained = triage.train(fx.training(events), fx.TRACE, split_at=source.split)
    rated = triage.rate(fx.inference(events), trained, fx.TRACE, split_at=source.split)
    return rated.table.select("cut", "band", "tp_count", "fp_count", r6("recall"), r6("precision"))


# Profiles and similarities


@query
def control_flow_profile(spark, sf_dir):
    counts = profiles.activity_counts(fx.training(fx.state_events(fx.packets(spark, sf_dir))), fx.TRACE)
    return profiles.control_flow_profile(counts).select("state", "activity", r6("value"))


def _training_durations(spark, sf_dir) -> DataFrame:
    source = fx.packets(spark, sf_dir)
    return windows.event_durations(fx.training(fx.state_events(source)), fx.TRACE, "packet_no", source.split)


@query
def timing_profile(spark, sf_dir):
    return profiles.timing_profile(_training_durations(spark, sf_dir)).select(
        "state", "activity", F.round("value", 3).alias("value")
    )


@query
def payload_profile(spark, sf_dir):
    events = fx.training(fx.state_events(fx.packets(spark, sf_dir)))
    return profiles.payload_profile(events).select("state", "activity", r6("value"))


def _durations(spark, sf_dir) -> DataFrame:
    source = fx.packets(spark, sf_dir)
    return windows.event_durations(fx.state_events(source), fx.TRACE, "packet_no", source.split)


@query
def trace_timing_profile(spark, sf_dir):
    rows = profiles.trace_timings(_durations(spark, sf_dir), fx.TRACE)
    return rows.select(*ALARM, "state", "activity", F.round("value", 3).alias("value"), "n")


@query
def trace_payload_profile(spark, sf_dir):
    rows = profiles.trace_payloads(fx.state_events(fx.packets(spark, sf_dir)), fx.TRACE)
    return rows.select(*ALARM, "state", "activity", r6("value"), "n")


@query
def trace_timing_similarity(spark, sf_dir):
    durations = _durations(spark, sf_dir)
    profile = profiles.timing_profile(fx.training(durations))
    timings = profiles.trace_timings(fx.inference(durations), fx.TRACE)
    return profiles.cosine_to_profile(timings, profile, fx.TRACE).select(*ALARM, "state", r6("similarity"))


@query
def trace_payload_similarity(spark, sf_dir):
    events = fx.state_events(fx.packets(spark, sf_dir))
    profile = profiles.payload_profile(fx.training(events))
    payloads = profiles.trace_payloads(fx.inference(events), fx.TRACE)
    return profiles.cosine_to_profile(payloads, profile, fx.TRACE).select(*ALARM, "state", r6("similarity"))


def _split_events(spark, sf_dir) -> tuple[fx.Packets, DataFrame, DataFrame]:
    source = fx.packets(spark, sf_dir)
    return source, *fx.parts_of_training(fx.state_events(source), source.split)


@query
def trace_split(spark, sf_dir):
    source = fx.packets(spark, sf_dir)
    sizes = fx.training(fx.state_events(source)).groupBy(*fx.TRACE).agg(F.count("*").alias("n"))
    return split.split_traces(sizes, ["state"]).select("state", "case_id", "part")


@query
def state_similarity_control(spark, sf_dir):
    _, fitted, held_out = _split_events(spark, sf_dir)
    profile = profiles.control_flow_profile(profiles.activity_counts(fitted, fx.TRACE))
    counts = profiles.activity_counts(held_out, fx.TRACE)
    return profiles.state_similarity_of_traces(counts, profile, fx.TRACE).select("state", r6("similarity"))


@query
def state_similarity_timing(spark, sf_dir):
    source, fitted, held_out = _split_events(spark, sf_dir)
    one, other = (
        profiles.timing_profile(windows.event_durations(rows, fx.TRACE, "packet_no", source.split))
        for rows in (fitted, held_out)
    )
    return profiles.state_similarity_pooled(one, other).select("state", r6("similarity"))


@query
def state_similarity_payload(spark, sf_dir):
    _, fitted, held_out = _split_events(spark, sf_dir)
    one, other = profiles.payload_profile(fitted), profiles.payload_profile(held_out)
    return profiles.state_similarity_pooled(one, other).select("state", r6("similarity"))


# Flows


def _cleaned(spark, sf_dir) -> DataFrame:
    rows = clean.drop_zero(fx.flows(spark, sf_dir), "duration")
    rows = clean.to_numbers(rows, ["delta_start"])
    return clean.clean_numbers(rows, ["duration", *fx.FLOW_FEATURES])


@query
def flow_clean(spark, sf_dir):
    rows = clean.drop_columns(_cleaned(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return clean.set_label(rows, 1).withColumn("label", F.col("label").cast("bigint"))


@query
def protocol_codes(spark, sf_dir):
    return clean.appearance_codes(fx.flows(spark, sf_dir), "protocol", fx.FLOW_IDS)


@query
def protocol_codes_by_label(spark, sf_dir):
    rows = fx.flows(spark, sf_dir).withColumn("label", F.col("label").cast("bigint"))
    return clean.appearance_codes(rows, "protocol", fx.FLOW_IDS, ["label"])


@query
def protocol_encoded(spark, sf_dir):
    rows = clean.encode_by_appearance(fx.flows(spark, sf_dir), "protocol", fx.FLOW_IDS)
    return rows.select("flow_identifier", "protocol")


@query
def flow_minmax(spark, sf_dir):
    rows = _cleaned(spark, sf_dir)
    scaled = scale.fit_minmax(rows.where("label = 1"), fx.FLOW_FEATURES).transform(rows)
    return scaled.select("flow_identifier", *[r6(c) for c in fx.FLOW_FEATURES])


@query
def holdout_split(spark, sf_dir):
    normal = fx.flows(spark, sf_dir).where("label = 1")
    return split.holdout(normal, "flow_identifier").select("flow_identifier", "part")


@query
def validation_split(spark, sf_dir):
    parts = split.detection_parts(fx.flows(spark, sf_dir), "flow_identifier")
    return parts.select("flow_identifier", F.col("label").cast("bigint").alias("label"), "part")


@query
def stacked_test_rows(spark, sf_dir):
    parts = split.detection_parts(fx.flows(spark, sf_dir), "flow_identifier")
    return parts.groupBy("part").agg(
        F.count_if(F.col("label") == 1).alias("benign"), F.count_if(F.col("label") == -1).alias("anomalies")
    )


def _false_alarms(spark, sf_dir) -> DataFrame:
    rows = fx.predictions(spark, sf_dir)
    alarms = evaluate.alarm_lists(rows).where("kind = 'false_positives'")
    return evaluate.membership(alarms, fx.DETECTORS)


@query
def repeated_split(spark, sf_dir):
    false_alarms = _false_alarms(spark, sf_dir)
    rated = fx.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return split.repeated_alarm_split(false_alarms, rated, fx.DETECTORS)


@query
def recon_threshold(spark, sf_dir):
    """Threshold, labels and statistics for a score that SQL can express."""
    rows = fx.flows(spark, sf_dir).withColumn("score", F.col("price") / 1000.0 + F.col("discount"))
    threshold = reconstruction_threshold(rows.where("label = 1"), 1.75)
    labelled = rows.withColumn("prediction", numbers.label_by_threshold(F.col("score"), F.lit(threshold)))
    found = score_statistics(labelled, ["prediction"]).withColumn("threshold", F.lit(threshold))
    columns = ["threshold", "mean_score", "std_score", "min_score", "max_score"]
    return found.select(F.col("prediction").cast("bigint").alias("prediction"), *[r6(c) for c in columns])


@query
def rff_svm_scores(spark, sf_dir):
    return _scores(spark, sf_dir, OneClassSvm())


@query
def autoencoder_scores(spark, sf_dir):
    return _scores(spark, sf_dir, Autoencoder())


@query
def vae_scores(spark, sf_dir):
    return _scores(spark, sf_dir, VariationalAutoencoder())


def _scores(spark, sf_dir, detector) -> DataFrame:
    return detection.run_detectors(fx.embedding_flows(spark, sf_dir), [detector])


@query
def detector_comparison(spark, sf_dir):
    """All detectors on the cleaned and scaled flows, as a metrics report."""
    prepared = detection.prepare_flows(
        fx.flows(spark, sf_dir), fx.FLOW_FEATURES, fx.FLOW_IDS, "protocol", fx.FLOW_IDS
    )
    detectors = [OneClassSvm(), Autoencoder(), VariationalAutoencoder()]
    return detection.compare(detection.run_detectors(prepared, detectors), [d.name for d in detectors])["report"]


# Evaluation


@query
def confusion(spark, sf_dir):
    return evaluate.confusion(fx.predictions(spark, sf_dir))


@query
def detector_metrics(spark, sf_dir):
    rows = evaluate.detector_metrics(fx.predictions(spark, sf_dir))
    measures = ["accuracy", "precision", "recall", "f1_score", "specificity", "fpr", "fnr"]
    return rows.select("model", "tp", "tn", "fp", "fn", "benign_samples", "anomaly_samples", *[r6(c) for c in measures])


@query
def class_report(spark, sf_dir):
    rows = evaluate.class_report(fx.predictions(spark, sf_dir))
    return rows.select("model", "row", *[r6(c) for c in ("precision", "recall", "f1_score")], "support")


@query
def fp_fn_lists(spark, sf_dir):
    return evaluate.alarm_lists(fx.predictions(spark, sf_dir))


def _members(spark, sf_dir) -> DataFrame:
    alarms = evaluate.alarm_lists(fx.predictions(spark, sf_dir)).where("kind = 'false_positives'")
    return evaluate.membership(alarms, fx.DETECTORS)


@query
def detector_membership(spark, sf_dir):
    return _members(spark, sf_dir)


@query
def common_alarms(spark, sf_dir):
    return evaluate.common_ids(_members(spark, sf_dir), fx.DETECTORS)


@query
def first_common_alarms(spark, sf_dir):
    return evaluate.first_ids(evaluate.common_ids(_members(spark, sf_dir), fx.DETECTORS), 10)


@query
def alarm_counts(spark, sf_dir):
    return evaluate.flag_counts(_members(spark, sf_dir), fx.DETECTORS)


@query
def metrics_report(spark, sf_dir):
    return evaluate.metrics_report(evaluate.detector_metrics(fx.predictions(spark, sf_dir)))


# Sources and sinks


@query
def xes_round_trip(spark, sf_dir):
    path = scratch_path(spark, "xes")
    events = fx.numbered_events(fx.packets(spark, sf_dir))
    logs.write_xes(events, path)
    read = logs.numbered_xes(logs.read_xes(spark, path))
    return read.select(
        *ALARM, "state", "event_no", "activity", F.date_format("ts", TEXT_STAMP).alias("ts_text"), "payload_size"
    )


@query
def event_log_store(spark, sf_dir):
    path = scratch_path(spark, "events")
    logs.write_event_log(fx.numbered_events(fx.packets(spark, sf_dir)).drop("phase"), path)
    return logs.read_event_log(spark, path, "TP").select(
        "label", "state", "case_id", "event_no", "activity", "payload_size"
    )


@query
def flow_csv_scan(spark, sf_dir):
    """Flows written as CSV with an index column, read back with their identifiers."""
    path = scratch_path(spark, "flows")
    rows = fx.flows(spark, sf_dir).withColumn("index", F.col("flow_identifier"))
    rows.write.option("header", True).csv(path)
    read = flow_files.numeric_columns(flow_files.read_flows(spark, path), ["flow_identifier", "index", "protocol"])
    index = F.regexp_extract("flow_identifier", "_flow_(.*)$", 1)
    return read.select(index.alias("flow_id"), "duration", "protocol", r6("price"), r6("delta_start"))


@query
def capture_ingest(spark, sf_dir):
    """Packets written as rotated capture files and read again by byte ranges."""
    source = fx.packets(spark, sf_dir)
    path = scratch_path(spark, "captures")
    captures.write_captures(fx.with_real_addresses(source.rows), path, fx.FILE_PACKETS)
    found = captures.read_captures(spark, path, source.split, rotated=True)
    return found.select(
        "label", "case_id", "packet_no", "src_ip", "dst_ip", F.col("src_port").cast("bigint").alias("src_port"),
        F.col("dst_port").cast("bigint").alias("dst_port"), "tcp_flag", "payload_size", "direction",
        F.date_format("ts", TEXT_STAMP).alias("ts_text"),
    )


@query
def capture_errors(spark, sf_dir):
    """Capture files that cannot be read, and the packets of all others."""
    path = scratch_path(spark, "damaged")
    captures.write_records(fx.damaged_records(fx.packets(spark, sf_dir).rows), path)
    decoded = captures.scan(spark, path, range_bytes=4096)
    name = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    errors = captures.ingest_errors(decoded).select(name.alias("file"), "reason", F.lit(0).cast("bigint").alias("n_packets"))
    read = captures.packets_of(decoded).groupBy(F.concat_ws("/", "label", "case_id").alias("file")).agg(F.count("*").alias("n_packets"))
    return errors.unionByName(read.withColumn("reason", F.lit(None).cast("string")))


@query
def alarm_semi_join(spark, sf_dir):
    """Alarmed orders that have line items, as alarms that have packets."""
    alarms = fx.table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"))
    captured = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"))
    return flow_files.alarms_with_capture(alarms, captured)


@query
def labelled_captures(spark, sf_dir):
    return flow_files.captures_with_label(fx.raw_packets(spark, sf_dir), "TP")


@query
def schema_union(spark, sf_dir):
    """Tables of unequal columns, united by name."""
    one = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("quantity")
    )
    other = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")
    )
    return flow_files.union_flows([one, other])


@query
def sorted_flows(spark, sf_dir):
    return clean.sort_by(fx.flows(spark, sf_dir).select("flow_identifier", "price"), "price")


@query
def scores_store(spark, sf_dir):
    path = scratch_path(spark, "scores")
    rows = fx.predictions(spark, sf_dir).withColumn("score", F.col("id") % 10 / F.lit(10.0))
    results.write_scores(rows, path)
    return spark.read.parquet(path).select("model", "flow_id", r6("anomaly_score"))


@query
def alarm_list_store(spark, sf_dir):
    path = scratch_path(spark, "alarms")
    alarms = evaluate.alarm_lists(fx.predictions(spark, sf_dir))
    results.write_alarm_lists(alarms.withColumn("id", F.col("id").cast("string")), path)
    return results.read_alarm_list(spark, path, "low_quality", "false_negatives")


@query
def membership_csv(spark, sf_dir):
    path = scratch_path(spark, "membership")
    results.write_membership(_members(spark, sf_dir), path)
    return flow_files.read_alarms(spark, path, fx.DETECTORS)


@query
def metrics_csv(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    report = evaluate.metrics_report(evaluate.detector_metrics(fx.predictions(spark, sf_dir)))
    results.write_metrics_report(report, path)
    return spark.read.option("header", True).csv(path).select("model", "accuracy", "f1_score", "tp", "fp")


@query
def split_layout(spark, sf_dir):
    path = scratch_path(spark, "split")
    results.write_split(repeated_split(spark, sf_dir), path)
    read = spark.read.parquet(path)
    return read.groupBy(F.col("repetition").cast("bigint").alias("repetition"), "detector", "phase", "label").agg(
        F.count("*").alias("n")
    )


@query
def profile_store(spark, sf_dir):
    path = scratch_path(spark, "profiles")
    events = fx.training(fx.state_events(fx.packets(spark, sf_dir))).persist()
    held = {
        "control_flow": profiles.control_flow_profile(profiles.activity_counts(events, fx.TRACE)),
        "payload": profiles.payload_profile(events),
    }
    logs.write_profiles(held, {}, path, digits=6)
    return spark.read.parquet(f"{path}/training_profile").select("perspective", "state", "activity", "value")


@query
def band_json(spark, sf_dir):
    """The nested band result, written as JSON and read back."""
    path = scratch_path(spark, "bands")
    counts, banded = _banded(spark, sf_dir)
    counts, banded = counts.persist(), banded.persist()
    document = results.band_document(
        bands.band_table(banded),
        bands.band_alignment_levels(bands.alignment_levels(counts), banded),
        bands.band_activity_means(counts, banded),
        bands.band_similarity_means(banded),
    )
    results.write_band_results(document, banded, path)
    read = spark.read.schema(document.schema).json(f"{path}/results")
    return read.select(
        "cut",
        F.col("result.band_threshold").alias("band"),
        F.round("result.recall_sigma", 6).alias("recall"),
        F.round("result.precision_sigma", 6).alias("precision"),
        F.col("result.tp_bands")["BAND_25_75"].alias("tp_middle"),
        F.col("result.fp_bands")["BAND_75_99"].alias("fp_high"),
        F.round(F.col("result.band_stats.mean_similarity")["BAND_25_75"]["TP"], 6).alias("similarity_middle"),
    )


@query
def model_store(spark, sf_dir):
    path = scratch_path(spark, "model")
    _, _, tree = _discovered(spark, sf_dir)
    nodes, arcs = discovery.net_tables(tree, ["state"])
    logs.write_model(tree, nodes, arcs, path)
    return logs.read_model(spark, path)


@query
def threshold_store(spark, sf_dir):
    path = scratch_path(spark, "threshold")
    means = conformance.mean_trace_fitness(_fitness(spark, sf_dir), ALARM)
    value = means.agg(numbers.robust_floor(F.col("fitness")).alias("t")).first()["t"]
    results.write_named_values(spark, {"fitness_threshold": value}, path)
    held = results.read_named_value(spark, path, "fitness_threshold")
    return means.groupBy().agg(
        F.count_if(F.col("fitness") >= held).alias("kept"), F.round(F.lit(held), 6).alias("threshold")
    )


@query
def experiment_grid(spark, sf_dir):
    """Rating per repetition, detector, window size and number of states, and the cells that failed."""
    source = fx.packets(spark, sf_dir)
    parts = split.repeated_alarm_split(*fx.grid_alarms(source.rows), fx.ALARM_DETECTORS)
    grid = triage.run_grid(source.rows.drop("phase"), parts, [3, 5], [2, 3], split_at=source.split)
    rated = grid.table.select(*triage.CELL, "cut", "band", "tp_count", "fp_count", r6("recall"), r6("precision"))
    return rated.unionByName(grid.errors, allowMissingColumns=True)


def _planted(spark, sf_dir) -> DataFrame:
    return fx.planted_windows(spark, sf_dir).withColumn("clusters", F.lit(3).cast("bigint"))


@query
def cell_states(spark, sf_dir):
    """States of all cells from one keyed fit, on windows whose groups are known."""
    rows = _planted(spark, sf_dir)
    return cells.fit_cells(rows, ["part", "clusters"]).transform(rows).select("part", "event_id", "state")


@query
def cell_failures(spark, sf_dir):
    """Cells that cannot be fitted: too few distinct windows, and none at all."""
    rows = _planted(spark, sf_dir)
    asked = rows.select("part", "clusters").distinct()
    asked = asked.unionByName(asked.select((F.col("part") + 10).alias("part"), "clusters"))
    return cells.fit_cells(rows, ["part", "clusters"], wanted=asked).failures


@query
def planted_states(spark, sf_dir):
    """States by every clustering method, on windows whose groups are known."""
    rows = _planted(spark, sf_dir).where("part < 2").persist()
    found = []
    for kind in ("kmeans", "gmm", "agglomerative"):
        model = states.fit_states(rows, 3, kind)
        labelled = states.assign_states(model, rows, training=True)
        found.append(labelled.select(F.lit(kind).alias("method"), "part", "event_id", "state"))
    return found[0].unionByName(found[1]).unionByName(found[2])
