import pytest
from pyspark.sql import functions as F

from alarmloom.operators import eventlog, states, windows
from alarmloom.plans import triage

KEYS = ["label", "case_id"]
COLUMNS = "label string, case_id string, packet_no long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flag string, payload_size long"


def packets(spark, flags_by_case, gap=1.0):
    rows = []
    for (label, case), flags in flags_by_case.items():
        for i, flag in enumerate(flags):
            out = i % 2 == 0
            rows.append((label, case, i + 1, i * gap, "c", "s", 5000, 443, flag, 10 * i) if out else
                        (label, case, i + 1, i * gap, "s", "c", 443, 5000, flag, 10 * i))
    held = spark.createDataFrame(rows, COLUMNS.replace("ts timestamp", "ts double"))
    return held.withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


def test_partial_windows_and_short_flows_are_dropped(spark):
    rows = packets(spark, {("FP", "long"): ["SYN"] * 7, ("FP", "short"): ["ACK"] * 2})
    found = windows.full_windows(windows.with_first_sender(rows), 3).orderBy("window_no").collect()
    assert [(r["case_id"], r["window_no"], r["avg_payload"]) for r in found] == [("long", 0, 10.0), ("long", 1, 40.0)]
    assert found[0]["n_servers"] == 1 and found[0]["n_user_ports"] == 1 and found[0]["n_syn"] == 3


def test_flag_counts_use_names_inside_combined_flags(spark):
    rows = packets(spark, {("FP", "a"): ["SYN+ACK", "ACK+PSH", "ACK+FIN+RST"]})
    row = windows.full_windows(windows.with_first_sender(rows), 3).first()
    assert [row[c] for c in ("n_ack", "n_syn", "n_fin", "n_psh", "n_rst")] == [3, 1, 1, 1, 1]


@pytest.mark.parametrize("split", [None, 2])
def test_direction_and_client(spark, split):
    rows = packets(spark, {("FP", "a"): ["SYN"] * 5, ("TP", "a"): ["ACK"] * 3})
    found = windows.with_direction(rows, split=split).orderBy("label", "packet_no").collect()
    assert [r["direction"] for r in found] == ["C_to_S", "S_to_C"] * 2 + ["C_to_S"] + ["C_to_S", "S_to_C", "C_to_S"]


def test_durations_skip_the_last_event_and_negative_gaps(spark):
    rows = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 2, 12.5), ("a", 3, 11.0), ("a", 4, None), ("a", 5, 20.0), (None, 1, 1.0), (None, 2, 2.0)],
        "case_id string, packet_no long, t double",
    ).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    for split in (None, 2):
        found = windows.event_durations(rows, ["case_id"], split=split).collect()
        assert [(r["packet_no"], r["duration"]) for r in found] == [(1, 2.5)]


def test_states_and_variants(spark, tmp_path):
    flows = {("FP", f"f{i:02d}"): (["SYN", "ACK", "ACK"] * 2 if i % 2 else ["ACK+PSH", "ACK", "ACK+FIN"] * 3) for i in range(20)}
    rows = windows.with_direction(packets(spark, flows))
    held = triage.window_rows(rows, 3, KEYS).persist()
    for kind in ("kmeans", "gmm", "agglomerative"):
        model = states.fit_states(held, 2, kind)
        labelled = states.assign_states(model, held, training=True)
        assert {r["state"] for r in labelled.select("state").distinct().collect()} == {"STATE_0", "STATE_1"}
        means = {r["state"]: r["m"] for r in labelled.groupBy("state").agg(F.avg("avg_payload").alias("m")).collect()}
        assert means["STATE_0"] < means["STATE_1"]
        if kind == "agglomerative":
            with pytest.raises(ValueError):
                model.transform(held)
        else:
            path = str(tmp_path / kind)
            model.save(spark, path)
            again = states.StateModel.load(spark, path).transform(held)
            keys = ["case_id", "window_no", "state"]
            assert again.select(*keys).exceptAll(labelled.select(*keys)).count() == 0
    with pytest.raises(Exception):
        states.StateModel.load(spark, str(tmp_path / "absent"))


@pytest.mark.parametrize("n_partitions", [1, 3, 8])
def test_mixture_finds_far_groups_however_rows_are_dealt(spark, n_partitions):
    """Three far groups stay apart for every dealing of the rows, and their sizes and spreads are those of the rows."""
    g, noise = F.col("id") % 3, F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0
    rows = spark.range(3000).select(
        "id", (g * 100_000 + noise).alias("avg_payload"), (g + 1).alias("n_servers"), (g * 3 + 2).alias("n_user_ports"),
        (2 - g).alias("n_ack"), F.lit(0).alias("n_syn"), (g * g).alias("n_fin"), F.when(g == 1, 5).otherwise(0).alias("n_psh"),
        g.alias("n_rst"),
    ).repartition(n_partitions)
    for seed in range(3):
        model = states.fit_states(rows, 3, "gmm", seed=seed)
        found = model.label(rows).select((F.col("id") % 3).alias("g"), "state").distinct().collect()
        assert sorted((r["g"], r["state"]) for r in found) == [(i, f"STATE_{i}") for i in range(3)]
        assert model.clusterer.weights.tolist() == pytest.approx([1 / 3] * 3)


def log_of(spark, traces):
    rows = [("L", case, i + 1, i + 1, a, i, 0) for case, seq in traces.items() for i, a in enumerate(seq)]
    return spark.createDataFrame(
        rows, "log string, case_id string, event_no long, packet_no long, activity string, s long, payload_size long"
    ).withColumn("ts", F.timestamp_seconds("s"))


def kept(spark, traces, threshold, split=None):
    events = log_of(spark, traces)
    return {r["case_id"] for r in eventlog.filter_variants(events, threshold, ["log", "case_id"], ["log"], split).collect()}


def test_variant_thresholds(spark):
    traces = {"c1": "ab", "c2": "ab", "c3": "ab", "c4": "ba", "c5": "ba", "c6": "a", "c7": "abab"}
    assert kept(spark, traces, 1.0005) == set(traces)
    assert kept(spark, traces, 2) == {"c1", "c2", "c3", "c4", "c5"}
    assert kept(spark, traces, 3) == {"c1", "c2", "c3", "c4", "c5", "c6"}
    assert kept(spark, traces, 0.4) == {"c1", "c2", "c3"}
    assert kept(spark, traces, 0.5) == {"c1", "c2", "c3", "c4", "c5"}
    assert kept(spark, traces, 0.0) == {"c1", "c2", "c3"}
    assert kept(spark, traces, 0.5, split=1) == kept(spark, traces, 0.5)
    sizes = [len(kept(spark, traces, t)) for t in (0.1, 0.5, 0.75, 0.9, 0.99)]
    assert sizes == sorted(sizes)


def test_ranks_of_long_levels_are_cut(spark):
    traces = {f"c{i:03d}": f"{'ab' * (i + 1)}" for i in range(60)}
    rows = eventlog.variants(eventlog.traces(log_of(spark, traces), ["log", "case_id"]), ["log"])
    plain, cut = eventlog.rank_variants(rows, ["log"]), eventlog.rank_variants(rows, ["log"], limit=7)
    columns = ["first_case", "variant_no", "traces_before"]
    assert plain.select(*columns).exceptAll(cut.select(*columns)).count() == 0


def test_mode_labels():
    assert triage.labels_for("training") == ["FP"] and triage.labels_for("inference") == ["FP", "TP"]
    with pytest.raises(ValueError):
        triage.labels_for("other")
