"""Known trees are found, training logs fit, and alignments match a plain search."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from alarmloom.operators import conformance, discovery, eventlog
from alarmloom.operators.trees import LOG_MOVE, SILENT_MOVE, Net, Tree, read_trees

TRACE = ["state", "case_id"]


def log_of(spark, logs):
    rows = [
        (state, f"c{n:03d}", i + 1, i + 1, a, i, 0)
        for state, traces in logs.items()
        for n, seq in enumerate(traces)
        for i, a in enumerate(seq)
    ]
    return spark.createDataFrame(
        rows, "state string, case_id string, event_no long, packet_no long, activity string, s long, payload_size long"
    ).withColumn("ts", F.timestamp_seconds("s"))


def tree_of(events, noise=0.0, split=None):
    rows = eventlog.variants(eventlog.traces(events, TRACE), ["state"])
    steps = eventlog.variant_steps(events, rows, ["state"]).select(
        "state", F.col("case_id").alias("sid"), F.col("event_no").alias("pos"), "activity", F.col("n_traces").alias("weight")
    )
    return discovery.discover_trees(steps, ["state"], noise, split)


def text(tree: Tree) -> str:
    if tree.activity:
        return tree.activity
    sign = {"sequence": "->", "xor": "X", "parallel": "+", "loop": "*", "tau": "tau"}[tree.operator]
    return sign if tree.operator == "tau" else f"{sign}({', '.join(text(c) for c in tree.children)})"


def texts(tree_rows):
    return {k[0]: text(t) for k, t in read_trees([r.asDict() for r in tree_rows.collect()], ["state"]).items()}


KNOWN = {
    "sequence": (["abc", "abc"], "->(a, b, c)"),
    "choice": (["ab", "ac", "ac"], "->(a, X(b, c))"),
    "concurrent": (["abcd", "acbd"], "->(a, +(b, c), d)"),
    "loop": (["abab" + "c", "abc", "ababab" + "c"], None),
    "redo": (["a", "aba", "ababa"], "*(a, b)"),
    "optional": (["abc", "ac"], "->(a, X(tau, b), c)"),
    "repeat": (["a", "aaa"], "*(a, tau)"),
    "single": (["a"], "a"),
    "flower": (["ab", "ba", "aab", "bba", "b", "a"], None),
    "two_redos": (["a", "aba", "aca", "abaca"], "*(a, b, c)"),
    "optional_tail": (["a", "ab", "abb"], "->(a, X(tau, *(b, tau)))"),
}


@pytest.mark.parametrize("split", [None, 2])
def test_known_trees(spark, split):
    found = texts(tree_of(log_of(spark, {name: traces for name, (traces, _) in KNOWN.items()}), split=split))
    for name, (_, expected) in KNOWN.items():
        assert expected is None or found[name] == expected, name


def test_noise_drops_rare_pairs(spark):
    traces = ["abc"] * 50 + ["acb"]
    assert texts(tree_of(log_of(spark, {"S": traces})))["S"] == "->(a, +(b, c))"
    assert texts(tree_of(log_of(spark, {"S": traces}), noise=0.2))["S"] == "->(a, b, c)"


def random_logs(seed, n_logs=4):
    picked = random.Random(seed)
    return {
        f"S{i}": ["".join(picked.choices("abcde"[: picked.randint(2, 5)], k=picked.randint(1, 9))) for _ in range(15)]
        for i in range(n_logs)
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_training_logs_fit(spark, seed):
    events = log_of(spark, random_logs(seed))
    tree = tree_of(events)
    aligned = conformance.Alignments(events, tree, ["state"], TRACE)
    assert aligned.trace_fitness().where("fitness <> 1.0 or deviations <> 0").count() == 0
    counts = events.groupBy(*TRACE, "activity").agg(F.count("*").alias("n"))
    synced = aligned.sync_counts()
    assert synced.exceptAll(counts).count() == 0 and counts.exceptAll(synced).count() == 0


def cheapest(tree: Tree, trace) -> int:
    """Cost of an optimal alignment by a plain shortest-path search on the whole net."""
    net = Net(tree)
    start = (frozenset([net.source]), 0)
    best, queue, order = {start: 0}, [(0, 0, start)], itertools.count(1)
    while queue:
        cost, _, (marking, at) = heapq.heappop(queue)
        if cost > best[marking, at]:
            continue
        if marking == frozenset([net.sink]) and at == len(trace):
            return cost
        steps = [((marking, at + 1), LOG_MOVE)] if at < len(trace) else []
        for label, sources, targets in net.transitions:
            if marking.issuperset(sources):
                after = marking.difference(sources).union(targets)
                steps.append(((after, at), SILENT_MOVE if label is None else LOG_MOVE))
                if at < len(trace) and trace[at] == label:
                    steps.append(((after, at + 1), 0))
        for state, price in steps:
            if cost + price < best.get(state, 1 << 60):
                best[state] = cost + price
                heapq.heappush(queue, (cost + price, next(order), state))
    raise AssertionError("no alignment")


@pytest.mark.parametrize("seed", [3, 4])
def test_alignments_match_a_plain_search(spark, seed):
    tree = tree_of(log_of(spark, random_logs(seed, 5)))
    trees = read_trees([r.asDict() for r in tree.collect()], ["state"])
    events = log_of(spark, {state: ["".join(t) + "x" * (i % 3 == 0) for i, t in enumerate(traces)] for state, traces in random_logs(seed + 100, 5).items()})
    aligned = conformance.Alignments(events, tree, ["state"], TRACE)
    sequences = {
        (r["state"], r["case_id"]): r["seq"]
        for r in events.groupBy(*TRACE).agg(F.array_sort(F.collect_list(F.struct("event_no", "activity")))["activity"].alias("seq")).collect()
    }
    rows = aligned.variants.select("state", "case_id", "cost", "deviations", "worst", "moves").collect()
    assert rows
    for row in rows:
        root, trace = trees[row["state"],], sequences[row["state"], row["case_id"]]
        # A net whose root is concurrent has one silent split and one silent join more.
        cost = cheapest(root, trace)
        assert cost // LOG_MOVE == row["deviations"], (text(root), trace)
        assert row["cost"] // LOG_MOVE == cost // LOG_MOVE
        assert row["worst"] == len(trace) + cheapest(root, []) // LOG_MOVE
        synced = sum(m["n"] for m in row["moves"] or [])
        assert synced <= len(trace) and all(m["n"] <= trace.count(m["activity"]) for m in row["moves"] or [])
        visible = row["deviations"] - (len(trace) - synced)
        assert visible >= 0


def test_pieces_give_the_same_alignments(spark):
    tree = tree_of(log_of(spark, random_logs(5)))
    events = log_of(spark, random_logs(6))
    whole = conformance.Alignments(events, tree, ["state"], TRACE)
    for split in (1, 3):
        cut = conformance.Alignments(events, tree, ["state"], TRACE, split)
        for one, other in ((whole.sync_counts(), cut.sync_counts()), (whole.trace_fitness(), cut.trace_fitness())):
            assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0
        replayed = conformance.token_replay(events, tree, ["state"], TRACE)
        again = conformance.token_replay(events, tree, ["state"], TRACE, split)
        assert replayed.exceptAll(again).count() == 0


def test_known_alignment_and_replay(spark):
    tree = tree_of(log_of(spark, {"S": ["abcd", "acbd"]}))
    events = log_of(spark, {"S": ["abcd", "abd", "abcxd", "ab"], "T": ["abcd"]})
    aligned = conformance.Alignments(events, tree, ["state"], TRACE)
    found = {r["case_id"]: (r["deviations"], r["fitness"]) for r in aligned.trace_fitness().collect()}
    assert found == {
        "c000": (0, 1.0),
        "c001": (1, pytest.approx(1 - 1 / 7)),
        "c002": (1, pytest.approx(1 - 1 / 9)),
        "c003": (2, pytest.approx(1 - 2 / 6)),
    }
    assert aligned.log_fitness().first()["fitness"] == pytest.approx(1 - 4 / 30)
    replayed = {r["case_id"]: r for r in conformance.token_replay(events, tree, ["state"], TRACE).collect()}
    assert replayed["c000"]["fitness"] == 1.0 and replayed["c000"]["missing"] == 0
    assert replayed["c001"]["missing"] == 1 and replayed["c001"]["remaining"] == 2
    assert 0 < replayed["c003"]["fitness"] < 1
    assert conformance.log_replay_fitness(
        conformance.token_replay(events.where("case_id = 'c000'"), tree, ["state"], TRACE), ["state"]
    ).first()["fitness"] == 1.0


def test_deviations_are_exact_on_long_traces(spark):
    tree = tree_of(log_of(spark, {"S": ["ab", "abab"]}))
    events = log_of(spark, {"S": ["ab" * 6000 + "b"]})
    row = conformance.Alignments(events, tree, ["state"], TRACE).trace_fitness().first()
    assert row["deviations"] == 1
    cut = conformance.Alignments(events, tree, ["state"], TRACE, 1000).trace_fitness().first()
    assert cut == row


def test_fitness_of_traces(spark):
    rows = spark.createDataFrame([("t", 0.5), ("t", 1.0), ("u", None)], "case_id string, fitness double")
    assert conformance.mean_trace_fitness(rows, ["case_id"]).where("case_id = 't'").first()["fitness"] == 0.75
    low = {r["case_id"]: r["fitness"] for r in conformance.min_trace_fitness(rows, ["case_id"]).collect()}
    assert low == {"t": 0.5, "u": 0.0}


def test_net_tables(spark):
    nodes, arcs = discovery.net_tables(tree_of(log_of(spark, {"S": ["abcd", "acbd"]})), ["state"])
    assert nodes.where("activity is not null").count() == 4
    assert nodes.where("marking = 'initial'").count() == nodes.where("marking = 'final'").count() == 1
    names = {r["node"] for r in nodes.collect()}
    assert all(r["source"] in names and r["target"] in names for r in arcs.collect())


@pytest.mark.parametrize("limits", [(2_000, 20_000), (20, 20_000), (20, 20)])
def test_alignments_do_not_depend_on_how_a_model_is_held(spark, monkeypatch, limits):
    from alarmloom.operators import trees

    monkeypatch.setattr(trees, "MAX_MARKINGS", limits[0])
    monkeypatch.setattr(trees, "MAX_WALKED", limits[1])
    rows = [("small", "0", None, 0, "sequence", None), ("small", "0.0", "0", 0, "activity", "a"), ("small", "0.1", "0", 1, "activity", "b")]
    rows += [("wide", "0", None, 0, "sequence", None), ("wide", "0.0", "0", 0, "activity", "s"), ("wide", "0.1", "0", 1, "parallel", None)]
    rows += [("wide", f"0.1.{i}", "0.1", i, "activity", f"p{i}") for i in range(6)]
    tree = spark.createDataFrame(rows, "log string, node string, parent string, position int, operator string, activity string")
    logged = [("small", "c1", i, a) for i, a in enumerate("ab", 1)] + [("wide", "c2", 1, "s"), ("wide", "c2", 2, "p1")]
    logged += [("wide", "c3", i, a) for i, a in enumerate(["p2", "s", "p1", "p1", "p5", "p4", "s", "p0"], 1)]
    events = spark.createDataFrame(logged, "log string, case_id string, event_no long, activity string").withColumns(
        {"ts": F.timestamp_seconds("event_no"), "payload_size": F.lit(0).cast("bigint"), "packet_no": F.col("event_no")}
    )
    found = conformance.Alignments(events, tree, ["log"], ["log", "case_id"])
    strayed = {(r["log"], r["case_id"]): r["deviations"] for r in found.trace_fitness().collect()}
    assert strayed == {("small", "c1"): 0, ("wide", "c2"): 5, ("wide", "c3"): 5}
    synced = {(r["case_id"], r["activity"]) for r in found.sync_counts().collect()}
    assert synced == {("c1", "a"), ("c1", "b"), ("c2", "s"), ("c2", "p1"), *(("c3", x) for x in ("s", "p0", "p1", "p4", "p5"))}
