"""Models with too many markings are aligned by intervals, as cheaply as by a plain search."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_discovery import cheapest

from alarmloom.operators import conformance, trees
from alarmloom.operators.trees import LOG_MOVE, Intervals, Markings, TooManyMarkings, Tree, Walks, advance, alphabet
from alarmloom.plans import triage


def leaf(activity):
    return Tree("activity", activity)


def random_tree(picked, labels):
    if len(labels) == 1:
        one = leaf(labels[0])
        return one if picked.random() < 0.7 else Tree("xor", None, [Tree("tau"), one])
    operator = picked.choice(["sequence", "xor", "parallel", "loop"])
    cut = picked.randint(1, len(labels) - 1)
    children = [random_tree(picked, labels[:cut]), random_tree(picked, labels[cut:])]
    if operator == "loop" and picked.random() < 0.3:
        children[1] = Tree("tau") if picked.random() < 0.5 else children[1]
    return Tree(operator, None, children)


@pytest.mark.parametrize("seed", range(40))
def test_intervals_match_a_plain_search(seed):
    picked = random.Random(seed)
    tree = random_tree(picked, list("abcdef"[: picked.randint(2, 6)]))
    part, held = Intervals(tree), Markings(tree)
    labels = alphabet(tree)
    assert part.labels == held.labels and part.shortest == held.shortest == cheapest(tree, [])
    for _ in range(6):
        trace = picked.choices(labels, k=picked.randint(0, 10))
        coded = np.array([part.labels.index(a) for a in trace], dtype=np.int64)
        cost, strayed, synced = part.align(coded)
        assert cost == cheapest(tree, trace)
        assert strayed == cost // LOG_MOVE
        assert all(n <= trace.count(a) for a, n in zip(part.labels, synced))
        start = held.cost[0][None, :]
        assert advance(held, start, [coded], track=True)[0][0, held.final] == cost


def by_markings(held, coded):
    """Cost, deviations and synchronous moves of one sequence by markings."""
    cost, _, origin, synced, strayed = advance(held, held.cost[0][None, :], [coded], track=True)
    at = held.final
    return int(cost[0, at]), int(strayed[0, at] + held.visible[0, origin[0, at]]), synced[0, at].tolist()


@pytest.mark.parametrize("seed", range(400))
def test_intervals_and_markings_count_the_same_synchronous_moves(seed):
    picked = random.Random(1000 + seed)
    tree = random_tree(picked, list("abcdef"[: picked.randint(2, 6)]))
    part, held, walks = Intervals(tree), Markings(tree), Walks(tree)
    assert walks.shortest == held.shortest and walks.labels == held.labels
    for _ in range(5):
        coded = np.array([picked.randrange(len(part.labels)) for _ in range(picked.randint(0, 12))], dtype=np.int64)
        cost, strayed, synced = part.align(coded)
        assert (cost, strayed, synced.tolist()) == by_markings(held, coded)
        cost, strayed, synced = walks.align(coded)
        assert (cost, strayed, synced.tolist()) == by_markings(held, coded)


def test_a_long_trace_on_a_wide_loop():
    """4,000 events on a loop over twelve lanes side by side, with known deviations."""
    lanes = [f"p{i:02d}" for i in range(12)]
    tree = Tree("loop", None, [Tree("sequence", None, [leaf("a"), Tree("parallel", None, [leaf(p) for p in lanes]), leaf("z")]), Tree("tau")])
    with pytest.raises(TooManyMarkings):
        Markings(tree)
    part, picked = Walks(tree), random.Random(5)
    events, strayed = [], 0
    for k in range(286):
        turn = ["a", *picked.sample(lanes, 12), "z"]
        if k % 10 == 3:  # a lane is left out, and another one is there twice
            turn.remove("p03")
            turn.insert(5, "p07")
            strayed += 2
        events += turn
    coded = np.array([part.labels.index(a) for a in events], dtype=np.int64)
    start = time.perf_counter()
    cost, found, synced = part.align(coded)
    assert len(events) > 4000 and time.perf_counter() - start < 60
    assert found == strayed == cost // LOG_MOVE
    assert synced.sum() == len(events) - strayed // 2


def test_one_of_two_equal_ways_is_taken_by_both():
    body = Tree("parallel", None, [leaf("d"), leaf("b"), Tree("loop", None, [Tree("loop", None, [leaf("c"), leaf("e")]), leaf("a")])])
    part, held = Intervals(body), Markings(body)
    coded = np.array([part.labels.index(a) for a in "cbcda"], dtype=np.int64)
    cost, strayed, synced = part.align(coded)
    assert (cost, strayed, synced.tolist()) == by_markings(held, coded)


def nodes(spark, width):
    rows = [("0", None, 0, "sequence", None), ("0.0", "0", 0, "activity", "s"), ("0.1", "0", 1, "parallel", None)]
    rows += [(f"0.1.{i}", "0.1", i, "activity", f"p{i:02d}") for i in range(width)]
    schema = "state string, node string, parent string, position int, operator string, activity string"
    return spark.createDataFrame([("wide", *r) for r in rows], schema)


def logged(spark, traces):
    rows = [(label, "wide", case, i, a) for (label, case), seq in traces.items() for i, a in enumerate(seq, 1)]
    return spark.createDataFrame(rows, "label string, state string, case_id string, event_no long, activity string").withColumns(
        {"ts": F.timestamp_seconds("event_no"), "payload_size": F.lit(0).cast("bigint"), "packet_no": F.col("event_no")}
    )


def test_alarms_of_an_eleven_wide_model_are_rated(spark, monkeypatch):
    lanes = [f"p{i:02d}" for i in range(11)]
    events = logged(
        spark,
        {
            ("FP", "c1"): ["s", *lanes],
            ("FP", "c2"): ["s", *reversed(lanes)],
            ("TP", "c3"): ["s", *lanes[:4], "x", "s"],
        },
    )
    tree, trace = nodes(spark, 11), ["label", "state", "case_id"]
    for split, walked in ((None, 20_000), (5, 20_000), (None, 100)):
        monkeypatch.setattr(trees, "MAX_WALKED", walked)
        found = conformance.Alignments(events, tree, ["state"], trace, split)
        assert {r["case_id"]: r["deviations"] for r in found.trace_fitness().collect()} == {"c1": 0, "c2": 0, "c3": 9}
        synced = found.sync_counts().groupBy("case_id").agg(F.sum("n").alias("n"))
        assert {r["case_id"]: r["n"] for r in synced.collect()} == {"c1": 12, "c2": 12, "c3": 5}
    profile = spark.createDataFrame([("wide", a, 1.0) for a in ["s", *lanes]], "state string, activity string, value double")
    rated = triage.rate(events, triage.Trained(tree, {"control_flow": profile}, {}), trace)
    assert rated.banded.count() == 3
    assert rated.table.agg(F.sum("tp_count"), F.sum("fp_count")).first()[:] == (1, 2)


def test_equal_parts_and_sequences_are_aligned_once(spark):
    """Logs with equal parts share one, whose rows go side by side; a row without a log goes nowhere."""
    nodes = [("0", None, 0, "loop", None), ("0.0", "0", 0, "activity", "a"), ("0.1", "0", 1, "activity", "b")]
    rows = [(log, *node) for log in (1, 2, 3) for node in nodes[: 3 if log < 3 else 0]]
    rows.append((3, "0", None, 0, "activity", "a"))
    tree = spark.createDataFrame(rows, "log int, node string, parent string, position int, operator string, activity string")
    models = conformance.Models(tree, ["log"])
    assert models.parts[1, 0] is models.parts[2, 0] and models.parts[3, 0] is not models.parts[1, 0]
    traces = [(1, list("aba")), (2, list("aba")), (2, list("ab")), (None, list("a")), (3, list("a")), (1, list("ab"))]
    batch = pd.DataFrame({"log": [t[0] for t in traces], conformance.PART: 0, "activities": [t[1] for t in traces]})
    found = list(conformance._batches(batch, ["log", conformance.PART], models.parts))
    assert sorted(len(coded) for _, _, coded in found) == [1, 4]
    part, held, coded = max(found, key=lambda x: len(x[2]))
    once, place = conformance._distinct(coded)
    assert len(once) == 2 and [once[k].tolist() for k in place] == [c.tolist() for c in coded]
    given = spark.createDataFrame([t for t in traces if t[0]], "log int, activities array<string>")
    given = given.withColumn(conformance.PART, F.lit(0)).withColumn("i", F.monotonically_increasing_id())
    keys = ["i", "log", conformance.PART]
    aligned = conformance._align_whole(given, keys, ["log", conformance.PART], models.parts).join(given, keys).collect()
    for row in aligned:
        own = models.parts[row["log"], 0]
        number = np.array([own.labels.index(a) for a in row["activities"]], dtype=np.int64)
        assert (row["cost"], row["deviations"], row["synced"]) == (lambda c, d, s: (c - own.shortest, d - own.shortest // LOG_MOVE, s))(*by_markings(own, number))
    assert len(aligned) == 5
