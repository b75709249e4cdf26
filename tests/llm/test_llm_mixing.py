"""Source targets and training positions against plain loops."""

import hashlib

import numpy as np
import pytest
from llm_tables import as_rows, awkward, empty, words
from pyspark.sql import functions as F

from alarmloom.llm import curriculum


def targets(sizes):
    """Resharing the excess until no target is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    most = {s: 2.0 * sizes[s] for s in names}
    budget, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = budget - sum(most[s] for s in stopped)
        out = {s: most[s] if s in stopped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if out[s] > most[s] * (1 + 1e-12)}
        if not above:
            return out
        stopped |= above


def brute(rows):
    sized = [(d, s, len(words(t))) for d, t, s in rows]
    sizes = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    wanted, out = targets(sizes), []
    for source in sizes:
        groups = {}
        for d, s, n in sized:
            if s == source:
                groups[d, n] = groups.get((d, n), 0) + 1
        name = lambda k: hashlib.md5(f"{'' if k[0] is None else k[0]}:0".encode()).hexdigest()
        start = 0
        for d, n in sorted(groups, key=lambda k: (name(k), k[0] is not None, k)):
            for _ in range(groups[d, n]):
                laps = [lap for lap in (0, 1) if n and start + lap * sizes[source] + n / 2 <= wanted[source]]
                out.append((d, n, sizes[source], round(wanted[source], 6), n * len(laps)))
                start += n
    return sorted(out, key=repr)


def documents(spark, clashing=False):
    docs = awkward(spark, extra=["w " * k for k in (3, 50, 7, 900)], clashing=clashing)
    return docs.withColumn("source", F.when(F.col("doc_id") % 5 == 0, "b").when(F.col("doc_id") % 3 == 0, "ä").when(F.col("doc_id") > 12, "Z").otherwise(F.col("source")))


COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs):
    found = curriculum.by_position(curriculum.mix(docs)).withColumn("target", F.round("target", 6))
    return as_rows(found, *COLUMNS)


@pytest.mark.parametrize("piece,broadcast", [(100_000, 100_000), (3, 100_000), (2, 1)])
def test_mix_equals_loops(spark, monkeypatch, piece, broadcast):
    monkeypatch.setattr(curriculum, "PIECE_ROWS", piece)
    monkeypatch.setattr(curriculum, "BROADCAST_ROWS", broadcast)
    docs = documents(spark)
    expected = brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    assert mixed_rows(docs) == expected
    assert mixed_rows(documents(spark, clashing=True).repartition(5)) == expected


def test_heavy_sources_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(curriculum, "GROUP_ROWS", 6)
    docs = documents(spark)
    assert mixed_rows(docs) == brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])


def test_many_equal_rows_go_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "CHUNK_ROWS", 7)
    rows = [(None, "a b c", "en", "s", 5)] * 100 + [(4, "a b", "en", None, 3)] * 20 + [(5, "", "en", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found = curriculum.by_position(curriculum.mix(docs)).collect()
    assert len(found) == 121
    for size in (2, 3):
        mine = [r for r in found if r["size"] == size]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= size
    assert [r["taken"] for r in found if r["doc_id"] == 5] == [0]


def test_empty_tables_and_texts(spark):
    assert curriculum.mix(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], list(r["positions"])) for r in curriculum.mix(blank).collect()] == [(0, 0.0, [])] * 2


def test_demand_and_due_are_inverse(spark):
    shares = spark.createDataFrame([(x / 200,) for x in range(201)], "u double")
    for knots in ((1.5, 0.5), (1, 1), (0, 2), (3, 0), (0, 5, 1, 0, 2)):
        found = shares.select("u", curriculum.due(F.col("u"), knots).alias("t")).select("u", "t", curriculum.demand(F.col("t"), knots).alias("v")).collect()
        times = [r["t"] for r in found]
        assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1 + 1e-12
        assert max(abs(r["u"] - r["v"]) for r in found) < 1e-9


def test_sources_follow_their_schedules(spark):
    rows = [(i, "w " * (20 + i % 30), "abc"[i % 3]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = curriculum.mix(docs).cache()
    order = curriculum.sequence(mixed).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    facts = {r["source"]: r["target"] for r in mixed.select("source", "target").distinct().collect()}
    total = sum(facts.values())
    # Words of each source before a time, against the integral of its schedule.
    for source, knots in zip("abc", curriculum.SCHEDULES):
        for time in (0.25, 0.5, 0.75):
            share = lambda k, t: (k[0] * t + (k[1] - k[0]) * t * t / 2) / ((k[0] + k[1]) / 2)
            place = sum(facts[s] * share(k, time) for s, k in zip("abc", curriculum.SCHEDULES))
            got = sum(r["size"] for r in order if r["source"] == source and r["position"] <= place)
            assert abs(got - facts[source] * share(knots, time)) <= 60
    assert abs(sum(r["size"] for r in order) - total) <= 150
    assert np.all(np.diff([r["position"] for r in order]) >= 0)
