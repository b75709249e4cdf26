"""Keyed clustering of grid cells, and the rating grid on top of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmloom.operators import cells, split
from alarmloom.plans import triage
from alarmloom.registry import fixtures as fx

SF = "/root/testdata/sf0.001"
FEATURES = ["u", "v", "w"]


def random_windows(spark, seed=1, n=600):
    rng = np.random.default_rng(seed)
    rows = []
    for cell in range(3):
        centres = np.array([(60 * k, 25 * (k * k % 3)) for k in range(cell + 2)]) + rng.normal(0, 3, (cell + 2, 2))
        for i in range(n):
            u, v = centres[i % len(centres)] + rng.normal(0, 1 + cell, 2)
            rows.append((cell, cell + 2, i, float(u), float(v), 7.0, i % len(centres)))
    rows += [rows[5]] * 300
    return spark.createDataFrame(rows, "cell int, clusters int, i int, u double, v double, w double, planted int")


@pytest.mark.parametrize("normalization", ["zscore", "min-max"])
def test_every_cell_finds_its_groups_whatever_the_partitions(spark, normalization):
    rows = random_windows(spark)
    found = []
    for parts in (1, 7):
        model = cells.fit_cells(rows.repartition(parts), ["cell", "clusters"], features=FEATURES, normalization=normalization)
        assert model.failures.count() == 0
        labelled = model.transform(rows).select("cell", "i", "planted", "state", "u")
        found.append(sorted(map(tuple, labelled.collect())))
    assert found[0] == found[1] and len(found[0]) == 2100
    groups = {}
    for cell, _, planted, state, u in found[0]:
        groups.setdefault((cell, planted), set()).add(state)
    assert all(len(states) == 1 for states in groups.values())
    assert len({(c, *s) for (c, _), s in groups.items()}) == 9
    # States are numbered by ascending centres.
    for cell in range(3):
        means = [np.mean([r[4] for r in found[0] if r[0] == cell and r[3] == f"STATE_{s}"]) for s in range(cell + 2)]
        assert means == sorted(means)


def test_centres_are_means_of_their_windows(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(0, 5, *map(float, p)) for p in rng.normal(0, 1, (500, 3))], "cell int, clusters int, u double, v double, w double")
    model = cells.fit_cells(rows, ["cell", "clusters"], features=FEATURES, tolerance=0.0)
    held = model.fitted.first()
    labelled = model.transform(rows).toPandas()
    for number, centre in enumerate(held["_centres"]):
        mine = labelled[labelled["state"] == f"STATE_{number}"][FEATURES].to_numpy()
        assert np.allclose((mine.mean(axis=0) - held["_shift"]) / held["_width"], centre, atol=1e-8)


def test_cells_that_cannot_be_fitted_leave_the_others_alone(spark):
    rows = random_windows(spark, n=60)
    few = rows.where("cell = 0 and i < 3").withColumns({"cell": F.lit(8), "clusters": F.lit(4)})
    lost = rows.where("cell = 0").withColumns({"cell": F.lit(9), "u": F.when(F.col("i") == 3, None).otherwise(F.col("u"))})
    nan = rows.where("cell = 0").withColumns({"cell": F.lit(10), "u": F.when(F.col("i") == 3, float("nan")).otherwise(F.col("u"))})
    asked = spark.createDataFrame([(0, 2), (77, 2)], "cell int, clusters int")
    mixed = rows.unionByName(few).unionByName(lost).unionByName(nan)
    model = cells.fit_cells(mixed, ["cell", "clusters"], features=FEATURES, wanted=asked)
    assert {(r["cell"], r["reason"]) for r in model.failures.collect()} == {
        (8, "4 states of fewer distinct windows"),
        (9, "a window feature is missing"),
        (10, "a window feature is missing"),
        (77, "no windows to fit"),
    }
    alone = cells.fit_cells(rows, ["cell", "clusters"], features=FEATURES)
    assert sorted(map(tuple, model.fitted.collect())) == sorted(map(tuple, alone.fitted.collect()))
    assert {r["cell"] for r in model.transform(mixed).select("cell").distinct().collect()} == {0, 1, 2}
    nothing = cells.fit_cells(rows.limit(0), ["cell", "clusters"], features=FEATURES, wanted=asked)
    assert nothing.failures.count() == 2 and nothing.transform(rows).count() == 0


def test_grid_cells_do_not_depend_on_each_other(spark):
    source = fx.packets(spark, SF)
    false_alarms, true_alarms = fx.grid_alarms(source.rows)
    parts = split.repeated_alarm_split(false_alarms, true_alarms, ["every_alarm", "silent"], repetitions=2).persist()
    packets = source.rows.drop("phase").persist()
    whole = triage.run_grid(packets, parts, [3, 5], [2])
    errors = {tuple(r) for r in whole.errors.collect()}
    assert errors == {(r, "silent", size, 2, "no windows to fit") for r in (1, 2) for size in (3, 5)}
    alone = triage.run_grid(packets, parts.where("repetition = 2 and detector = 'every_alarm'"), [5], [2])
    mine = whole.table.where("repetition = 2 and window_size = 5")
    assert alone.errors.count() == 0 and alone.table.count() == 5
    assert sorted(map(str, mine.collect())) == sorted(map(str, alone.table.collect()))


def test_distances_written_out_are_those_over_arrays(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 50, 3).tolist(), rng.normal(0, 50, (i % 3 + 1, 3)).tolist()) for i in range(60)]
    frame = cells.held_rows(spark, rows, "i int, x array<double>, c array<array<double>>")
    assert "LocalTableScan" in frame._jdf.queryExecution().toString()
    found = []
    for limit in (256, 0):
        monkeypatch.setattr(cells, "UNROLLED", limit)
        held = frame.select("i", "x", "c", cells._distances(F.col("x"), F.col("c"), 3, 3).alias("d"))
        found.append(held.select("i", F.filter("d", lambda v: v.isNotNull()).alias("d"), F.array_min("d").alias("m")).orderBy("i").collect())
    assert found[0] == found[1]
    assert [len(r["d"]) for r in found[0]] == [len(c) for _, _, c in rows]
    assert cells.held_rows(spark, [], "i int, c array<double>").collect() == []


def test_windows_are_dealt_by_number_before_cells_multiply_them(spark):
    source = fx.packets(spark, SF)
    parts = split.repeated_alarm_split(*fx.grid_alarms(source.rows), fx.ALARM_DETECTORS)
    rows = triage.grid_windows(source.rows.drop("phase"), parts, [3], [2, 3])
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
