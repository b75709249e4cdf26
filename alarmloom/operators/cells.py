"""k-means states of many grid cells at once.

The cell (repetition, detector, window size, number of states, ...) is a key: statistics,
seeding and every round of the fit are one job for all cells. Windows with the same
features travel as one point with a weight. A cell that cannot be fitted gives a row with
the reason, and all others go on. The driver holds the centres: one row per cell of the
grid, however many windows there are.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from alarmloom.operators.sizing import cut_lineage, held_rows, held_side, small_side
from alarmloom.operators.states import state_name
from alarmloom.schema import WINDOW_FEATURES

# Rounds at most, and the move of a scaled centre below which it stands still.
MAX_ROUNDS, TOLERANCE = 100, 1e-4
# Seedings per cell; the one with the least sum of squared distances is kept.
TRIES = 5
# Differences that are written out one by one, as Spark compiles these and no functions over arrays.
UNROLLED = 256


def _distances(x: Column, centres: Column, n_centres: int, n_features: int) -> Column:
    """Squared distance of a point to every centre; null beyond its own number of up to n_centres."""
    if n_centres * n_features <= UNROLLED:
        # From 0 on and feature by feature, like the aggregate below, so that the sums are the very same.
        found = []
        for k in range(max(1, n_centres)):
            total = F.lit(0.0)
            for i in range(n_features):
                gap = F.get(F.get(centres, F.lit(k)), F.lit(i)) - F.get(x, F.lit(i))
                total = total + gap * gap
            found.append(total)
        return F.array(*found)
    squares = lambda c: F.zip_with(c, x, lambda a, b: (a - b) * (a - b))
    return F.transform(centres, lambda c: F.aggregate(squares(c), F.lit(0.0), lambda s, v: s + v))


def _scaled(x: Column, n_features: int) -> Column:
    shift, width = F.col("_shift"), F.col("_width")
    return F.array(*[(F.get(x, F.lit(i)) - F.get(shift, F.lit(i))) / F.get(width, F.lit(i)) for i in range(n_features)])


@dataclass
class CellStates:
    """Scalers and centres of the fitted cells, in order of their state numbers, and the cells that failed."""

    cell: list[str]
    features: list[str]
    fitted: DataFrame
    failures: DataFrame
    most: int

    def transform(self, windows: DataFrame) -> DataFrame:
        """Windows of the fitted cells with their `state`; windows of other cells are left out."""
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        n = len(self.features)
        joined = windows.join(small_side(self.fitted), self.cell).withColumn("_x", _scaled(x, n))
        joined = joined.withColumn("_d", _distances(F.col("_x"), F.col("_centres"), self.most, n))
        number = F.array_position("_d", F.array_min("_d")) - 1
        return joined.withColumn("state", state_name(number)).drop("_shift", "_width", "_centres", "_x", "_d")


def _statistics(windows: DataFrame, cell: list[str], features: list[str], normalization: str) -> DataFrame:
    """Shift and width of every feature per cell; a constant one is only shifted."""
    if normalization not in ("zscore", "min-max"):
        raise ValueError(f"unknown normalization method: {normalization}")
    values = [F.col(c).cast("double") for c in features]
    if normalization == "zscore":
        shift, width = [F.avg(v) for v in values], [F.stddev_pop(v) for v in values]
    else:
        shift, width = [F.min(v) for v in values], [F.max(v) - F.min(v) for v in values]
    lost = F.count_if(F.exists(F.array(*values), lambda v: v.isNull() | F.isnan(v)))
    widths = F.transform(F.array(*width), lambda w: F.when(w == 0, 1.0).otherwise(w))
    return windows.groupBy(*cell).agg(F.array(*shift).alias("_shift"), widths.alias("_width"), lost.alias("_lost"))


class _Fit:
    """Centres of the open cells and tries, moved by weighted sums; keys are cells with the number of the try."""

    def __init__(self, points: DataFrame, cell: list[str], clusters: str, seed: int, tries: int, n_features: int):
        self.points, self.seed, self.tries, self.n_features = points, seed, tries, n_features
        self.on, self.cell = cell, [*cell, "_try"]
        self.types = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in cell)
        self.wanted = cell.index(clusters)
        self.centres: dict[tuple, np.ndarray] = {}
        self.failed: dict[tuple, str] = {}

    def _near(self, keys: list[tuple]) -> DataFrame:
        """Points of some cells with their distances to the centres."""
        rows = [(*key, self.centres[key].tolist()) for key in keys]
        frame = held_rows(self.points.sparkSession, rows, f"{self.types}, _try int, _centres array<array<double>>")
        most = max((len(self.centres[key]) for key in keys), default=0)
        apart = _distances(F.col("x"), F.col("_centres"), most, self.n_features)
        return self.points.join(held_side(frame, len(rows)), self.on).withColumn("_d", apart)

    def seeded(self) -> None:
        """k-means++: every next centre is drawn by weight times squared distance, with hashes as dice."""
        numbered = self.points.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(self.tries - 1))))
        step, drawn = 0, self._drawn(numbered, F.col("w").cast("double"), 0)
        self.centres = {key: x[None, :] for key, x in drawn.items()}
        open_ = [key for key in self.centres if key[self.wanted] > 1]
        while open_:
            step += 1
            near = self._near(open_)
            drawn = self._drawn(near, F.col("w") * F.array_min("_d"), step)
            for key in open_:
                if key in drawn:
                    self.centres[key] = np.vstack([self.centres[key], drawn[key]])
                else:
                    self.failed[key[:-1]] = f"{key[self.wanted]} states of fewer distinct windows"
                    del self.centres[key]
            open_ = [key for key in open_ if key in self.centres and len(self.centres[key]) < key[self.wanted]]

    def _drawn(self, points: DataFrame, weight: Column, step: int) -> dict[tuple, np.ndarray]:
        """One point per cell; the one whose exponential waiting time at rate weight is least.

        Dice are thrown for the unscaled windows, whose values do not depend on the order of summing.
        """
        dice = (F.shiftrightunsigned(F.xxhash64(*self.cell, "h", F.lit(self.seed), F.lit(step)), 11) + 1) / F.lit(float((1 << 53) + 1))
        found = (
            points.withColumn("_wait", -F.log(dice) / weight)
            .where(weight > 0)
            .groupBy(*self.cell)
            .agg(F.min_by("x", F.struct("_wait", "h")).alias("x"))
        )
        return {tuple(r[c] for c in self.cell): np.array(r["x"]) for r in found.collect()}

    def moved(self, max_rounds: int, tolerance: float) -> None:
        """Lloyd rounds; a cell whose centres stand still leaves."""
        open_ = list(self.centres)
        for _ in range(max_rounds):
            if not open_:
                return
            n = len(next(iter(self.centres.values()))[0])
            sums = [F.sum(F.col("w") * F.col("x")[i]).alias(f"s{i}") for i in range(n)]
            nearest = F.array_position("_d", F.array_min("_d")) - 1
            rows = self._near(open_).groupBy(*self.cell, nearest.alias("_c")).agg(F.sum("w").alias("_n"), *sums).collect()
            new = {key: self.centres[key].copy() for key in open_}
            for row in rows:
                # Rounded, so that the order of summing does not show.
                new[tuple(row[c] for c in self.cell)][row["_c"]] = np.round([row[f"s{i}"] / row["_n"] for i in range(n)], 12)
            open_ = [key for key in open_ if ((new[key] - self.centres[key]) ** 2).sum(axis=1).max() > tolerance**2]
            self.centres.update(new)

    def best(self) -> dict[tuple, np.ndarray]:
        """Centres of each cell's best try."""
        if not self.centres:
            return {}
        rows = self._near(list(self.centres)).groupBy(*self.cell).agg(F.sum(F.col("w") * F.array_min("_d")).alias("_sum")).collect()
        sums = {tuple(r[c] for c in self.cell): r["_sum"] for r in rows}
        chosen: dict[tuple, tuple] = {}
        for key in sorted(sums, key=lambda k: (sums[k], k[-1])):
            chosen.setdefault(key[:-1], key)
        return {cell: self.centres[key] for cell, key in chosen.items()}


def fit_cells(
    windows: DataFrame,
    cell: list[str],
    clusters: str = "clusters",
    features: list[str] = WINDOW_FEATURES,
    normalization: str = "zscore",
    wanted: DataFrame | None = None,
    seed: int = 0,
    max_rounds: int = MAX_ROUNDS,
    tolerance: float = TOLERANCE,
    tries: int = TRIES,
) -> CellStates:
    """Fit scaler and k-means in every cell of the windows.

    The column `clusters`, one of the cell's, says how many states the cell has. `wanted`
    lists cells that should be there: those without windows fail too. States are numbered
    by ascending unscaled centres, the first feature first.
    """
    spark = windows.sparkSession
    values = F.array(*[F.col(c).cast("double") for c in features])
    facts = cut_lineage(_statistics(windows, cell, features, normalization))
    lost = facts.where("_lost > 0").select(*cell, F.lit("a window feature is missing").alias("reason"))
    failures = [lost]
    if wanted is not None:
        failures.append(wanted.select(*cell).distinct().join(facts, cell, "left_anti").select(*cell, F.lit("no windows to fit").alias("reason")))
    whole = facts.where("_lost = 0").drop("_lost")
    points = windows.groupBy(*cell, values.alias("x")).agg(F.count("*").alias("w"))
    x = _scaled(F.col("x"), len(features)).alias("x")
    scaled = cut_lineage(points.join(small_side(whole), cell).select(*cell, F.xxhash64("x").alias("h"), x, "w"))
    fit = _Fit(scaled, cell, clusters, seed, tries, len(features))
    fit.seeded()
    fit.moved(max_rounds, tolerance)
    failed = [(*key, reason) for key, reason in fit.failed.items()]
    failures.append(spark.createDataFrame(failed, f"{fit.types}, reason string"))

    # Scalers of the fitted cells: as many rows as the driver holds centres of.
    scalers = {tuple(r[c] for c in cell): (np.array(r["_shift"]), np.array(r["_width"])) for r in whole.collect()}
    rows = []
    for key, centres in fit.best().items():
        shift, width = scalers[key]
        order = sorted(range(len(centres)), key=lambda i: tuple(np.round(centres[i] * width + shift, 9)))
        rows.append((*key, shift.tolist(), width.tolist(), centres[order].tolist()))
    fitted = held_rows(spark, rows, f"{fit.types}, _shift array<double>, _width array<double>, _centres array<array<double>>")
    most = max((len(row[-1]) for row in rows), default=0)
    reasons = failures[0]
    for more in failures[1:]:
        reasons = reasons.unionByName(more)
    return CellStates(list(cell), list(features), fitted, reasons, most)
