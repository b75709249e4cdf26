"""Protocol states: windows clustered by their scaled features."""

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alarmloom.operators.scale import Scaler, fit_scaler
from alarmloom.operators.sizing import cut_lineage
from alarmloom.schema import WINDOW_FEATURES
from alarmloom.shipping import ship_by_value

# Micro-clusters that stand for the windows in the hierarchical method.
MICRO_CLUSTERS = 64
# Rounds of a mixture at most, the gain of mean log-likelihood below which it stands still, and
# what is added to every variance.
MIXTURE_ROUNDS, MIXTURE_GAIN, LEAST_VARIANCE = 100, 1e-3, 1e-6


def nearest_centroid(columns: list[Column], centroids: list[list[float]]) -> Column:
    """Index of the closest centroid, by squared distance; the lower index wins ties."""
    distances = []
    for i, centroid in enumerate(centroids):
        squares = [(c - F.lit(float(x))) * (c - F.lit(float(x))) for c, x in zip(columns, centroid)]
        distances.append(F.struct(sum(squares[1:], squares[0]).alias("d"), F.lit(i).alias("i")))
    return F.array_min(F.array(*distances))["i"]


def state_name(number: Column) -> Column:
    return F.concat(F.lit("STATE_"), number.cast("string"))


def _log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """Logarithm of weight times density, a row per point and a column per component."""
    out = np.empty((len(x), len(weights)))
    for k, (weight, mean, covariance) in enumerate(zip(weights, means, covariances)):
        lower = np.linalg.cholesky(covariance)
        z = np.linalg.solve(lower, (x - mean).T)
        out[:, k] = np.log(weight) - np.log(np.diag(lower)).sum() - (z * z).sum(axis=0) / 2
    return out - x.shape[1] * np.log(2 * np.pi) / 2


@dataclass
class Mixture:
    """Gaussian components with full covariances, fitted by expectation-maximisation from the groups of k-means.

    A start from random rows depends on how the rows are partitioned, and may give one row
    a component of its own while two groups share another.
    """

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds `prediction`, the component most likely to have given the features."""
        ship_by_value()
        values = self.weights, self.means, self.covariances

        def number(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype="int32")
            return pd.Series(_log_densities(np.stack(features), *values).argmax(axis=1).astype("int32"))

        return rows.withColumn("prediction", F.pandas_udf(number, "int")(vector_to_array("features")))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(w), m.tolist(), c.tolist()) for i, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances))]
        schema = "component int, weight double, mean array<double>, covariance array<array<double>>"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Mixture":
        rows = spark.read.parquet(path).orderBy("component").collect()
        return Mixture(*(np.array([r[c] for r in rows]) for c in ("weight", "mean", "covariance")))

    @staticmethod
    def fit(points: DataFrame, n_components: int, seed: int) -> "Mixture":
        """From features and the number w of rows that have them; a round is one job, and the driver gets sums only."""
        start = KMeans(k=n_components, seed=seed, weightCol="w").fit(points)
        centres = np.array(start.clusterCenters())
        labelled = cut_lineage(start.transform(points).select(vector_to_array("features").alias("x"), "w", "prediction"))
        mixture, before = None, -np.inf
        for _ in range(MIXTURE_ROUNDS + 1):
            sizes, sums, squares, logs = _moments(labelled, mixture, centres)
            gain = logs / sizes.sum() - before
            if mixture is not None and gain < MIXTURE_GAIN:
                break
            before = logs / sizes.sum() if mixture is not None else before
            # A component that has lost all its rows leaves.
            held = sizes > 1e-9
            sizes, sums, squares, centres = sizes[held], sums[held], squares[held], centres[held]
            shift = sums / sizes[:, None]
            spread = squares / sizes[:, None, None] - shift[:, :, None] * shift[:, None, :]
            # Rounded, so that the order of summing does not show.
            centres = np.round(centres + shift, 12)
            mixture = Mixture(sizes / sizes.sum(), centres, np.round(spread, 12) + LEAST_VARIANCE * np.eye(centres.shape[1]))
        return mixture


def _moments(points: DataFrame, mixture: Mixture | None, centres: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sizes, sums and products of deviations from the centres per component, and the log-likelihood.

    Points belong to the components by their responsibilities; without a mixture, each to its prediction.
    """
    ship_by_value()
    n, d = centres.shape
    values = (mixture.weights, mixture.means, mixture.covariances) if mixture else None

    def work(batches):
        total = np.zeros((n, 1 + d + d * d))
        logs = 0.0
        for frame in batches:
            if not len(frame):
                continue
            x, w = np.stack(frame["x"]), frame["w"].to_numpy(float)
            if values is None:
                share = np.eye(n)[frame["prediction"].to_numpy()]
            else:
                dense = _log_densities(x, *values)
                top = dense.max(axis=1)
                whole = top + np.log(np.exp(dense - top[:, None]).sum(axis=1))
                logs += float((whole * w).sum())
                share = np.exp(dense - whole[:, None])
            for k in range(n):
                r, far = share[:, k] * w, x - centres[k]
                total[k] += np.concatenate(([r.sum()], r @ far, ((far * r[:, None]).T @ far).ravel()))
        yield pd.DataFrame({"sums": [total.ravel().tolist()], "logs": [logs]})

    rows = points.mapInPandas(work, "sums array<double>, logs double").collect()
    total = np.sum([r["sums"] for r in rows], axis=0).reshape(n, 1 + d + d * d)
    return total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(n, d, d), sum(r["logs"] for r in rows)


@dataclass
class StateModel:
    """A fitted scaler and clusterer, with the state number of each cluster."""

    kind: str
    scaler: Scaler
    clusterer: Any
    numbers: list[int]

    def transform(self, windows: DataFrame) -> DataFrame:
        """Add `state` to new windows; the hierarchical method cannot label new data."""
        if self.kind == "agglomerative":
            raise ValueError("agglomerative clustering does not label new data")
        return self.label(windows)

    def label(self, windows: DataFrame) -> DataFrame:
        predicted = self.clusterer.transform(_scaled(windows, self.scaler))
        number = F.array(*[F.lit(n) for n in self.numbers])[F.col("prediction")]
        added = [c for c in predicted.columns if c not in windows.columns]
        return predicted.withColumn("state", state_name(number)).drop(*added)

    def save(self, spark: SparkSession, path: str) -> None:
        self.scaler.save(spark, f"{path}/scaler")
        if self.kind == "gmm":
            self.clusterer.save(spark, f"{path}/clusterer")
        else:
            self.clusterer.write().overwrite().save(f"{path}/clusterer")
        rows = [(self.kind, i, n) for i, n in enumerate(self.numbers)]
        spark.createDataFrame(rows, "kind string, cluster int, number int").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/states")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "StateModel":
        rows = spark.read.parquet(f"{path}/states").orderBy("cluster").collect()
        kind = rows[0]["kind"]
        clusterer = Mixture.load(spark, f"{path}/clusterer") if kind == "gmm" else KMeansModel.load(f"{path}/clusterer")
        return StateModel(kind, Scaler.load(spark, f"{path}/scaler"), clusterer, [r["number"] for r in rows])


def _scaled(windows: DataFrame, scaler: Scaler) -> DataFrame:
    values = F.array(*scaler.expressions().values())
    return windows.withColumn("features", array_to_vector(values))


def _ranks(centres: np.ndarray, scaler: Scaler) -> list[int]:
    """State number per centre: ascending by unscaled features, mean payload first."""
    original = centres * np.array(scaler.widths) + np.array(scaler.centres)
    order = sorted(range(len(original)), key=lambda i: tuple(np.round(original[i], 9)))
    ranks = [0] * len(order)
    for rank, cluster in enumerate(order):
        ranks[cluster] = rank
    return ranks


def fit_states(
    windows: DataFrame, n_states: int, clustering: str = "kmeans", normalization: str = "zscore", seed: int = 0
) -> StateModel:
    """Fit scaler and clusterer on one row per window."""
    scaler = fit_scaler(windows, WINDOW_FEATURES, normalization)
    scaled = _scaled(windows, scaler).select("features")
    if clustering == "kmeans":
        model = KMeans(k=n_states, seed=seed).fit(scaled)
        return StateModel(clustering, scaler, model, _ranks(np.array(model.clusterCenters()), scaler))
    if clustering == "gmm":
        points = cut_lineage(scaled.groupBy("features").agg(F.count("*").alias("w")))
        model = Mixture.fit(points, n_states, seed)
        return StateModel(clustering, scaler, model, _ranks(model.means, scaler))
    if clustering == "agglomerative":
        micro = KMeans(k=max(MICRO_CLUSTERS, n_states), seed=seed).fit(scaled)
        centres = np.array(micro.clusterCenters())
        counted = micro.transform(scaled).groupBy("prediction").count().collect()
        weights = np.zeros(len(centres))
        for row in counted:
            weights[row["prediction"]] = row["count"]
        groups = _ward(centres, weights, n_states)
        labels = sorted(set(groups))
        merged = np.array([np.average(centres[groups == g], axis=0, weights=weights[groups == g]) for g in labels])
        number = dict(zip(labels, _ranks(merged, scaler)))
        return StateModel(clustering, scaler, micro, [number[g] for g in groups])
    raise ValueError(f"unknown clustering type: {clustering}")


def _ward(centres: np.ndarray, weights: np.ndarray, wanted: int) -> np.ndarray:
    """Merge weighted centres by least growth of variance until `wanted` groups are left."""
    group = np.arange(len(centres))
    alive = [i for i in range(len(centres)) if weights[i] > 0]
    group[weights == 0] = alive[0]
    mean, size = centres.astype(float).copy(), weights.astype(float).copy()
    while len(alive) > wanted:
        m, n = mean[alive], size[alive]
        gap = ((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)
        growth = gap * n[:, None] * n[None, :] / (n[:, None] + n[None, :])
        growth[np.tril_indices(len(alive))] = np.inf
        a, b = (alive[i] for i in np.unravel_index(np.argmin(growth), growth.shape))
        mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        group[group == b] = a
        alive.remove(b)
    return group


def assign_states(model: StateModel, windows: DataFrame, training: bool) -> DataFrame:
    """Label the windows the model was fitted on, or new ones."""
    return model.label(windows) if training else model.transform(windows)


def state_quality(events: DataFrame, log: list[str]) -> DataFrame:
    """Traces and events per log; logs without events have no row."""
    return events.groupBy(*log, "case_id").agg(F.count("*").alias("_n")).groupBy(*log).agg(
        F.count("*").alias("n_traces"), F.sum("_n").alias("n_events")
    )
