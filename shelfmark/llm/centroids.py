"""Centroid clustering of integer vectors with exact assignment, pruned in a PCA-rotated space.

Vectors are whole numbers, floor(scale * x). Every round assigns each vector to its nearest centroid
(squared Euclidean distance, ties to the smaller number) and replaces every centroid that has vectors
by their componentwise floor(sum / count).

1. The second moments of all vectors (a fixed number of sums) give a rotation. A vector is stored as its
   leading rotated coordinates and the norm of the rest of it.
2. The distance of the leading coordinates plus the squared difference of the rest norms is a lower bound
   of the squared distance: a rotation keeps distances, and rests of norms a and b are at least |a - b|
   apart. Centroids whose bound is above the exact distance to the one with the smallest bound are out;
   a margin covers rounding.
3. The survivors are measured in whole numbers, so the result does not depend on the rotation.

A task sends one row of sums per centroid, so a round moves tasks x centroids rows and the driver holds
the centroids only.

Defined results: vectors with another number of components, a component that is null, not finite, or of
2^27 or more after scaling (distances would leave 64 bits) are left out; repeated rows are vectors of
their own; rows without an id are clustered but never start a centroid; fewer vectors with an id than
centroids give as many centroids as there are, none of them gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut_lineage

SCALE = 1024
LARGEST = 1 << 27
LEADING = 16
BLOCK_ROWS = 8192  # rows measured at a time
PREPARED = "vec_id bigint, q array<int>, lead array<double>, rest double"


@dataclass
class Rotation:
    """Leading principal axes as columns."""
    axes: np.ndarray

    def project(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the rest of each row."""
        x = q.astype(np.float64)
        lead = x @ self.axes
        return lead, np.sqrt(np.maximum(0, (x * x).sum(axis=1) - (lead * lead).sum(axis=1)))


def whole_numbers(vectors: DataFrame, dims: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): floor(scale * x) of the vectors that can be measured."""
    x = F.col("embedding").cast("array<double>")
    scaled = F.transform(x, lambda v: F.floor(v * scale))
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < LARGEST))
    return (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
            .filter(F.coalesce((F.size("embedding") == dims) & fits, F.lit(False)))
            .select("vec_id", scaled.cast("array<int>").alias("q")))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def fit_rotation(numbers: DataFrame, dims: int, leading: int = LEADING) -> Rotation:
    """Leading axes of the second moments about the mean of all vectors."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims + 1, dims + 1)), 0
        for batch in batches:
            x = np.hstack([matrix(batch.column("q"), dims), np.ones((len(batch), 1))])
            total += x.T @ x
            n += len(batch)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    cells = numbers.select("q").mapInArrow(sums, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    moments = np.zeros((dims + 1) ** 2)
    for row in cells.collect():  # (dims + 1)^2 rows
        moments[row["cell"]] = row["value"]
    moments = moments.reshape(dims + 1, dims + 1)
    n = max(1.0, moments[-1, -1])
    mean = moments[-1, :-1] / n
    _, axes = np.linalg.eigh(moments[:-1, :-1] / n - np.outer(mean, mean))
    return Rotation(np.ascontiguousarray(axes[:, ::-1][:, :min(leading, dims)]))


def prepare(numbers: DataFrame, rotation: Rotation, dims: int) -> DataFrame:
    """(vec_id, q, lead, rest): what every round reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation.project(matrix(batch.column("q"), dims))
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * lead.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("q"), pa.ListArray.from_arrays(ends, pa.array(lead.ravel())),
                 pa.array(rest)], names=["vec_id", "q", "lead", "rest"])

    return numbers.mapInArrow(run, PREPARED)


def exact(q: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = q.astype(np.int64) - centroid
    return (gap * gap).sum(axis=1)


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray,
            rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each row, and how many distances were measured in full."""
    c_lead, c_rest = rotation.project(centroids)
    bound = ((lead * lead).sum(axis=1)[:, None] + (c_lead * c_lead).sum(axis=1)[None, :] - 2 * lead @ c_lead.T
             + (rest[:, None] - c_rest[None, :]) ** 2)
    # rounding grows with the squared norms, not with the difference
    norms = (lead * lead).sum(axis=1) + rest * rest
    bound -= 1 + 1e-9 * (norms[:, None] + ((c_lead * c_lead).sum(axis=1) + c_rest * c_rest)[None, :])
    guess = bound.argmin(axis=1)
    best = np.empty(len(q), np.int64)
    for c in np.unique(guess):
        rows = np.flatnonzero(guess == c)
        best[rows] = exact(q[rows], centroids[c])
    label, measured = guess.copy(), len(q)
    survives = bound <= best[:, None]
    survives[np.arange(len(q)), guess] = False
    for c in np.flatnonzero(survives.any(axis=0)):
        rows = np.flatnonzero(survives[:, c])
        distance = exact(q[rows], centroids[c])
        closer = (distance < best[rows]) | ((distance == best[rows]) & (c < label[rows]))
        label[rows[closer]], best[rows[closer]] = c, distance[closer]
        measured += len(rows)
    return label, best, measured


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, rotation: Rotation):
    """(batch, numbers, label, distance, measured) for blocks of bounded rows."""
    dims = centroids.shape[1]
    for whole in batches:
        for at in range(0, len(whole), BLOCK_ROWS):
            batch = whole.slice(at, BLOCK_ROWS)
            q = matrix(batch.column("q"), dims)
            lead = matrix(batch.column("lead"), rotation.axes.shape[1])
            yield batch, q, *nearest(q, lead, batch.column("rest").to_numpy(), centroids, rotation)


def seeds(numbers: DataFrame, k: int, key: Column) -> np.ndarray:
    """The ``k`` vectors with the smallest ``key``; equal keys in the order of the components."""
    first = (numbers.filter("vec_id is not null").select(key.alias("key"), "vec_id", "q")
             .orderBy("key", "vec_id", "q").limit(k).collect())
    return np.array([r["q"] for r in first], np.int64)


def update(prepared: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Centroids after one round."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, q, label, _, _ in _assign(batches, centroids, rotation):
            order = np.argsort(label, kind="stable")
            held, first = np.unique(label[order], return_index=True)
            total[held] += np.add.reduceat(q[order].astype(np.int64), first, axis=0)
            n += np.bincount(label, minlength=len(n))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array(list(total[held]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "total"])

    parts = prepared.select("q", "lead", "rest").mapInArrow(sums, "cluster bigint, n bigint, total array<bigint>")
    exact_sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    new = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact_sums).collect():  # one row per centroid
        new[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centroids.shape[1])]
    return new


def assign(prepared: DataFrame, centroids: np.ndarray, rotation: Rotation) -> DataFrame:
    """(vec_id, cluster, distance, n_measured): nearest centroid; ``n_measured`` is per block, on its first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, label, distance, measured in _assign(batches, centroids, rotation):
            counted = np.zeros(len(batch), np.int64)
            counted[0] = measured
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(distance), pa.array(counted)],
                names=["vec_id", "cluster", "distance", "n_measured"])

    return prepared.mapInArrow(run, "vec_id bigint, cluster int, distance bigint, n_measured bigint")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, key: Column | None = None, scale: int = SCALE,
            leading: int = LEADING) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, n_measured) after ``rounds`` rounds, and the centroids.

    Centroids start as the vectors with the smallest ``key`` (SHA-256 of the id by default).
    """
    numbers = cut_lineage(whole_numbers(vectors, dims, scale))
    start = seeds(numbers, k, F.sha2(F.col("vec_id").cast("string"), 256) if key is None else key)
    if not len(start):
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint, n_measured bigint"), start
    rotation = fit_rotation(numbers, dims, leading)
    prepared = cut_lineage(prepare(numbers, rotation, dims))
    for _ in range(rounds):
        new = update(prepared, start, rotation)
        if (new == start).all():  # further rounds would repeat this one
            break
        start = new
    return assign(prepared, start, rotation), start


def with_totals(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add cluster_inertia, inertia and centroid_sha256; ``assigned`` is a stable table."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    each = {r["cluster"]: int(r["d"]) for r in sums}  # one row per centroid, whatever the table
    rows = [(c, d, sum(each.values()), digest(centroids[c])) for c, d in each.items()]
    facts = assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster")
