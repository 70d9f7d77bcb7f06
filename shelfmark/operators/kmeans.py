"""k-means to convergence for several runs at once: distributed seeds, and bounds that skip distances.

Seeds. Rounds of oversampling: each round draws ``2 k`` rows without replacement, with probabilities in
proportion to the squared distance to what was drawn before (the smallest -log(u) / d^2, where u is a
hash of id and round, so a run can be repeated). The few rows drawn are weighted by the rows next to
them and clustered on the driver. A second start takes the rows with the smallest md5 of their id; the
cheaper of both runs is kept.

Steps. Now and then the table is written with, for every run, the nearest centre of each row, its
distance, and the distance of the second nearest. From then on the triangle inequality says how far these
can have moved: a row whose own centre, moved that far away, is still nearer than any other, moved that
far closer, keeps its label without a distance being taken. The others are measured against all centres by one
matrix product, and by plain differences where that leaves two centres too close to tell. Labels are those of the
plain method.

The table holds vectors and bounds as the bytes of a few rows at a time, so a step moves them to Python as they are.
A task folds its rows to one sum per centre, so only sums of centres move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import blocks
from ..runtime import cut_lineage

TOLERANCE = 1e-4  # a run ends when no centre moves further
ROWS_AT_ONCE = 1024
SEED_ROUNDS = 4
SLACK = 1e-9  # bounds are doubles: a row is skipped only beyond their rounding
REFRESH_SHARE = 0.25  # rows measured in full beyond which the bounds are taken again
REFRESH_STEPS = 4  # but not more often than this, and each time half as rarely again
PACK_BYTES = 1 << 13  # of vectors in a row of the table
CLOSE = 1e-12  # squared distances by products are right up to this part of the squared lengths
STARTS = ("id", "drawn")

Run = tuple[int, str]  # number of centres, start


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centre; ties to the smaller number."""
    squared = np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1)
    number = squared.argmin(axis=1)
    return number, squared[np.arange(len(rows)), number]


def _numbers(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre, as ``nearest`` has it."""
    if len(centres) == 1:
        return np.zeros(len(rows), np.int64)
    lengths = (centres * centres).sum(axis=1)
    score = rows @ centres.T - lengths / 2  # half the squared length of the row less half the squared distance
    number = score.argmax(axis=1)
    bar = score[np.arange(len(rows)), number] - CLOSE * (np.einsum("ij,ij->i", rows, rows) + lengths.max())
    unsure = np.flatnonzero((score >= bar[:, None]).sum(axis=1) != 1)
    if len(unsure):
        number[unsure] = nearest(rows[unsure], centres)[0]
    return number


def _packed(values: np.ndarray, rows: int) -> pa.Array:
    """The bytes of ``rows`` rows at a time."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * (values.size // len(values))
    ends = np.minimum(np.arange(-(-len(values) // rows) + 1) * rows, len(values)) * width
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _unpacked(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """The rows of ``width`` numbers that ``_packed`` put together."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind).reshape(-1, width)


def _first_rows(points: DataFrame, n: int) -> np.ndarray:
    found = points.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(n).select("vec").toArrow()
    return blocks.matrix(found["vec"])


def _draw(points: DataFrame, known: np.ndarray, n: int, number: int) -> np.ndarray:
    """``n`` further rows, by squared distance to the known ones; rows on top of a known one are never drawn."""
    hashed = points.select(F.xxhash64("id", F.lit(number)).alias("h"), "vec")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = blocks.matrix(batch.column("vec"))
            if not len(rows):
                continue
            squared = np.concatenate([nearest(rows[i:i + ROWS_AT_ONCE], known)[1] for i in range(0, len(rows), ROWS_AT_ONCE)])
            uniform = (batch.column("h").to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) + 0.5
            away = np.flatnonzero(squared > SLACK)
            key = -np.log(uniform[away] / 2.0 ** 53) / squared[away]
            first = np.argsort(key, kind="stable")[:n]
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), batch.column("vec").take(pa.array(away[first]))],
                                             names=["key", "vec"])

    drawn = hashed.mapInArrow(keys, "key double, vec array<double>").orderBy("key", "vec").limit(n).select("vec").toArrow()
    return np.unique(blocks.matrix(drawn["vec"]), axis=0) if len(drawn) else np.zeros((0, known.shape[1]))


def _weights(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Rows next to each centre."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centres), np.int64)
        for batch in batches:
            rows = blocks.matrix(batch.column("vec"))
            for i in range(0, len(rows), ROWS_AT_ONCE):
                total += np.bincount(nearest(rows[i:i + ROWS_AT_ONCE], centres)[0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["c", "n"])

    weights = np.zeros(len(centres))
    counted = points.select("vec").mapInArrow(count, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    for row in counted.collect():
        weights[row["c"]] = row["n"]
    return weights


def _choose(rows: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k centres of a few weighted rows: spread seeds, then steps until nothing changes."""
    rng = np.random.default_rng(k)
    chosen = [int(weights.argmax())]
    while len(chosen) < k:
        squared = nearest(rows, rows[chosen])[1] * weights
        chosen.append(int(rng.choice(len(rows), p=squared / squared.sum())) if squared.sum() > 0
                      else next(i for i in range(len(rows)) if i not in chosen))
    centres = rows[chosen]
    for _ in range(100):
        number, _ = nearest(rows, centres)
        total = np.zeros_like(centres)
        np.add.at(total, number, rows * weights[:, None])
        mass = np.bincount(number, weights, minlength=k)
        new = np.where(mass[:, None] > 0, total / np.maximum(mass, 1)[:, None], centres)
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return centres


def seeds(points: DataFrame, ks: list[int], starts: tuple[str, ...] = STARTS) -> dict[Run, np.ndarray]:
    """First centres of every run. ``points``: id, vec."""
    first = _first_rows(points, max(ks))
    out: dict[Run, np.ndarray] = {(k, "id"): first[:k] for k in ks if "id" in starts}
    if "drawn" in starts:
        known = first[:1]
        for number in range(SEED_ROUNDS):
            known = np.concatenate([known, _draw(points, known, 2 * max(ks), number)])
        weights = _weights(points, known)
        # with fewer different rows than centres the other start has them all
        out |= {(k, "drawn"): _choose(known, weights, k) for k in ks if k <= len(known)}
    return out


@dataclass
class Bounds:
    """Centres at the time the table was written with the distances to them."""
    runs: list[Run] = field(default_factory=list)
    centres: dict[Run, np.ndarray] = field(default_factory=dict)

    def drift(self, run: Run, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each centre has moved, and the furthest that any other one has."""
        moved = np.sqrt(((now - self.centres[run]) ** 2).sum(axis=1))
        if len(moved) == 1:
            return moved, np.zeros(1)
        order = np.argsort(moved)
        others = np.full(len(moved), moved[order[-1]])
        others[order[-1]] = moved[order[-2]]
        return moved, others


def _bounded(points: DataFrame, centres: dict[Run, np.ndarray]) -> tuple[DataFrame, Bounds]:
    """The rows with their nearest centre and the distances of the nearest and the second, one entry a run."""
    runs = list(centres)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = blocks.matrix(batch.column("vec"))
            for at in range(0, len(whole), ROWS_AT_ONCE):
                rows = whole[at:at + ROWS_AT_ONCE]
                shape = (len(rows), len(runs))
                near, upper, lower = np.zeros(shape, np.int32), np.zeros(shape), np.full(shape, np.inf)
                for r, run in enumerate(runs):
                    distance = np.sqrt(np.stack([((rows - c) ** 2).sum(axis=1) for c in centres[run]], axis=1))
                    near[:, r] = distance.argmin(axis=1)
                    upper[:, r] = distance[np.arange(len(rows)), near[:, r]]
                    if distance.shape[1] > 1:
                        distance[np.arange(len(rows)), near[:, r]] = np.inf
                        lower[:, r] = distance.min(axis=1)
                together = max(1, PACK_BYTES // (8 * max(1, rows.shape[1])))
                yield pa.RecordBatch.from_arrays([_packed(v, together) for v in (rows, near, upper, lower)],
                                                 names=["vec", "near", "upper", "lower"])

    schema = "vec binary, near binary, upper binary, lower binary"
    return cut_lineage(points.select("vec").mapInArrow(measure, schema)), Bounds(runs, dict(centres))


def label(rows: np.ndarray, centres: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray,
          moved: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centres, and the rows that had to be measured against all of them."""
    number = near.astype(np.int64)
    open_ = np.flatnonzero(upper + moved[number] + SLACK >= lower - others[number])
    if len(open_):
        number[open_] = _numbers(rows[open_] if len(open_) < len(rows) else rows, centres)
    return number, open_


def step(table: DataFrame, bounds: Bounds, centres: dict[Run, np.ndarray]) -> tuple[dict[Run, np.ndarray], float]:
    """Means of the clusters of every run, and the share of rows that were measured in full.

    A cluster without rows keeps its centre.
    """
    runs = list(centres)
    drift = {run: bounds.drift(run, centres[run]) for run in runs}
    column = {run: bounds.runs.index(run) for run in runs}
    dims = centres[runs[0]].shape[1]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(centres[run]), centres[run].shape[1] + 1)) for run in runs]
        measured = np.zeros(len(runs))
        for batch in batches:
            if len(batch) == 0:
                continue
            whole = _unpacked(batch.column("vec"), dims)
            near = _unpacked(batch.column("near"), len(bounds.runs), np.int32)
            upper, lower = (_unpacked(batch.column(c), len(bounds.runs)) for c in ("upper", "lower"))
            for at in range(0, len(whole), ROWS_AT_ONCE):
                cut = slice(at, at + ROWS_AT_ONCE)
                rows = np.concatenate([whole[cut], np.ones((len(whole[cut]), 1))], axis=1)
                for r, run in enumerate(runs):
                    c = column[run]
                    number, full = label(whole[cut], centres[run], near[cut, c], upper[cut, c], lower[cut, c], *drift[run])
                    member = np.zeros((len(rows), len(sums[r])))
                    member[np.arange(len(rows)), number] = 1
                    sums[r] += member.T @ rows
                    measured[r] += len(full)
        for r, total in enumerate(sums):
            value = np.append(total.ravel(), measured[r])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), r, np.int32)), pa.array(np.arange(len(value))),
                                              pa.array(value)], names=["run", "pos", "total"])

    sums = (table.select("vec", "near", "upper", "lower").mapInArrow(fold, "run int, pos bigint, total double")
            .groupBy("run", "pos").agg(F.sum("total").alias("total")).toArrow())
    number, pos, total = (sums[c].to_numpy() for c in ("run", "pos", "total"))
    totals = [np.zeros(len(centres[run]) * (centres[run].shape[1] + 1) + 1) for run in runs]
    for r, flat in enumerate(totals):
        flat[pos[number == r]] = total[number == r]
    means, rows, measured = {}, 0.0, 0.0
    for run, flat in zip(runs, totals):
        t = flat[:-1].reshape(len(centres[run]), -1)
        means[run] = np.where(t[:, -1:] > 0, t[:, :-1] / np.maximum(t[:, -1:], 1), centres[run])
        rows, measured = rows + t[:, -1].sum(), measured + flat[-1]
    return means, measured / max(1.0, rows)


def inertia(points: DataFrame, centres: dict[Run, np.ndarray]) -> dict[Run, float]:
    """Sum of squared distances to the nearest centre, for every run."""
    runs = list(centres)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = np.zeros(len(runs))
        for batch in batches:
            whole = blocks.matrix(batch.column("vec"))
            for at in range(0, len(whole), ROWS_AT_ONCE):
                cost += [nearest(whole[at:at + ROWS_AT_ONCE], centres[run])[1].sum() for run in runs]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(runs))), pa.array(cost)], names=["run", "cost"])

    folded = points.select("vec").mapInArrow(fold, "run bigint, cost double").groupBy("run").agg(F.sum("cost").alias("cost"))
    return {runs[r["run"]]: r["cost"] for r in folded.collect()}


def fit(points: DataFrame, ks: list[int], iterations: int,
        starts: tuple[str, ...] = STARTS) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Centres and cost for every k, of the cheapest start. ``points``: id, vec; a table that can be read again."""
    if not ks:
        return {}, {}
    centres = seeds(points, ks, starts)
    moving, table, bounds, since, wait = list(centres), None, Bounds(), 0, REFRESH_STEPS
    for _ in range(iterations):
        if table is None:
            table, bounds = _bounded(points, {run: centres[run] for run in moving})
            since = 0
        means, measured = step(table, bounds, {run: centres[run] for run in moving})
        moving = [run for run in moving if np.sqrt(((means[run] - centres[run]) ** 2).sum(axis=1)).max() > TOLERANCE]
        centres |= means
        since += 1
        if not moving:
            break
        if measured > REFRESH_SHARE and since >= wait:
            table, wait = None, wait + wait // 2
    costs = inertia(points, centres)
    best = {k: min((run for run in centres if run[0] == k), key=lambda run: (costs[run], starts.index(run[1]))) for k in ks}
    return {k: centres[run] for k, run in best.items()}, {k: costs[run] for k, run in best.items()}
