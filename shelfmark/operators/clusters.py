"""k-means for several k at once, the choice of k, and the dispatch between clustering algorithms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K
from ..functions import blocks
from ..runtime import cut_lineage
from . import kmeans
from .neighbours import dbscan
from .vectors import l2_normalize

MAX_ITERATIONS = 300


def _points(df: DataFrame) -> DataFrame:
    """Unit vectors, written once: every pass reads the same rows."""
    return cut_lineage(l2_normalize(df.select("id", "vec")))


def _elbow_ks(n: int, min_k: int, max_k: int) -> list[int]:
    last = min(max_k, n // 2 + 1, n)
    return list(range(min_k, last + 1)) if last > min_k else []


def elbow_curve(df: DataFrame, min_k: int = K.ELBOW_MIN_K, max_k: int = K.ELBOW_MAX_K,
                iterations: int = MAX_ITERATIONS, starts: tuple[str, ...] = kmeans.STARTS) -> DataFrame:
    """(k, inertia) for each k, from one loop for all of them. ``df``: id, vec."""
    points = _points(df)
    _, costs = kmeans.fit(points, _elbow_ks(points.count(), min_k, max_k), iterations, starts)
    return df.sparkSession.createDataFrame(sorted(costs.items()), "k int, inertia double")


def elbow_pick(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The k at the sharpest bend per curve: one after the largest second difference.

    A curve of fewer than three points gives its first k, ties go to the smaller k. A curve has
    at most 11 points (k = 2..12), so a window over it is small.
    """
    keys = keys or []
    by_k = Window.partitionBy(*keys).orderBy("k")
    whole = Window.partitionBy(*keys)
    bend = F.lead("inertia", 1).over(by_k) - 2 * F.col("inertia") + F.lag("inertia", 1).over(by_k)
    points = curve.withColumns({"_bend": bend, "_n": F.count("*").over(whole)})
    # second difference number i belongs to point i+1, which is the one picked
    eligible = points.filter(F.col("_bend").isNotNull() | (F.col("_n") < 3))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_bend"), "k")
    return (eligible.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1)
            .select(*keys, "k"))


def pick_k(costs: list[tuple[int, float]], min_k: int = K.ELBOW_MIN_K) -> int:
    """The same choice for one curve that is on the driver already (at most 11 numbers)."""
    if not costs:
        return min_k
    if len(costs) < 3:
        return costs[0][0]
    bends = [(costs[i - 1][1] - 2 * costs[i][1] + costs[i + 1][1], -costs[i][0]) for i in range(1, len(costs) - 1)]
    return -max(bends)[1]


def kmeans_labels(df: DataFrame, k: int | None = None, auto: bool = True, iterations: int = MAX_ITERATIONS,
                  starts: tuple[str, ...] = kmeans.STARTS) -> DataFrame:
    """(id, cluster) with labels ``cluster_<i>``, numbered by their smallest member.

    ``df``: id, vec. k is given, or taken from the elbow, or from the number of rows. ``starts``: where
    runs begin ("id": the rows with the smallest md5 of their id, "drawn": rows drawn far apart); the
    cheapest run counts.
    """
    points = _points(df)
    n = points.count()
    if k is None and auto:
        centres, costs = kmeans.fit(points, _elbow_ks(n, K.ELBOW_MIN_K, K.ELBOW_MAX_K), iterations, starts)
        k = min(pick_k(sorted(costs.items())), n)
    else:
        k, centres = min(k or max(2, min(8, n // 3)), n), {}
    chosen = centres[k] if k in centres else kmeans.fit(points, [k], iterations, starts)[0][k]

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        return pa.array(kmeans.nearest(blocks.matrix(column), chosen)[0].astype(np.int32))

    labelled = points.select("id", nearest("vec").alias("_c"))
    firsts = labelled.groupBy("_c").agg(F.min("id").alias("_first"))
    # one row per centre
    numbered = firsts.withColumn("_i", F.row_number().over(Window.orderBy("_first")) - 1)
    return labelled.join(numbered, "_c").select(
        "id", F.concat(F.lit("cluster_"), F.col("_i").cast("string")).alias("cluster"))


def cluster(df: DataFrame, algorithm: str = "kmeans", eps: float = K.DBSCAN_EPS,
            min_points: int = K.DBSCAN_MIN_POINTS, auto: bool = True,
            iterations: int = MAX_ITERATIONS, starts: tuple[str, ...] = kmeans.STARTS) -> DataFrame:
    """(id, cluster): DBSCAN when asked for, else k-means; fewer than two rows are one cluster."""
    if df.limit(2).count() < 2:
        return df.select("id", F.lit("cluster_0").alias("cluster"))
    if algorithm == "dbscan":
        return dbscan(df, eps, min_points)
    return kmeans_labels(df, auto=auto, iterations=iterations, starts=starts)
