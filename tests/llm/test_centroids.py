"""Op 12 against plain rounds in whole numbers."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import centroids
from shelfmark.llm.queries import QUERIES
from shelfmark.runtime import cut_lineage


def brute(rows, k, rounds, key):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    first = sorted((key(i), i, q) for i, q in kept if i is not None)[:k]
    c = [list(q) for _, _, q in first]
    q = np.array([v for _, v in kept], object)
    for step in range(rounds + 1):
        d = np.array([((q - np.array(m, object)) ** 2).sum(axis=1) for m in c])
        label = [min(range(len(c)), key=lambda j: (d[j][r], j)) for r in range(len(q))]
        if step == rounds:
            break
        for j in range(len(c)):
            mine = [r for r in range(len(q)) if label[r] == j]
            if mine:
                c[j] = [int(s) // len(mine) for s in q[mine].sum(axis=0)]
    own = [int(d[label[r]][r]) for r in range(len(q))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(kept[r][0], label[r], own[r], sum(o for o, g in zip(own, label) if g == label[r]), sum(own), digest[label[r]])
            for r in range(len(q))]


def test_registered_query_against_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    want = brute(rows, 8, 10, lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    got = [tuple(r) for r in QUERIES["op12_rotated_centroids"](spark, small).collect()]
    assert sorted(got) == sorted(want)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(i, v) for i, v in rows[:10]] + [(100 + i, rows[0][1]) for i in range(5)]  # repeats and ties
    rows += [(200, [1e5, -1e5, 0.0, 3.5]), (201, [-0.0, 0.0, 0.0005, -0.0005])]
    bad = [(300, None), (301, [1.0]), (302, [None, 1.0, 1.0, 1.0]), (303, [float("nan"), 0.0, 0.0, 0.0]),
           (304, [float("inf"), 0.0, 0.0, 0.0]), (305, []), (306, [2.0 ** 17, 0.0, 0.0, 0.0]), (307, [1e300, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "z", 1) for i, v in rows + [(None, [0.5] * 4)] + bad],
                                  "vec_id bigint, embedding array<double>, cluster string, q int").repartition(3)
    assigned, found = centroids.cluster(table, 5, 7, 4, F.md5(F.col("vec_id").cast("string")))
    got = centroids.with_totals(cut_lineage(assigned), found)
    want = brute(rows + [(None, [0.5] * 4)], 5, 7, lambda i: hashlib.md5(str(i).encode()).hexdigest())
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want))


def test_few_and_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (None, [5.0, 5.0])], schema)
    assigned, found = centroids.cluster(one, 8, 10, 2)
    rows = centroids.with_totals(cut_lineage(assigned), found).collect()
    assert sorted((r.vec_id or 0, r.cluster) for r in rows) == [(0, 0), (1, 0)] and len(found) == 1
    assert centroids.cluster(one.filter("vec_id < 0"), 8, 10, 2)[0].count() == 0
    assert centroids.with_totals(*centroids.cluster(one.filter("vec_id is null"), 8, 10, 2)).count() == 0


def test_rotation_prunes_and_never_lies():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(20, 64)) * 900 * np.exp(-np.arange(64) / 8)
    q = np.floor(middle[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 64)) * 60).astype(np.int64)
    moments = np.cov(q.T.astype(float))
    axes = np.linalg.eigh(moments)[1][:, ::-1][:, :16]
    rotation, c = centroids.Rotation(np.ascontiguousarray(axes)), np.floor(middle).astype(np.int64)
    label, best, measured = centroids.nearest(q, *rotation.project(q), c, rotation)
    full = ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (label == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert measured < 0.2 * full.size
