"""k-means: the steps against SQL, converged runs against plain ones, seeds and bounds."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import blocks
from shelfmark.operators import clusters, kmeans
from shelfmark.runtime import cut_lineage

STEPS = 4
ALL_KS = "SELECT unnest(range(2, least(12, n // 2 + 1, n) + 1)) AS k FROM (SELECT count(*) AS n FROM pts) q"
ONE_K = "SELECT greatest(2, least(8, n // 3)) AS k FROM (SELECT count(*) AS n FROM pts) q"


def steps_sql(ks: str) -> str:
    """The steps of k-means for every k of ``ks``: centres c<STEPS> and assignments a<STEPS> (k, id, c, d)."""
    parts = [f"""pts AS (SELECT vec_id AS id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) q),
  wide AS (SELECT id, unnest(range(len(v))) AS pos, unnest(v) AS x FROM pts),
  seeds AS (SELECT v, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS c FROM pts), ks AS ({ks}),
  c0 AS (SELECT k, c, v FROM ks JOIN seeds ON c < k)"""]
    for i in range(STEPS + 1):
        parts.append(f"""a{i} AS (SELECT k, id, c, d FROM (SELECT k, p.id, c, list_distance(p.v, c{i}.v) AS d FROM pts p, c{i}) q
    QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY d, c) = 1)""")
        if i < STEPS:
            parts.append(f"""c{i + 1} AS (SELECT o.k, o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN
    (SELECT k, c, list(x ORDER BY pos) AS v FROM (SELECT k, c, pos, avg(x) AS x FROM a{i} JOIN wide USING (id) GROUP BY k, c, pos) q
     GROUP BY k, c) m USING (k, c))""")
    return "WITH " + ",\n".join(parts)


@pytest.fixture(scope="module")
def db(small):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    return db


@pytest.fixture(scope="module")
def vectors(spark, small):
    return spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@pytest.fixture(scope="module")
def unit(vectors):
    rows = sorted((r.id, r.vec) for r in vectors.collect())
    return np.array([i for i, _ in rows]), blocks.unit_rows(np.array([v for _, v in rows], float))


def test_few_steps_are_those_of_sql(vectors, db):
    curve = clusters.elbow_curve(vectors, iterations=STEPS, starts=("id",)).collect()
    want = db.execute(steps_sql(ALL_KS) + f" SELECT k, sum(d * d) FROM a{STEPS} GROUP BY k ORDER BY k").fetchall()
    assert [r.k for r in curve] == [k for k, _ in want]
    assert np.allclose([r.inertia for r in curve], [x for _, x in want], atol=1e-6)
    numbered = f"""SELECT id, concat('cluster_', CAST(i AS VARCHAR)) FROM a{STEPS} JOIN
      (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY min(id)) - 1 AS i FROM a{STEPS} GROUP BY k, c) q USING (k, c)"""
    got = clusters.kmeans_labels(vectors, auto=False, iterations=STEPS, starts=("id",)).collect()
    assert {(r.id, r.cluster) for r in got} == set(db.execute(steps_sql(ONE_K) + " " + numbered).fetchall())


def plain(rows, centres, iterations=300):
    for _ in range(iterations):
        number, _ = kmeans.nearest(rows, centres)
        new = np.array([rows[number == c].mean(axis=0) if (number == c).any() else centres[c] for c in range(len(centres))])
        moved = np.sqrt(((new - centres) ** 2).sum(axis=1)).max()
        centres = new
        if moved <= kmeans.TOLERANCE:
            break
    return centres, kmeans.nearest(rows, centres)[1].sum()


def test_converged_runs(vectors, unit):
    """Not dearer than the plain run from the same first rows, and the drawn start pays off."""
    ids, rows = unit
    import hashlib
    order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(str(ids[i]).encode()).hexdigest(), ids[i]))
    costs = {r.k: r.inertia for r in clusters.elbow_curve(vectors).collect()}
    alone = {k: plain(rows, rows[order[:k]])[1] for k in costs}
    assert all(costs[k] <= alone[k] + 1e-6 for k in costs) and len(costs) == 11
    assert any(costs[k] < alone[k] - 1e-3 for k in costs)
    got = {r.id: r.cluster for r in clusters.kmeans_labels(vectors, k=8).collect()}
    number = np.array([int(got[i][8:]) for i in ids.tolist()])
    means = np.array([rows[number == c].mean(axis=0) for c in range(8)])
    own = ((rows - means[number]) ** 2).sum(axis=1)
    assert (own <= kmeans.nearest(rows, means)[1] + 1e-3).all() and own.sum() <= alone[8] + 1e-3
    firsts = [ids[number == c].min() for c in range(8)]
    assert firsts == sorted(firsts)


def test_bounds_skip_rows_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(6, 5)) * 3
    rows = middle[rng.integers(0, 6, 900)] + rng.normal(size=(900, 5))
    points = cut_lineage(spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "id bigint, vec array<double>").repartition(5))
    shares = []
    taken = kmeans.step
    monkeypatch.setattr(kmeans, "step", lambda *a: shares.append((out := taken(*a))[1]) or out)
    first = kmeans.seeds(points, [6], ("id",))[6, "id"]
    centres, costs = kmeans.fit(points, [6], 300, ("id",))
    want, cost = plain(rows, first)
    assert np.allclose(centres[6], want, atol=1e-9) and abs(costs[6] - cost) < 1e-6
    assert shares[-1] < 0.3 and shares[0] < 1.0


def test_label_is_that_of_the_plain_method():
    rng = np.random.default_rng(2)
    rows, old = rng.normal(size=(500, 3)), rng.normal(size=(7, 3))
    rows[:20] = (old[0] + old[1]) / 2  # ties
    distance = np.sqrt(((rows[:, None] - old[None]) ** 2).sum(axis=2))
    near = distance.argmin(axis=1)
    ranked = np.sort(distance, axis=1)
    for scale in (0, 1e-3, 0.1, 2):
        now = old + rng.normal(size=old.shape) * scale
        bounds = kmeans.Bounds([(7, "id")], {(7, "id"): old})
        number, full = kmeans.label(rows, now, near, ranked[:, 0], ranked[:, 1], *bounds.drift((7, "id"), now))
        assert (number == kmeans.nearest(rows, now)[0]).all()
        assert scale > 0.05 or len(full) < 120


def test_copies_few_rows_and_one_centre(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id bigint, vec array<double>")
    assert {r.cluster for r in clusters.kmeans_labels(same, k=3).collect()} == {"cluster_0"}
    two = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)], "id bigint, vec array<double>")
    assert {(r.id % 2, r.cluster) for r in clusters.kmeans_labels(two, k=2).collect()} == {(0, "cluster_0"), (1, "cluster_1")}
    assert {r.cluster for r in clusters.kmeans_labels(two, k=1).collect()} == {"cluster_0"}
    drawn = kmeans.seeds(cut_lineage(two), [2], ("drawn",))[2, "drawn"]
    assert sorted(map(tuple, drawn.tolist())) == [(1.0, 0.0), (1.0, 1.0)]


def test_numbers_by_products_are_those_of_differences():
    rng = np.random.default_rng(5)
    rows, centres = rng.normal(size=(400, 7)), rng.normal(size=(9, 7))
    rows[:50] = (centres[3] + centres[1]) / 2  # ties
    centres[8], centres[7] = centres[2], centres[2] * (1 + 1e-15)
    rows[50:90] = centres[2] + rng.normal(scale=1e-3, size=(40, 7))
    for scale in (1e-6, 1.0, 1e6):
        assert (kmeans._numbers(rows * scale, centres * scale) == kmeans.nearest(rows * scale, centres * scale)[0]).all()
    column = kmeans._packed(rows, 33)
    assert len(column) == 13 and (kmeans._unpacked(column, 7) == rows).all()
    assert (kmeans._unpacked(column.slice(2, 3), 7) == rows[66:165]).all()


def test_table_is_packed_and_written_few_times(spark, monkeypatch):
    """Without structure rows stay open: the table is not written again every few steps."""
    rows = np.random.default_rng(8).normal(size=(1500, 6))
    points = cut_lineage(spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "id bigint, vec array<double>").repartition(3))
    tables, steps = [], []
    written, taken = kmeans._bounded, kmeans.step
    monkeypatch.setattr(kmeans, "_bounded", lambda *a: tables.append(written(*a)) or tables[-1])
    monkeypatch.setattr(kmeans, "step", lambda *a: steps.append(1) or taken(*a))
    monkeypatch.setattr(kmeans, "REFRESH_SHARE", -1)
    first = kmeans.seeds(points, [5], ("id",))[5, "id"]
    centres, costs = kmeans.fit(points, [5], 30, ("id",))
    want, cost = plain(rows, first, 30)
    assert np.allclose(centres[5], want, atol=1e-9) and abs(costs[5] - cost) < 1e-6
    assert {t.schema["vec"].dataType.simpleString() for t, _ in tables} == {"binary"}
    assert len(steps) > 16 and len(tables) <= 4 and tables[0][0].count() < 1500 / 50
