import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import blocks
from shelfmark.functions.blocks import best_rows, spanning_links
from shelfmark.operators import clusters, neighbours, vectors
from shelfmark.runtime import cut_lineage


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id bigint, vec array<float>")


def brute_dbscan(ids, rows, eps, min_points):
    unit = rows / np.where((n := np.linalg.norm(rows, axis=1, keepdims=True)) > 0, n, 1)
    near = 1 - unit @ unit.T <= eps + 1e-12
    np.fill_diagonal(near, True)
    core = near.sum(axis=1) >= min_points
    label, number = {}, 0
    for start in np.argsort(ids):
        if not core[start] or start in label:
            continue
        stack = [start]
        label[start] = number
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(near[i]):
                if j not in label:
                    label[j] = number
                    if core[j]:
                        stack.append(j)
        number += 1
    return {int(ids[i]): f"cluster_{label[i]}" if i in label else "misc" for i in range(len(ids))}


def clumps(seed, n=160, dims=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    rows = centers[rng.integers(0, 6, n)] + rng.normal(scale=0.5, size=(n, dims))
    rows[n // 2: n // 2 + 30] = rows[0]      # a hot group of copies
    rows[5] = 0
    return rng.permutation(n * 3)[:n].astype(np.int64), rows.astype(np.float32)


@pytest.mark.parametrize("eps, min_points", [(0.02, 2), (0.01, 4), (0.1, 5)])
def test_dbscan_in_many_blocks(spark, eps, min_points):
    """Small blocks force many cells, visitors and block pairs."""
    ids, rows = clumps(int(eps * 1000))
    df = frame(spark, zip(ids.tolist(), rows.tolist()))
    assert neighbours.dbscan(df.selectExpr("id", "CAST(NULL AS array<float>) AS vec").limit(1)).first().cluster == "misc"
    got = {r.id: r.cluster for r in neighbours.dbscan(df, eps, min_points, block_rows=16).collect()}
    assert got == brute_dbscan(ids, rows.astype(np.float64), eps, min_points)
    assert len(set(got.values())) > 2


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(100, 140)] + [(300, 301), (301, 302), (302, 300)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.root for r in neighbours.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in [*range(100, 140), 200]}, 300: 300, 301: 300, 302: 300}


def test_spanning_links_join_the_same_parts():
    rng = np.random.default_rng(1)
    near = rng.random((30, 20)) < 0.06
    links = spanning_links(near)
    assert all(near[r, c] for r, c in links)

    def parts(pairs):
        group = {("r", i): i for i in range(30)} | {("c", i): 30 + i for i in range(20)}
        for r, c in pairs:
            a, b = group[("r", r)], group[("c", c)]
            group = {k: min(a, b) if v in (a, b) else v for k, v in group.items()}
        return group
    assert parts(links) == parts(zip(*np.nonzero(near)))
    assert len(links) == 50 - len(set(parts(links).values()))


def test_dbscan_blocks_grow_with_the_table(spark, monkeypatch):
    """A point is shipped to a fixed number of blocks where nothing can be pruned, as it came; strips change nothing."""
    monkeypatch.setattr(neighbours, "CELLS_AT_ONCE", 700)
    monkeypatch.setattr(blocks, "LEAST_ROWS", 8)
    copies = []
    for n in (150, 900):
        rng = np.random.default_rng(n)
        rows = rng.normal(size=(n, 6)).astype(np.float32)
        df = frame(spark, enumerate(rows.tolist()))
        got = {r.id: r.cluster for r in neighbours.dbscan(df, 0.08, 3).collect()}
        assert got == brute_dbscan(np.arange(n), rows.astype(np.float64), 0.08, 3) and len(set(got.values())) > 2
        points, pivots, block_rows = neighbours._with_pivots(neighbours._points(df), None)
        work = neighbours._work(points, pivots, neighbours._cells(points, pivots, block_rows), 0.7)
        assert work.schema["vec"].dataType.simpleString() == "array<float>"
        copies.append(work.count() / n)
    assert copies[1] < 1.5 * copies[0] and blocks.block_rows(10 ** 9, 64) * 64 * 8 <= blocks.BLOCK_BYTES


def test_forest_in_strips_joins_the_same_parts():
    rng = np.random.default_rng(2)
    near = rng.random((40, 25)) < 0.05
    forest, links = blocks.Forest(25), []
    for start in range(0, 40, 7):
        rows, cols = forest.add(near[start:start + 7])
        links += [(start + r, c) for r, c in zip(rows.tolist(), cols.tolist())]
    whole = spanning_links(near)
    assert all(near[r, c] for r, c in links) and len(links) == len(whole)
    both = np.zeros_like(near)
    both[tuple(np.array(links).T)] = True
    assert len(spanning_links(both)) == len(whole)


def brute_topk(ids, rows, k):
    scores = np.round(rows @ rows.T, 12)
    return {(int(ids[q]), r + 1): (int(ids[j]), scores[q, j]) for q in range(len(ids))
            for r, j in enumerate(sorted(range(len(ids)), key=lambda j: (-scores[q, j], ids[j]))[:k])}


@pytest.mark.parametrize("block_rows", [1000, 50, 7])
def test_topk_does_not_depend_on_the_blocks(spark, monkeypatch, block_rows):
    ids, rows = clumps(3)
    df = frame(spark, zip(ids.tolist(), rows.tolist())).repartition(3)
    monkeypatch.setattr(vectors, "CELLS_AT_ONCE", 500)
    found = vectors.topk_ip(df.select(F.col("id").alias("query_id"), "vec"), df, 4, block_rows=block_rows)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in found.collect()}
    want = brute_topk(ids, rows.astype(np.float64), 4)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_topk_by_distance_and_without_vectors(spark):
    ids, rows = clumps(8)
    df = frame(spark, zip(ids.tolist(), rows.tolist())).repartition(3)
    df = df.unionByName(spark.createDataFrame([(-1, None)], df.schema))
    found = vectors.topk_ip(df.select(F.col("id").alias("query_id"), "vec"), df, 3, block_rows=9, metric="l2")
    got = {(r.query_id, r["rank"]): r.id for r in found.collect()}
    wide = rows.astype(np.float64)
    scores = np.round(-((wide[:, None] - wide[None]) ** 2).sum(axis=2) / 2, 9)
    for q in range(len(ids)):
        best = sorted(range(len(ids)), key=lambda j: -scores[q, j])[2]
        assert scores[q, ids.tolist().index(got[int(ids[q]), 3])] >= scores[q, best] - 1e-9
    assert len(got) == 3 * len(ids)
    empty = df.limit(0)
    assert vectors.topk_ip(df.select(F.col("id").alias("query_id"), "vec"), empty, 3).count() == 0


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_search_visits_few_blocks(spark, metric):
    """Rows in tight clumps: a query reaches a small part of the blocks, and bounds hold for all of them."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(24, 16))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    rows = middle[rng.integers(0, 24, 2400)] + rng.normal(scale=0.01, size=(2400, 16))
    df = frame(spark, enumerate(rows.tolist())).repartition(4)
    search = vectors._Search(df.select(F.col("id").alias("query_id"), "vec"), df, 3, 20, metric)
    near = search.score(search.first())
    visits = search.others(near).count() / 2400
    assert search.n_blocks.sum() >= 120 and visits < 0.25 * search.n_blocks.sum()
    most = vectors.bounds(rows[:50], search.pivots, search.radius, metric)
    cell = {r.id: r.cell for r in search.base.select("id", "cell").collect()}
    score = rows[:50] @ rows.T
    if metric == "l2":
        score = -((rows[:50, None] - rows[None]) ** 2).sum(axis=2) / 2
    where = np.array([cell[i] for i in range(2400)])
    assert (score <= most[:, where] + 1e-4).all()


def test_search_blocks_grow_with_the_rows(spark, monkeypatch):
    """Without structure a query still visits a fixed number of blocks, and they report only what reaches its best so far."""
    monkeypatch.setattr(blocks, "LEAST_ROWS", 8)
    visits = []
    for n in (150, 900):
        rows = np.random.default_rng(n).normal(size=(n, 6)).astype(np.float32)
        df = frame(spark, enumerate(rows.tolist())).repartition(3)
        search = vectors._Search(df.select(F.col("id").alias("query_id"), "vec"), df, 3, None, "ip")
        near = cut_lineage(search.score(search.first()))
        others = cut_lineage(search.others(near))
        visits.append(others.count() / n)
        found = search.score(others).count() / n
        assert found < visits[-1]
    assert visits[1] < 1.5 * visits[0]


def test_best_rows_with_ties():
    row, col, value = best_rows(np.array([[1.0, 0], [1, 2], [1, 2], [0, 2], [0, 0], [0, 0], [0, 0], [0, 0], [0, 0]]), 2)
    assert list(zip(col, row, value)) == [(0, 0, 1), (0, 1, 1), (1, 1, 2), (1, 2, 2)]


def test_l2_normalize(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [])], "id bigint, vec array<double>")
    got = [r.vec for r in vectors.l2_normalize(df).orderBy("id").collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0], None, []]


def test_kmeans_step_and_labels(spark):
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(c, 0.05, (40, 3)) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1])])
    df = frame(spark, enumerate(rows.tolist()))
    labels = {r.id: r.cluster for r in clusters.kmeans_labels(df).collect()}
    assert [labels[i] for i in (0, 40, 80)] == ["cluster_0", "cluster_1", "cluster_2"]
    assert all(labels[i] == f"cluster_{i // 40}" for i in range(120))
    costs = [r.inertia for r in clusters.elbow_curve(df, max_k=5).orderBy("k").collect()]
    assert len(costs) == 4 and costs[0] > costs[1]
    means = vectors.kmeans_update(df.select((F.col("id") % 3).alias("cluster"), "vec"))
    got = {r.cluster: np.array(r.vec) for r in means.collect()}
    assert all(np.allclose(got[c], rows[c::3].mean(axis=0), atol=1e-6) for c in range(3))
    nearest = {r.id: (r.cluster, r.distance) for r in vectors.kmeans_assign(df, means).collect()}
    table = np.stack([got[c] for c in range(3)])
    for i, row in enumerate(rows):
        d = np.linalg.norm(table - row, axis=1)
        assert abs(nearest[i][1] - d.min()) < 1e-5


@pytest.mark.parametrize("points, want", [([], 2), ([5.0], 2), ([5.0, 1.0], 2), ([9.0, 3.0, 2.0], 3), ([9, 5, 1, 0.5, 0.4], 4), ([4, 3, 2, 1], 3)])
def test_elbow_pick(spark, points, want):
    costs = [(k, float(c)) for k, c in enumerate(points, 2)]
    assert clusters.pick_k(costs) == want
    if costs:
        assert [r.k for r in clusters.elbow_pick(spark.createDataFrame(costs, "k int, inertia double")).collect()] == [want]


def test_cluster_dispatch(spark):
    one = frame(spark, [(4, [1, 0])])
    assert [tuple(r) for r in clusters.cluster(one).collect()] == [(4, "cluster_0")]
    three = frame(spark, [(0, [1, 0]), (1, [1, 0.1]), (2, [0, 1])])
    got = {r.id: r.cluster for r in clusters.cluster(three, "dbscan").collect()}
    assert got == {0: "cluster_0", 1: "cluster_0", 2: "misc"}


def test_embed_text(spark):
    df = spark.createDataFrame([(0, "red red blue"), (1, "green"), (2, ""), (3, None)], "id bigint, text string")
    got = {r.id: np.array(r.vec) for r in vectors.embed_text(df, dims=64).collect()}
    assert abs(np.linalg.norm(got[0]) - 1) < 1e-9 and np.linalg.norm(got[2]) == 0
    own = {r.id: r.vec for r in vectors.embed_text(df.limit(2), lambda: lambda texts: [[3.0, 4.0] for _ in texts]).collect()}
    assert own == {0: [0.6, 0.8], 1: [0.6, 0.8]}
