"""Vectors: normalisation, exact top-k search, one step of k-means."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K
from ..functions import blocks
from ..runtime import cut_lineage
from .enrich import score_batches

BLOCK_ROWS = 8192      # points of a side that meet in one block pair with centroids
CELLS_AT_ONCE = 1 << 22  # scores held in memory by a task at one time
PIVOTS = 1024  # what a task holds of the index; with more rows cells grow and are cut into blocks
SLACK = 1e-9  # distances are doubles: pruning must not cut at the last digit


def l2_normalize(df: DataFrame, vec: str = "vec", out: str | None = None) -> DataFrame:
    @F.arrow_udf("array<double>")
    def unit(column: pa.Array) -> pa.Array:
        return blocks.normalize_lists(column)

    return df.withColumn(out or vec, unit(F.col(vec)))


def embed_text(df: DataFrame, make_fn: Callable | None = None, text: str = "text", out: str = "vec",
               dims: int = 384, batch: int = K.MODEL_BATCH) -> DataFrame:
    """Add a unit vector per text: the user's model, or hashed TF-IDF as a stand-in for one."""
    if make_fn is not None:
        return l2_normalize(score_batches(df, make_fn, text, out, "array<double>", batch), out)
    words = df.withColumn("_words", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"),
                                             lambda w: w != ""))
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims).transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(counted.select("_tf")).transform(counted)
    scaled = Normalizer(inputCol="_idf", outputCol="_unit").transform(weighted)
    return scaled.withColumn(out, vector_to_array("_unit")).drop("_words", "_tf", "_idf", "_unit")


def _score_block(q: pa.Table, b: pa.Table, k: int, metric: str) -> pa.Table:
    """Top k of ``b`` for every row of ``q``, as far as they reach its ``least``; both are taken in pieces that fit in memory."""
    b = b.take(pc.sort_indices(b["id"]))
    rows, queries = blocks.matrix(b["vec"]), blocks.matrix(q["vec"])
    least = q["least"].combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
    side = max(1, int(CELLS_AT_ONCE ** 0.5))
    found = []
    for start in range(0, len(queries) if len(rows) else 0, side):
        part = slice(start, start + side)
        row, col, score = _best_of_part(rows, queries[part], least[part], k, metric, side)
        found.append((row, col + start, score))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    row, col, score = (np.concatenate(x) for x in zip(empty, *found))
    return pa.table({"query_id": q["query_id"].take(pa.array(col)), "id": b["id"].take(pa.array(row)), "score": pa.array(score)})


def _best_of_part(rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, metric: str,
                  step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of the k best rows of each query; once k are known, only better scores are looked at."""
    row, col, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bar = least.copy()
    half = (queries * queries).sum(axis=1) / 2
    for start in range(0, len(rows), step):
        piece = rows[start:start + step]
        scores = piece @ queries.T
        if metric == "l2":  # -distance^2 / 2
            scores -= half + (piece * piece).sum(axis=1, keepdims=True) / 2
        if np.isneginf(bar).any():
            r, c, value = blocks.best_rows(scores, k)
        else:
            r, c = np.nonzero(scores >= bar - SLACK)
            value = np.round(scores[r, c], blocks.SCORE_DIGITS)
        reached = value >= bar[c]
        row, col, score = (np.concatenate(x) for x in ((row, r[reached] + start), (col, c[reached]), (score, value[reached])))
        order = np.lexsort((row, -score, col))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(col)) - np.searchsorted(col, col)
        kept = place < k
        row, col, score, place = row[kept], col[kept], score[kept], place[kept]
        bar[col[place == k - 1]] = score[place == k - 1]
    return row, col, score


def _placed(df: DataFrame, key: str, pivots: np.ndarray) -> DataFrame:
    """(key, vec, cell, off): the nearest pivot of each row and the distance to it."""
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0:
                continue
            far = blocks.distances(blocks.matrix(batch.column("vec")), pivots)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                names=[*batch.schema.names, "cell", "off"])

    kind, vec = (df.schema[c].dataType.simpleString() for c in (key, "vec"))
    return cut_lineage(df.select(key, "vec").mapInArrow(nearest, f"`{key}` {kind}, vec {vec}, cell int, off double"))


def _sizes(placed: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and radius of each cell; one row per pivot reaches the driver."""
    count, radius = np.zeros(n, np.int64), np.full(n, -np.inf)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect():
        count[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    return count, radius


def bounds(rows: np.ndarray, pivots: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """What a row can score at most in each cell: its members are within the radius of the pivot."""
    if metric == "l2":
        gap = np.maximum(blocks.distances(rows, pivots) - radius[None, :] - SLACK, 0)
        return -(gap * gap) / 2
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows @ pivots.T + norms * (radius[None, :] + SLACK)


class _Search:
    """Both sides in cells around the same pivots; a cell is cut into blocks of bounded rows."""

    def __init__(self, queries: DataFrame, base: DataFrame, k: int, block_rows: int | None, metric: str):
        self.k, self.metric = k, metric
        n, dims = base.agg(F.count("*"), F.max(F.size("vec"))).first()
        block_rows = block_rows or blocks.block_rows(n, dims or 1)
        wanted = max(1, min(PIVOTS, n // block_rows))
        sample = base.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").toArrow()
        self.pivots = blocks.matrix(sample["vec"])
        self.schema = (f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
                       f"id {base.schema['id'].dataType.simpleString()}, score double")
        if not len(self.pivots):
            return
        placed, asked = _placed(base, "id", self.pivots), _placed(queries, "query_id", self.pivots)
        self.rows, self.radius = _sizes(placed, len(self.pivots))
        asking, _ = _sizes(asked, len(self.pivots))
        self.n_blocks = -(-self.rows // block_rows)
        self.base = placed.withColumn("block", self._block("id", self.n_blocks))
        self.queries = asked.withColumn("part", self._block("query_id", -(-asking // block_rows)))

    @staticmethod
    def _block(key: str, n_blocks: np.ndarray):
        counts = F.array(*[F.lit(int(max(1, n))) for n in n_blocks])
        return F.pmod(F.xxhash64(key), F.element_at(counts, F.col("cell") + 1).cast("bigint")).cast("int")

    def first(self) -> DataFrame:
        """Every query visits one block of its own cell, if that holds enough rows to be of use."""
        large = F.array(*[F.lit(bool(n >= self.k * max(1, b))) for n, b in zip(self.rows, self.n_blocks)])
        return (self.queries.filter(F.element_at(large, F.col("cell") + 1))
                .select("query_id", "vec", F.col("cell").alias("home"), "part", "cell", F.lit(0).alias("block"),
                        F.lit(None).cast("double").alias("least")))

    def others(self, scored: DataFrame | None) -> DataFrame:
        """The other blocks in which a query can score as much as its k-th match so far."""
        asked = self.queries
        if scored is None:
            asked = asked.withColumn("least", F.lit(None).cast("double"))
        else:
            least = scored.groupBy("query_id").agg(F.min("score").alias("_least"), F.count("*").alias("_n"))
            asked = asked.join(least, "query_id", "left").withColumn("least", F.when(F.col("_n") >= self.k, F.col("_least")))
            asked = asked.withColumn("seen", F.col("_n").isNotNull())
        pivots, radius, metric, full = self.pivots, self.radius, self.metric, self.rows > 0

        @F.arrow_udf("array<int>")
        def reach(vecs: pa.Array, least: pa.Array) -> pa.Array:
            floor = least.fill_null(-np.inf).to_numpy(zero_copy_only=False)
            most = bounds(blocks.matrix(vecs), pivots, radius, metric)
            row, cell = np.nonzero((most + SLACK >= floor[:, None]) & full[None, :])
            offsets = np.searchsorted(row, np.arange(len(vecs) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32)))

        last = F.element_at(F.array(*[F.lit(int(max(0, n - 1))) for n in self.n_blocks]), F.col("to") + 1)
        seen = F.col("seen") if scored is not None else F.lit(False)
        return (asked.withColumn("to", F.explode(reach("vec", "least")))
                .withColumn("block", F.explode(F.sequence(F.lit(0), last)))
                .filter(~(seen & (F.col("to") == F.col("cell")) & (F.col("block") == 0)))
                .select("query_id", "vec", F.col("cell").alias("home"), "part", F.col("to").alias("cell"), "block", "least"))

    def score(self, visits: DataFrame) -> DataFrame:
        """The k best rows of the visited blocks; blocks wait for the parts of queries that visit them."""
        place = ["cell", "block", "home", "part"]
        arrivals = visits.select(*[F.col(c).alias(f"_{c}") for c in place]).distinct()
        waiting = (self.base.join(arrivals, (F.col("cell") == F.col("_cell")) & (F.col("block") == F.col("_block")))
                   .select("id", F.col("vec").alias("vec"), *[f"_{c}" for c in place]))
        k, metric = self.k, self.metric

        def one_block(q: pa.Table, b: pa.Table) -> pa.Table:
            return _score_block(q, b, k, metric)

        return (visits.groupBy(*place).cogroup(waiting.groupBy(*[f"_{c}" for c in place]))
                .applyInArrow(one_block, self.schema))


def topk_ip(queries: DataFrame, base: DataFrame, k: int = K.SEARCH_K,
            block_rows: int | None = None, metric: str = "ip") -> DataFrame:
    """Exact k best matches: (query_id, id, score, rank); ties by id.

    The score is the inner product ("ip") or minus half the squared Euclidean distance ("l2").

    ``queries``: query_id (unique), vec. ``base``: id, vec; rows without a vector take no part. Both sides are
    dealt to the cells of the same pivots. A first pass scores each query in one block of its own cell, which
    bounds its k-th match from below; a second pass visits only the cells that pivot, radius and norm
    allow to reach that. A query's part and a block are one bounded group, and no pairs leave it. Blocks grow with
    ``base`` up to what a task can hold, so until then a row is shipped to a fixed number of them.
    """
    search = _Search(queries.select("query_id", "vec").filter("vec is not null"),
                     base.select("id", "vec").filter("vec is not null"), k, block_rows, metric)
    if not len(search.pivots):
        found = queries.sparkSession.createDataFrame([], search.schema)
    elif len(search.pivots) == 1 and search.n_blocks[0] == 1:  # one block holds all
        found = search.score(search.others(None))
    else:
        near = cut_lineage(search.score(search.first()))
        found = near.unionByName(search.score(cut_lineage(search.others(near))))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by_score).cast("bigint")).filter(F.col("rank") <= k)


def kmeans_assign(df: DataFrame, centroids: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, cluster, distance): nearest centroid by Euclidean distance, ties to the smaller number.

    ``df``: id, vec. ``centroids``: cluster, vec.
    """
    best = topk_ip(df.select(F.col("id").alias("query_id"), "vec"),
                   centroids.select(F.col("cluster").alias("id"), "vec"), 1, block_rows, "l2")
    return best.select(F.col("query_id").alias("id"), F.col("id").alias("cluster"),
                       F.sqrt(F.greatest(F.col("score") * -2, F.lit(0.0))).alias("distance"))


def kmeans_update(assigned: DataFrame) -> DataFrame:
    """(cluster, vec) -> mean vector per cluster. Batches are summed before anything moves."""
    cluster_type = assigned.schema["cluster"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0:
                continue
            codes = batch.column("cluster").dictionary_encode()
            rows = blocks.matrix(batch.column("vec"))
            index = codes.indices.to_numpy(zero_copy_only=False)
            total = np.zeros((len(codes.dictionary), rows.shape[1]))
            np.add.at(total, index, rows)
            n = np.bincount(index, minlength=len(total))
            yield pa.RecordBatch.from_pydict({
                "cluster": codes.dictionary.take(pa.array(np.repeat(np.arange(len(total)), rows.shape[1]))),
                "pos": pa.array(np.tile(np.arange(rows.shape[1], dtype=np.int32), len(total))),
                "total": pa.array(total.ravel()),
                "n": pa.array(np.repeat(n, rows.shape[1]))})

    partial = assigned.select("cluster", "vec").mapInArrow(
        sums, f"cluster {cluster_type}, pos int, total double, n bigint")
    means = partial.groupBy("cluster", "pos").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return means.groupBy("cluster").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("vec"))
