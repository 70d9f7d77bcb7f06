"""Density clustering (cosine DBSCAN), exact, without a list of all neighbouring pairs.

1. Equal vectors become one point with a weight, so a group of copies is one row.
2. Points go to the cell of their nearest pivot. A point visits another cell only if the triangle
   inequality leaves room for a neighbour there, so far-apart cells never meet.
3. Cells are cut into blocks; a pair of blocks is one bounded group of work. It reports numbers of
   neighbours, and then only a spanning forest of the links between core points. Blocks grow with the
   table up to what a task can hold, so until then a point is shipped to a fixed number of them. Vectors
   travel as they came and are scaled to length one where they are compared.
4. Connected components of those links are the clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from .. import constants as K
from ..functions import blocks
from ..runtime import cut_lineage
from .grouping import rank_all

CELLS_AT_ONCE = 1 << 22  # distances held in memory by a task at one time
SLACK = 1e-9  # distances are doubles: pruning must not cut at the last digit


def _unit(column) -> np.ndarray:
    """The vectors scaled to length one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return blocks.matrix(blocks.normalize_lists(column))


def _points(df: DataFrame) -> DataFrame:
    """(gid, weight, vec): one row per distinct vector; gid is the smallest id."""
    return df.groupBy("vec").agg(F.min("id").alias("gid"), F.count("*").alias("weight")).select("gid", "weight", "vec")


def _with_pivots(points: DataFrame, block_rows: int | None) -> tuple[DataFrame, np.ndarray, int]:
    """Add ``cell`` and the distance ``off`` to its pivot; the pivots; rows of a block."""
    counted = Observation()
    points = cut_lineage(points.observe(counted, F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")))
    n = counted.get["n"]
    block_rows = block_rows or blocks.block_rows(n, counted.get["dims"] or 1)
    wanted = max(1, min(n // block_rows, math.isqrt(n)))
    sample = points.orderBy(F.xxhash64("gid")).limit(wanted).select("vec").toArrow()
    pivots = _unit(sample["vec"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0:
                continue
            far = blocks.distances(_unit(batch.column("vec")), pivots)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                names=[*batch.schema.names, "cell", "off"])

    gid, vec = (points.schema[c].dataType.simpleString() for c in ("gid", "vec"))
    schema = f"gid {gid}, weight bigint, vec {vec}, cell int, off double"
    return cut_lineage(points.select("gid", "weight", "vec").mapInArrow(nearest, schema)), pivots, block_rows


def _cells(points: DataFrame, pivots: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Radius and number of blocks of each cell: one row per pivot reaches the driver."""
    cells = {r["cell"]: (r["radius"], r["n"]) for r in
             points.groupBy("cell").agg(F.max("off").alias("radius"), F.count("*").alias("n")).collect()}
    radius = np.array([cells.get(c, (-np.inf, 0))[0] for c in range(len(pivots))])
    return radius, np.array([-(-cells.get(c, (0, 0))[1] // block_rows) for c in range(len(pivots))])


def _work(points: DataFrame, pivots: np.ndarray, cells: tuple[np.ndarray, np.ndarray], eps: float) -> DataFrame:
    """Rows for the block pairs: (cell, rb, vc, vb, visitor, own, gid, weight, vec [, core])."""
    radius, n_blocks = cells
    # |x-y|^2 = 2 (1-cos) for unit vectors; a zero vector (distance 1 to all) is nearer than that
    reach = np.sqrt(2.0 * eps) + SLACK

    @F.arrow_udf("array<int>")
    def visited(vecs: pa.Array, own: pa.Array) -> pa.Array:
        far = blocks.distances(_unit(vecs), pivots)
        open_ = far <= radius[None, :] + reach
        # each pair of cells meets once: the lower one visits the higher one
        higher = np.arange(len(pivots))[None, :] >= own.to_numpy(zero_copy_only=False)[:, None]
        row, cell = np.nonzero(open_ & higher & (n_blocks > 0)[None, :])
        offsets = np.searchsorted(row, np.arange(len(vecs) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32)))

    counts = F.array(*[F.lit(int(b)) for b in n_blocks])

    def block(cell):
        return F.pmod(F.xxhash64("gid"), F.greatest(F.element_at(counts, cell + 1), F.lit(1)).cast("bigint")).cast("int")

    # inside a cell each pair of blocks meets once as well
    last = F.when(F.col("own"), F.col("vb")).otherwise(F.element_at(counts, F.col("to") + 1) - 1)

    rest = [c for c in points.columns if c not in ("cell", "off")]
    visitors = (points.withColumn("to", F.explode(visited("vec", "cell")))
                .withColumn("own", F.col("to") == F.col("cell"))
                .withColumn("vb", block(F.col("cell"))).withColumn("vc", F.col("cell"))
                .withColumn("rb", F.explode(F.sequence(F.lit(0), last)))
                .select(F.col("to").alias("cell"), "rb", "vc", "vb", F.lit(True).alias("visitor"), "own", *rest))
    # residents wait for the blocks of every cell that visits theirs
    arrivals = visitors.select("cell", "rb", "vc", "vb").distinct()
    residents = (points.withColumn("rb", block(F.col("cell")))
                 .join(arrivals, ["cell", "rb"])
                 .select("cell", "rb", "vc", "vb", F.lit(False).alias("visitor"), F.lit(True).alias("own"), *rest))
    return visitors.unionByName(residents)


@dataclass
class _Meeting:
    """Residents and visitors of one block pair."""
    residents: pa.Table
    visitors: pa.Table
    eps: float

    @classmethod
    def of(cls, table: pa.Table, eps: float) -> _Meeting:
        visiting = table["visitor"].to_numpy().astype(bool)
        return cls(table.filter(pa.array(~visiting)), table.filter(pa.array(visiting)), eps)

    def near(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Who is within eps of whom, residents x visitors, in strips of residents that fit in memory."""
        residents, visitors = self.residents, self.visitors
        if len(residents) == 0 or len(visitors) == 0:
            return
        rows, columns = _unit(residents["vec"]), _unit(visitors["vec"])
        r_ids, v_ids = residents["gid"].to_numpy(), visitors["gid"].to_numpy()
        own = visitors["own"][0].as_py() and visitors["rb"][0] == visitors["vb"][0]
        step = max(1, CELLS_AT_ONCE // len(columns))
        for start in range(0, len(rows), step):
            strip = slice(start, min(start + step, len(rows)))
            distance = rows[strip] @ columns.T
            np.subtract(1.0, distance, out=distance)
            near = distance <= self.eps + 1e-12
            if own:  # a block against itself: each pair counts once, and a point is not its own neighbour
                near &= v_ids[None, :] < r_ids[strip, None]
            yield strip, near

    def both(self, column: str) -> tuple[np.ndarray, np.ndarray]:
        return self.residents[column].to_numpy(), self.visitors[column].to_numpy()


_PAIR = ["cell", "rb", "vc", "vb"]


def _degrees(work: DataFrame, eps: float, id_type: str) -> DataFrame:
    def count(table: pa.Table) -> pa.Table:
        meeting = _Meeting.of(table, eps)
        r_weight, v_weight = (w.astype(float) for w in meeting.both("weight"))
        by_resident, by_visitor = np.zeros(len(r_weight)), np.zeros(len(v_weight))
        for strip, near in meeting.near():
            near = near.astype(float)  # whole numbers, far below 2^53
            by_resident[strip] = near @ v_weight
            by_visitor += r_weight[strip] @ near
        gid = pa.concat_arrays([side["gid"].combine_chunks() for side in (meeting.residents, meeting.visitors)])
        degree = np.concatenate([by_resident, by_visitor]).astype(np.int64)
        out = pa.table({"gid": gid, "degree": pa.array(degree)})
        return out.filter(pa.array(degree > 0))

    return (work.groupBy(*_PAIR).applyInArrow(count, f"gid {id_type}, degree bigint")
            .groupBy("gid").agg(F.sum("degree").alias("degree")))


def _links(work: DataFrame, eps: float, id_type: str) -> DataFrame:
    """(a, b, border): a spanning forest between core points, and each border point's core points."""
    def link(table: pa.Table) -> pa.Table:
        meeting = _Meeting.of(table, eps)
        r_core, v_core = (c.astype(bool) for c in meeting.both("core"))
        r_id, v_id = (side["gid"].combine_chunks() for side in (meeting.residents, meeting.visitors))
        v_cores = np.flatnonzero(v_core)
        forest = blocks.Forest(len(v_cores))
        a, b, border = [r_id.slice(0, 0)], [r_id.slice(0, 0)], [np.zeros(0, bool)]
        for strip, near in meeting.near():
            core = r_core[strip]
            cores = np.flatnonzero(core)
            r1, v1 = forest.add(near if core.all() and v_core.all() else near[np.ix_(cores, v_cores)])
            r2, v2 = np.nonzero(near & ~core[:, None] & v_core[None, :]) if not core.all() else (v1[:0], v1[:0])
            r3, v3 = np.nonzero(near & core[:, None] & ~v_core[None, :]) if not v_core.all() else (v1[:0], v1[:0])
            a += [r_id.take(pa.array(strip.start + cores[r1])), r_id.take(pa.array(strip.start + r2)), v_id.take(pa.array(v3))]
            b += [v_id.take(pa.array(v_cores[v1])), v_id.take(pa.array(v2)), r_id.take(pa.array(strip.start + r3))]
            border.append(np.arange(len(r1) + len(r2) + len(r3)) >= len(r1))
        return pa.table({"a": pa.concat_arrays(a), "b": pa.concat_arrays(b), "border": pa.array(np.concatenate(border))})

    return work.groupBy(*_PAIR).applyInArrow(link, f"a {id_type}, b {id_type}, border boolean")


def _above(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Follow the pointers of ``child`` one step further, along those of ``parent``."""
    step = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return child.join(step, "root").select("node", F.col("root").alias("passed"), F.col("above").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected part. ``links``: a, b.

    Every node points at a smaller one. A round shortens the pointers to the roots (by four steps a
    time), lifts the links to the roots, and hooks each root to its smallest neighbour. Smallest
    neighbours are folded before the shuffle, so a node with very many links is no hot spot.
    """
    pairs = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    edges = both.filter("x != y").distinct()
    parent = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("root"))
    while True:
        moved = 1
        while moved:
            seen = Observation()
            twice = _above(parent, parent).drop("passed")
            parent = cut_lineage(_above(twice, twice).observe(
                seen, F.count_if(F.col("passed") != F.col("root")).alias("moved"))).drop("passed")
            moved = seen.get["moved"]
        of = parent.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        lifted = (edges.join(of, "x").select(F.col("rx").alias("z"), F.col("y").alias("x"))
                  .join(of, "x").select(F.col("z").alias("x"), F.col("rx").alias("y")))
        left = Observation()
        edges = cut_lineage(lifted.filter("x != y").distinct().observe(left, F.count("*").alias("n")))
        if not left.get["n"]:
            return parent
        least = edges.groupBy("x").agg(F.min("y").alias("y")).filter("y < x")
        parent = (parent.join(least.select(F.col("x").alias("node"), "y"), "node", "left")
                  .select("node", F.coalesce("y", "root").alias("root")))


def dbscan(df: DataFrame, eps: float = K.DBSCAN_EPS, min_points: int = K.DBSCAN_MIN_POINTS,
           block_rows: int | None = None) -> DataFrame:
    """(id, cluster): ``cluster_<i>`` in the order of the smallest core point, or "misc" for noise.

    ``df``: id (unique), vec. Neighbours are within cosine distance ``eps``; a point counts itself.
    Rows without a vector are noise.
    """
    every, df = df, df.filter("vec is not null")
    id_type = df.schema["id"].dataType.simpleString()
    points, pivots, block_rows = _with_pivots(_points(df), block_rows)
    cells = _cells(points, pivots, block_rows)
    degree = _degrees(_work(points, pivots, cells, eps), eps, id_type)
    total = F.col("weight") + F.coalesce("degree", F.lit(0))
    cored = cut_lineage(points.join(degree, "gid", "left")
                        .withColumn("core", total >= min_points).drop("degree"))
    links = cut_lineage(_links(_work(cored, pivots, cells, eps), eps, id_type))
    roots = components(links.filter("not border"))
    # core points without a core neighbour are clusters of their own
    cores = (cored.filter("core").select("gid").join(roots.withColumnRenamed("node", "gid"), "gid", "left")
             .select("gid", F.coalesce("root", "gid").alias("root")))
    cores = cut_lineage(cores)
    numbers = rank_all(cores.filter("gid = root").select("root"), "root", out="number")
    numbered = cores.join(numbers, "root").select("gid", "number")
    borders = (links.filter("border").join(numbered.withColumnRenamed("gid", "b"), "b")
               .groupBy(F.col("a").alias("gid")).agg(F.min("number").alias("number")))
    labels = numbered.unionByName(borders)
    members = df.join(df.groupBy("vec").agg(F.min("id").alias("gid")), "vec").select("id", "gid")
    missing = every.filter("vec is null").select("id", F.lit(K.NOISE_LABEL).alias("cluster"))
    return (members.join(labels, "gid", "left")
            .select("id", F.coalesce(F.concat(F.lit("cluster_"), F.col("number").cast("string")),
                                     F.lit(K.NOISE_LABEL)).alias("cluster"))
            .unionByName(missing))
