"""SimHash near-duplicates with vantage-point trees.

Fingerprint: 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles, repeats included. Fingerprints link at ``distance`` or fewer differing bits.

Search. Over all 64 bits the distances of unrelated fingerprints pile up around 32 (deviation 4), so
a ball of radius 4 overlaps about two of three boundaries and a tree over them prunes little. The
bits are therefore cut into ``BANDS`` bands: fingerprints within distance 4 are within distance 1 in
at least one of three bands. Each band has a vantage-point tree of its own:

* a node splits its fingerprints by their distance d to a vantage point at a threshold t: inside
  (d <= t) and outside. By the triangle inequality two of them within radius r can only be apart if
  the outer one has d <= t + r, so just those outer ones also go inside, and every pair within r
  stays together in some shard, down to the leaves;
* the trees are fitted on a bounded sample (``SAMPLE`` distinct fingerprints) and route every row; a
  shard (leaf) goes on splitting in its task by vantage points of its own, and small rests are
  compared pair by pair over all 64 bits, so the result is exact;
* a shard with more rows than ``SHARD_ROWS`` is cut into blocks, and every two blocks meet once.

Only distinct fingerprints take part, so a group of exact copies is one row. A shard reports a
spanning forest of its links and never all pairs; connected components of those links are the groups.

Defined results: a null or empty text has fingerprint zero, which links like any other; a row without
an id takes part and gets the group's smallest id; a group without any id has a null one; repeated
rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.neighbours import components
from ..runtime import cut_lineage
from .common import raw_texts

SHINGLE = 4
DISTANCE = 4
BANDS = 3
SEED = 42
SAMPLE = 1 << 14
LEAF_ROWS = 4096  # wanted rows of a shard
SHARD_ROWS = 1 << 16  # a larger shard is cut into blocks
PAIRWISE = 192


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text as an unsigned number."""
    words = raw.lower().split()  # ASCII letters and ASCII white space only, as these are bytes
    if not words:
        return 0
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    width = min(shingle, len(words))
    first, last = starts[:len(words) - width + 1], ends[width - 1:]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), 1 << 16):
        cut = slice(at, at + (1 << 16))
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(first[cut].tolist(), last[cut].tolist())], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(first))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] = ("doc_id",)) -> DataFrame:
    """(``keep`` columns, fp): the fingerprint as a signed number with the same bits."""
    source = docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{k}`") for k in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(r, shingle) for r in raw_texts(batch.column("_text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))],
                                             names=[*batch.schema.names[1:], "fp"])

    return source.mapInArrow(run, f"{schema}, fp bigint")


def bands(n: int = BANDS) -> list[int]:
    """Bit masks that cut 64 bits into n parts."""
    edges = [64 * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _gaps(fps: np.ndarray, point: np.uint64, band: np.uint64) -> np.ndarray:
    return np.bitwise_count((fps ^ point) & band)


@dataclass
class Node:
    """A split: vantage point, threshold, inner and outer child; or a leaf with the number of its shard."""
    shard: int = -1
    point: np.uint64 = np.uint64(0)
    threshold: int = 0
    inner: Node | None = None
    outer: Node | None = None


def _split(fps: np.ndarray, band: np.uint64, radius: int) -> tuple[np.uint64, int] | None:
    """Vantage point and threshold that part the fingerprints best, or None where none parts them well."""
    best = None
    for point in fps[np.linspace(0, len(fps) - 1, 5).astype(int)]:
        count = np.bincount(_gaps(fps, point, band), minlength=65).cumsum()
        for t in range(64):
            inside, outside = count[min(t + radius, 64)], len(fps) - count[t]
            cost = int(inside) ** 2 + int(outside) ** 2  # pairs left to compare
            if outside and (best is None or cost < best[0]):
                best = (cost, point, t)
    if best is None or best[0] > 0.8 * len(fps) ** 2:
        return None
    return best[1], best[2]


def build(sample: np.ndarray, leaf: float, distance: int = DISTANCE, n_bands: int = BANDS) -> tuple[list[Node], int]:
    """One tree per band, and the number of shards; ``leaf``: rows of the sample to a shard."""
    radius, shards = distance // n_bands, 0

    def grow(fps: np.ndarray, band: np.uint64) -> Node:
        nonlocal shards
        split = _split(fps, band, radius) if len(fps) > max(leaf, 8) else None
        if split is None:
            shards += 1
            return Node(shard=shards - 1)
        gap = _gaps(fps, split[0], band)
        return Node(-1, *split, grow(fps[gap <= split[1] + radius], band), grow(fps[gap > split[1]], band))

    return [grow(sample, np.uint64(b)) for b in bands(n_bands)], shards


def route(fps: np.ndarray, trees: list[Node], distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(index, shard) of every shard that each fingerprint belongs to."""
    radius, index, shard = distance // len(trees), [], []
    for tree, band in zip(trees, bands(len(trees))):
        todo = [(tree, np.arange(len(fps)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node.shard >= 0:
                index.append(rows)
                shard.append(np.full(len(rows), node.shard, np.int32))
                continue
            gap = _gaps(fps[rows], node.point, np.uint64(band))
            todo.append((node.inner, rows[gap <= node.threshold + radius]))
            todo.append((node.outer, rows[gap > node.threshold]))
    return np.concatenate(index), np.concatenate(shard)


def _forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Links (row, row) that join what is within ``distance`` between or inside two small sets of rows."""
    rows = a if a is b else np.concatenate([a, b])
    near = np.bitwise_count(fps[rows][:, None] ^ fps[rows][None, :]) <= distance
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label[None, :], len(rows)).min(axis=1)
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(rows))
    return np.stack([rows[moved], rows[label[moved]]], axis=1)


def links(fps: np.ndarray, distance: int = DISTANCE, n_bands: int = BANDS) -> np.ndarray:
    """Pairs of rows that connect all fingerprints of one shard within ``distance``."""
    radius, out = distance // n_bands, [np.empty((0, 2), np.int64)]
    todo = [(np.arange(len(fps)), k) for k in range(n_bands)]
    while todo:
        rows, k = todo.pop()
        if len(rows) <= PAIRWISE:
            out.append(_forest(fps, rows, rows, distance))
            continue
        band = np.uint64(bands(n_bands)[k])
        split = _split(fps[rows], band, radius)
        if split is None:
            parts = [rows[i:i + PAIRWISE] for i in range(0, len(rows), PAIRWISE)]
            out += [_forest(fps, p, q, distance) for i, p in enumerate(parts) for q in parts[i:]]
            continue
        gap = _gaps(fps[rows], split[0], band)
        todo += [(rows[gap <= split[1] + radius], k), (rows[gap > split[1]], k)]
    return np.unique(np.concatenate(out), axis=0)


def near_links(distinct: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS,
               shard_rows: int = SHARD_ROWS, n_bands: int = BANDS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) within ``distance``."""
    n = distinct.count()
    first = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toArrow()["fp"].to_numpy().view(np.uint64)
    trees, shards = build(first, leaf_rows * len(first) / max(1, n), distance, n_bands)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            index, shard = route(fps.view(np.uint64), trees, distance)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[index])], names=["shard", "fp"])

    routed = cut_lineage(distinct.select("fp").mapInArrow(deal, "shard int, fp bigint"))
    # the number of shards is bounded by the sample
    rows = {r["shard"]: r["n"] for r in routed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    blocks = {s: -(-c // shard_rows) for s, c in rows.items() if c > shard_rows}

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, fp = batch.column("shard").to_numpy(), batch.column("fp").to_numpy()
            low, high, at = np.zeros(len(fp), np.int32), np.zeros(len(fp), np.int32), np.arange(len(fp))
            if blocks:
                many = np.array([blocks.get(s, 1) for s in shard.tolist()])
                own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
                at = np.repeat(at, many)
                other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                low, high = np.minimum(own[at], other).astype(np.int32), np.maximum(own[at], other).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(low), pa.array(high), pa.array(fp[at])],
                                             names=["shard", "low", "high", "fp"])

    def join(table: pa.Table) -> pa.Table:
        fps = np.sort(table["fp"].to_numpy())  # signed order, the order of the column
        found = links(fps.view(np.uint64), distance, n_bands)
        return pa.table({"a": fps[found[:, 0]], "b": fps[found[:, 1]]})

    return (routed.mapInArrow(pair, "shard int, low int, high int, fp bigint")
            .groupBy("shard", "low", "high").applyInArrow(join, "a bigint, b bigint").distinct())


def _roots(distinct: DataFrame, distance: int) -> DataFrame:
    """``distinct`` (fp and other columns) with ``root``: the same for all fingerprints of a group."""
    found = cut_lineage(near_links(distinct, distance))
    roots = components(found).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def group(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, keep: list[str] = ("doc_id",)) -> DataFrame:
    """(``keep`` columns with doc_id, fp, component_id): component_id is the smallest doc_id of the group."""
    fps = cut_lineage(fingerprints(docs, shingle, keep))
    rooted = _roots(cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least"))), distance)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp", "left")


def hex_fingerprint(fp) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, the one with the smallest id (rows without an id come last); its own columns.

    Rows are told apart by id and a hash of the text, so ids need not be unique: of unlike texts under
    one id each belongs to its own group. The texts are shuffled once, to meet the keys that stay.
    """
    # keys without nulls, so that the join and the removal of repeated rows share one partitioning
    keyed = docs.select(F.struct("*").alias("body"), F.col("doc_id"), F.col("text").cast("string").alias("text"),
                        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
                        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    fps = cut_lineage(fingerprints(keyed, shingle, ["doc_id", "key", "hash"]))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "hash"))
    rooted = _roots(cut_lineage(fps.groupBy("fp").agg(first.alias("first"))), distance)
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.key", "first.hash")
    kept = keyed.select("key", "hash", "body").join(stay, ["key", "hash"], "left_semi").dropDuplicates(["key", "hash"])
    return kept.select(*[F.col(f"body.`{c}`").alias(c) for c in docs.columns])
