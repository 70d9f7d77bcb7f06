"""Packing documents into sequences of bounded length.

1. Documents become pieces: a document longer than a sequence is cut into full ones, the first piece
   takes the remainder. Nothing else is cut.
2. Only the number of pieces of each size reaches the driver (at most ``capacity`` numbers, whatever
   the input). ``plan`` packs sizes, not rows: pieces above a third of the capacity pair greedily,
   each with the largest partner that fits and at most two of them in a sequence; smaller ones then go,
   largest first, to the open sequence with the tightest gap. It handles equal sizes at a time.
3. Each piece gets its rank among the pieces of its size (local ranks within blocks of rows plus a
   running total over blocks, so a size that very many pieces share is spread), and the plan turns
   size and rank into sequence and offset.

Defined results: a null text is empty and leaves one end id; repeated rows and equal sizes are
pieces of their own; an empty table gives no pieces; rows with a null id are packed too.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut_lineage
from . import tokens
from .common import parts_of

CAPACITY = 2048
PART_BYTES = 4 << 20  # of a batch that are encoded at a time, to bound memory
PIECES = ("doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, block bigint, local bigint")


def pieces(docs: DataFrame, file: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32) and its local rank in a block of rows."""
    file = file or tokens.vocabulary_file()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = tokens.worker_encoder(file), 0
        for batch in parts_of(batches, PART_BYTES):
            ids, offsets = encoder.encode(batch.column("text"))
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            size = np.diff(offsets)
            count = -(-size // capacity)
            first = size - (count - 1) * capacity  # the first piece is the shorter one
            doc = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            raw = memoryview(ids.tobytes())
            low = 4 * (offsets[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), (low + 4 * length).tolist())]
            order = np.argsort(length, kind="stable")  # ranks among equal lengths of this block
            local = np.empty(len(doc), np.int64)
            local[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order])
            block = batch.column("part")[0].as_py() * (1 << 32) + number
            number += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                 pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), block)),
                 pa.array(local)], names=[c.split()[0] for c in PIECES.split(", ")])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.spark_partition_id().cast("bigint").alias("part"))
    return source.mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Placements (size, rank, count, each, sequence, offset) and the number of sequences.

    ``count`` pieces of ``size``, from ``rank`` on, go ``each`` to a sequence, from ``sequence`` on,
    at ``offset`` and behind one another. Sequences of equal content are handled together.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("a piece is longer than a sequence, or empty")
    used = dict.fromkeys(left, 0)
    out, gaps = [], {}  # gaps: free length -> [(first sequence, sequences)]
    sequences = 0

    def place(size: int, number: int, each: int, sequence: int, offset: int) -> None:
        out.append((size, used[size], number, each, sequence, offset))
        used[size] += number
        left[size] -= number

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            gaps.setdefault(gap, []).append((first, number))

    third = capacity // 3
    for size in sorted((s for s in left if s > third), reverse=True):
        while left[size]:
            partner = next((p for p in sorted((p for p in left if third < p <= capacity - size and left[p]),
                                              reverse=True)), None)
            if partner is None:
                number = left[size]
                place(size, number, 1, sequences, 0)
                leave(capacity - size, sequences, number)
            elif partner == size:
                number = left[size] // 2
                if number:
                    place(size, 2 * number, 2, sequences, 0)
                    leave(capacity - 2 * size, sequences, number)
                else:  # one of this size is left: it pairs with the next smaller size
                    other = next((p for p in sorted((p for p in left if third < p < size and left[p]), reverse=True)), None)
                    number = 1
                    place(size, 1, 1, sequences, 0)
                    if other:
                        place(other, 1, 1, sequences, size)
                    leave(capacity - size - (other or 0), sequences, 1)
            else:
                number = min(left[size], left[partner])
                place(size, number, 1, sequences, 0)
                place(partner, number, 1, sequences, size)
                leave(capacity - size - partner, sequences, number)
            sequences += number
    heap = sorted(gaps)
    for size in sorted((s for s in left if s <= third), reverse=True):
        while left[size]:
            at = bisect.bisect_left(heap, size)
            if at == len(heap):  # no gap is wide enough: new sequences, filled with this size
                each = capacity // size
                number, rest = divmod(left[size], each)
                groups = [(number, each)] * bool(number) + [(1, rest)] * bool(rest)
                for n, q in groups:
                    place(size, n * q, q, sequences, 0)
                    gap = capacity - q * size
                    if gap:
                        if gap not in gaps:
                            bisect.insort(heap, gap)
                        leave(gap, sequences, n)
                    sequences += n
                continue
            gap = heap[at]
            first, number = gaps[gap].pop()
            each = gap // size
            taken, rest = divmod(left[size], each)
            taken = min(taken, number)
            changed = []
            if taken:
                place(size, taken * each, each, first, capacity - gap)
                changed.append((gap - each * size, first, taken))
            elif rest:
                place(size, rest, rest, first, capacity - gap)
                changed.append((gap - rest * size, first, 1))
                taken = 1
            if number > taken:
                changed.append((gap, first + taken, number - taken))
            if not gaps[gap]:
                del gaps[gap]
                heap.pop(at)
            for width, start, n in changed:
                if width:
                    if width not in gaps:
                        bisect.insort(heap, width)
                    leave(width, start, n)
    table = np.array(out, np.int64).reshape(-1, 6)
    return table[np.lexsort((table[:, 1], table[:, 0]))], sequences


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a stable table of pieces (``pieces``, written once)."""
    sizes = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in  # at most ``capacity`` rows
              sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, _ = plan(counts, capacity)
    span = 1 << 40
    first = table[:, 0] * span + table[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(first, size * span + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 4] + nth // row[:, 3]
            offset = row[:, 5] + nth % row[:, 3] * size
            keep = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(size), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["block", "length"]).withColumn("rank", (F.col("base") + F.col("local")).cast("bigint"))
    return ranked.mapInArrow(look_up, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                      "sequence_id bigint, offset bigint")


def pack(docs: DataFrame, file: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document with its place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return assign(cut_lineage(pieces(docs, file, end_id, capacity)), capacity)
