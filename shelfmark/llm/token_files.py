"""Token ids as Arrow stream files of fixed-size lists.

The documents, in the order of their ids, form one sequence of token ids. Each Spark partition (a
range of ids) writes one file in the Arrow stream format. A row of it is one training sequence:
``ids`` (fixed-size list), ``mask`` (fixed-size list of booleans, false where the last sequence of a
file is filled up) and the documents that start in it (``doc_ids``, ``doc_starts`` counted within
the file, ``doc_tokens``). Sequences all have the same length, so the ids of a memory-mapped file
are one flat buffer per batch and any sequence is a slice of it, without a copy.

Defined results: a null text is empty and leaves only the end id; rows without a document id come
first; rows with equal ids stay next to each other in any order; an empty table gives no files;
other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..runtime import cut_lineage
from . import tokens
from .common import open_store

SEQUENCE_LENGTH = 2048
BATCH_SEQUENCES = 256
MANIFEST = "path string, part int, documents bigint, n_ids bigint, n_sequences bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


Store = Callable[[str], tuple[fs.FileSystem, str]]


def file_schema(length: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length)),
                      ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
                      ("doc_tokens", pa.list_(pa.int64()))])


class SequenceWriter:
    """Cuts a stream of documents into sequences; holds one batch of sequences at most."""

    def __init__(self, sink, length: int, id_type: pa.DataType):
        self.length, self.schema = length, file_schema(length, id_type)
        self.id_type = np.dtype(id_type.to_pandas_dtype())
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.rest, self.n_ids, self.n_documents, self.n_sequences = np.empty(0, self.id_type), 0, 0, 0
        self.index: list[tuple] = []  # (doc_id, start, tokens) of documents that start at or after the rest

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.index += zip(doc_ids, (offsets[:-1] + self.n_ids).tolist(), np.diff(offsets).tolist())
        self.n_ids += len(ids)
        self.n_documents += len(doc_ids)
        self.rest = np.concatenate([self.rest, ids.astype(self.id_type)])
        block = self.length * BATCH_SEQUENCES
        full = len(self.rest) // block * block
        for at in range(0, full, block):
            self._write(self.rest[at:at + block], block)
        self.rest = self.rest[full:].copy()

    def _write(self, ids: np.ndarray, used: int) -> None:
        rows = len(ids) // self.length
        base = self.n_sequences * self.length
        inside = 0
        while inside < len(self.index) and self.index[inside][1] < base + len(ids):
            inside += 1
        here, self.index = self.index[:inside], self.index[inside:]
        cuts = np.searchsorted([d[1] for d in here], base + self.length * np.arange(1, rows)) if rows > 1 else []
        offsets = pa.array([0, *cuts, inside], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array([d[k] for d in here], pa.int64())) for k in range(3)]
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < used), self.length)
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), mask, *lists], schema=self.schema))
        self.n_sequences += rows

    def close(self) -> None:
        used = len(self.rest)
        if used:
            filled = np.zeros(-(-used // self.length) * self.length, self.id_type)
            filled[:used] = self.rest
            self._write(filled, used)
        self.out.close()


def write(docs: DataFrame, folder: str, file: str | None = None, end_id: int = 2,
          length: int = SEQUENCE_LENGTH, partitions: int | None = None, store: Store = open_store) -> DataFrame:
    """Write (doc_id, text) rows below ``folder`` (shared storage); returns the manifest, a written table.

    ``store`` opens a place in a worker: it gives a file system of Arrow and the path in it.

    A file belongs to the result only if the manifest names it, so files of failed or repeated
    tasks do no harm.
    """
    spark = docs.sparkSession
    file = file or tokens.vocabulary_file()
    id_type = pa.uint16() if max(tokens.vocabulary_size(file), end_id + 1) <= 1 << 16 else pa.uint32()
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, writer = tokens.worker_encoder(file), None, None
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                part = batch.column("part")[0].as_py()
                files, base = store(folder)
                files.create_dir(base, recursive=True)
                path = f"{base.rstrip('/')}/ids-{part:06d}-{uuid.uuid4().hex}.arrows"
                sink = files.open_output_stream(path)
                writer = SequenceWriter(sink, length, id_type)
            ids, offsets = encoder.encode(batch.column("text"))
            ended = np.insert(ids, offsets[1:], end_id)
            writer.add(batch.column("doc_id").to_pylist(), ended, offsets + np.arange(len(offsets)))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({
                "path": [f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"], "part": pa.array([part], pa.int32()),
                "documents": [writer.n_documents], "n_ids": [writer.n_ids], "n_sequences": [writer.n_sequences]})

    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
               .withColumn("part", F.spark_partition_id()))
    return cut_lineage(ordered.mapInArrow(save, MANIFEST))


def read_sequences(path: str, store: Store = open_store) -> Iterator[pa.RecordBatch]:
    """The batches of one file; a local file is memory-mapped, so the batches are views of it."""
    files, place = store(path)
    if isinstance(files, fs.LocalFileSystem):
        source = pa.memory_map(place)
    else:
        source = files.open_input_file(place)
    with pa.ipc.open_stream(source) as stream:
        yield from stream


def read_documents(manifest: DataFrame, store: Store = open_store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before it: the files' own starts plus a running total
    over the manifest, which has one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path, base in zip(files.column("path").to_pylist(), files.column("base").to_pylist()):
                open_doc, crc, left = None, 0, 0  # a document may go on in the next batch
                at = 0
                for batch in read_sequences(path, store):
                    flat = batch.column("ids").flatten().to_numpy()
                    doc_ids = batch.column("doc_ids").flatten().to_pylist()
                    starts = batch.column("doc_starts").flatten().to_pylist()
                    sizes = batch.column("doc_tokens").flatten().to_pylist()
                    rows = []
                    todo = [(open_doc, 0, left)] if open_doc else []
                    todo += [((d, base + s, n), s - at, n) for d, s, n in zip(doc_ids, starts, sizes)]
                    for doc, low, n in todo:
                        crc = zlib.crc32(flat[low:low + n].astype("<u4").tobytes(), crc if doc is open_doc else 0)
                        open_doc, left = doc, low + n - len(flat)
                        if left <= 0:
                            rows.append((*doc, crc))
                            open_doc = None
                    at += len(flat)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shares = F.col("part")  # one file to a task
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return based.repartition(n, shares).mapInArrow(scan, DOCUMENTS)


def read_ids(spark: SparkSession, manifest: DataFrame, store: Store = open_store) -> DataFrame:
    """(path, row, ids, mask): every sequence as Spark rows."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path in files.column("path").to_pylist():
                row = 0
                for batch in read_sequences(path, store):
                    n = len(batch)
                    ids = batch.column("ids").cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n), pa.array(np.arange(row, row + n)), ids,
                         batch.column("mask").cast(pa.list_(pa.bool_()))], names=["path", "row", "ids", "mask"])
                    row += n

    return manifest.mapInArrow(scan, "path string, row bigint, ids array<int>, mask array<boolean>")
