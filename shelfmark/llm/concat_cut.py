"""Packing by concatenating all documents and cutting the stream into fixed windows.

1. One pass encodes every document, appends the end id and writes the ids next to where the document
   starts within its partition (a running sum of the task).
2. The token totals of the partitions are turned into global offsets by prefix sums in two levels:
   over blocks of partitions and inside a block. No ids move for that.
3. A document whose range of the stream crosses the edge of a window is cut there: each part is a record
   of its own, so every id is in exactly one piece and every window but the last is full.

The rest after the last full window is cut by its binary digits into windows of 2^k tokens, largest
first. A sequence that long needs no padding, so nothing is padded at all.

Words that stand between white space are encoded independently of each other by this vocabulary, so
each distinct word is encoded once as long as it stays in a worker's cache; ``tests/llm`` compares
with the encoding of whole texts.

Defined results: a null text is empty and leaves one end id; repeated rows, equal ids and rows without
an id are documents of their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut_lineage
from .common import large_text
from .tokens import vocabulary_file

DEFAULT_FILE = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
CACHED_BYTES = 80 << 20  # a bound on memory only: words that are dropped are encoded again
ENTRY_BYTES = 220  # what a cached word takes besides its characters
JOINED_WORDS = 256
PART_BYTES = 6 << 20
BLOCK = 1024  # partitions that one prefix sum runs over
ENCODED = "part bigint, local bigint, doc_id bigint, n_tokens bigint, ids binary"
PIECES = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


class WordEncoder:
    """Encodes batches of texts word by word; ids are little-endian unsigned 32-bit integers as bytes."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose token ends a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, words: list[str]) -> None:
        if self.held > CACHED_BYTES:
            self.cache.clear()
            self.held = 0
        new = [w for w in words if w not in self.cache]
        letters = [w for w in new if w.isalpha()]
        alone = [w for w in new if not w.isalpha()]
        # words of letters are encoded many at a time; the tokens that end a word tell them apart again
        groups = [letters[at:at + JOINED_WORDS] for at in range(0, len(letters), JOINED_WORDS)]
        joined = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, code in zip(groups, joined):
            ids = np.array(code.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(group):  # a letter that is none after its case is changed
                alone += group
                continue
            raw, ends = ids.tobytes(), [0, *ends.tolist()]
            self.cache.update(zip(group, [raw[a:b] for a, b in zip(ends, ends[1:])]))
        for at in range(0, len(alone), 4096):
            part = alone[at:at + 4096]
            codes = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.cache.update((w, np.array(c.ids, "<u4").tobytes()) for w, c in zip(part, codes))
        self.held += sum([ENTRY_BYTES + 2 * len(w) for w in new])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a column of texts; null is empty."""
        text = large_text(column)
        # case does not matter, save in the strings of special tokens
        text = pc.if_else(pc.match_substring(text, "<|"), text, pc.ascii_lower(text))
        # a full stop or comma behind a letter is a token of its own, with or without a space before it
        spread = pc.replace_substring_regex(pc.replace_substring(text, "\n", " "), r"(\pL)([.,])( |\z)", r"\1 \2\3")
        words = pc.split_pattern(spread, " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        known = coded.dictionary.to_pylist()
        self._learn(known)
        entries = [self.cache[w] for w in known]
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        start = np.concatenate([[0], np.cumsum(size)])
        store = np.frombuffer(b"".join(entries), "<u4")
        code = coded.indices.to_numpy(zero_copy_only=False)
        each = size[code]
        ends = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat(start[code] - ends[:-1], each)
        source += np.arange(len(source))
        return store[source], ends[bounds - bounds[0]]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded bytes, to bound memory."""
    if batch.nbytes > PART_BYTES and len(batch) > 1:
        half = len(batch) // 2
        yield from parts(batch.slice(0, half))
        yield from parts(batch.slice(half))
    elif len(batch):
        yield batch


def worker_encoder(file: str) -> WordEncoder:
    """One encoder for each Python worker and file: later tasks of the worker find its cache filled."""
    kept = sys.modules.setdefault("_shelfmark_words", types.ModuleType("_shelfmark_words"))
    encoders = kept.__dict__.setdefault("encoders", {})
    if file not in encoders:
        encoders[file] = WordEncoder(file)
    return encoders[file]


def encode(docs: DataFrame, file: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(part, local, doc_id, n_tokens, ids): the ids of each document and where it starts in its partition."""
    file = file or vocabulary_file(DEFAULT_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, local = worker_encoder(file), 0
        for batch in (part for whole in batches for part in parts(whole)):
            ids, offsets = encoder.encode(batch.column("text"))
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch),
                                                   [None, pa.py_buffer(4 * offsets.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), pa.array(local + offsets[:-1]), batch.column("doc_id"),
                 pa.array(np.diff(offsets)), raw.cast(pa.binary())], names=["part", "local", "doc_id", "n_tokens", "ids"])
            local += int(offsets[-1])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.spark_partition_id().cast("bigint").alias("part"))
    return source.mapInArrow(run, ENCODED)


def bases(encoded: DataFrame, block: int = BLOCK) -> DataFrame:
    """(part, base): tokens before each partition, by prefix sums inside blocks and over blocks."""
    totals = (encoded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
              .withColumn("block", F.floor(F.col("part") / block).cast("bigint")))

    def before(window) -> F.Column:
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    over = totals.groupBy("block").agg(F.sum("n").alias("n"))
    over = over.select("block", before(Window.partitionBy(F.lit(0)).orderBy("block")).alias("_over"))
    inside = totals.select("part", "block", before(Window.partitionBy("block").orderBy("part")).alias("_inside"))
    return inside.join(over, "block").select("part", (F.col("_over") + F.col("_inside")).cast("bigint").alias("base"))


def edges(total: int, capacity: int = CAPACITY) -> tuple[int, np.ndarray]:
    """Where the full windows end, and the starts of the windows behind them, each 2^k tokens long."""
    full = total // capacity * capacity
    rest, starts = total - full, [full]
    for k in reversed(range(rest.bit_length())):
        if rest >> k & 1:
            starts.append(starts[-1] + (1 << k))
    return full, np.array(starts, np.int64)


def cut(encoded: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of a stable table of encoded documents (``encode``, written once), with their places."""
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    full, rest = edges(total, capacity)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n_tokens").to_numpy()
            first = batch.column("base").to_numpy() + batch.column("local").to_numpy()

            def window(at: np.ndarray) -> np.ndarray:
                return np.where(at < full, at // capacity, full // capacity - 1 + np.searchsorted(rest, at, side="right"))

            def left(number: np.ndarray) -> np.ndarray:
                behind = np.clip(number - full // capacity, 0, len(rest) - 1)
                return np.where(number * capacity < full, number * capacity, rest[behind])

            low = window(first)
            count = window(first + size - 1) - low + 1
            doc = np.repeat(np.arange(len(size)), count)
            sequence = low[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(first[doc], left(sequence))
            end = np.minimum((first + size)[doc], left(sequence + 1))
            start = begin - first[doc]
            raw = [memoryview(v.as_buffer()) for v in batch.column("ids")]
            ids = [raw[d][4 * a:4 * b].tobytes() for d, a, b in zip(doc.tolist(), start.tolist(), (end - first[doc]).tolist())]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array(start), pa.array(end - begin), batch.column("n_tokens").take(rows),
                 pa.array(sequence), pa.array(begin - left(sequence)), pa.array(ids, pa.binary())],
                names=[c.split()[0] for c in PIECES.split(", ")])

    return encoded.join(bases(encoded), "part").mapInArrow(windows, PIECES)


def pack(docs: DataFrame, file: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    ``ids`` are little-endian unsigned 32-bit integers; sequences are numbered from 0 in the order of the stream.
    """
    return cut(cut_lineage(encode(docs, file, end_id)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, each of at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    hexed = F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(hexed).alias("ids"))
