"""Edit-aware token counts.

A document is cut into pre-token runs that a byte-level vocabulary encodes independently (a run
starts where white space follows a visible character). ``LEAF_RUNS`` runs form a leaf of a segment
tree whose nodes sum tokens and characters of their subtree. An edit finds the leaves it touches by
descending the character sums, re-encodes just those (and the run before and after, as the boundary
may move), replaces them and updates the sums above them. The count is the sum at the root.

Trees are stored as two arrays per document (characters and tokens of each leaf); the sums above are
rebuilt when the arrays are loaded.

Defined results: a null text is empty and counts 0; edits outside the text are moved to its end;
edits of one document are applied in the order of ``seq``; a null replacement is empty; documents
without edits keep their count; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens
from .common import parts_of, schema_with, texts, with_columns

LEAF_RUNS = 16
PART_BYTES = 2 << 20
_RUN = re.compile(r"\s*\S+|\s+\Z")


def runs(text: str) -> list[str]:
    """Runs of white space and what follows; each is encoded as if it stood alone."""
    return _RUN.findall(text)


class SegmentTree:
    """Leaves with characters and tokens; ``sums[1]`` is the root, children of i are 2i and 2i+1."""

    def __init__(self, chars: np.ndarray, counts: np.ndarray):
        self.size = 1
        while self.size < max(1, len(chars)):
            self.size *= 2
        self.n = len(chars)
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size:self.size + self.n, 0] = chars
        self.sums[self.size:self.size + self.n, 1] = counts
        level = self.size
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def count(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the position where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[node, 0])
            if position - start >= left and self.sums[node + 1, 0] > 0:
                start += left
                node += 1
        return node - self.size, start

    def replace(self, first: int, last: int, chars: list[int], counts: list[int]) -> None:
        """Leaves first..last get new contents; only the nodes above them change while the leaves fit."""
        if len(chars) == last - first + 1:
            for leaf, c, n in zip(range(first, last + 1), chars, counts):
                node = leaf + self.size
                change = np.array([c, n]) - self.sums[node]
                while node:
                    self.sums[node] += change
                    node //= 2
            return
        old = self.sums[self.size:self.size + self.n]
        new = np.array([chars, counts], np.int64).T.reshape(-1, 2)
        whole = np.concatenate([old[:first], new, old[last + 1:]])
        self.__init__(whole[:, 0], whole[:, 1])


class Counter:
    """Counts tokens of runs with the tokenizer; remembers how many were encoded."""

    def __init__(self, encoder: tokens.PieceEncoder):
        self.encoder, self.encoded = encoder, 0

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """(characters, tokens) of the leaves of a text."""
        parts = runs(text)
        self.encoded += len(parts)
        groups = ["".join(parts[i:i + LEAF_RUNS]) for i in range(0, len(parts), LEAF_RUNS)]
        if not groups:
            return [], []
        return list(map(len, groups)), list(map(self.encoder.count, groups))

    def edit(self, text: str, tree: SegmentTree, at: int, delete: int, insert: str) -> str:
        """Apply one edit to the text and its tree; returns the new text."""
        at = min(max(at, 0), len(text))
        end = min(at + max(delete, 0), len(text))
        new = text[:at] + insert + text[end:]
        if not tree.n or not tree.chars:
            chars, counts = self.leaves(new)
            tree.__init__(np.array(chars, np.int64), np.array(counts, np.int64))
            return new
        first, start = tree.leaf_at(max(at - 1, 0))
        last, last_start = tree.leaf_at(min(end, len(text) - 1))
        # boundary context: a leaf more on each side, as white space at the seam may join it
        if first:
            first, start = tree.leaf_at(start - 1)
        stop = last_start + int(tree.sums[tree.size + last, 0])
        if stop < len(text):
            last, last_start = tree.leaf_at(stop)
            stop = last_start + int(tree.sums[tree.size + last, 0])
        chars, counts = self.leaves(new[start:stop + len(new) - len(text)])
        tree.replace(first, last, chars, counts)
        return new


TREE = "n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>"


def _built(encoder: tokens.PieceEncoder, batch: pa.RecordBatch) -> pa.RecordBatch:
    groups, of = [], []
    for text in texts(batch.column("text")):
        parts = runs(text)
        own = ["".join(parts[i:i + LEAF_RUNS]) for i in range(0, len(parts), LEAF_RUNS)]
        groups += own
        of.append(len(own))
    _, offsets = encoder.encode(pa.array(groups, pa.large_string()))
    each = pa.array(np.diff(offsets), pa.int32())
    bounds = np.concatenate([[0], np.cumsum(of)]).astype(np.int32)
    return with_columns(
        batch, n_tokens=pa.array(offsets[bounds[1:]] - offsets[bounds[:-1]], pa.int64()),
        leaf_chars=pa.ListArray.from_arrays(pa.array(bounds), pa.array(list(map(len, groups)), pa.int32())),
        leaf_tokens=pa.ListArray.from_arrays(pa.array(bounds), each))


def _edited(counter: Counter, batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text, chars, counts, edits in zip(texts(batch.column("text")), *(
            batch.column(c) for c in ("leaf_chars", "leaf_tokens", "edits"))):
        tree = SegmentTree(*(np.array(c.as_py() or [], np.int64) for c in (chars, counts)))
        counter.encoded = 0
        for e in sorted(edits.as_py() or [], key=lambda e: (e["seq"] is None, e["seq"])):
            text = counter.edit(text, tree, e["at"] or 0, e["delete"] or 0, e["insert"] or "")
        kept = tree.sums[tree.size:tree.size + tree.n].astype(np.int32)
        out.append((text, tree.count, pa.array(kept[:, 0]), pa.array(kept[:, 1]), counter.encoded))
    columns = list(zip(*out)) or [()] * 5
    ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in columns[2]])]).astype(np.int32))
    leaves = [pa.ListArray.from_arrays(ends, pa.concat_arrays([pa.array([], pa.int32()), *c])) for c in columns[2:4]]
    return with_columns(batch, text=pa.array(columns[0], pa.string()), n_tokens=pa.array(columns[1], pa.int64()),
                        leaf_chars=leaves[0], leaf_tokens=leaves[1], n_encoded=pa.array(columns[4], pa.int64()))


def build(docs: DataFrame, file: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and the leaves of the tree."""
    file = file or tokens.vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.worker_encoder(file)
        for batch in parts_of(batches, PART_BYTES):
            yield _built(encoder, batch)

    return docs.mapInArrow(run, schema_with(docs, TREE))


def apply_edits(built: DataFrame, file: str | None = None) -> DataFrame:
    """``built`` rows (text, leaf_chars, leaf_tokens, edits) with edited text, leaves and count.

    ``edits``: array of (seq, at, delete, insert) in code points. Adds ``n_encoded``: runs encoded again.
    """
    file = file or tokens.vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokens.worker_encoder(file))
        for batch in parts_of(batches, PART_BYTES):
            yield _edited(counter, batch)

    return built.mapInArrow(run, schema_with(built, f"text string, {TREE}, n_encoded bigint"))


def count_edits(docs: DataFrame, file: str | None = None) -> DataFrame:
    """``docs`` with ``edits``: ``build`` and ``apply_edits`` in one pass, with ``n_before``: tokens before the edits."""
    file = file or tokens.vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.worker_encoder(file)
        counter = Counter(encoder)
        for batch in parts_of(batches, PART_BYTES):
            built = _built(encoder, batch)
            before = built.column("n_tokens")
            yield with_columns(_edited(counter, built), n_before=before)

    return docs.mapInArrow(run, schema_with(docs, f"text string, {TREE}, n_encoded bigint, n_before bigint"))


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with two ``edits`` a document, made from its own columns: a deletion and an insertion."""
    n = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    edit = lambda seq, at, delete, insert: F.struct(
        F.lit(seq).alias("seq"), at.cast("int").alias("at"), F.lit(delete).alias("delete"), insert.alias("insert"))
    return docs.withColumn("edits", F.array(
        edit(1, F.floor(n / 3), 12, F.lit("")),
        edit(2, F.floor(n / 2), 0, F.concat(F.lit(" "), F.coalesce(F.col("source"), F.lit("")), F.lit("! ")))))
