"""Alignment of two tokenizers over a corpus, with inverted bitmaps of the linked pairs of ids.

Tokens of A and B cover the same bytes. Offsets where both end cut them into groups; a token of A and
one of B are linked where their bytes overlap.

1. Documents are numbered within chunks of 2^16. A task encodes them, writes one row per document
   (counts and digest of its groups) and inverts their links: per pair of ids a compressed bitmap of the
   documents that hold it, and bit planes of how often (``bitmaps``), in buckets of A ids.
2. Fragments of one bucket and chunk are OR-ed together; popcounts give the pair's documents and links in
   the chunk. Sums over chunks are the counts in the corpus, and the highest of each A id marks its best
   partners. A pair's chunks stay apart, so a pair that every document holds is spread as well.
3. The counts go back to the chunks, whose postings add them up per document.

Segments that begin with one space or line break between visible characters are encoded independently of
what stands before them; a worker keeps the ids of each. That needs a
vocabulary B without tokens across such a place, which is checked when it is loaded; otherwise whole texts are
encoded. A text with a segment whose tokens do not spell it is judged as a whole.

Defined results: null and empty texts, and texts that the tokens of A or B do not spell, have no tokens:
all counts are zero and the digest is ''; repeated rows are documents of their own; rows without an id
count like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut_lineage
from .bitmaps import SLOTS, Counted, runs
from .tokens import vocabulary_file

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
BUCKETS = 64
CACHED_BYTES = 96 << 20  # a bound on memory only: segments that are dropped are encoded again
ENTRY_BYTES = 200  # what a cached segment takes besides its characters and ids
JOINED_WORDS = 256
TEXT_CHARS = 4 << 20  # texts encoded at a time
HELD_LINKS = 3 << 20  # links collected before they are written as a fragment
SPACE = "▁"
SEGMENT = re.compile(r"(?:[ \n]?\S+|\s+\S*)(?:(?![ \n]\S)\s+\S*)*")
INDEXED = ("chunk bigint, slot int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "groups_sha256 string, bucket int, planes binary")


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Aligned:
    """What each of several segments adds to a document."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]  # each ends with a semicolon
    links: np.ndarray  # coded pairs of ids of all segments behind one another, repeats included


class Aligner:
    """Encodes texts with both vocabularies and links their tokens."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        self.b = SentencePieceProcessor(model_file=b_file)
        value = byte_values()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(value[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.cuts = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)
        # a line break is a token of its own, so what follows it is encoded as if nothing stood before
        self.lead = len(self.b.encode("\n"))
        self.a_size = np.array([len(b) for b in self.a_bytes])
        self.b_size = np.array([len(b) for b in self.b_bytes])
        self.spaced = np.array([b[:1] == b" " for b in self.a_bytes])
        # ids as they are printed inside a list, and at its end: A, then B
        self.names = [f"{i}{end}".encode() for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";"))
                      for end in (",", last) for i in range(n)]
        self.name_size = np.array([len(n) for n in self.names])
        self.width = -(-len(self.a_bytes) // BUCKETS)  # A ids of a bucket
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs as numbers, those of one bucket behind one another."""
        return (a % BUCKETS * self.width + a // BUCKETS) * len(self.b_bytes) + b

    def pair(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = code // len(self.b_bytes)
        return a % self.width * BUCKETS + a // self.width, code % len(self.b_bytes)

    def bucket(self, code: np.ndarray) -> np.ndarray:
        return code // (len(self.b_bytes) * self.width)

    def _a_ids(self, segments: list[str]) -> list[list[int]]:
        """Words are encoded many at a time; the tokens that start with a space tell them apart again."""
        out: list[list[int]] = [[]] * len(segments)
        words = [i for i, s in enumerate(segments) if s[0] == " " and s[1:].isalpha()]
        alone = sorted(set(range(len(segments))).difference(words))
        groups = [words[at:at + JOINED_WORDS] for at in range(0, len(words), JOINED_WORDS)]
        joined = self.a.encode_batch_fast(["".join([segments[i] for i in g]) for g in groups], add_special_tokens=False)
        for group, coded in zip(groups, joined):
            ids = coded.ids
            first = np.flatnonzero(self.spaced[np.array(ids)]).tolist()
            if len(first) != len(group) or first[0]:  # a token of another make
                alone += group
                continue
            for i, low, high in zip(group, first, [*first[1:], len(ids)]):
                out[i] = ids[low:high]
        for i, coded in zip(alone, self.a.encode_batch_fast([segments[i] for i in alone], add_special_tokens=False)):
            out[i] = coded.ids
        return out

    def values(self, segments: list[str]) -> list[bytes]:
        """Number of A ids, A ids and B ids of each segment as bytes; b'' where they do not spell it.

        A segment starts with a space, which B adds itself, or with anything else, encoded behind a line break.
        """
        a_ids = self._a_ids(segments)
        coded = self.b.encode([s[1:] if s[0] == " " else "\n" + s for s in segments], num_threads=1)
        b_ids = [c if s[0] == " " else c[self.lead:] for s, c in zip(segments, coded)]
        raw = [s.encode() for s in segments]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        bad: set[int] = set()
        counts, flat = [], []
        for ids, table, width in ((a_ids, self.a_bytes, self.a_size), (b_ids, self.b_bytes, self.b_size)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            tokens = list(chain.from_iterable(ids))
            counts.append(n)
            flat.append(np.array(tokens, np.int64))
            spelled = np.diff(np.concatenate([[0], np.cumsum(width[flat[-1]])])[np.concatenate([[0], np.cumsum(n)])])
            if (spelled != sizes).any() or b"".join([table[t] for t in tokens]) != b"".join(raw):
                bad.update(i for i, seg in enumerate(ids) if b"".join([table[t] for t in seg]) != raw[i])
        size = 1 + counts[0] + counts[1]
        start, out = np.cumsum(size) - size, np.empty(size.sum(), "<u4")
        out[start] = counts[0]
        for first, n, ids in ((start + 1, counts[0], flat[0]), (start + 1 + counts[0], counts[1], flat[1])):
            out[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        joined, cut = out.tobytes(), [*(4 * start).tolist(), 4 * len(out)]
        return [b"" if i in bad else joined[x:y] for i, (x, y) in enumerate(zip(cut, cut[1:]))]

    def learn(self, segments: set[str]) -> None:
        if self.held > CACHED_BYTES:
            self.cache.clear()
            self.held = 0
        new = list(segments.difference(self.cache))
        for at in range(0, len(new), 1 << 14):
            part = new[at:at + (1 << 14)]
            values = self.values(part)
            self.cache.update(zip(part, values))
            self.held += sum([ENTRY_BYTES + 2 * len(s) + len(v) for s, v in zip(part, values)])

    def align(self, values: list[bytes]) -> Aligned:
        """Groups and links of segments, all at once: their tokens stand behind one another in one row of bytes."""
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        store = np.frombuffer(b"".join(values), "<u4").astype(np.int64)
        start = np.cumsum(size) - size
        n_a = store[start]
        n_b = size - n_a - 1
        within = np.arange(len(store)) - np.repeat(start, size)
        in_b = within > np.repeat(n_a, size)
        a, b = store[~in_b & (within > 0)], store[in_b]
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        first = np.searchsorted(b_end, a_end - self.a_size[a], side="right")
        last = np.searchsorted(b_end, a_end, side="left")
        each = last - first + 1
        link = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
        links = self.code(np.repeat(a, each), b[link])
        # offsets where both end
        at = np.minimum(last, len(b) - 1)
        a_ends = b_end[at] == a_end
        b_ends = np.zeros(len(b), bool)
        b_ends[at[a_ends]] = True
        a_group, b_group = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
        order = np.argsort(np.concatenate([a_group, b_group]), kind="stable")
        n = len(self.a_bytes)
        name = np.concatenate([a + n * a_ends, 2 * n + b + len(self.b_bytes) * b_ends])[order]
        text = b"".join([self.names[i] for i in name.tolist()])
        token = np.cumsum(n_a + n_b)  # a segment ends where both end
        cut = np.concatenate([[0], np.cumsum(self.name_size[name])[token - 1]]).tolist()
        a_token = np.cumsum(n_a)
        return Aligned(n_a, n_b, np.diff(np.concatenate([[0], np.cumsum(a_ends)[a_token - 1]])),
                       np.diff(np.concatenate([[0], np.cumsum(each)[a_token - 1]])),
                       [text[x:y] for x, y in zip(cut, cut[1:])], links)

    def documents(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Per text (n_a, n_b, n_groups, n_links, digest); all links, and the text of each."""
        cut = [SEGMENT.findall(" " + t) if t and self.cuts else [" " + t] if t else [] for t in texts]
        self.learn(set().union(*cut))
        bad = {s for c in cut for s in c if not self.cache[s]} if not all(self.cache.values()) else ()
        if bad:  # texts with such a segment are judged as a whole
            whole = {i: " " + texts[i] for i, c in enumerate(cut) if not bad.isdisjoint(c)}
            judged = dict(zip(whole, self.values(list(whole.values()))))
            cut = [c if i not in whole else [whole[i]] if judged[i] else [] for i, c in enumerate(cut)]
            known = {whole[i]: v for i, v in judged.items()} | {s: self.cache[s] for i, c in enumerate(cut) if i not in whole for s in c}
        else:
            known = self.cache
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        code = np.array([number[s] for c in cut for s in c], np.int64)
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        if not number:
            return [(0, 0, 0, 0, "")] * len(texts), np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = self.align([known[s] for s in number])
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[code])])[ends]).tolist()
                for v in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        pick, listed = found.groups.__getitem__, code.tolist()
        digests = [hashlib.sha256(b"".join(map(pick, listed[x:y]))[:-1]).hexdigest() if y > x else ""
                   for x, y in zip(ends.tolist(), ends[1:].tolist())]
        each = found.n_links[code]
        at = np.repeat((np.cumsum(found.n_links) - found.n_links)[code] - (np.cumsum(each) - each), each)
        links = found.links[at + np.arange(len(at))]
        return list(zip(*sums, digests)), links, np.repeat(np.arange(len(texts)), sums[3])


def worker_aligner(a_file: str, b_file: str) -> Aligner:
    """One aligner for each Python worker: later tasks of the worker find its cache filled."""
    kept = sys.modules.setdefault("_shelfmark_aligners", types.ModuleType("_shelfmark_aligners"))
    known = kept.__dict__.setdefault("aligners", {})
    if (a_file, b_file) not in known:
        known[a_file, b_file] = Aligner(a_file, b_file)
    return known[a_file, b_file]


@dataclass
class Files:
    """The two vocabularies."""
    a: str = field(default_factory=lambda: vocabulary_file(A_FILE))
    b: str = field(default_factory=lambda: vocabulary_file(B_FILE))


def fragments(aligner: Aligner, entries: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, planes) of unsorted links as code << 16 | slot."""
    entries, times = runs(np.sort(entries))
    bucket = aligner.bucket(entries >> 16)
    held, first = np.unique(bucket, return_index=True)
    for b, low, high in zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(entries)]):
        yield b, Counted.of(entries[low:high], times[low:high]).to_bytes()


def index(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """Rows of documents (``bucket`` null) and fragments of the inverted links (``bucket`` set) of each chunk."""
    files = files or Files()
    kinds = pa.schema([("chunk", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
                       ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                       ("groups_sha256", pa.string()), ("bucket", pa.int32()), ("planes", pa.binary())])

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
                                           for f in kinds], schema=kinds)

    def flush(aligner: Aligner, chunk: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for bucket, planes in fragments(aligner, np.concatenate(held)):
            yield batch_of(1, chunk=[chunk], bucket=[bucket], planes=[planes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, held, size, chunk = worker_aligner(files.a, files.b), 0, [], 0, 0
        for batch in batches:
            at = 0
            while at < len(batch):
                # a part of bounded length that stays in one chunk
                texts, chars = [], 0
                room = min(len(batch) - at, SLOTS - number % SLOTS)
                while len(texts) < room and chars < TEXT_CHARS:
                    texts.append(batch.column("text")[at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                chunk = batch.column("part")[0].as_py() << 32 | number // SLOTS
                rows, links, doc = aligner.documents(texts)
                n_a, n_b, n_groups, n_links, digests = zip(*rows)
                slots = number % SLOTS + np.arange(len(texts))
                yield batch_of(len(texts), chunk=[chunk] * len(texts), slot=slots, doc_id=batch.column("doc_id").slice(at, len(texts)),
                               n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=digests)
                if len(links):
                    held.append(links << 16 | slots[doc])
                    size += len(links)
                number += len(texts)
                at += len(texts)
                if held and (size >= HELD_LINKS or number % SLOTS == 0):
                    yield from flush(aligner, chunk, held)
                    held, size = [], 0
        if held:
            yield from flush(aligner, chunk, held)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.spark_partition_id().cast("bigint").alias("part"))
    return source.mapInArrow(run, INDEXED)


def merged(indexed: DataFrame) -> DataFrame:
    """(chunk, bucket, planes, codes, docs, links): the planes of a chunk and the popcounts of its pairs."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = bucket = None
        parts = []
        for batch in batches:
            parts += [Counted.from_bytes(p.as_py()) for p in batch.column("planes")]
            chunk, bucket = batch.column("chunk")[0].as_py(), batch.column("bucket")[0].as_py()
        whole = Counted.merge(parts)
        codes, docs, links = whole.totals()
        lists = [pa.array([v], pa.list_(pa.int64())) for v in (codes, docs, links)]
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()),
                                          pa.array([whole.to_bytes()], pa.binary()), *lists],
                                         names=["chunk", "bucket", "planes", "codes", "docs", "links"])

    return (indexed.filter("bucket is not null").select("chunk", "bucket", "planes").groupBy("chunk", "bucket")
            .applyInArrow(merge, "chunk bigint, bucket int, planes binary, codes array<bigint>, docs array<bigint>, links array<bigint>"))


def pair_counts(planes: DataFrame, files: Files | None = None) -> DataFrame:
    """(code, a_id, b_id, n_docs, n_links, best): every linked pair of the corpus; ``planes`` as of ``merged``."""
    aligner = worker_aligner(*vars(files or Files()).values())
    size, width = len(aligner.b_bytes), aligner.width
    rows = planes.select(F.inline(F.arrays_zip("codes", "docs", "links")))
    counts = rows.groupBy(F.col("codes").alias("code")).agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"))
    shifted = F.floor(F.col("code") / size).cast("bigint")
    ids = counts.select("code", (shifted % width * BUCKETS + F.floor(shifted / width)).cast("bigint").alias("a_id"),
                        (F.col("code") % size).alias("b_id"), "n_docs", "n_links")
    highest = ids.groupBy("a_id").agg(F.max("n_docs").alias("_most"))
    return ids.join(highest, "a_id").select("code", "a_id", "b_id", "n_docs", "n_links",
                                            (F.col("n_docs") == F.col("_most")).alias("best"))


def score(indexed: DataFrame, planes: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    pairs = planes.select("chunk", "bucket", F.explode("codes").alias("code")).join(counts, "code")
    facts = pairs.groupBy("chunk", "bucket").agg(F.collect_list(F.struct("code", "n_docs", "best")).alias("facts"))
    together = (planes.select("chunk", "bucket", "planes").join(facts, ["chunk", "bucket"])
                .repartition("chunk").sortWithinPartitions("chunk"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            slots = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slots), at)), pa.array(slots.astype(np.int32)), pa.array(best[slots]), pa.array(total[slots])],
                names=["chunk", "slot", "n_best", "count_sum"])

        at = None
        for batch in batches:
            for row in range(len(batch)):
                chunk = batch.column("chunk")[row].as_py()
                if chunk != at:
                    if at is not None:
                        yield result()
                    at, seen = chunk, np.zeros(SLOTS, bool)
                    best, total = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
                known = batch.column("facts")[row].values
                code, n_docs = (known.field(f).to_numpy() for f in ("code", "n_docs"))
                top = known.field("best").to_numpy(zero_copy_only=False)
                order = np.argsort(code)
                entries, times = Counted.from_bytes(batch.column("planes")[row].as_py()).postings()
                which, slot = order[np.searchsorted(code[order], entries >> 16)], entries & 0xFFFF
                seen[slot] = True
                np.add.at(total, slot, times * n_docs[which])
                np.add.at(best, slot, times * top[which])
        if at is not None:
            yield result()

    scored = together.mapInArrow(sums, "chunk bigint, slot int, n_best bigint, count_sum bigint")
    documents = indexed.filter("bucket is null").drop("bucket", "planes")
    zero = F.lit(0).cast("bigint")
    return documents.join(scored, ["chunk", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, files: Files | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``score`` and the table of ``pair_counts``."""
    files = files or Files()
    indexed = cut_lineage(index(docs, files))
    planes = cut_lineage(merged(indexed))
    counts = cut_lineage(pair_counts(planes, files))
    return score(indexed, planes, counts), counts
