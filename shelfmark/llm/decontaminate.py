"""Benchmark decontamination with suffix arrays of the training text.

Each Arrow batch of documents is one shard. Words become numbers of the benchmark's vocabulary; runs
of known words shorter than the shortest window can hold no match and are left out; over the rest a
suffix array is built (prefix doubling, whole order up to the longest benchmark item). Every suffix
of every benchmark item is binary-searched in it, which gives its longest verbatim match and the
range of suffixes that start with its window, so all places where the window occurs.

The benchmark is the stated query set. It is cut into blocks of bounded bytes. One block travels with the
task; the numbers and suffixes of several are written to the shared folder, and every worker goes
through them one after the other for each shard, so it holds one at a time. Documents are not shuffled.

A window is ``n`` consecutive words of an item; a shorter item is one window. Words are runs of ASCII
letters and digits and of all non-ASCII characters, ASCII letters in lower case.

Defined results: a null or empty text has no words and is clean; items without words match nothing;
repeated items count by distinct item id; an item without an id is left out; rows are never merged,
so repeated documents each get their own row.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import scratch_path
from .common import open_store, raw_texts, schema_with, text_column, with_columns

WINDOW = 13
SHARE = 20  # contaminated: at least one word in so many is hit
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 32 << 20

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD).split()


class Suffixes:
    """The suffixes of one block of benchmark items, as numbers of the block's own vocabulary."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        split = [(i, words(t)) for i, t in items if i is not None]
        split = [(i, w) for i, w in split if w]
        self.vocabulary: dict[bytes, int] = {}
        number = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for _, ws in split for w in ws]
        length = np.array([len(w) for _, w in split], np.int64)
        self.names = sorted({i for i, _ in split})
        name = {i: k for k, i in enumerate(self.names)}
        self.n = n
        self.words = np.array([*number, *[0] * n], np.int32)
        self.item = np.repeat(np.array([name[i] for i, _ in split], np.int64), length)
        ends = np.repeat(np.cumsum(length), length)
        self.left = ends - np.arange(len(ends))  # words up to the end of the item
        self.span = np.minimum(np.repeat(length, length), n)  # the length of the window at a suffix
        self.start = np.flatnonzero(self.left >= self.span)
        self.shortest = int(self.span.min()) if len(split) else n
        self.longest = int(length.max()) if len(split) else 0


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared over ``depth`` words at least (0 ends a run)."""
    rank = text.astype(np.int64)
    step, order = 1, np.argsort(rank, kind="stable")
    while step < depth:
        behind = np.zeros_like(rank)
        behind[:-step] = rank[step:]
        behind[rank == 0] = 0
        key = rank * (int(rank.max()) + 1) + behind if len(rank) else rank
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[key[order[0]] != 0], key[order[1:]] != key[order[:-1]]]))
        zero = rank == 0
        rank = np.empty_like(rank)
        rank[order] = new
        rank[zero] = 0
        step *= 2
    return order


def _known_runs(text: np.ndarray, shortest: int) -> np.ndarray:
    """Positions inside runs of known words (0: unknown) that are long enough for a window."""
    known = np.concatenate([[0], (text > 0).view(np.int8), [0]])
    edge = np.diff(known)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = last - first >= shortest
    first, size = first[keep], (last - first)[keep]
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) \
        if len(size) else np.empty(0, np.int64)


def _bound(text: np.ndarray, order: np.ndarray, bench: Suffixes, depth: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all suffixes at once: how many text suffixes come before each (or its prefix range)."""
    low, high = np.zeros(len(depth), np.int64), np.full(len(depth), len(order), np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        at = order[np.minimum(middle, len(order) - 1)]
        state = np.zeros(len(depth), np.int8)  # sign of (text suffix - benchmark suffix) over ``depth`` words
        open_ = np.flatnonzero(low < high)
        k = 0
        while len(open_):
            mine, other = text[np.minimum(at[open_] + k, len(text) - 1)], bench.words[bench.start[open_] + k]
            mine = np.where(at[open_] + k < len(text), mine, 0)
            state[open_] = np.sign(mine - other)
            k += 1
            open_ = open_[(mine == other) & (depth[open_] > k)]
        before = (state < 0) | (upper & (state == 0))
        going = low < high
        low = np.where(going & before, middle + 1, low)
        high = np.where(going & ~before, middle, high)
    return low


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, member) of many ranges."""
    size = high - low
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]


def match(raws: list[bytes], bench: Suffixes) -> list[tuple[int, list[tuple[int, int, object, int]]]]:
    """For each text: its number of words and its longest matches (start, words, item, start in the item)."""
    look, texts = bench.vocabulary.get, []
    for raw in raws:
        ws = words(raw)
        texts.append(np.fromiter((look(w, 0) for w in ws), np.int32, len(ws)))
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # a 0 stands behind each text
    whole = np.zeros(int((sizes + 1).sum()), np.int32)
    for at, text in zip(starts, texts):
        whole[at:at + len(text)] = text
    found: list[list] = [[] for _ in raws]
    place = _known_runs(whole, bench.shortest)
    if len(place) == 0 or len(bench.start) == 0:
        return list(zip(sizes.tolist(), found))
    # the runs, closed by a 0 each
    gap = np.flatnonzero(np.diff(place) != 1)
    place = np.insert(place, gap + 1, -1)
    place = np.append(place, -1)
    text = np.where(place >= 0, whole[place], 0)
    order = suffix_array(text, bench.longest)
    span = bench.span[bench.start]
    low, high = _bound(text, order, bench, span, False), _bound(text, order, bench, span, True)
    which, member = _expand(low, high)
    if not len(which):
        return list(zip(sizes.tolist(), found))
    at = place[order[member]]
    doc = np.searchsorted(starts, at, side="right") - 1
    suffix = bench.start[which]
    # windows that follow each other on one diagonal of a document and an item are one longest match
    base = np.cumsum(bench.left == 1) - (bench.left == 1)  # number of the item's own copy
    diagonal = suffix - at
    sort = np.lexsort((at, diagonal, base[suffix], doc))
    doc, at, suffix, diagonal = doc[sort], at[sort], suffix[sort], diagonal[sort]
    span = bench.span[suffix]
    new = np.ones(len(at), bool)
    new[1:] = ((doc[1:] != doc[:-1]) | (base[suffix[1:]] != base[suffix[:-1]]) | (diagonal[1:] != diagonal[:-1])
               | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    inside = np.arange(len(bench.item)) - (np.concatenate([[0], np.flatnonzero(bench.left == 1) + 1])[base])
    for d, s, n, i, w in zip(doc[first].tolist(), (at[first] - starts[doc[first]]).tolist(),
                             (at[last] - at[first] + span[last]).tolist(), bench.item[suffix[first]].tolist(),
                             inside[suffix[first]].tolist()):
        found[d].append((s, n, bench.names[i], w))
    return list(zip(sizes.tolist(), found))


def _suffixes(table: pa.Table, n: int) -> Suffixes:
    return Suffixes(list(zip(table["item_id"].to_pylist(), raw_texts(table["text"].combine_chunks()))), n)


def _blocks(benchmark: DataFrame, n: int, block_bytes: int) -> Callable[[], Iterator[Suffixes]]:
    """What goes through the blocks of the benchmark in a worker. The driver holds one block, or the names of files."""
    spark = benchmark.sparkSession
    items = (benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
             .filter("item_id is not null").distinct())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        only = _suffixes(items.toArrow(), n)
        return lambda: iter([only])
    folder = scratch_path(spark, "benchmark")

    def save(table: pa.Table) -> pa.Table:
        files, base = open_store(folder)
        files.create_dir(base, recursive=True)
        name = f"block-{uuid.uuid4().hex}"  # a repeated task writes another file, which nobody reads
        with files.open_output_stream(f"{base.rstrip('/')}/{name}") as out:
            out.write(pickle.dumps(vars(_suffixes(table, n))))
        return pa.table({"name": [name]})

    blocks = F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-2 * total // block_bytes)))
    names = sorted(r["name"] for r in items.groupBy(blocks.alias("block")).applyInArrow(save, "name string").collect())

    def each() -> Iterator[Suffixes]:
        files, base = open_store(folder)
        for name in names:
            with files.open_input_stream(f"{base.rstrip('/')}/{name}") as block:
                bench = Suffixes.__new__(Suffixes)
                vars(bench).update(pickle.loads(block.read()))
            yield bench

    return each


def find_matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words`` and ``matches``: array of (start, n_words, item_id, item_start), in words.

    Matches are the longest verbatim ones of a window or more, in any order.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    if kind not in ("string", "bigint"):
        kind, benchmark = "bigint", benchmark.withColumn("item_id", F.col("item_id").cast("bigint"))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()),
                                ("item_id", pa.string() if kind == "string" else pa.int64()), ("item_start", pa.int64())]))
    added = f"n_words bigint, matches array<struct<start:bigint,n_words:bigint,item_id:{kind},item_start:bigint>>"
    blocks = _blocks(benchmark, n, block_bytes)

    def against_all(shard: list[bytes]) -> list[tuple[int, list]]:
        found: list[tuple[int, list]] = []
        for bench in blocks():
            new = match(shard, bench)
            found = [(size, old + more) for (_, old), (size, more) in zip(found, new)] if found else new
        return found

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, found, shard = raw_texts(text_column(batch)), [], []
            held = 0
            for raw in raws:  # shards of bounded bytes, but for a single text beyond the bound
                if shard and held + len(raw) > SHARD_BYTES:
                    found += against_all(shard)
                    shard, held = [], 0
                shard.append(raw)
                held += len(raw)
            found += against_all(shard)
            rows = [[{"start": s, "n_words": k, "item_id": i, "item_start": w} for s, k, i, w in f] for _, f in found]
            yield with_columns(batch, n_words=pa.array([c for c, _ in found], pa.int64()), matches=pa.array(rows, arrow))

    return docs.mapInArrow(search, schema_with(docs, added))


def _covered(matches: Column) -> Column:
    """Number of words that lie in at least one of the matches."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(
        m["start"].alias("s"), (m["start"] + m["n_words"]).alias("e"))))
    done = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
                       lambda a, m: F.struct((a["n"] + F.greatest(m["e"] - F.greatest(m["s"], a["to"]), F.lit(0)))
                                             .cast("bigint").alias("n"),
                                             F.greatest(a["to"], m["e"]).alias("to")))
    return done["n"]


def judge(found: DataFrame, share: int = SHARE) -> DataFrame:
    """Add n_hit, n_items, items_sha256 and contaminated to the result of ``find_matches``."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return (found.withColumn("n_hit", _covered(F.col("matches")))
            .withColumn("_items", items)
            .withColumn("n_items", F.size("_items").cast("bigint"))
            .withColumn("items_sha256", F.sha2(F.array_join("_items", ","), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
            .drop("_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    packed = docs.select(F.struct("*").alias("_row"))
    return judge(find_matches(packed, benchmark, n), share).filter("not contaminated").select("_row.*")
