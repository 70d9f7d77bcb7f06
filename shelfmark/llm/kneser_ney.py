"""Interpolated modified Kneser-Ney bigram model, counted and looked up in Spark.

Tokens are lower-cased (ASCII) words and one end per document; the first word's context is a start
mark. The model is two tables of sorted hash arrays, one row per shard: bigram hashes with their
counts, and word hashes with count, number of distinct left neighbours, and the totals of the word as
a context. A shard is memory-mapped from a temporary file by the worker that looks up in it.

1. ``index`` writes the corpus once as batches of token numbers with a vocabulary of hashes each.
2. ``fit`` folds each batch to its distinct bigrams, deals them to shards by the hash of the bigram
   (so a word that makes up a third of all text is spread over all shards) and merges them; words and
   contexts are merged by the hash of the word.
3. ``score`` sends each batch's distinct hashes to the shards and gets arrays of counts back, so
   neither the model nor the texts have to fit anywhere as a whole.

The number of shards grows with the bytes of text. Words have hashes of 56 bits; bigrams have 20 bits
more than it takes to number the bytes of the indexed corpus.
Nothing is pruned or capped: every n-gram of every training document is counted.

Defined results: a null or empty text is one end token; a document without an id is training text;
repeated rows count as often as they occur; with no training text every word has the same
probability 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut_lineage, scratch_path
from .common import large_text, release, remove

BATCH_BYTES = 12 << 20
SHARD_BYTES = 24 << 20
FOLDS, HELD_OUT = 5, 1
SPARE_BITS = 20
BITS = np.uint64(8)  # hashes keep 64 - 8 bits
END, START = 1, 2  # hashes of the marks; no word is given one of them on purpose


# --- arrays as bytes ------------------------------------------------------------------------------

def _planes(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unplanes(raw: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return _planes(np.diff(a, prepend=np.uint64(0)).astype("<u8"))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, "<u8"), dtype=np.uint64)


def pack(a: np.ndarray, dtype: str = "<u4") -> bytes:
    return _planes(a.astype(dtype))


unpack = _unplanes


def mix(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """Hash of a bigram."""
    h = v * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h >> np.uint64(64 - bits)


def _cuts(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    if len(shard):
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(shard)]):
            yield int(shard[a]), slice(a, b)


# --- the indexed corpus ---------------------------------------------------------------------------

INDEX = ("batch bigint, doc_ids array<bigint>, held_out array<boolean>, sizes binary, words binary, tokens binary")


def number(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text's end included, tokens, sorted hashes): tokens are places in the hashes."""
    text = large_text(column)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds -= bounds[0]
    filled = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(filled)])[bounds]
    coded = values.filter(pa.array(filled)).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64) >> BITS
    kept, place = np.unique(np.append(hashes, np.uint64(END)), return_inverse=True)
    codes = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    return np.diff(before) + 1, np.insert(codes, before[1:], place[-1]), kept


def index(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The documents as numbered batches, written once."""
    remainder = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(FOLDS))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.coalesce(remainder == HELD_OUT, F.lit(False)).alias("held_out"),
                         F.spark_partition_id().cast("bigint").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(batch):  # documents of bounded bytes together, one at least
                end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), batch_bytes, side="right")))
                part = batch.slice(at, end - at)
                sizes, tokens, words = number(part.column("text"))
                rows = {"batch": [part.column("part")[0].as_py() * (1 << 32) + count],
                        "doc_ids": [part.column("doc_id").to_pylist()], "held_out": [part.column("held_out").to_pylist()],
                        "sizes": [pack(sizes)], "words": [pack_sorted(words)], "tokens": [pack(tokens)]}
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))
                count, at = count + 1, end

    return cut_lineage(source.mapInArrow(run, INDEX))


class Batch:
    """One batch in memory."""

    def __init__(self, sizes: bytes, words: bytes, tokens: bytes):
        self.sizes, self.tokens = unpack(sizes, "<u4").astype(np.int64), unpack(tokens, "<u4").astype(np.int64)
        self.words = unpack_sorted(words)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def pairs(self) -> np.ndarray:
        """(context, word) of each token as one number; the start mark is the number after the last word."""
        before = np.concatenate([[0], self.tokens[:-1]])
        before[self.starts] = len(self.words)
        return before * (len(self.words) + 1) + self.tokens

    def hashes(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.append(self.words, np.uint64(START))
        return words[pairs // len(words)], words[pairs % len(words)]


# --- fitting --------------------------------------------------------------------------------------

CHUNK = "kind string, shard int, keys binary, a binary, b binary, c binary, d binary, e binary, stats array<bigint>"
_CHUNK_TYPES = [pa.string(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64())]
_CHUNK_NAMES = [c.split()[0] for c in CHUNK.split(", ")]


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*r, *[None] * (len(_CHUNK_NAMES) - len(r))) if len(r) < len(_CHUNK_NAMES) else r for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*full), _CHUNK_TYPES)], names=_CHUNK_NAMES)


def _by_word(kind: str, words: np.ndarray, shards: int, *values: np.ndarray) -> list[tuple]:
    """Chunks of a sorted array of words and values, by the shard of the word."""
    shard = (words % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return [(kind, s, pack_sorted(words[order[cut]]), *[pack(v[order[cut]]) for v in values])
            for s, cut in _cuts(shard[order])]


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v[order] for v in values)


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _merge_pairs(table: pa.Table, shards: int, bits: int) -> list[tuple]:
    v, w, n = [], [], []
    for keys, a, b, c in zip(*(table[x].to_pylist() for x in ("keys", "a", "b", "c"))):
        words = unpack_sorted(keys)
        v.append(words[np.cumsum(unpack(a, "<u4"), dtype=np.int64)])
        w.append(words[unpack(b, "<u4")])
        n.append(unpack(c, "<u4").astype(np.int64))
    v, w, n = map(np.concatenate, (v, w, n))
    order = np.lexsort((w, v))
    v, w, n = v[order], w[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
    v, w, n = v[first], w[first], np.add.reduceat(n, first)
    one = np.ones(len(n), np.int64)
    contexts = _sum_by(v, n, (n == 1) * one, (n == 2) * one, (n > 2) * one)
    keys = mix(v, w, bits)
    order = np.argsort(keys)
    shard = int(table["shard"][0].as_py())
    return [("bigrams", shard, pack_sorted(keys[order]), pack(n[order]), *[None] * 4, [len(n), *_of_counts(n)]),
            *_by_word("context", contexts[0], shards, *contexts[1:]), *_by_word("left", *_sum_by(w, one)[:1], shards, _sum_by(w, one)[1])]


def _merge_words(table: pa.Table) -> list[tuple]:
    """Columns of a word: count, distinct left neighbours; as a context: total and words seen once, twice, more."""
    keys, values = [], []
    for kind, k, *columns in zip(*(table[x].to_pylist() for x in ("kind", "keys", "a", "b", "c", "d"))):
        words = unpack_sorted(k)
        row = np.zeros((6, len(words)), np.int64)
        at = {"count": 0, "left": 1, "context": 2}[kind]
        for j, column in enumerate(columns):
            if column is not None:
                row[at + j] = unpack(column, "<u4")
        keys.append(words)
        values.append(row)
    words, *sums = _sum_by(np.concatenate(keys), *np.concatenate(values, axis=1))
    count, left = sums[:2]
    stats = [int(count.sum()), int((count > 0).sum()), int(left.sum()), *_of_counts(left), int((left > 2).sum())]
    return [("words", int(table["shard"][0].as_py()), pack_sorted(words),
             *[pack(s) for s in sums[:5]], stats), ("more", int(table["shard"][0].as_py()), pack(sums[5]))]


@dataclass
class Model:
    """The tables of sorted hash arrays and the numbers that all shards share."""
    table: DataFrame  # rows of kinds bigrams, words and more
    shards: int
    bits: int  # of a bigram's hash
    tokens: int  # training tokens
    distinct: int  # distinct training tokens
    types: int  # distinct bigrams
    discounts: tuple[list[float], list[float]]  # of bigram counts, of numbers of left neighbours
    rest: float  # mass that the word level leaves to the uniform distribution


def discounts(counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


def fit(indexed: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the training documents of an indexed corpus."""
    total = indexed.agg(F.sum(F.octet_length("tokens") + F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-3 * total // shard_bytes))  # an indexed text takes about a third of its bytes
    # there are fewer bigrams than bytes: an unseen one is taken for a seen one once in 2 ** SPARE_BITS times at most
    bits = min(60, SPARE_BITS + int(total + 1).bit_length())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, *parts in zip(*(batch.column(c).to_pylist() for c in ("held_out", "sizes", "words", "tokens"))):
                own = Batch(*parts)
                train = np.repeat(~np.array(held, bool), own.sizes)
                if not train.any():
                    continue
                pairs, n = np.unique(own.pairs()[train], return_counts=True)
                v, w = own.hashes(pairs)
                shard = (mix(v, w, bits) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                rows = []
                for s, cut in _cuts(shard[order]):
                    some = order[cut]  # sorted by context, as the pairs are
                    kept, place = np.unique(np.concatenate([v[some], w[some]]), return_inverse=True)
                    low = np.sort(place[:len(some)])
                    by = np.argsort(place[:len(some)], kind="stable")
                    rows.append(("pairs", s, pack_sorted(kept), pack(np.diff(low, prepend=0)),
                                 pack(place[len(some):][by]), pack(n[some][by])))
                seen = np.bincount(own.tokens[train], minlength=len(own.words))
                used = seen > 0
                rows += _by_word("count", own.words[used], shards, seen[used])
                yield _chunks(rows)

    folded = indexed.select("held_out", "sizes", "words", "tokens").mapInArrow(fold, CHUNK)

    def merge(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == "pairs":
            rows = _merge_pairs(table, shards, bits)
        else:  # counts of words go on to the shard of the word
            rows = [tuple(r.values()) for r in table.to_pylist()]
        return pa.Table.from_batches([_chunks(rows)])

    spark, path = indexed.sparkSession, scratch_path(indexed.sparkSession, "kneser-ney")
    folded.groupBy("kind", "shard").applyInArrow(merge, CHUNK).write.partitionBy("kind").parquet(path)
    merged = spark.read.schema(CHUNK).parquet(path)

    def join(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_chunks(_merge_words(table))])

    words = cut_lineage(merged.filter("kind in ('count', 'left', 'context')").groupBy("shard").applyInArrow(join, CHUNK))
    for kind in ("count", "left", "context"):
        remove(spark, f"{path}/kind={kind}")
    del folded, merged
    release(spark)
    bigrams = spark.read.schema(CHUNK).parquet(path).filter("kind = 'bigrams'")

    def sums(df: DataFrame, n: int) -> list[int]:
        row = df.agg(*[F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(n)]).first()
        return [x or 0 for x in row]

    types, *pair_counts = sums(bigrams, 5)
    tokens, distinct, left, *left_counts, more = sums(words.filter("kind = 'words'"), 8)
    pair, word = discounts(pair_counts), discounts(left_counts)
    rest = (word[0] * left_counts[0] + word[1] * left_counts[1] + word[2] * more) / types if types else 1.0
    return Model(bigrams.unionByName(words), shards, bits, tokens, distinct, types, (pair, word), rest)


# --- scoring --------------------------------------------------------------------------------------

def _mapped(a: np.ndarray) -> np.ndarray:
    """The array in a temporary file of the worker, memory-mapped; the file goes with the array."""
    if not len(a):
        return a
    file = tempfile.TemporaryFile()
    file.write(a.tobytes())
    file.flush()
    return np.memmap(file, a.dtype, "r", shape=a.shape)


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of sorted hashes in a sorted array."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return place, keys[place] == asked


def _discount(counts: np.ndarray, of: list[float]) -> np.ndarray:
    return np.array([0.0, *of])[np.minimum(counts, 3)]


ASKED = "kind string, shard int, batch bigint, keys binary"
REPLY = "batch bigint, kind string, shard int, a binary, b binary, c binary, d binary"
_REPLY_TYPES = [pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 4]


def _queries(own: Batch, shards: int, bits: int) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Hashes that a batch asks for, shard by shard, and the order in which it asks: bigrams, words."""
    pairs = np.unique(own.pairs())
    keys = mix(*own.hashes(pairs), bits)
    out, orders = [], []
    for hashes in (keys, np.append(own.words, np.uint64(START))):
        shard = (hashes % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((hashes, shard))
        out.append([(s, hashes[order[cut]]) for s, cut in _cuts(shard[order])])
        orders.append(order)
    return *out, pairs, orders


def score(indexed: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    shards, bits, discount, types = model.shards, model.bits, model.discounts, model.types
    rest, distinct, tokens = model.rest, model.distinct, model.tokens

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number_, *parts in zip(*(batch.column(c).to_pylist() for c in ("batch", "sizes", "words", "tokens"))):
                bigrams, words, *_ = _queries(Batch(*parts), shards, bits)
                rows = [(kind, s, number_, pack_sorted(h)) for kind, asked in (("bigrams", bigrams), ("words", words))
                        for s, h in asked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                    names=["kind", "shard", "batch", "keys"])

    asked = indexed.select("batch", "sizes", "words", "tokens").mapInArrow(ask, ASKED)

    def reply(table: pa.Table) -> pa.Table:
        stored = {r["kind"]: r for r in table.filter(pc.is_null(table["batch"])).to_pylist()}
        questions = table.filter(pc.is_valid(table["batch"]))
        kind = "words" if "words" in table["kind"].unique().to_pylist() else "bigrams"
        have = stored.get(kind)
        keys = _mapped(unpack_sorted(have["keys"])) if have else np.empty(0, np.uint64)
        columns = [_mapped(unpack(have[c], "<u4")) for c in "abcde" if have[c] is not None] if have else []
        if kind == "words" and have:
            columns.append(_mapped(unpack(stored["more"]["keys"], "<u4")))
        out = []
        for number_, raw in zip(questions["batch"].to_pylist(), questions["keys"].to_pylist()):
            place, found = _find(keys, unpack_sorted(raw))
            got = [np.where(found, c[place].astype(np.int64), 0) for c in columns] or \
                [np.zeros(len(found), np.int64)] * (6 if kind == "words" else 1)
            if kind == "bigrams":
                values = [pack(got[0]), None, None, None]
            else:
                count, left, total, once, twice, more = got
                p = np.maximum(left - _discount(left, discount[1]), 0) / max(types, 1) + rest / (distinct + 1)
                free = (discount[0][0] * once + discount[0][1] * twice + discount[0][2] * more) / np.maximum(total, 1)
                free = np.where(total > 0, free, 1.0)
                values = [pack(count), pack(total), pack(p, "<f4"), pack(free, "<f4")]
            out.append((number_, kind, int(table["shard"][0].as_py()), *values))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, _REPLY_TYPES)],
                        names=[c.split()[0] for c in REPLY.split(", ")])

    stored = model.table.select(F.when(F.col("kind") == "bigrams", "bigrams").otherwise("words").alias("service"),
                                "kind", "shard", F.lit(None).cast("bigint").alias("batch"), "keys", "a", "b", "c", "d", "e")
    both = asked.withColumn("service", F.col("kind")).unionByName(stored, allowMissingColumns=True)
    # written, so that the shuffle files of the model and the questions are gone before texts are put together
    replies = cut_lineage(both.groupBy("service", "shard").applyInArrow(lambda t: reply(t), REPLY))
    del asked, stored, both
    release(indexed.sparkSession)

    def total(table: pa.Table) -> pa.Table:
        texts = table.filter(pc.is_null(table["kind"])).to_pylist()[0]
        rows = sorted((r for r in table.select(["kind", "shard", "a", "b", "c", "d"]).to_pylist() if r["kind"]),
                      key=lambda r: (r["kind"], r["shard"]))
        own = Batch(texts["sizes"], texts["words"], texts["tokens"])
        *_, pairs, (pair_order, word_order) = _queries(own, shards, bits)

        def column(kind: str, name: str, dtype: str, order: np.ndarray) -> np.ndarray:
            values = np.concatenate([unpack(r[name], dtype) for r in rows if r["kind"] == kind])
            out = np.empty(len(order), np.float64)
            out[order] = values
            return out

        n = column("bigrams", "a", "<u4", pair_order)
        count, all_, p, free = (column("words", c, t, word_order) for c, t in zip("abcd", ("<u4", "<u4", "<f4", "<f4")))
        before, word = pairs // (len(own.words) + 1), pairs % (len(own.words) + 1)
        high = np.maximum(n - _discount(n.astype(np.int64), discount[0]), 0) / np.maximum(all_[before], 1)
        log_p = np.log10(high + free[before] * p[word])
        each = log_p[np.searchsorted(pairs, own.pairs())]
        base = np.log10((count + 0.5) / (tokens + 0.5 * (distinct + 1)))[own.tokens]
        known = (count > 0)[own.tokens]
        sums = [np.add.reduceat(x, own.starts) for x in (known.astype(np.int64), base, each)]
        docs = len(own.sizes)
        return pa.table({
            "doc_id": pa.array(texts["doc_ids"], pa.int64()), "held_out": pa.array(texts["held_out"], pa.bool_()),
            "n_tokens": pa.array(own.sizes), "n_known": pa.array(sums[0]),
            "train_tokens": pa.array(np.full(docs, tokens, np.int64)),
            "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    rows = indexed.unionByName(replies, allowMissingColumns=True)
    return rows.groupBy("batch").applyInArrow(
        lambda t: total(t), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                            "base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, perplexity) per token of the held-out and the training documents."""
    return scored.groupBy("held_out").agg(
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
