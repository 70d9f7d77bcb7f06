"""Op 13: ids against the encoding of whole texts, places against a plain walk over the stream."""

import zlib

import numpy as np
import pytest

from shelfmark.llm import concat_cut, tokens
from shelfmark.llm.queries import QUERIES
from shelfmark.runtime import cut_lineage


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_file(concat_cut.DEFAULT_FILE))


def ids_of(tokenizer, text, end=1):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def padded(lengths, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def check(rows, texts, tokenizer, capacity):
    """``rows`` with doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset; ids are unique."""
    whole = {i: ids_of(tokenizer, t) for i, t in texts.items()}
    parts, fill = {i: [] for i in texts}, {}
    for r in rows:
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        parts[r.doc_id].append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in parts.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(whole[i])
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [sum(n for _, n in places) for places in fill.values()]
    total = sum(map(len, whole.values()))
    assert padded(lengths, capacity) == 0 and sum(n == capacity for n in lengths) == total // capacity


def test_registered_query(spark, small, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check(QUERIES["op13_concatenate_and_cut"](spark, small).collect(), texts, tokenizer, 2048)


ODD = [None, "", " ", "\n\n", "A B  c", "it's we'll 'S", "end. of, line.\nnext", "É é ΑΣ ΣΑΣ", "<|endoftext|>x <|startoftext|>", "a b\x1cc\td",
       "日本語。 テキスト", "x" * 5000, "word " * 3000, "½ ⅷ 12 345", "́ ́x", "\x00", "a.b., c.,", "the end", "the end", "İI ß"]


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_odd_texts_any_partitioning(spark, tokenizer, capacity):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(ODD)], "doc_id bigint, text string, ids string, part int")
    from pyspark.sql import functions as F
    packed = concat_cut.pack(docs.repartition(6), capacity=capacity)
    rows = packed.withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, dict(enumerate(ODD)), tokenizer, capacity)


def test_sequences_hold_the_stream(spark, tokenizer):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string").repartition(4)
    encoded = cut_lineage(concat_cut.encode(docs))
    stream = [r.ids for r in sorted(encoded.collect(), key=lambda r: (r.part, r.local))]
    made = sorted(concat_cut.sequences(concat_cut.cut(encoded, 64)).collect(), key=lambda r: r.sequence_id)
    assert b"".join(bytes(r.ids) for r in made) == b"".join(map(bytes, stream))
    assert all(len(r.ids) == 4 * r.length for r in made)


def test_odd_and_empty_tables(odd, none):
    assert concat_cut.pack(odd).groupBy("doc_id").count().count() == odd.select("doc_id").distinct().count()
    assert concat_cut.pack(none).count() == 0


def test_prefix_sums_over_many_partitions(spark):
    rows = [(p, n) for p in range(50) for n in (p % 7, 3)]
    table = spark.createDataFrame(rows, "part bigint, n_tokens bigint")
    got = {r.part: r.base for r in concat_cut.bases(table, block=8).collect()}
    assert got == {p: sum(n for q, n in rows if q < p) for p in range(50)}


def test_cache_is_bounded(tokenizer, monkeypatch):
    import pyarrow as pa

    encoder = concat_cut.WordEncoder(tokens.vocabulary_file(concat_cut.DEFAULT_FILE))
    monkeypatch.setattr(concat_cut, "CACHED_BYTES", 20_000)
    for k in range(50):
        ids, _ = encoder.encode(pa.array([" ".join(f"w{k}x{j}" for j in range(40))]))
        assert (ids == ids_of(tokenizer, " ".join(f"w{k}x{j}" for j in range(40)))[:-1]).all()
    assert len(encoder.cache) < 200
