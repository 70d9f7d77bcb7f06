import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import edit_counts, packing, token_files, tokens
from shelfmark.runtime import scratch_path

ODD = ["a   b", "a  b", " a", "  a\n b ", "x \ny", "", "   ", "a ", "a  ", "q\n \nz", "a\x1c b c", "it's  we'll", "\n\n a\n\n b",
       "a　 b", " \n ", "a\n\nb c.\n", "a\n\n", "a.\n\n\nb", "x\ty z.,q b., c\r\nd\x01", "Ġx y Ġz", None, "\n", "x\n", "\nx",
       " x y", "word. word, Word", "é b"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.worker_encoder(tokens.vocabulary_file())


def whole(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_like_whole_texts(encoder, docs):
    texts = [r.text for r in docs.select("text").limit(60).collect()] + ODD
    column = pa.array([*["skipped"], *texts], pa.string()).slice(1)
    ids, offsets = encoder.encode(column)
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == whole(encoder, text)
        assert encoder.count(text or "") == b - a


def test_files_round_trip(spark, encoder, docs, odd, none):
    for source in (docs.select("doc_id", "text"), odd):
        manifest = token_files.write(source, scratch_path(spark, "ids"), length=64, partitions=3)
        got = sorted((tuple(r) for r in token_files.read_documents(manifest).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == [r.doc_id for r in source.orderBy("doc_id").collect()]
        at, by_id = 0, {}
        for doc, start, n, crc in got:
            assert start == at
            at += n
            by_id.setdefault(doc, []).append((n, crc))
        for row in source.collect():
            ids = np.array([*whole(encoder, row.text), 2], "<u4")
            assert (len(ids), zlib.crc32(ids.tobytes())) in by_id[row.doc_id]
        sequences = token_files.read_ids(spark, manifest).collect()
        assert sum(sum(s["mask"]) for s in sequences) == at and {len(s["ids"]) for s in sequences} == {64}
    assert token_files.read_documents(token_files.write(none, scratch_path(spark, "ids"))).count() == 0


def test_plan_is_gapless_and_near_the_bound():
    rng = np.random.default_rng(1)
    for k in range(12):
        sizes = np.clip(rng.lognormal(5 + k / 5, 1, 3000).astype(int), 1, 2048)
        counts = dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)]))
        table, n = packing.plan(counts)
        bins, seen = {}, {}
        for size, rank, count, each, sequence, offset in table.tolist():
            assert seen.get(size, 0) == rank
            seen[size] = rank + count
            for j in range(count):
                bins.setdefault(sequence + j // each, []).append((offset + j % each * size, size))
        assert seen == counts and len(bins) == n <= 1.03 * sizes.sum() / 2048 + 3
        for content in bins.values():
            at = 0
            for offset, size in sorted(content):
                assert offset == at
                at += size
            assert at <= 2048


def test_pack_keeps_every_id(spark, encoder, odd, none):
    rows = packing.pack(odd, capacity=50).collect()
    want = {}
    for row in odd.collect():
        want.setdefault(row.doc_id, []).append(np.array([*whole(encoder, row.text), 0], "<u4"))
    assert {r.doc_id for r in rows} == set(want)
    places = {}
    for r in rows:
        assert any(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for ids in want[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(i) for ids in want.values() for i in ids)
    for content in places.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 50
    assert packing.pack(none).count() == 0


def test_edits_count_like_whole_texts(encoder, docs):
    counter, rng = edit_counts.Counter(encoder), random.Random(2)
    for text in [r.text for r in docs.select("text").limit(25).collect()] + ["", "a", "  x  y \n\n z", " " * 50, "ab" * 500]:
        tree = edit_counts.SegmentTree(*(np.array(x, np.int64) for x in counter.leaves(text)))
        for _ in range(8):
            text = counter.edit(text, tree, rng.randrange(len(text) + 5), rng.choice([0, 1, 40, 3000]),
                                rng.choice(["", " ", "\n", "  ", "abc", " foo bar\n\n baz ", "x" * 300, " y" * 150]))
            assert (tree.count, tree.chars) == (len(whole(encoder, text)), len(text))


def test_edit_rows(encoder, odd, none):
    built = edit_counts.build(edit_counts.sample_edits(odd)).withColumnRenamed("text", "old").selectExpr("*", "old AS text")
    rows = edit_counts.apply_edits(built).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.n_tokens == sum(r.leaf_tokens) == len(whole(encoder, r.text))
        assert r._text == "clash" and len(r.old or "") - min(12, len(r.old or "") - len(r.old or "") // 3) < len(r.text) + 1
    assert edit_counts.apply_edits(edit_counts.build(edit_counts.sample_edits(none))).count() == 0


def test_one_pass_equals_two(encoder, odd, monkeypatch):
    monkeypatch.setattr(edit_counts, "PART_BYTES", 1000)
    edits = edit_counts.sample_edits(odd)
    two = edit_counts.apply_edits(edit_counts.build(edits).withColumnRenamed("n_tokens", "n_before"))
    columns = ["doc_id", "text", "n_before", "n_tokens", "leaf_chars", "leaf_tokens", "n_encoded"]
    one = edit_counts.count_edits(edits)
    assert sorted(map(str, one.select(columns).collect())) == sorted(map(str, two.select(columns).collect()))


def test_counting_bounds_the_cache(monkeypatch):
    encoder = tokens.PieceEncoder(tokens.vocabulary_file())
    monkeypatch.setattr(tokens, "CACHED_PIECES", 100)
    for k in range(2000):
        assert encoder.count(f"first{k} second{k}") == len(encoder.whole(f"first{k} second{k}")) // 4
        assert len(encoder.cache) + len(encoder.firsts) <= 104
