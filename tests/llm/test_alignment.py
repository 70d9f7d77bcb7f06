"""Op 11 against a brute force over whole texts, and its bitmaps against sets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import alignment, bitmaps
from shelfmark.llm.queries import QUERIES

ODD = ["x ▁y", "a▁b", "<|endoftext|> in <s> text", "two  spaces", " leading", "trailing ", "\n", "\n\nx\n", "a\tb\r\nc", "é́ x",
       "\x00 nul", "日本語 テキスト。", "emoji 👩‍👩‍👧 end", "a　b \x1c c", "'s it's", "1 23\n456", "x" * 3000, "ﬁ ½", "﻿bom", "a \n b"]


def brute(texts):
    aligner = alignment.worker_aligner(*vars(alignment.Files()).values())
    links, rows = [], []
    for text in texts:
        whole = " " + (text or "")
        a = aligner.a.encode(whole, add_special_tokens=False).ids if text else []
        b = aligner.b.encode(text) if text else []
        if text and not (b"".join(aligner.a_bytes[i] for i in a) == whole.encode() == b"".join(aligner.b_bytes[i] for i in b)):
            a, b = [], []
        spans = []
        for ids, table in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(mine)
        found, j = [], 0
        for s, e, i in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(b) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    found.append((i, spans[1][j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, _, i in mine if low <= s < cut) for mine in spans))
            low = cut
        links.append(found)
        rows.append([len(a), len(b), len(groups), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    count = Counter(p for found in links for p in set(found))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(*r[:4], sum(count[p] == most[p[0]] for p in found), sum(count[p] for p in found), r[4])
            for r, found in zip(rows, links)], count, Counter(p for found in links for p in found)


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_registered_query_against_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want, _, _ = brute([texts[i] for i in sorted(texts)])
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in QUERIES["op11_pair_bitmaps"](spark, small).collect()}
    assert got == dict(zip(sorted(texts), want))


def test_odd_texts_ties_and_copies(spark):
    texts = [None, "", *ODD, *ODD[:4], "the same words here", "the same words here"]
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(texts)], "doc_id bigint, text string, n_a string, bucket int")
    scored, counts = alignment.align(docs.repartition(5))
    want, n_docs, n_links = brute(texts)
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in scored.collect()}
    assert got == dict(enumerate(want))
    assert got[texts.index("a▁b")] == (0,) * 6 + ("",) == got[0]
    assert got[texts.index("x" * 3000)][0] > 0
    assert {(r.a_id, r.b_id): (r.n_docs, r.n_links) for r in counts.collect()} == {p: (n, n_links[p]) for p, n in n_docs.items()}


def test_odd_and_empty_tables(odd, none):
    scored, counts = alignment.align(odd)
    assert scored.count() == odd.count() and counts.filter("n_docs < 1 or n_links < n_docs").count() == 0
    scored, counts = alignment.align(none)
    assert scored.count() == counts.count() == 0


def test_small_parts_and_fragments_give_the_same(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    aligner = alignment.worker_aligner(*vars(alignment.Files()).values())
    texts = [r.text for r in docs.collect()]
    rows, links, doc = aligner.documents(texts)
    monkeypatch.setattr(alignment, "CACHED_BYTES", 0)  # nothing is kept between calls
    parts = [aligner.documents(texts[i:i + 7]) for i in range(0, len(texts), 7)]
    assert [r for p in parts for r in p[0]] == rows
    whole = dict(alignment.fragments(aligner, links << 16 | doc))
    pieces = defaultdict(list)
    for k, (_, some, at) in enumerate(parts):
        for bucket, raw in alignment.fragments(aligner, some << 16 | (at + 7 * k)):
            pieces[bucket].append(bitmaps.Counted.from_bytes(raw))
    for bucket, raw in whole.items():
        for a, b in zip(bitmaps.Counted.from_bytes(raw).postings(), bitmaps.Counted.merge(pieces[bucket]).postings()):
            assert (a == b).all()


def test_codes_are_reversible():
    aligner = alignment.worker_aligner(*vars(alignment.Files()).values())
    a, b = np.array([0, 1, 63, 64, 50256]), np.array([0, 31999, 5, 7, 31999])
    code = aligner.code(a, b)
    assert [x.tolist() for x in aligner.pair(code)] == [a.tolist(), b.tolist()]
    assert aligner.bucket(code).tolist() == (a % alignment.BUCKETS).tolist()


@pytest.mark.parametrize("sparse", [3, 4096])
def test_planes_are_sets(monkeypatch, sparse):
    monkeypatch.setattr(bitmaps, "SPARSE", sparse)
    rng = np.random.default_rng(1)
    parts, want = [], Counter()
    for part in range(3):  # a slot is in one part only
        raw = Counter((int(k), int(s) * 3 + part) for k, s in zip(rng.integers(0, 9, 400), rng.integers(0, 60, 400)))
        want.update(raw)
        entries = np.array(sorted(k << 16 | s for k, s in raw), np.int64)
        times = np.array([raw[e >> 16, e & 0xFFFF] for e in entries.tolist()])
        parts.append(bitmaps.Counted.from_bytes(bitmaps.Counted.of(entries, times).to_bytes()))
    whole = bitmaps.Counted.merge(parts)
    entries, times = whole.postings()
    assert {(e >> 16, e & 0xFFFF): t for e, t in zip(entries.tolist(), times.tolist())} == want
    keys, slots, links = whole.totals()
    assert keys.tolist() == sorted({k for k, _ in want})
    assert slots.tolist() == [sum(1 for a, _ in want if a == k) for k in keys]
    assert links.tolist() == [sum(n for (a, _), n in want.items() if a == k) for k in keys]
    assert (len(whole.present.heads) > 0) == (sparse == 3)
