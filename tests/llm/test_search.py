import hashlib
import random
import re

import numpy as np
import xxhash

from shelfmark.llm import decontaminate, simhash
from shelfmark.llm.queries import QUERIES


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def brute_links(fps):
    return np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1)).tolist()


def test_trees_lose_no_link():
    rng = np.random.default_rng(5)
    for k in range(3):
        fps = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2)
        near, one = fps[:40].repeat(20), np.repeat(fps[:1], 900)
        for _ in range(k + 1):
            near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64))
            one = one ^ (np.uint64(1) << rng.integers(0, 64, len(one), dtype=np.uint64))
        fps = np.unique(np.concatenate([fps, near, one]))
        want = connected(len(fps), brute_links(fps))
        assert connected(len(fps), simhash.links(fps).tolist()) == want
        trees, shards = simhash.build(fps[rng.permutation(len(fps))[:500]], 40)
        index, shard = simhash.route(fps, trees)
        found = [(r[a], r[b]) for s in range(shards) for r in [index[shard == s]] for a, b in simhash.links(fps[r]).tolist()]
        assert shards > 10 and connected(len(fps), found) == want


def test_groups_against_brute_force(spark, docs, odd, none):
    docs = docs.select("doc_id", "text")
    many = docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "concat(text, ' more') AS text")).unionByName(
        spark.createDataFrame([(200000 + k, f"tiny {k % 7}") for k in range(300)], "doc_id bigint, text string"))
    rows = sorted(many.collect(), key=lambda r: r.doc_id)
    fps = np.array([slow_fingerprint(r.text) for r in rows], np.uint64)
    component = connected(len(rows), brute_links(fps))
    got = {r.doc_id: r for r in simhash.group(many).collect()}
    for k, row in enumerate(rows):
        assert got[row.doc_id].fp & (1 << 64) - 1 == fps[k]
        assert got[row.doc_id].component_id == rows[component[k]].doc_id
    # small shards and blocks go the same way
    distinct = simhash.fingerprints(many).select("fp").distinct()
    pairs = simhash.near_links(distinct, sample=200, leaf_rows=30, shard_rows=40).collect()
    unique = np.unique(fps)
    at = {int(v): i for i, v in enumerate(unique.view(np.int64))}
    assert connected(len(unique), [(at[p.a], at[p.b]) for p in pairs]) == connected(len(unique), brute_links(unique))
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 1
    assert kept.filter("doc_id in (4, 5)").count() == 1 and kept.filter("doc_id = 9").count() == 2
    assert kept.filter("text is null or trim(text) = '' or doc_id = 6").count() == 1
    assert simhash.deduplicate(none).count() == 0


def test_deduplicate_keeps_the_first_of_each_group(spark, docs):
    many = docs.selectExpr("doc_id", "text", "'k' AS key", "'b' AS body").unionByName(docs.selectExpr(
        "doc_id + 100000 AS doc_id", "concat(text, ' more') AS text", "'k' AS key", "'b' AS body"))
    # copies without an id, and unlike texts under one id
    many = many.unionByName(spark.createDataFrame(
        [(None, "a copied text without any id at all", "k", "b")] * 2 + [(7, "one text with its own seven words", "k", "b"),
         (7, "quite another text under the very same id", "k", "b")], many.schema))
    rows = sorted(many.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    fps = np.array([slow_fingerprint(r.text) for r in rows], np.uint64)
    component = connected(len(rows), brute_links(fps))
    want = sorted((str(r.doc_id), r.text) for k, r in enumerate(rows) if component[k] == k)
    kept = simhash.deduplicate(many.repartition(5))
    assert kept.columns == many.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == want


def brute_hits(text, items, n):
    words = decontaminate.words(text)
    hit, names = [0] * len(words), set()
    for name, item in items:
        own = decontaminate.words(item)
        k = min(n, len(own))
        for a in range(len(own) - k + 1 if own else 0):
            for p in range(len(words) - k + 1):
                if words[p:p + k] == own[a:a + k]:
                    hit[p:p + k] = [1] * k
                    names.add(name)
    return len(words), sum(hit), names


def test_matches_against_brute_force():
    rng = random.Random(3)
    for _ in range(80):
        vocabulary, n = rng.choice([2, 4, 10]), rng.choice([2, 3, 5, 13])
        def text(m): return b" ".join(b"w%d" % rng.randrange(vocabulary) for _ in range(rng.randrange(m)))
        items = [(k, text(rng.choice([3, 8, 20]))) for k in range(rng.randrange(6))]
        texts = [text(40) for _ in range(8)] + [b"zz " + i + b" y" for _, i in items]
        for raw, (n_words, found) in zip(texts, decontaminate.match(texts, decontaminate.Suffixes(items, n))):
            hit = [0] * n_words
            for start, k, item, at in found:
                hit[start:start + k] = [1] * k
                assert decontaminate.words(raw)[start:start + k] == decontaminate.words(dict(items)[item])[at:at + k]
            assert (n_words, sum(hit), {f[2] for f in found}) == brute_hits(raw, items, n)


def test_decontamination_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "Same text, here now"), (2, None), (None, "x"), (3, "x"), (3, "x"), (4, "  ")],
                                      "item_id bigint, text string")
    for block_bytes in (1 << 20, 8):  # one block and several
        found = decontaminate.judge(decontaminate.find_matches(odd, benchmark, block_bytes=block_bytes)).collect()
        assert len(found) == odd.count() and found[0]._text == "clash"
        by_id = {r.doc_id: r for r in found if r.doc_id != 9}
        assert (by_id[1].n_words, by_id[1].contaminated) == (0, False)
        assert (by_id[4].n_hit, by_id[4].n_items, by_id[4].contaminated) == (4, 1, True)
        assert by_id[3].items_sha256 == hashlib.sha256(b"3").hexdigest()
        assert by_id[8].n_words == 60000 and by_id[8].n_hit == 0
    kept = decontaminate.decontaminate(odd, benchmark)  # a third of the words of 7 are item 3
    assert kept.columns == odd.columns and kept.filter("doc_id in (3, 4, 5, 7)").count() == 0 and kept.count() == odd.count() - 4
    assert decontaminate.decontaminate(odd, benchmark.limit(0)).count() == odd.count()
    assert decontaminate.decontaminate(none, benchmark).count() == 0


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
