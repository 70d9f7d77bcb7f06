"""Ids at both ends of bigint, buckets of neighbouring ids, and texts with very many spans."""

import re
import time

import pytest

from shelfmark.llm import merkle, pii


def followers(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return sorted(((a[0], a[1], b[1]) for a, b in zip(ordered, ordered[1:] + ordered[:1])), key=repr)


@pytest.mark.parametrize("ids", [[-9 * 10**18, 0, 9 * 10**18], [-2**63, 2**63 - 1, 5, 6], [None, -2**63, 3, 4, None], [7], [None],
                                 [*range(40), 9 * 10**18], [*range(0, 140, 7), *range(10**12, 10**12 + 20)]])
@pytest.mark.parametrize("bucket_bytes", [256, 1 << 20])
def test_followers(spark, ids, bucket_bytes):
    rows = [(i, f"text {k} " + "x" * (k % 40)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(((r.doc_id, r.text, r.next_text) for r in merkle.with_next(df, bucket_bytes).collect()), key=repr)
    assert got == followers(rows)


def test_no_documents_no_followers(spark):
    assert merkle.with_next(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_a_far_id_leaves_buckets_small(spark):
    rows = [(i, "x" * 99) for i in range(4000)] + [(9 * 10**18, "far")]
    firsts, nulls = merkle._bounds(spark.createDataFrame(rows, "doc_id bigint, text string"), 10_000)
    assert not nulls
    ends = [*firsts[1:], 10**19]
    sizes = sorted(sum(a <= i < b for i, _ in rows) for a, b in zip(firsts, ends))
    assert len(firsts) > 30 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_many_bounds(spark):
    firsts = [3 * k for k in range(1000)]
    df = spark.createDataFrame([(i,) for i in [None, -5, 0, 1, 2, 3, 765, 767, 768, 769, 1537, 2996, 2997, 10**15]], "i bigint")
    for r in df.select("i", merkle._bucket(df.i, firsts).alias("b")).collect():
        assert r.b == max(0, sum(f <= r.i for f in firsts) - 1 if r.i is not None else 0)


def test_very_many_spans(spark):
    """A long text of addresses takes time in proportion; spans are those of a plain search."""
    long = " ".join(f"a{i}@mail{i % 7}.org call 555-123-{i % 10000:04d}" for i in range(4000))
    started = time.time()
    got = pii.find(spark.createDataFrame([(1, long), (2, "me@x.org")], "doc_id bigint, text string")).collect()
    assert time.time() - started < 60
    spans = {r.doc_id: r.spans for r in got}
    want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", long)]
    assert [(s.start, s.end) for s in spans[1] if s.base] == want and len(want) == 4000
    assert len(spans[2]) == 1
    ends = 0
    for s in spans[1]:
        assert s.base or s.start >= ends
        ends = max(ends, s.end)
