"""Document fingerprints: a Merkle tree over sections and paragraphs. Built-in functions only.

A text is cut at blank lines into sections, these at line breaks into paragraphs, and these into
leaves (sentences, and runs of 16 words of a longer one). Nothing is thrown away by the cuts, so a
node's hash stands for its exact text: equal roots mean equal texts. Where two roots differ, ``edits``
follows the branches that differ down to the paragraphs. ``likeness`` compares the sets of leaves.

Defined results: a null text is empty; an empty text has one empty leaf; the document after the last
one is the first; rows without an id come before the others; rows with equal ids follow each other in
the order of their texts; an empty table gives no rows; other columns are kept by ``fingerprint``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..runtime import cut_lineage

RUN = 16
HASH_CHARS = 32
BUCKET_BYTES = 32 << 20
RANGES = 1 << 16
STEP = 1 << 8


def _hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(HASH_CHARS))


def _runs(sentence: Column) -> Column:
    words = F.split(sentence, " ", -1)
    last = F.greatest(F.ceil(F.size(words) / RUN).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: _hash(F.array_join(F.slice(words, k * RUN + 1, RUN), " ")))


def tree(text: Column) -> Column:
    """sections: array of (hash, paragraphs: array of (hash, leaves: array of hashes))."""
    def paragraph(p: Column) -> Column:
        leaves = F.flatten(F.transform(F.split(p, r"\. ", -1), _runs))
        return F.struct(_hash(p).alias("hash"), leaves.alias("leaves"))

    def section(s: Column) -> Column:
        paragraphs = F.transform(F.split(s, "\n", -1), paragraph)
        return F.struct(_hash(F.array_join(F.transform(paragraphs, lambda p: p["hash"]), "\n")).alias("hash"),
                        paragraphs.alias("paragraphs"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section)


def leaves(text: Column) -> Column:
    """The distinct leaf hashes of a text, in the order of the text."""
    sentences = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.split(p, r"\. ", -1)))
    return F.array_distinct(F.flatten(F.transform(sentences, _runs)))


def root(text: Column) -> Column:
    """The root: the hash of the sections' hashes, which are the hashes of their paragraphs' hashes."""
    def section(s: Column) -> Column:
        return _hash(F.array_join(F.transform(F.split(s, "\n", -1), _hash), "\n"))

    return _hash(F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section), "\n\n"))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``root`` and ``sections`` (the tree)."""
    column = F.col(text).cast("string")
    return docs.withColumns({"root": root(column), "sections": tree(column)})


def edits(sections: Column, others: Column) -> Column:
    """(section, paragraph) pairs, from 0, whose hashes differ or that only one side has."""
    def branch(k: Column) -> Column:
        mine, other = F.get(sections, k), F.get(others, k)
        p, q = mine["paragraphs"], other["paragraphs"]
        n = F.greatest(F.coalesce(F.size(p), F.lit(0)), F.coalesce(F.size(q), F.lit(0)), F.lit(1))
        differing = F.filter(F.sequence(F.lit(0), n - 1),
                             lambda j: ~F.get(p, j)["hash"].eqNullSafe(F.get(q, j)["hash"]))
        pairs = F.transform(differing, lambda j: F.struct(k.alias("section"), j.alias("paragraph")))
        return F.when(mine["hash"].eqNullSafe(other["hash"]), F.slice(pairs, 1, 0)).otherwise(pairs)

    n = F.greatest(F.size(sections), F.size(others))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), branch))


def likeness(left: Column, right: Column) -> Column:
    """Share of common leaves among all leaves of two sets; 1 for two equal sets."""
    common = F.size(F.array_intersect(left, right))
    return common.cast("double") / (F.size(left) + F.size(right) - common)


def _bounds(source: DataFrame, bucket_bytes: int) -> tuple[list[int], bool]:
    """The first id of each bucket of neighbouring ids, and whether there are rows without an id.

    Ids are range partitioned (by Spark's own sample of them), four ranges for a bucket; neighbouring
    ranges are put together up to the wanted bytes. One row per range, at most ``RANGES``, reaches the driver.
    """
    seen = Observation()
    sizes = cut_lineage(source.select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("bytes")).observe(
        seen, F.sum("bytes").alias("bytes"), F.count_if(F.col("doc_id").isNull()).alias("nulls")))
    total = seen.get["bytes"] or 0
    ranges = min(RANGES, 4 * (total // bucket_bytes + 1))
    width = max(bucket_bytes, 4 * total / RANGES)
    ranged = sizes.filter("doc_id is not null").repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id()).agg(
        F.min("doc_id").alias("first"), F.sum("bytes").alias("bytes"))
    firsts, held = [], 0
    for r in sorted(ranged.collect(), key=lambda r: r["first"]):
        if not firsts or held + r["bytes"] > width:
            firsts.append(r["first"])
            held = 0
        held += r["bytes"]
    return firsts, bool(seen.get["nulls"])


def _bucket(key: Column, firsts: list[int]) -> Column:
    """The number of the last of ``firsts`` that is not above ``key``; 0 for null. Two short scans, not one long."""
    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda first: first <= key))

    def longs(values: list[int]) -> Column:
        return F.lit(values).cast("array<bigint>")

    if len(firsts) < 2:
        return F.lit(0)
    step = F.greatest(upto(longs(firsts[::STEP])) - 1, F.lit(0)) * STEP
    return F.greatest(step + upto(F.slice(longs(firsts), step + 1, STEP)) - 1, F.lit(0))


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, next_text): the text of the document that follows by id; the first follows the last.

    Documents are dealt to buckets of neighbouring ids, by one shuffle. The first document of each
    bucket is also sent to the bucket before, where it closes the order. Buckets are quantiles of the
    ids there are, so gaps between ids make no difference.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    firsts, nulls = _bounds(source, bucket_bytes)
    n = max(1, len(firsts))
    bucket = F.col("bucket")
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("closes"))
    before = F.struct(F.pmod(bucket - 1, F.lit(n)).cast("int").alias("bucket"), F.lit(True).alias("closes"))
    is_first = F.col("doc_id") == F.get(F.lit(firsts or [0]).cast("array<bigint>"), bucket)
    if nulls:  # rows without an id come first
        is_first = F.when(bucket == 0, F.col("doc_id").isNull()).otherwise(is_first)
    dealt = source.withColumn("bucket", _bucket(F.col("doc_id"), firsts).cast("int")).select(
        "doc_id", "text", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own))).alias("place"))
    order = Window.partitionBy("place.bucket").orderBy("place.closes", "doc_id", "text")
    return (dealt.withColumn("next_text", F.lead("text").over(order))
            .filter("not place.closes").select("doc_id", "text", "next_text"))


def half_replaced(text: Column, other: Column) -> Column:
    """The last half of the code points replaced by as many of the other text's first ones, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(other, half))
