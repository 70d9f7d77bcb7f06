"""Folders that only Arrow's or Hadoop's file systems open, and benchmarks of many blocks."""
import random
import re

from pyarrow import fs

from shelfmark.llm import decontaminate, token_files
from shelfmark.llm.common import arrow_uri, open_store


def test_names_of_stores(tmp_path):
    assert arrow_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and arrow_uri("hdfs://host:1/a") == "hdfs://host:1/a"
    assert arrow_uri("file:///a/b") == arrow_uri("file:/a/b") == arrow_uri("/a/b") == "/a/b"
    for name in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        files, place = open_store(name)
        assert isinstance(files, fs.LocalFileSystem) and place == str(tmp_path)


def test_token_files_in_a_store_of_another_name(spark, docs, tmp_path):
    base = str(tmp_path)

    def store(uri):
        assert uri.startswith("shelf://bucket/")
        return fs.SubTreeFileSystem(base, fs.LocalFileSystem()), uri.removeprefix("shelf://bucket/")

    source = docs.select("doc_id", "text").limit(40)
    manifest = token_files.write(source, "shelf://bucket/ids", length=64, partitions=2, store=store)
    assert all(r.path.startswith("shelf://bucket/ids/") for r in manifest.collect())
    plain = token_files.write(source, f"file:{base}/plain", length=64, partitions=2)
    want = sorted(tuple(r) for r in token_files.read_documents(plain).collect())
    assert sorted(tuple(r) for r in token_files.read_documents(manifest, store).collect()) == want and len(want) == 40
    assert token_files.read_ids(spark, manifest, store).count() == token_files.read_ids(spark, plain).count()


def test_many_blocks_of_a_benchmark_are_one_step(spark):
    rng = random.Random(5)

    def text(m):
        return " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(m)))

    items = [(k // 2, text(25)) for k in range(60)] * 3 + [(None, "w1"), (77, None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(k, text(60)) for k in range(80)] + [(80, None), (81, "")], "doc_id bigint, text string")
    results = []
    for block_bytes in (1 << 20, 200):
        found = decontaminate.find_matches(docs, benchmark, 4, block_bytes)
        assert len(re.findall("MapInArrow", found._jdf.queryExecution().optimizedPlan().toString())) == 1
        judged = decontaminate.judge(found)
        results.append(sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, len(r.matches)) for r in judged.collect()))
    assert results[0] == results[1] and sum(r[2] for r in results[0]) > 500
