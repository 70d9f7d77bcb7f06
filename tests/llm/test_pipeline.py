import corpus_pipeline
from shelfmark.runtime import cut_lineage


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, left = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, small))
        assert docs.columns == names and 0.7 * left < docs.count() <= left, name
        left = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == left
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0


def test_stages_take_odd_and_empty_tables(spark, small, odd, none):
    for table in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, small).count() >= 0, name


def test_planted_copies_and_passages(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    rows = [(1, "first words of a document that is long enough to be compared with others " * 20)]
    rows += [(2, rows[0][1]), (3, rows[0][1] + "end"), (4, item), (5, "clean " + " ".join(f"w{k}" for k in range(200)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicates(spark, docs, small)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, docs, small).collect()) == [1, 2, 3, 5]
