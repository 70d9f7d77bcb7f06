from pyspark.sql import functions as F

from shelfmark.sources import files as S, sessions as SE


def files_below(path):
    return [p for p in path.rglob("part-*") if not any(q.name.startswith("_") for q in p.relative_to(path).parents)]


def many(spark, n=400):
    return spark.range(n).select(
        F.concat(F.lit("20240101_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("session_id"), F.lit(0).cast("bigint").alias("seq"),
        F.concat(F.lit("/a/"), "id").alias("src"), F.concat(F.lit("/r/x/"), "id").alias("dst"), F.lit(0.0).alias("ts"))


def ledger_of(moves):
    return SE.Ledger(moves.select("session_id", F.lit("/r").alias("root"), F.lit(None).cast("string").alias("created_at")),
                     moves, moves.select("session_id", F.col("seq").alias("first_seq"), F.lit("/r/x").alias("folder")))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_files_of_a_ledger_do_not_grow_with_its_sessions(spark, tmp_path):
    """400 small sessions lie in a few files, in order, and come back whole, also after a second writing."""
    moves, odd = many(spark), spark.createDataFrame([(None, 0, "/a", "/b", 1.0), ("", 1, "/c", "/d", None)], SE.MOVES)
    for fmt in ("parquet", "json"):
        out = tmp_path / fmt
        SE.write_ledger(ledger_of(moves), str(out), fmt)
        SE.write_ledger(ledger_of(odd), str(out), fmt, "append")
        back = SE.read_ledger(spark, str(out), fmt)
        assert rows(back.moves) == rows(moves.unionByName(odd.withColumn("session_id", F.lit(None).cast("string"))))
        assert back.folders.count() == back.sessions.count() == 402
        assert len(files_below(out)) <= 30


def test_a_ledger_in_folders_is_read_and_appended_to(spark, tmp_path):
    moves, out = many(spark, 3), str(tmp_path / "old")
    old = ledger_of(moves.limit(2))
    for name in ("moves", "folders"):
        getattr(old, name).write.partitionBy("session_id").parquet(f"{out}/{name}")
    old.sessions.write.parquet(f"{out}/sessions")
    SE.write_ledger(ledger_of(moves.filter("src = '/a/2'")), out, mode="append")
    back = SE.read_ledger(spark, out)
    assert rows(back.moves) == rows(moves) and back.folders.count() == back.sessions.count() == 3


def test_sessions_are_dealt_to_tasks_by_number(spark, tmp_path):
    """Folders of small sessions are not all written by one task."""
    out = tmp_path / "ledger"
    assert SE.write_session(many(spark, 3 * SE.SESSIONS_A_TASK), str(out))
    tasks = {p.name.split("-")[1] for p in out.rglob("part-*")}
    assert len(tasks) > 1 and SE.read_sessions(spark, str(out)).count() == 3 * SE.SESSIONS_A_TASK


def test_files_of_an_organised_corpus_do_not_grow_with_its_folders(spark, tmp_path):
    """300 folders lie in a few files; the manifest says which. A folder of half the rows is dealt to several tasks."""
    df = spark.range(2000).select("id", F.concat(F.lit("t"), "id").alias("text"), F.when(
        F.col("id") < 1000, F.lit("hot")).otherwise(F.concat(F.lit("2024-"), F.col("id") % 150)).alias("level1"),
        F.when(F.col("id") % 2 == 0, F.lit("PDFs")).alias("level2"))
    df = df.unionByName(spark.createDataFrame([(-1, "n", None, ""), (-2, "n", "", "Other")], df.schema))
    want = rows(df.select("id", "text", F.nullif("level1", F.lit("")), F.nullif("level2", F.lit(""))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for fmt in ("parquet", "json"):
            out = tmp_path / fmt
            S.write_organized(df, str(out), fmt)
            back = S.read_organized(spark, str(out), fmt)
            assert back.columns == ["id", "text", "level1", "level2"] and rows(back) == want
            assert len(files_below(out)) <= 4
            found = S.organized_folders(spark, str(out))
            assert found.agg(F.sum("rows")).first()[0] == 2002
            assert found.filter("level1 = 'hot'").select("file").distinct().count() > 1
            S.write_organized(df.filter("id = 5"), str(out), fmt, "append")
            assert S.organized_folders(spark, str(out)).agg(F.sum("rows")).first()[0] == 2003
            assert S.read_organized(spark, str(out), fmt).count() == 2003
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_organised_directories_stay(spark, tmp_path):
    """The form with a directory per folder can be asked for, and is kept by what is appended."""
    df = spark.createDataFrame([("a", "2024-03", "PDFs"), ("b", None, "Other")], "text string, level1 string, level2 string")
    out = tmp_path / "tree"
    S.write_organized(df, str(out), directories=True)
    S.write_organized(df, str(out), mode="append")
    assert (out / "level1=2024-03" / "level2=PDFs").is_dir() and not (out / "_folders").exists()
    assert rows(S.read_organized(spark, str(out))) == rows(df.unionByName(df))
    S.write_organized(df, str(tmp_path / "lines"), "text")
    assert (tmp_path / "lines" / "level1=2024-03" / "level2=PDFs").is_dir()
