import random
import pytest
from pyspark.errors import AnalysisException
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from shelfmark.operators import assemble as A, catalog as C, enrich as E, layout as L, ledger as G, routing as R
from shelfmark.plans.organise import enriched_records, organise
from shelfmark.sources import files as S, sessions as SE


def texts(df, key="path"):
    return {r[key]: r.text for r in df.collect()}


def test_csv(spark):
    body = "\n".join(f"{i},x" for i in range(101))
    df = spark.createDataFrame([("a", body), ("b", 'h,"q, r"\r\n\r\n1,2\n'), ("c", "\n".join(["1"] * 100))], "path string, text string")
    got = texts(A.csv_digest(A.csv_rows(df)))
    assert got["a"].split("\n")[99:] == ["99, x", "... (100 rows total)"]
    assert got["b"] == "h, q, r\n\n1, 2"
    assert got["c"] == "\n".join(["1"] * 100)


def test_sheets(spark):
    rows = [("w", 0, "S", i, ["a", None, str(i)]) for i in range(51)] + [("w", 1, "E", 0, ["", None]), ("w", 2, "T", 0, ["z"])]
    got = texts(A.sheet_digest(spark.createDataFrame(rows, "path string, sheet_no int, sheet string, row_no bigint, cells array<string>")))["w"]
    assert got.startswith("[Sheet: S]\na |  | 0\n") and got.endswith("a |  | 49\n...\n\n[Sheet: T]\nz")


def test_slides_and_paragraphs(spark):
    shapes = [("p", 1, 0, " a "), ("p", 1, 1, "\n"), ("p", 1, 2, "b"), ("p", 2, 0, ""), ("p", 3, 0, "c")]
    df = spark.createDataFrame(shapes, "path string, slide_no int, shape_no int, text string")
    assert texts(A.slide_digest(df)) == {"p": "[Slide 1]: a | b\n[Slide 3]: c"}
    paragraphs = spark.createDataFrame([("d", 0, "x"), ("d", 1, ""), ("d", 2, " "), ("e", 0, "")], "path string, seq int, text string")
    assert texts(A.paragraph_join(paragraphs)) == {"d": "x\n ", "e": ""}


def test_pdf(spark):
    long = "n" * 51
    rows = [("/x/f.pdf", i, long if i % 2 else "short", " ocr " if i != 2 else None) for i in range(12)]
    got = A.pdf_text(spark.createDataFrame(rows, "path string, page_no bigint, text string, ocr_text string")).first()
    assert got.text.startswith("[PDF: f.pdf | 12 pages]\n\n[Page 1 - OCR]\nocr\n\n[Page 2]\n" + long + "\n\n[Page 4]")
    assert (got.total_pages, got.pages_processed, got.ocr_used) == (12, 10, True)
    assert "[Page 11" not in got.text and "[Page 10]" in got.text


def test_transcript(spark):
    rows = [("/a/t.mp3", 0, 10.0, " hi "), ("/a/t.mp3", 1, 601.0, "no"), ("/a/t.mp3", 2, 30.0, "no"), ("/a/u.mp3", 0, 700.0, "x"), ("/a/v.mp3", 0, 5.04, "")]
    got = {r.path: r for r in A.transcript_text(spark.createDataFrame(rows, "path string, seq bigint, end_sec double, text string")).collect()}
    assert (got["/a/t.mp3"].text, got["/a/t.mp3"].duration_sec, got["/a/t.mp3"].segment_count) == ("[Audio Transcript: t.mp3]\n\nhi", 10.0, 1)
    assert (got["/a/u.mp3"].text, got["/a/u.mp3"].error, got["/a/u.mp3"].segment_count) == (None, "No speech detected in audio", 0)
    assert got["/a/v.mp3"].error and got["/a/v.mp3"].duration_sec == 5.0


def test_frames(spark):
    videos = spark.createDataFrame([("v", 4000.0), ("w", None), ("x", 10.0), ("y", 10.0)], "path string, duration double")
    frames = spark.createDataFrame([("v", 2, "two"), ("v", 4, ""), ("v", 5, "five"), ("y", 1, "")], "path string, frame_no int, description string")
    got = {r.path: r for r in A.frame_text(videos, frames).collect()}
    # numbered among the frames there are: the second one is empty
    assert got["v"].text == "[Video File: v | Duration: 3600s]\n\n[Frame 1]: two\n\n[Frame 3]: five"
    assert [got[p].error for p in "wxy"] == ["Could not read video metadata", "No frames extracted from video", "Vision model returned no descriptions"]
    times = A.frame_times(videos.filter("path = 'v'")).orderBy("frame_no").collect()
    assert [r.at_sec for r in times] == [600.0, 1200.0, 1800.0, 2400.0, 3000.0]


def test_images(spark):
    images = spark.createDataFrame([("/i/a.jpg", "seen", None, None, None), ("/i/b.jpg", "", 4, 3, "RGB"), ("/i/c.jpg", None, None, None, None)],
                                   "path string, description string, width int, height int, mode string")
    tags = spark.createDataFrame([("/i/b.jpg", 3, "Make", "M"), ("/i/b.jpg", 1, "Model", "X"), ("/i/b.jpg", 0, "Flash", "1")],
                                 "path string, tag_no int, tag string, value string")
    got = {r.path: (r.text, r.error) for r in A.image_text(images, tags).collect()}
    assert got == {"/i/a.jpg": ("[Image File: a.jpg]\nseen", None),
                   "/i/b.jpg": ("[Image File: b.jpg]\nImage file: b.jpg | Size: 4x3 | Mode: RGB | Model: X | Make: M", None),
                   "/i/c.jpg": (None, "Vision model returned no output")}


def test_sizes_and_audit(spark):
    mb = 1048576
    df = C.catalog(spark.sql(f"SELECT col1 AS path, col2 AS length, TIMESTAMP_NTZ '2024-03-05 06:07:08.5' AS modified FROM VALUES "
                             f"('/r/a.JPG', {mb // 16}), ('/r/.git/b.txt', 1), ('/r/c', 0), ('/r/d.pdf', {500 * mb}), ('/r/e.pdf', {501 * mb})"))
    rows = {r.name: r for r in C.skip_audit(C.drop_ignored(df)).collect()}
    assert rows["a.JPG"].size_mb == 0.062 and rows["a.JPG"].category == "image"   # half to even
    assert {n: r.reason for n, r in rows.items()} == {
        "a.JPG": None, "c": "not readable / empty", "d.pdf": None, "e.pdf": "too large (501.0 MB > 500.0 MB)"}
    iso = C.with_iso_times(df).first()
    assert (iso.modified_iso, iso.created_iso) == ("2024-03-05T06:07:08.500000", None)


def test_duplicates(spark):
    df = spark.createDataFrame([("b", b"x"), ("a", b"x"), ("c", b"y"), ("d", b"")], "path string, content binary")
    got = C.duplicate_files(df).orderBy("path").collect()
    assert [(r.path, r.copies, r.keep, r.is_kept, r.length) for r in got] == [("a", 2, "a", True, 1), ("b", 2, "a", False, 1)]
    assert C.duplicate_files(df, algorithm="sha256").count() == 2


def test_folders(spark):
    df = spark.createDataFrame([("", 0.9, ""), ("t", 0.55, "cluster_1"), ("t", 0.54, "misc"), (None, None, None), ("", 0.1, "cluster_2")],
                               "topic string, confidence double, cluster_label string")
    got = df.select(L.topic_folder().alias("t"), L.relation_folder().alias("r")).collect()
    assert [r.t for r in got] == ["Miscellaneous", "t", "Miscellaneous", "Miscellaneous", "Miscellaneous"]
    assert [r.r for r in got] == ["Miscellaneous", "t", "misc", "Miscellaneous", "cluster_2"]


def test_plan_collapses_an_empty_slug(spark):
    df = spark.createDataFrame([(0, "/r/a.txt", "a.txt", "document", "!!!", 0.9)], "seq bigint, path string, name string, category string, topic string, confidence double")
    assert L.build_plan(df, "/r/", "topic").first().dst == "/r/Documents/a.txt"
    assert L.build_plan(df, "/r", "other").first().dst == "/r/Miscellaneous/Documents/a.txt"


def test_score_batches_survives_failures(spark):
    def make():
        def fn(values):
            if "bad" in values:
                raise ValueError
            return [v.upper() for v in values]
        return fn
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "bad", None, "c"])], "i int, v string").coalesce(1)
    assert [r.o for r in E.score_batches(df, make, "v", "o", default="?").orderBy("i").collect()] == ["A", "?", "?", "C"]


def test_topics_in_first_seen_order(spark):
    rows = [("c", i, f"t{(i * 7) % 20}") for i in range(40)] + [("e", 0, ""), ("e", 1, None)]
    got = {r.cluster: r.topics for r in E.cluster_topics(spark.createDataFrame(rows, "cluster string, seq bigint, topic string")).collect()}
    assert got == {"c": ", ".join(f"t{(i * 7) % 20}" for i in range(12)), "e": None}


def test_outcome_and_fallback(spark):
    df = spark.createDataFrame([(" x ", None), ("  ", None), ("", None), ("y", "err")], "text string, error string")
    assert [(r.text, r.success) for r in R.outcome(df).collect()] == [("x", True), ("", True), ("", False), ("y", False)]
    odd = spark.createDataFrame([("unknown", ""), ("unknown", "z" * 5000)], "category string, text string")
    got = R.fallback_text(odd).collect()
    assert got[0].error == "No pipeline for category 'unknown'" and len(got[1].text) == 4000


def test_extract_all_keeps_every_file(spark):
    files = C.catalog(spark.createDataFrame(
        [(p, s, None) for p, s in [("/r/a.txt", 1), ("/r/b.pdf", 1), ("/r/c.mp3", 1), ("/r/d.mp4", 1), ("/r/e.jpg", 1),
                                   ("/r/f.xyz", 1), ("/r/g.png", 21 * 1048576), ("/r/h.md", 1)]],
        "path string, length bigint, modified timestamp_ntz"))
    docs = A.document_text(spark.createDataFrame([("/r/a.txt", "hello")], "path string, text string"))
    images = spark.createDataFrame([("/r/g.png", "seen", None)], "path string, text string, error string")
    got = {r.name: (r.text, r.error, r.success) for r in R.extract_all(files, [docs, images]).collect()}
    assert got == {
        "a.txt": ("[Document: a.txt]\n\nhello", None, True), "b.pdf": ("[PDF: b.pdf | 0 pages]", None, True),
        "c.mp3": ("", "No speech detected in audio", False), "d.mp4": ("", "Could not read video metadata", False),
        "e.jpg": ("", "Vision model returned no output", False), "f.xyz": ("", "No pipeline for category 'unknown'", False),
        "g.png": ("", "Image too large: 21.0 MB > 20 MB", False), "h.md": ("", "No text extracted from document", False)}


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a b.txt").write_bytes(b"a\xffb\r\nc\rd")
    (tmp_path / "in" / "sub" / "x.tar.gz").write_bytes(b"12")
    root = str(tmp_path / "in")
    got = {r.path: (r.name, r.extension, r.category, r.size_bytes) for r in S.scan_files(spark, root).collect()}
    assert got == {f"{root}/a b.txt": ("a b.txt", ".txt", "document", 8), f"{root}/sub/x.tar.gz": ("x.tar.gz", ".gz", "unknown", 2)}
    assert S.scan_files(spark, root, recursive=False).count() == 1
    assert texts(S.read_text_files(spark, root))[f"{root}/a b.txt"] == "a�b\nc\nd"
    with pytest.raises(AnalysisException):
        S.scan_files(spark, str(tmp_path / "none"))


def test_walk_loses_nothing(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name, body in (("a.txt", "x"), ("empty.md", ""), (".hid.txt", "12"), ("_u.txt", "123"), ("sub/b.md", "1"), ("sub/deep/c", "1")):
        (tmp_path / name).write_text(body)
    (tmp_path / "broken.txt").symlink_to(tmp_path / "nowhere")
    (tmp_path / "sub" / "loop").symlink_to(tmp_path)
    got = C.skip_audit(S.scan_mounted(spark, str(tmp_path)))
    assert {(r.name, r.size_bytes, r.reason) for r in got.collect()} == {
        ("a.txt", 1, None), ("empty.md", 0, "not readable / empty"), (".hid.txt", 2, None), ("_u.txt", 3, None),
        ("b.md", 1, None), ("c", 1, None)}
    row = got.filter("name = 'a.txt'").first()
    assert abs((row.modified_time - row.created_time).total_seconds()) < 5
    assert S.walk_files(spark, str(tmp_path), recursive=False).count() == 4
    for bad in ("none", "a.txt"):
        with pytest.raises(NotADirectoryError):
            S.walk_files(spark, str(tmp_path / bad))


def test_ledger_on_disk(spark, tmp_path):
    moves = spark.createDataFrame([("s1", 0, "/a", "/r/x/a", 1.0), ("s2", 0, "/b", "/r/y/b", 2.5), ("s2", 1, "/c", "/r/y/c", 2.5)], SE.MOVES)
    sessions = spark.createDataFrame([("s1", "/r", "2024-01-01T00:00:00"), ("s2", "/r", None)], SE.SESSIONS)
    folders = spark.createDataFrame([("s1", 0, "/r/x"), ("s2", 0, "/r/y")], SE.FOLDERS)
    for fmt in ("parquet", "json"):
        out = str(tmp_path / fmt)
        SE.write_ledger(SE.Ledger(sessions, moves, folders), out, fmt)
        back = SE.read_ledger(spark, out, fmt)
        assert sorted(map(tuple, back.moves.collect())) == sorted(map(tuple, moves.collect()))
        assert {tuple(r) for r in back.sessions.collect()} == {tuple(r) for r in sessions.collect()}
        assert {tuple(r) for r in back.folders.collect()} == {tuple(r) for r in folders.collect()}
        assert [r.session_id for r in SE.pruned(back, 1).moves.collect()] == ["s2", "s2"]
        here = spark.createDataFrame([("/r/y/b",), ("/r/y/c",)], "path string")
        for session, left in (("s2", {"s1"}), ("s1", {"s1", "s2"})):  # a session with errors stays
            rest = SE.after_undo(back, G.undo_report(G.undo(back.moves, here, session), session))
            assert {r.session_id for r in rest.sessions.collect()} == left


def test_listing_does_not_read_content(spark, tmp_path):
    (tmp_path / "f.txt").write_text("x")
    plan = C.not_oversize(S.scan_files(spark, str(tmp_path)))._jdf.queryExecution().toString()
    assert "content" not in plan.split("== Physical Plan ==")[1]


def test_sessions_on_disk(spark, tmp_path):
    out = str(tmp_path / "ledger")
    moves = spark.createDataFrame([("20240101_000000", 0, "/a", "/b", 1.0), ("20240102_000000", 0, "/c", "/d", 2.0)], SE.MOVES)
    assert SE.write_session(moves.limit(0), out) is False and SE.read_sessions(spark, out).count() == 0
    assert SE.write_session(moves, out) is True
    with pytest.raises(ValueError):
        SE.write_session(moves.limit(1), out)
    assert [r.session_id for r in G.list_sessions(SE.read_sessions(spark, out)).collect()] == ["20240102_000000", "20240101_000000"]
    assert G.latest_session(SE.read_sessions(spark, out)).first().session_id == "20240102_000000"
    assert G.latest_session(moves.limit(0)).first().message == "No undo sessions found."
    one = SE.read_sessions(spark, out).filter("session_id = '20240101_000000'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(session_id" in one
    files = tmp_path / "json"
    files.mkdir()
    (files / "s.json").write_text('{"session_id": "s", "root_folder": "/r", "created_at": "2024", "records": [{"src": "/a", "dst": "/b"}], "folders_created": ["/f"]}')
    (files / "broken.json").write_text("{")
    sessions, moved, folders = SE.read_session_files(spark, str(files))
    assert [tuple(r) for r in moved.collect()] == [("s", 0, "/a", "/b", 0.0)]
    assert sessions.count() == 1 and folders.first().folder == "/f"


def test_undo_errors(spark):
    moves = spark.createDataFrame([("s", 0, "/a", "/x/a", 0.0), ("s", 1, "/b", "/x/b", 0.0), ("s", 2, "/c", "/x/c", 0.0)], SE.MOVES)
    current = spark.createDataFrame([("/x/a",), ("/x/c",), ("/c",)], "path string")
    rows = G.undo(moves, current, "s").collect()
    assert [(r.seq, r.error) for r in rows] == [(2, "Origin is occupied: /c"), (1, "File no longer at destination: /x/b"), (0, None)]
    assert [r.error for r in G.undo(moves, current, "s", overwrite=True).collect()][0] is None
    assert G.undo(moves, current).count() == 3
    after = {r.path for r in G.undone_catalog(current, G.undo(moves, current, "s")).collect()}
    assert after == {"/a", "/x/c", "/c"}


def test_relation_mode_from_texts_to_plan(spark):
    words = {0: "invoice total amount paid tax", 1: "beach sun travel hotel flight", 2: "python code class import def"}
    files = C.catalog(spark.createDataFrame([(i, f"/r/{i}.txt", 10, None) for i in range(30)], "seq bigint, path string, length bigint, modified timestamp_ntz"))
    extracted = spark.createDataFrame([(f"/r/{i}.txt", words[i % 3] + f" {i}", True) for i in range(29)], "path string, text string, success boolean")
    model = lambda: lambda prompts: ['{"topic": "%s", "summary": "", "keywords": [], "confidence": 0.9}' % (
        "Bills" if "invoice" in p else "Trips" if "beach" in p else "Code") for p in prompts]
    records = enriched_records(files, extracted, model)
    plan = organise(records, "/r", "relation", name_fn=lambda: lambda prompts: [p.split("\n")[1].split(", ")[0] + " Folder\nx" for p in prompts])
    got = {r.src: r.dst for r in plan.collect()}
    assert len(got) == 30
    assert got["/r/0.txt"] == "/r/Bills_Folder/Documents/0.txt" and got["/r/4.txt"] == "/r/Trips_Folder/Documents/4.txt"


def undone_file_by_file(moves, files):
    files, errors = set(files), {}
    for seq, src, dst in sorted(moves, reverse=True):
        if dst not in files:
            errors[seq] = f"File no longer at destination: {dst}"
        elif src in files and src != dst:
            errors[seq] = f"Origin is occupied: {src}"
        else:
            errors[seq] = None
            files = files - {dst} | {src}
    return errors, files


def test_undo_runs_last_move_first(spark):
    """Chains, swaps through a third name, and files that are missing inside a chain."""
    rng = random.Random(8)
    ledgers = [([(0, "/r/T/a", "/r/U/a"), (1, "/x/a", "/r/T/a")], ["/r/U/a", "/r/T/a"]),
               ([(0, "a", "t"), (1, "b", "a"), (2, "t", "b")], ["a", "b"]), ([(0, "a", "b"), (1, "b", "c"), (2, "c", "d")], ["d"]),
               ([(0, "a", "b"), (1, "b", "c"), (2, "c", "d")], ["b"])]
    for _ in range(3):
        ledgers.append(([(k, rng.choice("abcdef"), rng.choice("abcdef")) for k in range(8)], rng.sample("abcdef", 3)))
    for moves, files in ledgers:
        table = spark.createDataFrame([("s", k, a, b) for k, a, b in moves], "session_id string, seq bigint, src string, dst string")
        current = spark.createDataFrame([(f,) for f in files], "path string")
        undone = G.undo(table, current, "s")
        want, after = undone_file_by_file(moves, files)
        assert {r.seq: r.error for r in undone.collect()} == want
        assert sorted(r.path for r in G.undone_catalog(current, undone).collect()) == sorted(after)


def test_undo_of_long_chains_takes_few_rounds(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain; results are those of a run move by move, overwriting or not."""
    rounds = []
    cut = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    n = 300
    chain = [(k, f"/c/{k}", f"/c/{k + 1}") for k in range(n)]
    shifted = [(n + k, f"/s/{k}", f"/s/{k + 1}") for k in range(n - 1, -1, -1)]  # as many files, one place up
    shifted = [(n + i, a, b) for i, (_, a, b) in enumerate(shifted)]
    moves = chain + shifted + [(2 * n, "/self", "/self"), (2 * n + 1, "/void", "/void")]
    files = [f"/c/{n}", "/self"] + [f"/s/{k + 1}" for k in range(n) if k != 7]
    table = spark.createDataFrame([("s", k, a, b) for k, a, b in moves], "session_id string, seq bigint, src string, dst string")
    current = spark.createDataFrame([(f,) for f in files], "path string")
    undone = G.undo(table, current, "s")
    want, after = undone_file_by_file(moves, files)
    assert {r.seq: r.error for r in undone.collect()} == want
    assert len(rounds) <= 12
    assert sorted(r.path for r in G.undone_catalog(current, undone).collect()) == sorted(after)


def test_undo_with_overwriting(spark):
    rng = random.Random(11)
    for _ in range(3):
        moves = [(k, rng.choice("abcde"), rng.choice("abcde")) for k in range(9)]
        files = set(rng.sample("abcde", 3))
        table = spark.createDataFrame([("s", k, a, b) for k, a, b in moves], "session_id string, seq bigint, src string, dst string")
        got = G.undo(table, spark.createDataFrame([(f,) for f in files], "path string"), "s", overwrite=True)
        want, here = {}, set(files)
        for seq, src, dst in sorted(moves, reverse=True):
            want[seq] = None if dst in here else f"File no longer at destination: {dst}"
            if dst in here:
                here = here - {dst} | {src}
        assert {r.seq: r.error for r in got.collect()} == want


def test_failures_of_a_model_are_data(spark):
    """Only rows that fail alone get an error, others of their batch are answered; nulls are no failure."""
    def make():
        def answer(values):
            if any(v % 10 == 3 for v in values):
                raise KeyError("three")
            return [v * 2 for v in values]
        return answer

    df = spark.range(40).withColumn("v", F.when(F.col("id") != 5, F.col("id")))
    scored = E.score_batches(df, make, "v", "twice", "bigint", batch=16, default=-1, error_col="why")
    assert scored.columns == ["id", "v", "twice", "why"]
    for r in scored.collect():
        bad = r.id % 10 == 3
        assert r.twice == (-1 if bad or r.v is None else 2 * r.id)
        assert r.why == ("KeyError: 'three'" if bad else None)
    assert tuple(E.model_report(scored, "why").first()) == (40, 4, "KeyError: 'three'")
    mixed = E.score_batches(df, lambda: lambda vs: ["x" if v == 2 else str(v) if v else 7 for v in vs], "v", "o", default="?", error_col="why")
    assert [(r.id, r.o) for r in mixed.filter("why is not null").collect()] == [(0, "?")]
    assert [tuple(r) for r in E.model_report(scored.limit(0), "why").collect()] == [(0, 0, None)]


def test_slots_of_a_model_follow_a_profile(spark):
    """The stage of the model carries the resource profile; what it needs is not to be had on a local master."""
    needs = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", 1)).build
    scored = E.score_batches(spark.range(3), lambda: lambda v: v, "id", "same", "bigint", error_col="why", profile=needs)
    assert scored.columns == ["id", "same", "why"]
    node = scored._jdf.queryExecution().analyzed()
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    assert node.profile().get().id() == needs.id
    plain = E.score_batches(spark.range(3), lambda: lambda v: v, "id", "same", "bigint")
    assert "MapInArrow" not in plain._jdf.queryExecution().analyzed().toString()
