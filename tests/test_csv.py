"""CSV records against Python's reader: whole texts in one value, and lines of files read in ranges."""

import csv
import io
import random

from pyspark.sql import functions as F

from shelfmark.operators import assemble as A, grouping as G
from shelfmark.sources import files as S

CASES = ["", "\n", "a", '"', '""', '"""', '""""', '"a\nb",c', '"a\r\nb",c\r\nd', 'a"b,"c""d"x"y,\n\n1', '"a"b""c,d\n', "a\rb\r", '"x\n',
         '"open\n\nto the end\n', ',"",', '"a",\n,"b"\n""\n']


def random_texts(n: int, length: int) -> list[str]:
    draw = random.Random(7)
    return ["".join(draw.choice('ab"",,\n ') for _ in range(draw.randrange(length))) for _ in range(n)]


def expected(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text, newline="")))


def records(rows) -> dict:
    found: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.path, r.row_no)):
        assert r.row_no == len(found.setdefault(r.path, []))
        found[r.path].append(r.cells)
    return found


def test_texts_equal_pythons_reader(spark):
    texts = CASES + random_texts(600, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    got = records(A.csv_rows(df, 1000))
    for i, text in enumerate(texts):
        assert got.get(i, []) == expected(text), text


def test_cap_keeps_one_record_more(spark):
    df = spark.createDataFrame([("p", "\n".join(f'"{i}\n{i}",x' for i in range(9)))], "path string, text string")
    assert records(A.csv_rows(df, 3)) == {"p": [[f"{i}\n{i}", "x"] for i in range(4)]}
    assert A.csv_digest(A.csv_rows(df, 3), 3).first().text == "0\n0, x\n1\n1, x\n2\n2, x\n... (3 rows total)"


def test_a_long_cell_of_doubled_quotes(spark):
    df = spark.createDataFrame([("p", '"' + '""' * 100000 + '",b')], "path string, text string")
    assert records(A.csv_rows(df)) == {"p": [['"' * 100000, "b"]]}


def test_lines_equal_pythons_reader(spark):
    texts = [t for t in CASES + random_texts(300, 60) if t and "\r" not in t]
    rows = [(i, k, line) for i, t in enumerate(texts) for k, line in enumerate(t.removesuffix("\n").split("\n"))]
    lines = spark.createDataFrame(rows, "path int, line_no bigint, line string")
    got = records(A.csv_rows_of_lines(lines, None))
    for i, text in enumerate(texts):
        # a cell that is open at the end has the last line break or not: lines do not tell
        want = [[c.rstrip("\n") for c in r] for r in expected(text)]
        assert [[c.rstrip("\n") for c in r] for r in got[i]] == want, text


def test_running_last(spark):
    draw = random.Random(3)
    rows = [(g, i, draw.choice([None, None, i])) for g in (None, "a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint")
    got = {(r.g, r.i): r.out for r in G.running_last(df, ["g"], "i", F.col("v"), "out", bits=2).collect()}
    for g in (None, "a", "b"):
        last = None
        for _, i, v in (r for r in rows if r[0] == g):
            assert got[g, i] == last
            last = v if v is not None else last


def test_a_file_is_read_in_ranges(spark, tmp_path):
    """Many tasks read one file; its lines and records are those of the whole file, code points included."""
    text = "".join(f'é{i},"zwei\nZeilen {"ü" * (i % 50)}",{i}\n' for i in range(4000))
    (tmp_path / "big.csv").write_bytes(text.encode() + b"bad \xff byte,,\n")
    (tmp_path / "small.csv").write_text("a,b\r\nc,d")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = S.read_text_lines(spark, str(tmp_path))
        got = {p: [r.line for r in sorted(rs, key=lambda r: r.line_no)] for p, rs in _by_path(lines).items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = {r.path: r.text for r in S.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {p: t.removesuffix("\n").split("\n") for p, t in whole.items()}
    assert lines.groupBy("path").agg(F.max("line_no")).count() == 2
    rows = records(A.csv_rows_of_lines(lines, None))
    assert rows == {p: expected(t) for p, t in whole.items()}


def _by_path(lines):
    found: dict = {}
    for r in lines.collect():
        found.setdefault(r.path, []).append(r)
    return found
