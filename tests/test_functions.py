import html as stdlib_html
import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import html, paths, replies, text, trees
from shelfmark.operators import grouping


def values(spark, items, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


NAMES = ["a.txt", "a.tar.gz", ".env", ".env.txt", "x.", "noext", "..foo", "a..b", "a.b.", "A.TXT", "..."]


def test_name_parts(spark):
    assert values(spark, NAMES, paths.extension_of) == [".txt", ".gz", "", ".txt", "", "", ".foo", ".b", "", ".txt", ""]
    assert values(spark, NAMES, paths.stem_of) == [
        "a", "a.tar", ".env", ".env", "x.", "noext", ".", "a.", "a.b.", "A", "..."]


def test_category_and_level2(spark):
    exts = [".jpg", ".svg", ".pdf", ".opus", ".m4v", ".rtf", ".py", ""]
    assert values(spark, exts, paths.category_of) == [
        "image", "image", "pdf", "audio", "video", "document", "unknown", "unknown"]
    cats = ["image", "pdf", "audio", "video", "document", "unknown", "other"]
    assert values(spark, cats, paths.level2_of) == ["Images", "PDFs", "Audio", "Video", "Documents", "Other", "Other"]


def test_numbered_and_parents(spark):
    assert values(spark, ["/r/a.t", "/r/.env", "/r.d/noext"], lambda c: paths.numbered(c, F.lit(2))) == [
        "/r/a_2.t", "/r/.env_2", "/r.d/noext_2"]
    assert values(spark, ["/a/b/c.t", "/c.t", "c.t"], paths.parent_of) == ["/a/b", "/", "c.t"]
    assert values(spark, ["/r/a/b", "/r"], lambda c: F.array_join(paths.ancestors_of(c, "/r"), ",")) == ["/r/a,/r/a/b", ""]


SLUGS = {
    "": "", "!!!": "", " _a__b- -c ": "A_B-_-c", "Zürich_é: 日本 (x)!": "Zürich_É_日本_X", "a" * 39 + " b": "A" + "a" * 38,
    "½ cup": "½_Cup", "d\xe9compos\xe9": "D\xe9compos\xe9", "2024-03": "2024-03", "ǆungla": "ǅungla",
    "ΑΣ ΟΔΟΣ": "Ας_Οδος", "tabs\tand\x1cmore\xa0blanks": "Tabs_And_More_Blanks", "MiXeD cAsE": "Mixed_Case",
    "ßtraße": "Sstraße", "a---b": "A-b", "_".join(["ab"] * 30): "_".join(["Ab"] * 13) + "_A"}


def test_slugify(spark):
    assert values(spark, list(SLUGS), text.slugify) == list(SLUGS.values())


def test_strip(spark):
    items = [" \t x \x1f\n", "", " ", "a b"]
    assert values(spark, items, text.py_strip) == [s.strip() for s in items]


def test_csv_cells(spark):
    lines = ["a,b", "", ",a", "a,", '"x, y",z', '"say ""hi""",1', "one"]
    assert values(spark, lines, lambda c: F.array_join(text.csv_cells(c), "|")) == [
        "a|b", "", "|a", "a|", "x, y|z", 'say "hi"|1', "one"]


def test_unescape(spark):
    items = ["a &amp; b", "&lt;&gt;&quot;&#39;&#x41;&#8364;", "&copy; &eacute;", "&nope; & &am", "no refs", "&amp", "&#128512;"]
    assert values(spark, items, html.unescape) == [stdlib_html.unescape(s) for s in items]


def test_html_text(spark):
    page = ("<!DOCTYPE html><html><head><title> T &amp; U </title><style>p{}</style><SCRIPT>if (a<b) '</p>'</SCRIPT></head>"
            "<body><nav><a>x</a></nav><header>h</header>one<!-- c -->two <b> three</b>&nbsp;<p>1 < 2</p><footer>f</footer></body></html>")
    assert values(spark, [page], html.html_text) == ["T & U\none\ntwo\nthree\n1 < 2"]
    assert values(spark, ["<p>a</p>b"], html.strip_tags) == [" a b"]


GOOD = {"topic": "T", "n": [1, {"a": "b"}]}
# replies and what they hold; a list inside a spoiled object parses before the object is repaired
REPLIES = [
    json.dumps(GOOD), "  " + json.dumps(GOOD) + "\n", "```json\n" + json.dumps(GOOD) + "\n```",
    "```\nbad\n``` then ```JSON " + json.dumps(GOOD) + "```", "Sure: " + json.dumps(GOOD) + " done", "see [1, 2] there",
    "{'topic': 'T', 'n': [1, {'a': 'b'}]}", '{"topic": "T", "n": [1, {"a": "b"},],}', "nothing", "", "null", "7",
    '{"a":1} trailing', '{"a":1},{"b":2}', "pre {'a':1}", '{"a":1}] tail', '1],[2', '{"topic":"x", "k": ["q"],}',
]


def test_extract_json(spark):
    got = values(spark, REPLIES, lambda c: F.to_json(replies.extract_json(c)))
    assert [json.loads(g) if g is not None else None for g in got] == [
        GOOD, GOOD, GOOD, GOOD, GOOD, [1, 2], GOOD, GOOD, None, None, None, 7, {"a": 1}, None, None, {"a": 1}, None, ["q"]]


def meta(spark, objects):
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "i int, v string")
    rows = df.select("i", F.parse_json("v").alias("v")).select("i", replies.validate_metadata("v").alias("m")).orderBy("i").collect()
    return [r.m for r in rows]


@pytest.mark.parametrize("raw, want", [(True, 1.0), ("0.8", 0.8), ("nan", 1.0), (None, 0.0), ([], 0.0), (-1, 0.0), (2, 1.0), ("x", 0.0), (0.25, 0.25)])
def test_confidence(spark, raw, want):
    assert meta(spark, [{"confidence": raw}])[0].confidence == want


def test_validate_metadata(spark):
    full = {"topic": "  " + "t" * 90, "summary": "s" * 600 + " ", "keywords": ["a ", "", None, 0, False, [], {}, "0", "false", 3, True]
            + list("bcdefghij"), "confidence": 0.5, "file_date": "2024-01-01"}
    got = meta(spark, [full, {}, {"topic": None, "keywords": "no list"}, [1], "x", {"topic": "", "keywords": [" "]}])
    assert (got[0].topic, got[0].summary, got[0].file_date) == ("t" * 80, "s" * 500, "2024-01-01")
    assert got[0].keywords == ["a", "0", "false", "3", "True", "b", "c", "d", "e", "f"]
    assert tuple(got[1]) == ("Uncategorized", "", [], 0.0, None)
    assert (got[2].topic, got[2].keywords) == ("None", [])
    assert got[3] is None and got[4] is None
    assert (got[5].topic, got[5].keywords) == ("", [""])


def test_cluster_name(spark):
    items = [" Travel Photos \nmore", "", "x" * 60, "\n\n", None]
    assert values(spark, items, replies.cluster_name) == ["Travel Photos", "Miscellaneous", "x" * 50, "Miscellaneous", "Miscellaneous"]


def test_cells_keep_what_follows_a_quote_and_references_with_zeros(spark):
    df = spark.createDataFrame([('"ab"cd,e,"x,""y"', "a&#00000065;b&#x0000042;")], "line string, page string")
    row = df.select(text.csv_cells("line").alias("cells"), html.unescape("page").alias("plain")).first()
    assert row.cells == ["abcd", "e", 'x,"y'] and row.plain == "aAbB"


def test_groups_with_a_null_key_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, o bigint")
    assert sorted(r["rank"] for r in grouping.rank_in_group(df, ["g"], "o").collect()) == [0, 0, 1]


def test_furniture_of_html_goes_with_what_is_nested_in_it(spark):
    pages = ["<header>a<header>b</header>c</header>d", "<div><nav>x</div>y", "<nav>x<p>y", "a<nav/>b", "<nav><br>x</nav>y</nav>z",
             "<script>if (a<b) x</p>", "<p>a<!-- x", "a<i>b</u>c</i>", "", None]
    assert values(spark, pages, html.html_text) == ["d", "y", "", "a\nb", "y\nz", "", "a", "a\nb\nc", "", None]


def test_xml_digest(spark):
    items = ["<a>x<b c='1>2'> y </b>z<d/><e><f>&lt;&#65;</f></e></a>", "<a><!-- c -->x<![CDATA[<y>&]]></a>", "<a><b>x</a></b>",
             "<a>x</a><b/>", "x", "<a>1 & 2</a>", "<a>x</a>y", "<a/>", "", None]
    assert values(spark, items, trees.xml_digest) == ["<a>: x\n  <b>: y\n    <f>: <A", "<a>: x<y>&", *items[2:7], "", "", ""]
    assert values(spark, ["<a>" + "x" * 9000 + "</a>"], trees.xml_digest) == ["<a>: " + "x" * 5995]


def test_json_digest_equals_the_standard_layout(spark):
    items = ['{"a":[1,{"b":"x, {\\"y\\"}: \\\\"}],"c":{},"d":[ ],"e":null}', '[]', '"x"', "[[1,2],[[]]]", "12"]
    assert values(spark, items, trees.json_digest) == [json.dumps(json.loads(i), indent=2, ensure_ascii=False) for i in items]
    assert values(spark, ['{"a":', "plain", "", None], trees.json_digest) == ['{"a":', "plain", "", ""]
    long = json.dumps([['\n"' * 5000]] * 3)
    assert values(spark, [long], trees.json_digest) == [json.dumps(json.loads(long), indent=2)[:8000]]
