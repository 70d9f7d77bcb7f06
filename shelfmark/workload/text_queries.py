from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import assemble as A, routing as R
from ..runtime import cut_lineage
from . import derived as D
from .registry import query

WITH = "WITH " + D.CATALOG_SQL + " "
TEXTS = WITH[:-1] + ", texts AS (SELECT l.*, d.text, d.lang, d.source FROM live l JOIN documents d ON l.seq = d.doc_id) "


def _texts(t):
    docs = t.documents.select(F.col("doc_id").alias("seq"), "text", "lang", "source")
    return D.live(t).join(docs, "seq")


ROUTE_SQL = """CASE WHEN category = 'unknown' THEN 'fallback' WHEN category <> 'document' THEN category
  WHEN extension = '.csv' THEN 'csv' WHEN extension = '.json' THEN 'json' WHEN extension = '.html' THEN 'html'
  WHEN extension = '.docx' THEN 'paragraphs' ELSE 'plain' END"""


@query("route_category", WITH + f"SELECT seq, extension, category, {ROUTE_SQL} AS route FROM live")
def route_category(t):
    return R.route(D.live(t)).select("seq", "extension", "category", "route")


def _and_without(df, text, key="seq"):
    """All rows, and all of them once more (key + AGAIN) with ``text`` in place of theirs."""
    return df.unionByName(df.withColumns({key: F.col(key) + AGAIN, "text": text}))


AGAIN = 1000000000
TWICE = TEXTS + f", twice AS (SELECT seq, name, category, text FROM texts UNION ALL SELECT seq + {AGAIN}, name, category, '' FROM texts) "


@query("fallback_text", TWICE + """SELECT seq, left(text, 4000) AS text,
  CASE WHEN text = '' THEN concat('No pipeline for category ''', category, '''') ELSE 'none' END AS error FROM twice""")
def fallback_text(t):
    return R.fallback_text(_and_without(_texts(t), F.lit(""))).select("seq", "text", F.coalesce("error", F.lit("none")).alias("error"))


# every text as it stands, within white space and with an error; and no text, and white space only
OUTCOME_TEXT = "CASE k WHEN 1 THEN concat(chr(32), chr(10), text, chr(9)) WHEN 2 THEN concat(chr(32), chr(9)) WHEN 3 THEN '' ELSE text END"


@query("extract_outcome", f"""SELECT doc_id * 5 + k AS doc_id, {D.strip_sql(OUTCOME_TEXT)} AS text,
  k <> 4 AND {OUTCOME_TEXT} <> '' AS success FROM documents, range(5) AS r(k)""")
def extract_outcome(t):
    cases = t.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    raw = cases.select((F.col("doc_id") * 5 + F.col("k")).alias("doc_id"), F.expr(OUTCOME_TEXT).alias("text"),
                       F.when(F.col("k") == 4, F.lit("broken")).alias("error"))
    return R.outcome(raw).select("doc_id", "text", "success")


@query("text_or_default", TWICE + """SELECT seq, CASE WHEN text = ''
  THEN concat('File: ', name, ' (type: ', category, ')') ELSE text END AS text FROM twice""")
def text_or_default(t):
    return R.text_or_default(_and_without(_texts(t), F.lit(None).cast("string"))).select("seq", "text")


@query("document_text", TEXTS + """SELECT path, CASE WHEN text = '' THEN '' ELSE
  concat('[Document: ', name, ']', chr(10), chr(10), left(text, 8000)) END AS text,
  CASE WHEN text = '' THEN 'No text extracted from document' ELSE 'none' END AS error FROM texts""")
def document_text(t):
    return A.document_text(_texts(t).select("path", "text")).select(
        "path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error", F.lit("none")).alias("error"))


# every text as it stands, and once more with quoted cells that hold commas, doubled quotes and line breaks
CSV_TEXT = ("CASE k WHEN 0 THEN text ELSE concat('x,\"', replace(replace(replace(text, concat('.', chr(10)), "
            "concat('\"', chr(13), chr(10), '\"')), ', ', '\",\"'), ' e', '\"\"e'), '\"') END")
CSV_PIECES_SQL = r"""regexp_extract_all(concat(chr(10), text),
  '(?:,|\r\n|\r|\n)(?:"[^"]*(?:"|\z)|[^",\r\n][^,\r\n]*|)|"[^"]*(?:"|\z)|[^",\r\n][^,\r\n]*')"""


def _csv_sql(key: str, source: str) -> str:
    """csv_cells (key, row_no, cell, c): the cells of the first 101 records of each text of ``source``."""
    return rf"""csv_parts AS (SELECT {key}, {CSV_PIECES_SQL} AS p FROM {source} WHERE text <> ''),
  csv_pieces AS (SELECT {key}, unnest(p) AS s, unnest(range(len(p))) AS i, len(p) - 1 AS last FROM csv_parts),
  csv_kept AS (SELECT *, regexp_matches(s, '^[\r\n]') AS opens, regexp_matches(s, '^[,\r\n]') AS cuts FROM csv_pieces
    WHERE i < last OR i = 0 OR NOT regexp_full_match(s, '[\r\n]+')),
  csv_numbered AS (SELECT *, sum(opens::INT) OVER w - 1 AS row_no, sum(cuts::INT) OVER w AS cell
    FROM csv_kept WINDOW w AS (PARTITION BY {key} ORDER BY i)),
  csv_cells AS (SELECT {key}, row_no, cell, string_agg(CASE WHEN starts_with(s, '"') THEN concat('"', replace(s, '"', ''))
      WHEN regexp_matches(s, '^[,\r\n]+"') THEN replace(regexp_replace(s, '^(,|\r\n|\r|\n)', ''), '"', '')
      ELSE regexp_replace(s, '^(,|\r\n|\r|\n)', '') END, '' ORDER BY i) AS c FROM csv_numbered WHERE row_no <= 100 GROUP BY ALL)"""


@query("csv_rows", f"""WITH texts AS (SELECT doc_id * 2 + k AS doc_id, {CSV_TEXT} AS text FROM documents, range(2) AS r(k) WHERE text <> ''),
  {_csv_sql('doc_id', 'texts')}
  SELECT doc_id, row_no::BIGINT AS row_no, string_agg(c, chr(31) ORDER BY cell) AS cells FROM csv_cells GROUP BY ALL""")
def csv_rows(t):
    cases = t.documents.filter("text <> ''").select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    rows = A.csv_rows(cases.select((F.col("doc_id") * 2 + F.col("k")).alias("path"), F.expr(CSV_TEXT).alias("text")))
    return rows.select(F.col("path").alias("doc_id"), "row_no", F.array_join("cells", "\u001f").alias("cells"))


@query("csv_digest", """WITH rows AS (SELECT concat('/corpus/t', CAST(doc_id // 250 AS VARCHAR), '.csv') AS path,
    doc_id % 250 AS row_no, array_to_string(string_split(text, ' '), ', ') AS line FROM documents),
  lines AS (SELECT path, row_no, CASE WHEN row_no = 100 THEN '... (100 rows total)' ELSE line END AS line
    FROM rows WHERE row_no <= 100)
  SELECT path, string_agg(line, chr(10) ORDER BY row_no) AS text FROM lines GROUP BY path""")
def csv_digest(t):
    rows = t.documents.select(
        F.concat(F.lit("/corpus/t"), F.floor(F.col("doc_id") / 250).cast("string"), F.lit(".csv")).alias("path"),
        (F.col("doc_id") % 250).alias("row_no"), F.split("text", " ").alias("cells"))
    return A.csv_digest(rows)


def _html_sql() -> str:
    text = "replace(html, chr(1), ' ')"
    for tag in K.HTML_DROPPED_TAGS:
        text = f"regexp_replace({text}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(1), 'g')"
    text = f"regexp_replace({text}, '(?s)<!--.*?-->', chr(1), 'g')"
    text = f"regexp_replace({text}, '</?[A-Za-z][^>]*>|<[!?][^>]*>', chr(1), 'g')"
    # the references that occur in the pages; &amp last, as it makes new ampersands
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&copy;", "chr(169)"),
                       ("&middot;", "chr(183)"), ("&nbsp;", "chr(160)"), ("&#39;", "chr(39)")):
        text = f"replace({text}, '{name}', {char})"
    text = f"regexp_replace({text}, '&amp;?', '&', 'g')"
    nodes = f"list_filter(list_transform(string_split({text}, chr(1)), lambda n: {D.strip_sql('n')}), lambda n: n <> '')"
    return f"left(array_to_string({nodes}, chr(10)), 6000)"


@query("html_text", f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_text(t):
    return A.html_text(t.pages.select("page_id", "html"))


@query("html_strip_tags", "SELECT page_id, left(regexp_replace(html, '<[^>]+>', ' ', 'g'), 6000) AS text FROM pages")
def html_strip_tags(t):
    return A.html_strip_tags(t.pages.select("page_id", "html"))


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("xml_digest", f"""SELECT kind, doc_id, CASE kind WHEN 'broken' THEN concat('<doc><text>', {_ESCAPED}, '</text>') ELSE
  left(array_to_string(list_filter([concat('  <source>: ', source), concat('    <lang>: ', lang),
    CASE WHEN {D.strip_sql('text')} <> '' THEN concat('  <text>: ', {D.strip_sql('text')}) END], lambda l: l IS NOT NULL), chr(10)), 6000) END AS text
  FROM documents, (VALUES ('whole'), ('broken')) AS kinds(kind)""")
def xml_digest(t):
    """Every document as XML, and once more without its last end tag."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    whole = F.concat(F.lit('<?xml version="1.0"?>\n<doc id="a>b"><!-- c --><source>'), "source", F.lit("</source>\n<meta><lang>"),
                     "lang", F.lit("</lang>tail</meta><empty/><text>"), escaped, F.lit("</text></doc>\n"))
    kinds = F.array(F.struct(F.lit("whole").alias("kind"), whole.alias("text")),
                    F.struct(F.lit("broken").alias("kind"), F.concat(F.lit("<doc><text>"), escaped, F.lit("</text>")).alias("text")))
    return A.xml_digest(t.documents.select("doc_id", F.explode(kinds).alias("k")).select("k.kind", "doc_id", "k.text"))


@query("json_digest", """SELECT kind, doc_id, CASE kind WHEN 'broken' THEN concat('{"text": ', CAST(to_json(text) AS VARCHAR)) ELSE
  left(concat('{', chr(10), '  "id": ', doc_id, ',', chr(10), '  "meta": {', chr(10), '    "lang": "', lang, '",', chr(10), '    "none": []', chr(10),
    '  },', chr(10), '  "text": ', CAST(to_json(text) AS VARCHAR), ',', chr(10), '  "rest": [', chr(10), '    1.5,', chr(10), '    {}', chr(10), '  ]', chr(10), '}'), 8000) END AS text
  FROM documents, (VALUES ('whole'), ('broken')) AS kinds(kind)""")
def json_digest(t):
    """Every document as JSON, and once more without its end."""
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    whole = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(', "meta":{"lang":"'), "lang", F.lit('","none":[ ]},\n"text" : '),
                     quoted, F.lit(',"rest":[1.5,{ }]}'))
    kinds = F.array(F.struct(F.lit("whole").alias("kind"), whole.alias("text")),
                    F.struct(F.lit("broken").alias("kind"), F.concat(F.lit('{"text": '), quoted).alias("text")))
    return A.json_digest(t.documents.select("doc_id", F.explode(kinds).alias("k")).select("k.kind", "doc_id", "k.text"))


@query("paragraph_join", """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)),
  lambda p: p <> ''), chr(10)) AS text FROM documents""")
def paragraph_join(t):
    paragraphs = t.documents.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return A.paragraph_join(paragraphs).select(F.col("path").alias("doc_id"), "text")


@query("slide_digest", f"""WITH shapes AS (SELECT conv_id, turn + 1 AS slide_no,
    unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS shape_no FROM conversations),
  clean AS (SELECT conv_id, slide_no, shape_no, {D.strip_sql('text')} AS text FROM shapes),
  slides AS (SELECT conv_id, slide_no, string_agg(text, ' | ' ORDER BY shape_no) FILTER (text <> '') AS body
    FROM clean GROUP BY conv_id, slide_no)
  SELECT concat('/corpus/c', CAST(conv_id AS VARCHAR), '.pptx') AS path, coalesce(string_agg(
    concat('[Slide ', CAST(slide_no AS VARCHAR), ']: ', body), chr(10) ORDER BY slide_no) FILTER (body IS NOT NULL), '') AS text
  FROM slides GROUP BY conv_id""")
def slide_digest(t):
    shapes = t.conversations.select(
        F.concat(F.lit("/corpus/c"), F.col("conv_id").cast("string"), F.lit(".pptx")).alias("path"),
        (F.col("turn") + 1).alias("slide_no"), F.posexplode(F.split("text", "\n")).alias("shape_no", "text"))
    return A.slide_digest(shapes)


@query("sheet_digest", """WITH cells AS (SELECT concat('/corpus/w', CAST(doc_id // 250 AS VARCHAR), '.xlsx') AS path,
    doc_id % 3 AS sheet_no, (doc_id % 250) // 3 AS row_no, doc_id % 10 = 0 AS blank,
    concat(source, ' | ', ' | ', lang) AS line FROM documents),
  sheets AS (SELECT path, sheet_no, string_agg(CASE WHEN row_no = 50 THEN '...' WHEN NOT blank THEN line END, chr(10)
    ORDER BY row_no) AS body FROM cells WHERE row_no <= 50 GROUP BY path, sheet_no)
  SELECT path, left(coalesce(string_agg(concat('[Sheet: s', CAST(sheet_no AS VARCHAR), ']', chr(10), body), chr(10) || chr(10)
    ORDER BY sheet_no) FILTER (body IS NOT NULL), ''), 6000) AS text FROM sheets GROUP BY path""")
def sheet_digest(t):
    blank = F.col("doc_id") % 10 == 0
    value = lambda c: F.when(~blank, c).otherwise(F.lit(""))
    cells = t.documents.select(
        F.concat(F.lit("/corpus/w"), F.floor(F.col("doc_id") / 250).cast("string"), F.lit(".xlsx")).alias("path"),
        (F.col("doc_id") % 3).alias("sheet_no"), F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("sheet"),
        F.floor(F.col("doc_id") % 250 / 3).alias("row_no"),
        F.array(value(F.col("source")), F.lit(None).cast("string"), value(F.col("lang"))).alias("cells"))
    return A.sheet_digest(cells)


@query("pdf_text", f"""WITH pages_ AS ({D.PDF_PAGES_SQL}),
  parts AS (SELECT path, page_no, length({D.strip_sql('text')}) > 50 AS native, {D.strip_sql('text')} AS text,
    nullif({D.strip_sql('ocr_text')}, '') AS ocr FROM pages_),
  marked AS (SELECT path, page_no, NOT native AND ocr IS NOT NULL AS by_ocr, CASE
    WHEN native THEN concat('[Page ', CAST(page_no + 1 AS VARCHAR), ']', chr(10), text)
    WHEN ocr IS NOT NULL THEN concat('[Page ', CAST(page_no + 1 AS VARCHAR), ' - OCR]', chr(10), ocr) END AS part FROM parts)
  SELECT path, left(concat('[PDF: ', regexp_extract(path, '[^/]*$'), ' | ', CAST(count(*) AS VARCHAR), ' pages]', chr(10), chr(10),
      coalesce(string_agg(part, chr(10) || chr(10) ORDER BY page_no) FILTER (page_no < 10 AND part IS NOT NULL), '')), 12000) AS text,
    count(*) AS total_pages, count(*) FILTER (page_no < 10) AS pages_processed,
    coalesce(bool_or(by_ocr) FILTER (page_no < 10), false) AS ocr_used
  FROM marked GROUP BY path""")
def pdf_text(t):
    return A.pdf_text(D.pdf_pages(t))


@query("transcript_text", f"""WITH seg AS ({D.SEGMENTS_SQL}),
  cut AS (SELECT *, coalesce(bool_or(end_sec > 600) OVER (PARTITION BY path ORDER BY seq), false) AS late FROM seg),
  kept AS (SELECT path, string_agg({D.strip_sql('text')}, ' ' ORDER BY seq) AS body, arg_max(end_sec, seq) AS last, count(*) AS n
    FROM cut WHERE NOT late GROUP BY path)
  SELECT p.path, CASE WHEN coalesce(body, '') = '' THEN '' ELSE concat('[Audio Transcript: ', regexp_extract(p.path, '[^/]*$'), ']', chr(10), chr(10), body) END AS text,
    CASE WHEN coalesce(body, '') = '' THEN 'No speech detected in audio' ELSE 'none' END AS error,
    round_even(coalesce(last, 0.0), 1) AS duration_sec, coalesce(n, 0) AS segment_count
  FROM (SELECT DISTINCT path FROM seg) p LEFT JOIN kept k ON p.path = k.path""")
def transcript_text(t):
    return A.transcript_text(D.segments(t)).select(
        "path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error", F.lit("none")).alias("error"),
        "duration_sec", "segment_count")


@query("frame_times", f"""WITH v AS ({D.VIDEOS_SQL}), c AS (SELECT path, least(duration, 3600.0::DOUBLE) AS d FROM v WHERE duration IS NOT NULL)
  SELECT path, CAST(i AS INTEGER) AS frame_no, round(d / 6 * i, 6) AS at_sec, 'none' AS error FROM c, range(1, 6) r(i)
  UNION ALL SELECT path, 0, -1.0::DOUBLE, 'Could not read video metadata' FROM v WHERE duration IS NULL""")
def frame_times(t):
    return A.frame_times(D.videos(t)).select(
        "path", F.coalesce("frame_no", F.lit(0)).alias("frame_no"),
        F.coalesce(F.round("at_sec", 6), F.lit(-1.0)).alias("at_sec"), F.coalesce("error", F.lit("none")).alias("error"))


@query("frame_text", f"""WITH v AS ({D.VIDEOS_SQL}),
  f AS (SELECT path, i, CASE WHEN (event_id + i) % 4 = 0 THEN '' ELSE event_type END AS d FROM v, range(1, 6) r(i)),
  g AS (SELECT path, string_agg(concat('[Frame ', CAST(i AS VARCHAR), ']: ', d), chr(10) || chr(10) ORDER BY i) FILTER (d <> '') AS body,
    count(*) FILTER (d <> '') AS n FROM f GROUP BY path)
  SELECT v.path, CASE WHEN duration IS NULL THEN '' ELSE concat('[Video File: ', regexp_extract(v.path, '[^/]*$'), ' | Duration: ',
      CAST(CAST(round_even(least(duration, 3600), 0) AS BIGINT) AS VARCHAR), 's]', chr(10), chr(10), body) END AS text,
    CASE WHEN duration IS NULL THEN 'Could not read video metadata' ELSE 'none' END AS error,
    CASE WHEN duration IS NULL THEN 0 ELSE n END AS frames_analyzed
  FROM v JOIN g ON v.path = g.path""")
def frame_text(t):
    return A.frame_text(D.videos(t).select("path", "duration"), D.frames(t)).select(
        "path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error", F.lit("none")).alias("error"),
        "frames_analyzed")


# pictures p are described by every text, pictures q have no description
IMAGE_SQL = """SELECT concat('/corpus/', kind, CAST(doc_id AS VARCHAR), '.jpg') AS path,
    CASE WHEN kind = 'p' THEN text ELSE '' END AS description,
    CASE WHEN doc_id % 5 <> 1 THEN n_chars END AS width, n_chars * 2 AS height,
    CASE WHEN doc_id % 5 <> 1 THEN 'RGB' END AS mode, lang, source, doc_id FROM documents, (VALUES ('p'), ('q')) AS kinds(kind)"""


@query("image_text", f"""WITH im AS ({IMAGE_SQL}),
  named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM im),
  known AS (SELECT *, concat_ws(' | ', CASE WHEN width IS NOT NULL THEN concat('Size: ', CAST(width AS VARCHAR), 'x', CAST(height AS VARCHAR)) END,
    CASE WHEN mode IS NOT NULL THEN concat('Mode: ', mode) END,
    CASE WHEN doc_id % 5 IN (2, 3) THEN concat('Model: ', source, ' | Make: ', lang) END) AS facts FROM named),
  final AS (SELECT *, CASE WHEN description <> '' THEN description WHEN facts <> '' THEN concat('Image file: ', name, ' | ', facts) END AS d FROM known)
  SELECT path, CASE WHEN d IS NULL THEN '' ELSE concat('[Image File: ', name, ']', chr(10), d) END AS text,
    CASE WHEN d IS NULL THEN 'Vision model returned no output' ELSE 'none' END AS error FROM final""")
def image_text(t):
    base = t.documents.withColumn("kind", F.explode(F.array(F.lit("p"), F.lit("q")))).withColumn(
        "path", F.concat(F.lit("/corpus/"), F.col("kind"), F.col("doc_id").cast("string"), F.lit(".jpg")))
    there = F.col("doc_id") % 5 != 1
    images = base.select("path", F.when(F.col("kind") == "p", F.col("text")).otherwise(F.lit("")).alias("description"),
                         F.when(there, F.col("n_chars")).alias("width"), (F.col("n_chars") * 2).alias("height"),
                         F.when(there, F.lit("RGB")).alias("mode"))
    tagged = F.array(F.struct(F.lit(9).alias("tag_no"), F.lit("Make").alias("tag"), F.col("lang").alias("value")),
                     F.struct(F.lit(4).alias("tag_no"), F.lit("Model").alias("tag"), F.col("source").alias("value")),
                     F.struct(F.lit(1).alias("tag_no"), F.lit("Orientation").alias("tag"), F.lit("1").alias("value")))
    tags = base.filter((F.col("doc_id") % 5).isin(2, 3)).select("path", F.explode(tagged).alias("t")).select("path", "t.*")
    return A.image_text(images, tags).select(
        "path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error", F.lit("none")).alias("error"))


def assembled(t):
    """Every live file of the catalog with the text its kind of assembler makes."""
    texts = cut_lineage(R.route(_texts(t)))

    def of(*routes):
        return texts.filter(F.col("route").isin(*routes))

    plain = A.document_text(of("plain").select("path", "text"))
    trees = A.document_text(A.json_digest(of("json").select("path", "text")).unionByName(
        A.xml_digest(of("xml").select("path", "text"))))
    csv = A.document_text(A.csv_digest(A.csv_rows(of("csv").select("path", "text"))))
    html = A.document_text(A.html_text(of("html").select("path", F.col("text").alias("html"))))
    paragraphs = of("paragraphs").select("path", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    docx = A.document_text(A.paragraph_join(paragraphs, K.DOCUMENT_CHARS))
    pdf = A.pdf_text(of("pdf").select("path", F.lit(0).alias("page_no"), "text", F.col("lang").alias("ocr_text")))
    pdf = pdf.withColumn("error", F.lit(None).cast("string")).withColumn("extra", F.create_map(
        F.lit("total_pages"), F.col("total_pages").cast("string")))
    audio = A.transcript_text(of("audio").select("path", F.lit(0).alias("seq"), F.lit(5.0).alias("end_sec"), "text"))
    video_files = of("video").select("path", F.lit(90.0).alias("duration"))
    video = A.frame_text(video_files, of("video").select("path", F.lit(1).alias("frame_no"), F.col("text").alias("description")))
    image = A.image_text(of("image").select("path", F.col("text").alias("description"), F.lit(None).cast("int").alias("width"),
                                            F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("mode")))
    unknown = R.fallback_text(of("fallback").select("path", "category", "text"))
    frames = [plain, trees, csv, html, docx, pdf, audio, video, image, unknown]
    return R.extract_all(D.live(t), frames)


ASSEMBLED_SQL = TEXTS + f""", routed AS (SELECT *, {ROUTE_SQL} AS route FROM texts),
  csv_files AS (SELECT path, text FROM routed WHERE route = 'csv'), {_csv_sql('path', 'csv_files')},
  csv_each AS (SELECT path, row_no, string_agg(c, ', ' ORDER BY cell) AS line FROM csv_cells GROUP BY ALL),
  csv_text AS (SELECT path, string_agg(CASE WHEN row_no = 100 THEN '... (100 rows total)' ELSE line END,
    chr(10) ORDER BY row_no) AS csv FROM csv_each GROUP BY path),
  body AS (SELECT r.*, CASE route WHEN 'csv' THEN csv WHEN 'html' THEN {_html_sql().replace('(html,', '(text,')}
    WHEN 'paragraphs' THEN array_to_string(list_filter(string_split(text, chr(10)), lambda p: p <> ''), chr(10)) ELSE text END AS b
    FROM routed r LEFT JOIN csv_text c ON r.path = c.path),
  made AS (SELECT *, CASE
    WHEN category = 'document' THEN concat('[Document: ', name, ']', chr(10), chr(10), left(b, 8000))
    WHEN category = 'pdf' THEN left(concat('[PDF: ', name, ' | 1 pages]', chr(10), chr(10), CASE WHEN length({D.strip_sql('b')}) > 50
      THEN concat('[Page 1]', chr(10), {D.strip_sql('b')}) ELSE concat('[Page 1 - OCR]', chr(10), lang) END), 12000)
    WHEN category = 'audio' THEN concat('[Audio Transcript: ', name, ']', chr(10), chr(10), {D.strip_sql('b')})
    WHEN category = 'video' THEN concat('[Video File: ', name, ' | Duration: 90s]', chr(10), chr(10), '[Frame 1]: ', b)
    WHEN category = 'image' AND size_mb > 20 THEN ''
    WHEN category = 'image' THEN concat('[Image File: ', name, ']', chr(10), b)
    ELSE left(b, 4000) END AS full_text,
    CASE WHEN category = 'image' AND size_mb > 20 THEN concat('Image too large: ', CAST(size_mb AS VARCHAR), ' MB > 20 MB') ELSE 'none' END AS error FROM body),
  done AS (SELECT seq, path, category, {D.strip_sql('full_text')} AS text, error, error = 'none' AND full_text <> '' AS success FROM made) """


@query("route_all", ASSEMBLED_SQL + "SELECT * FROM done")
def route_all(t):
    return assembled(t).select("seq", "path", "category", "text", F.coalesce("error", F.lit("none")).alias("error"), "success")


@query("extract_report", ASSEMBLED_SQL + "SELECT count(*) FILTER (success) AS ok, count(*) AS total FROM done")
def extract_report(t):
    return R.extract_report(assembled(t))
