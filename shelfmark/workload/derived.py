"""Tables of the file domain derived from the given ones: as Spark frames and as SQL (CTE) text.

Both sides share the SQL where the dialects agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import numbered
from ..operators import catalog as C, enrich as E, layout as L
from ..runtime import cut_lineage
from .registry import Tables

ROOT = "/corpus"

_INVENTORY = """SELECT doc_id,
  concat('/corpus/', source, '/',
         CASE WHEN doc_id % 37 = 0 THEN '.git/' WHEN doc_id % 41 = 0 THEN '__pycache__/' ELSE '' END,
         lang, '/d', CAST(doc_id AS STRING), '/doc_', CAST(doc_id % 60 AS STRING),
         split_part('.txt,.md,.csv,.json,.html,.pdf,.JPG,.png,.mp3,.mp4,.docx,.xyz', ',', CAST(doc_id % 12 + 1 AS INT))) AS path,
  CASE WHEN doc_id % 53 = 0 THEN CAST(0 AS BIGINT)
       WHEN doc_id % 59 = 0 THEN n_chars * 1048576
       ELSE n_chars END AS length,
  <TS> AS modified
FROM {documents}"""
_SPARK_TS = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id * 7 AS INT))"
_DUCK_TS = "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id * 7 AS BIGINT))"

_REPLIES = """SELECT doc_id, CASE doc_id % 7
    WHEN 0 THEN body
    WHEN 1 THEN concat('```json ', body, ' ```')
    WHEN 2 THEN concat('Here you go: ', body, ' Done.')
    WHEN 3 THEN replace(body, 'null}}', 'null,}}')
    WHEN 4 THEN translate(body, chr(34), chr(39))
    WHEN 5 THEN 'no structure at all'
    ELSE replace(replace(body, 'null}}', 'null,}}'), ' k "]', ' k ", ]') END AS reply
FROM (SELECT doc_id, concat('{{"topic": "  ', source, ' ', lang, '", "summary": "s", "keywords": ["', lang,
      '", "", null, " k "], "confidence": ', CAST(doc_id % 131 AS STRING), 'e-2, "file_date": null}}') AS body
      FROM {documents}) t"""

# files f have every text as a page, files g the same pages without a text layer
_PDF_PAGES = """SELECT concat('/corpus/f', CAST(CAST(floor(doc_id / 25) AS BIGINT) AS STRING), '.pdf') AS path,
  doc_id % 25 AS page_no, text, concat('ocr ', lang) AS ocr_text
FROM {documents}
UNION ALL SELECT concat('/corpus/g', CAST(CAST(floor(doc_id / 25) AS BIGINT) AS STRING), '.pdf') AS path,
  doc_id % 25 AS page_no, '' AS text, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE concat('ocr ', lang) END AS ocr_text
FROM {documents}"""

_SEGMENTS = """SELECT concat('/corpus/f', CAST(CAST(floor(doc_id / 25) AS BIGINT) AS STRING), '.mp3') AS path,
  doc_id % 25 AS seq,
  CAST((doc_id % 25) * 40 + CASE WHEN doc_id % 11 = 8 THEN 500 ELSE 0 END AS DOUBLE) AS end_sec,
  text
FROM {documents}"""

_VIDEOS = """SELECT concat('/corpus/v', CAST(event_id AS STRING), '.mp4') AS path, event_id, event_type,
  CASE WHEN event_id % 50 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(event_id % 5000 AS DOUBLE) END AS duration
FROM {events}"""


def _duck(text: str) -> str:
    """The same SQL with bare table names, as the checking engine sees them."""
    text = text.replace("{{", "\0").replace("}}", "\1")
    text = text.replace("{", "").replace("}", "")
    return text.replace("\0", "{").replace("\1", "}").replace(" AS STRING)", " AS VARCHAR)")


INVENTORY_SQL = _duck(_INVENTORY).replace("<TS>", _DUCK_TS)
REPLIES_SQL = _duck(_REPLIES)
PDF_PAGES_SQL = _duck(_PDF_PAGES)
SEGMENTS_SQL = _duck(_SEGMENTS)
VIDEOS_SQL = _duck(_VIDEOS)

# text the checking engine strips like str.strip()
from ..constants import PY_WHITESPACE as _WS  # noqa: E402

WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in _WS) + ")"


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {WS})"


CATALOG_SQL = f"""inv AS ({INVENTORY_SQL}),
named AS (SELECT doc_id AS seq, path, length AS size_bytes, modified AS modified_time,
  regexp_extract(path, '[^/]*$') AS name,
  regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1) AS suffix FROM inv),
cat AS (SELECT *, left(name, length(name) - length(suffix)) AS stem, lower(suffix) AS extension,
  round_even(size_bytes / 1048576.0::DOUBLE, 3) AS size_mb,
  CASE WHEN lower(suffix) IN ('.jpg','.png') THEN 'image' WHEN lower(suffix) = '.pdf' THEN 'pdf'
       WHEN lower(suffix) = '.mp3' THEN 'audio' WHEN lower(suffix) = '.mp4' THEN 'video'
       WHEN lower(suffix) = '.xyz' THEN 'unknown' ELSE 'document' END AS category FROM named),
aud AS (SELECT *, CASE WHEN size_bytes <= 0 THEN 'not readable / empty'
       WHEN size_mb > 500 THEN concat('too large (', CAST(size_mb AS VARCHAR), ' MB > 500.0 MB)') END AS reason
  FROM cat WHERE path NOT LIKE '%/.git/%' AND path NOT LIKE '%/__pycache__/%'),
live AS (SELECT * FROM aud WHERE reason IS NULL)"""

# 3: the comma spoils the object, but the keyword list inside it parses, and a list is no record
METADATA_SQL = """meta AS (SELECT doc_id,
  CASE WHEN doc_id % 7 IN (3, 5) THEN 'Uncategorized' ELSE concat(source, ' ', lang) END AS topic,
  CASE WHEN doc_id % 7 IN (3, 5) THEN '' ELSE 's' END AS summary,
  CASE WHEN doc_id % 7 IN (3, 5) THEN '' ELSE concat(lang, '|k') END AS keywords,
  CASE WHEN doc_id % 7 IN (3, 5) THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, CAST(concat(CAST(doc_id % 131 AS VARCHAR), 'e-2') AS DOUBLE)) END AS confidence
  FROM documents)"""


def slug_sql(expr: str) -> str:
    """Folder-safe name in SQL; its \\s is ASCII only, so the other blanks are listed."""
    kept = f"regexp_replace({expr}, '[^\\p{{L}}\\p{{N}}_\\s\\x1C-\\x1F\\x0B\\x85\\xA0\\p{{Z}}\\-]', '', 'g')"
    joined = f"regexp_replace({strip_sql(kept)}, '[\\s\\x1C-\\x1F\\x0B\\x85\\xA0\\p{{Z}}_]+', '_', 'g')"
    single = f"regexp_replace({joined}, '-+', '-', 'g')"
    words = (f"list_transform(string_split({single}, '_'), lambda w: "
             "concat(replace(upper(left(w, 1)), chr(7838), chr(83) || chr(115)), lower(substr(w, 2))))")
    return f"trim(left(array_to_string({words}, '_'), 40), '_')"


LEVEL2_SQL = ("CASE category WHEN 'image' THEN 'Images' WHEN 'pdf' THEN 'PDFs' WHEN 'audio' THEN 'Audio' "
              "WHEN 'video' THEN 'Video' WHEN 'document' THEN 'Documents' ELSE 'Other' END")


def plan_sql(topic: str, source: str = "live") -> str:
    return f"""plan AS (SELECT seq, src, category, name, topic,
  concat_ws('/', '/corpus', nullif({slug_sql('topic')}, ''), {LEVEL2_SQL}, name) AS dst
  FROM (SELECT seq, path AS src, category, name, {topic} AS topic FROM {source}))"""


DATE_PLAN_SQL = plan_sql("strftime(modified_time, '%Y-%m')")


def number_sql(path: str, counter: str) -> str:
    suffix = f"regexp_extract(regexp_extract({path}, '[^/]*$'), '^.+(\\.[^.]+)$', 1)"
    return (f"CASE WHEN {counter} = 0 THEN {path} ELSE concat(left({path}, length({path}) - length({suffix})), '_', "
            f"CAST({counter} AS VARCHAR), {suffix}) END")


# snapshot: some sources are missing, some first numbered names are taken
EXISTING_SQL = f"""existing AS (SELECT path FROM inv WHERE doc_id % 29 <> 0
  UNION SELECT {number_sql('dst', '1')} FROM plan WHERE seq % 13 = 0)"""

RESOLVED_SQL = f"""{EXISTING_SQL},
claims AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY seq) - 1 AS k FROM plan
  WHERE src IN (SELECT path FROM existing)),
spans AS (SELECT dst, count(*) AS m FROM claims GROUP BY dst),
counters AS (SELECT dst, unnest(generate_series(0, m + 1)) AS c FROM spans),
candidates AS (SELECT dst, c, {number_sql('dst', 'c')} AS cand FROM counters),
free AS (SELECT dst, cand, row_number() OVER (PARTITION BY dst ORDER BY c) - 1 AS k FROM candidates
  WHERE cand NOT IN (SELECT path FROM existing)),
resolved AS (SELECT p.seq, p.src, p.dst, p.category, p.topic, f.cand AS final_dst,
  CASE WHEN c.seq IS NULL THEN concat('Source missing: ', p.name) END AS error
  FROM plan p LEFT JOIN claims c ON p.seq = c.seq LEFT JOIN free f ON c.dst = f.dst AND c.k = f.k)"""

MOVES_SQL = """moves AS (SELECT concat(strftime(modified_time, '%Y%m'), '01_000000') AS session_id,
  row_number() OVER (PARTITION BY strftime(modified_time, '%Y%m') ORDER BY r.seq) - 1 AS seq,
  r.src, r.final_dst AS dst, 0.0::DOUBLE AS ts
  FROM resolved r JOIN live l ON r.seq = l.seq WHERE r.error IS NULL)"""

# at undo: some files are gone, some origins are occupied
CURRENT_SQL = """current_files AS (SELECT dst AS path FROM moves WHERE (seq + 1) % 17 <> 0
  UNION SELECT src FROM moves WHERE seq % 19 = 5)"""

LEDGER_SQL = ", ".join([CATALOG_SQL, DATE_PLAN_SQL, RESOLVED_SQL, MOVES_SQL])


def inventory(t: Tables) -> DataFrame:
    return t.sql(_INVENTORY.replace("<TS>", _SPARK_TS))


def catalog(t: Tables) -> DataFrame:
    return C.catalog(inventory(t).withColumnRenamed("doc_id", "seq"))


def live(t: Tables) -> DataFrame:
    return C.live_files(catalog(t))


def replies(t: Tables) -> DataFrame:
    return t.sql(_REPLIES)


def metadata(t: Tables) -> DataFrame:
    return E.enrich(replies(t)).select(F.col("doc_id").alias("seq"), "metadata.*")


def enriched(t: Tables) -> DataFrame:
    return live(t).join(metadata(t), "seq")


def pdf_pages(t: Tables) -> DataFrame:
    return t.sql(_PDF_PAGES)


def segments(t: Tables) -> DataFrame:
    return t.sql(_SEGMENTS)


def videos(t: Tables) -> DataFrame:
    return t.sql(_VIDEOS)


def frames(t: Tables) -> DataFrame:
    numbers = F.explode(F.sequence(F.lit(1), F.lit(5)))
    described = videos(t).select("path", "event_id", "event_type", numbers.alias("frame_no"))
    return described.select("path", "frame_no", F.when(
        (F.col("event_id") + F.col("frame_no")) % 4 == 0, F.lit("")).otherwise(F.col("event_type")).alias("description"))


def date_plan(t: Tables) -> DataFrame:
    return L.build_plan(live(t), ROOT, "date")


def existing(t: Tables) -> DataFrame:
    here = inventory(t).filter(F.col("doc_id") % 29 != 0).select("path")
    named = date_plan(t).filter(F.col("seq") % 13 == 0).select(numbered("dst", F.lit(1)).alias("path"))
    return cut_lineage(here.unionByName(named).distinct())
