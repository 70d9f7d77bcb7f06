from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import slugify as slug
from ..operators import layout as L
from ..operators.conflicts import resolve_conflicts as resolve
from ..plans.organise import organise
from ..runtime import cut_lineage, scratch_path
from ..sources import files as S
from . import derived as D
from .registry import query

CAT = "WITH " + D.CATALOG_SQL + " "
ENRICHED = "WITH " + D.CATALOG_SQL + ", " + D.METADATA_SQL + (
    ", enriched AS (SELECT l.*, m.topic, m.confidence FROM live l JOIN meta m ON l.seq = m.doc_id) ")
TOPIC_SQL = "CASE WHEN topic = '' OR confidence < 0.55 THEN 'Miscellaneous' ELSE topic END"
LABEL_SQL = "CASE WHEN seq % 11 = 0 THEN '' WHEN seq % 7 = 0 THEN 'misc' WHEN seq % 5 = 0 THEN 'Named, by hand' ELSE concat('cluster_', CAST(seq % 3 AS VARCHAR)) END"
RELATION_SQL = f"""CASE WHEN {LABEL_SQL} = '' THEN 'Miscellaneous' WHEN topic <> '' AND {LABEL_SQL} LIKE 'cluster\\_%' ESCAPE '\\' THEN topic ELSE {LABEL_SQL} END"""


def _labelled(t):
    seq = F.col("seq")
    label = (F.when(seq % 11 == 0, F.lit("")).when(seq % 7 == 0, F.lit("misc"))
             .when(seq % 5 == 0, F.lit("Named, by hand")).otherwise(F.concat(F.lit("cluster_"), (seq % 3).cast("string"))))
    return D.enriched(t).withColumn("cluster_label", label)


@query("topic_folder", ENRICHED + f"SELECT seq, {TOPIC_SQL} AS level1 FROM enriched")
def topic_folder(t):
    return D.enriched(t).select("seq", L.topic_folder().alias("level1"))


@query("date_folder", CAT + """SELECT seq, CASE WHEN seq % 10 = 3 THEN 'Unknown_Date' ELSE strftime(modified_time, '%Y-%m') END AS level1,
  strftime(modified_time, '%Y-%m') AS level1_typed FROM live""")
def date_folder(t):
    text = F.when(F.col("seq") % 20 == 3, F.lit("not a date")).when(F.col("seq") % 20 == 13, F.lit(None)).otherwise(
        F.date_format("modified_time", "yyyy-MM-dd'T'HH:mm:ss"))
    return D.live(t).withColumn("iso", text).select(
        "seq", L.date_folder("iso", text=True).alias("level1"), L.date_folder().alias("level1_typed"))


@query("relation_folder", ENRICHED + f"SELECT seq, {RELATION_SQL} AS level1 FROM enriched")
def relation_folder(t):
    return _labelled(t).select("seq", L.relation_folder().alias("level1"))


@query("level2_folder", CAT + f"SELECT seq, {D.LEVEL2_SQL} AS level2 FROM live")
def level2_folder(t):
    from ..functions.paths import level2_of

    return D.live(t).select("seq", level2_of("category").alias("level2"))


@query("slugify", f"SELECT doc_id, {D.slug_sql('text')} AS slug FROM documents")
def slugify(t):
    return t.documents.select("doc_id", slug("text").alias("slug"))


_PLAN = "SELECT seq, src, dst, category, topic FROM plan"


@query("build_plan_topic", ENRICHED + ", " + D.plan_sql(TOPIC_SQL, "enriched") + _PLAN)
def build_plan_topic(t):
    return L.build_plan(D.enriched(t), D.ROOT, "topic").select("seq", "src", "dst", "category", "topic")


@query("build_plan_date", CAT + ", " + D.DATE_PLAN_SQL + _PLAN)
def build_plan_date(t):
    return D.date_plan(t).select("seq", "src", "dst", "category", "topic")


@query("build_plan_relation", ENRICHED + ", " + D.plan_sql(RELATION_SQL, "enriched") + _PLAN)
def build_plan_relation(t):
    return L.build_plan(_labelled(t), D.ROOT, "relation").select("seq", "src", "dst", "category", "topic")


@query("organise_by_relation")
def organise_by_relation(t):
    """Documents embedded, clustered, named and laid out: relation mode from texts to plan."""
    docs = t.documents.select(F.col("doc_id").alias("seq"), "text")
    plan = organise(D.enriched(t).join(docs, "seq"), D.ROOT, "relation", auto=False)
    return plan.select("seq", "src", "dst", "category", "topic")


@query("resolve_conflicts", CAT + ", " + D.DATE_PLAN_SQL + ", " + D.RESOLVED_SQL + """
  SELECT seq, src, dst, coalesce(final_dst, 'none') AS final_dst, coalesce(error, 'none') AS error FROM resolved""")
def resolve_conflicts(t):
    return resolve(D.date_plan(t), D.existing(t)).select(
        "seq", "src", "dst", F.coalesce("final_dst", F.lit("none")).alias("final_dst"),
        F.coalesce("error", F.lit("none")).alias("error"))


# a run over folders that are in order already: all sources lie where the destinations are, many names are
# counters of others, and some files are missing
_SECOND_RUN = """SELECT doc_id AS seq, concat(folder, '/r', CAST(j % 5 AS STRING), src_no, '.txt') AS src,
  concat(folder, '/r', CAST((j * 7 + 3) % 5 AS STRING), dst_no, '.txt') AS dst, folder, doc_id % 29 <> 0 AS present
FROM (SELECT doc_id, j, concat('/corpus/', lang, CAST(doc_id % 8 AS STRING)) AS folder,
        CASE WHEN j < 5 THEN '' ELSE concat('_', CAST(CAST(floor(j / 5) AS BIGINT) AS STRING)) END AS src_no,
        CASE WHEN j % 3 = 0 THEN concat('_', CAST(j % 11 + 1 AS STRING)) ELSE '' END AS dst_no
      FROM (SELECT doc_id, lang, CAST(floor(doc_id / 8) AS BIGINT) AS j FROM {documents}) a) b"""
# file by file in each folder, with a list of the names that are taken at the time
_ONE_BY_ONE = f"""WITH RECURSIVE files AS ({D._duck(_SECOND_RUN)}),
  line AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY seq) AS n FROM files),
  here AS (SELECT folder, list(src) FILTER (present) AS taken FROM files GROUP BY folder),
  walk AS (SELECT folder, 0::BIGINT AS n, coalesce(taken, []) AS taken, 0::BIGINT AS seq, '' AS src, '' AS dst, '' AS final_dst FROM here
    UNION ALL SELECT folder, n, CASE WHEN present THEN list_append(list_filter(taken, lambda x: x <> src), got) ELSE taken END,
      seq, src, dst, CASE WHEN present THEN got ELSE 'none' END
    FROM (SELECT l.*, w.taken, list_filter(list_transform(range(0, len(w.taken) + 1), lambda c: CASE WHEN c = 0 THEN l.dst
            ELSE concat(left(l.dst, length(l.dst) - 4), '_', CAST(c AS VARCHAR), '.txt') END),
            lambda x: NOT list_contains(w.taken, x))[1] AS got
          FROM walk w JOIN line l ON l.folder = w.folder AND l.n = w.n + 1) q)
  SELECT seq, src, dst, final_dst FROM walk WHERE n > 0"""


@query("resolve_second_run", _ONE_BY_ONE)
def resolve_second_run(t):
    files = cut_lineage(t.sql(_SECOND_RUN))
    found = resolve(files.select("seq", "src", "dst"), files.filter("present").select(F.col("src").alias("path")))
    return found.select("seq", "src", "dst", F.coalesce("final_dst", F.lit("none")).alias("final_dst"))


_FOLDER = "regexp_replace(dst, '/[^/]*$', '')"


@query("plan_preview", CAT + ", " + D.DATE_PLAN_SQL + f"SELECT {_FOLDER} AS folder, seq, name FROM plan")
def plan_preview(t):
    return L.plan_preview(D.date_plan(t))


@query("plan_folders", CAT + ", " + D.DATE_PLAN_SQL + f"SELECT {_FOLDER} AS folder, count(*) AS files FROM plan GROUP BY 1")
def plan_folders(t):
    return L.plan_folders(D.date_plan(t))


@query("plan_totals", CAT + ", " + D.DATE_PLAN_SQL + f"SELECT count(*) AS files, count(DISTINCT {_FOLDER}) AS folders FROM plan")
def plan_totals(t):
    return L.plan_totals(D.date_plan(t))


@query("write_organized", CAT + ", " + D.DATE_PLAN_SQL + f"""SELECT topic AS level1, {D.LEVEL2_SQL} AS level2, count(*) AS files,
  CAST(sum(length(d.text)) AS BIGINT) AS chars FROM plan p JOIN documents d ON p.seq = d.doc_id GROUP BY 1, 2""")
def write_organized(t):
    out = scratch_path(t.spark, "organised")
    docs = t.documents.select(F.col("doc_id").alias("seq"), "text")
    S.write_organized(D.date_plan(t).select("seq", "level1", "level2", "dst").join(docs, "seq"), out)
    return S.read_organized(t.spark, out).groupBy("level1", "level2").agg(
        F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))
