from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as P
from ..operators import enrich as E
from . import derived as D
from .registry import query

META = "WITH " + D.METADATA_SQL + " "


def _flat(df, key="doc_id"):
    m = "metadata"
    return df.select(key, f"{m}.topic", f"{m}.summary", F.array_join(f"{m}.keywords", "|").alias("keywords"),
                     f"{m}.confidence", F.coalesce(f"{m}.file_date", F.lit("none")).alias("file_date"))


_HEAD, _NAME_END, _TYPE_END, _TAIL = (s.replace("'", "''") for s in E.PROMPT.split("%s"))


@query("metadata_prompt", f"""SELECT doc_id * 2 AS doc_id, CASE WHEN {D.strip_sql('text')} = '' THEN 'none' ELSE
  concat('{_HEAD}', source, '{_NAME_END}', lang, '{_TYPE_END}', left(text, 4000), '{_TAIL}') END AS prompt FROM documents
  UNION ALL SELECT doc_id * 2 + 1, 'none' FROM documents""")
def metadata_prompt(t):
    # every text, and a blank one beside it
    both = t.documents.withColumn("t", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("text")),
                                                         F.struct(F.lit(1).alias("k"), F.lit(" \n").alias("text")))))
    docs = both.select((F.col("doc_id") * 2 + F.col("t.k")).alias("doc_id"), F.col("source").alias("name"),
                       F.col("lang").alias("category"), F.col("t.text").alias("text"))
    return E.metadata_prompt(docs).select("doc_id", F.coalesce("prompt", F.lit("none")).alias("prompt"))


def _word_counter():
    """Stands in for a model: answers the number of blanks, and refuses every fifth kind of text."""
    def answer(texts):
        if any(len(text) % 5 == 0 for text in texts):
            raise ValueError("refused")
        return [f"{text.count(' ')} blanks" for text in texts]
    return answer


@query("score_batches", """SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN 'failed' ELSE
  concat(CAST(length(text) - length(replace(text, ' ', '')) AS VARCHAR), ' blanks') END AS reply FROM documents""")
def score_batches(t):
    return E.score_batches(t.documents.select("doc_id", "text"), _word_counter, "text", "reply",
                           default="failed").select("doc_id", "reply")


@query("model_report", """SELECT source, count(*) AS rows, count(*) FILTER (length(text) % 5 = 0) AS failed,
  CASE WHEN count(*) FILTER (length(text) % 5 = 0) > 0 THEN 'ValueError: refused' ELSE 'none' END AS failure FROM documents GROUP BY source""")
def model_report(t):
    scored = E.score_batches(t.documents.select("source", "text"), _word_counter, "text", "reply", error_col="error")
    return E.model_report(scored, by=["source"]).withColumn("failure", F.coalesce("failure", F.lit("none")))


@query("extract_json", META + """SELECT doc_id, CASE WHEN doc_id % 7 IN (3, 5) THEN 'none' ELSE concat('  ', topic) END AS topic,
  doc_id % 7 <> 5 AS found FROM meta""")
def extract_json(t):
    parsed = D.replies(t).withColumn("j", P.extract_json("reply"))
    return parsed.select("doc_id", F.coalesce(F.try_variant_get("j", "$.topic", "string"), F.lit("none")).alias("topic"),
                         F.col("j").isNotNull().alias("found"))


@query("fix_json", f"""SELECT doc_id, regexp_replace(regexp_replace(reply, ',\\s*([}}\\]])', '\\1', 'g'),
  '''([^''\\\\]*)''', '"\\1"', 'g') AS fixed FROM ({D.REPLIES_SQL}) r""")
def fix_json(t):
    return D.replies(t).select("doc_id", P.fix_json("reply").alias("fixed"))


@query("validate_metadata", META + """SELECT doc_id, topic, summary, keywords, confidence, 'none' AS file_date FROM meta WHERE doc_id % 7 NOT IN (3, 5)""")
def validate_metadata(t):
    parsed = D.replies(t).withColumn("j", P.extract_json("reply"))
    checked = parsed.withColumn("metadata", P.validate_metadata("j"))
    return _flat(checked.filter(F.col("metadata").isNotNull()))


@query("enrich", META + "SELECT doc_id, topic, summary, keywords, confidence, 'none' AS file_date FROM meta")
def enrich(t):
    return _flat(E.enrich(D.replies(t)))


# long replies: every text inside a reply object, with fields missing or of the wrong kind
@query("enrich_texts", """SELECT doc_id,
  CASE WHEN doc_id % 4 = 3 THEN 'Uncategorized' ELSE left(trim(text, """ + D.WS + """), 80) END AS topic,
  CASE WHEN doc_id % 4 = 3 THEN '' ELSE left(trim(text, """ + D.WS + """), 500) END AS summary,
  CASE WHEN doc_id % 4 = 1 THEN lang ELSE '' END AS keywords,
  CASE doc_id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN doc_id % 4 = 1 THEN '2024-03-01' ELSE 'none' END AS file_date FROM documents""")
def enrich_texts(t):
    text, lang, kind = F.col("text"), F.col("lang"), F.col("doc_id") % 4
    body = F.when(kind == 0, F.to_json(F.struct(text.alias("topic"), text.alias("summary"), F.lit("x").alias("keywords")))) \
        .when(kind == 1, F.to_json(F.struct(text.alias("topic"), text.alias("summary"), F.array(lang).alias("keywords"),
                                            F.lit(True).alias("confidence"), F.lit("2024-03-01").alias("file_date")))) \
        .when(kind == 2, F.to_json(F.struct(text.alias("topic"), text.alias("summary"), F.array(F.lit("")).alias("keywords"),
                                            F.lit("0.25").alias("confidence")))) \
        .otherwise(F.to_json(F.array(text)))
    return _flat(E.enrich(t.documents.select("doc_id", F.concat(F.lit("Sure.\n```JSON\n"), body, F.lit("\n```\n")).alias("reply"))))


TOPICS = "WITH " + D.METADATA_SQL + """, firsts AS (SELECT CAST(doc_id % 5 AS VARCHAR) AS cluster, topic, min(doc_id) AS f
  FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '' ELSE topic END AS topic FROM meta) m GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY f) AS r FROM firsts WHERE topic <> ''),
named AS (SELECT c.cluster, string_agg(topic, ', ' ORDER BY r) FILTER (r <= 12) AS topics
  FROM (SELECT DISTINCT cluster FROM firsts) c LEFT JOIN ranked r ON c.cluster = r.cluster GROUP BY c.cluster) """


def _labelled(t):
    meta = D.metadata(t)
    cluster = F.col("seq") % 5
    return meta.select("seq", cluster.cast("string").alias("cluster"),
                       F.when(cluster == 4, F.lit("")).otherwise(F.col("topic")).alias("topic"))


_N_HEAD, _N_TAIL = (s.replace("'", "''") for s in E.NAMING_PROMPT.split("%s"))


@query("naming_prompt", TOPICS + f"""SELECT cluster, coalesce(topics, 'none') AS topics,
  CASE WHEN topics IS NULL THEN 'none' ELSE concat('{_N_HEAD}', topics, '{_N_TAIL}') END AS prompt FROM named""")
def naming_prompt(t):
    return E.naming_prompt(_labelled(t)).select(
        "cluster", F.coalesce("topics", F.lit("none")).alias("topics"), F.coalesce("prompt", F.lit("none")).alias("prompt"))


@query("cluster_name", f"""SELECT doc_id, coalesce(nullif(left({D.strip_sql("string_split(" + D.strip_sql('text') + ", chr(10))[1]")}, 50), ''),
  'Miscellaneous') AS cluster_name FROM documents""")
def cluster_name(t):
    return E.with_cluster_name(t.documents, "text").select("doc_id", "cluster_name")


@query("attach_cluster_names", TOPICS + """SELECT d.doc_id AS seq, CAST(d.doc_id % 5 AS VARCHAR) AS cluster,
  coalesce(string_split(topics, ', ')[1], CAST(d.doc_id % 5 AS VARCHAR)) AS cluster_label
  FROM documents d LEFT JOIN named n ON CAST(d.doc_id % 5 AS VARCHAR) = n.cluster""")
def attach_cluster_names(t):
    labelled = _labelled(t)
    names = E.cluster_topics(labelled).filter(F.col("topics").isNotNull()).select(
        "cluster", F.split_part("topics", F.lit(", "), F.lit(1)).alias("cluster_name"))
    return E.attach_names(labelled.select("seq", "cluster"), names)
