from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..runtime import scratch_path
from ..sources import files as S
from . import derived as D
from .registry import query

WITH = "WITH " + D.CATALOG_SQL + " "
STAMP = "%Y-%m-%dT%H:%M:%S"


@query("scan_files", """SELECT source, count(*) AS texts, sum(octet_length(encode(text)) + 1) AS bytes, 0 AS audited
  FROM documents GROUP BY source""")
def scan_files(t):
    """Documents as text files, one folder per source; the folder is walked, audited and its files read back."""
    out = scratch_path(t.spark, "scan")
    docs = t.documents.select("source", F.replace("text", F.lit("\n"), F.lit("\u0001")).alias("value"))
    docs.hint("rebalance", "source").write.partitionBy("source").text(out)
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    files = C.skip_audit(S.scan_mounted(t.spark, out)).filter("extension = '.txt'")
    sizes = files.groupBy(source.alias("source")).agg(F.sum("size_bytes").alias("bytes"),
                                                      F.count_if(F.col("reason").isNotNull()).alias("audited"))
    lines = t.spark.read.text(out).groupBy("source").agg(F.count("*").alias("texts"))
    return sizes.join(lines, "source").select("source", "texts", "bytes", "audited")


@query("catalog_from_inventory", WITH + f"""SELECT seq, path, name, stem, extension, category, size_bytes, size_mb,
  strftime(modified_time, '{STAMP}') AS modified FROM cat""")
def catalog_from_inventory(t):
    return D.catalog(t).select("seq", "path", "name", "stem", "extension", "category", "size_bytes", "size_mb",
                               C.iso_text("modified_time").alias("modified"))


@query("read_text_files", "SELECT source, count(*) AS files, sum(length(text)) AS chars FROM documents GROUP BY source")
def read_text_files(t):
    """Documents written out as text files, one folder per source, read back as bytes."""
    out = scratch_path(t.spark, "texts")
    # one line per document: the text source writes lines, so line ends are escaped for the trip
    docs = t.documents.select("source", F.replace("text", F.lit("\n"), F.lit("\u0001")).alias("value"))
    docs.hint("rebalance", "source").write.partitionBy("source").text(out)
    read = S.read_text_files(t.spark, out)
    lines = read.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"),
                        F.explode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("line"))
    return lines.groupBy("source").agg(F.count("*").alias("files"), F.sum(F.length("line")).alias("chars"))


@query("file_parts", WITH + "SELECT path, name, stem, extension FROM cat")
def file_parts(t):
    return C.with_parts(D.inventory(t)).select("path", "name", "stem", "extension")


@query("classify_ext", WITH + "SELECT seq, extension, category FROM cat")
def classify_ext(t):
    parts = C.with_category(C.with_parts(D.inventory(t)))
    return parts.select(F.col("doc_id").alias("seq"), "extension", "category")


@query("size_mb", WITH + "SELECT seq, size_mb FROM cat")
def size_mb(t):
    return C.with_size_mb(D.inventory(t), "length").select(F.col("doc_id").alias("seq"), "size_mb")


@query("iso_times", WITH + f"SELECT seq, strftime(modified_time, '{STAMP}') AS modified_iso, "
       "CAST(NULL AS VARCHAR) AS created_iso FROM cat")
def iso_times(t):
    return C.with_iso_times(D.catalog(t)).select("seq", "modified_iso", "created_iso")


@query("ignore_filter", WITH + "SELECT seq, path FROM aud")
def ignore_filter(t):
    return C.drop_ignored(D.catalog(t)).select("seq", "path")


@query("readable_filter", WITH + "SELECT seq, path FROM cat WHERE size_bytes > 0")
def readable_filter(t):
    return C.readable(D.catalog(t)).select("seq", "path")


@query("oversize_filter", WITH + "SELECT seq, path, size_mb FROM cat WHERE size_mb <= 500")
def oversize_filter(t):
    return C.not_oversize(D.catalog(t)).select("seq", "path", "size_mb")


@query("skip_audit", WITH + "SELECT seq, path, coalesce(reason, 'kept') AS reason FROM aud")
def skip_audit(t):
    return C.skip_audit(C.drop_ignored(D.catalog(t))).select(
        "seq", "path", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("skipped_files", WITH + "SELECT path, reason FROM aud WHERE reason IS NOT NULL")
def skipped_files(t):
    return C.skipped_files(D.catalog(t))


@query("image_size_guard", WITH + """SELECT seq, CASE WHEN category = 'image' AND size_mb > 20
  THEN concat('Image too large: ', CAST(size_mb AS VARCHAR), ' MB > 20 MB') ELSE 'fits' END AS error FROM aud""")
def image_size_guard(t):
    from ..operators.routing import guard_image

    return guard_image(C.drop_ignored(D.catalog(t))).select("seq", F.coalesce("error", F.lit("fits")).alias("error"))


@query("category_counts", WITH + "SELECT category, count(*) AS files FROM live GROUP BY category")
def category_counts(t):
    return C.category_counts(D.live(t))


@query("manifest_summary", WITH + """SELECT count(*) FILTER (reason IS NULL) AS total_files,
  round_even(sum(size_bytes) FILTER (reason IS NULL) / 1048576.0::DOUBLE, 2) AS total_size_mb,
  count(*) FILTER (reason IS NULL AND category = 'image') AS image_files,
  count(*) FILTER (reason IS NULL AND category = 'pdf') AS pdf_files,
  count(*) FILTER (reason IS NULL AND category = 'audio') AS audio_files,
  count(*) FILTER (reason IS NULL AND category = 'video') AS video_files,
  count(*) FILTER (reason IS NULL AND category = 'document') AS document_files,
  count(*) FILTER (reason IS NULL AND category = 'unknown') AS unknown_files,
  count(*) FILTER (reason IS NOT NULL) AS skipped FROM aud""")
def manifest_summary(t):
    return C.manifest_summary(C.skip_audit(C.drop_ignored(D.catalog(t))))


@query("manifest_head", WITH + "SELECT path, name, category, size_bytes FROM live ORDER BY path LIMIT 200")
def manifest_head(t):
    return C.manifest_head(D.live(t)).select("path", "name", "category", "size_bytes")


@query("duplicate_files", f"""WITH inv AS ({D.INVENTORY_SQL}),
  hashed AS (SELECT path, md5(text) AS digest, CAST(strlen(text) AS BIGINT) AS length FROM inv i JOIN documents d ON i.doc_id = d.doc_id)
  SELECT path, digest, length, count(*) OVER w AS copies, min(path) OVER w AS keep, path = min(path) OVER w AS is_kept
  FROM hashed WINDOW w AS (PARTITION BY digest, length) QUALIFY count(*) OVER w > 1""")
def duplicate_files(t):
    content = t.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    named = D.inventory(t).select("doc_id", "path").join(content, "doc_id")
    return C.duplicate_files(named).withColumn("length", F.col("length").cast("bigint"))
