"""The file catalog: parts of names, categories, audit of skipped files, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import paths
from ..functions.text import short_float
from ..runtime import cut_lineage


def size_in_mb(size_bytes) -> Column:
    # half-even, as sizes are dyadic fractions and ties do occur
    return F.bround(F.col(size_bytes) / F.lit(1048576), 3)


def with_parts(df: DataFrame) -> DataFrame:
    """Add name, stem and lower-case extension of ``path``."""
    return (df.withColumn("name", paths.name_of("path"))
            .withColumns({"stem": paths.stem_of("name"), "extension": paths.extension_of("name")}))


def with_category(df: DataFrame) -> DataFrame:
    return df.withColumn("category", paths.category_of("extension"))


def with_size_mb(df: DataFrame, size: str = "size_bytes") -> DataFrame:
    return df.withColumn("size_mb", size_in_mb(size))


def iso_text(col) -> Column:
    """ISO-8601 text of a local time; the fraction is printed only when there is one."""
    # through text, not date_format: local times must not pass through a time zone
    text = F.replace(F.col(col).cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
    fraction = F.split_part(text, F.lit("."), F.lit(2))
    return F.when(fraction == "", text).otherwise(F.concat(
        F.split_part(text, F.lit("."), F.lit(1)), F.lit("."), F.rpad(fraction, 6, "0")))


def with_iso_times(df: DataFrame) -> DataFrame:
    return df.withColumns({"modified_iso": iso_text("modified_time"),
                           "created_iso": iso_text("created_time")})


def catalog(inventory: DataFrame) -> DataFrame:
    """File records from any listing with path, length, modified (and optionally created)."""
    created = F.col("created") if "created" in inventory.columns else F.lit(None)
    kept = [c for c in inventory.columns if c not in ("path", "length", "modified", "created")]
    base = inventory.select(
        *kept, "path", F.col("length").cast("bigint").alias("size_bytes"),
        F.col("modified").cast("timestamp_ntz").alias("modified_time"),
        created.cast("timestamp_ntz").alias("created_time"))
    return with_size_mb(with_category(with_parts(base)))


def is_ignored(path="path") -> Column:
    return F.arrays_overlap(F.split(F.col(path), "/"), F.array(*[F.lit(n) for n in K.IGNORED_NAMES]))


def drop_ignored(df: DataFrame) -> DataFrame:
    """Without files that have an ignored name anywhere in their path."""
    return df.filter(~is_ignored())


def skip_reason(max_mb: float = K.MAX_FILE_MB, has_error: bool = False) -> Column:
    too_large = F.concat(F.lit("too large ("), short_float("size_mb"),
                         F.lit(f" MB > {float(max_mb)} MB)"))
    reason = (F.when(F.coalesce(F.col("size_bytes"), F.lit(0)) <= 0, F.lit(K.EMPTY_REASON))
              .when(F.col("size_mb") > max_mb, too_large))
    return F.coalesce(F.col("error"), reason) if has_error else reason


def skip_audit(df: DataFrame, max_mb: float = K.MAX_FILE_MB) -> DataFrame:
    """Add ``reason``: why a file is skipped, null when it is kept; a column ``error`` goes first."""
    return df.withColumn("reason", skip_reason(max_mb, "error" in df.columns))


def readable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("size_bytes") > 0)


def not_oversize(df: DataFrame, max_mb: float = K.MAX_FILE_MB) -> DataFrame:
    # the bound on bytes reaches the scan, the rounded size decides
    return df.filter((F.col("size_bytes") <= int((max_mb + 0.001) * 1048576)) & (F.col("size_mb") <= max_mb))


def live_files(df: DataFrame, max_mb: float = K.MAX_FILE_MB) -> DataFrame:
    return skip_audit(drop_ignored(df), max_mb).filter(F.col("reason").isNull()).drop("reason")


def skipped_files(df: DataFrame, max_mb: float = K.MAX_FILE_MB) -> DataFrame:
    return (skip_audit(drop_ignored(df), max_mb).filter(F.col("reason").isNotNull())
            .select("path", "reason"))


def category_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count("*").alias("files"))


def manifest_summary(audited: DataFrame) -> DataFrame:
    """One row over a ``skip_audit`` frame: files, MB, files per category, skipped files."""
    kept = F.col("reason").isNull()
    per_category = [F.count_if(kept & (F.col("category") == c)).alias(f"{c}_files")
                    for c in [*K.CATEGORIES, K.UNKNOWN]]
    return audited.agg(
        F.count_if(kept).alias("total_files"),
        F.bround(F.coalesce(F.sum(F.when(kept, F.col("size_bytes"))), F.lit(0)) / F.lit(1048576), 2)
        .alias("total_size_mb"),
        *per_category,
        F.count_if(~kept).alias("skipped"))


def manifest_head(files: DataFrame, rows: int = K.LISTING_ROWS) -> DataFrame:
    """The first rows of the listing, in path order."""
    return files.orderBy("path").limit(rows)


def with_digest(df: DataFrame, content: str = "content", algorithm: str = "md5") -> DataFrame:
    digest = F.md5(content) if algorithm == "md5" else F.sha2(content, int(algorithm.removeprefix("sha")))
    return df.withColumn("digest", digest).drop(content)


def duplicate_files(df: DataFrame, content: str = "content", algorithm: str = "md5") -> DataFrame:
    """Every file whose content occurs more than once, with the copy to keep (smallest path).

    Content is hashed where it is read and never shuffled; copies are counted before the
    shuffle. The joined side has one row per content, so a hot content can be split.
    """
    # contents are read and hashed once: what is written here is a few bytes per file
    hashed = cut_lineage(with_digest(df.select("path", F.octet_length(content).alias("length"), content),
                                     content, algorithm))
    groups = (hashed.groupBy("digest", "length")
              .agg(F.count("*").alias("copies"), F.min("path").alias("keep"))
              .filter(F.col("copies") > 1))
    return (hashed.join(groups, ["digest", "length"])
            .select("path", "digest", "length", "copies", "keep",
                    (F.col("path") == F.col("keep")).alias("is_kept")))
