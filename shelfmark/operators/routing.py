"""Which assembler a file goes to, and what counts as a successful extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.paths import one_of
from ..functions.text import blank_to_null, py_strip, short_float


def route_of(category: str = "category", extension: str = "extension") -> Column:
    by_extension = one_of(F.col(extension), K.DOCUMENT_ROUTES, F.lit(K.PLAIN_TEXT_ROUTE))
    return (F.when(F.col(category) == "document", by_extension)
            .when(F.col(category).isin(*K.CATEGORIES), F.col(category))
            .otherwise(F.lit(K.FALLBACK_ROUTE)))


def route(df: DataFrame) -> DataFrame:
    return df.withColumn("route", route_of())


def guard_image(df: DataFrame, max_mb: float = K.MAX_IMAGE_MB) -> DataFrame:
    """Add ``error`` for images above the cap."""
    message = F.concat(F.lit("Image too large: "), short_float("size_mb"), F.lit(f" MB > {max_mb} MB"))
    return df.withColumn("error", F.when(
        (F.col("category") == "image") & (F.col("size_mb") > max_mb), message))


def fallback_text(df: DataFrame, max_chars: int = K.FALLBACK_CHARS) -> DataFrame:
    """Files of no known category: the head of their text, or an error when there is none."""
    text = F.left(F.coalesce("text", F.lit("")), F.lit(max_chars))
    return df.withColumns({
        "error": F.when(text == "", F.concat(F.lit("No pipeline for category '"), F.col("category"), F.lit("'"))),
        "text": text})


def outcome(df: DataFrame) -> DataFrame:
    """Add ``success`` (no error, some text before stripping) and strip the text."""
    raw = F.coalesce("text", F.lit(""))
    return (df.withColumn("success", F.col("error").isNull() & (raw != ""))
            .withColumn("text", py_strip(raw)))


def text_or_default(df: DataFrame) -> DataFrame:
    stand_in = F.concat(F.lit("File: "), F.col("name"), F.lit(" (type: "), F.col("category"), F.lit(")"))
    return df.withColumn("text", F.coalesce(blank_to_null("text"), stand_in))


def extract_all(files: DataFrame, assembled: list[DataFrame]) -> DataFrame:
    """Every file with the text its assembler made; files no assembler answered get an error.

    ``assembled``: frames with path, text, error (extra optional), each path in one of them.
    """
    parts = None
    for frame in assembled:
        extra = F.col("extra") if "extra" in frame.columns else F.lit(None)
        frame = frame.select("path", "text", "error", extra.cast("map<string,string>").alias("extra"),
                             F.lit(True).alias("_seen"))
        parts = frame if parts is None else parts.unionByName(frame)
    joined = guard_image(route(files)).withColumnRenamed("error", "_guard").join(parts, "path", "left")
    unseen, guarded = F.col("_seen").isNull(), F.col("_guard").isNotNull()
    # no child rows at all: a PDF still has its header, the others have nothing to show
    bare_pdf = F.when(unseen & (F.col("category") == "pdf"), F.concat(
        F.lit("[PDF: "), F.col("name"), F.lit(" | 0 pages]\n\n")))
    silent = {K.NO_DOCUMENT_TEXT: ["document"], K.NO_SPEECH: ["audio"], K.NO_VIDEO_METADATA: ["video"],
              K.NO_IMAGE_TEXT: ["image"]}
    nothing = F.when(unseen & (F.col("category") != "pdf"), one_of(F.col("category"), silent, F.concat(
        F.lit("No pipeline for category '"), F.col("category"), F.lit("'"))))
    return outcome(joined.withColumns({
        "text": F.when(~guarded, F.coalesce("text", bare_pdf)),
        "extra": F.when(~guarded, F.col("extra")),
        "error": F.coalesce("_guard", "error", nothing)}).drop("_guard", "_seen"))


def extract_report(extracted: DataFrame) -> DataFrame:
    return extracted.agg(F.count_if("success").alias("ok"), F.count("*").alias("total"))
