"""Text per file out of child rows: pages, segments, frames, rows, slides, sheets, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import html, trees
from ..functions.paths import name_of
from ..functions.text import blank_to_null, csv_left_open, csv_pieces, csv_record, csv_records, py_strip
from .grouping import join_lines, running_last, running_total


def _stripped_or_null(col) -> Column:
    return blank_to_null(py_strip(col))


def document_text(df: DataFrame, max_chars: int = K.DOCUMENT_CHARS) -> DataFrame:
    """Header and head of a document's text; an error when there is no text."""
    empty = F.coalesce("text", F.lit("")) == ""
    full = F.concat(F.lit("[Document: "), name_of("path"), F.lit("]\n\n"), F.left("text", F.lit(max_chars)))
    return df.withColumns({"error": F.when(empty, F.lit(K.NO_DOCUMENT_TEXT)),
                           "text": F.when(~empty, full)})


def html_text(df: DataFrame, max_chars: int = K.HTML_CHARS) -> DataFrame:
    return df.withColumn("text", html.html_text("html", max_chars)).drop("html")


def html_strip_tags(df: DataFrame, max_chars: int = K.HTML_CHARS) -> DataFrame:
    return df.withColumn("text", html.strip_tags("html", max_chars)).drop("html")


def xml_digest(df: DataFrame, max_chars: int = K.XML_CHARS) -> DataFrame:
    return df.withColumn("text", trees.xml_digest("text", max_chars))


def json_digest(df: DataFrame, max_chars: int = K.JSON_CHARS) -> DataFrame:
    return df.withColumn("text", trees.json_digest("text", max_chars))


def csv_rows(df: DataFrame, max_rows: int = K.CSV_ROWS) -> DataFrame:
    """(path, row_no, cells) of CSV text; one row past the cap is kept to tell that there are more."""
    records = F.when(F.col("text") != "", csv_records("text", max_rows + 1))
    rows = df.select("path", F.posexplode(records).alias("row_no", "cells"))
    return rows.select("path", F.col("row_no").cast("bigint").alias("row_no"), "cells")


def csv_rows_of_lines(lines: DataFrame, max_rows: int | None = K.CSV_ROWS) -> DataFrame:
    """``csv_rows`` of files of any size, given as (path, line_no, line): see ``sources.files.read_text_lines``.

    Whether a line starts inside a quoted cell depends on all lines before it. What a line does to that
    is one of four functions of two states: it leaves a cell open or closed whatever was before, it
    keeps the state, or it turns it round. So a line starts inside if the last line that decides and
    the number of turns since then say so: two prefix scans over ranges of lines, no file in one task.
    A record is one value; line breaks within cells come as "\\n". With ``max_rows`` None all records are kept.
    """
    fresh, inside = csv_left_open("line", False), csv_left_open("line", True)
    turned = lines.withColumns({"_fresh": fresh, "_inside": inside})
    turned = running_total(turned, ["path"], "line_no", F.when(F.expr("_fresh and not _inside"), 1).otherwise(0), "_turns")
    # what a deciding line leaves, as if no line before it had turned the state round
    left = F.when(F.expr("_fresh = _inside"), (F.col("_fresh").cast("int") + F.col("_turns")) % 2)
    scanned = running_last(turned, ["path"], "line_no", left, "_left")
    is_inside = (F.coalesce("_left", F.lit(0)) + F.col("_turns")) % 2 == 1
    started = running_total(scanned.select("path", "line_no", "line", is_inside.alias("_within")), ["path"], "line_no",
                            (~F.col("_within")).cast("int"), "_before")
    numbered = started.withColumn("row_no", F.col("_before") - F.col("_within").cast("int"))
    if max_rows is not None:
        numbered = numbered.filter(F.col("row_no") <= max_rows)
    records = join_lines(numbered, ["path", "row_no"], "line_no", "line", "\n", "text")
    return records.select("path", "row_no", csv_record(csv_pieces(F.concat("text", F.lit("\n")))).alias("cells"))


def csv_digest(rows: DataFrame, max_rows: int = K.CSV_ROWS) -> DataFrame:
    """First records, one per line, and a closing line when there are more."""
    line = F.when(F.col("row_no") < max_rows, F.array_join("cells", ", ", ""))
    line = F.when(F.col("row_no") == max_rows, F.lit(f"... ({max_rows} rows total)")).otherwise(line)
    kept = rows.filter(F.col("row_no") <= max_rows).withColumn("_line", line)
    return join_lines(kept, ["path"], "row_no", "_line", "\n", "text")


def paragraph_join(paragraphs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(path, seq, text) -> non-empty paragraphs, one per line."""
    kept = paragraphs.withColumn("text", blank_to_null("text"))
    return join_lines(kept, ["path"], "seq", "text", "\n", "text", max_chars)


def slide_digest(shapes: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(path, slide_no from 1, shape_no, text) -> one line per slide that has text."""
    kept = shapes.withColumn("text", _stripped_or_null("text"))
    slides = join_lines(kept, ["path", "slide_no"], "shape_no", "text", " | ", "_body", max_chars)
    lines = slides.withColumn("_line", F.when(F.col("_body") != "", F.concat(
        F.lit("[Slide "), F.col("slide_no").cast("string"), F.lit("]: "), F.col("_body"))))
    return join_lines(lines, ["path"], "slide_no", "_line", "\n", "text", max_chars)


def sheet_digest(cells: DataFrame, max_rows: int = K.SHEET_ROWS,
                 max_chars: int = K.SHEET_CHARS) -> DataFrame:
    """(path, sheet_no, sheet, row_no, cells) -> the head of every sheet that has content."""
    filled = F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != "")
    line = (F.when(F.col("row_no") == max_rows, F.lit("..."))
            .when(filled, F.array_join("cells", " | ", "")))
    kept = cells.filter(F.col("row_no") <= max_rows).withColumn("_line", line)
    sheets = join_lines(kept, ["path", "sheet_no", "sheet"], "row_no", "_line", "\n", "_body", max_chars)
    parts = sheets.withColumn("_part", F.when(F.col("_body") != "", F.concat(
        F.lit("[Sheet: "), F.col("sheet"), F.lit("]\n"), F.col("_body"))))
    return join_lines(parts, ["path"], "sheet_no", "_part", "\n\n", "text", max_chars)


def pdf_text(pages: DataFrame, max_pages: int = K.PDF_PAGES, max_chars: int = K.PDF_CHARS) -> DataFrame:
    """(path, page_no from 0, text, ocr_text) -> text of the first pages; OCR where a page has little.

    Pages beyond the cap only count: they are folded into a number before the shuffle.
    """
    native, ocr = py_strip("text"), _stripped_or_null("ocr_text")
    first = F.col("page_no") < max_pages
    long_enough = F.coalesce(F.length(native), F.lit(0)) > K.PDF_NATIVE_MIN_CHARS
    number = (F.col("page_no") + 1).cast("string")
    # nothing past the cap of the whole text can be seen, so a page is cut there before it moves
    page = (F.when(long_enough, F.concat(F.lit("[Page "), number, F.lit("]\n"), F.left(native, F.lit(max_chars))))
            .when(ocr.isNotNull(), F.concat(F.lit("[Page "), number, F.lit(" - OCR]\n"),
                                            F.left(ocr, F.lit(max_chars)))))
    grouped = pages.select(
        "path", first.alias("_first"), F.when(first, F.col("page_no")).alias("_no"),
        F.when(first, page).alias("_page"),
        (first & ~long_enough & ocr.isNotNull()).alias("_ocr"),
    ).groupBy("path").agg(
        F.count("*").alias("total_pages"),
        F.count_if("_first").alias("pages_processed"),
        F.bool_or("_ocr").alias("ocr_used"),
        F.sort_array(F.collect_list(F.when(F.col("_page").isNotNull(), F.struct("_no", "_page")))).alias("_pages"))
    header = F.concat(F.lit("[PDF: "), name_of("path"), F.lit(" | "), F.col("total_pages").cast("string"),
                      F.lit(" pages]\n\n"))
    body = F.array_join(F.transform("_pages", lambda p: p["_page"]), "\n\n")
    return grouped.select("path", F.left(F.concat(header, body), F.lit(max_chars)).alias("text"),
                          "total_pages", "pages_processed", "ocr_used")


def transcript_text(segments: DataFrame, max_seconds: float = K.AUDIO_SECONDS) -> DataFrame:
    """(path, seq, end_sec, text) -> transcript up to the first segment that ends too late.

    The place to stop is a plain minimum per file; later segments are gone before texts move.
    """
    stops = segments.groupBy("path").agg(
        F.min(F.when(F.col("end_sec") > max_seconds, F.col("seq"))).alias("_stop"))
    spoken = F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))
    cut = segments.join(stops, "path").select(
        "path", "seq", F.when(spoken, py_strip("text")).alias("text"),
        F.when(spoken, F.struct("seq", "end_sec")).alias("_end"))
    out = join_lines(cut, ["path"], "seq", "text", " ", "_body", also={
        "_last": (F.max("_end"), F.max), "_n": (F.count("_end"), F.sum)})
    empty = F.col("_body") == ""
    full = F.concat(F.lit("[Audio Transcript: "), name_of("path"), F.lit("]\n\n"), F.col("_body"))
    return out.select(
        "path", F.when(~empty, full).alias("text"), F.when(empty, F.lit(K.NO_SPEECH)).alias("error"),
        F.bround(F.coalesce("_last.end_sec", F.lit(0.0)), 1).alias("duration_sec"),
        F.col("_n").alias("segment_count"))


def frame_times(videos: DataFrame, frames: int = K.VIDEO_FRAMES,
                max_seconds: float = K.VIDEO_SECONDS) -> DataFrame:
    """(path, duration) -> evenly spaced moments; one error row when the duration is unknown."""
    capped = F.least(F.col("duration"), F.lit(float(max_seconds)))
    step = F.col("_capped") / F.lit(frames + 1)
    moments = F.transform(F.sequence(F.lit(1), F.lit(frames)), lambda i: F.struct(
        i.alias("frame_no"), (step * i).alias("at_sec")))
    return (videos.select("path", F.when(F.col("duration").isNotNull(), capped).alias("_capped"))
            .select("path", F.col("_capped").alias("duration"),
                    F.when(F.col("_capped").isNull(), F.lit(K.NO_VIDEO_METADATA)).alias("error"),
                    F.explode_outer(F.when(F.col("_capped").isNotNull(), moments)).alias("f"))
            .select("path", "duration", "error", "f.frame_no", "f.at_sec"))


def frame_text(videos: DataFrame, frames: DataFrame, max_seconds: float = K.VIDEO_SECONDS,
               max_frames: int = K.VIDEO_FRAMES) -> DataFrame:
    """Descriptions of the frames that were grabbed, numbered among those.

    ``videos``: path, duration. ``frames``: path, frame_no (1 to max_frames), description.
    """
    listed = frames.filter(F.col("frame_no").between(1, max_frames)).groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("frame_no", "description"))).alias("_frames"))
    numbered = F.transform("_frames", lambda f, i: F.when(
        F.coalesce(f["description"], F.lit("")) != "",
        F.concat(F.lit("[Frame "), (i + 1).cast("string"), F.lit("]: "), f["description"])))
    duration = F.least(F.col("duration"), F.lit(float(max_seconds)))
    joined = (videos.join(listed, "path", "left")
              .withColumn("_texts", F.filter(numbered, lambda t: t.isNotNull()))
              .withColumn("_duration", F.when(F.col("duration").isNotNull(), duration)))
    count = F.coalesce(F.size("_texts"), F.lit(0))
    error = (F.when(F.col("_duration").isNull(), F.lit(K.NO_VIDEO_METADATA))
             .when(F.col("_frames").isNull(), F.lit(K.NO_FRAMES))
             .when(count <= 0, F.lit(K.NO_FRAME_TEXT)))
    seconds = F.format_string("%d", F.bround("_duration", 0).cast("bigint"))
    full = F.concat(F.lit("[Video File: "), name_of("path"), F.lit(" | Duration: "), seconds, F.lit("s]\n\n"),
                    F.array_join("_texts", "\n\n"))
    return joined.select("path", F.when(error.isNull(), full).alias("text"), error.alias("error"),
                         F.when(error.isNull(), F.col("_duration")).alias("duration_sec"),
                         F.when(error.isNull(), count).otherwise(0).alias("frames_analyzed"))


def image_text(images: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Description, or what is known of the image: size, mode and a few tags.

    ``images``: path, description, width, height, mode. ``tags``: path, tag_no, tag, value.
    """
    if tags is None:
        joined = images.withColumn("_tags", F.lit(None).cast("array<string>"))
    else:
        # seven tag names at most, the first value of each
        listed = (tags.filter(F.col("tag").isin(K.IMAGE_TAGS)).groupBy("path", "tag")
                  .agg(F.min("tag_no").alias("o"), F.min_by("value", "tag_no").alias("v"))
                  .groupBy("path").agg(F.sort_array(F.collect_list(F.struct("o", "tag", "v"))).alias("_t")))
        joined = images.join(listed.select("path", F.transform(
            "_t", lambda t: F.concat(t["tag"], F.lit(": "), t["v"])).alias("_tags")), "path", "left")
    size = F.concat(F.lit("Size: "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    known = F.array_compact(F.concat(F.array(size, F.concat(F.lit("Mode: "), F.col("mode"))),
                                     F.coalesce("_tags", F.array().cast("array<string>"))))
    name = name_of("path")
    stand_in = F.when(F.size(known) > 0, F.array_join(
        F.concat(F.array(F.concat(F.lit("Image file: "), name)), known), " | "))
    description = F.coalesce(blank_to_null("description"), stand_in)
    return joined.select(
        "path", F.concat(F.lit("[Image File: "), name, F.lit("]\n"), description).alias("text"),
        F.when(description.isNull(), F.lit(K.NO_IMAGE_TEXT)).alias("error"),
        description.alias("vision_description"))


