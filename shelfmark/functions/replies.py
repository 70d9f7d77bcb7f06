"""Metadata out of raw model replies, natively with the VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .text import as_col, let, py_strip

METADATA_TYPE = ("struct<topic:string,summary:string,keywords:array<string>,"
                 "confidence:double,file_date:string>")
# Follows the candidate inside the probing array, see strict_json.
_END = "\u0002end"
_JSON_STARTS = list('{["-0123456789tfn')
_JSON_BLANKS = " \t\r\n"


def strict_json(text) -> Column:
    """VARIANT of ``text`` when all of it is one JSON value (no blanks in front), else null.

    The parser ignores what follows a complete value, so the candidate is put in an array in
    front of an end mark: only a whole single value leaves the mark at the second place.
    """
    def parsed(candidate: Column) -> Column:
        probe = F.try_parse_json(F.concat(F.lit("["), candidate, F.lit(',"\\u0002end"]')))
        return let(F.try_variant_get(probe, "$", "array<variant>"), lambda a: F.when(
            (F.size(a) == 2) & (F.try_variant_get(F.get(a, F.lit(1)), "$", "string") == _END), F.get(a, F.lit(0))))

    # prose is told from JSON by its first character, without a failing parse
    return let(as_col(text), lambda t: F.when(F.left(t, F.lit(1)).isin(*_JSON_STARTS), parsed(t)))


def fix_json(text) -> Column:
    """Drop commas before a closing bracket; turn plain single-quoted strings into double-quoted."""
    no_commas = F.regexp_replace(as_col(text), r"(?U),[\s\x1C-\x1F]*([}\]])", "$1")
    return F.regexp_replace(no_commas, r"'([^'\\]*)'", '"$1"')


def fenced_blocks(reply) -> Column:
    """What stands between pairs of ``` marks, without the label "json" and outer blanks."""
    pieces = F.split(as_col(reply), "```")
    # pieces 1, 3, 5, ... are inside, the last piece has no closing mark
    inside = F.filter(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: i % 2 == 1)
    return F.transform(inside, lambda p: py_strip(
        F.when(F.lower(F.left(p, F.lit(4))) == "json", F.substr(p, F.lit(5))).otherwise(p)))


def extract_json(reply) -> Column:
    """First value that parses: whole reply, each fenced block, {...}, [...], repaired reply."""
    reply = as_col(reply)
    fenced = F.try_element_at(
        F.filter(F.transform(fenced_blocks(reply), strict_json), lambda v: v.isNotNull()), F.lit(1))
    return F.coalesce(
        strict_json(py_strip(reply)),
        F.when(F.contains(reply, F.lit("```")), fenced),
        strict_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0)),
        strict_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0)),
        strict_json(F.btrim(fix_json(reply), F.lit(_JSON_BLANKS))),
    )


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _printed(value: Column) -> Column:
    """Text of any JSON value; null and booleans as the words None, True, False."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def _truthy(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    return (F.when(kind == "VOID", F.lit(False))
            .when(kind == "STRING", text != "")
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}"))
            .otherwise(F.coalesce(number != 0, F.lit(True))))


def validate_metadata(value) -> Column:
    """Five typed fields out of a VARIANT; null when it is not an object."""
    value = as_col(value)

    def field(name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "variant")

    def text(name: str, default: str, cap: int) -> Column:
        return F.coalesce(let(field(name), lambda v: F.left(py_strip(_printed(v)), F.lit(cap))), F.lit(default))

    confidence = F.coalesce(F.try_variant_get(value, "$.confidence", "double"), F.lit(0.0))
    listed = F.try_variant_get(value, "$.keywords", "array<variant>")
    keywords = F.slice(F.transform(F.filter(listed, _truthy), lambda k: py_strip(_printed(k))),
                       1, K.MAX_KEYWORDS)
    date = let(field("file_date"), lambda v: F.when(
        ~F.is_variant_null(v), F.try_variant_get(v, "$", "string")))
    return F.when(is_object(value), F.struct(
        text("topic", K.DEFAULT_TOPIC, K.TOPIC_CHARS).alias("topic"),
        text("summary", "", K.SUMMARY_CHARS).alias("summary"),
        F.coalesce(keywords, F.array().cast("array<string>")).alias("keywords"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        date.alias("file_date"),
    ))


def default_metadata() -> Column:
    return F.struct(
        F.lit(K.DEFAULT_TOPIC).alias("topic"),
        F.lit("").alias("summary"),
        F.array().cast("array<string>").alias("keywords"),
        F.lit(0.0).alias("confidence"),
        F.lit(None).cast("string").alias("file_date"),
    ).cast(METADATA_TYPE)


def cluster_name(reply) -> Column:
    """First line of a naming reply, at most 50 characters."""
    first = F.split_part(py_strip(reply), F.lit("\n"), F.lit(1))
    name = F.left(py_strip(first), F.lit(K.CLUSTER_NAME_CHARS))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(K.MISC_FOLDER))
