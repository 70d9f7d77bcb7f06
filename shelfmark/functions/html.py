"""Text of HTML pages with built-in expressions only."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, functions as F

from .. import constants as K
from .text import as_col, let, py_strip

_BREAK = "\x01"
# Names that occur in nearly every page are looked up before the full table.
_COMMON = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "apos;": "'", "nbsp;": " "}


def _lookup(table: dict[str, str]) -> Column:
    # two literals and a split fold into one constant; thousands of literals would be slow to plan
    names, chars = "\x02".join(table), "\x02".join(table.values())
    return F.map_from_arrays(F.split(F.lit(names), "\x02"), F.split(F.lit(chars), "\x02"))


def _decode(piece: Column) -> Column:
    """``piece`` is what follows an ``&``; turn a leading reference into its character."""
    name = F.regexp_extract(piece, r"^[A-Za-z][A-Za-z0-9]*;?", 0)
    decimal = F.regexp_extract(piece, r"^#0*([0-9]+);?", 1)
    hexa = F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]+);?", 1)
    number = (F.when(F.length(decimal).between(1, 7), decimal.cast("int"))
              .when(F.length(hexa).between(1, 6), F.conv(hexa, 16, 10).cast("int")))
    # UTF-32 reaches every code point; chr() stops at 255
    char = F.when((number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF),
                  F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    used = F.length(F.regexp_extract(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0))
    named = F.coalesce(F.try_element_at(_lookup(_COMMON), name),
                       F.try_element_at(_lookup(html.entities.html5), name))
    return F.coalesce(F.concat(named, F.substr(piece, F.length(name) + 1)),
                      F.concat(char, F.substr(piece, used + 1)),
                      F.concat(F.lit("&"), piece))


def unescape(col) -> Column:
    """Named and numeric character references of HTML."""
    def decoded(text: Column) -> Column:
        # every piece but the first follows an ampersand
        return let(F.split(text, "&"), lambda pieces: F.array_join(F.transform(
            pieces, lambda p, i: F.when(i == 0, p).otherwise(_decode(p))), ""))

    return let(as_col(col), lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


# scripts and styles whole (what looks like a tag inside is none), comments, tags, declarations
_MARKUP = (r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|</?[A-Za-z][^>]*>|<[!?][^>]*>")


def open_names(stack: Column, name: Column, leaf: Column) -> Column:
    """Open elements, written /a/b/, after a tag; ``name`` starts with / for an end tag.

    An end tag closes everything up to the last element of its name, or nothing where none is open.
    ``leaf``: the tag opens and closes at once.
    """
    ended = F.concat(name, F.lit("/"))
    behind = F.length(F.call_function("substring_index", stack, ended, F.lit(-1)))
    closed = F.when(F.contains(stack, ended), F.left(stack, F.length(stack) - behind - F.length(ended) + 1)).otherwise(stack)
    return F.when((name == "") | leaf, stack).when(F.startswith(name, F.lit("/")), closed).otherwise(
        F.concat(stack, name, F.lit("/")))


def html_text(col, max_chars: int | None = K.HTML_CHARS) -> Column:
    """Text nodes, stripped, one per line; scripts, styles and page furniture left out.

    Furniture goes with all that is nested in it; left unclosed, it ends with the element around it.
    """
    whole = F.replace(as_col(col), F.lit(_BREAK), F.lit(" "))
    nodes = F.transform(F.split(unescape(F.regexp_replace(whole, _MARKUP, _BREAK)), _BREAK), py_strip)
    tags = F.transform(F.regexp_extract_all(whole, F.lit(_MARKUP), F.lit(0)), lambda t: F.struct(
        F.lower(F.regexp_extract(t, r"^<(/?[A-Za-z][^\s/>]*)", 1)).alias("name"), F.endswith(t, F.lit("/>")).alias("closed")))
    steps = F.zip_with(nodes, tags, lambda n, t: F.struct(n.alias("node"), t["name"].alias("name"), t["closed"].alias("closed")))
    dropped = "/(?:" + "|".join(K.HTML_DROPPED_TAGS) + ")/"

    def step(a: Column, s: Column) -> Column:
        wanted = (s["node"] != "") & ~a["stack"].rlike(dropped)
        if max_chars:
            wanted &= F.length(a["out"]) < max_chars
        leaf = s["closed"] | s["name"].isin("script", "style", *K.HTML_VOID_TAGS)
        return F.struct(
            F.when(s["name"].isNull(), a["stack"]).otherwise(open_names(a["stack"], s["name"], leaf)).alias("stack"),
            F.when(wanted, F.concat(a["out"], F.when(a["out"] == "", "").otherwise("\n"), s["node"])).otherwise(a["out"]).alias("out"))

    lines = F.aggregate(steps, F.struct(F.lit("/").alias("stack"), F.lit("").alias("out")), step)["out"]
    return F.left(lines, F.lit(max_chars)) if max_chars else lines


def strip_tags(col, max_chars: int = K.HTML_CHARS) -> Column:
    return F.left(F.regexp_replace(as_col(col), r"<[^>]+>", " "), F.lit(max_chars))
