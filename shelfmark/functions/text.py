"""Column functions over text. All of them compile to built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def py_strip(col) -> Column:
    """Both ends without Unicode white space (``trim`` alone takes only blanks)."""
    return F.btrim(as_col(col), F.lit(K.PY_WHITESPACE))


def universal_newlines(col) -> Column:
    return F.replace(F.replace(as_col(col), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def blank_to_null(col) -> Column:
    return F.nullif(as_col(col), F.lit(""))


def short_float(col, places: int = 3) -> Column:
    """A number the way ``str(round(x, places))`` prints it, at any magnitude."""
    text = F.format_string(f"%.{places}f", as_col(col).cast("double"))
    return F.regexp_replace(text, r"(\.\d+?)0+\z", "$1")


def capitalize(word) -> Column:
    """First character in title case, the others in lower case."""
    first = F.substring(word, 1, 1)
    # lower() runs over the whole word so that a final sigma sees what precedes it
    rest = F.substr(F.lower(word), F.length(F.lower(first)) + 1)
    return F.concat(F.initcap(first), rest)


def slugify(col, max_chars: int = K.SLUG_CHARS) -> Column:
    """Folder-safe name: letters, numbers, ``_`` and ``-`` only, words capitalised."""
    kept = F.regexp_replace(as_col(col), r"(?U)[^\p{L}\p{N}_\s\x1C-\x1F\-]", "")
    joined = F.regexp_replace(py_strip(kept), r"(?U)[\s\x1C-\x1F_]+", "_")
    words = F.split(F.regexp_replace(joined, "-+", "-"), "_")
    # words that start behind the cut cannot come into view: capitalising never shortens a text
    seen = F.slice(words, 1, max_chars)
    return F.btrim(F.left(F.array_join(F.transform(seen, capitalize), "_"), F.lit(max_chars)), F.lit("_"))


# a cell starts with a comma or a line break; a quoted stretch right behind another one is a doubled quote; what
# follows a closing quote stands as it is. No piece repeats a group, so long cells need no deep recursion.
_CSV_BREAK = r"(?:,|\r\n|\r|\n)"
_CSV_QUOTED, _CSV_BARE = r'"[^"]*+(?:"|\z)', r'[^",\r\n][^,\r\n]*+'


def csv_pieces(text) -> Column:
    """The pieces of CSV text in order, its last line break left out; ``csv_record`` puts a record's together."""
    pattern = f"{_CSV_BREAK}(?:{_CSV_QUOTED}|{_CSV_BARE}|)|{_CSV_QUOTED}|{_CSV_BARE}"
    found = F.regexp_extract_all(F.concat(F.lit("\n"), as_col(text)), F.lit(pattern), F.lit(0))
    return let(found, lambda p: F.when((F.size(p) > 1) & _is_break(F.element_at(p, -1)), F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def _is_break(piece: Column) -> Column:
    return piece.isin("\n", "\r", "\r\n")


def _cut_at(pieces: Column, firsts: tuple[str, ...], n: int | None, body) -> Column:
    """``body`` of the pieces from one that starts with any of ``firsts`` to the next such one; ``n`` stretches at most."""
    end = F.size(pieces) + 1

    def stretches(starts: Column) -> Column:
        return F.transform(starts if n is None else F.slice(starts, 1, n), lambda at, k: body(
            F.slice(pieces, at, F.coalesce(F.get(starts, k + 1), end) - at)))

    return let(F.filter(F.sequence(F.lit(1), F.size(pieces)),
                        lambda i: F.left(F.element_at(pieces, i), F.lit(1)).isin(*firsts)), stretches)


def csv_record(pieces: Column) -> Column:
    """The cells of one record; an empty line has none."""
    def content(piece: Column) -> Column:
        behind = F.substr(piece, F.when(piece.startswith("\r\n"), 3).otherwise(2))
        bare = F.replace(piece, F.lit('"'), F.lit(""))
        return (F.when(piece.startswith('"'), F.concat(F.lit('"'), bare))
                .when(~F.left(piece, F.lit(1)).isin(",", "\n", "\r"), piece)
                .when(behind.startswith('"'), F.replace(behind, F.lit('"'), F.lit(""))).otherwise(behind))

    def cells(own: Column) -> Column:
        return F.when((F.size(own) == 1) & _is_break(F.element_at(own, 1)), F.array().cast("array<string>")).otherwise(
            _cut_at(own, (",", "\n", "\r"), None, lambda cell: F.array_join(F.transform(cell, content), "")))

    return let(pieces, cells)


def csv_records(text, n: int) -> Column:
    """The cells of the first ``n`` records of CSV text; quoted cells may hold commas, quotes and line breaks."""
    text = as_col(text)

    def plain(lines: Column) -> Column:
        ended = (F.size(lines) > 1) & (F.size(lines) <= n) & (F.element_at(lines, -1) == "")
        kept = F.slice(lines, 1, F.least(F.size(lines) - ended.cast("int"), F.lit(n)))
        return F.transform(kept, lambda line: F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, ",")))

    quoted = let(csv_pieces(text), lambda pieces: _cut_at(pieces, ("\n", "\r"), n, csv_record))
    # without a quote nothing behind the first lines matters
    return F.when(text.contains('"'), quoted).otherwise(let(F.split(text, r"\r\n|\r|\n", n + 1), plain))


def csv_left_open(line, inside: bool) -> Column:
    """Whether a quoted cell is open behind a line that starts a record, or starts ``inside`` a quoted cell."""
    # a doubled quote never changes whether a cell is open, wherever it stands
    text = F.replace(F.concat(F.lit(',"' if inside else ","), as_col(line)), F.lit('""'), F.lit(""))
    return F.regexp_replace(text, r',(?:"[^"]*+"[^,]*+|[^",][^,]*+|(?=,|\z))', "") != ""
