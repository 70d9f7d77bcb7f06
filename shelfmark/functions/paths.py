"""Column functions over ``/``-separated paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import constants as K
from .text import as_col


def name_of(path) -> Column:
    return F.substring_index(as_col(path), "/", -1)


def parent_of(path) -> Column:
    """Folder of a path: everything before the last slash ("/" for entries of the root)."""
    path = as_col(path)
    cut = F.regexp_replace(path, r"/[^/]*\z", "")
    return F.when((cut == "") & F.startswith(path, F.lit("/")), F.lit("/")).otherwise(cut)


def suffix_of(name) -> Column:
    """The part from the last dot; none when that dot is the first or the last character."""
    return F.regexp_extract(as_col(name), r"(?s)^.+(\.[^.]+)\z", 1)


def stem_of(name) -> Column:
    name = as_col(name)
    return F.left(name, F.length(name) - F.length(suffix_of(name)))


def extension_of(name) -> Column:
    return F.lower(suffix_of(name))


def one_of(col: Column, table: dict[str, list[str]], default) -> Column:
    """CASE over set memberships: compiled code, no join and no map lookup per row."""
    first, *rest = table.items()
    chain = reduce(lambda acc, kv: acc.when(col.isin(kv[1]), F.lit(kv[0])), rest,
                   F.when(col.isin(first[1]), F.lit(first[0])))
    return chain.otherwise(default)


def category_of(extension) -> Column:
    return one_of(as_col(extension), K.CATEGORIES, F.lit(K.UNKNOWN))


def level2_of(category) -> Column:
    table = {folder: [category] for category, folder in K.LEVEL2_FOLDERS.items()}
    return one_of(as_col(category), table, F.lit(K.LEVEL2_DEFAULT))


def numbered(path, counter) -> Column:
    """``a/x.txt`` and 2 -> ``a/x_2.txt``; counter 0 leaves the path alone."""
    path, counter = as_col(path), as_col(counter)
    suffix = suffix_of(name_of(path))
    base = F.left(path, F.length(path) - F.length(suffix))
    return F.when(counter == 0, path).otherwise(
        F.concat(base, F.lit("_"), counter.cast("string"), suffix))


def ancestors_of(folder, below=None) -> Column:
    """The folder and all folders above it, as an array; only those strictly below ``below``."""
    parts = F.split(as_col(folder), "/")
    chain = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
                        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    if below is None:
        return chain
    prefix = below.rstrip("/") + "/"
    return F.filter(chain, lambda f: F.startswith(f, F.lit(prefix)))
