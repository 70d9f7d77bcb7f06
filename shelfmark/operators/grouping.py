"""Per-group work that stays even when one group holds a large share of all rows.

A plain window puts a whole group into one task. Here a group is cut into ranges of its
integer order column, so no task sees more than one range of one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut_lineage

RANGE_BITS = 20  # rows of one group handled together: at most 2^20 distinct order values
TEXT_BITS = 12


def join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on group keys where a null key is a group like any other."""
    other = right.select(*[F.col(c).alias(f"_key_{c}" if c in keys else c) for c in right.columns])
    same = [left[k].eqNullSafe(other[f"_key_{k}"]) for k in keys]
    return left.join(other, same).drop(*[f"_key_{k}" for k in keys])


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                  bits: int = RANGE_BITS) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come strictly before.

    ``order`` is a bigint that is unique within a group and does not change between reads.
    """
    ranged = df.withColumns({"_range": F.shiftright(order, bits), "_value": value.cast("bigint")})
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range",
                            F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0)))
            .transform(join_groups, offsets, [*keys, "_range"])
            .withColumn(out, F.col("_local") + F.col("_offset"))
            .drop("_range", "_value", "_local", "_offset"))


def running_last(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                 bits: int = RANGE_BITS) -> DataFrame:
    """Add ``out``: the last ``value`` that is not null among the rows of the group strictly before, or null."""
    ranged = df.withColumns({"_range": F.shiftright(order, bits), "_value": value})
    lasts = ranged.groupBy(*keys, "_range").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_local", F.last("_value", ignorenulls=True).over(within))
            .transform(join_groups, carried, [*keys, "_range"])
            .withColumn(out, F.coalesce("_local", "_carried"))
            .drop("_range", "_value", "_local", "_carried"))


def rank_in_group(df: DataFrame, keys: list[str], order: str, out: str = "rank",
                  bits: int = RANGE_BITS) -> DataFrame:
    """Zero-based position of each row within its group."""
    return running_total(df, keys, order, F.lit(1), out, bits)


def rank_all(df: DataFrame, *order: str, out: str = "seq") -> DataFrame:
    """Zero-based position of each row in the sorted whole, without a single-task window.

    The sorted ranges are written once, so that both uses below see the same ranges.
    """
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(df.repartitionByRange(ranges, *order)
                         .withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    # one row per range: at most spark.sql.shuffle.partitions rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (ranged.withColumn("_local", local).join(offsets, "_part")
            .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
            .drop("_part", "_local", "_offset"))


def _concat_sorted(order: str, text: str, sep: str, max_chars: int | None) -> Column:
    pieces = F.sort_array(F.collect_list(
        F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    joined = F.array_join(F.transform(pieces, lambda p: p["t"]), sep)
    return F.left(joined, F.lit(max_chars)) if max_chars else joined


def join_lines(df: DataFrame, keys: list[str], order: str, text: str, sep: str, out: str,
               max_chars: int | None = None, bits: int = TEXT_BITS,
               also: dict[str, tuple[Column, Callable[[str], Column]]] | None = None) -> DataFrame:
    """Ordered concatenation of ``text`` per group; null texts are left out, none left -> "".

    ``also`` adds aggregates: name -> (aggregate per range, aggregate that merges ranges).

    Pieces are joined range by range first. Cutting a partial result at ``max_chars`` never
    changes the first ``max_chars`` characters of the whole, so with a cap nothing grows.
    """
    piece = F.left(text, F.lit(max_chars)) if max_chars else F.col(text)
    also = also or {}
    ranged = df.withColumns({"_order": F.col(order), "_text": piece,
                             "_range": F.shiftright(F.col(order).cast("bigint"), bits)})
    partial = ranged.groupBy(*keys, "_range").agg(
        _concat_sorted("_order", "_text", sep, max_chars).alias("_text"),
        F.count("_text").alias("_filled"), *[first.alias(name) for name, (first, _) in also.items()])
    partial = partial.withColumn("_text", F.when(F.col("_filled") > 0, F.col("_text")))
    return partial.groupBy(*keys).agg(
        _concat_sorted("_range", "_text", sep, max_chars).alias(out),
        *[merge(name).alias(name) for name, (_, merge) in also.items()])
