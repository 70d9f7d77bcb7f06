"""The two-level layout: first-level folder by topic, month or cluster, second by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import paths
from ..functions.text import blank_to_null, slugify
from .grouping import rank_all


def topic_folder(topic="topic", confidence="confidence", threshold: float = K.CONFIDENCE_THRESHOLD) -> Column:
    unsure = F.coalesce(F.col(topic), F.lit("")).eqNullSafe("") | \
        (F.coalesce(F.col(confidence), F.lit(0.0)) < threshold)
    return F.when(unsure, F.lit(K.MISC_FOLDER)).otherwise(F.col(topic))


def date_folder(modified="modified_time", pattern: str = "yyyy-MM", text: bool = False) -> Column:
    """Month of the modification time; ``text`` for a column of ISO strings."""
    moment = F.col(modified)
    if text:
        iso = F.when(moment.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), moment)
        moment = iso.try_cast("timestamp_ntz")
    return F.coalesce(F.date_format(moment, pattern), F.lit(K.UNKNOWN_DATE))


def relation_folder(label="cluster_label", topic="topic") -> Column:
    label, topic = F.coalesce(F.col(label), F.lit("")), F.coalesce(F.col(topic), F.lit(""))
    return (F.when(label == "", F.lit(K.MISC_FOLDER))
            .when((topic != "") & F.startswith(label, F.lit("cluster_")), topic)
            .otherwise(label))


def level1_for(mode: str) -> Column:
    if mode == "topic":
        return topic_folder()
    if mode == "date":
        return date_folder()
    if mode == "relation":
        return relation_folder()
    return F.lit(K.MISC_FOLDER)


def with_order(df: DataFrame, *order: str) -> DataFrame:
    """Add the plan order ``seq`` where the catalog has none; path order by default."""
    return rank_all(df, *(order or ("path",)))


def build_plan(records: DataFrame, root: str, mode: str) -> DataFrame:
    """(seq, src, dst, category, topic, name, level1, level2) for records with seq, path, name, category."""
    topic = level1_for(mode)
    slug, level2 = blank_to_null(slugify("topic")), paths.level2_of("category")
    return (records.select("seq", F.col("path").alias("src"), "category", "name", topic.alias("topic"))
            .withColumns({"level1": slug, "level2": level2})
            .select("seq", "src",
                    F.concat_ws("/", F.lit(root.rstrip("/")), "level1", "level2", "name").alias("dst"),
                    "category", "topic", "name", "level1", "level2"))


def plan_preview(plan: DataFrame) -> DataFrame:
    """One row per file under its folder, folders sorted, files in plan order.

    Rows instead of one list per folder: a folder with a third of all files stays spread.
    """
    return (plan.select(paths.parent_of("dst").alias("folder"), "seq", paths.name_of("dst").alias("name"))
            .orderBy("folder", "seq"))


def plan_folders(plan: DataFrame) -> DataFrame:
    """Files per destination folder."""
    return plan.groupBy(paths.parent_of("dst").alias("folder")).agg(F.count("*").alias("files"))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan_folders(plan).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
                                  F.count("*").alias("folders"))
