"""Whole runs: from a catalog to a plan, from a plan to a ledger, and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import blank_to_null
from ..operators import clusters, enrich as E, layout, ledger, routing, vectors
from ..operators.conflicts import resolve_conflicts
from ..runtime import cut_lineage


def cluster_records(records: DataFrame, name_fn: Callable | None = None, embed_fn: Callable | None = None,
                    algorithm: str = "kmeans", **options) -> DataFrame:
    """Add ``cluster_label`` to records with seq, name, text, topic: embed, cluster, name, attach.

    ``name_fn`` makes a model ``list of prompts -> list of replies``; without one each cluster
    takes its first topic.
    """
    text = F.coalesce(blank_to_null("text"), F.col("name"))
    embedded = cut_lineage(vectors.embed_text(records.select("seq", text.alias("text")), embed_fn)
                           .select(F.col("seq").alias("id"), "vec"))
    labels = cut_lineage(clusters.cluster(embedded, algorithm, **options))
    labelled = records.join(labels.withColumnRenamed("id", "seq"), "seq")
    prompts = E.naming_prompt(labelled.select("cluster", "seq", "topic"))
    if name_fn is None:
        replies = prompts.withColumn("reply", F.split_part("topics", F.lit(", "), F.lit(1)))
    else:
        replies = E.score_batches(prompts, name_fn, "prompt", "reply")
    return E.attach_names(labelled, E.with_cluster_name(replies))


def organise(records: DataFrame, root: str, mode: str, **cluster_options) -> DataFrame:
    """The plan for enriched records.

    Records: seq, path, name, category; for "topic" and "relation" also topic and confidence
    (see ``enrich``); for "date" modified_time; for "relation" text. Clustering is only built
    into the plan when the mode asks for it.
    """
    if mode == "relation" and "cluster_label" not in records.columns:
        records = cluster_records(records, **cluster_options)
    return layout.build_plan(records, root, mode)


def enriched_records(files: DataFrame, extracted: DataFrame, model_fn: Callable | None = None,
                     replies: DataFrame | None = None) -> DataFrame:
    """Files with text and metadata: a model answers a prompt per file, or replies (path, reply) are given."""
    texts = routing.text_or_default(files.join(extracted.select("path", "text", "success"), "path", "left"))
    if replies is not None:
        answered = texts.join(replies.select("path", "reply"), "path", "left")
    else:
        answered = E.score_batches(E.metadata_prompt(texts), model_fn, "prompt", "reply").drop("prompt")
    done = E.enrich(answered)
    return done.select(*[c for c in done.columns if c not in ("reply", "metadata")], "metadata.*")


@dataclass
class Execution:
    resolved: DataFrame
    moves: DataFrame
    folders: DataFrame
    report: DataFrame


def execute(plan: DataFrame, existing: DataFrame, session_id: str) -> Execution:
    """Resolve a plan against the current catalog and derive the ledger rows of the session."""
    resolved = cut_lineage(resolve_conflicts(plan, existing))
    return Execution(
        resolved=resolved,
        moves=ledger.record_moves(resolved, session_id, F.unix_micros(F.current_timestamp()) / 1e6),
        folders=ledger.folders_created(resolved, ledger.folders_of(existing)),
        report=ledger.execution_report(resolved))


def undo_and_report(moves: DataFrame, folders: DataFrame, current: DataFrame, root: str,
                    session_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog after the undo, folders to remove, report)."""
    undone = cut_lineage(ledger.undo(moves, current, session_id))
    after = ledger.undone_catalog(current, undone)
    return after, ledger.empty_folders(folders, after, root), ledger.undo_report(undone, session_id)
