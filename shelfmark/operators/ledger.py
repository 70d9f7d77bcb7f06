"""The ledger of moves: record, list, undo, prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from .. import constants as K
from ..functions import paths
from ..runtime import cut_lineage
from .grouping import rank_in_group


def record_moves(resolved: DataFrame, session_id: str | None = None, ts=None) -> DataFrame:
    """One row per successful move, numbered in plan order within its session.

    ``resolved``: output of ``resolve_conflicts``; without ``session_id`` it has that column.
    """
    moves = resolved.filter(F.col("error").isNull())
    if session_id is not None:
        moves = moves.withColumn("session_id", F.lit(session_id))
    moves = moves.select("session_id", F.col("seq").alias("_plan"), "src", F.col("final_dst").alias("dst"),
                         (F.lit(0.0) if ts is None else ts).cast("double").alias("ts"))
    return rank_in_group(moves, ["session_id"], "_plan", "seq").select("session_id", "seq", "src", "dst", "ts")


def execution_report(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        (F.count_if(F.col("error").isNotNull()) == 0).alias("success"),
        F.count_if(F.col("error").isNull()).alias("moved"),
        F.count_if(F.col("error").isNotNull()).alias("errors"))


def folders_of(files: DataFrame, path: str = "path") -> DataFrame:
    """All folders that hold a file at any depth: distinct parents first, then their ancestors."""
    parents = files.select(paths.parent_of(path).alias("parent")).distinct()
    return parents.select(F.explode(paths.ancestors_of("parent")).alias("folder")).distinct()


def folders_created(resolved: DataFrame, existing: DataFrame) -> DataFrame:
    """(folder, first_seq): destination folders that did not exist, each at its first use."""
    used = (resolved.filter(F.col("error").isNull())
            .groupBy(paths.parent_of("final_dst").alias("folder")).agg(F.min("seq").alias("first_seq")))
    return used.join(existing.select("folder"), "folder", "left_anti")


def list_sessions(moves: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(session_id, created_at, move_count), newest first."""
    counts = moves.groupBy("session_id").agg(F.count("*").alias("move_count"))
    if sessions is not None:
        counts = sessions.select("session_id", "created_at").join(counts, "session_id", "left")
        counts = counts.withColumn("move_count", F.coalesce("move_count", F.lit(0)))
    else:
        moment = F.to_timestamp_ntz("session_id", F.lit("yyyyMMdd_HHmmss"))
        counts = counts.withColumn("created_at", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"))
    return counts.select("session_id", "created_at", "move_count").orderBy(F.desc("session_id"))


def latest_session(moves: DataFrame) -> DataFrame:
    """One row: the newest id, or the message that there is none."""
    newest = moves.agg(F.max("session_id").alias("session_id"))
    return newest.select("session_id", F.when(
        F.col("session_id").isNull(), F.lit(K.NO_SESSIONS)).alias("message"))


def undo(moves: DataFrame, current: DataFrame, session_id: str | None = None,
         overwrite: bool = False) -> DataFrame:
    """(undo_seq, src, dst, error) for one session, last move first.

    ``session_id`` None takes the newest. A file that left its destination is an error; so is
    an occupied origin, unless ``overwrite``. ``current``: (path) of the files there are now.
    """
    if session_id is None:
        newest = moves.agg(F.max("session_id").alias("session_id"))
        chosen = moves.join(newest, "session_id", "left_semi")
    else:
        chosen = moves.filter(F.col("session_id") == session_id)
    gates = _settled(_gates(chosen, current), overwrite)
    found = chosen.select("session_id", "seq", "src", "dst").join(gates, "seq")
    gone = F.when(~F.col("there"), F.concat(F.lit("File no longer at destination: "), F.col("dst")))
    taken = F.when(F.col("origin") & ~F.col("alone") & F.lit(not overwrite),
                   F.concat(F.lit("Origin is occupied: "), F.col("src")))
    return (found.withColumn("error", F.coalesce(gone, taken))
            .select("session_id", "seq", "src", "dst", "error").orderBy(F.desc("seq")))


def _gates(moves: DataFrame, current: DataFrame) -> DataFrame:
    """(seq, alone, origin, origin_of, there, there_of): is there a file at both ends before a move is undone?

    An end that no move touched before is known from the snapshot; any other is what the move named in ``_of``
    leaves there, as ``2 * seq`` for the src of that move and ``2 * seq + 1`` for its dst. ``alone``: src is dst.
    """
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("path")),
                   F.struct(F.lit(1).alias("side"), F.col("dst").alias("path")))
    ends = moves.select("seq", F.inline(F.when(F.col("src") == F.col("dst"), F.slice(both, 2, 1)).otherwise(both)))
    undone_before = Window.partitionBy("path").orderBy(F.desc("seq"), "side")
    snapshot = current.select("path").distinct().withColumn("_here", F.lit(True))
    seen = (ends.withColumn("of", F.lag(2 * F.col("seq") + F.col("side")).over(undone_before))
            .join(snapshot, "path", "left")
            .withColumn("is_there", F.when(F.col("of").isNull(), F.coalesce("_here", F.lit(False)))))

    def end(side, column):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    alone = F.count("*") == 1
    return seen.groupBy("seq").agg(
        alone.alias("alone"), F.when(alone, F.lit(True)).otherwise(end(0, "is_there")).alias("origin"),
        end(0, "of").alias("origin_of"), end(1, "is_there").alias("there"), end(1, "of").alias("there_of"))


def _settled(gates: DataFrame, overwrite: bool) -> DataFrame:
    """``_gates`` with both ends known.

    A move that is undone leaves a file at src if there was one at either end, and one at dst if there was one
    at both (with ``overwrite`` none). So once one end is known, what the move leaves is known as well or the
    same as at its other end, and can be looked up one move further. Every round does that for all moves
    at once, which halves a chain of moves; its length costs rounds in the logarithm. Only a move with
    two open ends waits for one of them.
    """
    while True:
        counted = Observation()
        gates = cut_lineage(gates.observe(
            counted, F.count_if(F.col("origin").isNull() | F.col("there").isNull()).alias("open")))
        if not counted.get["open"]:
            return gates.select("seq", "alone", "origin", "there")
        at_src = F.col("origin") | F.col("there")  # null: open
        at_dst = F.col("origin") & F.col("there")
        if overwrite:
            at_dst = F.when(F.col("alone"), at_dst).otherwise(F.lit(False))
        same_as = F.when(F.col("origin").isNotNull(), F.col("there_of")).when(F.col("there").isNotNull(), F.col("origin_of"))
        left = gates.select(F.inline(F.array(
            F.struct((2 * F.col("seq")).alias("of"), at_src.alias("is_there"), same_as.alias("same_as")),
            F.struct((2 * F.col("seq") + 1).alias("of"), at_dst.alias("is_there"), same_as.alias("same_as")))))
        asked = gates.select("seq", F.inline(F.array(
            F.struct(F.lit(0).alias("side"), F.col("origin_of").alias("of")),
            F.struct(F.lit(1).alias("side"), F.col("there_of").alias("of"))))).filter("of is not null")
        answers = (asked.join(left, "of").withColumn("next", F.when(
            F.col("is_there").isNull(), F.coalesce("same_as", "of"))).groupBy("seq").pivot("side", [0, 1])
            .agg(F.max("is_there").alias("is"), F.max("next").alias("of")))
        gates = gates.join(answers, "seq", "left").select(
            "seq", "alone", F.coalesce("origin", "0_is").alias("origin"), F.col("0_of").alias("origin_of"),
            F.coalesce("there", "1_is").alias("there"), F.col("1_of").alias("there_of"))


def undone_catalog(current: DataFrame, undone: DataFrame) -> DataFrame:
    """Paths after an undo: of what the undo did to a path the last step counts."""
    done = undone.filter(F.col("error").isNull())
    steps = done.select(F.col("src").alias("path"), "seq", F.lit(True).alias("adds")).unionByName(
        done.select(F.col("dst").alias("path"), "seq", F.lit(False).alias("adds")))
    # the smallest seq is undone last; a move onto itself leaves the file
    last = steps.groupBy("path").agg(F.min_by("adds", F.struct("seq", ~F.col("adds"))).alias("adds"))
    return (current.select("path").join(last, "path", "left_anti")
            .unionByName(last.filter("adds").select("path")))


def undo_report(undone: DataFrame, session_id: str) -> DataFrame:
    """One row; the session is kept when anything failed, and it is not found when it has no moves."""
    errors = F.count_if(F.col("error").isNotNull())
    known = F.count("*") > 0
    return undone.agg(
        (known & (errors == 0)).alias("success"),
        F.count_if(F.col("error").isNull() & F.col("session_id").isNotNull()).alias("restored"),
        errors.alias("errors"),
        (known & (errors > 0)).alias("session_kept"),
        F.when(~known, F.lit(f"Session not found: {session_id}")).alias("message"),
        F.lit(session_id).alias("session_id"))


def empty_folders(created: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Folders made by a session, and folders above them below ``root``, that hold no file any more."""
    candidates = (created.select("folder").distinct()
                  .select(F.explode(paths.ancestors_of("folder", root)).alias("folder")).distinct())
    return candidates.join(folders_of(files), "folder", "left_anti")


def prune_sessions(moves: DataFrame, keep: int = K.KEEP_SESSIONS) -> DataFrame:
    """Only the moves of the newest sessions."""
    newest = moves.select("session_id").distinct().orderBy(F.desc("session_id")).limit(keep)
    return moves.join(newest, "session_id", "left_semi")
