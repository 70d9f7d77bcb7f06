from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as G
from ..operators.conflicts import resolve_conflicts
from ..runtime import cut_lineage, scratch_path
from ..sources import sessions as S
from . import derived as D
from .registry import query

WITH = "WITH " + D.LEDGER_SQL + " "
RESOLVED = "WITH " + ", ".join([D.CATALOG_SQL, D.DATE_PLAN_SQL, D.RESOLVED_SQL]) + " "
SESSION = "20240201_000000"
_PARENT = "regexp_replace({}, '/[^/]*$', '')"


def _resolved(t):
    # written once, as the ledger reads it more than once
    return cut_lineage(resolve_conflicts(D.date_plan(t), D.existing(t))).withColumn(
        "session_id", F.concat(F.replace("topic", F.lit("-"), F.lit("")), F.lit("01_000000")))


def _moves(t):
    return cut_lineage(G.record_moves(_resolved(t)))


def _current(moves):
    there = moves.filter((F.col("seq") + 1) % 17 != 0).select(F.col("dst").alias("path"))
    return there.unionByName(moves.filter(F.col("seq") % 19 == 5).select(F.col("src").alias("path"))).distinct()


@query("execution_report", RESOLVED + """SELECT count(*) FILTER (error IS NOT NULL) = 0 AS success,
  count(*) FILTER (error IS NULL) AS moved, count(*) FILTER (error IS NOT NULL) AS errors FROM resolved""")
def execution_report(t):
    return G.execution_report(_resolved(t))


@query("record_moves", WITH + "SELECT session_id, seq, src, dst FROM moves")
def record_moves(t):
    return G.record_moves(_resolved(t)).select("session_id", "seq", "src", "dst")


# folders of the snapshot: all parents of its files and the folders above those
FOLDERS_SQL = """paths AS (SELECT DISTINCT string_split(path, '/') AS p FROM {0}),
folders{1} AS (SELECT DISTINCT array_to_string(p[:n], '/') AS folder FROM
  (SELECT p, unnest(range(2, len(p))) AS n FROM paths))"""


@query("folders_created", RESOLVED[:-1] + ", " + FOLDERS_SQL.format("existing", "") + f""" SELECT {_PARENT.format('final_dst')} AS folder, min(seq) AS first_seq
  FROM resolved WHERE error IS NULL AND {_PARENT.format('final_dst')} NOT IN (SELECT folder FROM folders) GROUP BY 1""")
def folders_created(t):
    return G.folders_created(_resolved(t), G.folders_of(D.existing(t)))


@query("list_sessions", WITH + """SELECT session_id, strftime(strptime(session_id, '%Y%m%d_%H%M%S'), '%Y-%m-%dT%H:%M:%S') AS created_at,
  count(*) AS move_count FROM moves GROUP BY session_id""")
def list_sessions(t):
    return G.list_sessions(G.record_moves(_resolved(t)))


@query("latest_session", WITH + "SELECT max(session_id) AS session_id, coalesce(CASE WHEN count(*) = 0 THEN 'No undo sessions found.' END, 'found') AS message FROM moves")
def latest_session(t):
    return G.latest_session(G.record_moves(_resolved(t))).select("session_id", F.coalesce("message", F.lit("found")).alias("message"))


UNDO_SQL = WITH[:-1] + ", " + D.CURRENT_SQL + f""", undone AS (SELECT seq, src, dst, CASE
    WHEN dst NOT IN (SELECT path FROM current_files) THEN concat('File no longer at destination: ', dst)
    WHEN src IN (SELECT path FROM current_files) THEN concat('Origin is occupied: ', src) END AS error
  FROM moves WHERE session_id = '{SESSION}') """


def _undone(t):
    moves = _moves(t)
    return moves, _current(moves), G.undo(moves, _current(moves), SESSION)


@query("undo_session", UNDO_SQL + "SELECT seq, src, dst, coalesce(error, 'none') AS error FROM undone")
def undo_session(t):
    return _undone(t)[2].select("seq", "src", "dst", F.coalesce("error", F.lit("none")).alias("error"))


@query("undo_report", UNDO_SQL + f"""SELECT count(*) > 0 AND count(error) = 0 AS success, count(*) FILTER (error IS NULL) AS restored,
  count(error) AS errors, count(error) > 0 AS session_kept, CASE WHEN count(*) = 0 THEN 'Session not found: {SESSION}' ELSE 'found' END AS message,
  '{SESSION}' AS session_id FROM undone""")
def undo_report(t):
    report = G.undo_report(_undone(t)[2], SESSION)
    return report.withColumn("message", F.coalesce("message", F.lit("found")))


@query("undone_catalog", UNDO_SQL + """SELECT coalesce(u.src, c.path) AS path FROM current_files c
  LEFT JOIN undone u ON c.path = u.dst AND u.error IS NULL""")
def undone_catalog(t):
    _, current, undone = _undone(t)
    return G.undone_catalog(current, undone)


@query("empty_folders", UNDO_SQL[:-1] + """, after AS (SELECT coalesce(u.src, c.path) AS path FROM current_files c
    LEFT JOIN undone u ON c.path = u.dst AND u.error IS NULL), """ + FOLDERS_SQL.format("after", "") + f""",
  made AS (SELECT DISTINCT string_split({_PARENT.format('dst')}, '/') AS p FROM undone),
  above AS (SELECT DISTINCT array_to_string(p[:n], '/') AS folder FROM (SELECT p, unnest(range(3, len(p) + 1)) AS n FROM made))
  SELECT folder FROM above WHERE folder NOT IN (SELECT folder FROM folders)""")
def empty_folders(t):
    from ..functions.paths import parent_of

    moves, current, undone = _undone(t)
    created = moves.filter(F.col("session_id") == SESSION).select(parent_of("dst").alias("folder"))
    return G.empty_folders(created, G.undone_catalog(current, undone), D.ROOT)


@query("prune_sessions", WITH + """SELECT session_id, seq, src, dst FROM moves WHERE session_id IN
  (SELECT DISTINCT session_id FROM moves ORDER BY session_id DESC LIMIT 4)""")
def prune_sessions(t):
    return G.prune_sessions(_moves(t), keep=4).select("session_id", "seq", "src", "dst")


@query("write_session", WITH + "SELECT session_id, count(*) AS moves, max(seq) AS last FROM moves GROUP BY session_id")
def write_session(t):
    out = scratch_path(t.spark, "ledger")
    S.write_session(_moves(t), out)
    return S.read_sessions(t.spark, out).groupBy("session_id").agg(F.count("*").alias("moves"), F.max("seq").alias("last"))


def _ledger(t):
    """The sessions of the plan with their root, time of creation and folders."""
    from ..functions.paths import parent_of

    moves = _moves(t)
    sessions = moves.select("session_id").distinct().withColumns({
        "root": F.lit(D.ROOT), "created_at": F.concat(F.left("session_id", F.lit(4)), F.lit("-01-01T00:00:00"))})
    folders = moves.groupBy("session_id", parent_of("dst").alias("folder")).agg(F.min("seq").alias("first_seq"))
    return S.Ledger(sessions, moves, folders)


def _stored(t, ledger, fmt="parquet"):
    out = scratch_path(t.spark, "ledger")
    S.write_ledger(ledger, out, fmt)
    return S.read_ledger(t.spark, out, fmt)


_FOLDERS = f"""folders AS (SELECT session_id, {_PARENT.format('dst')} AS folder, min(seq) AS first_seq FROM moves GROUP BY ALL) """
_SESSIONS = f"""SELECT session_id, '{D.ROOT}' AS root, concat(left(session_id, 4), '-01-01T00:00:00') AS created_at, count(*) AS moves,
  (SELECT count(*) FROM folders f WHERE f.session_id = moves.session_id) AS folders FROM moves"""


def _summary(ledger):
    made = ledger.folders.groupBy("session_id").agg(F.count("*").alias("folders"))
    moved = ledger.moves.groupBy("session_id").agg(F.count("*").alias("moves"))
    return ledger.sessions.join(moved, "session_id").join(made, "session_id").select(
        "session_id", "root", "created_at", "moves", "folders")


@query("read_sessions", WITH + "SELECT session_id, seq, src, dst FROM moves")
def read_sessions(t):
    """The ledger as JSON lines, written and read back: moves."""
    return _stored(t, _ledger(t), "json").moves.select("session_id", "seq", "src", "dst")


@query("session_records", WITH[:-1] + ", " + _FOLDERS + _SESSIONS + " GROUP BY session_id")
def session_records(t):
    """The ledger in parquet, written and read back: sessions and what belongs to them."""
    return _summary(_stored(t, _ledger(t)))


@query("session_folders", WITH[:-1] + ", " + _FOLDERS + "SELECT session_id, folder, first_seq FROM folders")
def session_folders(t):
    return _stored(t, _ledger(t), "json").folders.select("session_id", "folder", "first_seq")


@query("pruned_ledger", WITH[:-1] + ", " + _FOLDERS + _SESSIONS + """
  WHERE session_id IN (SELECT DISTINCT session_id FROM moves ORDER BY session_id DESC LIMIT 4) GROUP BY session_id""")
def pruned_ledger(t):
    """The newest sessions of a stored ledger, stored anew."""
    return _summary(_stored(t, S.pruned(_stored(t, _ledger(t)), 4)))


@query("ledger_after_undo", WITH[:-1] + ", " + _FOLDERS + _SESSIONS + f" WHERE session_id <> '{SESSION}' GROUP BY session_id")
def ledger_after_undo(t):
    """Undo of one session out of a stored ledger, all of its files in place; a clean undo drops the session."""
    ledger = _stored(t, _ledger(t))
    undone = G.undo(ledger.moves, ledger.moves.select(F.col("dst").alias("path")), SESSION)
    return _summary(_stored(t, S.after_undo(ledger, G.undo_report(undone, SESSION))))
