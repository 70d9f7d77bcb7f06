"""Conflict-free destinations for a whole plan at once.

Files are placed in plan order. A file whose destination is taken gets ``stem_1.ext``,
``stem_2.ext``, ... : the first name that is free at that moment. "Taken" means a file of the
``existing`` snapshot that has not been moved yet, or a name given to an earlier file of the plan.

Each wanted name (an owner) has a row of counters, and every counter a window of time in which the
owner's files can take it:

* most are open from the start and for good;
* a file of the snapshot closes its counter, for good if the plan does not move it, else until then;
* a counter whose name is wanted by others as well (``a_1.t`` is counter 1 of ``a.t``) is open until
  the first of these comes while the name is free.

All files of an owner prefer small counters, and all counters are taken by the earliest file that
finds them open and has got no smaller one. So counters can be settled in their order instead of the
files in theirs: a counter with a window takes the earliest file without a counter in it, and a run of
open ones takes the next files in line, as a number. Only counters with a window are looked at one by one;
the state is what was given out of line.

A name is a counter of one owner only, the name without its last ``_n``, so owners are settled from
the short ones to the long ones, all of one length of chain together. Without windows (one small
check) nothing of that runs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from ..runtime import cut_lineage
from .grouping import RANGE_BITS, rank_in_group, running_total


# A numbered name: stem_N.ext, or stem_N where there is no extension (a leading dot is none).
_N = "[1-9][0-9]{0,17}"
_NUMBERED = rf"(?s)^(?:(.*[^/])_({_N})(\.[^./]+)|((?:.*/)?\.?[^./]+)_({_N}))\z"
# Names that end in a dot: x._1 is counter 1 of "x.".
_DOTTED = rf"(?s)^(.*[^/]\.)_({_N})\z"
_CUT = "\x01"


def _numbered(names: DataFrame, path: str, pattern: str = _NUMBERED, groups: str = "$1$3$4\x01$2$5") -> DataFrame:
    """Add (owner, slot): the name without its counter and the counter, null for other names."""
    split = names.withColumn("_split", F.regexp_replace(path, pattern, groups))
    slot = F.split_part("_split", F.lit(_CUT), F.lit(2)).try_cast("bigint")
    return split.withColumn("slot", slot).withColumn("owner", F.when(
        F.col("slot").isNotNull(), F.split_part("_split", F.lit(_CUT), F.lit(1)))).drop("_split")


def _dotted(names: DataFrame, path: str) -> DataFrame:
    return _numbered(names, path, _DOTTED, "$1\x01$2").filter(F.col("slot").isNotNull()).select("owner", "slot")


def _taken(existing: DataFrame, wanted: DataFrame, freed: DataFrame) -> DataFrame:
    """(owner, slot, path, freed): counters of wanted names that the snapshot takes, and when they are given up.

    A wanted name like ``x._1`` is kept away from "x." altogether: it can look like a numbered
    form of two names at once, which would make the order of settling circular.
    """
    owners = wanted.select(F.col("dst").alias("owner"))
    both = _numbered(existing.select("path"), "path").select("path", F.explode(F.array(
        F.struct(F.col("path").alias("owner"), F.lit(0).cast("bigint").alias("slot")),
        F.struct("owner", "slot"))).alias("s"))
    taken = both.select("path", "s.owner", "s.slot").filter(F.col("owner").isNotNull()).join(owners, "owner", "left_semi")
    dotted = _dotted(existing, "path").unionByName(_dotted(wanted, "dst")).join(owners, "owner", "left_semi").distinct()
    return taken.join(freed, "path", "left").select("owner", "slot", "path", "freed").unionByName(
        dotted.select("owner", "slot", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("freed")))


class _Line:
    """Files of one owner by rank: a front up to which all have a counter, and those given out of line."""

    def __init__(self) -> None:
        self.front, self.given, self.ahead, self.next = 0, 0, [], {}

    def serve(self, counters: int) -> None:
        """Open counters take the next files in line."""
        end = self.front + counters
        while self.ahead and self.ahead[0] < end:
            self.next.pop(heapq.heappop(self.ahead))
            end += 1
        self.front = end
        self._close_up()

    def _close_up(self) -> None:
        while self.ahead and self.ahead[0] == self.front:
            self.next.pop(heapq.heappop(self.ahead))
            self.front += 1

    def take(self, low: int, high: float) -> int | None:
        """The first file from ``low`` on without a counter, if it is below ``high``."""
        rank = max(low, self.front)
        passed = []
        while rank in self.next:
            passed.append(rank)
            rank = self.next[rank]
        for p in passed:  # the next search skips them at once
            self.next[p] = rank
        if rank >= high:
            return None
        self.next[rank] = rank + 1
        heapq.heappush(self.ahead, rank)
        self._close_up()
        return rank


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The file that takes each counter with a window, owner by owner, counters in order."""
    owner, line, windows = None, _Line(), 0
    for batch in batches:
        ranks = []
        for name, slot, shut, low, high in zip(batch["owner"], batch["slot"], batch["shut"], batch["low"], batch["high"]):
            if name != owner:
                owner, line, windows = name, _Line(), 0
            open_ = int(slot) - int(shut) - windows  # open counters below this one
            line.serve(open_ - line.given)
            line.given = open_
            windows += 1
            ranks.append(line.take(int(low), math.inf if pd.isna(high) else int(high)))
        batch["rank"] = pd.array(ranks, "Int64")
        yield batch[["owner", "slot", "child", "rank"]]


def _settle(ready: DataFrame, claims: DataFrame, closed: DataFrame, bits: int) -> DataFrame:
    """(owner, slot, child, rank): the file, by its rank among those of the owner, that takes each counter."""
    owners = ready.select("owner").distinct()
    # files before the window opens (one that leaves the name itself comes too early) and before it ends
    arrivals = claims.select(F.col("dst").alias("owner"), (F.col("seq") * 2).alias("at"), F.lit(1).alias("_add")) \
        .join(owners, "owner", "left_semi")
    edges = ready.select("owner", "slot", "child", F.explode(F.array(
        F.struct((F.col("freed") * 2 + 1).alias("at"), F.lit(True).alias("opens")),
        F.struct((F.col("until") * 2).alias("at"), F.lit(False).alias("opens")))).alias("e"))
    probes = edges.select("owner", "slot", "child", "e.at", "e.opens", F.lit(0).alias("_add")).filter("at is not null")
    arrived = running_total(arrivals.unionByName(probes, allowMissingColumns=True), ["owner"], "at",
                            F.col("_add"), "arrived", bits).filter(F.col("slot").isNotNull())
    counted = arrived.groupBy("owner", "slot").agg(F.max(F.when(F.col("opens"), F.col("arrived"))).alias("low"),
                                                   F.max(F.when(~F.col("opens"), F.col("arrived"))).alias("high"))
    windows = ready.select("owner", "slot", "child").join(counted, ["owner", "slot"]).withColumn(
        "low", F.coalesce("low", F.lit(0)))
    shut = closed.join(owners, "owner", "left_semi").select("owner", "slot", F.lit(1).alias("_add"))
    marked = running_total(
        windows.withColumn("_add", F.lit(0)).unionByName(shut, allowMissingColumns=True),
        ["owner"], "slot", F.col("_add"), "shut", bits).filter(F.col("low").isNotNull())
    return (marked.select("owner", "slot", "child", "shut", "low", "high")
            .repartition("owner").sortWithinPartitions("owner", "slot")
            .mapInPandas(_walk, "owner string, slot bigint, child string, rank bigint"))


def _windows(taken: DataFrame, claims: DataFrame, wanted: DataFrame) -> DataFrame:
    """(owner, slot, freed, until, child): counters that open late, or end when ``child`` is wanted by its own files."""
    here = taken.filter("slot = 0 and path = owner").select(F.col("owner").alias("dst"), F.lit(True).alias("_here"), "freed")
    # the first file of a name that finds it free
    firsts = claims.join(here, "dst", "left").filter("_here is null or seq > freed").groupBy("dst").agg(F.min("seq").alias("until"))
    late = taken.filter("freed is not null").select("owner", "slot", "freed", F.col("path").alias("dst"))
    late = late.join(firsts, "dst", "left").withColumn("contested", (F.col("slot") > 0) & F.col("until").isNotNull())
    late = late.select("owner", "slot", "freed", F.when(F.col("contested"), F.col("until")).alias("until"),
                       F.when(F.col("contested"), F.col("dst")).alias("child"))
    likes = (_numbered(wanted.select("dst"), "dst").filter(F.col("slot").isNotNull())
             .join(wanted.select(F.col("dst").alias("owner")), "owner", "left_semi")
             .join(taken.select("owner", "slot"), ["owner", "slot"], "left_anti").join(firsts, "dst"))
    return late.unionByName(likes.select("owner", "slot", F.lit(None).cast("bigint").alias("freed"), "until",
                                         F.col("dst").alias("child")))


def resolve_conflicts(plan: DataFrame, existing: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """Add ``final_dst`` and ``error`` to a plan.

    ``plan``: seq (unique bigint, the order), src (each once), dst and any other columns. ``existing``:
    (path), the snapshot, each path once. A source that is not in it becomes an error row. A file that is
    moved frees its name for those behind it, and still holds it while its own destination is chosen.
    """
    present = existing.select(F.col("path").alias("src"), F.lit(True).alias("_present"))
    # the plan is used several times below: computed once, then read by column
    checked = cut_lineage(plan.join(present, "src", "left"))
    claims = checked.filter(F.col("_present").isNotNull()).drop("_present")
    missing = checked.filter(F.col("_present").isNull()).drop("_present")

    wanted = claims.select("dst").distinct()
    freed = claims.groupBy(F.col("src").alias("path")).agg(F.min("seq").alias("freed"))
    taken = cut_lineage(_taken(existing, wanted, freed))
    closed = taken.filter("freed is null").select("owner", "slot").distinct()

    pending = cut_lineage(_windows(taken, claims, wanted))
    empty = pending.limit(0).select("owner", "slot", "child", F.lit(None).cast("bigint").alias("rank"))
    given, windowed = empty, pending.select("owner", "slot")
    while not pending.isEmpty():
        waiting = pending.filter("child is not null").select(F.col("child").alias("owner")).distinct()
        settled = cut_lineage(_settle(pending.join(waiting, "owner", "left_anti"), claims, closed, bits))
        given = given.unionByName(settled)
        # a name that went to the files of a shorter one is closed for its own
        lost = settled.filter("child is not null and rank is not null").select(
            F.col("child").alias("owner"), F.lit(0).cast("bigint").alias("slot"))
        closed = closed.unionByName(lost).distinct()
        pending = cut_lineage(pending.join(settled.select("owner").distinct(), "owner", "left_anti")
                              .join(lost, ["owner", "slot"], "left_anti"))
    closed = cut_lineage(closed.unionByName(windowed).distinct())
    given = cut_lineage(given.filter("rank is not null").select(F.col("owner").alias("dst"), F.col("rank").alias("_k"),
                                                                F.col("slot").alias("_counter")))

    # most names have no closed counter: the k-th file that wants them takes counter k
    ranked = cut_lineage(rank_in_group(claims, ["dst"], "seq", "_k", bits))
    gapped = closed.select(F.col("owner").alias("dst")).distinct()
    plain = ranked.join(gapped, "dst", "left_anti").withColumn("_counter", F.col("_k"))
    seated = ranked.join(given, ["dst", "_k"])
    # the others take the counters that are left, in line
    rest = rank_in_group(ranked.join(gapped, "dst", "left_semi").join(given, ["dst", "_k"], "left_anti").drop("_k"),
                         ["dst"], "seq", "_k", bits)
    # the j-th closed counter z has z - j open ones below it
    gaps = (rank_in_group(closed, ["owner"], "slot", "_j", bits)
            .groupBy("owner", (F.col("slot") - F.col("_j")).alias("_below")).agg(F.count("*").alias("_add"))
            .select(F.col("owner").alias("dst"), (F.col("_below") * 2).alias("_at"), "_add"))
    walkers = rest.withColumns({"_at": F.col("_k") * 2 + 1, "_add": F.lit(0).cast("bigint")})
    passed = running_total(walkers.unionByName(gaps, allowMissingColumns=True), ["dst"], "_at",
                           F.col("_add"), "_passed", bits).filter(F.col("_k").isNotNull())
    counted = (plain.unionByName(passed.select(*ranked.columns, (F.col("_k") + F.col("_passed")).alias("_counter")))
               .unionByName(seated.select(*ranked.columns, "_counter")))
    done = counted.select(*plan.columns, paths.numbered("dst", "_counter").alias("final_dst"),
                          F.lit(None).cast("string").alias("error"))
    failed = missing.select(*plan.columns, F.lit(None).cast("string").alias("final_dst"),
                            F.concat(F.lit("Source missing: "), paths.name_of("src")).alias("error"))
    return done.unionByName(failed)
