import random

import pytest

from shelfmark.operators.conflicts import _Line, resolve_conflicts
from shelfmark.operators.grouping import join_lines, rank_all, rank_in_group, running_total
from shelfmark.plans.organise import execute, undo_and_report
from pyspark.sql import functions as F


def numbered(path, n):
    head, _, name = path.rpartition("/")
    dot = name.rfind(".")
    stem, suffix = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
    return f"{head}/{stem}_{n}{suffix}"


def one_by_one(plan, existing):
    """Place the files one after the other against the growing set of taken names."""
    taken, out = set(existing), {}
    for seq, src, dst in sorted(plan):
        name, n = dst, 0
        while name in taken:
            n += 1
            name = numbered(dst, n)
        taken.add(name)
        taken.discard(src)
        out[seq] = name
    return out


def resolve(spark, plan, existing, bits):
    sources = [s for _, s, _ in plan]
    p = spark.createDataFrame(plan, "seq bigint, src string, dst string")
    e = spark.createDataFrame([(x,) for x in dict.fromkeys(sources + list(existing))], "path string")
    return {r.seq: r.final_dst for r in resolve_conflicts(p, e, bits).collect()}


STEMS = ["a", "a_1", "a_2", "a_1_1", "a_3", "a_2_1", "a_1_2", "b", "b_1", ".env", ".env_1", "a_01"]


@pytest.mark.parametrize("seed", range(5))
def test_look_alikes_equal_one_by_one(spark, seed):
    """Many folders at once, each a small random plan with names that collide with counters."""
    rng = random.Random(seed)
    plan, existing = [], set()
    for folder in range(60):
        names = rng.sample(STEMS, rng.randint(2, len(STEMS)))
        ext = rng.choice([".t", "", ".tar.gz"])
        for _ in range(rng.randint(2, 25)):
            plan.append(f"/out/{folder}/{rng.choice(names)}{ext}")
        existing |= {f"/out/{folder}/{rng.choice(STEMS + ['a_4', 'b_2'])}{ext}" for _ in range(rng.randint(0, 4))}
    rng.shuffle(plan)
    plan = [(i, f"/in/{i}", dst) for i, dst in enumerate(plan)]
    assert resolve(spark, plan, existing, bits=2) == one_by_one(plan, existing)


@pytest.mark.parametrize("seed", range(6))
def test_second_run_equals_one_by_one(spark, seed):
    """Sources lie in the target folders: names are freed while others wait for them."""
    rng = random.Random(100 + seed)
    plan, existing = [], set()
    names = STEMS + ["a_4", "a_5", "b_2", "a_1_3"]
    for folder in range(80):
        ext = rng.choice([".t", ""])
        here = [f"/out/{folder}/{n}{ext}" for n in rng.sample(names, rng.randint(2, len(names)))]
        existing |= set(here)
        wanted = rng.sample(names, rng.randint(1, 5))
        for src in here:
            if rng.random() < 0.85:
                plan.append((src, src if rng.random() < 0.2 else f"/out/{folder}/{rng.choice(wanted)}{ext}"))
        plan += [(f"/in/{folder}/{i}", f"/out/{folder}/{rng.choice(wanted)}{ext}") for i in range(rng.randint(0, 8))]
    rng.shuffle(plan)
    existing |= {s for s, _ in plan}
    plan = [(i * 2, s, d) for i, (s, d) in enumerate(plan)]
    got = resolve(spark, plan, existing, bits=3)
    assert got == one_by_one(plan, existing)


def test_hot_name_freed_while_others_wait(spark):
    """One folder: all files want one name, and most of its counters are freed on the way."""
    rng = random.Random(11)
    here = ["/o/a.t"] + [f"/o/a_{n}.t" for n in range(1, 300)]
    plan = [(s, "/o/a.t" if rng.random() < 0.9 else f"/o/a_{rng.randint(1, 320)}.t") for s in here]
    plan += [(f"/in/{i}", "/o/a.t") for i in range(200)]
    rng.shuffle(plan)
    plan = [(i, s, d) for i, (s, d) in enumerate(plan)]
    assert resolve(spark, plan, set(here), bits=4) == one_by_one(plan, [s for _, s, _ in plan])


def test_line_serves_in_order():
    line, free, rng = _Line(), list(range(4000)), random.Random(3)
    for _ in range(300):
        if rng.random() < 0.5:
            n = rng.randint(0, 9)
            line.serve(n)
            del free[:n]
        else:
            low = rng.randint(0, 3000)
            high = low + rng.choice([0, 3, 500, 4000])
            want = next((r for r in free if low <= r < high), None)
            assert line.take(low, high) == want
            if want is not None:
                free.remove(want)


def test_hot_name_with_contested_counters(spark):
    rng = random.Random(7)
    dsts = ["/o/a.t"] * 400 + [f"/o/a_{rng.randint(1, 500)}.t" for _ in range(200)]
    rng.shuffle(dsts)
    plan = [(i * 3, f"/in/{i}", d) for i, d in enumerate(dsts)]
    existing = {f"/o/a_{n}.t" for n in range(50, 90)}
    got = resolve(spark, plan, existing, bits=4)
    assert got == one_by_one(plan, existing)
    assert len(set(got.values())) == len(plan)


def test_dotted_names_stay_unique(spark):
    dsts = ["/o/x.", "/o/x.", "/o/x._1", "/o/x.", "/o/x._2", "/o/x._1"]
    got = resolve(spark, [(i, f"/in/{i}", d) for i, d in enumerate(dsts)], {"/o/x._3"}, bits=2)
    assert len(set(got.values())) == len(dsts) and "/o/x._3" not in got.values()
    assert got[0] == "/o/x."


def test_missing_source_and_own_place(spark):
    p = spark.createDataFrame([(0, "/in/gone.t", "/o/a.t"), (1, "/o/a.t", "/o/a.t")], "seq bigint, src string, dst string")
    e = spark.createDataFrame([("/o/a.t",)], "path string")
    rows = {r.seq: (r.final_dst, r.error) for r in resolve_conflicts(p, e).collect()}
    assert rows == {0: (None, "Source missing: gone.t"), 1: ("/o/a_1.t", None)}


def test_round_trip(spark):
    files = [(i, f"/c/in{i % 3}/d{i}/f_{i % 4}.t", f"/c/2024-0{i % 2 + 1}/Documents/f_{i % 4}.t") for i in range(40)]
    plan = spark.createDataFrame(files, "seq bigint, src string, dst string")
    existing = plan.select(F.col("src").alias("path"))
    run = execute(plan, existing, "20240101_000000")
    assert run.report.first().asDict() == {"success": True, "moved": 40, "errors": 0}
    assert {r.folder for r in run.folders.collect()} == {"/c/2024-01/Documents", "/c/2024-02/Documents"}
    moved = run.moves.select(F.col("dst").alias("path"))
    assert moved.distinct().count() == 40
    after, empty, report = undo_and_report(run.moves, run.folders, moved, "/c", "20240101_000000")
    assert {r.path for r in after.collect()} == {f[1] for f in files}
    assert {r.folder for r in empty.collect()} == {"/c/2024-01", "/c/2024-01/Documents", "/c/2024-02", "/c/2024-02/Documents"}
    assert report.first().asDict() == {"success": True, "restored": 40, "errors": 0, "session_kept": False,
                                       "message": None, "session_id": "20240101_000000"}
    unknown = undo_and_report(run.moves, run.folders, moved, "/c", "nope")[2].first()
    assert (unknown.success, unknown.message) == (False, "Session not found: nope")


def test_running_total_over_ranges(spark):
    rows = [(k, i * 7 % 101, i % 5) for k in "xy" for i in range(101)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    for bits in (1, 4, 20):
        got = {(r.k, r.o): r.s for r in running_total(df, ["k"], "o", F.col("v"), "s", bits).collect()}
        assert got == {(k, o): sum(v for kk, oo, v in rows if kk == k and oo < o) for k, o, _ in rows}
    ranks = {(r.k, r.o): r["rank"] for r in rank_in_group(df, ["k"], "o", bits=3).collect()}
    assert ranks == {(k, o): o for k, o, _ in rows}


def test_rank_all(spark):
    df = spark.createDataFrame([(f"p{i * 37 % 200:03d}",) for i in range(200)], "path string")
    assert {r.path: r.seq for r in rank_all(df, "path").collect()} == {f"p{i:03d}": i for i in range(200)}


@pytest.mark.parametrize("cap", [None, 40])
def test_join_lines_over_ranges(spark, cap):
    rows = [("k", i, None if i % 4 == 0 else f"w{i}" * (i % 3)) for i in range(300)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, o bigint, t string").repartition(5)
    got = {r.k: r.out for r in join_lines(df, ["k"], "o", "t", "|", "out", cap, bits=3).collect()}
    want = "|".join(t for _, _, t in rows if t is not None)
    assert got == {"k": want[:cap] if cap else want, "none": ""}
