"""The general data operators against brute force, with the edges each of them defines."""

import datetime as dt
import math
import random
import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoplane.functions.instants import day_number, instant_micros
from chronoplane.operators import late_windows, phase_space, regular_grid, value_counts
from chronoplane.operators.known_state import as_known_at
from chronoplane.operators.shards import exchange_halo, neighbour
from chronoplane.operators.snapshot_diff import canonical_day, canonical_digest, snapshot_changes
from chronoplane.streaming.late_upsert import LateUpsert


# -- instants --------------------------------------------------------------------------------------------------------------
def test_instants(spark):
    texts = ["2020-01-01T00:00:00Z", "2020-01-01T02:00:00+02:00", "2019-12-31T20:30:00-03:30", "2020-01-01T00:00:00.000Z", "2020-01-01T00:00:00", " 2020-01-01 00:00:00Z ", "x", None, ""]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(instant_micros(F.col("t")).alias("m")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1577836800000000] * 6 + [None] * 3
    days = ["2020-02-29", "2019-02-29", "2020-2-9", "20200229", None]
    assert [r.d for r in spark.createDataFrame([(t,) for t in days], "t string").select(day_number(F.col("t")).alias("d")).collect()] == [18321, None, None, None, None]


# -- snapshots -------------------------------------------------------------------------------------------------------------
def diff(df):
    values = {"sha256": canonical_digest(F.col("sha256")), "rows": F.col("rows"), "last_obs": canonical_day(F.col("last_obs"))}
    return sorted(map(tuple, snapshot_changes(df, "series", "snap", "at", "k", values).collect()), key=str)


SNAP = "series string, snap int, at timestamp, k string, sha256 string, rows long, last_obs string, entity string, leaf string"


def row(series, snap, hour, k, sha="ab", rows=1, last="2020-01-01"):
    return (series, snap, dt.datetime(2025, 1, snap or 1, hour), k, sha, rows, last, "clash", "clash")


def test_snapshot_changes_edges(spark):
    rows = [
        row("a", 1, 1, "x"), row("a", 1, 1, "y"), row("a", 1, 1, None),
        row("a", 3, 1, "gone"),  # an earlier delivery of the same snapshot doesn't count
        row("a", 3, 2, "x", sha=" AB "), row("a", 3, 2, "z"), row("a", 3, 2, "z"), row("a", 3, 2, None, rows=None),
        row("b", 1, 1, "x", last="20200101"), row("b", 2, 1, "x", last="2020-01-01T00:00:00"), row("b", 4, 1, "x", last=None), row("b", 5, 1, "x", last=""), row("b", 6, 1, "x", last="odd"),
        row("c", 1, 1, "x"), (None, 1, None, "x", None, None, None, None, None), ("a", None, None, "x", None, None, None, None, None),
    ]
    got = diff(spark.createDataFrame(rows, SNAP))
    want = [("a", 3, "y", "removed"), ("a", 3, "z", "added"), ("a", 3, None, "changed"), ("b", 4, "x", "changed"), ("b", 6, "x", "changed")]
    assert got == sorted(want, key=str)
    assert diff(spark.createDataFrame([], SNAP)) == []


def test_snapshot_changes_against_force(spark):
    rng = random.Random(3)
    rows, want, state = [], set(), {}
    for series in "pqr":
        before = None
        for snap in range(1, 6):
            if rng.random() < 0.2:
                continue
            now = {f"k{i}": rng.randint(0, 1) if rng.random() < 0.2 else state.get((series, i), 0) for i in range(200 if series == "p" else 9) if rng.random() < 0.9}
            state |= {(series, int(k[1:])): v for k, v in now.items()}
            rows += [row(series, snap, 1, k, rows=v) for k, v in now.items()]
            if before is not None:
                want |= {(series, snap, k, "added") for k in now.keys() - before} | {(series, snap, k, "removed") for k in before.keys() - now} | {(series, snap, k, "changed") for k in now.keys() & before.keys() if now[k] != before[k]}
            before = now
    assert set(diff(spark.createDataFrame(rows, SNAP))) == want


# -- as known --------------------------------------------------------------------------------------------------------------
def test_as_known_against_force(spark):
    rng = random.Random(1)
    day = 86_400_000_000
    records = [(rng.choice(["a", "b", None]), rng.randint(0, 400) * day if rng.random() < 0.9 else None, rng.randint(0, 30), i, "period", "rank") for i in range(400)]
    events = [(i, rng.choice(["a", "b", "c", None]), rng.randint(-50, 500) * day if rng.random() < 0.9 else None, "x") for i in range(200)]
    events += events[:20]
    r = spark.createDataFrame(records + records[:30], "who string, at long, as_of int, id int, period string, rank string")
    e = spark.createDataFrame(events, "event int, who string, when long, best string")
    for days in (7, 91, 5000):
        got = {x.event: x.best.id for x in as_known_at(e, ["event"], F.col("when"), r, F.col("at"), F.struct("as_of", "at", "id"), ["who"], days).collect()}
        want = {}
        for i, who, when, _ in events:
            known = [(a, t, k) for w, t, a, k, *_ in records if w == who and who and t is not None and when is not None and t <= when]
            if known:
                want[i] = max(known)[2]
        assert got == want
    assert as_known_at(e.where("false"), ["event"], F.col("when"), r, F.col("at"), F.struct("id"), ["who"]).count() == 0
    assert as_known_at(e, ["event"], F.col("when"), r.where("false"), F.col("at"), F.struct("id"), ["who"]).count() == 0


# -- value counts ----------------------------------------------------------------------------------------------------------
def columns():
    return [
        value_counts.Profiled("t", malformed=~F.col("t").rlike("^[a-z]+$"), checks=frozenset({"nulls", "pattern", "distinct"})),
        value_counts.Profiled("n", impossible=F.col("n") < 1, measure=F.col("n"), checks=frozenset({"nulls", "range", "shift"})),
    ]


def test_value_counts_profile_and_deltas(spark):
    rng = random.Random(2)
    rows = [(p, rng.choice(["a", "b", "cc", "9", None]), rng.choice([None, -1, 0, 1, 2, 10**6, 10**12 + rng.randint(0, 9)])) for p in (1, 2, None) for _ in range(101)]
    df = spark.createDataFrame(rows, "part int, t string, n long").selectExpr("*", "1 as kind", "'x' as h1")
    state = value_counts.load_delta(df, "part", columns())
    got = {(r.part, r.col): r for r in value_counts.profile(state).collect()}
    for p in (1, 2):
        t = [x for q, x, _ in rows if q == p]
        n = [x for q, _, x in rows if q == p]
        good = sorted(x for x in n if x is not None and x >= 1)
        r, s = got[(p, 1)], got[(p, 0)]
        assert (r.rows, r.nulls, r.impossible, r.lowest, r.highest) == (101, n.count(None), sum(x is not None and x < 1 for x in n), good[0], good[-1])
        assert r.median == (good[(len(good) - 1) // 2] + good[len(good) // 2]) / 2
        words = [x for x in t if x is not None]
        assert (s.nulls, s.malformed, s.distinct) == (t.count(None), words.count("9"), len(set(words)))
        assert s.entropy == pytest.approx(-sum(words.count(w) / len(words) * math.log(words.count(w) / len(words)) for w in set(words)))
    # adding a load and taking it back leaves the state as it was
    part = df.where("part = 1")
    added, taken = (value_counts.load_delta(part, "part", columns(), sign=sign) for sign in (1, -1))
    back = value_counts.merged(state.unionByName(added).unionByName(taken))
    assert sorted(map(str, back.collect())) == sorted(map(str, state.collect()))
    gone = value_counts.merged(state.unionByName(taken))
    assert {r.part for r in gone.select("part").distinct().collect()} == {2, None}
    assert value_counts.profile(value_counts.load_delta(df.where("false"), "part", columns())).count() == 0


def recount(df):
    return sorted(map(str, value_counts.profile(value_counts.load_delta(df, "part", columns())).collect()))


def test_count_store_equals_a_recount_after_every_load(spark, tmp_path):
    rows = [(p, t, n) for p in (1, 2, 3, None) for t in ("a", "b", None, "9") for n in (1, 5, -1, (p or 9) * 7)]
    df = spark.createDataFrame(rows, "part int, t string, n long")
    profile = lambda store: sorted(map(str, value_counts.profile(store.state()).collect()))
    store = value_counts.CountStore(spark, str(tmp_path / "s"), "int")
    assert store.loads() == [] and store.state().collect() == []
    store.refresh(df.where("part < 3"), "part", columns())
    assert store.loads() == ["1", "2"] and profile(store) == recount(df.where("part < 3"))
    # opened again by name; only the loads it hasn't seen are counted
    store = value_counts.CountStore(spark, str(tmp_path / "s"), "int")
    changed = df.withColumn("t", F.when(F.col("part") == 1, "zz").otherwise(F.col("t")))
    store.refresh(changed, "part", columns())
    assert len(store.loads()) == 4 and profile(store) == recount(df)
    for _ in range(2):  # a delta that is applied again counts once
        store.apply(value_counts.load_delta(df.where("part = 2"), "part", columns()))
    assert profile(store) == recount(df)
    # a correction is what the load was, taken away, and what it is
    was, now = (value_counts.load_delta(x.where("part = 1"), "part", columns(), sign=sign) for x, sign in ((df, -1), (changed, 1)))
    store.apply(was.unionByName(now), "corrected")
    assert profile(store) == recount(changed)
    store.withdraw([2, 3])
    left = changed.where("part = 1 or part is null")
    assert profile(store) == recount(left)
    store.compact("c")
    assert profile(store) == recount(left) and len(store.loads()) == 2


def test_a_delta_of_withdrawals_alone_is_negative(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1)], "part int, t string, n long")
    store = value_counts.CountStore(spark, str(tmp_path / "s"), "int")
    store.apply(value_counts.load_delta(df, "part", columns(), sign=-1), "early")
    assert {r.n for r in store.state().collect()} == {-2}
    store.refresh(spark.createDataFrame([], df.schema), "part", columns())
    store.apply(value_counts.load_delta(df, "part", columns()))
    assert store.state().collect() == []


def test_out_of_order_issues(spark):
    rows = []
    for p in range(1, 8):
        for i in range(100):
            t = "".join(chr(97 + int(c)) for c in f"{i}") if p != 3 else "same"
            n = 100 + i if p != 4 else 900 + i
            if p == 5 and i < 20:
                t, n = None, None
            if p == 6 and i < 9:
                t, n = "9", -5
            rows.append((p, t, n))
    df = spark.createDataFrame(rows, "part int, t string, n long")
    got = {tuple(r) for r in value_counts.out_of_order(value_counts.profile(value_counts.load_delta(df, "part", columns())), columns()).collect()}
    assert got == {(3, "t", "distinct"), (4, "n", "shift"), (5, "t", "nulls"), (5, "n", "nulls"), (6, "t", "pattern"), (6, "n", "range")}


# -- shards ----------------------------------------------------------------------------------------------------------------
def test_halo_is_the_same_for_any_shard_length(spark):
    rng = random.Random(4)
    rows = [(k, p, float(rng.randint(0, 9))) for k in ("a", "b") for p in sorted(rng.sample(range(300), 60))] + [("c", 5, 1.0)]
    df = spark.createDataFrame(rows, "k string, p int, v double")
    by = defaultdict(list)
    for k, p, v in rows:
        by[k].append((p, v))
    for length in (1, 7, 50, 10_000):
        near = exchange_halo(df.withColumn("s", F.floor(F.col("p") / length)), ["k"], "s", "p", ["v"], 3, 4)
        got = {(r.k, r.p): r for r in near.select("k", "p", *[neighbour(["k"], "s", "p", "v", o).alias(f"o{o}") for o in range(-3, 5)]).collect()}
        assert len(got) == len(rows)
        for k, line in by.items():
            for i, (p, _) in enumerate(line):
                for o in range(-3, 5):
                    assert got[(k, p)][f"o{o}"] == (line[i + o][1] if 0 <= i + o < len(line) else None)


# -- spikes ----------------------------------------------------------------------------------------------------------------
def flags(df):
    return {(r.k, r.d): (r.spike, r.stuck, r.impossible) for r in phase_space.flag_readings(df, ["k"], "d", "v", lower=-1.0).collect()}


def test_phase_space(spark):
    rng = random.Random(6)
    rows = []
    for k, scale in (("calm", 0.001), ("wild", 0.02)):
        storm = 1.0
        for d in range(600):
            storm = 4.0 if 200 <= d < 230 else 1.0
            rows.append([k, d, round(rng.gauss(0, scale * storm), 7)])
    at = {(k, d): i for i, (k, d, _) in enumerate(rows)}
    for k, d, v in (("calm", 50, 0.04), ("calm", 51, -0.04), ("calm", 400, 0.05), ("wild", 90, 0.8), ("wild", 300, -1.0), ("wild", 301, -7.0), ("calm", 599, 0.03)):
        rows[at[(k, d)]][2] = v
    for d in range(95, 101):
        rows[at[("calm", d)]][2] = 0.0005
    for d in range(120, 125):  # five are not stuck
        rows[at[("wild", d)]][2] = 0.01
    rows += [["flat", d, 0.0] for d in range(20)] + [["one", 1, 5.0]]
    df = spark.createDataFrame([tuple(r) for r in rows], "k string, d int, v double")
    for parts in (1, 7):
        got = flags(df.repartition(parts))
        assert {x for x, f in got.items() if f[0]} == {("calm", 50), ("calm", 51), ("calm", 400), ("calm", 599), ("wild", 90)}
        assert {x for x, f in got.items() if f[1]} == {("calm", d) for d in range(95, 101)} | {("flat", d) for d in range(20)}
        assert {x for x, f in got.items() if f[2]} == {("wild", 300), ("wild", 301)}
    assert flags(df.where("false")) == {}
    clash = df.withColumns({"spike": F.lit("x"), "_shard": F.lit(1)})
    assert flags(clash) == got


def test_differences_decide_in_a_smooth_source():
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(800) / 40) + rng.normal(0, 0.002, 800)
    x[300] += 0.9  # less than the source's own range
    x[500:503] += (0.8, -0.7, 0.9)
    deviations = np.abs(x - np.median(x)) / (np.median(np.abs(x - np.median(x))) / 0.6745)
    assert deviations.max() < 12
    assert set(np.flatnonzero(phase_space.spikes(x))) == {300, 500, 501, 502}  # and none of their neighbours
    assert not phase_space.spikes(x, axes=(0,)).any() and not phase_space.spikes(x, axes=(0, 1)).any()


def test_spikes_are_those_outside_the_ellipsoid_of_the_rest():
    rng = np.random.default_rng(2)
    for n in (2, 3, 40, 700):
        x = rng.standard_t(4, n) * 0.01
        if n > 3:
            x[rng.integers(0, n, n // 20)] *= 60
        out = phase_space.spikes(x)
        kept = [float(v) for v in x[~out]]
        rows = []
        for i in range(n):
            before = [float(x[j]) for j in range(i) if not out[j]][-1:]
            after = [float(x[j]) for j in range(i + 1, n) if not out[j]][:1]
            both = bool(before and after)
            rows.append((float(x[i]) - statistics.median(kept), (after[0] - before[0]) / 2 if both else 0.0, after[0] - 2 * float(x[i]) + before[0] if both else 0.0))
        scales = [(sum(r[k] ** 4 for r, o in zip(rows, out) if not o) / len(kept) / 3) ** 0.25 for k in range(3)]
        reach = phase_space.MARGIN * math.sqrt(2 * math.log(n))
        if all(scales):
            assert [sum((r[k] / scales[k]) ** 2 for k in range(3)) > reach**2 for r in rows] == out.tolist()
    assert phase_space.spikes(np.array([])).tolist() == [] and phase_space.spikes(np.array([3.0])).tolist() == [False]
    assert phase_space.spikes(np.array([0.1, math.inf, 0.2, 0.1, -math.inf])).tolist() == [False, True, False, False, True]
    assert not phase_space.spikes(np.full(50, 0.3)).any()


# -- late windows ----------------------------------------------------------------------------------------------------------
LATE = "region string, signal string, as_of string, available_at string, id long, value double, window string"


def late_arrivals(df):
    windows = late_windows.MonthWindows()
    return late_windows.arrivals(df, ["region", "signal"], F.date_from_unix_date(day_number(F.col("as_of"))), instant_micros(F.col("available_at")), F.col("id"), F.col("value"), windows), windows


ROWS = [
    ("r", "s", "2020-01-10", "2020-01-20T00:00:00Z", 1, 1.0, "x"), ("r", "s", "2020-01-11", "2020-03-17T00:00:00Z", 2, 2.0, "x"), ("r", "s", "2020-01-12", "2020-03-17T00:00:00.001Z", 3, 4.0, "x"),
    ("r", "s", "2020-01-10", "2020-07-30T00:00:00Z", 4, 1.5, "x"), ("r", "s", "2020-01-10", "2020-07-30T00:00:01Z", 5, 9.0, "x"), ("r", "s", "2020-02-01", "2020-02-02T00:00:00Z", 6, None, "x"),
    ("r", "s", "2020-02-02", "2020-02-03T00:00:00Z", 7, math.nan, "x"), ("r", "s", "bad", "2020-02-03T00:00:00Z", 8, 1.0, "x"), (None, "s", "2020-02-02", "2020-02-03T00:00:00Z", 9, 1.0, "x"),
    ("r", "s", "2020-02-03", None, 10, 1.0, "x"), ("r", "s", "2020-01-10", "2020-01-20T00:00:00Z", 1, 1.0, "x"), ("r", "s", "2020-03-01", "2020-03-02T00:00:00Z", 11, 1.0, "x"), ("r", "s", "2020-03-01", "2020-03-02T00:00:00Z", 12, 3.0, "x"),
]


def test_late_windows(spark):
    df = spark.createDataFrame(ROWS, LATE)
    rows, windows = late_arrivals(df)
    state = late_windows.merge_state(rows, ["region", "signal"], windows)
    got = {str(r.window): (r.count_closed, float(r.sum_closed), r.count_final, float(r.sum_final), r.corrected) for r in late_windows.window_aggregates(state, ["region", "signal"]).collect()}
    assert got == {"2020-01-01": (2, 3.0, 3, 7.5, True), "2020-02-01": (0, 0.0, 0, 0.0, False), "2020-03-01": (1, 3.0, 1, 3.0, False)}
    assert [(r.turn, r.days_late) for r in late_windows.dropped_late(rows, windows).collect()] == [(5, 1)]
    none = late_windows.merge_state(rows.where("false"), ["region", "signal"], windows)
    assert late_windows.window_aggregates(none, ["region", "signal"]).collect() == []


def test_late_batches_in_any_order(spark, tmp_path):
    df = spark.createDataFrame(ROWS, LATE)
    rows, windows = late_arrivals(df)
    keys = ["region", "signal"]
    want = sorted(map(str, late_windows.window_aggregates(late_windows.merge_state(rows, keys, windows), keys).collect()))
    for seed in range(2):
        shuffled = ROWS[:]
        random.Random(seed).shuffle(shuffled)
        sink = LateUpsert(spark, f"{tmp_path}/{seed}", keys, windows, compact_every=3)
        for n, at in enumerate(range(0, len(shuffled), 3)):
            part, _ = late_arrivals(spark.createDataFrame(shuffled[at : at + 3], LATE))
            sink.batch(part, n)
            if n % 3 != 2:
                sink.batch(part, n)  # a batch that is tried again
        assert sorted(map(str, sink.aggregates().collect())) == want
        assert [r.turn for r in sink.late().collect()] == [5]
        sink.compact(99)
        assert sorted(map(str, sink.aggregates().collect())) == want


def test_windows_are_let_go_after_their_cutoff(spark, tmp_path):
    keys = ["region", "signal"]
    record = lambda i, day, at, v: ("r", "s", day, at, i, v, "x")
    batches = [
        ([record(1, "2020-01-10", "2020-01-11T00:00:00Z", 1.0), record(2, "2019-01-01", "2020-01-12T00:00:00Z", 9.0)], "2020-01-20"),
        ([record(3, "2020-01-11", "2020-06-01T00:00:00Z", 2.0), record(4, "2020-05-01", "2020-06-01T00:00:00Z", 5.0)], "2020-06-02"),
        ([record(5, "2020-05-02", "2020-09-01T00:00:00Z", 7.0), record(6, "2020-01-12", "2020-09-01T00:00:00Z", 8.0)], "2020-09-02"),
        ([record(7, "2020-01-13", "2020-03-01T00:00:00Z", 3.0), record(8, "2020-05-03", "2020-09-03T00:00:00Z", 1.0)], "2020-09-04"),
    ]
    micros = lambda day: int(dt.datetime.fromisoformat(day + "T00:00:00+00:00").timestamp()) * 10**6
    windows = late_windows.MonthWindows()
    sink = LateUpsert(spark, str(tmp_path / "w"), keys, windows, compact_every=0)
    held, updated = [], []
    for n, (rows, mark) in enumerate(batches):
        part, _ = late_arrivals(spark.createDataFrame(rows, LATE))
        sink.batch(part, n, micros(mark))
        sink.batch(part, n, micros(mark))
        held.append({str(r.window)[:7] for r in sink.state().collect()})
        updated.append({str(r.window)[:7] for r in spark.read.parquet(f"{tmp_path}/w/updates/batch={n}").collect()})
    assert held == [{"2020-01"}, {"2020-01", "2020-05"}, {"2020-05"}, {"2020-05"}]
    assert updated == [{"2020-01"}, {"2020-01", "2020-05"}, {"2020-05"}, {"2020-05"}]
    # 7 was in time, but came after the watermark had let its window go
    assert {(r.turn, r.days_late > 0) for r in sink.late().collect()} == {(2, True), (6, True), (7, False)}
    got = {str(r.window)[:7]: (r.count_closed, float(r.sum_closed), r.count_final, float(r.sum_final), r.corrected) for r in sink.aggregates().collect()}
    assert got == {"2019-01": (0, 0.0, 0, 0.0, False), "2020-01": (1, 1.0, 2, 3.0, True), "2020-05": (1, 5.0, 3, 13.0, True)}


def test_replay_equals_one_pass(spark, tmp_path):
    rng = random.Random(4)
    days = [f"20{19 + i // 12}-{i % 12 + 1:02d}-{rng.randint(1, 28):02d}" for i in range(30)]
    rows = []
    for i in range(400):
        day = rng.choice(days)
        at = dt.datetime.fromisoformat(day) + dt.timedelta(days=rng.choice([1, 3, 40, 90, 200, 230]), hours=rng.randint(0, 50))
        rows.append((rng.choice("ab"), "s", day, at.isoformat() + "Z", i, rng.choice([1.5, 2.25, None]), "x"))
    arrivals, windows = late_arrivals(spark.createDataFrame(rows, LATE))
    keys = ["region", "signal"]
    want = sorted(map(str, late_windows.window_aggregates(late_windows.merge_state(arrivals, keys, windows), keys).collect()))
    late = sorted(r.turn for r in late_windows.dropped_late(arrivals, windows).collect())
    for batches in (1, 5):
        sink = LateUpsert(spark, f"{tmp_path}/{batches}", keys, windows, compact_every=2)
        sink.replay(arrivals, batches)
        assert sorted(map(str, sink.aggregates().collect())) == want
        assert sorted(r.turn for r in sink.late().collect()) == late
    none = LateUpsert(spark, f"{tmp_path}/none", keys, windows)
    none.replay(arrivals.where("false"), 3)
    assert none.aggregates().collect() == [] and none.late().collect() == []


# -- grid ------------------------------------------------------------------------------------------------------------------
def pchip(xs, ys, x):
    """Plain version: Fritsch-Carlson slopes with the three-point rule at the ends."""
    n = len(xs)
    h = [b - a for a, b in zip(xs, xs[1:])]
    s = [(b - a) / w for a, b, w in zip(ys, ys[1:], h)]
    sign = lambda v: (v > 0) - (v < 0)

    def end(h0, h1, s0, s1):
        d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        if sign(d) != sign(s0):
            return 0.0
        return 3 * s0 if sign(s0) != sign(s1) and abs(d) > 3 * abs(s0) else d

    d = [0.0] * n
    for k in range(1, n - 1):
        if s[k - 1] * s[k] > 0:
            a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            d[k] = (a + b) / (a / s[k - 1] + b / s[k])
    d[0], d[-1] = (s[0], s[0]) if n == 2 else (end(h[0], h[1], s[0], s[1]), end(h[-1], h[-2], s[-1], s[-2]))
    k = max(i for i in range(n - 1) if xs[i] <= x)
    t = (x - xs[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * ys[k] + t * (1 - t) ** 2 * h[k] * d[k] + t * t * (3 - 2 * t) * ys[k + 1] + t * t * (t - 1) * h[k] * d[k + 1]


def test_grid_against_force(spark):
    rng = random.Random(8)
    rows = []
    for k in ("a", "b"):
        p = 0
        for _ in range(80):
            p += rng.choice([1, 1, 1, 2, 3, 5, 9])
            rows.append((k, float(p) + rng.choice([0, 0, 0, 0.5]), rng.uniform(-1, 1)))
    rows += [("one", 4.0, 2.0), ("two", 1.0, 1.0), ("two", 4.0, 4.0), ("half", 1.5, 1.0), ("half", 3.5, 2.0)]
    df = spark.createDataFrame(rows, "k string, p double, v double").selectExpr("*", "'x' as status", "1 as q")
    most = 3
    want = {}
    for k in {r[0] for r in rows}:
        line = sorted((p, v) for q, p, v in rows if q == k)
        segments, current = [], [line[0]]
        for a, b in zip(line, line[1:]):
            if math.ceil(b[0]) - math.floor(a[0]) - 1 > most:
                segments.append(current)
                current = []
            current.append(b)
        segments.append(current)
        have = dict(line)
        for x in range(math.ceil(line[0][0]), math.floor(line[-1][0]) + 1):
            if float(x) in have:
                want[(k, x)] = ("observed", have[float(x)])
                continue
            inside = [s for s in segments if s[0][0] < x < s[-1][0]]
            want[(k, x)] = ("filled", pchip([p for p, _ in inside[0]], [v for _, v in inside[0]], x)) if inside else ("gap", None)
    for length in (1, 13, 100_000):
        got = {(r.k, r.p): (r.status, r.v) for r in regular_grid.onto_grid(df, ["k"], "p", "v", length, most).collect()}
        assert got.keys() == want.keys()
        for x, (status, v) in want.items():
            assert got[x][0] == status and (v is None and got[x][1] is None or got[x][1] == pytest.approx(v, abs=1e-12))
    assert regular_grid.onto_grid(df.where("false"), ["k"], "p", "v", 10, most).collect() == []


def test_weekday_numbers(spark):
    days = [dt.date(1969, 12, 29) + dt.timedelta(i) for i in range(-30, 4000, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", regular_grid.weekday_number(F.unix_date("d")).alias("n"))
    df = df.withColumn("back", regular_grid.weekday_date(F.floor("n")))
    count = None
    for r in df.orderBy("d").collect():
        if r.d.weekday() < 5:
            assert r.n == int(r.n) and r.back == r.d and (count is None or r.n == count + 1)
            count = r.n
        else:
            assert r.n % 1 == 0.5 and (count is None or r.n == count + 0.5)
