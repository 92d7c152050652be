"""Operators and queries cover the whole of their input, not a first part of it."""

import hashlib

import datetime as dt

import numpy as np

import __spark_entry__ as entry
from chronoplane.operators import inference
from chronoplane.operators import sequential as q
from chronoplane.plans import sequential_queries
from chronoplane.sources import files

FOLDER = "/root/testdata/sf0.001"


# -- loads, orders, digests --------------------------------------------------------------------------------------------
def test_every_load_is_compared_with_the_one_before(spark):
    rows = [(1, "a", "1"), (1, "b", "1"), (1, "b", "1"), (2, "a", "1"), (2, "b", "2"), (5, "b", "2"), (5, "c", None), (7, "b", None), (7, "c", None), (7, None, "x"), (None, "z", "1")]
    m = spark.createDataFrame(rows, "load_id long, file string, sha256 string")
    got = {tuple(r) for r in files.manifest_changes_by_load(m, "load_id", ["file"], "sha256").collect()}
    assert got == {(2, "b", "changed"), (5, "a", "gone"), (5, "c", "added"), (7, "b", "changed"), (7, None, "added")}


def test_load_queries_reach_the_last_load(spark, tmp_path):
    rows = [(n, f, f"{f}{n // 3}") for n in range(1, 7) for f in "abcd" if (n, f) not in {(6, "a"), (3, "c")}]
    spark.createDataFrame(rows, "load_id long, file string, sha256 string").write.parquet(f"{tmp_path}/panel_manifest.parquet")
    changes = {tuple(r) for r in entry.queries()["b14_manifest_changes"](spark, str(tmp_path)).collect()}
    assert {(6, "a", "gone"), (3, "c", "gone"), (4, "c", "added"), (3, "b", "changed"), (6, "b", "changed")} <= changes
    assert {tuple(r) for r in entry.queries()["s6_difference"](spark, str(tmp_path)).collect()} == {(6, "a"), (3, "c")}


def test_log_is_sorted_whole(spark):
    rows = entry.queries()["s1_s4_order"](spark, FOLDER).collect()
    key = lambda r: [(x is not None, x) for x in r]
    assert len(rows) > 100 and rows == sorted(rows, key=key)


def test_all_files_of_a_folder_are_digested(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "x.parquet").write_bytes(b"x")
    (tmp_path / "in/part 0.parquet").write_bytes(b"yy")
    got = {tuple(r) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got == {("x.parquet", 1, hashlib.sha256(b"x").hexdigest()), ("in/part 0.parquet", 2, hashlib.sha256(b"yy").hexdigest())}
    assert [r.file for r in files.file_digests(spark, f"{tmp_path}/x.parquet").collect()] == ["x.parquet"]
    import os

    assert {r.file for r in entry.queries()["sc13_file_digests"](spark, FOLDER).collect()} == set(os.listdir(FOLDER))


# -- refits on the expanding history -----------------------------------------------------------------------------------
def monthly(n):
    rng = np.random.default_rng(3)
    z = np.cumsum(rng.normal(0, 0.1, n)) + 2
    z[250:] += np.cumsum(rng.normal(0, 1.0, n - 250))  # another level noise
    z[[5, 100, 260]] = np.nan
    return z


def test_kalman_level_uses_all_of_the_past_and_no_future():
    z = monthly(310)
    out = q.kalman_refits(z, 24, 12)
    assert (np.isnan(out) == np.isnan(z)).all()
    begin = 25 + 12 * ((300 - 25) // 12)  # one value among the first 24 rows is missing, so the first fit is at row 25
    past = z[:begin]
    assert np.allclose(out[begin : begin + 12], q.kalman(z[: begin + 12], *q.fit_kalman(past[np.isfinite(past)]))[0][begin:], equal_nan=True)
    later = z.copy()
    later[300:] += 50
    assert np.allclose(out[25:300], q.kalman_refits(later, 24, 12)[25:300], equal_nan=True)
    assert np.isnan(q.kalman_refits(z[:24], 24, 12)).all() and np.isfinite(q.kalman_refits(z[:25], 24, 12)).sum() == 24


def test_kalman_query_refits_after_240_months(spark, tmp_path):
    z = monthly(310)
    rows = [("f", dt.date(1990 + i // 12, i % 12 + 1, 28), None if np.isnan(v) else float(v)) for i, v in enumerate(z)]
    spark.createDataFrame(rows, "source_id string, date date, jp_y10 double").write.parquet(f"{tmp_path}/intl_bonds_monthly.parquet")
    got = [r.level for r in entry.queries()["r9_kalman_level"](spark, str(tmp_path)).orderBy("month").collect()]
    want = q.kalman_refits(z, 24, 12)
    assert np.allclose(np.array(got, float), want, atol=1e-6, equal_nan=True)
    prefix = q.kalman(z, *q.fit_kalman(z[np.isfinite(z)][:240]))[0]
    assert np.nanmax(np.abs(prefix[250:] - want[250:])) > 0.01


def daily_feed(spark, path, n, start=dt.date(2000, 1, 3)):
    rng = np.random.default_rng(5)
    r = rng.standard_t(6, n) * 0.008 * (1 + (np.arange(n) % 400 > 300))
    rows = [("f", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(r)]
    spark.createDataFrame(rows, "source_id string, date date, mkt_ret double").write.parquet(f"{path}/assets_daily.parquet")
    return rows, r


def test_variance_has_a_value_for_every_day_after_the_first_years(spark, tmp_path):
    rows, r = daily_feed(spark, tmp_path, 1100)
    out = entry.queries()["r5_asymmetric_refits"](spark, str(tmp_path)).orderBy("date").collect()
    assert [x.date for x in out] == [x[1] for x in rows]
    years = np.array([x[1].year for x in rows])
    assert [x.vol is not None for x in out] == [y > 2000 for y in years]  # the feed begins on 3 January: over 252 rows before 2001
    first = q.fit_garch_t(r[years < 2001], asymmetric=True)
    s2 = q.conditional_variance(100 * r[years < 2002] - first["mu"], first["omega"], first["alpha"], first["beta"], first["gamma"])
    assert np.allclose([x.vol for x in out if x.date.year == 2001], np.sqrt(s2[years[years < 2002] == 2001]) / 100, atol=2e-6)
    later = r.copy()
    later[years == 2002] *= 9
    again = q.asymmetric_refits(later, years)
    assert np.allclose(again["vol"][years == 2001], [x.vol for x in out if x.date.year == 2001], atol=2e-6)
    whole = entry.queries()["r5_full_sample"](spark, str(tmp_path)).collect()
    assert len(whole) == 1 and whole[0].n == 1100 and abs(whole[0].alpha - q.fit_garch_t(r)["alpha"]) < 1e-5


def test_half_lives_come_from_1260_rows_every_63(spark, tmp_path):
    rows, r = daily_feed(spark, tmp_path, 1260 + 64)
    for name in ("r4_shock_half_life", "sig_volatility"):
        out = [x for x in entry.queries()[name](spark, str(tmp_path)).orderBy("date").collect() if x.half_life is not None]
        if name == "r4_shock_half_life":
            assert [x.date for x in out] == [rows[1260][1], rows[1323][1]]
        assert out[0].date == rows[1260][1]
        fit = q.fit_garch_t(r[:1260])
        assert abs(out[0].half_life / q.half_life(fit["alpha"], fit["beta"]) - 1) < 1e-3


# -- inference ---------------------------------------------------------------------------------------------------------
def test_null_bootstrap_gives_a_p_per_feed(spark):
    out = entry.queries()["i4_null_bootstrap"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) > 10 and len({x.source_id for x in out}) == len(out)
    known = [x.p for x in out if x.p is not None]
    assert all(abs(p * 2001 - round(p * 2001)) < 2e-2 and 0 < p <= 1 for p in known)


def test_null_slope_p_tells_predictable_returns_from_others():
    rng = np.random.default_rng(1)
    r = rng.normal(0, 1, 200)
    level = np.zeros(200)
    bound = r.copy()
    for t in range(1, 200):
        level[t] = 0.5 * level[t - 1] + rng.normal()
        bound[t] += level[t - 1]
    slope, p = inference.null_slope_p(level, bound, 2000, 1, np.random.default_rng(0))  # longer blocks would keep what lies within them
    assert abs(slope - np.polyfit(level[:-1], bound[1:], 1)[0]) < 1e-12 and p == 1 / 2001
    assert inference.null_slope_p(level, r, 2000, 1, np.random.default_rng(0))[1] > 0.02
    assert np.isnan(inference.null_slope_p(level[:26], r[:26], 10, 12, rng)[1])


def test_block_permutation_p():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 420))
    assert inference.permutation_p(x, x + y, 500, 21, np.random.default_rng(0))[1] == 1 / 501
    assert inference.permutation_p(x, y, 500, 21, np.random.default_rng(0))[1] > 0.02


def test_sharpe_replicate_is_drawn_once(spark, monkeypatch):
    calls = []

    def replicates(spark, n, statistic, seed=0, slices=None):
        calls.append(seed)
        first = statistic(np.random.default_rng([seed, 0]))
        if seed == 0:
            x = sequential_queries.monthly_sample(spark, FOLDER)
            d = x[inference.stationary_index(np.random.default_rng([0, 0]), len(x), 12)]
            assert abs(first - d.mean() / d.std()) < 1e-12
        return spark.createDataFrame([(0, first)], "rep long, value double")

    monkeypatch.setattr(inference, "replicates", replicates)
    assert entry.queries()["i5_bootstrap_interval"](spark, FOLDER).columns and calls == [0, 1, 2, 3]


def test_event_logit_is_scored_on_the_rows_after_its_window():
    rng = np.random.default_rng(4)
    e = (rng.random(252 + 63 + 20) < 0.1).astype(float)
    out = q.rolling_event_logit(e, 252, 63, 0.1, (1e-3, 1e-1))
    assert [(f["at"], f["scored"]) for f in out] == [(252, 63), (315, 20)]
    h = np.concatenate([[np.nan], q.excitation(e, 0.1)[:-1]])
    assert abs(out[0]["loss"] - q.bernoulli_loss(out[0]["a"] + out[0]["b"] * h[252:315], e[252:315])) < 1e-12
    later = e.copy()
    later[252:] = 1 - later[252:]
    again = q.rolling_event_logit(later, 252, 63, 0.1, (1e-3, 1e-1))
    assert (again[0]["a"], again[0]["b"], again[0]["ridge"]) == (out[0]["a"], out[0]["b"], out[0]["ridge"]) and again[0]["loss"] != out[0]["loss"]


def test_mean_correlation_takes_all_pairs(spark, tmp_path):
    from chronoplane.plans.panels import INDUSTRIES

    x = np.random.default_rng(6).normal(0, 0.01, (70, 10)) + np.random.default_rng(7).normal(0, 0.01, (70, 1))
    rows = [("f", dt.date(2001, 1, 1) + dt.timedelta(days=i), *map(float, v)) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "source_id string, date date, " + ", ".join(f"{c} double" for c in INDUSTRIES)).write.parquet(f"{tmp_path}/assets_daily.parquet")
    out = [r.corr_z for r in entry.queries()["w29_mean_corr_z"](spark, str(tmp_path)).orderBy("date").collect()]
    assert out[:63] == [None] * 63
    c = np.corrcoef(x[6:69].T)
    assert abs(out[69] - np.arctanh(c[np.triu_indices(10, 1)].mean())) < 1e-4
