"""Order-dependent estimators against definitions, pandas and brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoplane.operators import inference, linalg
from chronoplane.operators import sequential as q

RNG = np.random.default_rng(0)


def holes(x, share=0.1):
    x = x.copy()
    x[RNG.random(len(x)) < share] = np.nan
    return x


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5).map(float), st.just(math.nan)), max_size=60))
def test_expanding_rank(x):
    got = q.expanding_rank(np.array(x, float))
    want = pd.Series(x, dtype=float).expanding().rank(pct=True).to_numpy() if x else np.array([])
    np.testing.assert_allclose(got, want)


def test_ewm_equals_pandas():
    x = holes(RNG.normal(size=500))
    np.testing.assert_allclose(q.ewm_mean(x, 10), pd.Series(x).ewm(halflife=10).mean())
    np.testing.assert_allclose(q.ewm_std(x, 20)[2:], pd.Series(x).ewm(halflife=20).std().to_numpy()[2:], rtol=1e-7)


def test_ewma_vol_seed_and_poison():
    r = RNG.normal(0, 0.01, 300)
    v = q.ewma_vol(r)
    assert np.isnan(v[:252]).all() and v[252] == pytest.approx(math.sqrt(252 * (0.94 * r[:252].var() + 0.06 * r[252] ** 2)))
    r[260] = np.nan
    assert np.isnan(q.ewma_vol(r)[260:]).all()
    assert len(q.ewma_vol(np.array([]))) == 0


def test_causal_functions_do_not_look_ahead():
    r = RNG.normal(0, 0.01, 400)
    moved = np.concatenate([r[:280], RNG.normal(0, 1, 120)])
    for f in (q.ewma_vol, q.expanding_rank, lambda x: q.ewm_mean(x, 5), lambda x: q.ewm_std(x, 5), q.smoothed, lambda x: q.excitation((x < 0).astype(float), 0.3), lambda x: q.hysteresis((x > 0).astype(float), 3), q.vol_target, lambda x: q.kalman(x, 0.9, 0.1, 0.1)[0]):
        np.testing.assert_array_equal(f(r)[:280], f(moved)[:280])
    # the guard bites: a full-sample rank changes the past
    assert (pd.Series(r).rank().to_numpy()[:280] != pd.Series(moved).rank().to_numpy()[:280]).any()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(2, 3), st.floats(0, 3), st.integers(0, 10_000))
def test_best_path_is_best(n, k, penalty, seed):
    cost = np.random.default_rng(seed).random((n, k))
    path, value = q.best_path(cost, penalty)
    total = lambda p: sum(cost[t, s] for t, s in enumerate(p)) + penalty * sum(a != b for a, b in zip(p, p[1:]))
    assert total(path) == pytest.approx(value) == pytest.approx(min(map(total, itertools.product(range(k), repeat=n))))


def test_filtering_chains_and_forgets_the_future():
    x, centres = RNG.normal(size=(80, 2)), np.array([[-1.0, 0.0], [1.0, 0.0]])
    whole, last = q.filtered_states(x, centres, 2.0)
    first, v = q.filtered_states(x[:30], centres, 2.0)
    rest, end = q.filtered_states(x[30:], centres, 2.0, v)
    assert (np.concatenate([first, rest]) == whole).all() and np.allclose(end, last)


def test_jump_model_finds_planted_states():
    s = np.repeat([0, 1, 0, 1], 60)
    x = RNG.normal(size=(240, 3)) * 0.3 + s[:, None] * 2.0
    fit = q.fit_jump_model(x, 2, 5.0, starts=3)
    assert (fit["path"] == s).mean() > 0.97 and fit["centres"][0, 0] < fit["centres"][1, 0]
    with pytest.raises(ValueError):
        q.fit_jump_model(np.array([[np.nan]]))
    states, chosen = q.walk_forward(RNG.normal(0, 0.01, 240), x, 10, 120, 60, (1.0, 5.0), 30)
    assert (states[:130] == -1).all() and (states[130:] >= 0).all() and len(chosen) == 2


def test_bull_bear_and_drawdowns():
    p = np.array([1, 2, 3, 2.3, 3.1, 2, 1.9, 2.5, 3.0])
    assert q.bull_bear(p, 0.2).tolist() == [0, 0, 0, 1, 0, 1, 1, 0, 0]
    r = p[1:] / p[:-1] - 1
    worst = q.drawdown_episodes(list(range(len(r))), r, 2)
    assert worst[0][:2] == (3, 5) and worst[0][3] == pytest.approx(1.9 / 3.1 - 1)
    assert q.drawdown_episodes([], np.array([]), 3) == []


def test_hysteresis():
    x = np.array([0, 1, 0, 1, 1, np.nan, 1, 1, 0, 0, 0.0])
    assert q.hysteresis(x, 2).tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 1, 0, 0]
    assert np.isnan(q.hysteresis(np.array([np.nan, np.nan]), 2)).all()


def test_garch_recovers_persistence():
    rng = np.random.default_rng(5)
    n, omega, alpha, beta = 3000, 0.02, 0.08, 0.9
    e, s2 = np.empty(n), 1.0
    for t in range(n):
        e[t] = math.sqrt(s2) * rng.standard_t(7) * math.sqrt(5 / 7)
        s2 = omega + alpha * e[t] ** 2 + beta * s2
    fit = q.fit_garch_t(e / 100)
    assert fit["alpha"] + fit["beta"] == pytest.approx(0.98, abs=0.03) and 3 < fit["nu"] < 15
    assert math.isnan(q.fit_garch_t(np.zeros(100))["mu"]) and math.isnan(q.half_life(0.2, 0.8)) and q.half_life(0.1, 0.8) == pytest.approx(6.5788, abs=1e-3)


def test_kalman_and_hidden_states():
    z = np.cumsum(RNG.normal(size=200)) * 0.1 + RNG.normal(size=200)
    phi, level, noise = q.fit_kalman(z)
    assert q.kalman(z, phi, level, noise)[1] >= q.kalman(z, 0.5, 1.0, 1.0)[1]
    log = np.log(RNG.random((6, 2)))
    a, start = np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([0.4, 0.6])
    force = sum(start[p[0]] * np.prod([a[x, y] for x, y in zip(p, p[1:])]) * np.exp(sum(log[t, s] for t, s in enumerate(p))) for p in itertools.product(range(2), repeat=6))
    assert q.hmm_log_likelihood(log, a, start) == pytest.approx(math.log(force))


def test_logit_and_strategy():
    x = RNG.normal(size=(4000, 1))
    y = (RNG.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0])))).astype(float)
    b = q.fit_logit(x, y, 1e-6)
    assert b == pytest.approx([0.5, 2.0], abs=0.2)
    w = np.array([1.0, 1.0, 0.0])
    np.testing.assert_allclose(q.strategy_returns(w, np.array([0.1, 0.2, 0.3]), 0.0), [0.0, 0.2 - 0.001, 0.3])


def test_small_matrices():
    c = RNG.random((6, 6))
    assert sum(c[i, j] for i, j in enumerate(linalg.assignment(c))) == pytest.approx(linalg.best_assignment_by_force(c))
    x = RNG.normal(size=(300, 4)) @ RNG.normal(size=(4, 4))
    s = linalg.toward_constant_correlation(np.cov(x.T))
    w = linalg.minimum_variance(s)
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and all(w @ s @ w <= v @ s @ v + 1e-9 for v in RNG.dirichlet(np.ones(4), 300))
    e = linalg.equal_risk(s)
    parts = e * (s @ e)
    assert parts == pytest.approx(np.full(4, parts.mean()), rel=1e-6)
    assert linalg.qlik(s, s) == pytest.approx(0, abs=1e-6) and linalg.correlation_distance(s, 4 * s) == pytest.approx(0, abs=1e-12)
    assert linalg.absorption_ratio(np.eye(5)) == pytest.approx(0.2) and 1 <= linalg.participation_ratio(x) <= 4
    assert linalg.principal_angles(np.eye(4)[:, :2], np.eye(4)[:, :2]) == pytest.approx([0, 0], abs=1e-7)
    b, f = linalg.var1(np.column_stack([0.5 ** np.arange(30), 0.8 ** np.arange(30)]), 1)
    assert f == pytest.approx([0.5**30, 0.8**30], abs=1e-9)
    a, coef = linalg.ridge_cv(x[:, 1:], x[:, 1:] @ [1.0, 2.0, 3.0] + 5)
    assert coef == pytest.approx([5, 1, 2, 3], rel=1e-2) and a == 0.01
    m = np.concatenate([RNG.normal(-4, 1, (200, 2)), RNG.normal(4, 1, (200, 2))])
    assert linalg.gaussian_mixture(m, 2)["bic"] < linalg.gaussian_mixture(m, 1)["bic"]
    assert linalg.bisect_root(lambda v: v**3 - 2, 0, 4) == pytest.approx(2 ** (1 / 3))


def test_resampling():
    g = np.random.default_rng(1)
    assert sorted(inference.block_permutation(g, 10, 3)) == list(range(10))
    assert len(inference.block_index(g, 25, 12)) == 25 and inference.stationary_index(g, 50, 5).max() < 50
    x = g.normal(size=64)
    np.testing.assert_allclose(np.abs(np.fft.rfft(inference.phase_surrogate(g, x) - x.mean()))[1:-1], np.abs(np.fft.rfft(x - x.mean()))[1:-1], rtol=1e-8)
    assert inference.chi2_tail(3.841459) == pytest.approx(0.05, abs=1e-5)


def test_replicates_do_not_depend_on_partitions(spark):
    draw = lambda g: float(g.normal())
    a, b = ({r.rep: r.value for r in inference.replicates(spark, 20, draw, 3, n).collect()} for n in (1, 7))
    assert a == b and len(set(a.values())) == 20


def test_refits_see_only_their_window(spark):
    rows = [("s", i, float(i)) for i in range(25)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    out = q.windowed_refits(df, ["k"], "t", ["x"], 10, 5, lambda g: {"lo": float(g["x"].min()), "hi": float(g["x"].max()), "n": float(len(g))}, "lo double, hi double, n double")
    assert sorted((r.refit, r.t, r.lo, r.hi, r.n) for r in out.collect()) == [(0, 10, 0, 9, 10), (1, 15, 5, 14, 10), (2, 20, 10, 19, 10)]


def test_regressions(spark):
    n = 200
    x = RNG.normal(size=n).cumsum()
    z = RNG.normal(size=n)
    y = 0.5 * x - 2 * z + RNG.normal(size=n)
    df = spark.createDataFrame([("k", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, x, z))], "k string, t int, y double, x double, z double")
    r = inference.normal_equations(df, ["k"], "y", ["x", "z"]).first()
    d = np.column_stack([np.ones(n), x, z])
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    assert r.beta == pytest.approx(beta.tolist()) and r.r2 == pytest.approx(1 - ((y - d @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    h = inference.newey_west(df, ["k"], "t", "y", "x", 4).first()
    d = np.column_stack([np.ones(n), x])
    b = np.linalg.lstsq(d, y, rcond=None)[0]
    g = d * (y - d @ b)[:, None]
    meat = g.T @ g + sum((1 - k / 5) * (g[k:].T @ g[:-k] + g[:-k].T @ g[k:]) for k in range(1, 5))
    bread = np.linalg.inv(d.T @ d)
    assert h.t_hac == pytest.approx(b[1] / math.sqrt((bread @ meat @ bread)[1, 1]))
    singular = inference.normal_equations(df.withColumn("z", df.x * 2), ["k"], "y", ["x", "z"]).first()
    assert singular.beta is None


def test_expanding_quantile():
    x = holes(RNG.normal(size=120))
    np.testing.assert_allclose(q.expanding_quantile(x, 0.8, 5), pd.Series(x).expanding(5).quantile(0.8).to_numpy())


def test_block_sums_and_correlations(spark):
    from chronoplane.operators import rolling

    rng = np.random.default_rng(11)
    frames = []
    for k, n in (("a", 100), ("b", 7), ("c", 1)):
        d = pd.DataFrame({"k": k, "t": range(n), "x": rng.normal(5, 0.01, n), "y": rng.normal(size=n)})
        if k == "a":
            d.loc[30, "x"] = 1e9  # leaves no trace in later windows
            d.loc[50, "y"] = np.nan
            d.loc[70:80, "x"] = 5.0
        frames.append(d)
    whole = pd.concat(frames)
    df = spark.createDataFrame([(r.k, int(r.t), float(r.x), None if np.isnan(r.y) else float(r.y)) for r in whole.itertuples()], "k string, t int, x double, y double")
    for w in (1, 2, 5, 8, 64):
        got = {(r.k, r.t): (r.s, r.c) for r in rolling.rolling_correlations(rolling.rolling_sums(df, ["k"], "t", {"s": df.y}, w), ["k"], "t", {"c": ("x", "y")}, w).collect()}
        for d in frames:
            s, c = d.y.fillna(0).rolling(w).sum(), [d.x[i - w + 1 : i + 1].corr(d.y[i - w + 1 : i + 1]) if i + 1 >= w and d.y[i - w + 1 : i + 1].notna().all() and np.ptp(d.x[i - w + 1 : i + 1]) > 0 else None for i in range(len(d))]
            for i in range(len(d)):
                a, b = got[(d.k[0], i)]
                assert (a is None) == np.isnan(s[i]) and (a is None or a == pytest.approx(s[i], abs=1e-9))
                assert (b is None) == (c[i] is None or w < 2) and (b is None or b == pytest.approx(c[i], abs=1e-6))


def test_variance_inflation_equals_regressions(spark):
    from chronoplane.operators import inference

    x = RNG.normal(size=(200, 3))
    x[:, 2] += 0.8 * x[:, 0] - 0.5 * x[:, 1]
    rows = [("k", *map(float, v)) for v in x] + [("flat", 1.0, float(i), 2.0 * i) for i in range(20)] + [("k", None, 1.0, 1.0)]
    got = {r.k: r for r in inference.variance_inflation(spark.createDataFrame(rows, "k string, a double, b double, c double"), ["k"], ["a", "b", "c"]).collect()}
    want = []
    for j in range(3):
        d = np.column_stack([np.ones(200), np.delete(x, j, 1)])
        e = x[:, j] - d @ np.linalg.lstsq(d, x[:, j], rcond=None)[0]
        want.append(((x[:, j] - x[:, j].mean()) ** 2).sum() / (e @ e))
    assert got["k"].n == 200 and np.allclose(got["k"].vif, want) and got["flat"].vif is None


def test_placebo_spline_and_logit():
    from chronoplane.operators import inference

    rng = np.random.default_rng(8)
    base, extra = rng.normal(size=(300, 2)), np.cumsum(rng.normal(size=300)) * 0.1
    y = base @ [0.3, -0.2] + rng.normal(size=300)
    gain, p = inference.placebo_gain(y + extra, base, extra, 99, np.random.default_rng(0))
    assert gain > 0.05 and p <= 0.02
    assert inference.placebo_gain(y, base, rng.normal(size=300), 99, np.random.default_rng(0))[1] > 0.02
    x = rng.uniform(-2, 2, 500)
    curve = np.sin(2 * x) + rng.normal(0, 0.1, 500)
    line = np.polyfit(x[:400], curve[:400], 1)
    assert inference.spline_score(x[:400], curve[:400], x[400:], curve[400:]) < 0.3 * ((curve[400:] - np.polyval(line, x[400:])) ** 2).mean()
    hit = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    assert inference.logit_score(x[:400], hit[:400], x[400:], hit[400:]) < 0.55
    assert abs(inference.logit_score(np.r_[0.0, 1.0] , np.r_[1.0, 0.0], np.r_[0.5], np.r_[1.0]) - np.log(2)) < 1e-6


def test_silhouettes_equal_the_definition(spark):
    from chronoplane.operators import cross_section

    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(400, 2)), rng.integers(0, 3, 400)
    x[label == 1] += 3
    label[7] = 9  # alone
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(400):
        means = {k: d[i, (label == k) & (np.arange(400) != i)].mean() for k in set(label) if ((label == k) & (np.arange(400) != i)).any()}
        own = means.pop(label[i], None)
        s.append(0.0 if own is None else (min(means.values()) - own) / max(own, min(means.values())))
    df = spark.createDataFrame([("a", i, float(p), float(q), int(k)) for i, ((p, q), k) in enumerate(zip(x, label))] + [("b", 1, 0.0, 0.0, 1)], "k string, i int, p double, q double, l int")
    got = {r.k: r.silhouette for r in cross_section.silhouettes(df, ["k"], "i", ["p", "q"], "l").collect()}
    assert abs(got["a"] - np.mean(s)) < 1e-9 and (got["b"] is None or np.isnan(got["b"]))


def test_correlations_do_not_depend_on_later_rows(spark):
    from chronoplane.operators.rolling import rolling_correlations

    rows = [("k", i, float(a), float(b)) for i, (a, b) in enumerate(RNG.normal(0, 0.01, (90, 2)))]
    build = lambda r: {x.i: x.c for x in rolling_correlations(spark.createDataFrame(r, "k string, i int, a double, b double"), ["k"], "i", {"c": ("a", "b")}, 21).collect()}
    whole, changed = build(rows), build(rows[:60] + [(k, i, 50.0 + a, b) for k, i, a, b in rows[60:]])
    assert all(whole[i] == changed[i] for i in range(60)) and whole[70] != changed[70]
    window = np.array([r[2:] for r in rows[30:51]])
    assert abs(whole[50] - np.corrcoef(window.T)[0, 1]) < 1e-12
