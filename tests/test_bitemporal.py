"""The record contract, the log's invariants, sources and relational helpers."""

import copy
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronoplane.functions import stats
from chronoplane.functions import windows as w
from chronoplane.operators import bitemporal as bi
from chronoplane.operators import calendar, runs
from chronoplane.operators import cross_section as xs
from chronoplane.plans import signals
from chronoplane.sources import files, text_panels

GOOD = {
    "spec_version": "1.0", "signal": "vol_x", "as_of": "2020-01-31", "available_at": "2020-03-06T13:30:00Z", "clock": "monthly", "assumption_monitored": "N/A because it is context",
    "reading": {"value": 0.2, "units": "x", "estimator": "y"}, "rarity": {"level_percentile": 0.5, "basis": "expanding", "window": None},
    "assessment": {"mechanism": "pass", "measurement_validity": "H", "investment_usefulness": "M", "evidence_maturity": "L"}, "maturity": "production",
}


def changed(**paths):
    r = copy.deepcopy(GOOD)
    for path, value in paths.items():
        *way, leaf = path.split("__")
        part = r
        for x in way:
            part = part[x]
        if value is ...:
            part.pop(leaf)
        else:
            part[leaf] = value
    return r


@pytest.mark.parametrize("record", [
    GOOD, changed(reading__value=None, reading__undefined_reason="no data"), changed(rarity__basis="trailing_fixed", rarity__window=252), changed(rarity__basis="full_sample", maturity="research"),
    changed(supersedes="ab"), changed(trend={"level_percentile_change": 0.1, "lookback_observations": 10}), changed(spec_version="<version>", as_of="<day>", rarity__level_percentile="<p>"),
    changed(assumption_state={"status": "intact", "derivation": "corr < -0.1"}), changed(cross_signal_relationships=["reorder of things"]),
])
def test_good_records(record):
    assert bi.violations(json.dumps(record)) == []


@pytest.mark.parametrize(("record", "rule"), [
    (changed(spec_version="2.0"), "spec_version"), (changed(assumption_monitored=" "), "assumption_empty"), (changed(rarity__window=10), "window_rule"), (changed(rarity__basis="trailing_fixed"), "window_rule"),
    (changed(rarity__basis="full_sample"), "leaking_production"), (changed(assessment__mechanism="rejected"), "leaking_production"), (changed(available_at=...), "missing_field"), (changed(available_at="2020-03-06"), "available_at_form"),
    (changed(reading__value=None), "undefined_without_reason"), (changed(rarity__level_percentile=1.01), "percentile_bounds"), (changed(reading__units=""), "reading_fields"), (changed(target_weight=1), "decision_word"),
    (changed(reading__sizing=1), "decision_word"), (changed(signal="Vol-X"), "signal_form"), (changed(extra=1), "unknown_key"), (changed(assessment__extra="H"), "unknown_key"), (changed(as_of="31.01.2020"), "as_of_form"),
    (changed(trend={"level_percentile_change": 0.1}), "trend_horizon"), (changed(assumption_state={"status": "intact"}), "status_without_rule"), (changed(clock="hourly"), "choice"), (changed(rarity__basis="guess"), "choice"),
    (changed(reading__secondary_readings=[{"name": "a"}]), "secondary_fields"), (changed(rarity=3), "rarity_fields"),
])
def test_bad_records(record, rule):
    assert rule in bi.violations(json.dumps(record))


def test_not_json():
    assert bi.violations("{") == bi.violations(None) == ["not_json"] and bi.violations("[1]") == ["not_an_object"]


def test_canonical_hash(spark):
    texts = ['{"b": 1e-07, "a": "é"}', '{"a":"\\u00e9","b":1e-7}', '{"a": NaN}', None, "x"]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(bi.sha256_of_json(F.col("t")).alias("h")).collect()]
    assert got[0] == got[1] and len(got[0]) == 64 and got[2:] == [None] * 3


LOG = "s string, as_of string, at long, line long, v double, sha string, supersedes string, spec_version string"


def test_views_and_replay(spark):
    rows = [("a", "2020-01", 1, 1, 1.0, "h1", None, "1.0"), ("a", "2020-01", 5, 2, 2.0, "h2", "h1", "1.0"), ("a", "2020-02", 3, 3, 3.0, "h3", None, "1.0"), ("a", "2020-02", 3, 4, 4.0, "h4", None, "1.0"), ("a", "2020-03", None, 5, 9.0, "h5", None, "1.0")]
    log = spark.createDataFrame(rows, LOG)
    view = {r.as_of: r.v for r in bi.current_view(log, ["s"], F.col("at"), "line", ["v"]).collect()}
    assert view == {"2020-01": 2.0, "2020-02": 4.0}
    known = lambda d, t: [(r.as_of, r.v) for r in bi.known_at(d, t, ["s"], F.col("at"), "line", ["v"]).collect()]
    assert known(log, 2) == [("2020-01", 1.0)] and known(log, 9) == [("2020-02", 4.0)] and known(log, 0) == []
    # replay: what comes later changes nothing
    assert known(log.where("at <= 2"), 2) == known(log, 2)


def test_append_corrections_audit_manifest(spark):
    rows = [("a", "2020-01-05", 1, 1, 1.0, "h1", None, "1.0"), ("a", "2020-01-06", 10**18, 2, 2.0, "h2", "gone", "1.0"), ("a", "2020-01-06", 10**18, 3, 2.0, "h9", None, "1.0"), ("a", "2020-01-06", 10**18, 3, 2.0, "h9", None, "1.0")]
    log = spark.createDataFrame(rows, LOG)
    fresh = spark.createDataFrame([("a", "2020-01-05", 1, "h1"), ("a", "2020-01-06", 10**18, "other"), ("b", "2020-01-05", 1, "n")], "s string, as_of string, at long, sha string")
    new, conflict = bi.split_append(log.where("line < 3"), fresh, ["s", "as_of", "at"], "sha")
    assert [r.s for r in new.collect()] == ["b"] and [r.sha for r in conflict.collect()] == ["other"]
    view = spark.createDataFrame([("a", "d1", 1.0, "h1"), ("a", "d2", None, "h2")], "s string, as_of string, v double, sha string")
    rebuilt = spark.createDataFrame([("a", "d1", 1.5), ("a", "d2", None), ("a", "d3", 2.0)], "s string, as_of string, v double")
    fixes = bi.corrections(view, rebuilt, ["s", "as_of"], "v", "sha", "now").collect()
    assert [(r.as_of, r.supersedes, r.available_at) for r in fixes] == [("d1", "h1", "now")]
    problems = {(r.problem, r.n) for r in bi.audit(log, ["s"], F.col("at"), "line", "sha").collect()}
    assert problems == {("key_with_several_lines", 1), ("available_before_as_of", 1), ("supersedes_unknown", 1), ("repeated_line", 1)}
    prior = spark.createDataFrame([("a", "2020-01-05", 1, "h1", "captured")], "s string, as_of string, at long, sha string, provenance string")
    assert {(r.sha, r.provenance) for r in bi.derive_manifest(log, prior, ["s", "as_of", "at"], "sha").collect()} == {("h1", "captured"), ("h2", "reconstructed"), ("h9", "reconstructed")}


def test_look_ahead_guard_bites(spark):
    rows = [("a", i, float((i * 7919) % 13)) for i in range(40)]
    panel = spark.createDataFrame(rows, "s string, t int, x double")
    a = w.Along("s", "t")
    causal = lambda p: p.select("s", "t", a.mean(F.col("x"), 5).alias("m"), a.expanding_z(F.col("x"), 5).alias("z"))
    centred = lambda p: p.select("s", "t", a.rolling(F.avg, [F.col("x")], 3, a.spec.rowsBetween(-1, 1)).alias("m"))
    assert bi.look_ahead(causal, panel, ["s"], "t", ["x"], 28).count() == 0
    assert bi.look_ahead(centred, panel, ["s"], "t", ["x"], 28).count() > 0
    for build in (lambda p: signals.stock_bond_monthly(p, 4, 5), lambda p: signals.valuation(p, 4, 5), lambda p: signals.credit(p, 5).withColumnRenamed("obs_month", "month")):
        months = spark.sql("SELECT 'a' AS series, last_day(add_months(date'2000-01-01', int(id))) AS month, 1.0 + (id * 7919 % 13) AS eq, 1.0 + (id * 104729 % 11) AS bond FROM range(40)").selectExpr("*", "eq as price", "bond as earnings", "1.0 + eq / 9 as cpi", "eq as ebp")
        months = months.select("series", "month", *[F.col(c).cast("double").alias(c) for c in months.columns[2:]])
        assert bi.look_ahead(build, months, ["series"], "month", ["eq", "bond", "price", "earnings", "cpi", "ebp"], dt.date(2002, 1, 31)).count() == 0


def test_publication_lags(spark):
    months = [(m, last) for m, last in ((i, None) for i in range(30))]
    rows = [("a", dt.date(2000 + m // 12, m % 12 + 1, 28), 100.0, 5.0 if m != 12 else 50.0, 2.0) for m, _ in months]
    schema = "series string, month date, price double, earnings double, cpi double"
    base = [("a", r[1], r[2], 5.0, r[4]) for r in rows]
    cape = lambda d: {r.month: r.cape for r in signals.valuation(spark.createDataFrame(d, schema), 3, 5).collect()}
    a, b = cape(rows), cape(base)
    moved = sorted(m for m in a if a[m] != b[m])
    assert moved == [rows[i][1] for i in (17, 18, 19)]


def test_runs_and_spells(spark):
    rows = [("a", i, s) for i, s in enumerate(["x", "x", None, "x", "y", "y", "y", "x"])] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, t int, s string")
    got = [(r.s, r.start, r.end, r.length) for r in runs.contiguous_runs(df, ["k"], "t", "s").orderBy("run").collect()]
    assert got == [("x", 0, 3, 3), ("y", 4, 6, 3), ("x", 7, 7, 1)]
    sp = runs.spells(df.withColumn("f", F.col("s") == "y"), ["k"], "t", "f").first()
    assert (sp.spells, sp.median_length, sp.longest, sp.current, sp.rows_since) == (1, 3.0, 3, 0, 1)
    e = runs.episodes(spark.createDataFrame([("a", i, i in (1, 2, 9)) for i in range(12)], "k string, t int, h boolean"), ["k"], "t", F.col("h"), 3).orderBy("episode").collect()
    assert [(r.start, r.end, r.hot_rows) for r in e] == [(1, 2, 2), (9, 9, 1)]


def test_calendar(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 5), 0.1), ("a", dt.date(2020, 1, 6), None), ("a", dt.date(2020, 3, 5), 0.2)], "k string, d date, r double")
    got = {r.month.month: r.r for r in calendar.compound_months(df, ["k"], "d", "r").collect()}
    assert got == {1: pytest.approx(0.1), 2: 0.0, 3: pytest.approx(0.2)}
    days = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (2, 3, 4, 5)], "d date")
    assert [r.n.day for r in days.select(calendar.next_business_day(F.col("d")).alias("n")).collect()] == [3, 6, 6, 6]
    with pytest.raises(ValueError):
        calendar.available_at(F.col("d"), "nowhere")
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 4, None)], "k string, u int, v double")
    assert {(r.k, r.t): r.v for r in calendar.asof_backward(left, right, ["k"], "t", "u", "v").collect()} == {("a", 5): 2.0, ("a", 1): None, ("b", 3): None}


def test_correlation_measures(spark):
    for n in (3, 6):
        for rho in (-0.05, 0.0, 0.5, 0.9):
            pairs = spark.createDataFrame([("m", str(i), str(j), rho) for i in range(n) for j in range(i + 1, n)], "k string, i string, j string, rho double")
            r = xs.matrix_measures(pairs, ["k"]).first()
            assert r.mean_rho == pytest.approx(rho) and r.residual_share == pytest.approx(0, abs=1e-7)
    r = xs.matrix_measures(spark.createDataFrame([("m", "a", "b", 0.5), ("m", "a", "c", None)], "k string, i string, j string, rho double"), ["k"]).first()
    assert r.mean_rho is None and r.residual_share is None


def test_aggregates(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 9.0, None)], "k string, x double")
    r = df.groupBy("k").agg(stats.bias_corrected_skew(F.col("x")).alias("s"), stats.bias_corrected_kurtosis(F.col("x")).alias("u"), stats.sharpe(F.lit(1.0)).alias("z"), w.corr(F.col("x"), F.lit(1.0)).alias("c")).first()
    import pandas as pd

    x = pd.Series([1, 2, 2, 9.0])
    assert (r.s, r.u) == (pytest.approx(x.skew()), pytest.approx(x.kurt())) and r.z == 0 and r.c is None
    clipped = [v.c for v in df.select(w.clip(F.col("x"), 1.5, 3).alias("c")).collect()]
    assert clipped == [1.5, 2.0, 2.0, 3.0, None]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Preamble\n\n,mkt, rf\n20200102, 1.50,-99.99\n20200103,-999, 0.1\n\n20200102, 9, 9\nend\n")
    lines = text_panels.numbered_lines(spark, str(tmp_path / "a.txt"))
    got = {r.date.day: (r.mkt, r.rf) for r in text_panels.daily_table(lines, ["mkt", "rf"]).collect()}
    assert got == {2: (0.015, None), 3: (None, 0.001)} and text_panels.header(lines).first().names == ["mkt", "rf"]
    with pytest.raises(Exception, match="expected one block"):
        text_panels.titled_block(lines, "Nothing", ["a"]).collect()


def test_file_sources(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in files.read_log(spark, str(tmp_path / "log.json"), "a int").collect()] == [1, 2]
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        files.read_log(spark, str(tmp_path / "bad.json"), "a int").collect()
    folder = tmp_path / "v"
    folder.mkdir()
    (folder / "v1.csv").write_bytes("﻿date,x\n2020-01-01,1\n,,\nbad,2\n".encode())
    got = files.read_vintages(spark, str(folder), "date string, x double", "date").collect()
    assert [(r.vintage, r.x) for r in got] == [("v1", 1.0)]
    text = spark.createDataFrame([('[["timestamp","digest"],["2","d"],["1","d"],["3","e"]]',)], "t string")
    rows = files.parse_archive_json(text, "t").select("row.timestamp", "row.digest")
    assert {(r.digest, r.timestamp) for r in files.archive_index(rows, "digest", "timestamp", []).collect()} == {("d", "1"), ("e", "3")}
    built = []
    make = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert built == [1]


def test_reindexed_names(spark):
    a = spark.createDataFrame([("f", "1"), ("g", "2"), ("h", None)], "file string, sha string")
    b = spark.createDataFrame([("f", "1"), ("g", "3"), ("i", "4"), ("h", None)], "file string, sha string")
    assert {(r.file, r.change) for r in files.manifest_changes(a, b, ["file"], "sha").collect()} == {("g", "changed"), ("i", "added")}


def test_schema_agrees_with_rules():
    schema = bi.json_schema()
    assert set(schema["properties"]) == bi.TOP_LEVEL and set(schema["required"]) == bi.REQUIRED
    assert set(schema["properties"]["assessment"]["required"]) == bi.ASSESSMENT and json.dumps(schema)
    for key in schema["required"]:
        assert "missing_field" in bi.violations(json.dumps({k: v for k, v in GOOD.items() if k != key}))


def test_schema_closes_inner_objects():
    def objects(part):
        if isinstance(part, dict):
            if part.get("type") == "object":
                yield part
            for v in part.values():
                yield from objects(v)
        elif isinstance(part, list):
            for v in part:
                yield from objects(v)

    found = list(objects(bi.json_schema()))
    assert len(found) >= 8 and all(o["additionalProperties"] is False for o in found)


def test_axis_map(spark):
    p = [0.5, 0.99, 0.97, 0.5, 0.02, 0.6, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.94, 0.96, 0.98]
    status = ["intact"] * 11 + ["violated"] * 4
    rows = [("a", i, v, s) for i, (v, s) in enumerate(zip(p, status))] + [("a", 99, None, "intact"), ("never", 1, 0.5, None), ("never", 2, 0.4, None)]
    df = spark.createDataFrame(rows, "axis string, t int, p double, s string").selectExpr("*", "1 as n", "2 as run")
    got = {r.axis: r for r in bi.axis_map(df, ["axis"], "t", "p", "s").collect()}
    r = got["a"]
    assert (r.as_of, r.status, r.percentile, r.inside, r.readings) == (14, "violated", 0.98, True, 15)
    assert (r.spell_now, r.median_spell, r.longest_spell, r.since_inside, r.since_status) == (2, 2.0, 2, 0, 4)
    assert r.moved == pytest.approx(0.98 - 0.97) and r.tail_mass == pytest.approx(0.02)
    r = got["never"]
    assert (r.inside, r.spell_now, r.since_inside, r.median_spell, r.moved, r.since_status) == (False, 0, None, None, None, 2)
    # what is known at an instant doesn't change with what comes later
    early = {r.axis: r for r in bi.axis_map(df.where("t < 10"), ["axis"], "t", "p", "s").collect()}
    assert (early["a"].as_of, early["a"].since_inside, early["a"].spell_now) == (9, 5, 0)
    assert bi.axis_map(df.where("false"), ["axis"], "t", "p", "s").collect() == []


def test_presentation(spark):
    from chronoplane.plans import present

    rows = present.rows_of(spark.createDataFrame([("b", None), ("a", "<x> & y")], "k string, v string"), ["k"])
    assert [r["k"] for r in rows] == ["a", "b"] and json.loads(present.to_json(rows)) == rows
    assert present.to_text(rows).splitlines() == ["k  v", "a  <x> & y", "b"] and present.to_text([]) == "(nothing)\n"
    page = present.to_html(rows, "a < b")
    assert "<td>&lt;x&gt; &amp; y</td>" in page and "<title>a &lt; b</title>" in page
