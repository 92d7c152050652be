"""Observation records in an append-only log with two times: the day a reading is about and the instant it became available."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.functions import windows as w
from chronoplane.operators import calendar

# --- fixed values: the record's closed schema ---------------------------------------------------------------------------
SPEC_VERSION = "1.0"
TOP_LEVEL = frozenset(
    "spec_version signal as_of available_at supersedes clock assumption_monitored assumption_state reading rarity trend extreme_conditions cross_signal_relationships assessment maturity".split()
)
REQUIRED = frozenset("spec_version signal as_of available_at clock assumption_monitored reading rarity assessment maturity".split())
ASSESSMENT = frozenset("mechanism measurement_validity investment_usefulness evidence_maturity".split())
DECISION_WORDS = frozenset(
    "weight allocation allocate exposure position sizing size order trade buy sell entry exit stop tilt sleeve overweight underweight recommendation action score rating target".split()
)
CHOICES = {
    "mechanism": {"pass", "rejected"}, "measurement_validity": {"H", "M", "L"}, "investment_usefulness": {"H", "M", "L"}, "evidence_maturity": {"H", "M", "L"},
    "maturity": {"production", "research", "rejected"}, "clock": {"daily", "weekly", "monthly", "structural"},
    "basis": {"expanding", "trailing_fixed", "full_sample"}, "status": {"intact", "under_test", "violated"},
}
# ------------------------------------------------------------------------------------------------------------------------
#: Schema of a record, for typed reads.
RECORD = (
    "spec_version string, signal string, as_of string, available_at string, supersedes string, clock string, assumption_monitored string, "
    "assumption_state struct<status: string, derivation: string>, "
    "reading struct<value: double, units: string, estimator: string, undefined_reason: string, context_band: string, secondary_readings: array<struct<name: string, value: double, units: string, estimator: string, undefined_reason: string>>>, "
    "rarity struct<level_percentile: double, basis: string, window: int, calibration: string, secondary_percentiles: array<struct<name: string, level_percentile: double, basis: string, window: int>>>, "
    "trend struct<level_percentile_change: double, lookback_observations: int, direction: string>, "
    "extreme_conditions struct<threshold_percentile: double, observations_at_or_above: int, share_of_history: double, most_recent_such_date: string, undefined_eras: string, episodes: struct<current_length: int, current_start: string, length_units: string, major_episode_definition: string, major_episode_median_max: array<int>>>, "
    "cross_signal_relationships array<string>, assessment struct<mechanism: string, measurement_validity: string, investment_usefulness: string, evidence_maturity: string>, maturity string"
)


# -- hashing -------------------------------------------------------------------------------------------------------------
def canonical(record: dict) -> bytes:
    """The bytes a record is hashed over: sorted keys, no blanks, no NaN."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def sha256_of_json(text: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text; null for null or unreadable texts and for NaN."""

    @F.pandas_udf("string")
    def digest(batch: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return hashlib.sha256(canonical(json.loads(t))).hexdigest()
            except (TypeError, ValueError):
                return None

        return batch.map(one)

    return digest(text)


# -- views ---------------------------------------------------------------------------------------------------------------
def current_view(log: DataFrame, series: Sequence[str], available: Column, line: str, columns: Sequence[str]) -> DataFrame:
    """Per series and ``as_of`` the record with the latest availability, of equals the later line. Reduced before it is shuffled."""
    best = F.max_by(F.struct(*columns, line), F.struct(available.alias("a"), F.col(line).alias("l")))
    return log.where(available.isNotNull()).groupBy(*series, "as_of").agg(best.alias("r")).select(*series, "as_of", "r.*")


def known_at(log: DataFrame, instant_micros: int, series: Sequence[str], available: Column, line: str, columns: Sequence[str]) -> DataFrame:
    """What a reader at the instant held: available by then, then the current view, then each series' latest ``as_of``."""
    view = current_view(log.where(available <= instant_micros), series, available, line, columns)
    rest = [c for c in view.columns if c not in [*series, "as_of"]]
    return view.groupBy(*series).agg(F.max("as_of").alias("as_of"), F.max_by(F.struct(*rest), "as_of").alias("r")).select(*series, "as_of", "r.*")


def vintage_grid(days: DataFrame, keys: Sequence[str], day: str, source: str) -> DataFrame:
    """The freshest day behind every publication instant of a source."""
    return days.withColumn("available_at", calendar.available_at(F.col(day), source)).groupBy(*keys, "available_at").agg(F.max(day).alias(day))


# -- the log ---------------------------------------------------------------------------------------------------------------
def split_append(log: DataFrame, fresh: DataFrame, key: Sequence[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): fresh keys the log lacks, and keys it holds with another digest. A conflict must stop the append."""
    held = log.select(*key, F.col(digest).alias("_held")).distinct()
    return fresh.join(held, list(key), "left_anti"), fresh.join(held, list(key)).where(F.col(digest) != F.col("_held"))


def corrections(view: DataFrame, rebuilt: DataFrame, key: Sequence[str], payload: str, digest: str, now: str) -> DataFrame:
    """Rebuilt records whose payload differs from the current view's: they become available now and name what they supersede."""
    old = view.select(*key, F.col(payload).alias("_old"), F.col(digest).alias("supersedes"))
    return rebuilt.join(old, list(key)).where(~F.col(payload).eqNullSafe(F.col("_old"))).drop("_old").withColumn("available_at", F.lit(now))


def audit(log: DataFrame, series: Sequence[str], available: Column, line: str, digest: str) -> DataFrame:
    """Problems of a log: series, ``problem``, ``n``. Repeated rows, keys with several digests, records available before the day they are about, unreadable instants, digests nothing supersedes."""
    one = log.dropDuplicates([*series, line])
    keyed = log.groupBy(*series, "as_of", available.alias("at")).agg(F.count_distinct(digest).alias("d"), F.count_distinct(line).alias("lines"))
    many = keyed.where("lines > 1").groupBy(*series).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("key_with_several_lines"))
    early = one.where(F.floor(available / 86_400_000_000) < F.unix_date(F.to_date("as_of"))).groupBy(*series).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("available_before_as_of"))
    known = one.select(*series, F.col(digest).alias("supersedes")).distinct()
    broken = one.where("supersedes is not null").join(known, [*series, "supersedes"], "left_anti").groupBy(*series).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("supersedes_unknown"))
    repeated = log.groupBy(*series).agg((F.count(F.lit(1)) - F.count_distinct(line)).alias("n")).where("n > 0").withColumn("problem", F.lit("repeated_line"))
    out = None
    for part in (many, early, broken, repeated):
        part = part.select(*series, "problem", "n")
        out = part if out is None else out.unionByName(part)
    return out


def derive_manifest(log: DataFrame, prior: DataFrame, key: Sequence[str], digest: str) -> DataFrame:
    """One row per key and digest of the log, with the provenance the prior manifest has for it, else ``reconstructed``."""
    rows = log.select(*key, digest, "spec_version").distinct()
    return rows.join(prior.select(*key, digest, "provenance"), [*key, digest], "left").withColumn("provenance", F.coalesce("provenance", F.lit("reconstructed")))


# -- building records ------------------------------------------------------------------------------------------------------
def descriptor_records(panel: DataFrame, series: str, day: str, value: str, percentile: str, threshold: float = 0.95, lookback: int = 12, edge: float = 0.05) -> DataFrame:
    """Everything a record says as of each row, from one pass of expanding windows over valid rows: level, percentile, change and direction, extremes so far."""
    a = w.Along(series, day)
    valid = panel.where(F.col(value).isNotNull() & F.col(percentile).isNotNull())
    p = F.col(percentile)
    hot = p >= threshold
    change = F.round(a.change(p, lookback), 9)
    return valid.select(
        series, F.col(day).alias("as_of"), F.col(value).alias("value"), p.alias("level_percentile"), w.band(p, *w.RECORD_BANDS).alias("context_band"),
        change.alias("level_percentile_change"), w.direction(change, edge).alias("direction"),
        a.count_true(hot).cast("long").alias("observations_at_or_above"), a.share_true(hot).alias("share_of_history"), a.last_true(hot).alias("most_recent_such_date"),
    )


def ledger(records: DataFrame, assumption: str, status: Column, columns: Sequence[str]) -> DataFrame:
    """Latest records grouped by the assumption they monitor: signals, evidence in order of signal, the status all agree on, and whether they disagree."""
    rows = records.withColumn("_status", status)
    return rows.groupBy(assumption).agg(
        F.sort_array(F.collect_set("signal")).alias("signals"), F.sort_array(F.collect_list(F.struct("signal", *columns))).alias("evidence"),
        F.when(F.count_distinct("_status") == 1, F.min("_status")).alias("status"), (F.count_distinct("_status") > 1).alias("conflict"),
    )


# -- the contract ------------------------------------------------------------------------------------------------------------
def _placeholder(v: object) -> bool:
    return isinstance(v, str) and re.fullmatch(r"<.*>", v, re.S) is not None


def _keys(v: object) -> Iterator[str]:
    if isinstance(v, dict):
        for k, x in v.items():
            yield k
            yield from _keys(x)
    elif isinstance(v, list):
        for x in v:
            yield from _keys(x)


def _filled(v: object) -> bool:
    return bool(str(v if v is not None else "").strip())


def _unit(v: object) -> bool:
    return v is None or _placeholder(v) or (isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1)


def _part(r: dict, name: str) -> dict:
    return r[name] if isinstance(r.get(name), dict) else {}


#: (name of the rule, test that holds for a good record). A rule looks at its own part only, so each is told on its own.
RULES: list[tuple[str, Callable[[dict], bool]]] = [
    ("decision_word", lambda r: not any(set(k.lower().split("_")) & DECISION_WORDS for k in _keys(r))),
    ("unknown_key", lambda r: set(r) <= TOP_LEVEL and set(_part(r, "assessment")) <= ASSESSMENT),
    ("missing_field", lambda r: set(r) >= REQUIRED),
    ("spec_version", lambda r: r.get("spec_version") == SPEC_VERSION or _placeholder(r.get("spec_version"))),
    ("signal_form", lambda r: not isinstance(r.get("signal"), str) or _placeholder(r["signal"]) or re.fullmatch(r"[a-z][a-z0-9_]*", r["signal"]) is not None),
    ("as_of_form", lambda r: not isinstance(r.get("as_of"), str) or _placeholder(r["as_of"]) or re.fullmatch(r"\d{4}-\d{2}-\d{2}", r["as_of"]) is not None),
    ("available_at_form", lambda r: not isinstance(r.get("available_at"), str) or _placeholder(r["available_at"]) or "T" in r["available_at"]),
    ("assumption_empty", lambda r: _filled(r.get("assumption_monitored"))),
    ("choice", lambda r: all(v in CHOICES[k] or _placeholder(v) for part in (r, _part(r, "assessment"), _part(r, "rarity"), _part(r, "assumption_state")) for k, v in part.items() if k in CHOICES)),
    ("reading_fields", lambda r: isinstance(r.get("reading"), dict) and {"value", "units", "estimator"} <= set(r["reading"]) and _filled(r["reading"].get("units"))),
    ("undefined_without_reason", lambda r: _part(r, "reading").get("value") is not None or "value" not in _part(r, "reading") or _filled(r["reading"].get("undefined_reason"))),
    ("secondary_fields", lambda r: all({"name", "value", "units", "estimator"} <= set(s) for s in _part(r, "reading").get("secondary_readings") or [])),
    ("rarity_fields", lambda r: isinstance(r.get("rarity"), dict) and {"level_percentile", "basis", "window"} <= set(r["rarity"])),
    ("percentile_bounds", lambda r: _unit(_part(r, "rarity").get("level_percentile")) and all(_unit(s.get("level_percentile")) for s in _part(r, "rarity").get("secondary_percentiles") or [])),
    ("window_rule", lambda r: (isinstance(_part(r, "rarity").get("window"), int) and r["rarity"]["window"] >= 1) if _part(r, "rarity").get("basis") == "trailing_fixed" else _part(r, "rarity").get("window") is None),
    ("leaking_production", lambda r: not (r.get("maturity") == "production" and (_part(r, "rarity").get("basis") == "full_sample" or _part(r, "assessment").get("mechanism") == "rejected"))),
    ("trend_horizon", lambda r: _part(r, "trend").get("level_percentile_change") is None or _part(r, "trend").get("lookback_observations") is not None),
    ("status_without_rule", lambda r: r.get("assumption_state") is None or (isinstance(r["assumption_state"], dict) and "status" in r["assumption_state"] and _filled(r["assumption_state"].get("derivation")))),
]


def json_schema() -> dict:
    """The contract as a JSON Schema, from the same constants the rules use; what only a rule can say is left to the rules."""
    text, some = {"type": "string"}, {"type": "string", "pattern": r"\S"}
    number, share = {"type": ["number", "null"]}, {"type": ["number", "null"], "minimum": 0, "maximum": 1}
    choice = lambda k: {"enum": sorted(CHOICES[k])}
    closed = lambda required, **fields: {"type": "object", "additionalProperties": False, "required": sorted(required), "properties": fields}
    or_null = lambda part: {"anyOf": [{"type": "null"}, part]}
    count, words, day = {"type": ["integer", "null"], "minimum": 0}, {"type": ["string", "null"]}, {"type": ["string", "null"], "pattern": r"^\d{4}-\d{2}-\d{2}$"}
    episodes = closed([], current_length=count, current_start=day, length_units={"type": ["string", "null"], "minLength": 1}, major_episode_definition=words, major_episode_median_max={"type": ["array", "null"], "items": {"type": "integer", "minimum": 0}, "minItems": 2, "maxItems": 2})
    leaf = {"value": number, "units": some, "estimator": text, "undefined_reason": {"type": ["string", "null"]}}
    parts = {
        "spec_version": {"const": SPEC_VERSION}, "signal": {"type": "string", "pattern": "^[a-z][a-z0-9_]*$"}, "as_of": {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"}, "available_at": {"type": "string", "pattern": "T"},
        "supersedes": {"type": ["string", "null"]}, "clock": choice("clock"), "assumption_monitored": some, "maturity": choice("maturity"),
        "assumption_state": {"anyOf": [{"type": "null"}, closed(["status", "derivation"], status=choice("status"), derivation=some)]},
        "reading": closed(["value", "units", "estimator"], **leaf, context_band=text, secondary_readings={"type": "array", "items": closed(["name", "value", "units", "estimator"], name=text, **leaf)}),
        "rarity": closed(["level_percentile", "basis", "window"], level_percentile=share, basis=choice("basis"), window={"type": ["integer", "null"], "minimum": 1}, calibration=words, secondary_percentiles={"type": "array"}),
        "trend": or_null(closed([], level_percentile_change=number, lookback_observations={"type": ["integer", "null"], "minimum": 1}, direction={"enum": ["rising", "falling", "flat", None]})),
        "extreme_conditions": or_null(closed([], threshold_percentile=share, observations_at_or_above=count, share_of_history=share, most_recent_such_date=day, undefined_eras=words, episodes=or_null(episodes))),
        "cross_signal_relationships": {"type": "array", "items": {"type": "string", "minLength": 1}},
        "assessment": closed(ASSESSMENT, **{k: choice(k) for k in sorted(ASSESSMENT)}),
    }
    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | closed(REQUIRED, **parts)


def violations(text: str | None) -> list[str]:
    """Names of the rules a record (as JSON text, so that unknown keys are seen) breaks."""
    try:
        record = json.loads(text)
    except (TypeError, ValueError):
        return ["not_json"]
    return [name for name, good in RULES if not good(record)] if isinstance(record, dict) else ["not_an_object"]


def validate(records: DataFrame, key: str, text: str) -> DataFrame:
    """Key and ``rule`` of every broken rule."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, v) for k, t in zip(b["key"], b["text"]) for v in violations(t)], columns=["key", "rule"])

    return records.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInPandas(run, f"key {kind}, rule string").withColumnRenamed("key", key)


# -- look-ahead guard --------------------------------------------------------------------------------------------------------
def look_ahead(build: Callable[[DataFrame], DataFrame], panel: DataFrame, keys: Sequence[str], order: str, inputs: Sequence[str], cut: object, seed: int = 0) -> DataFrame:
    """Rows up to the cut whose readings change when everything after the cut is replaced by noise: empty for a causal build.

    The noise is five deviations wide and follows from the row's key, so a repeated run sees the same.
    """
    scale = panel.agg(*[F.stddev_samp(c).alias(c) for c in inputs]).first()
    noise = lambda c: (F.pmod(F.xxhash64(F.lit(seed), F.lit(c), *keys, order), F.lit(2001)) / 1000.0 - 1) * 5 * float(scale[c] or 1.0)
    moved = panel.withColumns({c: F.when(F.col(order) > F.lit(cut), noise(c)).otherwise(F.col(c)) for c in inputs})
    a, b = (build(p).where(F.col(order) <= F.lit(cut)) for p in (panel, moved))
    # each build once: rows that don't come as often on one side as on the other
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    odd = both.groupBy(*a.columns).agg(F.sum("_side").alias("_side")).where("_side <> 0")
    return odd.withColumn("_side", F.explode(F.array_repeat(F.lit(1), F.abs("_side").cast("int")))).drop("_side")


# -- map of axes ---------------------------------------------------------------------------------------------------------
def axis_map(rows: DataFrame, axis: Sequence[str], order: str, percentile: str, status: str, tail: float = 0.05, lookback: int = 12) -> DataFrame:
    """How each axis stands in its own history, and how new that is; one row per axis, at its last reading.

    Standing: ``status``, ``percentile``, ``tail_mass`` (the share of history further out), ``inside`` (of the two-sided
    tail), ``spell_now`` (readings in a row inside, up to the last), against ``median_spell`` and ``longest_spell``.
    Novelty: ``since_status`` (readings with the present status), ``since_inside`` (readings since the last one inside, null
    if there was none), ``moved`` (change of the percentile over ``lookback`` readings, null in a shorter history). Novelty
    has no threshold. Rows without a percentile don't count; ``order`` is unique within an axis.
    """
    axis = list(axis)
    whole, along = Window.partitionBy(*axis), Window.partitionBy(*axis).orderBy("as_of")
    r = rows.where(F.col(percentile).isNotNull()).select(*axis, F.col(order).alias("as_of"), F.col(percentile).alias("p"), F.col(status).alias("s"))
    mass = F.least(F.col("p"), 1 - F.col("p"))
    r = r.withColumns({"f": mass <= tail, "i": F.row_number().over(along), "n": F.count(F.lit(1)).over(whole), "now": F.max_by("s", "as_of").over(whole)})
    # a run of readings inside the tail: those with as many readings outside before them
    r = r.withColumn("run", F.sum((~F.col("f")).cast("int")).over(along))
    spells = r.where("f").groupBy(*axis, "run").agg(F.count(F.lit(1)).alias("k")).groupBy(*axis).agg(F.percentile("k", F.lit(0.5)).alias("median_spell"), F.max("k").alias("longest_spell"))
    last = lambda test: F.max(F.when(test, F.col("i")))
    at = lambda c: F.max_by(c, "as_of")
    n = F.max("n")
    out = r.groupBy(*axis).agg(
        F.max("as_of").alias("as_of"), at("s").alias("status"), at("p").alias("percentile"), at("f").alias("inside"), n.alias("readings"),
        (n - F.coalesce(last(~F.col("f")), F.lit(0))).alias("spell_now"), (n - last(F.col("f"))).alias("since_inside"),
        (n - F.coalesce(last(~F.col("s").eqNullSafe(F.col("now"))), F.lit(0))).alias("since_status"),
        (at("p") - F.max(F.when(F.col("i") == F.col("n") - lookback, F.col("p")))).alias("moved"),
    )
    return out.withColumn("tail_mass", F.least(F.col("percentile"), 1 - F.col("percentile"))).join(spells, axis, "left")
