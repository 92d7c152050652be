"""DuckDB SQL for the queries of ``pipeline``, written from the statement of each problem, not from the operator."""

SQL: dict[str, str] = {}

SQL["p1_found"] = """
WITH r AS (
  SELECT DISTINCT series, snapshot_no, delivered_at, wayback_timestamp AS k,
         nullif(lower(trim(sha256)), '') AS h, rows,
         CASE WHEN trim(last_obs) = '' THEN NULL ELSE substr(replace(trim(last_obs), '-', ''), 1, 8) END AS d
  FROM vintage_manifest),
s AS (SELECT series, snapshot_no, max(delivered_at) AS delivered_at FROM r GROUP BY ALL),
p AS (SELECT *, lag(snapshot_no) OVER (PARTITION BY series ORDER BY snapshot_no) AS before FROM s),
c AS (SELECT r.* FROM r JOIN s USING (series, snapshot_no, delivered_at)),
now AS (SELECT p.series, p.snapshot_no, k, h, rows, d FROM p JOIN c USING (series, snapshot_no) WHERE before IS NOT NULL),
was AS (SELECT p.series, p.snapshot_no, k, h, rows, d FROM p JOIN c ON c.series = p.series AND c.snapshot_no = p.before)
SELECT coalesce(n.series, w.series) AS series, coalesce(n.snapshot_no, w.snapshot_no) AS snapshot_no, coalesce(n.k, w.k) AS wayback_timestamp,
       CASE WHEN w.series IS NULL THEN 'added' WHEN n.series IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM now n FULL JOIN was w ON n.series = w.series AND n.snapshot_no = w.snapshot_no AND n.k = w.k
WHERE w.series IS NULL OR n.series IS NULL OR n.h IS DISTINCT FROM w.h OR n.rows IS DISTINCT FROM w.rows OR n.d IS DISTINCT FROM w.d
"""

SQL["p2_found"] = """
WITH c AS (SELECT DISTINCT capture_id, region, signal, captured_at FROM vintage_capture WHERE captured_at IS NOT NULL),
o AS (SELECT DISTINCT record_id, region, signal, as_of, available_at::TIMESTAMPTZ AS a FROM observation_log)
SELECT capture_id, record_id FROM (
  SELECT c.capture_id, o.record_id, row_number() OVER (PARTITION BY c.capture_id ORDER BY o.as_of DESC, o.a DESC, o.record_id DESC) AS n
  FROM c JOIN o ON c.region = o.region AND c.signal = o.signal AND o.a <= c.captured_at)
WHERE n = 1
"""

_P3_CELLS = r"""
m AS (SELECT *, (loaded_at AT TIME ZONE 'UTC')::DATE AS loaded,
        CASE WHEN regexp_full_match("first", '\d{4}-\d{2}-\d{2}') THEN try_cast("first" AS DATE) END AS f,
        CASE WHEN regexp_full_match("last", '\d{4}-\d{2}-\d{2}') THEN try_cast("last" AS DATE) END AS l FROM panel_manifest),
v AS (
  SELECT load_id, 'sha256' AS c, sha256 AS t, NOT regexp_full_match(sha256, '[0-9a-f]{64}') AS bad, false AS odd, NULL::BIGINT AS x FROM m
  UNION ALL SELECT load_id, 'bytes', bytes::VARCHAR, false, bytes < 1, bytes FROM m
  UNION ALL SELECT load_id, 'rows', rows::VARCHAR, false, rows < 1, rows FROM m
  UNION ALL SELECT load_id, 'first', "first", f IS NULL, f < DATE '1800-01-01', f - DATE '0001-01-01' FROM m
  UNION ALL SELECT load_id, 'last', "last", l IS NULL, l > loaded, l - DATE '0001-01-01' FROM m
  UNION ALL SELECT load_id, 'column_spans', column_spans, NOT regexp_full_match(column_spans, '[^:;]+:(\d{4}-\d{2}-\d{2}\.\.\d{4}-\d{2}-\d{2}|EMPTY)(;[^:;]+:(\d{4}-\d{2}-\d{2}\.\.\d{4}-\d{2}-\d{2}|EMPTY))*'), false,
                   length(column_spans) - length(replace(column_spans, ';', '')) + 1 FROM m),
k AS (SELECT load_id, c, t, x, t IS NULL AS nil, t IS NOT NULL AND bad AS bad, t IS NOT NULL AND NOT bad AND odd AS odd FROM v),
p AS (SELECT load_id, c, count(*) AS n, count(*) FILTER (nil) AS nulls, count(*) FILTER (bad) AS malformed, count(*) FILTER (odd) AS impossible,
        count(DISTINCT t) AS d, median(x::DOUBLE) FILTER (NOT nil AND NOT bad AND NOT odd) AS med,
        min(x) FILTER (NOT nil AND NOT bad AND NOT odd) AS lo, max(x) FILTER (NOT nil AND NOT bad AND NOT odd) AS hi FROM k GROUP BY ALL)
"""

SQL["p3_found"] = (
    "WITH "
    + _P3_CELLS
    + """,
q AS (SELECT *, nulls / n AS ns, malformed / nullif(n - nulls, 0) AS ms, impossible / nullif(n - nulls, 0) AS os, d / nullif(n - nulls, 0) AS ds FROM p),
y AS (SELECT c, median(ns) AS tn, median(ds) AS td, median(med) AS tm FROM q GROUP BY c),
z AS (SELECT * FROM q JOIN y USING (c))
SELECT load_id, c AS column_name, 'nulls' AS issue FROM z WHERE ns > tn + 0.10
UNION ALL SELECT load_id, c, 'pattern' FROM z WHERE ms > 0.05
UNION ALL SELECT load_id, c, 'range' FROM z WHERE os > 0.05
UNION ALL SELECT load_id, c, 'distinct' FROM z WHERE ds < td * 0.5 AND c IN ('sha256', 'bytes', 'rows')
UNION ALL SELECT load_id, c, 'shift' FROM z WHERE CASE WHEN c IN ('first', 'last') THEN abs(med - tm) > 1095 ELSE med > 1.5 * tm OR med < tm / 1.5 END
"""
)

SQL["p3_profile"] = (
    "WITH "
    + _P3_CELLS
    + """,
e AS (SELECT load_id, c, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS entropy FROM (SELECT load_id, c, t, count(*) AS m FROM k WHERE NOT nil GROUP BY ALL) GROUP BY ALL)
SELECT load_id, c AS column_name, n AS rows, nulls, malformed, impossible, d AS "distinct", lo AS lowest, hi AS highest, med AS median, round(entropy, 6) AS entropy
FROM p LEFT JOIN e USING (load_id, c)
"""
)

_READ = """
r AS (SELECT source_id, date, max(CASE WHEN NOT isnan(mkt_ret) THEN mkt_ret END) AS mkt_ret, max(CASE WHEN NOT isnan(bond10_ret) THEN bond10_ret END) AS bond10_ret
      FROM assets_daily GROUP BY ALL),
x AS (SELECT source_id, date, 'mkt_ret' AS field, mkt_ret AS v FROM r WHERE mkt_ret IS NOT NULL
      UNION ALL SELECT source_id, date, 'bond10_ret', bond10_ret FROM r WHERE bond10_ret IS NOT NULL)
"""


def _round(k: int) -> str:
    """One repetition of the phase-space test: ``t{k}`` from ``t{k - 1}``. Differences to the nearest readings not out, scales from these; medians in the first round, fourth moments after it."""
    o = "OVER (PARTITION BY source_id, field ORDER BY date ROWS BETWEEN"
    scale = (lambda c: f"median(abs({c})) FILTER (NOT out) / 0.6745") if k == 1 else (lambda c: f"pow(avg(pow({c}, 4)) FILTER (NOT out) / 3, 0.25)")
    return f"""
b{k} AS (SELECT source_id, field, date, v, out, last_value(CASE WHEN NOT out THEN v END IGNORE NULLS) {o} UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(CASE WHEN NOT out THEN v END IGNORE NULLS) {o} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM t{k - 1}),
m{k} AS (SELECT source_id, field, median(v) FILTER (NOT out) AS m, sqrt(2 * ln(count(*))) AS reach FROM t{k - 1} GROUP BY ALL),
c{k} AS (SELECT *, v - m AS u, coalesce((a - b) / 2, 0) AS d1, coalesce(a - 2 * v + b, 0) AS d2 FROM b{k} JOIN m{k} USING (source_id, field)),
s{k} AS (SELECT source_id, field, {scale('u')} AS su, {scale('d1')} AS s1, {scale('d2')} AS s2 FROM c{k} GROUP BY ALL),
t{k} AS (SELECT source_id, field, date, v, coalesce(pow(u / nullif(su, 0), 2) + coalesce(pow(d1 / nullif(s1, 0), 2), 0) + coalesce(pow(d2 / nullif(s2, 0), 2), 0) > pow(2.8 * reach, 2), false) AS out FROM c{k} JOIN s{k} USING (source_id, field))"""


# a spike lies outside the ellipsoid over value, first and second difference; four rounds, of which the sources here need two
_FLAGS = (
    "WITH "
    + _READ
    + """,
g AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, field ORDER BY date) AS run
      FROM (SELECT *, lag(v) OVER (PARTITION BY source_id, field ORDER BY date) AS before FROM x)),
h AS (SELECT *, count(*) OVER (PARTITION BY source_id, field, run) AS len FROM g),
t0 AS (SELECT source_id, field, date, v, false AS out FROM x WHERE v > -1),"""
    + ",".join(_round(k) for k in (1, 2, 3, 4))
    + """,
f AS (SELECT h.source_id, h.date, h.field, h.v AS value, coalesce(t4.out, false) AS spike, len >= 6 AS stuck, h.v <= -1 AS impossible
      FROM h LEFT JOIN t4 USING (source_id, field, date))
"""
)
SQL["p4_flags"] = _FLAGS + "SELECT source_id, field, date, value, spike, stuck, impossible FROM f"
SQL["p4_found"] = _FLAGS + "SELECT source_id, strftime(date, '%Y-%m-%d') AS obs_date, field FROM f WHERE spike OR stuck OR impossible"

_LATE = """
WITH o AS (SELECT DISTINCT record_id, region, signal, as_of::DATE AS day, date_trunc('month', as_of::DATE)::DATE AS w, available_at::TIMESTAMPTZ AT TIME ZONE 'UTC' AS a, reading.value AS v FROM observation_log),
t AS (SELECT *, w::TIMESTAMP + INTERVAL 1 MONTH + INTERVAL 45 DAY AS closed, w::TIMESTAMP + INTERVAL 1 MONTH + INTERVAL 180 DAY AS cut FROM o)
"""
_LATE_AGG = (
    _LATE
    + """,
c AS (SELECT region, signal, w, count(v) AS n, sum(v) AS s FROM (SELECT *, row_number() OVER (PARTITION BY region, signal, day ORDER BY a DESC, record_id DESC) AS i FROM t WHERE a <= closed) WHERE i = 1 GROUP BY ALL),
f AS (SELECT region, signal, w, count(v) AS n, sum(v) AS s FROM (SELECT *, row_number() OVER (PARTITION BY region, signal, day ORDER BY a DESC, record_id DESC) AS i FROM t WHERE a <= cut) WHERE i = 1 GROUP BY ALL),
u AS (SELECT k.region, k.signal, strftime(k.w, '%Y-%m') AS period, coalesce(c.n, 0) AS count_closed, round(coalesce(c.s, 0), 4) AS sum_closed, coalesce(f.n, 0) AS count_final, round(coalesce(f.s, 0), 4) AS sum_final
      FROM (SELECT DISTINCT region, signal, w FROM o) k LEFT JOIN f USING (region, signal, w) LEFT JOIN c USING (region, signal, w))
"""
)
SQL["p5_aggregates"] = _LATE_AGG + "SELECT *, count_closed <> count_final OR sum_closed <> sum_final AS corrected FROM u"
SQL["p5_found"] = _LATE_AGG + "SELECT region, signal, period FROM u WHERE count_closed <> count_final OR sum_closed <> sum_final"
SQL["p5_dropped"] = _LATE + "SELECT DISTINCT record_id, region, signal, strftime(w, '%Y-%m') AS period, ceil(epoch(a - cut) / 86400)::INT AS days_late FROM t WHERE a > cut"

SQL["p6_found"] = """
WITH d AS (SELECT DISTINCT source_id, date FROM assets_daily WHERE mkt_ret IS NOT NULL AND NOT isnan(mkt_ret)),
s AS (SELECT source_id, min(date) AS a, max(date) AS b FROM d GROUP BY ALL),
g AS (SELECT source_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM s),
m AS (SELECT source_id, 'jp_bond10_ret' AS field, date_trunc('month', date)::DATE AS mo FROM intl_bonds_monthly WHERE jp_bond10_ret IS NOT NULL AND NOT isnan(jp_bond10_ret)
      UNION SELECT source_id, 'de_bond10_ret', date_trunc('month', date)::DATE FROM intl_bonds_monthly WHERE de_bond10_ret IS NOT NULL AND NOT isnan(de_bond10_ret)),
ms AS (SELECT source_id, field, min(mo) AS a, max(mo) AS b FROM m GROUP BY ALL),
mg AS (SELECT source_id, field, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS mo FROM ms)
SELECT source_id, 'mkt_ret' AS field, strftime(date, '%Y-%m-%d') AS period FROM g WHERE isodow(date) <= 5 AND (source_id, date) NOT IN (SELECT (source_id, date) FROM d)
UNION ALL
SELECT mg.source_id, mg.field, strftime(mg.mo, '%Y-%m') FROM mg LEFT JOIN m USING (source_id, field, mo) WHERE m.mo IS NULL
"""


def _edge_sql(h0: str, h1: str, s0: str, s1: str) -> str:
    """Three-point slope at an end, held to the shape; the secant where there is no second interval."""
    d = f"(((2 * {h0} + {h1}) * {s0} - {h0} * {s1}) / ({h0} + {h1}))"
    return f"CASE WHEN {h1} IS NULL THEN {s0} WHEN sign({d}) <> sign({s0}) THEN 0 WHEN sign({s0}) <> sign({s1}) AND abs({d}) > 3 * abs({s0}) THEN 3 * {s0} ELSE {d} END"


def _inner_sql(h0: str, h1: str, s0: str, s1: str) -> str:
    return f"CASE WHEN {s0} * {s1} <= 0 THEN 0 ELSE 3 * ({h0} + {h1}) / ((2 * {h1} + {h0}) / {s0} + ({h1} + 2 * {h0}) / {s1}) END"


# positions are weekdays or months counted on; a weekend day lies between Friday and Monday
SQL["p6_grid"] = f"""
WITH d AS (SELECT source_id, date, max(mkt_ret) AS v FROM assets_daily WHERE mkt_ret IS NOT NULL AND NOT isnan(mkt_ret) GROUP BY ALL),
w AS (SELECT source_id, date, v, (date - DATE '1969-12-29')::BIGINT AS n FROM d),
dp AS (SELECT source_id, 'mkt_ret' AS field, n // 7 * 5 + least(n % 7, 4) + CASE WHEN n % 7 > 4 THEN 0.5 ELSE 0 END AS p, max_by(v, date) AS v, 5 AS fill FROM w GROUP BY ALL),
b AS (SELECT source_id, 'jp_bond10_ret' AS field, date, jp_bond10_ret AS v FROM intl_bonds_monthly UNION ALL SELECT source_id, 'de_bond10_ret', date, de_bond10_ret FROM intl_bonds_monthly),
mp AS (SELECT source_id, field, year(date) * 12 + month(date) - 1 AS p, max(struct_pack(d := date, v := v)).v AS v, 3 AS fill FROM b WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL),
r AS (SELECT source_id, field, p::DOUBLE AS p, v, fill FROM dp UNION ALL SELECT source_id, field, p::DOUBLE, v, fill FROM mp),
x AS (SELECT *, lag(p) OVER o AS pb, lag(v) OVER o AS vb, lead(p) OVER o AS pa, lead(v) OVER o AS va, lead(p, 2) OVER o AS pc, lead(v, 2) OVER o AS vc FROM r WINDOW o AS (PARTITION BY source_id, field ORDER BY p)),
h AS (SELECT *, pa - p AS h, (va - v) / (pa - p) AS s, ceil(pa) - floor(p) - 1 > fill AS gap, CASE WHEN ceil(p) - floor(pb) - 1 <= fill THEN p - pb END AS hb, CASE WHEN ceil(pc) - floor(pa) - 1 <= fill THEN pc - pa END AS hc FROM x),
s AS (SELECT *, (v - vb) / hb AS sb, (vc - va) / hc AS sc FROM h),
k AS (SELECT *, CASE WHEN hb IS NOT NULL THEN {_inner_sql('hb', 'h', 'sb', 's')} ELSE {_edge_sql('h', 'hc', 's', 'sc')} END AS d0, CASE WHEN hc IS NOT NULL THEN {_inner_sql('h', 'hc', 's', 'sc')} ELSE {_edge_sql('h', 'hb', 's', 'sb')} END AS d1 FROM s),
g AS (SELECT *, unnest(generate_series(ceil(p)::BIGINT, CASE WHEN pa IS NULL THEN floor(p) ELSE ceil(pa) - 1 END::BIGINT)) AS q FROM k),
t AS (SELECT *, (q - p) / h AS t FROM g),
y AS (SELECT source_id, field, q, CASE WHEN q = p THEN 'observed' WHEN gap THEN 'gap' ELSE 'filled' END AS status,
        CASE WHEN q = p THEN v WHEN NOT gap THEN (1 + 2 * t) * (1 - t) ** 2 * v + t * (1 - t) ** 2 * h * d0 + t * t * (3 - 2 * t) * va + t * t * (t - 1) * h * d1 END AS value FROM t)
SELECT source_id, field, CASE WHEN field = 'mkt_ret' THEN strftime(DATE '1969-12-29' + (q // 5 * 7 + q % 5)::INT, '%Y-%m-%d') ELSE strftime(make_date(q // 12, q % 12 + 1, 1), '%Y-%m') END AS period,
       round(value, 9) + 0.0 AS value, status FROM y
"""
