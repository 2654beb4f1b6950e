"""The SQL that each query must equal, for an engine with ANSI windows and aggregates (DuckDB's dialect)."""

from __future__ import annotations

from ..sources.driver_tables import AS_OF, AS_OF_LONG, SQL

A, L = f"DATE '{AS_OF}'", f"DATE '{AS_OF_LONG}'"
START = "DATE '2000-06-01'"
OBS = "(PARTITION BY series_id ORDER BY date)"
MONTHS = "(SELECT unnest(range(1, 13)) AS month)"
STATUS = "CASE WHEN {first} > {a} THEN 'after_cutoff' WHEN last_day({first}) > {a} THEN 'month_in_progress' ELSE 'month_ended' END"
ORACLES: dict[str, str] = {}


def q(name: str, body: str, *views: str, **ctes: str) -> None:
    """Registers a query over driver views; v stands for the first view up to the cutoff."""
    parts = [f"{v} AS ({SQL[v]})" for v in views]
    if views and "v" not in ctes and " v" in body + " ".join(ctes.values()):
        cut = L if views[0] == "long_prices" else A
        parts.append(f"v AS (SELECT * FROM {views[0]} WHERE date <= {cut})")
    parts += [f"{k} AS ({c})" for k, c in ctes.items()]
    ORACLES[name] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


def r(x: str, digits: int = 4) -> str:
    return f"round({x}, {digits}) + 0.0"


def pct(end: str, start: str) -> str:
    return f"CASE WHEN {end} > 0 AND {start} > 0 THEN ({end} / {start} - 1) * 100 END"


MEANS = "SELECT series_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, avg(value) AS mean, count(*) AS n, arg_max(value, date) AS last FROM v GROUP BY 1, 2, 3"
GRID12 = "SELECT DISTINCT series_id, CAST(month AS INTEGER) AS month FROM {view}, " + MONTHS


def first_of(year: str, month: str) -> str:
    return f"make_date(CAST({year} AS INTEGER), CAST({month} AS INTEGER), 1)"


def status(year: str, month: str, a: str = A) -> str:
    return STATUS.format(first=first_of(year, month), a=a)


# monthly and seasonal
q("monthly_means", f"SELECT series_id, year, month, {r('mean')} AS mean, n, {r('last')} AS last FROM m", "prices", m=MEANS)
q("monthly_grid", f"SELECT g.series_id, g.year, g.month, {r('m.mean')} AS mean, coalesce(m.n, 0) AS n FROM g LEFT JOIN m USING (series_id, year, month)", "gappy_prices", m=MEANS, s="SELECT series_id, min(year) AS a, max(year) AS b FROM m GROUP BY 1", g="SELECT series_id, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month FROM (SELECT series_id, unnest(range(a, b + 1)) AS year FROM s), (SELECT unnest(range(1, 13)) AS month)")
PROFILE = "SELECT g.series_id, g.month, avg(m.mean) AS mean, min(m.mean) AS minimum, max(m.mean) AS maximum, count(m.mean) AS year_count, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS observation_count FROM g LEFT JOIN m ON g.series_id = m.series_id AND g.month = m.month AND m.year BETWEEN {a} AND {b} GROUP BY 1, 2"
_profile = f"SELECT series_id, month, {r('mean')} AS mean, {r('minimum')} AS minimum, {r('maximum')} AS maximum, year_count, observation_count FROM p"
q("seasonal_profile", _profile, "prices", m=MEANS, g=GRID12.format(view="prices"), p=PROFILE.format(a=1991, b=2000))
q("seasonal_current", f"SELECT p.series_id, p.month, {r('c.mean')} AS mean, coalesce(c.n, 0) AS observation_count, {r('c.mean - p.mean')} AS difference, {status('2001', 'p.month')} AS calendar_status FROM p LEFT JOIN m c ON p.series_id = c.series_id AND p.month = c.month AND c.year = 2001", "prices", m=MEANS, g=GRID12.format(view="prices"), p=PROFILE.format(a=1996, b=2000))
q("seasonal_distribution", f"SELECT g.series_id, g.month, {r('avg(m.mean)')} AS mean, {r('quantile_cont(m.mean, 0.5)')} AS median, {r('quantile_cont(m.mean, 0.25)')} AS q25, {r('quantile_cont(m.mean, 0.75)')} AS q75, count(m.mean) AS year_count, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS observation_count FROM g LEFT JOIN m ON g.series_id = m.series_id AND g.month = m.month AND m.year BETWEEN 1991 AND 2000 GROUP BY 1, 2", "prices", m=MEANS, g=GRID12.format(view="prices"))
q("year_bases", f"SELECT series_id, CAST(year(date) AS INTEGER) AS year, min(date) AS base_date, {r('arg_min(value, date)')} AS base_value FROM v GROUP BY 1, 2", "prices")
q("normalized_profile", _profile, "prices", v=f"SELECT series_id, date, value / first_value(value) OVER (PARTITION BY series_id, year(date) ORDER BY date) * 100 AS value FROM prices WHERE date <= {A}", m=MEANS, g=GRID12.format(view="prices"), p=PROFILE.format(a=1996, b=2000))
_partial = {"y": "SELECT series_id, CAST(year(date) AS INTEGER) AS year, avg(value) AS mean, count(*) AS n FROM v WHERE month(date) = 5 AND day(date) <= 17 AND year(date) >= 1996 GROUP BY 1, 2", "g": "SELECT DISTINCT series_id, CAST(year AS INTEGER) AS year FROM prices, (SELECT unnest(range(1996, 2002)) AS year)"}
q("partial_month_years", f"SELECT g.series_id, g.year, make_date(g.year, 5, 17) AS through_date, {r('y.mean')} AS mean, coalesce(y.n, 0) AS observation_count FROM g LEFT JOIN y USING (series_id, year)", "prices", **_partial)
q("partial_month_summary", f"""SELECT series_id, {r('base')} AS baseline_mean, {r('lo')} AS minimum, {r('hi')} AS maximum, years AS year_count, CAST(n AS BIGINT) AS baseline_observations, {r('now')} AS current_mean, now_n AS current_observations, {r('now - base')} AS difference FROM (
SELECT g.series_id, avg(y.mean) FILTER (WHERE g.year < 2001) AS base, min(y.mean) FILTER (WHERE g.year < 2001) AS lo, max(y.mean) FILTER (WHERE g.year < 2001) AS hi, count(y.mean) FILTER (WHERE g.year < 2001) AS years, coalesce(sum(y.n) FILTER (WHERE g.year < 2001), 0) AS n, max(y.mean) FILTER (WHERE g.year = 2001) AS now, coalesce(max(y.n) FILTER (WHERE g.year = 2001), 0) AS now_n FROM g LEFT JOIN y USING (series_id, year) GROUP BY 1)""", "prices", **_partial)
q("recent_years", "SELECT g.series_id, g.month, " + ", ".join(r(f"max(m.mean) FILTER (WHERE m.year = {1997 + k})") + f" AS y{k}" for k in range(5)) + " FROM g LEFT JOIN m USING (series_id, month) GROUP BY 1, 2", "prices", m=MEANS, g=GRID12.format(view="prices"))
q("recent_year_mean", f"SELECT g.series_id, g.month, {r('avg(m.mean)')} AS mean, count(m.mean) AS year_count, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS observation_count FROM g LEFT JOIN m ON g.series_id = m.series_id AND g.month = m.month AND m.year BETWEEN 1997 AND 2001 GROUP BY 1, 2", "prices", m=MEANS, g=GRID12.format(view="prices"))
q("price_matrix", f"""SELECT g.series_id, g.year, g.month, {r('m.mean')} AS mean,
CASE WHEN m.mean IS NULL THEN CASE WHEN {first_of('g.year', 'g.month')} > {A} THEN 'future' ELSE 'missing' END WHEN m.mean < e.ref THEN 'lower' WHEN m.mean > e.ref THEN 'higher' ELSE 'equal' END AS side,
m.mean IS NOT NULL AND {status('g.year', 'g.month')} = 'month_in_progress' AS partial
FROM g LEFT JOIN m USING (series_id, year, month) LEFT JOIN e USING (series_id)""", "gappy_prices", m=MEANS, e="SELECT series_id, arg_max(value, date) AS ref FROM v GROUP BY 1", g="SELECT DISTINCT series_id, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month FROM gappy_prices, (SELECT unnest(range(1992, 2002)) AS year), (SELECT unnest(range(1, 13)) AS month)")
RETURNS = {
    "c": "SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month_start, arg_max(value, date) AS close, max(date) AS close_date FROM v GROUP BY 1, 2",
    "g": f"SELECT series_id, CAST(unnest(generate_series(a, CAST(date_trunc('month', {A}) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM (SELECT series_id, min(month_start) AS a FROM c GROUP BY 1)",
    "t": "SELECT series_id, month_start, close_date, close, lag(close) OVER (PARTITION BY series_id ORDER BY month_start) AS before FROM g LEFT JOIN c USING (series_id, month_start)",
}
q("monthly_returns", f"SELECT series_id, month_start, close_date, {r('close', 6)} AS close, {r(pct('close', 'before'), 6)} AS return_pct, {status('year(month_start)', 'month(month_start)')} AS calendar_status FROM t", "gappy_prices", **RETURNS)
q("return_heatmap", "SELECT series_id, CAST(year(month_start) AS INTEGER) AS year, " + ", ".join(r(f"max({pct('close', 'before')}) FILTER (WHERE month(month_start) = {m})", 6) + f" AS m{m:02d}" for m in range(1, 13)) + " FROM t GROUP BY 1, 2", "gappy_prices", **RETURNS)
q("coverage", f"SELECT series_id, first_date, last_date, n AS observation_count, CAST(datediff('day', last_date, {A}) AS INTEGER) AS age_days, CAST(datediff('month', first_date, last_date) + 1 - months AS BIGINT) AS missing_months FROM (SELECT series_id, min(date) AS first_date, max(date) AS last_date, count(*) AS n, count(DISTINCT date_trunc('month', date)) AS months FROM v GROUP BY 1)", "gappy_prices")


# windows
def frame(n: int, by: str = "series_id") -> str:
    return f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sma(n: int) -> str:
    return f"CASE WHEN row_number() OVER {OBS} >= {n} THEN avg(value) OVER {frame(n)} END"


TECH = f"SELECT series_id, date, value, {sma(20)} AS sma20, {sma(100)} AS sma100, {sma(200)} AS sma200, CASE WHEN row_number() OVER {OBS} >= 20 THEN stddev_pop(value) OVER {frame(20)} END AS sd FROM v"
_tech = f"SELECT series_id, date, {r('value')} AS value, {r('sma20')} AS sma20, {r('sma100')} AS sma100, {r('sma200')} AS sma200, {r('sma20 + 2 * sd')} AS upper, {r('sma20 - 2 * sd')} AS lower FROM t"
q("technical", _tech, "prices", t=TECH)
q("display_range", _tech + f" WHERE date >= {A} - 90", "prices", t=TECH)
q("bollinger_exact", f"SELECT series_id, date, {r('sma20')} AS middle, {r('sd')} AS deviation, {r('sma20 + 2 * sd')} AS upper, {r('sma20 - 2 * sd')} AS lower FROM t", "prices", t=TECH)
q("moving_averages", f"SELECT series_id, date, {r('value')} AS value, {r(sma(20))} AS sma20, {r(sma(50))} AS sma50 FROM v", "prices")
_lc = f"SELECT series_id, date, CASE WHEN value > 0 AND lag(value) OVER {OBS} > 0 THEN ln(value) - ln(lag(value) OVER {OBS}) END AS lc FROM v"
q("volatility", "SELECT series_id, date, " + ", ".join(r(f"CASE WHEN count(lc) OVER {frame(n)} = {n} THEN stddev_samp(lc) OVER {frame(n)} * 100 END", 6) + f" AS volatility{n}" for n in (20, 60)) + " FROM c", "prices", c=_lc)
RSI = {
    "d": f"SELECT series_id, date, row_number() OVER {OBS} AS k, value - lag(value) OVER {OBS} AS x FROM v",
    "w": """SELECT series_id, CAST(15 AS BIGINT) AS k, sum(greatest(x, 0) / 14) AS g, sum(greatest(-x, 0) / 14) AS l FROM d WHERE k BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14
UNION ALL SELECT d.series_id, d.k, w.g * (13 / CAST(14 AS DOUBLE)) + greatest(d.x, 0) / 14, w.l * (13 / CAST(14 AS DOUBLE)) + greatest(-d.x, 0) / 14 FROM w JOIN d ON d.series_id = w.series_id AND d.k = w.k + 1""",
}
_rsi = "CASE WHEN w.g IS NULL THEN NULL WHEN greatest(w.g, w.l) = 0 THEN 50 ELSE 100 * w.g / (w.g + w.l) END"
q("rsi14", f"SELECT d.series_id, d.date, {r(_rsi, 6)} AS rsi14 FROM d LEFT JOIN w ON d.series_id = w.series_id AND d.k = w.k", "prices", **RSI)
q("rsi_last", f"SELECT d.series_id, d.date, {r(_rsi, 6)} AS rsi14 FROM d LEFT JOIN w ON d.series_id = w.series_id AND d.k = w.k WHERE d.k = (SELECT max(k) FROM d e WHERE e.series_id = d.series_id)", "prices", **RSI)


def changes(h: int) -> str:
    before = f"lag(value, {h}) OVER {OBS}"
    return f"SELECT * FROM (SELECT series_id, lag(date, {h}) OVER {OBS} AS start_date, date AS end_date, {pct('value', before)} AS change FROM v) WHERE start_date IS NOT NULL"


q("interval_changes", f"SELECT series_id, start_date, end_date, {r('change', 6)} AS change FROM i", "signed_prices", i=changes(5))
q("interval_counts", "SELECT series_id, count(*) AS candidate_intervals, count(change) AS valid_intervals, count(*) - count(change) AS nonpositive_endpoints FROM i GROUP BY 1", "signed_prices", i=changes(5))
q("indicator_availability", "SELECT series_id, n AS observation_count, n >= 20 AS has_sma20, n >= 100 AS has_sma100, n >= 200 AS has_sma200, CASE WHEN n < 20 THEN 'SMA20 and bands need 20 observations' WHEN n < 100 THEN 'SMA100 needs 100 observations' WHEN n < 200 THEN 'SMA200 needs 200 observations' ELSE 'all indicators are available' END AS message FROM (SELECT series_id, count(*) AS n FROM v GROUP BY 1)", "prices")


def position(span: str, start: str) -> str:
    return f"SELECT v.series_id, '{span}' AS span, {start} AS start_date, {r('min(value)', 6)} AS minimum, {r('max(value)', 6)} AS maximum, {r('100 * (count(*) FILTER (WHERE value < latest) + 0.5 * count(*) FILTER (WHERE value = latest)) / CAST(count(*) AS DOUBLE)', 6)} AS percentile, count(*) AS observation_count FROM v JOIN e USING (series_id) WHERE date >= {start} GROUP BY 1"


LATEST = "SELECT series_id, arg_max(value, date) AS latest, max(date) AS last_date, count(*) AS n FROM v GROUP BY 1"
_position = position("one_year", "DATE '2000-05-17'") + " UNION ALL " + position("five_year", "DATE '1996-05-17'")
q("level_position", _position, "prices", e=LATEST)
REFS = {"previous": ("k > 1", "CAST(NULL AS DATE)"), "month": ("date <= DATE '2001-04-17'", "DATE '2001-04-17'"), "quarter": ("date <= DATE '2001-02-17'", "DATE '2001-02-17'"), "ytd": ("date <= DATE '2000-12-31'", "DATE '2000-12-31'")}
K = "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM v"
SNAP = " UNION ALL ".join(f"SELECT e.series_id, '{k}' AS reference, {t} AS target_date, max(s.date) AS reference_date, arg_max(s.value, s.date) AS ref, any_value(e.latest) AS latest FROM e LEFT JOIN s ON e.series_id = s.series_id AND s.{c} GROUP BY 1" for k, (c, t) in REFS.items())
q("snapshot_changes", f"SELECT series_id, reference, target_date, reference_date, {r('ref', 6)} AS reference_value, {r('latest - ref', 6)} AS change, {r(pct('latest', 'ref'), 6)} AS change_pct FROM x", "prices", e=LATEST, s=K, x=SNAP)
q("market_snapshot", f"SELECT e.series_id, e.last_date, {r('e.latest', 6)} AS last_value, {r('t.sma200', 6)} AS sma200, e.n AS observation_count, " + ", ".join(f"(SELECT {r(pct('x.latest', 'x.ref'), 6)} FROM x WHERE x.series_id = e.series_id AND x.reference = '{k}') AS {k}_pct" for k in REFS) + ", " + ", ".join(f"(SELECT percentile FROM p WHERE p.series_id = e.series_id AND p.span = '{k}') AS {k}_percentile" for k in ("one_year", "five_year")) + f", {r(pct('e.latest', 't.sma200'), 6)} AS distance_sma200_pct FROM e JOIN t ON t.series_id = e.series_id AND t.date = e.last_date", "prices", e=LATEST, s=K, x=SNAP, p=_position, t=TECH)

# joins
FX = f"SELECT date, value AS rate FROM fx WHERE date <= {A}"
JOINT = "SELECT v.series_id, v.date, v.value, f.rate FROM v JOIN f USING (date)"
q("fx_convert", f"SELECT series_id, date, {r('value * rate')} AS value FROM j", "prices", "fx", f=FX, j=JOINT)
q("fx_convert_positive", f"SELECT series_id, date, {r('value * rate')} AS value FROM j WHERE value > 0", "signed_prices", "fx", f=FX, j=JOINT)
q("fx_convert_counts", f"SELECT p.series_id, count(f.rate) FILTER (WHERE p.date <= {A}) AS matched, count(*) FILTER (WHERE p.date <= {A} AND f.rate IS NULL) AS unmatched_price_observations, (SELECT count(*) FROM f) - count(f.rate) FILTER (WHERE p.date <= {A}) AS unmatched_fx_observations, count(*) FILTER (WHERE p.date > {A}) AS excluded_future_price_observations, (SELECT count(*) FROM fx WHERE date > {A}) AS excluded_future_fx_observations FROM prices p LEFT JOIN f USING (date) GROUP BY 1", "prices", "fx", f=FX)
q("spread", f"SELECT date, {r('a.value - b.value')} AS value FROM (SELECT * FROM v WHERE series_id = '1-URGENT') a JOIN (SELECT * FROM v WHERE series_id = '2-HIGH') b USING (date)", "prices")
q("indexed_comparison", f"SELECT series_id, date, first_value(date) OVER {OBS} AS base_date, {r(f'CASE WHEN min(value) OVER (PARTITION BY series_id) > 0 THEN value / first_value(value) OVER {OBS} * 100 END', 6)} AS value FROM s", "gappy_prices", s=f"SELECT * FROM v WHERE date >= {START} AND date IN (SELECT date FROM v WHERE date >= {START} GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT series_id) FROM gappy_prices))")
PAIRS = {
    "rr": f"SELECT * FROM (SELECT series_id, lag(date) OVER {OBS} AS start_date, date, {pct('value', f'lag(value) OVER {OBS}')} AS p FROM v) WHERE p IS NOT NULL",
    "m": "SELECT a.series_id AS left_id, b.series_id AS right_id, a.start_date, a.date, a.p AS x, b.p AS y FROM rr a JOIN rr b ON a.start_date = b.start_date AND a.date = b.date AND a.series_id < b.series_id",
}
q("matched_intervals", f"SELECT left_id, right_id, start_date, date, {r('x', 6)} AS left_pct, {r('y', 6)} AS right_pct FROM m", "prices", **PAIRS)


def corr(over: str) -> str:
    raw = f"covar_samp(x, y){over} / nullif(stddev_samp(x){over} * stddev_samp(y){over}, 0)"
    return f"CASE WHEN {raw} IS NOT NULL THEN greatest(-1, least(1, {raw})) END"


_w = " OVER " + frame(20, "left_id, right_id")
q("rolling_correlation", f"SELECT left_id, right_id, start_date, date, {r(f'CASE WHEN k >= 20 THEN c END', 6)} AS correlation, least(k, 20) AS matched_interval_count FROM (SELECT *, row_number() OVER (PARTITION BY left_id, right_id ORDER BY date) AS k, {corr(_w)} AS c FROM m)", "prices", **PAIRS)
q("correlation_matrix", f"SELECT left_id, right_id, {r(corr(''), 6)} AS correlation, count(*) AS matched_interval_count FROM (SELECT *, row_number() OVER (PARTITION BY left_id, right_id ORDER BY date DESC) AS k FROM m) WHERE k <= 250 GROUP BY 1, 2", "prices", **PAIRS)
_terms = {"commodity": "(p1 - p0) * f0", "fx": "p0 * (f1 - f0)", "interaction": "(p1 - p0) * (f1 - f0)"}
_share = "CASE WHEN p0 * f0 > 0 AND p1 * f1 > 0 THEN ({}) / (p0 * f0) * 100 END"
q("fx_attribution", f"SELECT series_id, DATE '2001-04-17' AS target_date, start_date, CASE WHEN start_date IS NOT NULL THEN end_date END AS end_date, {r('p0 * f0')} AS start_pln, {r('p1 * f1')} AS end_pln, " + ", ".join(f"{r(c)} AS {k}" for k, c in _terms.items()) + f", {r('p1 * f1 - p0 * f0')} AS total, " + ", ".join(f"{r(_share.format(c))} AS {k}_pp" for k, c in _terms.items()) + f", {r(_share.format('p1 * f1 - p0 * f0'))} AS total_pct, n AS matched_observation_count FROM (SELECT series_id, max(date) FILTER (WHERE date <= DATE '2001-04-17') AS start_date, max(date) AS end_date, arg_max(value, date) FILTER (WHERE date <= DATE '2001-04-17') AS p0, arg_max(rate, date) FILTER (WHERE date <= DATE '2001-04-17') AS f0, arg_max(value, date) AS p1, arg_max(rate, date) AS f1, count(*) AS n FROM j GROUP BY 1)", "prices", "fx", f=FX, j=JOINT)


def logs(source: str) -> str:
    before = f"lag(value) OVER {OBS}"
    rel = f"((value - {before}) / {before})"
    return f"SELECT * FROM (SELECT series_id, lag(date) OVER {OBS} AS start_date, date, CASE WHEN value > 0 AND {before} > 0 THEN 100 * CASE WHEN abs({rel}) < 0.5 THEN ln(1 + {rel}) ELSE ln(value) - ln({before}) END END AS c FROM {source}) WHERE c IS NOT NULL"


q("fx_variance", f"SELECT series_id, n AS paired_intervals, {r('vc', 6)} AS var_commodity, {r('vf', 6)} AS var_fx, {r('cv', 6)} AS covariance, {r('vz', 6)} AS total_variance, {r('cz', 6)} AS commodity_contribution, {r('fz', 6)} AS fx_contribution, {r('CASE WHEN vz > pow(32 * 2.220446049250313e-16 * s, 2) THEN cz / vz * 100 END', 6)} AS commodity_share, {r('CASE WHEN vz > pow(32 * 2.220446049250313e-16 * s, 2) THEN fz / vz * 100 END', 6)} AS fx_share FROM (SELECT a.series_id, count(*) AS n, var_samp(a.c) AS vc, var_samp(b.c) AS vf, covar_samp(a.c, b.c) AS cv, var_samp(a.c + b.c) AS vz, covar_samp(a.c, a.c + b.c) AS cz, covar_samp(b.c, a.c + b.c) AS fz, greatest(100, max(abs(a.c)), max(abs(b.c))) AS s FROM a JOIN b ON a.start_date = b.start_date AND a.date = b.date GROUP BY 1)", "prices", "fx", a=logs("v"), f=f"SELECT * FROM fx WHERE date <= {A}", b=logs("f"))
q("cross_rate", f"SELECT s AS series_id, date, {r('x', 6)} AS value FROM (SELECT 'EUR_PLN' AS s, date, value AS x FROM fx UNION ALL SELECT 'EUR_USD', date, value / 4 FROM fx UNION ALL SELECT 'USD_PLN', date, value / (value / 4) FROM fx)", "fx")
q("compatible_rates", "SELECT s.n_name AS series_id, r.n_name AS fx_id FROM nation s JOIN nation r ON s.n_regionkey = r.n_regionkey AND s.n_nationkey % 3 <> 0 AND r.n_nationkey % 3 = 0")
q("scenario", f"SELECT series_id, date, {r('value * rate', 6)} AS pln_per_tonne, {r('value * rate * 100', 6)} AS benchmark_value_pln, CAST(4000 AS DOUBLE) AS baseline_pln_per_tonne, {r('value * rate - 4000', 6)} AS change_pln_per_tonne, {r('(value * rate - 4000) * 100', 6)} AS change_benchmark_value_pln, {r(pct('value * rate', '4000'), 6)} AS change_pct FROM j", "prices", "fx", f=FX, j=JOINT)


# risk
def tails(h: int, parts: int, least: int, sign: str) -> dict[str, str]:
    return {
        "i": changes(h),
        "k": f"SELECT series_id, {sign}change AS loss, count(*) OVER (PARTITION BY series_id) AS n, row_number() OVER (PARTITION BY series_id ORDER BY {sign}change DESC, end_date) AS k FROM i WHERE change IS NOT NULL",
        "t": f"SELECT series_id, n, n / CAST({parts} AS DOUBLE) AS mass, n >= {least} AS ok, max(loss) FILTER (WHERE k = n + 1 - CAST(ceil(n * {parts - 1} / CAST({parts} AS DOUBLE)) AS BIGINT)) AS var, sum(greatest(0, least(1, n / CAST({parts} AS DOUBLE) - (k - 1))) * loss) / (n / CAST({parts} AS DOUBLE)) AS es FROM k GROUP BY 1, 2",
    }


_var = f"SELECT series_id, n AS interval_count, {r('mass', 6)} AS tail_mass, ok AS available, {r('CASE WHEN ok THEN var END', 6)} AS var, {r('CASE WHEN ok THEN es END', 6)} AS expected_shortfall FROM t"
q("var_es", _var, "prices", **tails(1, 20, 100, ""))
q("var_es_seller", _var, "prices", **tails(5, 100, 500, "-"))
q("exposure", f"SELECT series_id, {r('CASE WHEN ok THEN var END / 100 * 1000000')} AS var_amount, {r('CASE WHEN ok THEN es END / 100 * 1000000')} AS es_amount FROM t", "prices", **tails(1, 20, 100, ""))
q("change_histogram", f"SELECT g.series_id, g.bin, {r('g.lo * (1 - g.bin / g.bins) + g.hi * (g.bin / g.bins)', 6)} AS lower, {r('g.lo * (1 - (g.bin + 1) / g.bins) + g.hi * ((g.bin + 1) / g.bins)', 6)} AS upper, coalesce(b.c, 0) AS count FROM g LEFT JOIN b USING (series_id, bin)", "prices", i=changes(1), e="SELECT series_id, min(change) AS lo, max(change) AS hi, CASE WHEN min(change) = max(change) THEN 1 ELSE least(10, CAST(ceil(sqrt(count(*))) AS INTEGER)) END AS bins FROM i WHERE change IS NOT NULL GROUP BY 1", b="SELECT series_id, CAST(greatest(0, least(bins - 1, coalesce(floor((change - lo) / nullif(hi - lo, 0) * bins), 0))) AS INTEGER) AS bin, count(*) AS c FROM i JOIN e USING (series_id) WHERE change IS NOT NULL GROUP BY 1, 2", g="SELECT series_id, lo, hi, CAST(bins AS DOUBLE) AS bins, CAST(unnest(range(bins)) AS INTEGER) AS bin FROM e")
q("change_summary", f"SELECT series_id, {r('avg(change)', 6)} AS mean_change, {r('quantile_cont(change, 0.5)', 6)} AS median_change, count(change) AS valid_intervals, count(*) - count(change) AS nonpositive_endpoints FROM i GROUP BY 1", "signed_prices", i=changes(1))
q("top_moves", f"SELECT series_id, kind, CAST(k AS INTEGER) AS rank, start_date, end_date, {r('change', 6)} AS change FROM (SELECT *, row_number() OVER (PARTITION BY series_id, kind ORDER BY abs(change) DESC, end_date) AS k FROM (SELECT *, CASE WHEN change > 0 THEN 'rise' ELSE 'fall' END AS kind FROM i WHERE change <> 0)) WHERE k <= 5", "prices", i=changes(1))


def extreme(order: str, keep: str, best: str) -> dict[str, str]:
    """Earliest peak (or trough) before each row of its path, and the first largest change from it."""
    return {
        "s": f"SELECT *, row_number() OVER {OBS} AS i, count(*) FILTER (WHERE value <= 0) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS segment FROM v",
        "p": f"SELECT b.series_id, b.date AS end_date, b.i, b.value, a.date AS start_date, a.i AS i0, a.value AS v0, row_number() OVER (PARTITION BY b.series_id, b.i ORDER BY a.value {order}, a.i) AS k FROM s a JOIN s b ON a.series_id = b.series_id AND a.segment = b.segment AND a.i < b.i WHERE a.value > 0 AND b.value > 0",
        "z": f"SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY (value / v0 - 1) * 100 {best}, end_date) AS z FROM p WHERE k = 1 AND (value / v0 - 1) * 100 {keep} 0",
    }


_extreme = f"SELECT series_id, start_date, end_date, i - i0 AS observed_intervals, {r('(value / v0 - 1) * 100', 6)} AS change FROM z WHERE z = 1"
q("max_drawdown", _extreme, "signed_prices", **extreme("DESC", "<=", "ASC"))
q("max_runup", _extreme, "signed_prices", **extreme("ASC", ">=", "DESC"))
q("path_breaks", "SELECT series_id, count(*) FILTER (WHERE value <= 0) AS nonpositive_path_breaks FROM v GROUP BY 1", "signed_prices")


# completed years and forecasts
def year_grid(first: str, last: int) -> dict[str, str]:
    return {
        "y": f"SELECT DISTINCT series_id, {first} AS first FROM long_prices p",
        "c": "SELECT series_id, CAST(year(date) * 12 + month(date) - 1 AS BIGINT) AS k, arg_max(value, date) AS close FROM v GROUP BY 1, 2",
        "g": f"SELECT series_id, first, unnest(range(CAST(first * 12 - 1 AS BIGINT), CAST({last} * 12 + 12 AS BIGINT))) AS k FROM y",
        "s": "SELECT g.series_id, g.first, g.k, c.close, lag(c.close) OVER (PARTITION BY g.series_id ORDER BY g.k) AS before FROM g LEFT JOIN c USING (series_id, k)",
        "x": f"SELECT series_id, CAST(k // 12 AS INTEGER) AS year, CAST(k % 12 + 1 AS INTEGER) AS month, {pct('close', 'before')} AS change, CASE WHEN close IS NULL THEN 'missing_month_close' WHEN before IS NULL THEN 'missing_previous_month' WHEN close <= 0 OR before <= 0 THEN 'nonpositive_month_endpoints' ELSE 'ok' END AS state, first FROM s WHERE k >= first * 12",
    }


ALL = year_grid("(SELECT min(year(date)) FROM v w WHERE w.series_id = p.series_id AND year(date) < 1999)", 1998)
q("return_grid", f"SELECT series_id, year, month, {r('change', 6)} AS change, state FROM x", "long_prices", **ALL)
q("seasonality_omissions", "SELECT series_id, " + ", ".join(f"count(*) FILTER (WHERE state = '{k}') AS {k}" for k in ("ok", "missing_month_close", "missing_previous_month", "nonpositive_month_endpoints")) + " FROM x GROUP BY 1", "long_prices", **ALL)
q("return_seasonality", f"""SELECT series_id, month, {r('avg(change)', 6)} AS mean, {r('quantile_cont(change, 0.5)', 6)} AS median, count(change) AS year_count, count(*) FILTER (WHERE change > 0) AS positive_count, {r('min(change)', 6)} AS minimum, {r('max(change)', 6)} AS maximum,
{r('avg(change) FILTER (WHERE year <= 1993)', 6)} AS early_mean, count(change) FILTER (WHERE year <= 1993) AS early_count, {r('avg(change) FILTER (WHERE year > 1993)', 6)} AS late_mean, count(change) FILTER (WHERE year > 1993) AS late_count,
{r('min(lo)', 6)} AS leave_one_out_minimum, {r('max(lo)', 6)} AS leave_one_out_maximum, {r('count(*) FILTER (WHERE change > 0) / CAST(nullif(count(change), 0) AS DOUBLE)', 6)} AS positive_fraction
FROM (SELECT *, CASE WHEN count(change) OVER w >= 2 AND change IS NOT NULL THEN (sum(change) OVER w - change) / (count(change) OVER w - 1) END AS lo FROM x WINDOW w AS (PARTITION BY series_id, month)) GROUP BY 1, 2""", "long_prices", **year_grid("1989", 1998))


def times(a: str, b: str) -> str:
    return f"((((({a}) & 65535) * ({b})) + ((((({a}) >> 16) * ({b})) & 65535) * 65536)) & 4294967295)"


_boot = {
    **ALL,
    "n": "SELECT series_id, CAST(1999 - first AS BIGINT) AS years, first FROM y WHERE 1999 - first >= 2",
    "d0": "SELECT series_id, years, first, r, b, (CAST(20261008 AS BIGINT) + (r * ((years + 1) // 2) + b + 1) * 1831565813) & 4294967295 AS s FROM (SELECT series_id, years, first, unnest(range(1000)) AS r FROM n), (SELECT unnest(range(60)) AS b) WHERE b < (years + 1) // 2",
    "d1": f"SELECT *, {times('xor(s, s >> 15)', '(s | 1)')} AS v1 FROM d0",
    "d2": f"SELECT *, xor(v1, (v1 + {times('xor(v1, v1 >> 7)', '(v1 | 61)')}) & 4294967295) AS v2 FROM d1",
    "d3": "SELECT *, CAST(floor(xor(v2, v2 >> 14) / CAST(4294967296 AS DOUBLE) * (years - 1)) AS BIGINT) AS start FROM d2",
    "u": "SELECT series_id, r, first + start + o AS year FROM d3, (VALUES (0), (1)) AS t(o) WHERE b * 2 + o < years",
    "mm": "SELECT u.series_id, u.r, x.month, avg(x.change) AS mean FROM u JOIN x ON u.series_id = x.series_id AND u.year = x.year GROUP BY 1, 2, 3",
    "yc": "SELECT series_id, month, count(change) AS n FROM x GROUP BY 1, 2",
    "qq": "SELECT series_id, month, count(mean) AS valid, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM mm GROUP BY 1, 2",
}
q("bootstrap_interval", f"SELECT yc.series_id, yc.month, yc.n AS year_count, CASE WHEN yc.n >= 8 THEN qq.valid ELSE 0 END AS valid_replicates, {r('CASE WHEN yc.n >= 8 AND qq.valid >= 900 THEN qq.lo END', 6)} AS low, {r('CASE WHEN yc.n >= 8 AND qq.valid >= 900 THEN qq.hi END', 6)} AS high FROM yc LEFT JOIN qq USING (series_id, month)", "long_prices", **_boot)
WALK = {
    "o": f"SELECT series_id, date, value, row_number() OVER {OBS} - 1 AS i, first_value(value) OVER {OBS} AS first, avg(value) OVER {frame(20)} AS mean20, " + ", ".join(f"lead(date, {h}) OVER {OBS} AS d{h}, lead(value, {h}) OVER {OBS} AS x{h}" for h in (1, 5, 20)) + " FROM v",
    "h": " UNION ALL ".join(f"SELECT series_id, {h} AS horizon, date AS origin_date, d{h} AS target_date, x{h} AS actual, value AS naive, value + (value - first) / i * {h} AS drift, mean20 FROM o WHERE i >= 199 AND d{h} IS NOT NULL" for h in (1, 5, 20)),
    "z": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY origin_date DESC) AS k FROM h) WHERE k <= 252",
}
q("walk_forward_rows", f"SELECT series_id, horizon, origin_date, target_date, {r('actual')} AS actual, {r('naive')} AS naive, {r('drift')} AS drift, {r('mean20')} AS mean20 FROM z", "prices", **WALK)
_models = " UNION ALL ".join(f"SELECT series_id, horizon, '{m}' AS model, {m} - actual AS e FROM z" for m in ("naive", "drift", "mean20"))
q("walk_forward", f"SELECT a.series_id, a.horizon, a.model, a.n AS count, {r('a.mae')} AS mae, {r('a.rmse')} AS rmse, {r('1 - a.mae / nullif(b.mae, 0)')} AS mae_skill, {r('1 - a.rmse / nullif(b.rmse, 0)')} AS rmse_skill FROM s a JOIN s b ON a.series_id = b.series_id AND a.horizon = b.horizon AND b.model = 'naive'", "prices", **WALK, e=_models, s="SELECT series_id, horizon, model, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM e GROUP BY 1, 2, 3")
q("walk_forward_counts", "SELECT series_id, CAST(h AS INTEGER) AS horizon, CAST(greatest(0, n - h - 199) AS BIGINT) AS eligible_origins, CAST(least(252, greatest(0, n - h - 199)) AS BIGINT) AS count, CAST(greatest(0, n - h - 199 - 252) AS BIGINT) AS limited_origins FROM (SELECT series_id, count(*) AS n FROM v GROUP BY 1), (VALUES (1), (5), (20)) AS t(h)", "prices")

# vintages, versions and the store
VINT = {"w0": f"SELECT *, ending_stocks / total_use * 100 AS stu FROM vintages WHERE publication_date <= {A}", "w1": "SELECT *, lag(ending_stocks) OVER w AS e0, lag(total_use) OVER w AS u0, lag(stu) OVER w AS s0 FROM w0 WINDOW w AS (PARTITION BY commodity, region, marketing_year ORDER BY publication_date)"}
_vint = f"commodity, region, marketing_year, publication_date, {r('ending_stocks')} AS ending_stocks, {r('total_use')} AS total_use, {r('stu')} AS stocks_to_use_pct, {r('ending_stocks - e0')} AS ending_stocks_revision, {r('total_use - u0')} AS total_use_revision, {r('stu - s0')} AS stocks_to_use_revision_pp"
q("fundamental_revisions", f"SELECT {_vint} FROM w1", "vintages", **VINT)
q("fundamental_latest", f"SELECT {_vint} FROM (SELECT *, row_number() OVER (PARTITION BY commodity, region ORDER BY marketing_year DESC, publication_date DESC) AS k FROM w1) WHERE k = 1", "vintages", **VINT)
q("fundamental_counts", f"SELECT commodity, region, count(*) AS input, count(*) FILTER (WHERE seen) AS visible, count(*) FILTER (WHERE NOT seen) AS after_cutoff, count(*) FILTER (WHERE seen AND marketing_year = top) AS selected FROM (SELECT *, max(marketing_year) FILTER (WHERE seen) OVER (PARTITION BY commodity, region) AS top FROM (SELECT *, publication_date <= {A} AS seen FROM vintages)) GROUP BY 1, 2", "vintages")
DIFF = "SELECT coalesce(o.series_id, n.series_id) AS series_id, coalesce(o.date, n.date) AS date, o.value AS old_value, n.value AS new_value, CASE WHEN o.date IS NULL THEN 'new' WHEN n.date IS NULL THEN 'absent' WHEN o.value = n.value THEN 'unchanged' ELSE 'corrected' END AS state FROM older o FULL JOIN newer n ON o.series_id = n.series_id AND o.date = n.date"
q("version_diff", f"SELECT series_id, date, {r('old_value')} AS old_value, {r('new_value')} AS new_value, state FROM d", "older", "newer", d=DIFF)
q("version_diff_counts", "SELECT series_id, state, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM d GROUP BY 1, 2", "older", "newer", d=DIFF)
q("merge_keep_last", f"SELECT series_id, date, {r('coalesce(new_value, old_value)')} AS value FROM d", "older", "newer", d=DIFF)
q("upsert_snapshot", f"SELECT series_id, date, {r('coalesce(new_value, old_value)')} AS value FROM d", "older", "newer", d=DIFF)
q("upsert_classify", f"SELECT series_id, date, {r('old_value')} AS old_value, {r('new_value')} AS new_value, CASE state WHEN 'new' THEN 'inserted' WHEN 'corrected' THEN 'revised' ELSE 'unchanged' END AS action FROM d WHERE state <> 'absent'", "older", "newer", d=DIFF)
q("freshness", f"SELECT series_id, max(date) FILTER (WHERE date <= {A}) AS last_date, CAST(datediff('day', max(date) FILTER (WHERE date <= {A}), {A}) AS INTEGER) AS age_days, coalesce(datediff('day', max(date) FILTER (WHERE date <= {A}), {A}) > 7, true) AS stale FROM gappy_prices GROUP BY 1", "gappy_prices")
q("read_series", f"SELECT series_id, date, {r('value')} AS value FROM prices WHERE series_id = '1-URGENT'", "prices")
q("cutoff_counts", f"SELECT series_id, count(*) FILTER (WHERE date <= {A}) AS visible, count(*) FILTER (WHERE date > {A}) AS excluded_future_observations FROM prices GROUP BY 1", "prices")
q("series_catalog", "SELECT s.series_id, count(g.date) AS observation_count, min(g.date) AS first_date, max(g.date) AS last_date, (SELECT max(p.date) FROM prices p WHERE p.series_id = s.series_id) AS last_import FROM (SELECT DISTINCT o_orderpriority AS series_id FROM orders UNION ALL SELECT 'EMPTY') s LEFT JOIN gappy_prices g ON g.series_id = s.series_id GROUP BY 1", "gappy_prices", "prices")

# sources
_bad = {"missing_date": "date IS NULL", "duplicate_date": "date IS NOT NULL AND c > 1", "missing_value": "value IS NULL", "nonfinite_value": "isinf(value) OR isnan(value)"}
q("quality_report", " UNION ALL ".join(f"SELECT series_id, row, '{k}' AS code FROM t WHERE {c}" for k, c in _bad.items()), o="SELECT o_orderpriority AS series_id, o_orderkey AS row, CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(o_totalprice AS DOUBLE) END AS value FROM orders", t="SELECT *, count(*) OVER (PARTITION BY series_id, date) AS c FROM o")
q("instrument_filter_counts", "SELECT count(*) FILTER (WHERE series_id = '1-URGENT') AS selected, count(*) FILTER (WHERE series_id <> '1-URGENT') AS filtered_instrument_rows FROM prices", "prices")
q("wide_to_series", f"SELECT CASE series_id WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' ELSE 'c' END AS series_id, date, {r('value')} AS value FROM prices WHERE series_id IN ('1-URGENT', '2-HIGH', '5-LOW')", "prices")
q("excel_serial_date", "SELECT o_orderkey, CASE WHEN k <> 60 THEN CAST(DATE '1899-12-31' + (CASE WHEN k > 60 THEN k - 1 ELSE k END) AS DATE) END AS date_1900, CAST(DATE '1904-01-01' + k AS DATE) AS date_1904 FROM (SELECT o_orderkey, CAST(o_orderkey AS INTEGER) AS k FROM orders)")
q("csv_import", f"SELECT series_id, date, {r('value')} AS value FROM prices", "prices")
q("daily_events", "SELECT CAST(date_trunc('day', ts) AS DATE) AS date, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")

# files: what was written must come back
_lines = "SELECT series_id, date, value, CAST(row_number() OVER (ORDER BY date, series_id) + 1 AS BIGINT) AS row, datediff('day', DATE '1990-01-01', date) % 53 = 0 AS blank FROM prices"
q("csv_file", f"SELECT '1-URGENT' AS series_id, date, {r('value')} AS value, row FROM l WHERE series_id = '1-URGENT' AND NOT blank AND date <= {A}", "prices", l=_lines)
q("csv_file_left_out", f"SELECT CASE WHEN series_id <> '1-URGENT' THEN 'instrument' WHEN date > {A} THEN 'date' ELSE 'missing' END AS reason, row FROM l WHERE series_id <> '1-URGENT' OR blank OR date > {A}", "prices", l=_lines)
q("csv_file_issues", "SELECT CAST(k AS BIGINT) AS row, CASE day(date) WHEN 5 THEN 'invalid_date' WHEN 7 THEN 'invalid_numeric' ELSE 'nonfinite_value' END AS code FROM (SELECT date, row_number() OVER (ORDER BY date) + 1 AS k FROM prices WHERE series_id = '1-URGENT') WHERE day(date) IN (5, 7, 9)", "prices")
q("workbook_series", f"SELECT CASE series_id WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' ELSE 'c' END AS series_id, date, {r('value')} AS value FROM v WHERE series_id IN ('1-URGENT', '2-HIGH', '5-LOW')", "prices")
q("ecb_rates", f"SELECT s AS series_id, date, {r('x', 6)} AS value FROM (SELECT 'EUR_PLN' AS s, date, value AS x FROM fx UNION ALL SELECT 'EUR_USD', date, value / 4 FROM fx UNION ALL SELECT 'USD_PLN', date, value / (value / 4) FROM fx)", "fx")
q("master_import", f"SELECT series_id, date, {r('value')} AS value FROM v WHERE series_id IN ('1-URGENT', '2-HIGH', '5-LOW')", "prices")
q("fundamentals_file", f"SELECT publication_date, commodity, region, marketing_year, 'metric tonnes' AS unit, {r('ending_stocks')} AS ending_stocks, {r('total_use')} AS total_use FROM vintages", "vintages")
_both = "SELECT coalesce(n.date, o.date) AS date, o.value AS old_value, n.value AS new_value FROM older o FULL JOIN newer n ON o.date = n.date"
q("store_series", f"SELECT 'ALL' AS series_id, date, {r('coalesce(new_value, old_value)')} AS value FROM b", "older", "newer", b=_both)
q("store_revisions", f"SELECT 'ALL' AS series_id, date, CAST(NULL AS DOUBLE) AS old_value, {r('value')} AS new_value, 0 AS import FROM older UNION ALL SELECT 'ALL', date, {r('old_value')}, {r('new_value')}, 1 FROM b WHERE new_value IS NOT NULL AND new_value IS DISTINCT FROM old_value", "older", "newer", b=_both)
q("store_imports", "SELECT 'ALL' AS series_id, 0 AS import, count(*) AS observations, count(*) AS inserted, CAST(0 AS BIGINT) AS revised, CAST(0 AS BIGINT) AS unchanged FROM older UNION ALL SELECT 'ALL', 1, count(new_value), count(*) FILTER (WHERE new_value IS NOT NULL AND old_value IS NULL), count(*) FILTER (WHERE new_value <> old_value), count(*) FILTER (WHERE new_value = old_value) FROM b", "older", "newer", b=_both)
q("named_pairs", f"SELECT a.series_id AS left_id, b.series_id AS right_id, a.start_date, a.date, {r('a.p', 6)} AS left_pct, {r('b.p', 6)} AS right_pct FROM rr a JOIN rr b ON a.start_date = b.start_date AND a.date = b.date WHERE (a.series_id = '2-HIGH' AND b.series_id = '1-URGENT') OR (a.series_id = '1-URGENT' AND b.series_id = '5-LOW')", "prices", rr=PAIRS["rr"])
