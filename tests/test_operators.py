"""Hand-calculated vectors for every price-history operator."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from almanac.functions import scalars
from almanac.operators import contract, forecast, fundamentals, market, monthly, risk, seasonality, store, technical

D = dt.date.fromisoformat


@pytest.fixture()
def series(spark):
    def make(rows, series_id="s"):
        return spark.createDataFrame([(series_id, D(d), float(v)) for d, v in rows], "series_id string, date date, value double")

    return make


@pytest.fixture()
def daily(spark):
    def make(values, start="2024-01-01", series_id="s", step=1):
        return spark.createDataFrame([(series_id, D(start) + dt.timedelta(days=step * k), float(v)) for k, v in enumerate(values)], "series_id string, date date, value double")

    return make


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def test_monthly_grid(series):
    df = series([("2020-01-20", 0), ("2020-01-01", 10), ("2020-01-09", 20), ("2020-02-01", -6), ("2022-01-01", 4), ("2022-01-07", 8)])
    grid = {(r["year"], r["month"]): (r["mean"], r["n"]) for r in rows(monthly.monthly_grid(df))}
    assert len(grid) == 36
    assert grid[2020, 1] == (10, 3) and grid[2020, 2] == (-6, 1) and grid[2022, 1] == (6, 2)
    assert all(grid[2021, m] == (None, 0) for m in range(1, 13))


def test_seasonal_profile_and_current(series):
    base = [("2024-01-01", 100), ("2024-01-03", 120), ("2025-01-01", 200), ("2026-01-15", 155)]
    later = [("2026-01-16", 999), ("2026-02-01", 999), ("2027-01-01", 999)]
    for df in (series(base), series(list(reversed(base + later)))):
        p = rows(monthly.seasonal_profile(df, D("2026-01-15"), 5), "month")[0]
        assert (p["mean"], p["minimum"], p["maximum"], p["year_count"], p["observation_count"]) == (155, 110, 200, 2, 3)
        now = rows(monthly.seasonal_current(df, D("2026-01-15"), 5), "month")
        assert (now[0]["mean"], now[0]["difference"], now[0]["calendar_status"]) == (155, 0, "month_in_progress")
        assert all(r["calendar_status"] == "after_cutoff" and r["mean"] is None for r in now[1:])
    assert rows(contract.cutoff_counts(series(base + later), D("2026-01-15")))[0]["excluded_future_observations"] == 3


def test_seasonal_distribution(series):
    df = series([("2023-01-01", 100), ("2023-01-02", 120), ("2024-01-01", 200)])
    r = rows(monthly.seasonal_distribution(df, D("2025-01-01"), 5), "month")[0]
    assert (r["mean"], r["median"], r["q25"], r["q75"], r["year_count"], r["observation_count"]) == (155, 155, 132.5, 177.5, 2, 3)


def test_normalized_profile(series):
    df = series([("2024-01-03", 10), ("2024-01-05", 12), ("2024-02-01", 15), ("2025-01-09", 20), ("2025-02-01", 40), ("2026-01-15", 50), ("2026-02-02", 60)])
    p = rows(monthly.normalized_profile(df, D("2026-02-02"), 5), "month")
    assert p[0]["mean"] == pytest.approx(105) and p[1]["mean"] == pytest.approx(175)
    assert (p[1]["minimum"], p[1]["maximum"]) == (pytest.approx(150), pytest.approx(200))
    b = rows(monthly.year_bases(df, D("2026-02-02")), "year")[0]
    assert (b["base_date"], b["base_value"]) == (D("2024-01-03"), 10)


def test_partial_month(series):
    df = series([("2023-02-28", 140), ("2023-03-01", 9), ("2022-02-28", 160), ("2024-02-29", 180)])
    y = rows(monthly.partial_month_years(df, D("2024-02-29"), 2), "year")
    assert y[1]["through_date"] == D("2023-02-28")
    s = rows(monthly.partial_month_summary(df, D("2024-02-29"), 2))[0]
    assert (s["baseline_mean"], s["difference"], s["year_count"]) == (150, 30, 2)


def test_recent_years(series):
    df = series([("2022-01-01", 100), ("2022-01-02", 120), ("2026-01-15", 200)])
    r = rows(monthly.recent_year_mean(df, D("2026-01-15")), "month")[0]
    assert (r["mean"], r["year_count"], r["observation_count"]) == (155, 2, 3)
    wide = rows(monthly.recent_years(df, D("2026-01-15")), "month")[0]
    assert [wide[f"y{k}"] for k in range(5)] == [110, None, None, None, 200]


def test_price_matrix(series):
    df = series([("2025-03-01", 10), ("2025-04-01", 30), ("2025-05-01", 20), ("2026-01-05", 20), ("2026-01-06", 20)])
    got = {(r["year"], r["month"]): (r["side"], r["partial"]) for r in rows(monthly.price_matrix(df, D("2026-01-10")))}
    assert len(got) == 120
    assert got[2025, 3] == ("lower", False) and got[2025, 4] == ("higher", False) and got[2025, 5] == ("equal", False)
    assert got[2026, 1] == ("equal", True) and got[2026, 2][0] == "future" and got[2024, 1][0] == "missing"


def test_monthly_returns(series):
    df = series([("2024-12-31", 100), ("2025-01-01", 200), ("2025-01-30", 110), ("2025-02-04", 121), ("2025-02-05", 999)])
    got = rows(monthly.monthly_returns(df, D("2025-02-04")), "month_start")
    assert [g["return_pct"] for g in got] == [None, pytest.approx(10), pytest.approx(10)]
    assert got[-1]["calendar_status"] == "month_in_progress"
    gap = rows(monthly.monthly_returns(series([("2025-01-31", 1), ("2025-03-31", 2)]), D("2025-04-30")), "month_start")
    assert len(gap) == 4 and all(g["return_pct"] is None for g in gap)


def test_technical(daily):
    last = rows(technical.technical(daily([0] * 10 + [2] * 10), D("2030-01-01")), "date")
    assert (last[-1]["sma20"], last[-1]["upper"], last[-1]["lower"]) == (1, 3, -1)
    assert all(r["sma20"] is None for r in last[:-1])
    long = rows(technical.technical(daily(range(1, 501)), D("2030-01-01")), "date")
    assert (long[99]["sma100"], long[199]["sma200"], long[499]["sma200"]) == (50.5, 100.5, 400.5)


def test_bollinger_exact(daily):
    r = rows(technical.bollinger_exact(daily([1e12] * 10 + [1e12 + 0.125] * 10), D("2030-01-01")), "date")[-1]
    assert (r["middle"] - 1e12, r["upper"] - 1e12, r["lower"] - 1e12) == (0.0625, 0.1875, -0.0625)


def test_moving_averages(daily):
    got = rows(technical.moving_averages(daily(range(1, 52), step=2), D("2024-01-01") + dt.timedelta(days=98)), "date")
    assert len(got) == 50 and got[19]["sma20"] == 10.5 and got[-1]["sma20"] == 40.5 and got[-1]["sma50"] == 25.5


def test_rsi(daily):
    values = [100]
    for change in [2, -1] * 7 + [0]:
        values.append(values[-1] + change)
    got = [r["rsi14"] for r in rows(technical.rsi(daily(values), D("2030-01-01")), "date")]
    assert got[:14] == [None] * 14 and got[14] == pytest.approx(200 / 3) and got[15] == pytest.approx(200 / 3)
    assert rows(technical.rsi_last(daily(values), D("2030-01-01")))[0]["rsi14"] == pytest.approx(got[-1])
    for v, expected in ((([5] * 20), 50), (range(20), 100), (range(20, 0, -1), 0)):
        assert rows(technical.rsi_last(daily(v), D("2030-01-01")))[0]["rsi14"] == expected
        assert rows(technical.rsi(daily(v), D("2030-01-01")), "date")[-1]["rsi14"] == expected


def test_volatility(daily):
    got = rows(technical.volatility(daily([1, 2] * 10 + [1]), D("2030-01-01")), "date")
    assert got[20]["volatility20"] == pytest.approx(100 * math.log(2) * math.sqrt(20 / 19)) and got[19]["volatility20"] is None
    assert rows(technical.volatility(daily([0, 2] + [1, 2] * 9 + [1]), D("2030-01-01")), "date")[20]["volatility20"] is None


def test_snapshot(series):
    df = series([("2024-12-30", 100), ("2025-01-30", 110), ("2025-02-27", 120), ("2025-03-31", 120), ("2025-04-01", 1)])
    got = {r["reference"]: r for r in rows(technical.snapshot_changes(df, D("2025-03-31")))}
    assert (got["month"]["reference_date"], got["month"]["change_pct"]) == (D("2025-02-27"), 0)
    assert got["quarter"]["reference_date"] == D("2024-12-30") and got["ytd"]["change_pct"] == pytest.approx(20)
    assert {r["span"]: r["percentile"] for r in rows(technical.level_position(df, D("2025-03-31")))}["one_year"] == 75
    assert rows(technical.market_snapshot(df, D("2025-03-31")))[0]["ytd_pct"] == pytest.approx(20)


def test_conversion(series):
    p = series([("2024-01-01", 10), ("2024-01-02", -20), ("2024-01-03", 30), ("2024-01-05", 999)])
    f = series([("2024-01-01", 4), ("2024-01-03", 5), ("2024-01-04", 4), ("2024-01-05", 999)], "fx")
    assert [r["value"] for r in rows(market.fx_convert(p, f, D("2024-01-04")), "date")] == [40, 150]
    c = rows(market.fx_convert_counts(p, f, D("2024-01-04")))[0]
    assert (c["unmatched_price_observations"], c["unmatched_fx_observations"], c["excluded_future_price_observations"], c["excluded_future_fx_observations"]) == (1, 1, 1, 1)
    with pytest.raises(Exception, match="contract"):
        market.fx_convert(p, series([("2024-01-01", 4), ("2025-01-01", 0)]), D("2024-01-04")).collect()


def test_indexed_comparison(series):
    both = series([("2024-01-01", 5), ("2024-01-02", 10), ("2024-01-03", 20)], "a").union(series([("2024-01-02", 100), ("2024-01-03", 80)], "b"))
    got = rows(market.indexed_comparison(both, D("2024-01-04"), D("2024-01-01")), "series_id", "date")
    assert [(r["series_id"], r["value"]) for r in got] == [("a", 100), ("a", 200), ("b", 100), ("b", pytest.approx(80))]
    low = series([("2024-01-02", -1), ("2024-01-03", 20)], "a").union(series([("2024-01-02", 100), ("2024-01-03", 80)], "b"))
    assert [r["value"] for r in rows(market.indexed_comparison(low, D("2024-01-04"), D("2024-01-01")), "series_id", "date")][:2] == [None, None]


def test_correlation(series):
    a = series([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 4), ("2024-01-04", 5)], "a")
    b = series([("2024-01-01", 1), ("2024-01-03", 2), ("2024-01-04", 3)], "b")
    got = rows(market.rolling_correlation(a.union(b), D("2024-01-05"), 2))
    assert len(got) == 1 and got[0]["correlation"] is None and got[0]["matched_interval_count"] == 1
    same = a.union(a.withColumn("series_id", F.lit("z")))
    assert rows(market.rolling_correlation(same, D("2024-01-05"), 2), "date")[-1]["correlation"] == pytest.approx(1)
    flat = a.union(series([(f"2024-01-0{k}", 3) for k in range(1, 5)], "f"))
    assert all(r["correlation"] is None for r in rows(market.rolling_correlation(flat, D("2024-01-05"), 2)))


def test_spread_and_scenario(spark, series):
    a, b = series([("2024-01-01", 200), ("2024-01-02", 210)]), series([("2024-01-02", 150)])
    assert [r["value"] for r in rows(market.spread(a, b, D("2024-01-03"), "EUR/t", "EUR/t"))] == [60]
    with pytest.raises(ValueError, match="units"):
        market.spread(a, b, D("2024-01-03"), "EUR/t", "PLN/t")
    got = spark.range(1).select(*[c.alias(k) for k, c in scalars.scenario(F.lit(105.0), F.lit(4.08), F.lit(100.0), F.lit(100.0), F.lit(4.0)).items()]).first()
    assert got["pln_per_tonne"] == pytest.approx(428.4) and got["change_benchmark_value_pln"] == pytest.approx(2840) and got["change_pct"] == pytest.approx(7.1)


def test_attribution(series):
    p, f = series([("2024-01-01", 200), ("2024-02-05", 210)]), series([("2024-01-01", 4), ("2024-02-05", 4.2)])
    r = rows(market.fx_attribution(p, f, D("2024-02-05")))[0]
    assert [r[k] for k in ("commodity", "fx", "interaction", "total")] == [pytest.approx(x) for x in (40, 40, 2, 82)]
    assert [r[k] for k in ("commodity_pp", "fx_pp", "interaction_pp", "total_pct")] == [pytest.approx(x) for x in (5, 5, 0.25, 10.25)]


def _path(changes):
    out = [100.0]
    for c in changes:
        out.append(out[-1] * math.exp(c / 100))
    return out


def test_fx_variance(daily):
    r = rows(market.fx_variance(daily(_path([1, 2, 3])), daily(_path([-0.5, -1, -1.5])), D("2030-01-01")))[0]
    assert [r[k] for k in ("var_commodity", "var_fx", "covariance", "total_variance", "commodity_share", "fx_share")] == [pytest.approx(x, abs=1e-9) for x in (1, 0.25, -0.5, 0.25, 200, -100)]
    assert rows(market.fx_variance(daily(_path([1, 2, 3])), daily(_path([-2, -3, -4])), D("2030-01-01")))[0]["commodity_share"] is None


def _changes(changes):
    """Pairs of levels with a break between them, so that intervals have just these changes."""
    out = []
    for c in changes:
        out += [0.0, 100.0, 100.0 + c]
    return out


@pytest.mark.parametrize(("changes", "var", "es"), [(range(100), 94, 97), (range(101), 95, 97.97029702970298), ([0] * 99 + [100], 0, 20)])
def test_var_es(daily, changes, var, es):
    r = rows(risk.var_es(daily(_changes(changes), start="1990-01-01"), D("2030-01-01")))[0]
    assert r["available"] and r["var"] == pytest.approx(var) and r["expected_shortfall"] == pytest.approx(es)


def test_var_es_limits(daily):
    r = rows(risk.var_es(daily(_changes(range(99)), start="1990-01-01"), D("2030-01-01")))[0]
    assert not r["available"] and r["var"] is None
    up = rows(risk.var_es(daily(_changes([1] * 100), start="1990-01-01"), D("2030-01-01"), direction="seller"))[0]
    assert up["var"] == pytest.approx(-1) and up["expected_shortfall"] == pytest.approx(-1)


def test_paths(daily):
    df = daily([100, 120, 60, 90, 0, 10, 25])
    down, up = rows(risk.max_drawdown(df, D("2030-01-01")))[0], rows(risk.max_runup(df, D("2030-01-01")))[0]
    assert (down["start_date"], down["end_date"], down["change"]) == (D("2024-01-02"), D("2024-01-03"), -50)
    assert (up["start_date"], up["end_date"], up["change"]) == (D("2024-01-06"), D("2024-01-07"), 150)
    assert rows(risk.path_breaks(df, D("2030-01-01")))[0]["nonpositive_path_breaks"] == 1


def test_histogram_and_moves(daily):
    df = daily(_changes([0, 10, 20, 30]))
    h = rows(risk.change_histogram(df, D("2030-01-01")), "bin")
    assert sum(r["count"] for r in h) == 4 and (h[0]["lower"], h[-1]["upper"]) == (pytest.approx(0), pytest.approx(30))
    s = rows(risk.change_summary(df, D("2030-01-01")))[0]
    assert s["mean_change"] == pytest.approx(15) and s["median_change"] == pytest.approx(15)
    moves = rows(risk.top_moves(daily([100, 110, 99, 108.9, 98.01]), D("2030-01-01")), "kind", "rank")
    assert [r["end_date"].day for r in moves if r["kind"] == "fall"] == [3, 5]
    got = rows(technical.interval_counts(daily([100, 0, 102, 103, 104, 105, 106]), D("2030-01-01"), 5))[0]
    assert (got["candidate_intervals"], got["valid_intervals"], got["nonpositive_endpoints"]) == (2, 1, 1)


def _januaries(changes, first):
    out = []
    for k, c in enumerate(changes):
        out += [(f"{first + k - 1}-12-31", 100), (f"{first + k}-01-31", 100 + c)]
    return out


def test_return_seasonality(series):
    df = series(_januaries([10, 20, 0, -10, 30], 2021))
    r = rows(seasonality.return_seasonality(df, D("2026-06-01"), 5), "month")[0]
    expected = {"mean": 10, "median": 10, "positive_fraction": 0.6, "minimum": -10, "maximum": 30, "leave_one_out_minimum": 5, "leave_one_out_maximum": 15, "early_mean": 15, "early_count": 2, "late_mean": 20 / 3, "late_count": 3}
    assert {k: r[k] for k in expected} == {k: pytest.approx(v) for k, v in expected.items()}


def test_bootstrap(spark, series):
    starts = [r[0] for r in spark.range(5).select(F.floor(seasonality.draw(1, F.col("id")) * 9)).collect()]
    assert starts == [5, 0, 4, 8, 8]
    df = series(_januaries(range(10), 2011))
    r = rows(seasonality.bootstrap_interval(df, D("2021-06-01"), 10, 1, 1), "month")[0]
    assert r["low"] == pytest.approx(5.5) and r["high"] == pytest.approx(5.5)
    flat = rows(seasonality.bootstrap_interval(series(_januaries([25] * 10, 2011)), D("2021-06-01"), 10, 100), "month")[0]
    assert (flat["low"], flat["high"], flat["valid_replicates"]) == (pytest.approx(25), pytest.approx(25), 100)


def test_walk_forward(daily):
    got = {(r["horizon"], r["model"]): r for r in rows(forecast.walk_forward(daily(range(1, 26)), D("2030-01-01"), min_training=20))}
    assert [got[1, m]["mae"] for m in forecast.MODELS] == [pytest.approx(x) for x in (1, 0, 10.5)] and got[1, "naive"]["count"] == 5
    assert [got[1, m]["mae_skill"] for m in forecast.MODELS] == [pytest.approx(x) for x in (0, 1, -9.5)]
    assert [got[5, m]["mae"] for m in forecast.MODELS] == [pytest.approx(x) for x in (5, 0, 14.5)] and (20, "naive") not in got
    other = {r["model"]: r for r in rows(forecast.walk_forward(daily([10] * 20 + [14, 8, 15]), D("2030-01-01"), min_training=20, horizons=(1,)))}
    assert other["naive"]["mae"] == pytest.approx(17 / 3) and other["naive"]["rmse"] == pytest.approx(math.sqrt(101 / 3)) and other["mean20"]["mae"] == pytest.approx((4 + 2.2 + 4.9) / 3)


def _vintages(spark, rows_):
    return spark.createDataFrame([(D(d), "wheat", "EU", my, "bushels", float(e), float(u)) for d, my, e, u in rows_], "publication_date date, commodity string, region string, marketing_year string, unit string, ending_stocks double, total_use double")


def test_fundamentals(spark):
    df = _vintages(spark, [("2025-08-12", "2025/26", 25, 100), ("2025-09-12", "2025/26", 24, 102), ("2025-10-09", "2025/26", 1, 1)])
    assert fundamentals.validate(df) is df
    r = rows(fundamentals.fundamental_latest(df, D("2025-09-12")))[0]
    assert r["stocks_to_use_pct"] == pytest.approx(400 / 17) and r["stocks_to_use_revision_pp"] == pytest.approx(-25 / 17) and r["ending_stocks_revision"] == -1 and r["total_use_revision"] == 2
    c = rows(fundamentals.fundamental_counts(df, D("2025-09-12")))[0]
    assert (c["input"], c["visible"], c["after_cutoff"], c["selected"]) == (3, 2, 1, 2)
    for bad in ([("2025-08-12", "2025/27", 1, 1)], [("2025-08-12", "2025/26", -1, 1)], [("2025-08-12", "2025/26", 1, 0)], [("2025-08-12", "2025/26", 1, 1)] * 2, []):
        with pytest.raises(ValueError, match="invalid|no rows"):
            fundamentals.validate(_vintages(spark, bad))


def test_versions_and_freshness(series):
    old = series([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3), ("2024-01-04", 0.0)])
    new = series([("2024-01-02", 2), ("2024-01-03", 4), ("2024-01-04", -0.0), ("2024-01-05", 5)])
    got = {r["date"].day: r["state"] for r in rows(store.version_diff(old, new))}
    assert got == {1: "absent", 2: "unchanged", 3: "corrected", 4: "unchanged", 5: "new"}
    assert [r["value"] for r in rows(store.merge_keep_last(old, new), "date")] == [1, 2, 4, 0, 5]
    f = series([("2024-01-05", 1), ("2024-01-20", 1)])
    assert [rows(store.freshness(f, D(d), 2))[0]["stale"] for d in ("2024-01-07", "2024-01-08")] == [False, True]
    assert rows(store.freshness(f, D("2023-01-01"), 2))[0]["stale"]


def test_contract_rejects(spark, series):
    good = [("2024-01-01", 1), ("2024-01-02", 2)]
    assert contract.validate(series(good)) is not None
    for bad in ([*good, ("2030-01-01", math.nan)], [*good, ("2030-01-01", math.inf)], [*good, ("2024-01-02", 3)], []):
        df = series(bad)
        with pytest.raises(ValueError, match="nonfinite_value|duplicate_date|empty_data"):
            contract.validate(df)
        if not bad:
            continue
        with pytest.raises(Exception, match="contract"):  # rows after the cutoff count too
            monthly.seasonal_profile(df, D("2024-06-01"), 5).collect()
    with pytest.raises(ValueError, match="date"):
        monthly.seasonal_profile(series(good), dt.datetime(2024, 1, 1), 5)
    with pytest.raises(ValueError, match="positive integer"):
        monthly.seasonal_profile(series(good), D("2024-01-01"), True)
    with pytest.raises(Exception, match="contract"):
        monthly.monthly_returns(series([*good, ("2030-01-01", 0)]), D("2024-06-01")).collect()


def test_quality_report(spark):
    day = D("2024-01-01")
    df = spark.createDataFrame([("s", day, 1.0, 0), ("s", day, 2.0, 1), ("s", None, 1.0, 2), ("s", D("2024-01-02"), None, 3), ("s", D("2024-01-03"), math.inf, 4), ("s", D("2024-01-04"), 3.0, 5)], "series_id string, date date, value double, row long")
    assert [(r["row"], r["code"]) for r in rows(contract.quality_report(df), "row")] == [(0, "duplicate_date"), (1, "duplicate_date"), (2, "missing_date"), (3, "missing_value"), (4, "nonfinite_value")]


def test_overflow_raises(daily):
    with pytest.raises(Exception, match="numeric range"):
        technical.interval_changes(daily([1e-300, 1e300]), D("2030-01-01")).collect()


def test_scalars(spark):
    assert scalars.shift_months(D("2024-03-31"), 1) == D("2024-02-29") and scalars.shift_months(D("0001-01-31"), 1) == dt.date(1, 1, 1)
    df = spark.createDataFrame([(1,), (59,), (60,), (61,)], "n int").select(scalars.excel_date(F.col("n")).alias("d"))
    assert [r["d"] for r in df.collect()] == [D("1900-01-01"), D("1900-02-28"), None, D("1900-03-01")]
    text = spark.createDataFrame([("1,5",), ("1.5",), ("NaN",), ("1e400",), ("-.5e1",), ("1 000",)], "t string")
    assert [r[0] for r in text.select(scalars.number(F.col("t"))).collect()] == [None, 1.5, None, None, -5.0, None]
    assert [r[0] for r in text.select(scalars.number(F.col("t"), ",")).collect()][0] == 1.5
    years = spark.createDataFrame([("2025/26",), ("1999/00",), ("2025/27",), ("25/26",), (None,)], "y string")
    assert [r[0] for r in years.select(scalars.marketing_year_ok(F.col("y"))).collect()] == [True, True, False, False, False]


def test_plans_have_no_row_python_and_partitioned_windows(spark):
    from almanac.plans.queries import QUERIES

    for name in ("technical", "volatility", "seasonal_profile", "rolling_correlation", "var_es", "fundamental_revisions"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


# ---------------------------------------------------------------- numeric extremes


def _overflows(df):
    with pytest.raises(Exception, match="numeric range"):
        df.collect()


def test_overflow_is_never_passed_on(spark):
    rows = lambda *pairs: spark.createDataFrame([("w", dt.date.fromisoformat(d), v) for d, v in pairs], "series_id string, date date, value double")
    as_of = dt.date(2026, 1, 15)
    same = rows(("2025-01-01", 1e308), ("2025-01-02", 1e308))
    _overflows(monthly.monthly_means(contract.visible(same, as_of)))
    _overflows(monthly.seasonal_profile(rows(("2024-01-01", 1e308), ("2025-01-01", 1e308)), as_of, 5))
    _overflows(monthly.seasonal_current(rows(("2025-01-01", -1e308), ("2026-01-01", 1e308)), as_of, 5))
    _overflows(monthly.partial_month_summary(rows(("2024-01-01", 1e308), ("2025-01-01", 1e308)), as_of, 2))
    _overflows(monthly.recent_year_mean(rows(("2022-01-01", 1e308), ("2026-01-01", 1e308)), as_of))
    _overflows(monthly.monthly_returns(rows(("2025-01-01", 1e-308), ("2025-02-01", 1e308)), as_of))
    _overflows(monthly.normalized_profile(rows(("2025-01-01", 1e-308), ("2025-02-01", 1e308)), as_of, 1))
    _overflows(technical.technical(rows(*[(f"20{k:02d}-01-01", (-1) ** k * 1e308) for k in range(20)]), as_of))
    _overflows(technical.snapshot_changes(rows(("2024-12-31", -1.7e308), ("2025-01-01", 1.7e308)), as_of))
    _overflows(technical.rsi(rows(*[(f"20{k:02d}-01-01", (-1) ** k * 1.7e308) for k in range(20)]), as_of))
    _overflows(technical.interval_changes(rows(("2024-12-31", 1e-300), ("2025-01-01", 1e300)), as_of))
    fx = rows(("2025-01-01", 10.0), ("2025-01-02", 10.0))
    _overflows(market.fx_convert(same, fx, as_of))
    _overflows(market.fx_attribution(same, fx, as_of))
    one = spark.range(1)
    _overflows(one.select(*scalars.scenario(F.lit(1.7e308), F.lit(4.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).values()))


def test_means_and_roots_of_extremes(spark):
    mean = lambda *v: spark.createDataFrame([(x,) for x in v], "v double").agg(scalars.safe_mean(F.col("v")), scalars.root_mean_square(F.col("v"))).first()
    assert mean(1e308, 1e308)[0] == 1e308 and mean(1e308, -1e308)[0] == 0 and mean(1.7e308, 1.5e308, None)[0] == pytest.approx(1.6e308)
    assert mean(3.0, 4.0) == (3.5, math.sqrt(12.5)) and mean(5e-324, 5e-324)[0] == 5e-324 and mean()[0] is None
    assert mean(3e200, 4e200)[1] == pytest.approx(math.sqrt(12.5) * 1e200) and mean(3e-200, 4e-200)[1] == pytest.approx(math.sqrt(12.5) * 1e-200)
    assert mean(0.0, 0.0)[1] == 0


def test_errors_of_extremes(spark):
    rows = spark.createDataFrame([("w", dt.date(2020, 1, 1) + dt.timedelta(k), 1e200 if k % 2 else 2e200) for k in range(60)], "series_id string, date date, value double")
    got = {r["model"]: r for r in forecast.walk_forward(rows, dt.date(2021, 1, 1), min_training=20, horizons=(1,)).collect()}
    assert got["naive"]["mae"] == pytest.approx(1e200) and got["naive"]["rmse"] == pytest.approx(1e200) and got["naive"]["rmse_skill"] == 0


def test_relative_strength_of_a_long_series(spark):
    """The listed recurrence against a plain loop, over several blocks."""
    import random

    rng, n = random.Random(5), 14
    values = [100.0]
    for _ in range(1300):
        values.append(values[-1] + rng.choice([-2.0, -0.5, 0.0, 1.0, 1.5]))
    rows = spark.createDataFrame([("w", dt.date(2000, 1, 1) + dt.timedelta(k), v) for k, v in enumerate(values)] + [("short", dt.date(2000, 1, 1), 1.0)] + [("flat", dt.date(2000, 1, 1) + dt.timedelta(k), 1.0) for k in range(20)], "series_id string, date date, value double")
    gain = loss = 0.0
    expected = [None] * n
    changes = [b - a for a, b in zip(values, values[1:], strict=False)]
    for k, c in enumerate(changes, 1):
        up, down = max(c, 0), max(-c, 0)
        if k <= n:
            gain, loss = gain + up / n, loss + down / n
        else:
            gain, loss = (gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n
        if k >= n:
            expected.append(100 - 100 / (1 + gain / loss))
    got = {s: [r["rsi14"] for r in technical.rsi(rows, dt.date(2010, 1, 1)).filter(F.col("series_id") == s).orderBy("date").collect()] for s in ("w", "short", "flat")}
    assert got["w"][:n] == expected[:n] and got["w"][n:] == pytest.approx(expected[n:]) and got["short"] == [None] and got["flat"] == [None] * n + [50.0] * 6


def test_pairs_on_request(spark):
    rows = spark.createDataFrame([(s, dt.date(2024, 1, 1) + dt.timedelta(k), float(k + 1 + j)) for j, s in enumerate("abc") for k in range(5)], "series_id string, date date, value double")
    as_of = dt.date(2024, 2, 1)
    every = {(r["left_id"], r["right_id"], r["date"]): (r["left_pct"], r["right_pct"]) for r in market.matched_intervals(rows, as_of).collect()}
    assert len(every) == 12
    some = market.matched_intervals(rows, as_of, [("c", "a"), ("a", "b"), ("a", "none")]).collect()
    assert len(some) == 8 and all((r["left_pct"], r["right_pct"]) == (every[("a", "c", r["date"])][::-1] if r["left_id"] == "c" else every[("a", "b", r["date"])]) for r in some)
    assert market.correlation_matrix(rows, as_of, 3, pairs=[("c", "a")]).count() == 1
    many = spark.range(13).crossJoin(spark.range(3).withColumnRenamed("id", "k")).select(F.col("id").cast("string").alias("series_id"), F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("k").cast("int")).alias("date"), (F.col("k") + 1.0).alias("value"))
    with pytest.raises(Exception, match="name the pairs"):
        market.matched_intervals(many, as_of).collect()
    for bad in ([], [("a", "a")]):
        with pytest.raises(ValueError):
            market.matched_intervals(rows, as_of, bad)


def test_quality_report_of_columns(spark):
    codes = lambda df: sorted((r["code"], r["row"]) for r in contract.quality_report(df).collect())
    text = spark.createDataFrame([("w", "2024-01-01", 1.0, 1), ("w", "2024-01-01", None, 2)], "series_id string, date string, value double, row long")
    assert codes(text) == [("invalid_date_type", None), ("missing_value", 2)]
    flag = spark.createDataFrame([("w", dt.date(2024, 1, 1), True, 1), ("w", None, False, 2)], "series_id string, date date, value boolean, row long")
    assert codes(flag) == [("invalid_value_type", None), ("missing_date", 2)]
    twice = spark.createDataFrame([("w", dt.date(2024, 1, 1), 1.0, 1)], "series_id string, date date, value double, row long").selectExpr("*", "value")
    assert codes(twice) == [("duplicate_columns", None), ("invalid_value_type", None)]
    assert codes(spark.createDataFrame([(1,)], "row long")) == [("invalid_date_type", None), ("invalid_value_type", None)]
