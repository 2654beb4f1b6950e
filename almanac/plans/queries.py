"""Each query: an operator over a driver view, with results rounded for comparison between engines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import contract, forecast, fundamentals, market, monthly, risk, seasonality, store, technical
from ..sources import driver_tables as t

A, L = t.AS_OF, t.AS_OF_LONG
START = dt.date(2000, 6, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to so many decimals; negative zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, digits: int = 4):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        return f

    return register


def _over(view, name: str, operator, *args, digits: int = 4, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(operator(view(spark, sf_dir), *args, **options), digits)


def _with_fx(name: str, operator, *args, digits: int = 4, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(operator(t.prices(spark, sf_dir), t.fx(spark, sf_dir), *args, **options), digits)


# monthly and seasonal
_over(t.prices, "monthly_means", lambda df: monthly.monthly_means(contract.visible(df, A)).select("series_id", "year", "month", "mean", "n", "last"))
_over(t.gappy_prices, "monthly_grid", lambda df: monthly.monthly_grid(contract.visible(df, A)))
_over(t.prices, "seasonal_profile", monthly.seasonal_profile, A, 10)
_over(t.prices, "seasonal_current", monthly.seasonal_current, A, 5)
_over(t.prices, "seasonal_distribution", monthly.seasonal_distribution, A, 10)
_over(t.prices, "year_bases", monthly.year_bases, A)
_over(t.prices, "normalized_profile", monthly.normalized_profile, A, 5)
_over(t.prices, "partial_month_years", monthly.partial_month_years, A, 5)
_over(t.prices, "partial_month_summary", monthly.partial_month_summary, A, 5)
_over(t.prices, "recent_years", monthly.recent_years, A)
_over(t.prices, "recent_year_mean", monthly.recent_year_mean, A)
_over(t.gappy_prices, "price_matrix", monthly.price_matrix, A)
_over(t.gappy_prices, "monthly_returns", monthly.monthly_returns, A, digits=6)
_over(t.gappy_prices, "return_heatmap", monthly.return_heatmap, A, digits=6)
_over(t.gappy_prices, "coverage", monthly.coverage, A)

# windows
_over(t.prices, "technical", technical.technical, A)
_over(t.prices, "bollinger_exact", technical.bollinger_exact, A)
_over(t.prices, "moving_averages", technical.moving_averages, A)
_over(t.prices, "volatility", technical.volatility, A, digits=6)
_over(t.prices, "rsi14", technical.rsi, A, digits=6)
_over(t.prices, "rsi_last", technical.rsi_last, A, digits=6)
_over(t.signed_prices, "interval_changes", technical.interval_changes, A, 5, digits=6)
_over(t.signed_prices, "interval_counts", technical.interval_counts, A, 5)
_over(t.prices, "indicator_availability", technical.indicator_availability, A)
_over(t.prices, "display_range", lambda df: monthly.display_range(technical.technical(df, A), A, 90))
_over(t.prices, "level_position", technical.level_position, A, digits=6)
_over(t.prices, "snapshot_changes", technical.snapshot_changes, A, digits=6)
_over(t.prices, "market_snapshot", technical.market_snapshot, A, digits=6)

# joins
_with_fx("fx_convert", market.fx_convert, A)
_with_fx("fx_convert_counts", market.fx_convert_counts, A)
QUERIES["fx_convert_positive"] = lambda spark, sf_dir: rounded(market.fx_convert(t.signed_prices(spark, sf_dir), t.fx(spark, sf_dir), A, positive_prices=True))
_over(t.gappy_prices, "indexed_comparison", market.indexed_comparison, A, START, digits=6)
_over(t.prices, "matched_intervals", market.matched_intervals, A, digits=6)
_over(t.prices, "rolling_correlation", market.rolling_correlation, A, 20, digits=6)
_over(t.prices, "correlation_matrix", market.correlation_matrix, A, 250, digits=6)
_with_fx("fx_attribution", market.fx_attribution, A)
_with_fx("fx_variance", market.fx_variance, A, digits=6)


@query("spread")
def _spread(spark, sf_dir):
    rows = t.prices(spark, sf_dir)
    return market.spread(rows.filter("series_id = '1-URGENT'"), rows.filter("series_id = '2-HIGH'"), A, "units", "units")


@query("cross_rate", 6)
def _cross_rate(spark, sf_dir):
    rows = t.fx(spark, sf_dir)
    usd = rows.select("date", F.lit("USD").alias("currency"), (F.col("value") / 4).alias("rate"))
    return market.cross_rate(rows.select("date", F.lit("PLN").alias("currency"), F.col("value").alias("rate")).unionByName(usd))


@query("compatible_rates")
def _compatible(spark, sf_dir):
    rows = t.table(spark, sf_dir, "nation")
    unit = F.when(F.col("n_nationkey") % 3 == 0, "PLN per EUR").otherwise("EUR/t")
    return market.compatible_rates(rows.select(F.col("n_name").alias("series_id"), unit.alias("unit"), F.lit("USER_FILE").alias("provenance"), F.col("n_regionkey").alias("group")))


@query("scenario", 6)
def _scenario(spark, sf_dir):
    a = market.fx_convert(t.prices(spark, sf_dir), t.fx(spark, sf_dir), A).select("series_id", "date")
    rows = t.prices(spark, sf_dir).join(t.fx(spark, sf_dir).select("date", F.col("value").alias("rate")), "date").join(a, ["series_id", "date"])
    out = scalars.scenario(F.col("value"), F.col("rate"), F.lit(100.0), F.lit(1000.0), F.lit(4.0))
    return rows.select("series_id", "date", *[c.alias(k) for k, c in out.items()])


# risk
_over(t.prices, "var_es", risk.var_es, A, 1, 0.95, "buyer", digits=6)
_over(t.prices, "var_es_seller", risk.var_es, A, 5, 0.99, "seller", digits=6)
_over(t.prices, "exposure", lambda df: risk.exposure(risk.var_es(df, A, 1, 0.95, "buyer"), 1_000_000.0))
_over(t.prices, "change_histogram", risk.change_histogram, A, digits=6)
_over(t.signed_prices, "change_summary", risk.change_summary, A, digits=6)
_over(t.prices, "top_moves", risk.top_moves, A, digits=6)
_over(t.signed_prices, "max_drawdown", risk.max_drawdown, A, digits=6)
_over(t.signed_prices, "max_runup", risk.max_runup, A, digits=6)
_over(t.signed_prices, "path_breaks", risk.path_breaks, A)

# completed years and forecasts
_over(t.long_prices, "return_grid", lambda df: seasonality.return_grid(df, L, "all").drop("split", "years", "first"), digits=6)
_over(t.long_prices, "seasonality_omissions", seasonality.seasonality_omissions, L, "all")
_over(t.long_prices, "return_seasonality", seasonality.return_seasonality, L, 10, digits=6)
_over(t.long_prices, "bootstrap_interval", seasonality.bootstrap_interval, L, "all", digits=6)
_over(t.prices, "walk_forward_rows", forecast.walk_forward_rows, A)
_over(t.prices, "walk_forward", forecast.walk_forward, A)
_over(t.prices, "walk_forward_counts", forecast.walk_forward_counts, A)

# vintages, versions and the store
_over(t.vintages, "fundamental_revisions", fundamentals.fundamental_revisions, A)
_over(t.vintages, "fundamental_latest", fundamentals.fundamental_latest, A)
_over(t.vintages, "fundamental_counts", fundamentals.fundamental_counts, A)
for _name, _op in {"version_diff": store.version_diff, "version_diff_counts": store.version_diff_counts, "merge_keep_last": store.merge_keep_last, "upsert_classify": store.upsert_classify, "upsert_snapshot": store.upsert_snapshot}.items():
    QUERIES[_name] = lambda spark, sf_dir, op=_op: rounded(op(*t.versions(spark, sf_dir)))
_over(t.gappy_prices, "freshness", store.freshness, A, 7)
_over(t.prices, "read_series", lambda df: df.filter("series_id = '1-URGENT'").orderBy("date"))
_over(t.prices, "cutoff_counts", contract.cutoff_counts, A)


@query("series_catalog")
def _catalog(spark, sf_dir):
    rows = t.gappy_prices(spark, sf_dir)
    series = t.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id")).distinct().union(spark.range(1).select(F.lit("EMPTY").alias("series_id")))
    imports = t.prices(spark, sf_dir).select("series_id", F.col("date").alias("recorded_at"))
    return store.series_catalog(series, rows, imports)


# sources
@query("quality_report")
def _quality(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 97 == 0, F.lit(None)).when(F.col("o_orderkey") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice").cast("double"))
    rows = orders.select(F.col("o_orderpriority").alias("series_id"), F.when(F.col("o_orderkey") % 83 == 0, F.lit(None)).otherwise(F.col("o_orderdate").cast("date")).alias("date"), value.alias("value"), F.col("o_orderkey").alias("row"))
    return contract.quality_report(rows).select("series_id", "row", "code")


@query("instrument_filter_counts")
def _filtered(spark, sf_dir):
    rows = t.prices(spark, sf_dir)
    return rows.agg(F.count_if(F.col("series_id") == "1-URGENT").alias("selected"), F.count_if(F.col("series_id") != "1-URGENT").alias("filtered_instrument_rows"))


@query("wide_to_series")
def _wide(spark, sf_dir):
    from ..sources import sheets

    wide = t.prices(spark, sf_dir).groupBy("date").agg(*[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(c) for c, s in (("a", "1-URGENT"), ("b", "2-HIGH"), ("c", "5-LOW"))])
    return sheets.wide_to_series(wide, "date", ["a", "b", "c"])


@query("excel_serial_date")
def _serials(spark, sf_dir):
    rows = t.table(spark, sf_dir, "orders").select("o_orderkey")
    return rows.select("o_orderkey", scalars.excel_date(F.col("o_orderkey").cast("int")).alias("date_1900"), scalars.excel_date(F.col("o_orderkey").cast("int"), True).alias("date_1904"))


@query("csv_import")
def _csv(spark, sf_dir):
    from ..sources import csv_strict

    rows = t.prices(spark, sf_dir)
    text = rows.select("series_id", F.date_format("date", "dd/MM/yyyy").alias("date_text"), F.regexp_replace(F.format_string("%.2f", F.col("value")), "\\.", ",").alias("value_text"))
    return csv_strict.typed(text, "%d/%m/%Y", ",").select("series_id", "date", "value")


@query("daily_events")
def _events(spark, sf_dir):
    from ..streaming import incremental

    return incremental.daily(t.table(spark, sf_dir, "events"))
