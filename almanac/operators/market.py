"""Currency conversion, attribution and comparison. Joins match exact dates, interval joins both ends; nothing is filled."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite, log_change_pct, pct, shift_months
from .contract import finite_results, obs, visible

EPSILON = 2.220446049250313e-16
MOST = 12  # series that are compared in all pairs


def _rates(fx: DataFrame, as_of: dt.date) -> DataFrame:
    """Visible rates; the whole input must be positive."""
    return visible(fx, as_of, positive=True).select("date", F.col("value").alias("rate"))


def fx_convert(prices: DataFrame, fx: DataFrame, as_of: dt.date, positive_prices: bool = False) -> DataFrame:
    """Prices times the rate of the same date. Prices may be of any sign, or only positive ones are converted."""
    rows = visible(prices, as_of).join(_rates(fx, as_of), "date")
    rows = rows.filter("value > 0") if positive_prices else rows
    return rows.select("series_id", "date", finite(F.col("value") * F.col("rate"), "Converted price").alias("value"))


def fx_convert_counts(prices: DataFrame, fx: DataFrame, as_of: dt.date) -> DataFrame:
    """Matched, unmatched and excluded observations on both sides, for each price series."""
    seen, rates = visible(prices, as_of), _rates(fx, as_of)
    own = seen.join(rates, "date", "left").groupBy("series_id").agg(F.count("rate").alias("matched"), F.count_if(F.col("rate").isNull()).alias("unmatched_price_observations"))
    late = prices.groupBy("series_id").agg(F.count_if(F.col("date") > F.lit(as_of)).alias("excluded_future_price_observations"))
    sides = [fx.agg(F.count_if(c).alias("n")).scalar() for c in (F.col("date") <= F.lit(as_of), F.col("date") > F.lit(as_of))]
    out = late.join(own, "series_id", "left").withColumns({"n": sides[0], "excluded_future_fx_observations": sides[1]})
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select("series_id", zero("matched").alias("matched"), zero("unmatched_price_observations").alias("unmatched_price_observations"), (F.col("n") - zero("matched")).alias("unmatched_fx_observations"), "excluded_future_price_observations", "excluded_future_fx_observations")


def spread(left: DataFrame, right: DataFrame, as_of: dt.date, left_unit: str, right_unit: str) -> DataFrame:
    """Left less right on exact dates; units must be the same."""
    if not left_unit or left_unit != right_unit:
        raise ValueError("a spread needs identical units")
    a, b = visible(left, as_of), visible(right, as_of)
    rows = a.select("date", F.col("value").alias("l")).join(b.select("date", F.col("value").alias("r")), "date")
    return rows.select("date", finite(F.col("l") - F.col("r"), "Spread").alias("value"))


@finite_results
def indexed_comparison(df: DataFrame, as_of: dt.date, start: dt.date) -> DataFrame:
    """Every series as 100 at the first date from start on that all of them have, on the dates that all of them have.

    A series with a level of 0 or less among those dates is null throughout.
    """
    if start > as_of:
        raise ValueError("start must not be later than as_of")
    everyone = df.agg(F.count_distinct("series_id").alias("all")).scalar()
    rows = visible(df, as_of).filter(F.col("date") >= F.lit(start))
    shared = rows.groupBy("date").agg(F.count("*").alias("n")).filter(F.col("n") == everyone).select("date")
    rows = rows.join(shared, "date")
    whole = obs().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = F.first("value").over(whole)
    return rows.select("series_id", "date", F.first("date").over(whole).alias("base_date"), F.when(F.min("value").over(whole) > 0, F.try_divide(F.col("value"), base) * 100).alias("value"))


def returns(rows: DataFrame) -> DataFrame:
    """Changes between adjacent observations with positive endpoints, from each series' own dates."""
    out = rows.select("series_id", F.lag("date").over(obs()).alias("start_date"), "date", pct(F.col("value"), F.lag("value").over(obs())).alias("return_pct"))
    return out.filter("return_pct is not null")


def matched_intervals(df: DataFrame, as_of: dt.date, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Returns of pairs of series over intervals with the same start and end.

    Of the given pairs, in the order given; without a list of all pairs, which takes MOST series
    at most (more raise when this runs): the result grows with their square.
    """
    rows = visible(df, as_of)
    if pairs is not None:
        if not pairs or any(a == b for a, b in pairs):
            raise ValueError("pairs are of two different series")
        named = F.array(*[F.struct(F.lit(a).alias("left_id"), F.lit(b).alias("right_id")) for a, b in pairs])
        r = returns(rows.filter(F.col("series_id").isin(sorted({s for pair in pairs for s in pair}))))
        # each return goes to its pairs alone, and the two of a pair meet by pair and interval
        sides = r.select("series_id", "start_date", "date", "return_pct", F.explode(named).alias("p")).filter((F.col("series_id") == F.col("p.left_id")) | (F.col("series_id") == F.col("p.right_id")))
        side = lambda name: F.max(F.when(F.col("series_id") == F.col(f"p.{name}"), F.col("return_pct")))
        met = sides.groupBy(F.col("p.left_id").alias("left_id"), F.col("p.right_id").alias("right_id"), "start_date", "date").agg(side("left_id").alias("left_pct"), side("right_id").alias("right_pct"))
        return met.filter("left_pct is not null and right_pct is not null")
    few = rows.agg(F.when(F.count_distinct("series_id") > MOST, F.raise_error(F.lit(f"name the pairs: all pairs are for {MOST} series at most")).cast("boolean")).otherwise(F.lit(True)).alias("few"))
    # all series of an interval meet once, in a list of at most MOST
    met = returns(rows.filter(few.scalar())).groupBy("start_date", "date").agg(F.array_sort(F.collect_list(F.struct("series_id", "return_pct"))).alias("r"))
    met = met.select("start_date", "date", "r", F.posexplode("r").alias("k", "a")).select("start_date", "date", "a", F.explode(F.slice("r", F.col("k") + 2, MOST)).alias("b"))
    return met.select(F.col("a.series_id").alias("left_id"), F.col("b.series_id").alias("right_id"), "start_date", "date", F.col("a.return_pct").alias("left_pct"), F.col("b.return_pct").alias("right_pct"))


def _correlation(a: str, b: str, w):
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    spread_ = over(F.stddev_samp(a)) * over(F.stddev_samp(b))
    raw = F.try_divide(over(F.covar_samp(a, b)), F.nullif(spread_, F.lit(0.0)))
    return F.when(raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))  # least and greatest pass over nulls


@finite_results
def rolling_correlation(df: DataFrame, as_of: dt.date, window: int = 60, start: dt.date | None = None, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Sample correlation over the last so many matched intervals; a constant sample is null. The crop to start comes after warming up."""
    if window < 2:
        raise ValueError("window must be 2 or more")
    order = W.partitionBy("left_id", "right_id").orderBy("date")
    w = order.rowsBetween(-(window - 1), 0)
    rows = matched_intervals(df, as_of, pairs).select("left_id", "right_id", "start_date", "date", F.when(F.row_number().over(order) >= window, _correlation("left_pct", "right_pct", w)).alias("correlation"), F.least(F.row_number().over(order), F.lit(window)).cast("long").alias("matched_interval_count"))
    return rows.filter(F.col("date") >= F.lit(start)) if start else rows


@finite_results
def correlation_matrix(df: DataFrame, as_of: dt.date, window: int = 250, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Correlation of each pair over its last so many matched intervals."""
    latest = F.row_number().over(W.partitionBy("left_id", "right_id").orderBy(F.desc("date")))
    rows = matched_intervals(df, as_of, pairs).withColumn("_k", latest).filter(F.col("_k") <= window)
    return rows.groupBy("left_id", "right_id").agg(_correlation("left_pct", "right_pct", None).alias("correlation"), F.count("*").alias("matched_interval_count"))


@finite_results
def fx_attribution(prices: DataFrame, fx: DataFrame, as_of: dt.date, start: dt.date | None = None) -> DataFrame:
    """The change in converted price from the last joint date at or before a target (a month ago) to the last one: price, rate and interaction terms.

    Points of the starting level are null unless both levels are positive.
    """
    target = start or shift_months(as_of, 1)
    joint = visible(prices, as_of).join(_rates(fx, as_of), "date")
    point = F.struct("date", F.col("value").alias("p"), F.col("rate").alias("f"))
    ends = joint.groupBy("series_id").agg(F.max(F.when(F.col("date") <= F.lit(target), point)).alias("a"), F.max(point).alias("b"), F.count("*").alias("matched_observation_count"))
    ends = ends.withColumn("b", F.when(F.col("a").isNotNull(), F.col("b")))
    p0, p1, f0, f1 = (F.col(c) for c in ("a.p", "b.p", "a.f", "b.f"))
    terms = {"commodity": (p1 - p0) * f0, "fx": p0 * (f1 - f0), "interaction": (p1 - p0) * (f1 - f0)}
    level, total = p0 * f0, p1 * f1 - p0 * f0
    share = lambda c: F.when((level > 0) & (p1 * f1 > 0), F.try_divide(c, level) * 100)
    return ends.select("series_id", F.lit(target).alias("target_date"), F.col("a.date").alias("start_date"), F.col("b.date").alias("end_date"), level.alias("start_pln"), (p1 * f1).alias("end_pln"), *[c.alias(k) for k, c in terms.items()], total.alias("total"), *[share(c).alias(f"{k}_pp") for k, c in terms.items()], share(total).alias("total_pct"), "matched_observation_count")


@finite_results
def fx_variance(prices: DataFrame, fx: DataFrame, as_of: dt.date) -> DataFrame:
    """Variance of log changes of price times rate over intervals that both have: parts, covariance, contributions and shares.

    Shares are null where the whole variance is within the resolution of the logs.
    """
    logs = lambda rows: rows.select("series_id", F.lag("date").over(obs()).alias("start_date"), "date", log_change_pct(F.col("value"), F.lag("value").over(obs())).alias("c")).filter("c is not null")
    a = logs(visible(prices, as_of))
    b = logs(visible(fx, as_of)).select("start_date", "date", F.col("c").alias("f"))
    rows = a.join(b, ["start_date", "date"]).withColumn("z", F.col("c") + F.col("f"))
    out = rows.groupBy("series_id").agg(F.count("*").alias("paired_intervals"), F.var_samp("c").alias("var_commodity"), F.var_samp("f").alias("var_fx"), F.covar_samp("c", "f").alias("covariance"), F.var_samp("z").alias("total_variance"), F.covar_samp("c", "z").alias("commodity_contribution"), F.covar_samp("f", "z").alias("fx_contribution"), F.greatest(F.lit(100.0), F.max(F.abs("c")), F.max(F.abs("f"))).alias("_scale"))
    real = F.col("total_variance") > F.pow(32 * EPSILON * F.col("_scale"), 2)
    shares = [F.when(real, F.try_divide(F.col(f"{k}_contribution"), F.col("total_variance")) * 100).alias(f"{k}_share") for k in ("commodity", "fx")]
    return out.select("series_id", "paired_intervals", "var_commodity", "var_fx", "covariance", "total_variance", "commodity_contribution", "fx_contribution", *shares)


def compatible_rates(series: DataFrame) -> DataFrame:
    """For each price series (series_id, unit, provenance, group): the EUR/PLN series of the same provenance and group that converts it."""
    s = series.filter("unit = 'EUR/t'").alias("s")
    r = series.filter("unit = 'PLN per EUR'").alias("r")
    return s.join(r, (F.col("s.provenance") == F.col("r.provenance")) & (F.col("s.group") == F.col("r.group"))).select(F.col("s.series_id").alias("series_id"), F.col("r.series_id").alias("fx_id"))


@finite_results
def cross_rate(rates: DataFrame) -> DataFrame:
    """EUR_PLN, EUR_USD and USD_PLN series from rows (date, currency, rate) of euro reference rates, on dates that have both."""
    pair = rates.groupBy("date").agg(F.max(F.when(F.col("currency") == "PLN", F.col("rate"))).alias("pln"), F.max(F.when(F.col("currency") == "USD", F.col("rate"))).alias("usd")).filter("pln is not null and usd is not null")
    rows = F.array(F.struct(F.lit("EUR_PLN").alias("series_id"), F.col("pln").alias("value")), F.struct(F.lit("EUR_USD").alias("series_id"), F.col("usd").alias("value")), F.struct(F.lit("USD_PLN").alias("series_id"), F.try_divide("pln", "usd").alias("value")))
    return pair.select("date", F.explode(rows).alias("s")).select("s.series_id", "date", "s.value")
