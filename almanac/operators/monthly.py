"""Monthly and seasonal aggregation. Years weigh alike: first a mean for each year and month, then over years."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite, month_status, pct, window_start
from .contract import finite_results, visible


def _year() -> Column:
    return F.year("date").alias("year")


def _month() -> Column:
    return F.month("date").alias("month")


@finite_results
def monthly_means(rows: DataFrame) -> DataFrame:
    """Mean, number and last value of each year and month that has observations."""
    return rows.groupBy("series_id", _year(), _month()).agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.max_by("value", "date").alias("last"))


def _months() -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(12)))


def monthly_grid(rows: DataFrame) -> DataFrame:
    """Every month of every year from a series' first to its last; months without observations have a null mean and n 0."""
    means = monthly_means(rows)
    years = means.groupBy("series_id").agg(F.min("year").alias("a"), F.max("year").alias("b")).select("series_id", F.explode(F.sequence("a", "b")).alias("year"))
    grid = years.select("*", _months().alias("month"))
    return grid.join(means, ["series_id", "year", "month"], "left").select("series_id", "year", "month", "mean", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _series_months(df: DataFrame) -> DataFrame:
    """Twelve rows for each series of the whole input, so that one without visible rows is there too."""
    return df.select("series_id").distinct().select("series_id", _months().alias("month"))


def _past(means: DataFrame, as_of: dt.date, years: int) -> DataFrame:
    return means.filter(F.col("year").between(window_start(as_of, years), as_of.year - 1))


@finite_results
def profile_of(means: DataFrame, grid: DataFrame, as_of: dt.date, years: int) -> DataFrame:
    stats = _past(means, as_of, years).groupBy("series_id", "month").agg(F.avg("mean").alias("mean"), F.min("mean").alias("minimum"), F.max("mean").alias("maximum"), F.count("mean").alias("year_count"), F.sum("n").alias("observation_count"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("year_count", "observation_count")]
    return grid.join(stats, ["series_id", "month"], "left").select("series_id", "month", "mean", "minimum", "maximum", *zero)


def seasonal_profile(df: DataFrame, as_of: dt.date, years: int = 10) -> DataFrame:
    """Twelve rows a series over exactly the given years before the cutoff's; absent years never extend the window."""
    window_start(as_of, years)
    return profile_of(monthly_means(visible(df, as_of)), _series_months(df), as_of, years)


@finite_results
def current_of(means: DataFrame, profile: DataFrame, as_of: dt.date) -> DataFrame:
    now = means.filter(F.col("year") == as_of.year).select("series_id", "month", F.col("mean").alias("current"), "n")
    out = profile.select("series_id", "month", F.col("mean").alias("base")).join(now, ["series_id", "month"], "left")
    return out.select("series_id", "month", F.col("current").alias("mean"), F.coalesce("n", F.lit(0).cast("long")).alias("observation_count"), (F.col("current") - F.col("base")).alias("difference"), month_status(as_of.year, F.col("month"), as_of).alias("calendar_status"))


def seasonal_current(df: DataFrame, as_of: dt.date, years: int = 10) -> DataFrame:
    """The cutoff year's months against the profile."""
    means = monthly_means(visible(df, as_of))
    return current_of(means, profile_of(means, _series_months(df), as_of, years), as_of)


@finite_results
def seasonal_distribution(df: DataFrame, as_of: dt.date, years: int = 10) -> DataFrame:
    """Mean, median and linear quartiles over yearly monthly means of completed years."""
    q = _past(monthly_means(visible(df, as_of)), as_of, years).groupBy("series_id", "month").agg(F.avg("mean").alias("mean"), F.percentile("mean", [0.25, 0.5, 0.75]).alias("q"), F.count("*").alias("year_count"), F.sum("n").alias("observation_count"))
    out = _series_months(df).join(q, ["series_id", "month"], "left")
    return out.select("series_id", "month", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("year_count", "observation_count")])


def year_bases(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Each year's first visible observation. The whole input must be positive."""
    rows = visible(df, as_of, positive=True)
    return rows.groupBy("series_id", _year()).agg(F.min("date").alias("base_date"), F.min_by("value", "date").alias("base_value"))


@finite_results
def normalized_profile(df: DataFrame, as_of: dt.date, years: int = 10) -> DataFrame:
    """The seasonal profile of each year's path from 100 at its first observation. The whole input must be positive."""
    rows = visible(df, as_of, positive=True).withColumn("year", F.year("date"))
    first = F.first("value").over(W.partitionBy("series_id", "year").orderBy("date"))
    indexed = rows.select("series_id", "date", finite(F.col("value") / first * 100, "Year normalization").alias("value"))
    return profile_of(monthly_means(indexed), _series_months(df), as_of, years)


@finite_results
def partial_month_years(df: DataFrame, as_of: dt.date, years: int = 5) -> DataFrame:
    """For the cutoff's year and each of the years before: the mean of the cutoff's month up to its day (or the month's last)."""
    start = window_start(as_of, years)
    rows = visible(df, as_of).filter(F.col("date") >= F.lit(dt.date(start, as_of.month, 1))).filter(F.month("date") == as_of.month).filter(F.dayofmonth("date") <= as_of.day)
    stats = rows.groupBy("series_id", _year()).agg(F.avg("value").alias("mean"), F.count("*").alias("observation_count"))
    grid = df.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(start), F.lit(as_of.year))).alias("year"))
    first = F.make_date("year", F.lit(as_of.month), F.lit(1))
    through = F.least(F.date_add(first, as_of.day - 1), F.last_day(first))
    return grid.join(stats, ["series_id", "year"], "left").select("series_id", "year", through.alias("through_date"), "mean", F.coalesce("observation_count", F.lit(0).cast("long")).alias("observation_count"))


@finite_results
def partial_month_summary(df: DataFrame, as_of: dt.date, years: int = 5) -> DataFrame:
    """The cutoff month so far against the equal-year mean of the same days in earlier years."""
    past = F.col("year") < as_of.year
    when = lambda c: F.when(past, F.col(c))
    out = partial_month_years(df, as_of, years).groupBy("series_id").agg(F.avg(when("mean")).alias("baseline_mean"), F.min(when("mean")).alias("minimum"), F.max(when("mean")).alias("maximum"), F.count(when("mean")).alias("year_count"), F.coalesce(F.sum(when("observation_count")), F.lit(0).cast("long")).alias("baseline_observations"), F.max(F.when(~past, F.col("mean"))).alias("current_mean"), F.max(F.when(~past, F.col("observation_count"))).alias("current_observations"))
    return out.withColumn("difference", F.col("current_mean") - F.col("baseline_mean"))


def recent_years(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Monthly means of the cutoff's year and the four before, a column for each."""
    if as_of.year < 5:
        raise ValueError("the five years must start in year 1 or later")
    span = list(range(as_of.year - 4, as_of.year + 1))
    means = monthly_means(visible(df, as_of)).filter(F.col("year").between(span[0], span[-1]))
    wide = means.groupBy("series_id", "month").agg(*[F.max(F.when(F.col("year") == y, F.col("mean"))).alias(f"y{k}") for k, y in enumerate(span)])
    return _series_months(df).join(wide, ["series_id", "month"], "left")


@finite_results
def recent_year_mean(df: DataFrame, as_of: dt.date) -> DataFrame:
    """The equal-year mean of those five years, the current one included."""
    if as_of.year < 5:
        raise ValueError("the five years must start in year 1 or later")
    means = monthly_means(visible(df, as_of)).filter(F.col("year").between(as_of.year - 4, as_of.year))
    stats = means.groupBy("series_id", "month").agg(F.avg("mean").alias("mean"), F.count("*").alias("year_count"), F.sum("n").alias("observation_count"))
    return _series_months(df).join(stats, ["series_id", "month"], "left").select("series_id", "month", "mean", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("year_count", "observation_count")])


def price_matrix(df: DataFrame, as_of: dt.date, years: int = 10) -> DataFrame:
    """Monthly means of the last years against the last visible observation: lower, higher or equal, or why there is none."""
    rows = visible(df, as_of)
    last = rows.groupBy("series_id").agg(F.max_by("value", "date").alias("reference"))
    grid = _series_months(df).select("series_id", "month", F.explode(F.sequence(F.lit(as_of.year - years + 1), F.lit(as_of.year))).alias("year"))
    out = grid.join(monthly_means(rows), ["series_id", "year", "month"], "left").join(last, "series_id", "left")
    status = month_status(F.col("year"), F.col("month"), as_of)
    side = F.when(F.col("mean").isNull(), F.when(status == "after_cutoff", "future").otherwise("missing")).when(F.col("mean") < F.col("reference"), "lower").when(F.col("mean") > F.col("reference"), "higher").otherwise("equal")
    return out.select("series_id", "year", "month", "mean", side.alias("side"), (F.col("mean").isNotNull() & (status == "month_in_progress")).alias("partial"))


def _closes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series_id", F.trunc("date", "MM").alias("month_start")).agg(F.max_by("value", "date").alias("close"), F.max("date").alias("close_date"))


@finite_results
def monthly_returns(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Every calendar month from the first visible to the cutoff's: last observation and the change from the month before, null if either is missing. The whole input must be positive."""
    rows = visible(df, as_of, positive=True)
    closes = _closes(rows)
    span = closes.groupBy("series_id").agg(F.min("month_start").alias("a"))
    grid = span.select("series_id", F.explode(F.sequence("a", F.trunc(F.lit(as_of), "MM"), F.expr("interval 1 month"))).alias("month_start"))
    out = grid.join(closes, ["series_id", "month_start"], "left")
    before = F.lag("close").over(W.partitionBy("series_id").orderBy("month_start"))
    return out.select("series_id", "month_start", "close_date", "close", pct(F.col("close"), before).alias("return_pct"), month_status(F.year("month_start"), F.month("month_start"), as_of).alias("calendar_status"))


def return_heatmap(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Monthly returns as a row for each year and a column for each month."""
    rows = monthly_returns(df, as_of)
    return rows.groupBy("series_id", F.year("month_start").alias("year")).agg(*[F.max(F.when(F.month("month_start") == m, F.col("return_pct"))).alias(f"m{m:02d}") for m in range(1, 13)])


def coverage(df: DataFrame, as_of: dt.date) -> DataFrame:
    """First and last date, age in days, and calendar months between without an observation."""
    rows = visible(df, as_of)
    out = rows.groupBy("series_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("observation_count"), F.count_distinct(F.trunc("date", "MM")).alias("months"))
    span = F.months_between(F.trunc("last_date", "MM"), F.trunc("first_date", "MM")).cast("long") + 1
    return out.select("series_id", "first_date", "last_date", "observation_count", F.datediff(F.lit(as_of), "last_date").alias("age_days"), (span - F.col("months")).alias("missing_months"))


def display_range(rows: DataFrame, as_of: dt.date, days: int | None = None) -> DataFrame:
    """The last so many days up to the cutoff of a finished frame; windows are warm before the crop."""
    return rows if days is None else rows.filter(F.col("date") >= F.date_sub(F.lit(as_of), days))


