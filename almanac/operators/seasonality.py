"""Return seasonality over completed years, with block-bootstrap intervals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import pct, safe_mean
from .contract import finite_results, visible

MASK = 0xFFFFFFFF
LEAST_YEARS = 8
VALID_SHARE = 0.9
PARTS = 16  # tasks that share a series' replicates


def _years(rows: DataFrame, df: DataFrame, as_of: dt.date, years: int | str) -> DataFrame:
    """series_id, first and number of declared years, and the last year of the early half."""
    if years not in (5, 10, "all"):
        raise ValueError("years must be 5, 10 or 'all'")
    if years == "all":
        done = rows.filter(F.year("date") < as_of.year).groupBy("series_id").agg(F.min(F.year("date")).alias("first"))
        spans = df.select("series_id").distinct().join(done, "series_id", "left").select("series_id", F.coalesce("first", F.lit(as_of.year)).alias("first"))
    else:
        if as_of.year - years < 1:
            raise ValueError("the window must start in year 1 or later")
        spans = df.select("series_id").distinct().select("series_id", F.lit(as_of.year - years).alias("first"))
    spans = spans.withColumn("years", F.lit(as_of.year) - F.col("first"))
    spans = spans.withColumn("years", F.when(F.col("years") > 100, F.raise_error(F.lit("at most 100 years are supported")).cast("int")).otherwise(F.col("years")))
    return spans.withColumn("split", F.col("first") + F.floor(F.col("years") / 2).cast("int") - 1)


def return_grid(df: DataFrame, as_of: dt.date, years: int | str = 10) -> DataFrame:
    """Each declared year and month: change of the month's last value from the calendar month before, and why there is none.

    state is ok, missing_month_close, missing_previous_month or nonpositive_month_endpoints.
    """
    rows = visible(df, as_of)
    spans = _years(rows, df, as_of, years)
    closes = rows.groupBy("series_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.max_by("value", "date").alias("close"))
    # the month before the first one too, for its close alone
    grid = spans.select("series_id", "split", "years", "first", F.explode(F.sequence(F.lit(-1), F.col("years") * 12 - 1)).alias("k"))
    grid = grid.withColumn("year", F.col("first") + F.floor(F.col("k") / 12).cast("int")).withColumn("month", F.pmod("k", F.lit(12)) + 1)
    out = grid.join(closes, ["series_id", "year", "month"], "left").withColumn("before", F.lag("close").over(W.partitionBy("series_id").orderBy("k"))).filter("k >= 0")
    state = F.when(F.col("close").isNull(), "missing_month_close").when(F.col("before").isNull(), "missing_previous_month").when((F.col("close") <= 0) | (F.col("before") <= 0), "nonpositive_month_endpoints").otherwise("ok")
    return out.select("series_id", "year", "month", pct(F.col("close"), F.col("before")).alias("change"), state.alias("state"), "split", "years", "first")


def seasonality_omissions(df: DataFrame, as_of: dt.date, years: int | str = 10) -> DataFrame:
    """How many months have no change, by reason."""
    return return_grid(df, as_of, years).groupBy("series_id").agg(*[F.count_if(F.col("state") == k).alias(k) for k in ("ok", "missing_month_close", "missing_previous_month", "nonpositive_month_endpoints")])


@finite_results
def return_seasonality(df: DataFrame, as_of: dt.date, years: int | str = 10) -> DataFrame:
    """For each month over the declared years: mean, median, extremes, share of rises, halves, and the range of means with one year left out."""
    rows = return_grid(df, as_of, years)
    whole = W.partitionBy("series_id", "month")
    n = F.count("change").over(whole)
    left = F.when((n >= 2) & F.col("change").isNotNull(), (F.sum("change").over(whole) - F.col("change")) / (n - 1))
    rows = rows.withColumn("left_out", left)
    early, late = F.col("year") <= F.col("split"), F.col("year") > F.col("split")
    out = rows.groupBy("series_id", "month").agg(
        safe_mean(F.col("change")).alias("mean"), F.percentile("change", 0.5).alias("median"), F.count("change").alias("year_count"), F.count_if(F.col("change") > 0).alias("positive_count"),
        F.min("change").alias("minimum"), F.max("change").alias("maximum"),
        safe_mean(F.when(early, F.col("change"))).alias("early_mean"), F.count(F.when(early, F.col("change"))).alias("early_count"),
        safe_mean(F.when(late, F.col("change"))).alias("late_mean"), F.count(F.when(late, F.col("change"))).alias("late_count"),
        F.min("left_out").alias("leave_one_out_minimum"), F.max("left_out").alias("leave_one_out_maximum"),
    )
    return out.withColumn("positive_fraction", F.try_divide("positive_count", "year_count"))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, in halves so that a long holds it."""
    low, high = a.bitwiseAND(F.lit(65535)), F.shiftrightunsigned(a, 16)
    return (low * b + ((high * b).bitwiseAND(F.lit(65535))) * 65536).bitwiseAND(F.lit(MASK))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def draw(seed: int, k: Column) -> Column:
    """The k-th draw (from 0) of a counter-based generator of 32 bits, in [0, 1)."""
    first = lambda x: _times(x.bitwiseXOR(F.shiftrightunsigned(x, 15)), x.bitwiseOR(F.lit(1)))
    second = lambda v: v.bitwiseXOR((v + _times(v.bitwiseXOR(F.shiftrightunsigned(v, 7)), v.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)))
    last = lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 14)) / 4294967296.0
    state = (F.lit(seed).cast("long") + (k.cast("long") + 1) * 0x6D2B79F5).bitwiseAND(F.lit(MASK))
    return _let(_let(_let(state, first), second), last)


@finite_results
def bootstrap_interval(df: DataFrame, as_of: dt.date, years: int | str = "all", replicates: int = 1000, seed: int = 20261008) -> DataFrame:
    """2.5 and 97.5 per cent quantiles of each month's mean over resampled years: non-circular blocks of two years, the last cut short.

    Draws are numbered, so all replicates of all series run at once. Months with fewer than eight
    contributing years, or nine tenths of the replicates, have none.
    """
    if not 1 <= replicates <= 2000 or not 0 <= seed <= MASK:
        raise ValueError("replicates are 1 to 2000 and the seed has 32 bits")
    grid = return_grid(df, as_of, years)
    months = grid.groupBy("series_id", "month").agg(F.count("change").alias("year_count"))
    vectors = grid.groupBy("series_id", "years", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "month", "change"))), lambda r: r["change"]).alias("v")).filter("years >= 2")
    # a series' values go to PARTS tasks, each of which has its share of the replicates
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))
    rows = vectors.select("series_id", "years", "v", F.ceil(F.col("years") / 2).cast("long").alias("blocks"), parts.alias("part")).repartition("series_id", "part")
    rows = rows.withColumn("r", F.explode(F.filter(F.sequence(F.col("part"), F.lit(replicates + PARTS - 1).cast("long"), F.lit(PARTS).cast("long")), lambda r: r < replicates)))
    # the years of a replicate: of each block the start and the one after it, the last block cut short
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.floor(draw(seed, F.col("r") * F.col("blocks") + j) * (F.col("years") - 1)).cast("int") * 12)
    picks = F.slice(F.flatten(F.transform(starts, lambda at: F.array(at, at + 12))), 1, F.col("years"))
    rows = rows.select("series_id", "v", picks.alias("picks"))

    def mean(month):
        add = lambda a, y: F.when(F.get("v", y + month).isNull(), a).otherwise(F.struct((a["s"] + F.get("v", y + month)).alias("s"), (a["n"] + 1).alias("n")))
        return F.aggregate("picks", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), add, lambda a: F.try_divide(a["s"], a["n"]))

    means = rows.select("series_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(11)), mean)).alias("m", "mean")).select("series_id", (F.col("m") + 1).alias("month"), "mean")
    q = means.groupBy("series_id", "month").agg(F.percentile("mean", [0.025, 0.975]).alias("q"), F.count("mean").alias("valid"))
    out = months.join(q, ["series_id", "month"], "left")
    enough = F.col("year_count") >= LEAST_YEARS
    good = enough & (F.col("valid") >= VALID_SHARE * replicates)
    return out.select("series_id", "month", "year_count", F.when(enough, F.col("valid")).otherwise(0).cast("long").alias("valid_replicates"), F.when(good, F.col("q")[0]).alias("low"), F.when(good, F.col("q")[1]).alias("high"))
