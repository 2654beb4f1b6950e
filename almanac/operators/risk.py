"""Historical risk of observed intervals: quantile losses, histograms, extremes and paths."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import pct, safe_mean
from .contract import by_series, finite_results, obs, visible
from .technical import interval_changes

#: One over the tail's share, and the least number of intervals (five of tail mass), by confidence.
TAILS = {0.95: (20, 100), 0.99: (100, 500)}


@finite_results
def var_es(df: DataFrame, as_of: dt.date, horizon: int = 1, confidence: float = 0.95, direction: str = "buyer") -> DataFrame:
    """Value at risk by rank and expected shortfall with exactly the tail's mass, the boundary loss in part; null with too few intervals.

    A buyer loses when prices rise, a seller when they fall. Neither figure is cut off at 0.
    """
    if confidence not in TAILS or direction not in ("buyer", "seller"):
        raise ValueError("confidence is 0.95 or 0.99; direction is buyer or seller")
    parts, least = TAILS[confidence]
    loss = F.col("change") * (1 if direction == "buyer" else -1)
    rows = interval_changes(df, as_of, horizon, bounded=True).filter("change is not null").select("series_id", loss.alias("loss"), "end_date")
    rows = rows.withColumn("n", F.count("*").over(by_series())).withColumn("k", F.row_number().over(by_series().orderBy(F.desc("loss"), "end_date")))
    # rank ceil(c * n) upwards, in whole numbers, is rank n + 1 - that downwards
    up = F.ceil(F.col("n") * (parts - 1) / parts)
    mass = F.col("n") / parts
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mass - (F.col("k") - 1)))
    out = rows.groupBy("series_id", "n").agg(F.max(F.when(F.col("k") == F.col("n") + 1 - up, F.col("loss"))).alias("v"), F.sum(weight * F.col("loss")).alias("e"))
    enough = F.col("n") >= least
    return out.select("series_id", F.col("n").alias("interval_count"), mass.alias("tail_mass"), enough.alias("available"), F.when(enough, F.col("v")).alias("var"), F.when(enough, F.col("e") / mass).alias("expected_shortfall"))


@finite_results
def exposure(risk: DataFrame, budget: float) -> DataFrame:
    """What a budget may lose at the risk's figures."""
    return risk.select("series_id", (F.col("var") / 100 * budget).alias("var_amount"), (F.col("expected_shortfall") / 100 * budget).alias("es_amount"))


@finite_results
def change_histogram(df: DataFrame, as_of: dt.date, horizon: int = 1) -> DataFrame:
    """At most ten equal bins, as many as the root of the number of changes (rounded up); the last is closed; one bin if all are equal."""
    rows = interval_changes(df, as_of, horizon).filter("change is not null")
    ends = rows.groupBy("series_id").agg(F.min("change").alias("lo"), F.max("change").alias("hi"), F.count("*").alias("n"))
    ends = ends.withColumn("bins", F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.least(F.lit(10), F.ceil(F.sqrt("n")))).cast("int"))
    place = F.coalesce(F.floor(F.try_divide(F.col("change") - F.col("lo"), F.col("hi") - F.col("lo")) * F.col("bins")), F.lit(0))
    counts = rows.join(ends, "series_id").groupBy("series_id", F.greatest(F.lit(0), F.least(F.col("bins") - 1, place)).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    grid = ends.select("series_id", "lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    edge = lambda k: F.col("lo") * (1 - k / F.col("bins")) + F.col("hi") * (k / F.col("bins"))
    return grid.join(counts, ["series_id", "bin"], "left").select("series_id", "bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


@finite_results
def change_summary(df: DataFrame, as_of: dt.date, horizon: int = 1) -> DataFrame:
    """Mean and median change, and counts of intervals."""
    rows = interval_changes(df, as_of, horizon)
    return rows.groupBy("series_id").agg(safe_mean(F.col("change")).alias("mean_change"), F.percentile("change", 0.5).alias("median_change"), F.count("change").alias("valid_intervals"), F.count_if(F.col("change").isNull()).alias("nonpositive_endpoints"))


def top_moves(df: DataFrame, as_of: dt.date, horizon: int = 1, k: int = 5) -> DataFrame:
    """The k largest rises and falls; ties in order of time."""
    rows = interval_changes(df, as_of, horizon).filter("change <> 0")
    rows = rows.withColumn("kind", F.when(F.col("change") > 0, "rise").otherwise("fall"))
    rank = F.row_number().over(W.partitionBy("series_id", "kind").orderBy(F.desc(F.abs("change")), "end_date"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("series_id", "kind", "rank", "start_date", "end_date", "change")


def _extreme(df: DataFrame, as_of: dt.date, rise: bool) -> DataFrame:
    rows = visible(df, as_of).withColumn("i", F.row_number().over(obs()).cast("long"))
    rows = rows.withColumn("segment", F.count_if(F.col("value") <= 0).over(obs().rowsBetween(W.unboundedPreceding, 0))).filter("value > 0")
    before = W.partitionBy("series_id", "segment").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    sign = -1 if rise else 1
    point, key = F.struct("date", "i", "value"), F.struct((sign * F.col("value")).alias("v"), (-F.col("i")).alias("k"))
    rows = rows.withColumn("p", F.max_by(point, key).over(before)).filter("p is not null")
    rows = rows.withColumn("change", pct(F.col("value"), F.col("p.value"))).filter("change >= 0" if rise else "change <= 0")
    best = F.row_number().over(by_series().orderBy(F.desc("change") if rise else F.asc("change"), "date"))
    return rows.withColumn("_k", best).filter("_k = 1").select("series_id", F.col("p.date").alias("start_date"), F.col("date").alias("end_date"), (F.col("i") - F.col("p.i")).alias("observed_intervals"), "change")


def max_drawdown(df: DataFrame, as_of: dt.date) -> DataFrame:
    """The largest fall from an earlier peak. A level of 0 or less ends the path and a new one begins after it; earliest peak and end win ties."""
    return _extreme(df, as_of, rise=False)


def max_runup(df: DataFrame, as_of: dt.date) -> DataFrame:
    """The largest rise from an earlier trough, likewise."""
    return _extreme(df, as_of, rise=True)


def path_breaks(df: DataFrame, as_of: dt.date) -> DataFrame:
    """How many levels of 0 or less break the path."""
    return visible(df, as_of).groupBy("series_id").agg(F.count_if(F.col("value") <= 0).alias("nonpositive_path_breaks"))
