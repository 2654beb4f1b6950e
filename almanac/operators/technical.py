"""Technical indicators and positions. Windows count observations; an incomplete window is null."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite, log_change, pct, shift_months
from .contract import by_series, finite_results, obs, visible


def _frame(n: int):
    return obs().rowsBetween(-(n - 1), 0)


def sma(n: int) -> Column:
    return F.when(F.row_number().over(obs()) >= n, F.avg("value").over(_frame(n)))


@finite_results
def technical(df: DataFrame, as_of: dt.date) -> DataFrame:
    """SMA of 20, 100 and 200 observations and bands of two population deviations about SMA20."""
    deviation = F.when(F.row_number().over(obs()) >= 20, F.stddev_pop("value").over(_frame(20)))
    rows = visible(df, as_of).select("series_id", "date", "value", sma(20).alias("sma20"), sma(100).alias("sma100"), sma(200).alias("sma200"), deviation.alias("_sd"))
    return rows.select("series_id", "date", "value", "sma20", "sma100", "sma200", (F.col("sma20") + 2 * F.col("_sd")).alias("upper"), (F.col("sma20") - 2 * F.col("_sd")).alias("lower"))


@finite_results
def bollinger_exact(df: DataFrame, as_of: dt.date, n: int = 20) -> DataFrame:
    """The bands with two passes over each window, about its first value: exact where levels are huge beside their changes."""
    window = F.collect_list("value").over(_frame(n))
    rows = visible(df, as_of).select("series_id", "date", "value", window.alias("w"))
    rows = rows.withColumn("d", F.transform("w", lambda x: x - F.get("w", F.lit(0))))
    rows = rows.withColumn("m", F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / n)
    rows = rows.withColumn("sd", F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / n))
    full = F.size("w") == n
    middle = F.get("w", F.lit(0)) + F.col("m")
    return rows.select("series_id", "date", F.when(full, middle).alias("middle"), F.when(full, F.col("sd")).alias("deviation"), F.when(full, middle + 2 * F.col("sd")).alias("upper"), F.when(full, middle - 2 * F.col("sd")).alias("lower"))


@finite_results
def moving_averages(df: DataFrame, as_of: dt.date) -> DataFrame:
    """SMA of 20 and 50 observations."""
    return visible(df, as_of).select("series_id", "date", "value", sma(20).alias("sma20"), sma(50).alias("sma50"))


BLOCK = 256  # steps of a recurrence that are listed in one go


def _listed(steps: Column) -> Column:
    """The state (gain, loss) of a recurrence after each of its steps (up, down, keep), as an array.

    A step is linear in the state, so a block of steps is too: each block is folded from 0 first,
    then the blocks' starts follow from one another, then each block is listed from its start.
    The work grows with the steps.
    """
    pair = lambda g, x: F.struct(g.alias("g"), x.alias("l"))
    zero = pair(F.lit(0.0), F.lit(0.0))
    one = lambda a, x: pair(a["g"] * x["keep"] + x["up"], a["l"] * x["keep"] + x["down"])

    def total(block):
        """(g, l, keep) of a block: what it adds, and what it leaves of the state before it."""
        start = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("l"), F.lit(1.0).alias("keep"))
        return F.aggregate(block, start, lambda a, x: F.struct((a["g"] * x["keep"] + x["up"]).alias("g"), (a["l"] * x["keep"] + x["down"]).alias("l"), (a["keep"] * x["keep"]).alias("keep")))

    def within(block, start):
        grow = lambda a, x: F.struct(one(a["at"], x).alias("at"), F.concat(a["out"], F.array(one(a["at"], x))).alias("out"))
        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast("array<struct<g:double,l:double>>").alias("out")), grow, lambda a: a["out"])

    def over(blocks):
        follow = lambda a, t: F.concat(a, F.array(pair(F.element_at(a, -1)["g"] * t["keep"] + t["g"], F.element_at(a, -1)["l"] * t["keep"] + t["l"])))
        starts = F.aggregate(F.transform(blocks, total), F.array(zero), follow)
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), within))

    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  computed once
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, BLOCK))
    return let(steps, lambda x: let(cut(x), over))


def rsi(df: DataFrame, as_of: dt.date, n: int = 14) -> DataFrame:
    """Wilder's relative strength index: the mean of the first n gains and losses, then each time one part in n of the new one and the rest of the old; in one task for each series. Null before n changes."""
    rows = visible(df, as_of).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("r"))

    def step(x, i):
        change = F.coalesce(x["value"] - F.get("r", i - 1)["value"], F.lit(0.0))
        keep = F.when(i <= n, 1.0).otherwise(1.0 - 1.0 / n)
        return F.struct((F.greatest(change, F.lit(0.0)) / n).alias("up"), (F.greatest(-change, F.lit(0.0)) / n).alias("down"), keep.alias("keep"))

    states = rows.withColumn("s", _listed(F.transform("r", step)))
    out = states.select("series_id", F.posexplode(F.arrays_zip(F.col("r")["date"].alias("date"), F.col("s")["g"].alias("g"), F.col("s")["l"].alias("l"))).alias("k", "x"))
    g, x = finite(F.col("x.g"), "Relative strength"), finite(F.col("x.l"), "Relative strength")
    top = F.greatest(g, x)
    return out.select("series_id", F.col("x.date").alias("date"), F.when(F.col("k") >= n, F.when(top == 0, 50.0).otherwise(100 * F.try_divide(g, top) / (F.try_divide(g, top) + F.try_divide(x, top)))).alias("rsi14"))


@finite_results
def rsi_last(df: DataFrame, as_of: dt.date, n: int = 14) -> DataFrame:
    """The index at each series' last observation, by a fold over its values."""
    state = lambda k, p, g, x: F.struct(k.alias("k"), p.alias("p"), g.alias("g"), x.alias("l"))
    start = state(F.lit(0), F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0))

    def step(a, v):
        change = v - a["p"]
        up, down = F.greatest(change, F.lit(0.0)) / n, F.greatest(-change, F.lit(0.0)) / n
        keep = F.when(a["k"] <= n, 1.0).otherwise((n - 1) / n)
        first = a["p"].isNull()
        return state(a["k"] + 1, v, F.when(first, 0.0).otherwise(a["g"] * keep + up), F.when(first, 0.0).otherwise(a["l"] * keep + down))

    rows = visible(df, as_of).groupBy("series_id").agg(F.max("date").alias("date"), F.transform(F.array_sort(F.collect_list(F.struct("date", "value"))), lambda r: r["value"]).alias("v"))
    rows = rows.withColumn("s", F.aggregate("v", start, step))
    g, x = F.col("s.g"), F.col("s.l")
    return rows.select("series_id", "date", F.when(F.size("v") > n, F.when(F.greatest(g, x) == 0, 50.0).otherwise(100 * F.try_divide(g, g + x))).alias("rsi14"))


@finite_results
def volatility(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Sample deviation of log changes over 20 and 60 intervals, in per cent; null if an interval in it has an endpoint of 0 or less."""
    rows = visible(df, as_of).withColumn("lc", log_change(F.col("value"), F.lag("value").over(obs())))
    out = {f"volatility{n}": F.when(F.count("lc").over(_frame(n)) == n, F.stddev_samp("lc").over(_frame(n)) * 100) for n in (20, 60)}
    return rows.select("series_id", "date", *[c.alias(k) for k, c in out.items()])


def interval_changes(df: DataFrame, as_of: dt.date, horizon: int = 1, bounded: bool = False) -> DataFrame:
    """Changes over so many observed steps: start, end, change (null if an endpoint is 0 or less)."""
    if horizon not in (1, 5, 20):
        raise ValueError("the horizon must be 1, 5 or 20 observed intervals")
    rows = visible(df, as_of, bounded=bounded)
    out = rows.select("series_id", F.lag("date", horizon).over(obs()).alias("start_date"), F.col("date").alias("end_date"), pct(F.col("value"), F.lag("value", horizon).over(obs())).alias("change"))
    return out.filter("start_date is not null")


def interval_counts(df: DataFrame, as_of: dt.date, horizon: int = 1) -> DataFrame:
    """Candidate intervals, valid ones and those left out."""
    return interval_changes(df, as_of, horizon).groupBy("series_id").agg(F.count("*").alias("candidate_intervals"), F.count("change").alias("valid_intervals"), F.count_if(F.col("change").isNull()).alias("nonpositive_endpoints"))


def indicator_availability(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Which indicators a series is long enough for."""
    rows = visible(df, as_of).groupBy("series_id").agg(F.count("*").alias("observation_count"))
    n = F.col("observation_count")
    message = F.when(n < 20, "SMA20 and bands need 20 observations").when(n < 100, "SMA100 needs 100 observations").when(n < 200, "SMA200 needs 200 observations").otherwise("all indicators are available")
    return rows.select("series_id", "observation_count", (n >= 20).alias("has_sma20"), (n >= 100).alias("has_sma100"), (n >= 200).alias("has_sma200"), message.alias("message"))


def level_position(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Midrank of the last value among those of the last one and five years: 100 * (below + half of equal) / n, the last one included."""
    return _positions(visible(df, as_of), as_of)


def _positions(rows: DataFrame, as_of: dt.date) -> DataFrame:
    rows = rows.withColumn("latest", F.last("value").over(obs().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    spans = [(name, shift_months(as_of, 12 * years)) for name, years in (("one_year", 1), ("five_year", 5))]
    spans = F.array(*[F.struct(F.lit(name).alias("span"), F.lit(start).alias("start_date")) for name, start in spans])
    rows = rows.select("*", F.explode(spans).alias("s")).filter(F.col("date") >= F.col("s.start_date"))
    below, equal = F.count_if(F.col("value") < F.col("latest")), F.count_if(F.col("value") == F.col("latest"))
    return rows.groupBy("series_id", F.col("s.span").alias("span"), F.col("s.start_date").alias("start_date")).agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"), (100 * (below + 0.5 * equal) / F.count("*")).alias("percentile"), F.count("*").alias("observation_count"))


@finite_results
def snapshot_changes(df: DataFrame, as_of: dt.date) -> DataFrame:
    """The last level against the observation before it and the last ones at or before a month ago, a quarter ago and the last year's end."""
    return _against(visible(df, as_of), as_of)


def _against(rows: DataFrame, as_of: dt.date) -> DataFrame:
    targets = {"previous": None, "month": shift_months(as_of, 1), "quarter": shift_months(as_of, 3), "ytd": dt.date(as_of.year - 1, 12, 31) if as_of.year > 1 else None}
    rank = F.row_number().over(by_series().orderBy(F.desc("date")))
    rows = rows.withColumn("_k", rank)
    refs = [F.max(F.when((F.col("_k") > 1) if k == "previous" else (F.col("date") <= F.lit(t)), F.struct("date", "value"))).alias(k) for k, t in targets.items() if k == "previous" or t]
    wide = rows.groupBy("series_id").agg(F.max(F.struct("date", "value")).alias("latest"), *refs)
    kinds = [F.struct(F.lit(k).alias("reference"), F.lit(t).cast("date").alias("target_date"), F.col(k).alias("ref")) for k, t in targets.items() if k == "previous" or t]
    long = wide.select("series_id", "latest", F.explode(F.array(*kinds)).alias("r"))
    end, start = F.col("latest.value"), F.col("r.ref.value")
    return long.select("series_id", "r.reference", "r.target_date", F.col("r.ref.date").alias("reference_date"), start.alias("reference_value"), (end - start).alias("change"), pct(end, start).alias("change_pct"))


@finite_results
def market_snapshot(df: DataFrame, as_of: dt.date) -> DataFrame:
    """One row a series: the last level, its distance from SMA200, monthly change and midranks."""
    rows = visible(df, as_of)  # checked once for all three parts
    last = rows.withColumn("sma200", sma(200)).groupBy("series_id").agg(F.max("date").alias("last_date"), F.max_by("value", "date").alias("last_value"), F.max_by("sma200", "date").alias("sma200"), F.count("*").alias("observation_count"))
    changes = _against(rows, as_of).groupBy("series_id").agg(*[F.max(F.when(F.col("reference") == k, F.col("change_pct"))).alias(f"{k}_pct") for k in ("previous", "month", "quarter", "ytd")])
    ranks = _positions(rows, as_of).groupBy("series_id").agg(*[F.max(F.when(F.col("span") == k, F.col("percentile"))).alias(f"{k}_percentile") for k in ("one_year", "five_year")])
    out = last.join(changes, "series_id", "left").join(ranks, "series_id", "left")
    return out.withColumn("distance_sma200_pct", pct(F.col("last_value"), F.col("sma200")))
