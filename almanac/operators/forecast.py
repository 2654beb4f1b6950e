"""Walk-forward scoring of fixed models on observed steps; nothing after an origin is used."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite, root_mean_square, safe_mean
from .contract import finite_results, obs, visible

MODELS = ("naive", "drift", "mean20")


@finite_results
def walk_forward_rows(df: DataFrame, as_of: dt.date, min_training: int = 200, max_origins: int = 252, horizons: tuple[int, ...] = (1, 5, 20), start: dt.date | None = None) -> DataFrame:
    """Predictions and actual values of the last origins that have a later target, for each horizon."""
    if not 20 <= min_training <= 20000 or not 1 <= max_origins <= 1000 or not horizons or set(horizons) - {1, 5, 20} or len(set(horizons)) != len(horizons):
        raise ValueError("min_training is 20 to 20000, max_origins 1 to 1000, horizons some of 1, 5 and 20")
    if start is not None and start > as_of:
        raise ValueError("start must not be later than as_of")
    rows = visible(df, as_of).select("series_id", "date", "value", (F.row_number().over(obs()) - 1).alias("i"), F.first("value").over(obs()).alias("first"), F.avg("value").over(obs().rowsBetween(-19, 0)).alias("mean20"), *[F.struct(F.lead("date", h).over(obs()).alias("date"), F.lead("value", h).over(obs()).alias("value")).alias(f"t{h}") for h in horizons])
    rows = rows.filter(F.col("i") >= min_training - 1)
    rows = rows.select("*", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"t{h}").alias("t")) for h in horizons])).alias("h")).filter("h.t.date is not null")
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start))
    rank = F.row_number().over(W.partitionBy("series_id", "h.horizon").orderBy(F.desc("date")))
    rows = rows.withColumn("_k", rank).filter(F.col("_k") <= max_origins)
    drift = F.col("value") + (F.col("value") - F.col("first")) / F.col("i") * F.col("h.horizon")
    return rows.select("series_id", "h.horizon", F.col("date").alias("origin_date"), F.col("h.t.date").alias("target_date"), F.col("h.t.value").alias("actual"), F.col("value").alias("naive"), finite(drift, "Drift prediction").alias("drift"), "mean20")


@finite_results
def walk_forward(df: DataFrame, as_of: dt.date, **options) -> DataFrame:
    """Mean absolute and root mean square error of each model, and skill against the last value (null where that has no error)."""
    rows = walk_forward_rows(df, as_of, **options)
    errors = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) - F.col("actual")).alias("error")) for m in MODELS])
    rows = rows.select("series_id", "horizon", F.explode(errors).alias("e"))
    out = rows.groupBy("series_id", "horizon", F.col("e.model").alias("model")).agg(F.count("*").alias("count"), safe_mean(F.abs("e.error")).alias("mae"), root_mean_square(F.col("e.error")).alias("rmse"))
    each = W.partitionBy("series_id", "horizon")
    base = lambda c: F.max(F.when(F.col("model") == "naive", F.col(c))).over(each)
    skill = lambda c: 1 - F.try_divide(F.col(c), F.nullif(base(c), F.lit(0.0)))
    return out.withColumns({"mae_skill": skill("mae"), "rmse_skill": skill("rmse")})


def walk_forward_counts(df: DataFrame, as_of: dt.date, min_training: int = 200, max_origins: int = 252, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Origins that could be used and those that the limit leaves out, for each horizon."""
    n = visible(df, as_of).groupBy("series_id").agg(F.count("*").alias("n"))
    rows = n.select("series_id", "n", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    eligible = F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("horizon") - min_training + 1)
    return rows.select("series_id", "horizon", eligible.alias("eligible_origins"), F.least(eligible, F.lit(max_origins).cast("long")).alias("count"), F.greatest(F.lit(0).cast("long"), eligible - max_origins).alias("limited_origins"))
