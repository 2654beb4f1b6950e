"""Supply balances by publication: each key is a commodity, region and marketing year; each publication a vintage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cutoff, marketing_year_ok
from .contract import finite_results

KEY = ("commodity", "region", "marketing_year")


def validate(rows: DataFrame) -> DataFrame:
    """rows themselves; raises ValueError if a field is missing or out of range, a vintage is there twice or a key has two units."""
    bad = F.lit(False)
    for c in ("publication_date", *KEY, "unit", "ending_stocks", "total_use"):
        bad = bad | F.col(c).isNull()
    for c in ("commodity", "region", "unit"):
        bad = bad | (F.trim(c) != F.col(c)) | (F.length(c) == 0) | (F.length(c) > 80)
    bad = bad | ~marketing_year_ok(F.col("marketing_year")) | (F.col("ending_stocks") < 0) | (F.col("total_use") <= 0) | F.isnan("ending_stocks") | F.isnan("total_use")
    found = rows.groupBy(*KEY, "publication_date").agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.min("unit").alias("u0"), F.max("unit").alias("u1"))
    found = found.groupBy(*KEY).agg(F.sum("bad").alias("bad"), F.max("n").alias("n"), (F.min("u0") != F.max("u1")).alias("units"))
    row = found.agg(F.sum("bad").alias("bad"), F.count_if(F.col("n") > 1).alias("twice"), F.count_if("units").alias("units"), F.count("*").alias("keys")).first()
    if not row["keys"]:
        raise ValueError("there are no rows")
    if row["bad"] or row["twice"] or row["units"]:
        raise ValueError(f"{row['bad']} invalid rows, {row['twice']} keys with a vintage twice, {row['units']} keys with two units")
    return rows


@finite_results
def fundamental_revisions(rows: DataFrame, as_of: dt.date) -> DataFrame:
    """Every visible vintage with its stocks-to-use ratio and how it differs from the vintage before."""
    seen = rows.filter(F.col("publication_date") <= F.lit(cutoff(as_of)))
    w = W.partitionBy(*KEY).orderBy("publication_date")
    seen = seen.withColumn("stocks_to_use_pct", F.try_divide("ending_stocks", "total_use") * 100)
    diff = lambda c: F.col(c) - F.lag(c).over(w)
    return seen.select(*KEY, "publication_date", "ending_stocks", "total_use", "stocks_to_use_pct", diff("ending_stocks").alias("ending_stocks_revision"), diff("total_use").alias("total_use_revision"), diff("stocks_to_use_pct").alias("stocks_to_use_revision_pp"))


def fundamental_latest(rows: DataFrame, as_of: dt.date) -> DataFrame:
    """The latest visible vintage of the greatest visible marketing year of each commodity and region."""
    rows = fundamental_revisions(rows, as_of)
    newest = F.row_number().over(W.partitionBy("commodity", "region").orderBy(F.desc("marketing_year"), F.desc("publication_date")))
    return rows.withColumn("_k", newest).filter("_k = 1").drop("_k")


def fundamental_counts(rows: DataFrame, as_of: dt.date) -> DataFrame:
    """For each commodity and region: rows, visible ones, later ones, and those of the greatest visible marketing year."""
    rows = rows.withColumn("seen", F.col("publication_date") <= F.lit(cutoff(as_of)))
    top = F.max(F.when(F.col("seen"), F.col("marketing_year"))).over(W.partitionBy("commodity", "region"))
    rows = rows.withColumn("top", top)
    return rows.groupBy("commodity", "region").agg(F.count("*").alias("input"), F.count_if("seen").alias("visible"), F.count_if(~F.col("seen")).alias("after_cutoff"), F.count_if(F.col("seen") & (F.col("marketing_year") == F.col("top"))).alias("selected"))
