"""The contract of a prepared series, the quality report, and the cutoff.

The whole input is checked before the cutoff takes rows away: a bad row after the cutoff still
rejects the call. A filter on dates would be pushed below a check inside the same projection, so
the lazy check is a subquery of its own that a filter needs.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cutoff, finite


def by_series():
    """Window over a whole series. (A function, as windows need a session.)"""
    return W.partitionBy("series_id")


def obs():
    """Window over a series in order of date."""
    return by_series().orderBy("date")


#: Checks in order: code and message.
CODES = {
    "empty_data": "The series has no rows.",
    "duplicate_columns": "Column names must be unique.",
    "invalid_date_type": "Exactly one date column of dates is needed.",
    "invalid_value_type": "Exactly one value column of numbers of up to 64 bits is needed.",
    "missing_date": "The date is missing.",
    "non_daily_date": "The date has a time of day.",
    "duplicate_date": "The date occurs more than once.",
    "missing_value": "The value is missing.",
    "nonfinite_value": "The value is not finite.",
    "out_of_domain": "The magnitude is neither 0 nor from 1e-100 to 1e100.",
    "nonpositive_value": "The value must be positive.",
}


def _value_checks(positive: bool, bounded: bool) -> dict[str, Column]:
    v = F.col("value").cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    checks = {"missing_value": F.col("value").isNull(), "nonfinite_value": bad}
    if bounded:
        checks["out_of_domain"] = ~bad & (v != 0) & ((F.abs(v) < 1e-100) | (F.abs(v) > 1e100))
    if positive:
        checks["nonpositive_value"] = v <= 0
    return checks


def problems(df: DataFrame, positive: bool = False, bounded: bool = False) -> DataFrame:
    """One row: how many rows break each rule (columns named by code), and n, the number of rows."""
    checks = {"missing_date": F.col("date").isNull()} | _value_checks(positive, bounded)
    if dict(df.dtypes)["date"].startswith("timestamp"):
        checks["non_daily_date"] = F.col("date") != F.date_trunc("day", "date")
    flags = [F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in checks.items()]
    by_day = df.groupBy("series_id", "date").agg(F.count("*").alias("_n"), *flags)
    sums = [F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in checks]
    return by_day.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("date").isNotNull() & (F.col("_n") > 1), F.col("_n"))), F.lit(0)).alias("duplicate_date"), *sums)


def validate(df: DataFrame, positive: bool = False, bounded: bool = False) -> DataFrame:
    """df itself; raises ValueError at once if it breaks the contract or is empty. One aggregate over the input."""
    row = problems(df, positive, bounded).first().asDict()
    found = {k: row[k] for k in CODES if row.get(k)} if row["n"] else {"empty_data": 1}
    if found:
        raise ValueError("; ".join(f"{CODES[k]} ({k}: {n})" for k, n in found.items()))
    return df


def guard(df: DataFrame, positive: bool = False, bounded: bool = False) -> DataFrame:
    """df, which raises when it runs if it breaks the contract; nothing runs yet. An input known to be empty may give an empty result instead; validate() always rejects it."""
    found = problems(df, positive, bounded)
    bad = F.col("n") == 0
    for k in found.columns:
        bad = bad | (F.col(k) > 0) if k != "n" else bad
    ok = found.select(F.when(bad, F.raise_error(F.lit("the input breaks the contract of a prepared series")).cast("boolean")).otherwise(F.lit(True)).alias("ok"))
    return df.filter(ok.scalar())  # a subquery of one value


def visible(df: DataFrame, as_of: dt.date, check: bool = True, positive: bool = False, bounded: bool = False) -> DataFrame:
    """(series_id, date, value) up to the cutoff, after the whole input is checked."""
    cutoff(as_of)
    df = guard(df, positive, bounded) if check else df
    return df.select("series_id", F.col("date").cast("date").alias("date"), F.col("value").cast("double").alias("value")).filter(F.col("date") <= F.lit(as_of))


def finite_results(operator):
    """An operator whose doubles raise when they are infinite or no number: an overflow is never passed on."""
    purpose = operator.__name__.replace("_", " ").capitalize()

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        out = operator(*args, **options)
        return out.select(*[finite(F.col(f"`{c}`"), purpose).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in out.dtypes])

    return run


def cutoff_counts(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Rows up to the cutoff and after it, of each series."""
    return df.groupBy("series_id").agg(F.count_if(F.col("date") <= F.lit(cutoff(as_of))).alias("visible"), F.count_if(F.col("date") > F.lit(as_of)).alias("excluded_future_observations"))


def schema_problems(df: DataFrame) -> list[str]:
    """Codes of what is wrong with the columns of df, before any row is looked at. (Timestamps have no zone of their own here, so a zone can't be wrong.)"""
    names, kinds = [f.name for f in df.schema], {f.name: f.dataType for f in df.schema}
    out = ["duplicate_columns"] if len(set(names)) != len(names) else []
    if names.count("date") != 1 or kinds["date"].simpleString() not in ("date", "timestamp", "timestamp_ntz"):
        out.append("invalid_date_type")
    if names.count("value") != 1 or kinds["value"].simpleString().partition("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        out.append("invalid_value_type")
    return out


def quality_report(df: DataFrame, row: str = "row", bounded: bool = False) -> DataFrame:
    """Every problem of every row of df (series_id, date, value and a row label): series_id, row, code, message; also of rows after any cutoff.

    All members of a duplicated date are reported. Null, non-finite and timed rows are each found.
    What is wrong with columns is reported without a row, and then such a column's rows are not
    looked at; with repeated names no row is.
    """
    message = lambda code: F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), code)
    wrong = schema_problems(df)
    if not wrong:
        return _row_problems(df, row, bounded).withColumn("message", message(F.col("code")))
    rows = None
    if "duplicate_columns" not in wrong and {"date", "value", "series_id", row} <= set(df.columns):
        cast = [F.current_date().alias(c) if c == "date" and "invalid_date_type" in wrong else F.lit(0.0).alias(c) if c == "value" and "invalid_value_type" in wrong else F.col(c) for c in df.columns]
        bare = _row_problems(df.select(*cast), row, bounded)
        rows = bare.filter("code <> 'duplicate_date'") if "invalid_date_type" in wrong else bare
        rows = rows.select(F.col("series_id").cast("string"), F.col("row").cast("long"), "code")
    spark = df.sparkSession
    out = spark.createDataFrame([(None, None, c) for c in wrong], "series_id string, row long, code string")
    out = out if rows is None else out.union(rows)
    return out.withColumn("message", message(F.col("code")))


def _row_problems(df: DataFrame, row: str, bounded: bool) -> DataFrame:
    df = df.withColumn("_dup", F.count("*").over(W.partitionBy("series_id", "date")) > 1)
    checks = {"missing_date": F.col("date").isNull()}
    if dict(df.dtypes)["date"].startswith("timestamp"):
        checks["non_daily_date"] = F.col("date") != F.date_trunc("day", "date")
    checks |= {"duplicate_date": F.col("_dup") & F.col("date").isNotNull()} | _value_checks(False, bounded)
    marks = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()])
    return df.select("series_id", F.col(row).alias("row"), F.explode(F.filter(marks, lambda c: c.isNotNull())).alias("code"))
