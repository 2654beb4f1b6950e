"""Euro reference rates from the bank's XML envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.market import cross_rate

MAX_BYTES = 16 * 2**20
CURRENCIES = ("PLN", "USD")
_SCHEMA = "Cube struct<Cube: array<struct<_time: string, Cube: array<struct<_currency: string, _rate: string>>>>>"


def parse(spark: SparkSession, content: bytes) -> DataFrame:
    """EUR_PLN, EUR_USD and USD_PLN series; every date needs both currencies once, each rate positive. Raises ValueError otherwise."""
    if not content or len(content) > MAX_BYTES:
        raise ValueError("the document is empty or larger than 16 MiB")
    text = content.decode("utf-8-sig")
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("declarations are not supported")
    rows = spark.createDataFrame([(text,)], "xml string").select(F.from_xml("xml", _SCHEMA, {"ignoreNamespace": "true"}).alias("e"))
    days = rows.select(F.explode("e.Cube.Cube").alias("d")).select(F.try_to_date("d._time", "yyyy-MM-dd").alias("date"), F.explode("d.Cube").alias("q"))
    rates = days.select("date", F.col("q._currency").alias("currency"), F.col("q._rate").try_cast("double").alias("rate")).filter(F.col("currency").isin(*CURRENCIES))
    found = rates.groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("currency").alias("k"), F.min("rate").alias("low"), F.max("rate").alias("high"), F.count("rate").alias("valid"))
    bad = found.filter("date is null or n <> 2 or k <> 2 or valid <> 2 or not (low > 0) or high = double('infinity')")
    if rates.isEmpty() or not bad.isEmpty():
        raise ValueError("every date needs one positive rate of PLN and one of USD")
    return cross_rate(rates)


def read(spark: SparkSession, path: str) -> DataFrame:
    """parse() of one file that Spark can read."""
    return parse(spark, bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
