"""Price-like views of the driver's star schema, as DataFrames and as the SQL that defines them.

Daily sums are made in decimals and cut to whole units, so that both engines agree to the bit.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AS_OF = dt.date(2001, 5, 17)
AS_OF_LONG = dt.date(1999, 3, 10)


_SCHEMAS: dict[str, StructType] = {}  # of each table's path; these tables don't change while they are read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema; its schema is read from the file once, as that is a job of its own."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    whole = F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("double")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("date")).agg(whole.alias("value"))


def _by_ship_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_linenumber").alias("s"))


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_ship_date(spark, sf_dir).select(F.lit("EUR_PLN").alias("series_id"), "date", (F.lit(4.0) + (F.col("s") % 50) / F.lit(100.0)).alias("value"))


def signed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_ship_date(spark, sf_dir).select(F.lit("SIGNED").alias("series_id"), "date", ((F.col("s") % 7) - 3).cast("double").alias("value"))


def gappy_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices(spark, sf_dir)
    return rows.filter(((F.year("date") * 12 + F.month("date")) % 7 != 0) & ~F.dayofweek("date").isin(1, 7))


def long_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices(spark, sf_dir)
    return rows.withColumn("date", F.date_add(F.lit(dt.date(1960, 1, 1)), F.datediff("date", F.lit(dt.date(1995, 1, 1))) * 6))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    make = lambda status: orders.filter(F.col("o_orderstatus") != status).groupBy(F.lit("ALL").alias("series_id"), F.col("o_orderdate").cast("date").alias("date")).agg(F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("value"))
    return make("P"), make("F")


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {k: table(spark, sf_dir, k) for k in ("orders", "customer", "nation", "region")}
    rows = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    first = F.year(month) - F.when(F.month(month) < 7, 1).otherwise(0)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    out = rows.groupBy(month.alias("publication_date"), F.col("c_mktsegment").alias("commodity"), F.col("r_name").alias("region"), first.alias("first"))
    out = out.agg(F.coalesce(F.floor(F.sum(F.when(F.col("o_orderstatus") == "O", price))), F.lit(0)).cast("double").alias("ending_stocks"), F.floor(F.sum(price)).cast("double").alias("total_use"))
    year = F.concat(F.lpad(F.col("first").cast("string"), 4, "0"), F.lit("/"), F.lpad(((F.col("first") + 1) % 100).cast("string"), 2, "0"))
    return out.select("publication_date", "commodity", "region", year.alias("marketing_year"), F.lit("metric tonnes").alias("unit"), "ending_stocks", "total_use")


PRICES = "SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2"
SQL = {
    "prices": PRICES,
    "fx": "SELECT 'EUR_PLN' AS series_id, CAST(l_shipdate AS DATE) AS date, CAST(4.0 AS DOUBLE) + CAST(CAST(sum(l_linenumber) AS BIGINT) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS value FROM lineitem GROUP BY 2",
    "signed_prices": "SELECT 'SIGNED' AS series_id, CAST(l_shipdate AS DATE) AS date, CAST((CAST(sum(l_linenumber) AS BIGINT) % 7) - 3 AS DOUBLE) AS value FROM lineitem GROUP BY 2",
    "gappy_prices": f"SELECT * FROM ({PRICES}) WHERE (year(date) * 12 + month(date)) % 7 <> 0 AND dayofweek(date) NOT IN (0, 6)",
    "long_prices": f"SELECT series_id, CAST(DATE '1960-01-01' + CAST(datediff('day', DATE '1995-01-01', date) * 6 AS INTEGER) AS DATE) AS date, value FROM ({PRICES})",
    "older": "SELECT 'ALL' AS series_id, CAST(o_orderdate AS DATE) AS date, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS DOUBLE) AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2",
    "newer": "SELECT 'ALL' AS series_id, CAST(o_orderdate AS DATE) AS date, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS DOUBLE) AS value FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2",
    "vintages": """SELECT publication_date, commodity, region, lpad(CAST(f AS VARCHAR), 4, '0') || '/' || lpad(CAST((f + 1) % 100 AS VARCHAR), 2, '0') AS marketing_year, ending_stocks, total_use FROM (
  SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS publication_date, c_mktsegment AS commodity, r_name AS region,
    year(CAST(o_orderdate AS DATE)) - CASE WHEN month(CAST(o_orderdate AS DATE)) < 7 THEN 1 ELSE 0 END AS f,
    CAST(coalesce(floor(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O')), 0) AS DOUBLE) AS ending_stocks,
    CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS DOUBLE) AS total_use
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4)""",
}
