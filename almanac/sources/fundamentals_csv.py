"""Supply balances from text with exactly seven columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import number
from ..operators.fundamentals import validate
from ..storage import staged
from .csv_strict import checked, records

#: The header, and how many rows a file may have.
HEADER = ["publication_date", "commodity", "region", "marketing_year", "unit", "ending_stocks", "total_use"]
LIMIT_ROWS = 20_000


def read(spark: SparkSession, path: str, limit: int | None = LIMIT_ROWS) -> DataFrame:
    """Checked rows with dates and numbers. Raises ValueError for another header, width or an invalid field, and for a file of more than ``limit`` rows."""
    rows = staged(records(spark, path))
    names, body = checked(rows)
    if names != HEADER:
        raise ValueError(f"the header must be {','.join(HEADER)}")
    if limit is not None and not rows.groupBy("file").count().filter(F.col("count") > limit + 1).isEmpty():
        raise ValueError(f"a file has more than {limit} rows")
    text = body.select(*[F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(HEADER)])
    date = F.when(F.col("publication_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("publication_date", "yyyy-MM-dd"))
    return validate(text.select(date.alias("publication_date"), *HEADER[1:5], *[number(F.col(c)).alias(c) for c in HEADER[5:]]))
