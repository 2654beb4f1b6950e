"""Finished frames of one series as CSV files, written in order of date. A file that exists already is an error."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

from pyspark.sql import DataFrame

from .. import storage

#: Columns of the technical export, and where its frame has them.
TECHNICAL = {"date": "date", "value": "value", "sma20": "sma20", "sma100": "sma100", "sma200": "sma200", "bollinger_upper": "upper", "bollinger_lower": "lower"}


def _write(rows: DataFrame, destination: str, header: list[str], line: Callable, end: str) -> None:
    """Rows come to the driver a partition at a time; a daily series of a century has some 36,000."""
    if rows.select("series_id").distinct().limit(2).count() > 1:
        raise ValueError("an export has one series")
    if storage.exists(rows.sparkSession, destination):
        raise FileExistsError(destination)
    text = io.StringIO(newline="")
    out = csv.writer(text, lineterminator=end)
    out.writerow(header)
    for r in rows.orderBy("date").toLocalIterator():
        out.writerow(line(r))
    storage.write_text(rows.sparkSession, destination, text.getvalue())


def write_series(rows: DataFrame, destination: str) -> None:
    """(series_id, date, value) as date, instrument_id, value; numbers with as many digits as give them back."""
    _write(rows, destination, ["date", "instrument_id", "value"], lambda r: [r["date"].isoformat(), r["series_id"], repr(r["value"])], "\r\n")


def write_technical(rows: DataFrame, destination: str) -> None:
    """technical() of one series as seven columns; what is unavailable is empty, whole numbers have no decimals."""

    def shown(v) -> str:
        return "" if v is None else v.isoformat() if hasattr(v, "isoformat") else repr(v).removesuffix(".0")

    _write(rows, destination, list(TECHNICAL), lambda r: [shown(r[c]) for c in TECHNICAL.values()], "\n")
