"""Imports of whole files into the store: a master text of many instruments, and reference rates."""

from __future__ import annotations

import datetime as dt
import json
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cutoff
from ..operators.contract import quality_report, validate
from ..operators.store import FIELDS, RESERVED, Store
from ..storage import staged
from . import csv_strict, ecb_xml

#: What the bank's series are called in the store.
RATE_SERIES = {
    "EUR_PLN": ("Euro in zloty", "PLN per EUR"),
    "EUR_USD": ("Euro in US dollars", "USD per EUR"),
    "USD_PLN": ("US dollar in zloty", "PLN per USD"),
}
RATE_SOURCE, RATE_PROVENANCE = "European Central Bank", "ECB_REFERENCE"


def read_metadata(text: str) -> list[dict]:
    """Series metadata from JSON: a list of objects, or an object keyed by series_id. Raises ValueError."""
    data = json.loads(text)
    rows = [{"series_id": k, **v} for k, v in data.items()] if isinstance(data, dict) else data
    if not isinstance(rows, list) or not rows or any(not isinstance(r, dict) or set(r) != set(FIELDS) for r in rows):
        raise ValueError(f"metadata needs exactly the fields {', '.join(FIELDS)}")
    ids = [r["series_id"] for r in rows]
    if len(set(ids)) != len(ids) or set(ids) & set(RESERVED):
        raise ValueError("series are named once; those of reference rates are reserved")
    return rows


def import_master(store: Store, path: str, metadata: str, now: dt.datetime, *, date_column: str = "date", value_column: str = "value", instrument_column: str = "instrument_id", date_format: str = "%Y-%m-%d", delimiter: str = ",", decimal: str = ".", skip_missing: bool = False, as_of: dt.date | None = None) -> DataFrame:
    """Checks every declared instrument of one file in a single scan, then writes all or none. Returns import counts.

    Instruments that metadata does not declare are left out; a declared one without rows rejects the import.
    """
    declared = read_metadata(metadata)
    csv_strict.date_pattern(date_format)
    rows = staged(csv_strict.records(store.spark, path, delimiter))
    names, body = csv_strict.checked(rows)
    if any(c not in names for c in (date_column, value_column, instrument_column)):
        raise ValueError("a declared column is missing")
    at = lambda c: F.get("fields", F.lit(names.index(c)))
    text = body.select("row", at(instrument_column).alias("series_id"), at(date_column).alias("date_text"), at(value_column).alias("value_text"))
    text = text.filter(F.col("series_id").isin([m["series_id"] for m in declared]))
    found = csv_strict.issues_of(text, date_format, decimal)
    if not found.isEmpty():
        raise csv_strict.CsvRejected(found)
    own = csv_strict.typed(text, date_format, decimal)
    wrong = quality_report(own).select("row", "code", "message")
    wrong = wrong.filter("code <> 'missing_value'") if skip_missing else wrong
    if not wrong.isEmpty():
        raise csv_strict.CsvRejected(wrong)
    blank = F.col("value").isNull()
    kept = own.filter(~blank).select("series_id", "date", "value")
    kept = kept.filter(F.col("date") <= F.lit(cutoff(as_of))) if as_of else kept
    if kept.select("series_id").distinct().count() != len(declared):
        raise ValueError("a declared instrument has no rows")
    return store.upsert(declared, validate(kept), now)


def update_rates(store: Store, content: bytes, now: dt.datetime, as_of: dt.date) -> DataFrame:
    """Upserts the three rate series of the bank's document; one that is dated after as_of is rejected before any write."""
    rows = ecb_xml.parse(store.spark, content)
    if not rows.filter(F.col("date") > F.lit(cutoff(as_of))).isEmpty():
        raise ValueError("the document has rates of the future")
    metadata = [dict(zip(FIELDS, (k, title, unit, RATE_SOURCE, "daily reference rate", RATE_PROVENANCE), strict=True)) for k, (title, unit) in RATE_SERIES.items()]
    return store.upsert(metadata, rows, now)


def fetch(url: str, timeout: float = 20.0) -> bytes:
    """A document of at most 16 MiB from an https address."""
    if not url.startswith("https://"):
        raise ValueError("only https addresses are read")
    with urllib.request.urlopen(url, timeout=timeout) as response:  # noqa: S310
        content = response.read(ecb_xml.MAX_BYTES + 1)
    if len(content) > ecb_xml.MAX_BYTES:
        raise ValueError("the document is larger than 16 MiB")
    return content
