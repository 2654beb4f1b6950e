"""Queries that go through files: each writes the driver's tables in a source's format to the shared folder and reads them by the operator of that source."""

from __future__ import annotations

import datetime as dt
import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import market
from ..operators.store import FIELDS, Store
from ..sources import csv_strict, driver_tables, ecb_xml, fundamentals_csv, master, sheets
from .queries import query

NOW = dt.datetime(2001, 6, 1)
_BOOK = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _text(rows: DataFrame, order: list[str], delimiter: str = ",") -> str:
    """The path of a text file of rows in an order, with a header."""
    path = storage.fresh(rows.sparkSession)
    rows.coalesce(1).sortWithinPartitions(*order).write.option("header", True).option("sep", delimiter).csv(path)
    return path


def _prices_text(spark: SparkSession, sf_dir: str) -> str:
    """All prices with every 53rd value blank, dates as day/month/year and a decimal comma."""
    rows = driver_tables.prices(spark, sf_dir)
    blank = F.datediff("date", F.lit(dt.date(1990, 1, 1))) % 53 == 0
    value = F.when(~blank, F.regexp_replace(F.format_string("%.2f", F.col("value")), "\\.", ","))
    rows = rows.select(F.date_format("date", "yyyyMMdd").alias("key"), F.date_format("date", "dd/MM/yyyy").alias("day"), F.col("series_id").alias("instrument_id"), value.alias("price"))
    return _text(rows, ["key", "instrument_id"], ";")


def _import(spark: SparkSession, sf_dir: str) -> csv_strict.Imported:
    return csv_strict.import_csv(spark, _prices_text(spark, sf_dir), date_column="day", value_column="price", date_format="%d/%m/%Y", delimiter=";", decimal=",", instrument_column="instrument_id", instrument="1-URGENT", missing_values="skip", max_date=driver_tables.AS_OF)


@query("csv_file")
def _csv_file(spark, sf_dir):
    return _import(spark, sf_dir).frame


@query("csv_file_left_out")
def _csv_left_out(spark, sf_dir):
    got = _import(spark, sf_dir)
    parts = {"missing": got.skipped_missing_rows, "instrument": got.filtered_instrument_rows, "date": got.filtered_date_rows}
    out = None
    for reason, rows in parts.items():
        one = rows.select(F.lit(reason).alias("reason"), "row")
        out = one if out is None else out.union(one)
    return out


@query("csv_file_issues")
def _csv_issues(spark, sf_dir):
    """What an import rejects a file for, by row: bad dates, bad numbers, and values beyond a double."""
    rows = driver_tables.prices(spark, sf_dir).filter("series_id = '1-URGENT'")
    day = F.dayofmonth("date")
    value = F.when(day == 7, "1 000").when(day == 9, "1e999").otherwise(F.col("value").cast("string"))
    text = rows.select(F.when(day == 5, F.date_format("date", "yyyy-MM-32")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"), value.alias("value"), F.date_format("date", "yyyyMMdd").alias("key"))
    try:
        csv_strict.import_csv(spark, _text(text, ["key"]), date_column="date", value_column="value", date_format="%Y-%m-%d")
    except csv_strict.CsvRejected as e:
        return e.issues.select("row", "code")
    return spark.createDataFrame([], "row long, code string")


def _column(k: int) -> str:
    return "ABCDEFGHIJ"[k]


def workbook(rows: list[tuple], sheet: str) -> bytes:
    """A minimal XLSX of one sheet, numbers and inline texts; None is an empty cell."""
    lines = []
    for n, row in enumerate(rows, 1):
        cells = [f'<c r="{_column(k)}{n}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{_column(k)}{n}"><v>{v!r}</v></c>' for k, v in enumerate(row) if v is not None]
        lines.append(f'<row r="{n}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {_BOOK}><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_BOOK}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return out.getvalue()


@query("workbook_series")
def _workbook(spark, sf_dir):
    """Three series as a sheet with serial dates; a workbook has 20,000 rows at most, so its rows fit the driver that writes it."""
    wide = driver_tables.prices(spark, sf_dir).groupBy("date").agg(*[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(c) for c, s in (("a", "1-URGENT"), ("b", "2-HIGH"), ("c", "5-LOW"))])
    serial = F.datediff("date", F.lit(dt.date(1899, 12, 30)))
    rows = [tuple(r) for r in wide.select(serial, "a", "b", "c").filter("a is not null or b is not null or c is not null").orderBy(serial).collect()]
    path = storage.fresh(spark) + ".xlsx"
    storage.write_bytes(spark, path, workbook([("date", "a", "b", "c"), ("", "units", "units", "units"), ("", "", "", ""), *rows], "Prices"))
    maps = [{"column": k + 1, "title": c, "unit": "units", "role": "custom"} for k, c in enumerate("abc")]
    cells = storage.staged(sheets.read_workbooks(spark, path))
    storage.remove(spark, path)
    return sheets.sheet_series(cells, "Prices", as_of=driver_tables.AS_OF, date_column=0, mappings=maps, skip_blank_rows=True)


@query("ecb_rates", 6)
def _rates(spark, sf_dir):
    """Rates of two currencies in the bank's envelope, a document of some 200 kB."""
    rows = driver_tables.fx(spark, sf_dir).orderBy(F.desc("date")).collect()
    days = "".join(f'<Cube time="{r["date"]}"><Cube currency="USD" rate="{r["value"] / 4!r}"/><Cube currency="PLN" rate="{r["value"]!r}"/></Cube>' for r in rows)
    return ecb_xml.parse(spark, f'<?xml version="1.0"?><g:Envelope xmlns:g="u:g" xmlns="u:e"><Cube>{days}</Cube></g:Envelope>'.encode())


def _store(spark: SparkSession) -> Store:
    return Store(spark, storage.fresh(spark)).create()


def _meta(series_id: str) -> dict:
    return dict(zip(FIELDS, (series_id, series_id.title(), "units", "orders", "daily sum", "DRIVER"), strict=True))


@query("master_import")
def _master(spark, sf_dir):
    """All prices as one file of many instruments, three of which metadata declares; what the store has afterwards."""
    path = _text(driver_tables.prices(spark, sf_dir).select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("series_id").alias("instrument_id"), F.col("value").cast("string").alias("value")), ["date", "instrument_id"])
    store = _store(spark)
    master.import_master(store, path, json.dumps([_meta(s) for s in ("1-URGENT", "2-HIGH", "5-LOW")]), NOW, as_of=driver_tables.AS_OF)
    return store.table("observations").select("series_id", F.col("observation_date").alias("date"), "value")


@query("fundamentals_file")
def _fundamentals(spark, sf_dir):
    rows = driver_tables.vintages(spark, sf_dir)
    text = rows.select(F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"), *fundamentals_csv.HEADER[1:5], *[F.col(c).cast("string").alias(c) for c in fundamentals_csv.HEADER[5:]])
    return fundamentals_csv.read(spark, _text(text, fundamentals_csv.HEADER[:4]))


def _two_versions(spark: SparkSession, sf_dir: str) -> Store:
    """A store that took the older version of a series and then the newer one."""
    store = _store(spark)
    for k, rows in enumerate(driver_tables.versions(spark, sf_dir)):
        store.upsert([_meta("ALL")], rows, NOW + dt.timedelta(days=k))
    return store


@query("store_series")
def _store_series(spark, sf_dir):
    return _two_versions(spark, sf_dir).read("ALL")


@query("store_revisions")
def _store_revisions(spark, sf_dir):
    rows = _two_versions(spark, sf_dir).table("revisions")
    return rows.select("series_id", F.col("observation_date").alias("date"), "old_value", "new_value", F.datediff(F.col("recorded_at").cast("date"), F.lit(NOW.date())).alias("import"))


@query("store_imports")
def _store_imports(spark, sf_dir):
    rows = _two_versions(spark, sf_dir).table("imports")
    return rows.select("series_id", F.datediff(F.col("recorded_at").cast("date"), F.lit(NOW.date())).alias("import"), "observations", "inserted", "revised", "unchanged")


@query("named_pairs", 6)
def _named_pairs(spark, sf_dir):
    return market.matched_intervals(driver_tables.prices(spark, sf_dir), driver_tables.AS_OF, [("2-HIGH", "1-URGENT"), ("1-URGENT", "5-LOW")])
