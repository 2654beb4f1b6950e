"""Workbooks (XLSX) as cells, and sheets as series. Saved formula values are read, never computed."""

from __future__ import annotations

import datetime as dt
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cutoff, excel_date, number

#: Fixed limits of a workbook.
MAX_PACKED, MAX_EXPANDED, MAX_ENTRIES, MAX_ROWS, MAX_CELLS, MAX_SERIES = 12 * 2**20, 64 * 2**20, 1000, 20_000, 250_000, 20
#: Units that each role may have.
ROLE_UNITS = {"eur_pln": ["PLN per EUR"], "eur_usd": ["USD per EUR"], "usd_pln": ["PLN per USD"], "wheat": ["EUR/t", "PLN/t"], "corn": ["EUR/t", "PLN/t"], "rapeseed": ["EUR/t", "PLN/t"]}
RATES = ("eur_pln", "eur_usd", "usd_pln")
CELLS = "file string, sheet string, row int, col int, type string, num double, text string, formula boolean, date1904 boolean"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def checked_archive(data: bytes) -> zipfile.ZipFile:
    """The archive of a workbook; raises ValueError for one that is encrypted, split, too large, unsafe or inconsistent."""
    if not data or len(data) > MAX_PACKED:
        raise ValueError("the workbook is empty or larger than 12 MiB")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not an unencrypted XLSX workbook") from e
    entries = archive.infolist()
    names = [e.filename for e in entries]
    if not entries or len(entries) > MAX_ENTRIES or len(set(names)) != len(names):
        raise ValueError("too many or repeated archive entries")
    for e in entries:
        if e.flag_bits & 1 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or e.volume:
            raise ValueError("encrypted, split or unsupported archive")
        if "\\" in e.filename or e.filename.startswith("/") or ".." in e.filename.split("/"):
            raise ValueError("unsafe archive name")
        if re.search("vbaProject|externalLinks|embeddings|activeX", e.filename, re.IGNORECASE):
            raise ValueError("macros, embedded objects and external links are not supported")
        extra = e.extra
        while len(extra) >= 4:
            kind, size = struct.unpack("<HH", extra[:4])
            if kind == 1:
                raise ValueError("ZIP64 archives are not supported")
            extra = extra[4 + size :]
        head = data[e.header_offset : e.header_offset + 30]
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise ValueError("malformed archive entry")
        packed, size = struct.unpack("<II", head[18:26])
        if (packed, size) != (e.compress_size, e.file_size) and not (e.flag_bits & 8 and (packed, size) == (0, 0)):
            raise ValueError("local and central sizes differ")
    if sum(e.file_size for e in entries) > MAX_EXPANDED:
        raise ValueError("the workbook expands to more than 64 MiB")
    if not {"[Content_Types].xml", "xl/workbook.xml"} <= set(names):
        raise ValueError("not an XLSX workbook")
    return archive


def _read(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    with archive.open(name) as f:
        data = f.read(MAX_EXPANDED + 1)
    if len(data) > MAX_EXPANDED or b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("unsafe or oversized workbook part")
    return ElementTree.fromstring(data)


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def cells_of(data: bytes) -> list[tuple]:
    """All stored cells: sheet, row (from 1), col (from 0), type (n, s, b or e), num, text, formula, date1904."""
    archive = checked_archive(data)
    book = _read(archive, "xl/workbook.xml")
    properties = book.find(f"{_MAIN}workbookPr")
    old = properties is not None and properties.get("date1904") in ("1", "true")
    links = {r.get("Id"): r.get("Target") for r in _read(archive, "xl/_rels/workbook.xml.rels")}
    strings = []
    if "xl/sharedStrings.xml" in archive.namelist():
        strings = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in _read(archive, "xl/sharedStrings.xml").iter(f"{_MAIN}si")]
    out = []
    for sheet in book.iter(f"{_MAIN}sheet"):
        target = links[sheet.get(f"{_REL}id")].lstrip("/")
        for c in _read(archive, target if target.startswith("xl/") else f"xl/{target}").iter(f"{_MAIN}c"):
            place = re.fullmatch(r"([A-Z]+)([1-9][0-9]*)", c.get("r", ""))
            if not place:
                raise ValueError("invalid cell address")
            kind, formula, v = c.get("t", "n"), c.find(f"{_MAIN}f") is not None, c.find(f"{_MAIN}v")
            raw = v.text if v is not None else None
            num, text = None, None
            if kind == "s" and raw is not None:
                text, kind = strings[int(raw)], "s"
            elif kind == "inlineStr":
                text, kind = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")), "s"
            elif kind == "str":
                text, kind = raw, "s"
            elif kind in ("b", "e"):
                text = raw
            elif raw is not None:
                num = float(raw)
            if raw is not None or text is not None or formula:
                out.append((sheet.get("name"), int(place[2]), _column(place[1]), kind, num, text, formula, old))
            if len(out) > MAX_CELLS:
                raise ValueError("more than 250,000 stored cells")
    return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every workbook at a path, a file a task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(p, *row) for row in cells_of(bytes(content))], columns=[c.split()[0] for c in CELLS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, CELLS)


def _shown(cells: DataFrame) -> DataFrame:
    return cells.select("row", "col", F.coalesce("text", F.col("num").cast("string")).alias("value"), "type", "formula").orderBy("row", "col")


def inspect_sheet(cells: DataFrame, sheet: str, rows: int = 10, header_row: int = 1, start_row: int | None = None) -> DataFrame:
    """The header row and the first ``rows`` rows from ``start_row`` (default: the header's) of a sheet as (row, col, value, type, formula)."""
    start = header_row if start_row is None else start_row
    if header_row < 1 or start < header_row or rows < 1:
        raise ValueError("rows count from 1, and data do not begin before their header")
    return _shown(cells.filter((F.col("sheet") == sheet) & ((F.col("row") == header_row) | F.col("row").between(start, start + rows - 1))))


def wide_to_series(wide: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """A date column and value columns as rows (series_id, date, value); blank cells are left out."""
    return wide.unpivot([date], columns, "series_id", "value").filter("value is not null").select("series_id", F.col(date).alias("date"), "value")


def sheet_series(cells: DataFrame, sheet: str, *, as_of: dt.date, date_column: int, mappings: list[dict], start_row: int = 4, decimal: str = ".", date_format: str = "ISO", skip_blank_rows: bool = False, allow_cached_formulas: bool = False) -> DataFrame:
    """A sheet's columns as series (series_id, date, value), checked as a whole before the cutoff.

    Each mapping has column (from 0), title, unit and role (custom or one of ROLE_UNITS). Only
    wholly empty rows at the end are ignored. Raises ValueError for anything else amiss.
    """
    cutoff(as_of)
    if not 1 <= len(mappings) <= MAX_SERIES or date_format not in ("ISO", "DD.MM.YYYY") or decimal not in (".", ","):
        raise ValueError("1 to 20 columns, a date format of ISO or DD.MM.YYYY and a decimal mark of . or , are needed")
    roles = [m.get("role", "custom") for m in mappings]
    named = [r for r in roles if r != "custom"]
    if len({m["column"] for m in mappings} | {date_column}) != len(mappings) + 1 or len({m["title"] for m in mappings}) != len(mappings) or len(set(named)) != len(named):
        raise ValueError("columns, titles and roles must differ")
    for m, role in zip(mappings, roles, strict=True):
        if role != "custom" and m["unit"] not in ROLE_UNITS.get(role, []):
            raise ValueError(f"unit {m['unit']} does not suit role {role}")
    own = cells.filter((F.col("sheet") == sheet) & (F.col("row") >= start_row))
    blank = F.col("text").isNull() & F.col("num").isNull() | (F.trim("text") == "")
    own = own.withColumn("blank", F.coalesce(blank, F.lit(False)) & ~F.col("formula"))
    end = own.filter(~F.col("blank")).agg(F.max("row")).first()[0]
    if end is None:
        raise ValueError("the sheet has no data rows")
    if end - start_row + 1 > MAX_ROWS:
        raise ValueError("more than 20,000 data rows")
    own = own.filter(~F.col("blank"))
    used = own.filter(F.col("col").isin([date_column, *[m["column"] for m in mappings]]))
    bad = used.filter(F.col("type").isin("b", "e") | F.col("formula") & (F.lit(not allow_cached_formulas) | F.col("text").isNull() & F.col("num").isNull())).agg(F.min("row")).first()[0]
    if bad is not None:
        raise ValueError(f"row {bad}: a truth value, an error, or a formula without consent or saved value")
    pattern = "yyyy-MM-dd" if date_format == "ISO" else "dd.MM.yyyy"
    text_date = F.when(F.trim("text").rlike(r"^\d{4}-\d{2}-\d{2}$" if date_format == "ISO" else r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_date(F.trim("text"), pattern))
    date = F.when(F.col("num").isNotNull(), excel_date(F.col("num"), F.col("date1904"))).otherwise(text_date)
    dates = used.filter(F.col("col") == date_column).select("row", date.alias("date"))
    grid = cells.sparkSession.range(start_row, end + 1).select(F.col("id").cast("int").alias("row")).join(dates, "row", "left")
    check = grid.agg(F.count_if(F.col("date").isNull()).alias("n"), (F.count("date") - F.count_distinct("date")).alias("twice")).first()
    if check["n"] or check["twice"]:
        raise ValueError(f"{check['n']} rows without a valid date, {check['twice']} repeated dates")
    value = F.coalesce("num", number(F.trim("text"), decimal))
    value = F.when((value == 0) | F.abs(value).between(1e-100, 1e100), value)
    table = F.array(*[F.struct(F.lit(m["column"]).alias("col"), F.lit(m["title"].strip()).alias("series_id"), F.lit(r in RATES).alias("positive")) for m, r in zip(mappings, roles, strict=True)])
    every = grid.select("*", F.inline(table))
    rows = every.join(used.select("row", "col", value.alias("value"), F.lit(True).alias("there")), ["row", "col"], "left")
    check = rows.agg(F.count_if(F.col("there") & F.col("value").isNull()).alias("bad"), F.count_if(F.col("there").isNull()).alias("blank"), F.count_if(F.col("positive") & (F.col("value") <= 0)).alias("rates")).first()
    if check["bad"] or check["rates"] or check["blank"] and not skip_blank_rows:
        raise ValueError(f"{check['bad']} values that are no numbers, {check['blank']} blank ones, {check['rates']} rates of 0 or less")
    out = rows.filter(F.col("value").isNotNull() & (F.col("date") <= F.lit(as_of))).select("series_id", "date", "value")
    if out.select("series_id").distinct().count() < len(mappings):
        raise ValueError("a series has no observations up to the cutoff")
    return out
