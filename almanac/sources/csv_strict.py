"""Strict delimited text: declared columns and formats, exact headers, physical row numbers.

Quoted cells may hold line ends, so a file's rows can only be numbered from its start: files are
read side by side, each in one task, and what they hold is written to the shared folder once, so
that every check and the result see the same rows. ``fast()`` reads huge files of plain rows
without numbers.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cutoff, number
from ..operators.contract import quality_report
from ..storage import staged

#: What each directive of a date format takes, as a pattern.
DIRECTIVES = {
    "%Y": "([0-9]{4})", "%m": "(1[0-2]|0[1-9]|[1-9])", "%d": "(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])",
    "%H": "(2[0-3]|[01][0-9]|[0-9])", "%M": "([0-5][0-9]|[0-9])", "%S": "(6[01]|[0-5][0-9]|[0-9])",
}
#: Names of months; the short ones are their first three letters.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Codes of what is wrong with a file or a row.
CODES = {
    "missing_header": "There is no header after the rows left out.",
    "malformed_csv": "A record could not be parsed.",
    "invalid_header": "Column names must not be empty.",
    "duplicate_columns": "Column names must differ.",
    "different_headers": "The files have different headers.",
    "missing_column": "A declared column is not in the header.",
    "missing_instrument_selection": "The file names instruments; select one.",
    "field_count": "A record has another number of fields than the header.",
    "invalid_date": "The date is not of the declared format.",
    "invalid_daily_date": "The date has a time of day.",
    "invalid_numeric": "The value is not a number of the declared format.",
    "nonfinite_value": "The value is not finite.",
    "empty_data": "No rows remain.",
}
LIMIT_BYTES, LIMIT_ROWS = 12 * 2**20, 20_000  # of the bounded profile
_BATCH = 20_000  # rows that a reader hands on at once


class CsvRejected(ValueError):
    """A file was rejected. ``issues`` has all that is wrong (row, code, message), the message the first five."""

    def __init__(self, issues: DataFrame):
        self.issues = issues
        first = issues.orderBy(F.col("row").asc_nulls_first(), "code").limit(6).collect()
        said = [r["code"] + (f" at row {r['row']}" if r["row"] is not None else "") for r in first[:5]] + ["..."] * (len(first) > 5)
        super().__init__("import rejected: " + "; ".join(said))


def _reject(spark: SparkSession, code: str, row: int | None = None) -> CsvRejected:
    return CsvRejected(spark.createDataFrame([(row, code, CODES[code])], "row long, code string, message string"))


def date_pattern(date_format: str) -> tuple[str, list[str]]:
    """A Java regular expression for a strptime format, and the directives of its groups in order. Raises ValueError for a format without a full date, or with a directive that has no fixed meaning here."""
    out, groups = "", []
    for part in re.findall("%.?|\\s+|[^%\\s]+", date_format, re.DOTALL):
        if part == "%%":
            out += "%"
        elif part in ("%b", "%B"):
            names = [m[:3] if part == "%b" else m for m in MONTHS]
            out, groups = out + "((?i:" + "|".join(sorted(names, key=len, reverse=True)) + "))", [*groups, part]
        elif part in DIRECTIVES:
            out, groups = out + DIRECTIVES[part], [*groups, part]
        elif part[0] == "%":
            raise ValueError(f"{part} is not supported in a date format")
        else:
            out += "\\s+" if part.isspace() else re.sub(r"([^0-9A-Za-z])", r"\\\1", part)
    if "%Y" not in groups or "%d" not in groups or not {"%m", "%b", "%B"} & set(groups) or len(set(groups)) < len(groups):
        raise ValueError("the date format needs %Y, %d and a month, each once")
    return "^" + out, groups


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def parse_date(text: Column, date_format: str) -> tuple[Column, Column]:
    """The date of a text that is wholly of a strptime format, else null; and whether it has a time of day."""
    pattern, groups = date_pattern(date_format)
    part = {g: F.regexp_extract(text, pattern, k + 1) for k, g in enumerate(groups)}
    if "%m" in part:
        month = part["%m"]
    else:
        name = F.substring(F.lower(part.get("%b", part.get("%B"))), 1, 3)
        month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name).cast("string")
    date = F.try_to_date(F.concat_ws("-", part["%Y"], month, F.trim(part["%d"])), "yyyy-M-d")
    whole = (F.regexp_extract(text, pattern, 0) == text) & (text != "") & (part["%Y"] != "0000")
    timed = F.lit(False)
    for g in ("%H", "%M", "%S"):
        timed = timed | (part[g].try_cast("int") != 0) if g in part else timed
    return F.when(whole, date), F.coalesce(timed, F.lit(False))


def records(spark: SparkSession, path: str, delimiter: str = ",", skip_rows: int = 0, encoding: str = "utf-8-sig") -> DataFrame:
    """Rows of every file: file, row (physical line where it starts), fields, problem. The header is row skip_rows + 1; a blank line has no fields.

    A file that ends before its header, or cannot be parsed, has a last row with a problem (a code).
    """
    if len(delimiter) != 1 or delimiter in "\"\r\n\0":
        raise ValueError("the delimiter is one character, neither a quote nor a line end")
    if isinstance(skip_rows, bool) or not isinstance(skip_rows, int) or skip_rows < 0:
        raise ValueError("skip_rows must be a whole number, not negative")

    def rows_of(content: bytes) -> Iterator[tuple]:
        lines = io.StringIO(content.decode(encoding), newline="")
        for _ in range(skip_rows):
            if not lines.readline():
                yield None, None, "missing_header"
                return
        reader, at = csv.reader(lines, delimiter=delimiter, strict=True), skip_rows + 1
        try:
            for fields in reader:
                yield at, fields, None
                at = skip_rows + reader.line_num + 1
        except csv.Error:
            yield at, None, "malformed_csv"
            return
        if at == skip_rows + 1:
            yield None, None, "missing_header"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                some = []
                for row in rows_of(bytes(content)):
                    some.append((path_, *row))
                    if len(some) == _BATCH:
                        yield pd.DataFrame(some, columns=["file", "row", "fields", "problem"])
                        some = []
                yield pd.DataFrame(some, columns=["file", "row", "fields", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, row long, fields array<string>, problem string")


def checked(rows: DataFrame, skip_rows: int = 0) -> tuple[list[str], DataFrame]:
    """The header of records(), and the rows below it (row, fields). Raises CsvRejected for a file without a header, a record that can't be parsed or is of another width, and headers with empty or repeated names."""
    spark, head = rows.sparkSession, skip_rows + 1
    heads = [r["fields"] for r in rows.filter((F.col("row") == head) & F.col("problem").isNull()).select("fields").distinct().limit(2).collect()]
    if not rows.filter("problem = 'missing_header'").isEmpty() or not heads and rows.isEmpty():
        raise _reject(spark, "missing_header")
    if not heads:
        raise _reject(spark, "malformed_csv", head)
    names = heads[0]
    if not names or any(not c.strip() for c in names):
        raise _reject(spark, "invalid_header", head)
    if len(set(names)) != len(names):
        raise _reject(spark, "duplicate_columns", head)
    if len(heads) > 1:
        raise _reject(spark, "different_headers", head)
    wrong = F.coalesce(F.col("problem"), F.when(F.size("fields") != len(names), "field_count"))
    first = rows.filter(wrong.isNotNull()).select("row", wrong.alias("code")).orderBy("row").limit(1).collect()
    if first:
        raise _reject(spark, first[0]["code"], first[0]["row"])
    return names, rows.filter(F.col("row") > head).select("row", "fields")


@dataclass
class Imported:
    """Accepted rows (series_id, date, value, row) and the rows left out, by reason; ``report`` has what a policy let pass (row, code, message), of all selected rows."""

    frame: DataFrame
    skipped_missing_rows: DataFrame
    filtered_instrument_rows: DataFrame
    filtered_date_rows: DataFrame
    report: DataFrame


def typed(text: DataFrame, date_format: str, decimal: str = ".") -> DataFrame:
    """Adds date and value to rows with date_text and value_text; null where the text is not exactly of the format."""
    date, timed = parse_date(stripped(F.col("date_text")), date_format)
    return text.withColumn("date", F.when(~timed, date)).withColumn("value", number(stripped(F.col("value_text")), decimal))


def issues_of(text: DataFrame, date_format: str, decimal: str = ".") -> DataFrame:
    """What is wrong with the texts of rows (row, date_text, value_text): row, code, message. A row without a date is not looked at further; a blank value is not wrong here."""
    date, timed = parse_date(stripped(F.col("date_text")), date_format)
    value = stripped(F.col("value_text"))
    numeric = number(value, decimal, finite_only=False)
    code = F.when(date.isNull(), "invalid_date").when(timed, "invalid_daily_date").when((value != "") & numeric.isNull(), "invalid_numeric").when(F.abs(numeric) == float("inf"), "nonfinite_value")
    message = F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), F.col("code"))
    return text.select("row", code.alias("code")).filter("code is not null").withColumn("message", message)


def import_csv(spark: SparkSession, path: str, *, date_column: str, value_column: str, date_format: str, delimiter: str = ",", decimal: str = ".", instrument_column: str | None = None, instrument: str | None = None, missing_values: str = "reject", max_date: dt.date | None = None, skip_rows: int = 0, encoding: str = "utf-8-sig") -> Imported:
    """Reads and checks everything, also rows that max_date would leave out; then filters.

    Blank values are rejected, or left out with ``missing_values='skip'``; a duplicated date is
    rejected even if one of its values is blank. A row after max_date counts as that, blank or
    not. Raises CsvRejected with rows and codes, ValueError for options that can't be.
    """
    if any(not isinstance(x, str) or not x for x in (date_column, value_column, date_format)) or date_column == value_column:
        raise ValueError("date and value columns and a date format are needed; the columns must differ")
    if decimal not in (".", ",") or decimal == delimiter or missing_values not in ("reject", "skip"):
        raise ValueError("decimal is . or , and not the delimiter; missing_values is reject or skip")
    if (instrument_column is None) != (instrument is None) or instrument_column in (date_column, value_column) or instrument_column == "" or instrument == "":
        raise ValueError("an instrument needs its column and a name; the column must be another one")
    date_pattern(date_format)
    if max_date is not None:
        cutoff(max_date)
    rows = staged(records(spark, path, delimiter, skip_rows, encoding))
    names, body = checked(rows, skip_rows)
    if any(c not in names for c in (date_column, value_column, instrument_column) if c is not None):
        raise _reject(spark, "missing_column")
    if instrument_column is None and "instrument_id" in names:
        raise _reject(spark, "missing_instrument_selection")
    field = lambda c: F.get("fields", F.lit(names.index(c)))
    text = body.select("row", (field(instrument_column) if instrument_column else F.lit("series")).alias("series_id"), field(date_column).alias("date_text"), field(value_column).alias("value_text"))
    wanted = F.col("series_id") == instrument if instrument is not None else F.lit(True)
    found = issues_of(text.filter(wanted), date_format, decimal)
    if not found.isEmpty():
        raise CsvRejected(found)
    own = typed(text.filter(wanted), date_format, decimal)
    report = quality_report(own).select("row", "code", "message")
    wrong = report if missing_values == "reject" else report.filter("code <> 'missing_value'")
    if not wrong.isEmpty():
        raise CsvRejected(report)
    blank = F.col("value").isNull()
    late = F.col("date") > F.lit(max_date) if max_date else F.lit(False)
    kept = own.filter(~blank & ~late).select("series_id", "date", "value", "row")
    if kept.isEmpty():
        raise _reject(spark, "empty_data")
    return Imported(kept, own.filter(blank & ~late).select("row"), text.filter(~wanted).select("row"), own.filter(late).select("row"), report)


@dataclass
class BoundedImport:
    """Accepted rows (series_id, date, value), the rows left out, and facts of the whole input."""

    frame: DataFrame
    skipped_blank_rows: DataFrame
    skipped_future_rows: DataFrame
    total_rows: int
    original_all_positive: bool


def import_bounded(spark: SparkSession, path: str, *, as_of: dt.date, date_column: str, value_column: str, delimiter: str = ",", decimal: str = ".", skip_blank_rows: bool = False) -> BoundedImport:
    """One series of ISO dates from a file of at most 12 MiB and 20,000 rows; every row is checked before the cutoff.

    Values are 0 or of a magnitude from 1e-100 to 1e100. original_all_positive looks at the whole
    input, rows after the cutoff included. A blank row counts as blank wherever it lies. Raises
    ValueError, as CsvRejected where rows are to blame.
    """
    cutoff(as_of)
    if delimiter not in (",", ";", "\t") or decimal not in (".", ",") or not date_column or not value_column or date_column == value_column:
        raise ValueError("the delimiter is a comma, semicolon or tab, the decimal mark . or ,; date and value columns must differ")
    size = spark.read.format("binaryFile").load(path).select("length").agg(F.sum("length")).first()[0]
    if (size or 0) > LIMIT_BYTES:
        raise ValueError("the text is larger than 12 MiB")
    names, body = checked(staged(records(spark, path, delimiter)))
    if date_column not in names or value_column not in names:
        raise _reject(spark, "missing_column")
    if "instrument_id" in names:
        raise _reject(spark, "missing_instrument_selection")
    n = body.count()
    if n > LIMIT_ROWS:
        raise ValueError("more than 20,000 data rows")
    text = body.select("row", F.lit("series").alias("series_id"), F.get("fields", F.lit(names.index(date_column))).alias("date_text"), F.get("fields", F.lit(names.index(value_column))).alias("value_text"))
    iso = F.when(stripped(F.col("date_text")).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("date_text")).otherwise("")
    found = issues_of(text.withColumn("date_text", iso), "%Y-%m-%d", decimal)
    if not found.isEmpty():
        raise CsvRejected(found)
    own = typed(text, "%Y-%m-%d", decimal)
    wrong = quality_report(own, bounded=True).select("row", "code", "message")
    wrong = wrong.filter("code <> 'missing_value'") if skip_blank_rows else wrong
    if not wrong.isEmpty():
        raise CsvRejected(wrong)
    blank, late = F.col("value").isNull(), F.col("date") > F.lit(as_of)
    kept = own.filter(~blank & ~late).select("series_id", "date", "value")
    if kept.isEmpty():
        raise _reject(spark, "empty_data")
    return BoundedImport(kept, own.filter(blank).select("row"), own.filter(~blank & late).select("row"), n, own.filter("value <= 0").isEmpty())


def preview(spark: SparkSession, path: str, delimiter: str = ",", n: int = 10, skip_rows: int = 0) -> tuple[list[str], list[list[str]], int]:
    """Header, first rows (blank lines have no fields), and the number of rows, blank ones included; of one file."""
    rows = staged(records(spark, path, delimiter, skip_rows))
    if rows.select("file").distinct().limit(2).count() > 1:
        raise ValueError("a preview shows one file")
    bad = rows.filter("problem is not null").select("problem", "row").first()
    if bad:
        raise _reject(spark, bad["problem"], bad["row"])
    first = [r["fields"] for r in rows.orderBy("row").limit(n + 1).collect()]
    if not first:
        raise _reject(spark, "missing_header")
    return first[0], first[1:], rows.count() - 1


def fast(spark: SparkSession, path: str, schema: str, delimiter: str = ",") -> DataFrame:
    """Plain rows without physical numbers, split within files; a malformed row fails the read."""
    return spark.read.schema(schema).option("header", True).option("sep", delimiter).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
