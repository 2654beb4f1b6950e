"""Column functions of dates and prices. Unavailable results are null, never NaN or infinite."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: dt.date) -> Column:
    return F.lit(cutoff(value))


def cutoff(value: dt.date) -> dt.date:
    """Checks an explicit cutoff: a date, not a time."""
    if not isinstance(value, dt.date) or isinstance(value, dt.datetime):
        raise ValueError("as_of must be a date without a time")
    return value


def shift_months(value: dt.date, months: int) -> dt.date:
    """The date so many months before, at the month's end if it has no such day; never before 0001-01-01."""
    year, month = divmod(value.year * 12 + value.month - 1 - months, 12)
    if year < 1:
        return dt.date(1, 1, 1)
    following = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) if (year, month) != (9999, 11) else None
    last = (following - dt.timedelta(days=1)).day if following else 31
    return dt.date(year, month + 1, min(value.day, last))


def window_start(as_of: dt.date, years: int) -> int:
    """First year of the window of so many years before the cutoff's."""
    if isinstance(years, bool) or not isinstance(years, int) or years <= 0:
        raise ValueError("window_years must be a positive integer")
    if as_of.year - years < 1:
        raise ValueError("the window must start in year 1 or later")
    return as_of.year - years


def pct(end: Column, start: Column) -> Column:
    """Change in per cent; null unless both are positive."""
    return F.when((start > 0) & (end > 0), finite((end / F.when(start > 0, start) - 1) * 100, "Percentage change"))


def log_change(end: Column, start: Column) -> Column:
    """Natural log of the ratio; null unless both are positive."""
    return F.when((start > 0) & (end > 0), F.ln(end) - F.ln(start))


def log_change_pct(end: Column, start: Column) -> Column:
    """Log change in per cent, by log1p where the relative change is small."""
    relative = (end - start) / F.when(start > 0, start)
    return F.when((start > 0) & (end > 0), 100 * F.when(F.abs(relative) < 0.5, F.log1p(relative)).otherwise(F.ln(end) - F.ln(start)))


def finite(value: Column, purpose: str) -> Column:
    """The value; an infinite or NaN one raises."""
    return F.when((F.abs(value) < float("inf")) | value.isNull(), value).otherwise(F.raise_error(F.lit(f"{purpose} exceeded the supported numeric range")).cast("double"))


def safe_mean(value: Column) -> Column:
    """A mean whose sum can't overflow: of large values the mean of values scaled by a power of two, which loses nothing."""
    return F.when(F.max(F.abs(value)) > 1e280, F.avg(value * 2.0**-64) * 2.0**64).otherwise(F.avg(value))


def root_mean_square(value: Column) -> Column:
    """The root of the mean square, of values scaled by a power of two where squares would overflow or vanish."""
    top, square = F.max(F.abs(value)), lambda x: F.avg(x * x)
    return F.when(top > 1e140, F.sqrt(square(value * 2.0**-600)) * 2.0**600).when(top < 1e-140, F.sqrt(square(value * 2.0**600)) * 2.0**-600).otherwise(F.sqrt(square(value)))


def excel_date(serial: Column, epoch_1904: Column | bool = False) -> Column:
    """Date of an Excel serial of whole days; null where there is none (the 1900 system has no day 60)."""
    epoch = F.lit(epoch_1904) if isinstance(epoch_1904, bool) else epoch_1904
    old = F.when(serial != 60, F.date_add(F.lit(dt.date(1899, 12, 31)), F.when(serial > 60, serial - 1).otherwise(serial).cast("int")))
    return F.when((serial >= 0) & (serial == F.floor(serial)), F.when(epoch, F.date_add(F.lit(dt.date(1904, 1, 1)), serial.cast("int"))).otherwise(old))


def number(text: Column, decimal: str = ".", finite_only: bool = True) -> Column:
    """A strict decimal number, null for anything else (no thousands separators, NaN or infinity). One beyond a double's range is null too, or infinite where not ``finite_only``."""
    mark = "," if decimal == "," else "\\."
    plain = F.when(text.rlike(rf"^[+-]?([0-9]+({mark}[0-9]*)?|{mark}[0-9]+)([eE][+-]?[0-9]+)?\z"), F.regexp_replace(text, ",", "."))
    value = plain.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value) if finite_only else value


def unit_decimals(unit: Column) -> Column:
    """Decimals that a unit is shown with: 3 for quotes like PLN per EUR, else 0."""
    return F.when(unit.rlike("^[A-Z]{3} per [A-Z]{3}$"), 3).otherwise(0)


def marketing_year_ok(value: Column) -> Column:
    """YYYY/YY of consecutive years."""
    first, second = F.substring(value, 1, 4).try_cast("int"), F.substring(value, 6, 2).try_cast("int")
    return F.coalesce(value.rlike("^[0-9]{4}/[0-9]{2}$") & (first >= 1) & (first <= 9998) & (second == (first + 1) % 100), F.lit(False))


def month_status(year: Column | int, month: Column, as_of: dt.date) -> Column:
    """month_ended, month_in_progress or after_cutoff for a calendar month at the cutoff."""
    first = F.make_date(F.lit(year) if isinstance(year, int) else year, month, F.lit(1))
    return F.when(first > F.lit(as_of), "after_cutoff").when(F.last_day(first) > F.lit(as_of), "month_in_progress").otherwise("month_ended")


def scenario(price: Column, fx: Column, tonnes: Column, base_price: Column, base_fx: Column) -> dict[str, Column]:
    """What a tonnage is worth at a price and a rate, and how much more than at the baseline."""
    level, base = price * fx, base_price * base_fx
    out = {"pln_per_tonne": level, "benchmark_value_pln": level * tonnes, "baseline_pln_per_tonne": base, "change_pln_per_tonne": level - base, "change_benchmark_value_pln": (level - base) * tonnes, "change_pct": pct(level, base)}
    return {k: finite(c, "Scenario") for k, c in out.items()}
