"""Saved settings of a workbook import, as JSON."""

from __future__ import annotations

import json
import re

from .sheets import ROLE_UNITS

MAX_BYTES = 65536
FORMAT, VERSION = "almanac-import-profile", 1
_FIELDS = {"format", "version", "kind", "worksheet", "header_row", "start_row", "date", "mappings", "decimal", "date_format"}
_MAPPING = {"column", "header", "title", "unit", "role"}


def parse(text: str) -> dict:
    """A checked profile; raises ValueError."""
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("the profile is larger than 64 KiB")
    try:
        profile = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError("the profile is not JSON") from e
    return check(profile)


def check(profile: dict) -> dict:
    if not isinstance(profile, dict) or set(profile) != _FIELDS or (profile["format"], profile["version"], profile["kind"]) != (FORMAT, VERSION, "XLSX"):
        raise ValueError("unsupported fields, format or version")
    head, start = profile["header_row"], profile["start_row"]
    if not all(isinstance(x, int) and not isinstance(x, bool) for x in (head, start)) or not 1 <= head <= 1000 or not head < start <= 1001:
        raise ValueError("invalid row numbers")
    if profile["decimal"] not in (".", ",") or profile["date_format"] not in ("ISO", "DD.MM.YYYY"):
        raise ValueError("unsupported number or date format")
    mappings = profile["mappings"]
    if not isinstance(mappings, list) or not 1 <= len(mappings) <= 20 or any(not isinstance(m, dict) or set(m) != _MAPPING for m in mappings):
        raise ValueError("1 to 20 columns with five fields each are needed")
    columns = [profile["date"]["column"], *(m["column"] for m in mappings)]
    if any(not re.fullmatch("[A-Z]{1,3}", c) for c in columns) or len(set(columns)) != len(columns) or len({m["title"] for m in mappings}) != len(mappings):
        raise ValueError("columns and titles must be valid and differ")
    for m in mappings:
        if m["role"] != "custom" and m["unit"] not in ROLE_UNITS.get(m["role"], []):
            raise ValueError("a unit does not suit its role")
    return profile


def serialize(profile: dict) -> str:
    text = json.dumps(check(profile), indent=2, ensure_ascii=False) + "\n"
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("the profile is larger than 64 KiB")
    return text


def compatible(profile: dict, headers: dict[str, str]) -> dict:
    """The profile, if a sheet's headers by column letter are those it was saved with."""
    for m in (profile["date"], *profile["mappings"]):
        if headers.get(m["column"]) != m["header"]:
            raise ValueError(f"column {m['column']} is not {m['header']!r} any more")
    return profile


def capture(worksheet: str, headers: dict[str, str], *, date_column: str, mappings: list[dict], header_row: int = 1, start_row: int = 4, decimal: str = ".", date_format: str = "ISO") -> dict:
    """A checked profile of the settings of an import; headers are those of the sheet by column letter, mappings have column, title, unit and role."""
    named = lambda column: {"column": column, "header": headers.get(column, "")}
    columns = [named(m["column"]) | {k: m[k] for k in ("title", "unit", "role")} for m in mappings]
    return check({"format": FORMAT, "version": VERSION, "kind": "XLSX", "worksheet": worksheet, "header_row": header_row, "start_row": start_row, "date": named(date_column), "mappings": columns, "decimal": decimal, "date_format": date_format})
