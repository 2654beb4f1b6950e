"""Text, workbook and XML sources, the store, streams and settings."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from almanac.operators.store import Store
from almanac.render.axis import axis_domain
from almanac.sources import csv_strict, ecb_xml, fundamentals_csv, master, profiles, sheets
from almanac.streaming import incremental

D = dt.date.fromisoformat


def _import(spark, tmp_path, text, **options):
    path = tmp_path / "in.csv"
    path.write_text(text, encoding="utf-8")
    base = {"date_column": "date", "value_column": "value", "date_format": "%Y-%m-%d"}
    return csv_strict.import_csv(spark, str(path), **(base | options))


def test_csv_instruments_and_rows(spark, tmp_path):
    text = "﻿date,instrument_id,value\n2024-01-03,A,0\n2024-01-01,B,9\n2024-01-01,A,100\n2024-01-02,A,120\n2024-01-04,A,-4\n"
    got = _import(spark, tmp_path, text, instrument_column="instrument_id", instrument="A")
    assert [(r["value"], r["row"]) for r in got.frame.orderBy("date").collect()] == [(100, 4), (120, 5), (0, 2), (-4, 6)]
    assert [r["row"] for r in got.filtered_instrument_rows.collect()] == [3]
    with pytest.raises(ValueError, match="missing_instrument_selection"):
        _import(spark, tmp_path, text)


def test_csv_missing_values(spark, tmp_path):
    text = "date,value\n2024-01-01,100\n2024-01-02,\n2024-01-03,120\n2024-01-09,5\n"
    with pytest.raises(ValueError, match="missing_value"):
        _import(spark, tmp_path, text)
    got = _import(spark, tmp_path, text, missing_values="skip", max_date=D("2024-01-05"))
    assert [r["value"] for r in got.frame.orderBy("date").collect()] == [100, 120]
    assert [r["row"] for r in got.skipped_missing_rows.collect()] == [3] and [r["row"] for r in got.filtered_date_rows.collect()] == [5]


def test_csv_dialect_and_quotes(spark, tmp_path):
    got = _import(spark, tmp_path, 'note\nday;price;memo\n31/12/2024;1,5;"a\nb"\n01/01/2025;+,5e1;x\n', date_column="day", value_column="price", date_format="%d/%m/%Y", delimiter=";", decimal=",", skip_rows=1)
    assert [(r["date"], r["value"], r["row"]) for r in got.frame.orderBy("date").collect()] == [(D("2024-12-31"), 1.5, 3), (D("2025-01-01"), 5.0, 5)]


@pytest.mark.parametrize(
    ("text", "match"),
    [
        ("date,value\n2024-01-01,1\n2024-01-01,\n", "duplicate_date at row 2; duplicate_date at row 3"),
        ("date,value\n2024-02-30,1\n", "invalid_date at row 2"),
        ("date,value\n2024-01-01,1 000\n2024-01-02,x\n", "invalid_numeric at row 2; invalid_numeric at row 3"),
        ("date,value\n2024-01-01,NaN\n", "invalid_numeric"),
        ("date,value\n2024-01-01,1e999\n", "nonfinite_value"),
        ("date,value\n2024-01-01\n", "field_count at row 2"),
        ("date,value\n2024-01-01,1\n\n2024-01-02,2\n", "field_count at row 3"),
        ('date,value\n2024-01-01,1\n2024-01-02,"2"x\n', "malformed_csv at row 3"),
        ("date,other\n2024-01-01,1\n", "missing_column"),
        ("date,value,\n2024-01-01,1,\n", "invalid_header"),
        ("date,value,value\n2024-01-01,1,1\n", "duplicate_columns"),
        ("\ndate,value\n2024-01-01,1\n", "invalid_header"),
        ("", "missing_header"),
        ("date,value\n", "empty_data"),
        ("date,value\n2030-01-01,x\n", "invalid_numeric"),
    ],
)
def test_csv_rejects(spark, tmp_path, text, match):
    with pytest.raises(csv_strict.CsvRejected, match=match):
        _import(spark, tmp_path, text, missing_values="skip", max_date=D("2025-01-01"))


def test_csv_issues_have_rows(spark, tmp_path):
    with pytest.raises(csv_strict.CsvRejected) as e:
        _import(spark, tmp_path, "date,value\nx,1\n2024-01-02,y\n2024-01-03,1\n2024/01/04,z\n")
    assert [(r["row"], r["code"]) for r in e.value.issues.orderBy("row").collect()] == [(2, "invalid_date"), (3, "invalid_numeric"), (5, "invalid_date")]
    got = _import(spark, tmp_path, "date,value\n2024-01-01,1\n2024-01-02,\n", missing_values="skip")
    assert [(r["row"], r["code"]) for r in got.report.collect()] == [(3, "missing_value")]


def test_csv_blank_rows_after_the_cutoff(spark, tmp_path):
    got = _import(spark, tmp_path, "date,value\n2024-01-01,1\n2024-02-01,\n", missing_values="skip", max_date=D("2024-01-15"))
    assert [r["row"] for r in got.skipped_missing_rows.collect()] == [] and [r["row"] for r in got.filtered_date_rows.collect()] == [3]


def test_a_file_is_read_anew(spark, tmp_path):
    first = _import(spark, tmp_path, "date,value\n2024-01-01,1\n")
    second = _import(spark, tmp_path, "date,value\n2024-01-02,2\n2024-01-03,3\n")
    assert [r["value"] for r in second.frame.orderBy("date").collect()] == [2, 3] and [r["value"] for r in first.frame.collect()] == [1]
    head = ",".join(fundamentals_csv.HEADER)
    for stocks in (25, 30):
        (tmp_path / "f.csv").write_text(f"{head}\n2025-08-12,wheat,EU,2025/26,bushels,{stocks},100\n")
        assert fundamentals_csv.read(spark, str(tmp_path / "f.csv")).first()["ending_stocks"] == stocks


@pytest.mark.parametrize(
    ("options", "day"),
    [({"date_format": "%Y-%m-%d"}, "2024-1-1"), ({"date_format": "%d %b %Y"}, "1 jan 2024"), ({"date_format": "%B %d, %Y"}, "January 01, 2024"), ({"date_format": "%Y%m%d"}, "20240101"), ({"date_format": "%Y-%m-%d %H:%M"}, "2024-01-01 00:00"), ({"date_format": "%d%%%m.%Y"}, "1%1.2024")],
)
def test_csv_dates(spark, tmp_path, options, day):
    got = _import(spark, tmp_path, f'date;value\n" {day}\t";1\n', delimiter=";", **options)
    assert got.frame.first()["date"] == D("2024-01-01")


@pytest.mark.parametrize("day", ["2024-01-01x", "24-01-01", "2024-13-01", "2024-00-01", "0000-01-01", "2024-01-32", "", "2023-02-29"])
def test_csv_bad_dates(spark, tmp_path, day):
    with pytest.raises(ValueError, match="invalid_date"):
        _import(spark, tmp_path, f"date,value\n{day},1\n")
    with pytest.raises(ValueError, match="invalid_daily_date"):
        _import(spark, tmp_path, "date,value\n2024-01-01 01:00,1\n", date_format="%Y-%m-%d %H:%M")


def test_csv_options(spark, tmp_path):
    for bad in ({"date_format": "%d/%m/%y"}, {"date_format": "%Y-%m"}, {"date_format": "%Y-%m-%d %z"}, {"date_format": "%Y-%d"}, {"date_column": "value"}, {"instrument": "A"}, {"instrument_column": "date", "instrument": "A"}, {"instrument_column": "x"}, {"delimiter": "\n"}, {"delimiter": ",,"}, {"decimal": ","}, {"skip_rows": -1}, {"skip_rows": True}, {"missing_values": "fill"}, {"max_date": dt.datetime(2024, 1, 1)}):
        with pytest.raises(ValueError):
            _import(spark, tmp_path, "date,value\n2024-01-01,1\n", **bad)


def test_csv_preview(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n1,2\n\n3,4\n")
    assert csv_strict.preview(spark, str(tmp_path / "p.csv"), n=2) == (["a", "b"], [["1", "2"], []], 3)
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="missing_header"):
        csv_strict.preview(spark, str(tmp_path / "e.csv"))


def test_bounded_import(spark, tmp_path):
    def read(text, **options):
        (tmp_path / "b.csv").write_text(text)
        return csv_strict.import_bounded(spark, str(tmp_path / "b.csv"), **({"as_of": D("2024-01-31"), "date_column": "date", "value_column": "value"} | options))

    got = read("date,value\n2024-01-02,5\n2024-01-01,1e100\n2024-02-01,-3\n2024-02-02,\n", skip_blank_rows=True)
    assert [r["value"] for r in got.frame.orderBy("date").collect()] == [1e100, 5] and got.total_rows == 4
    assert not got.original_all_positive and [r["row"] for r in got.skipped_blank_rows.collect()] == [5] and [r["row"] for r in got.skipped_future_rows.collect()] == [4]
    assert read("date,value\n2024-01-02,5\n").original_all_positive
    for text, match in {"date,value\n2024-01-02,\n": "missing_value", "date,value\n2024-1-2,1\n": "invalid_date", "date,value\n2024-01-02,1e101\n": "out_of_domain", "date,value\n2024-02-02,1e-101\n2024-01-01,1\n": "out_of_domain", "date,value\n2024-02-02,1\n": "empty_data", "date,instrument_id,value\n2024-01-02,a,1\n": "instrument", "date,value\n2024-01-02,1\n2024-01-02,2\n": "duplicate_date"}.items():
        with pytest.raises(ValueError, match=match):
            read(text)
    for options in ({"delimiter": "|"}, {"value_column": "date"}, {"decimal": "x"}):
        with pytest.raises(ValueError):
            read("date,value\n2024-01-02,1\n", **options)
    with pytest.raises(ValueError, match="20,000"):
        read("date,value\n" + "2024-01-02,1\n" * 20_001)


XML = '<?xml version="1.0"?><g:Envelope xmlns:g="u:g" xmlns="u:e"><Cube>{}</Cube></g:Envelope>'


def test_ecb(spark):
    day = '<Cube time="{}"><Cube currency="PLN" rate="{}"/><Cube currency="USD" rate="{}"/><Cube currency="JPY" rate="1"/></Cube>'
    doc = XML.format(day.format("2024-01-03", 4.2, 1.05) + day.format("2024-01-02", 4.4, 1.1))
    got = {(r["series_id"], r["date"].day): r["value"] for r in ecb_xml.parse(spark, doc.encode()).collect()}
    assert got["USD_PLN", 2] == pytest.approx(4) and got["USD_PLN", 3] == pytest.approx(4) and len(got) == 6
    for bad in ("<!DOCTYPE x>" + doc, XML.format('<Cube time="2024-01-02"><Cube currency="PLN" rate="4"/></Cube>'), XML.format(day.format("2024-01-02", -1, 1)), XML.format(day.format("2024-01-02", 4, 1) * 2)):
        with pytest.raises(ValueError):
            ecb_xml.parse(spark, bad.encode())


def _workbook(rows, date1904=False, extra=None):
    cells = ""
    for k, row in enumerate(rows, 1):
        for c, v in enumerate(row):
            if v is None:
                continue
            ref, formula = f"{'ABCDEF'[c]}{k}", ""
            if isinstance(v, tuple):
                formula, v = "<f>1+1</f>", v[0]
            cells += f'<c r="{ref}" t="inlineStr">{formula}<is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}">{formula}<v>{v}</v></c>'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {main}><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="P" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData><row>{cells}</row></sheetData></worksheet>")
        for name in extra or ():
            z.writestr(name, "x")
    return out.getvalue()


HEAD = [["date", "price", "rate"], ["", "EUR/t", "PLN"], ["live", "1", "1"]]
MAPS = [{"column": 1, "title": "wheat", "unit": "EUR/t", "role": "wheat"}, {"column": 2, "title": "fx", "unit": "PLN per EUR", "role": "eur_pln"}]


def test_workbook(spark, tmp_path):
    data = _workbook([*HEAD, [45292, 200, 4.5], ["2024-01-02", (210.5,), 4.4], [45294, None, 4.3], [50000, 1, 4]])
    (tmp_path / "b.xlsx").write_bytes(data)
    cells = sheets.read_workbooks(spark, str(tmp_path / "b.xlsx")).cache()
    options = {"as_of": D("2024-02-01"), "date_column": 0, "mappings": MAPS}
    got = {(r["series_id"], r["date"].day): r["value"] for r in sheets.sheet_series(cells, "P", skip_blank_rows=True, allow_cached_formulas=True, **options).collect()}
    assert got == {("wheat", 1): 200, ("wheat", 2): 210.5, ("fx", 1): 4.5, ("fx", 2): 4.4, ("fx", 3): 4.3}
    with pytest.raises(ValueError, match="formula"):
        sheets.sheet_series(cells, "P", skip_blank_rows=True, **options)
    with pytest.raises(ValueError, match="blank"):
        sheets.sheet_series(cells, "P", allow_cached_formulas=True, **options)
    with pytest.raises(ValueError, match="unit"):
        sheets.sheet_series(cells, "P", as_of=D("2024-02-01"), date_column=0, mappings=[MAPS[0] | {"unit": "USD/t"}])
    assert sheets.inspect_sheet(cells, "P", 1).count() == 3
    shown = sheets.inspect_sheet(cells, "P", 2, header_row=1, start_row=4).collect()
    assert sorted({r["row"] for r in shown}) == [1, 4, 5] and [r["formula"] for r in shown if r["row"] == 5 and r["col"] == 1] == [True]
    with pytest.raises(ValueError):
        sheets.inspect_sheet(cells, "P", 2, header_row=3, start_row=2)


def test_workbook_archives():
    good = _workbook(HEAD)
    assert sheets.cells_of(good)
    for bad in (b"", good[:-30], _workbook(HEAD, extra=["xl/vbaProject.bin"]), _workbook(HEAD, extra=["../x"]), good.replace(b"[Content_Types].xml", b"[Content_Typez].xml")):
        with pytest.raises(ValueError):
            sheets.cells_of(bad)


def test_wide_to_series(spark):
    wide = spark.createDataFrame([(D("2024-01-01"), 1.0, None), (D("2024-01-02"), 2.0, 3.0)], "d date, a double, b double")
    assert sorted((r["series_id"], r["value"]) for r in sheets.wide_to_series(wide, "d", ["a", "b"]).collect()) == [("a", 1), ("a", 2), ("b", 3)]


def test_fundamentals_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text(",".join(fundamentals_csv.HEADER) + "\n2025-08-12,wheat,EU,2025/26,bushels,25,100\n")
    assert fundamentals_csv.read(spark, str(tmp_path / "f.csv")).first()["ending_stocks"] == 25
    (tmp_path / "g.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        fundamentals_csv.read(spark, str(tmp_path / "g.csv"))


def test_profiles():
    p = {"format": profiles.FORMAT, "version": 1, "kind": "XLSX", "worksheet": "P", "header_row": 1, "start_row": 4, "date": {"column": "A", "header": "date"}, "decimal": ".", "date_format": "ISO", "mappings": [{"column": "B", "header": "price", "title": "w", "unit": "EUR/t", "role": "wheat"}]}
    assert profiles.parse(profiles.serialize(p)) == p and profiles.compatible(p, {"A": "date", "B": "price"}) == p
    with pytest.raises(ValueError):
        profiles.compatible(p, {"A": "date", "B": "other"})
    got = profiles.capture("P", {"A": "date", "B": "price"}, date_column="A", mappings=[{"column": "B", "title": "w", "unit": "EUR/t", "role": "wheat"}])
    assert got == p and profiles.parse(profiles.serialize(got)) == got
    for bad in ("{", json.dumps(p | {"version": 2}), json.dumps(p | {"more": 1}), json.dumps(p | {"start_row": 1})):
        with pytest.raises(ValueError):
            profiles.parse(bad)


META = {"series_id": "w", "title": "Wheat", "unit": "EUR/t", "source": "file", "quote_semantics": "close", "provenance": "SYNTHETIC"}


def _rows(spark, *values, series_id="w"):
    return spark.createDataFrame([(series_id, D(d), float(v)) for d, v in values], "series_id string, date date, value double")


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store")).create()
    now = [dt.datetime(2024, 1, k) for k in range(1, 6)]
    first = s.upsert([META], _rows(spark, ("2024-01-01", 10)), now[0]).first()
    assert (first["inserted"], first["revised"]) == (1, 0)
    assert s.upsert([META], _rows(spark, ("2024-01-01", 10)), now[1]).first()["unchanged"] == 1
    third = s.upsert([META], _rows(spark, ("2024-01-01", 12), ("2024-01-02", 0)), now[2]).first()
    assert (third["inserted"], third["revised"]) == (1, 1)
    audit = [(r["old_value"], r["new_value"]) for r in s.table("revisions").orderBy("recorded_at", "observation_date").collect()]
    assert audit == [(None, 10), (10, 12), (None, 0)] and s.table("imports").count() == 3
    with pytest.raises(ValueError, match="change"):
        s.upsert([META | {"title": "Other"}], _rows(spark, ("2024-01-03", 1)), now[3])
    with pytest.raises(ValueError, match="duplicate"):
        s.upsert([META], _rows(spark, ("2024-01-03", 1), ("2024-01-03", 2)), now[3])
    with pytest.raises(ValueError, match="positive"):
        s.upsert([META | {"series_id": "EUR_PLN"}], _rows(spark, ("2024-01-03", 0), series_id="EUR_PLN"), now[3])
    assert [r["value"] for r in s.read("w").collect()] == [12, 0]
    s.export("w", str(tmp_path / "w.csv"))
    assert (tmp_path / "w.csv").read_bytes() == b"date,instrument_id,value\r\n2024-01-01,w,12.0\r\n2024-01-02,w,0.0\r\n"
    with pytest.raises(FileExistsError):
        s.export("w", str(tmp_path / "w.csv"))
    s.backup(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy")).read("w").count() == 2 and Store(spark, str(tmp_path / "copy")).table("revisions").count() == 3
    with pytest.raises(ValueError, match="new folder"):
        s.backup(str(tmp_path / "copy"))
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    with pytest.raises(ValueError, match="checkout"):
        Store(spark, str(tmp_path / "repo" / "private"))
    (tmp_path / "link").symlink_to(tmp_path / "repo")
    with pytest.raises(ValueError, match="checkout"):
        Store(spark, str(tmp_path / "link" / "private"))


def test_store_writes_only_what_changes(spark, tmp_path, monkeypatch):
    from almanac.operators import store

    monkeypatch.setattr(store, "FOLDERS", 3)
    s = Store(spark, str(tmp_path / "store")).create()
    metas = [META | {"series_id": k} for k in ("a", "b")]
    assert store.bucket_of("a") != store.bucket_of("b")
    rows = _rows(spark, ("2024-01-01", 1), series_id="a").union(_rows(spark, ("2024-01-01", 2), series_id="b"))
    s.upsert(metas, rows, dt.datetime(2024, 1, 1))
    before = s._state()["observations"]
    for k in range(2, 7):
        s.upsert(metas[:1], _rows(spark, ("2024-01-01", k), series_id="a"), dt.datetime(2024, 1, k))
    after = s._state()["observations"]
    assert after[str(store.bucket_of("b"))] == before[str(store.bucket_of("b"))] and after[str(store.bucket_of("a"))] != before[str(store.bucket_of("a"))]
    assert s.read("a").first()["value"] == 6 and s.read("b").first()["value"] == 2 and s.read("none").count() == 0
    assert s.table("revisions").count() == 7 and s.table("imports").count() == 7 and s.table("series").count() == 2 and len(s._state()["imports"]) <= 3
    # what a write replaced is gone after the next one, and no more than two pointers stay
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("STATE-")]) == 2
    assert not (tmp_path / "store" / before[str(store.bucket_of("a"))]).exists()
    # a writer that lost its number changes nothing
    stale = s._state() | {"number": s._state()["number"] - 1}
    with pytest.raises(Exception, match="exists"):
        s._point(stale)
    # a pointer that is still being written is passed over
    (tmp_path / "store" / f"STATE-{s._state()['number'] + 1:012d}").write_text("{")
    assert s.read("a").first()["value"] == 6


def test_technical_export(spark, tmp_path):
    from almanac.operators import technical
    from almanac.sources import exports

    rows = spark.createDataFrame([("w", D("2024-01-01") + dt.timedelta(k), float(k)) for k in range(21)], "series_id string, date date, value double")
    to = f"file://{tmp_path}/t.csv"
    exports.write_technical(technical.technical(rows, D("2024-02-01")), to)
    lines = (tmp_path / "t.csv").read_text().split("\n")
    assert lines[0] == "date,value,sma20,sma100,sma200,bollinger_upper,bollinger_lower" and lines[1] == "2024-01-01,0,,,,," and lines[20].startswith("2024-01-20,19,9.5,,,") and len(lines) == 23
    with pytest.raises(FileExistsError):
        exports.write_technical(technical.technical(rows, D("2024-02-01")), to)
    with pytest.raises(ValueError, match="one series"):
        exports.write_technical(technical.technical(rows.union(rows.withColumn("series_id", F.lit("x"))), D("2024-02-01")), f"file://{tmp_path}/u.csv")


def test_diff_pages(spark):
    from almanac.operators import store

    old = _rows(spark, *[(f"2024-01-{k:02d}", k) for k in range(1, 11)])
    new = _rows(spark, *[(f"2024-01-{k:02d}", k + k % 2) for k in range(1, 13)])
    diff = store.version_diff(old, new)
    pages = [[r["date"].day for r in store.diff_page(diff, p, 3).collect()] for p in (1, 2, 3, 4)]
    assert pages == [[1, 3, 5], [7, 9, 11], [12], []]
    with pytest.raises(ValueError):
        store.diff_page(diff, 0)


def test_stream_refresh(spark, tmp_path):
    src = tmp_path / "src"
    _rows(spark, ("2024-01-01", 1), ("2024-01-02", 2)).coalesce(1).write.parquet(str(src))
    s = Store(spark, str(tmp_path / "store")).create()
    stream = lambda: spark.readStream.schema("series_id string, date date, value double").parquet(str(src))
    incremental.refresh(stream(), s, [META], str(tmp_path / "ck")).awaitTermination()
    _rows(spark, ("2024-01-01", 5)).coalesce(1).write.mode("append").parquet(str(src))
    incremental.refresh(stream(), s, [META], str(tmp_path / "ck")).awaitTermination()
    assert [r["value"] for r in s.read("w").collect()] == [5, 2] and s.table("revisions").count() == 3
    assert s.upsert([META], _rows(spark, ("2024-01-01", 9)), dt.datetime(2025, 1, 1), stream=(str(tmp_path / "ck"), 1)).count() == 0
    assert s.table("imports").count() == 2 and s.read("w").first()["value"] == 5
    _rows(spark, ("2024-01-03", 5), ("2024-01-03", 6)).coalesce(1).write.mode("append").parquet(str(src))
    with pytest.raises(Exception, match="two values"):
        incremental.refresh(stream(), s, [META], str(tmp_path / "ck")).awaitTermination()


def test_daily_stream(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "a", 1.0), (dt.datetime(2024, 1, 1, 9), "a", 2.5), (dt.datetime(2024, 1, 9), "a", 9.0)], "ts timestamp, event_type string, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = incremental.daily_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r["date"]), r["n"], r["total"]) for r in spark.table("days").collect()} == {("2024-01-01", 2, 3.5), ("2024-01-09", 1, 9.0)}
    assert incremental.daily(rows).filter(F.col("n") == 2).count() == 1


def test_axis():
    low, high, labels = axis_domain([100.0, 200.0])
    assert (low, high) == (92, 208) and len(set(labels)) == 5
    assert axis_domain([0.0])[:2] == (-1, 1)


def test_master_and_rates(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store")).create()
    path = tmp_path / "m.csv"
    path.write_text("date,instrument_id,value\n2024-01-01,w,1\n2024-01-02,w,\n2024-01-01,c,3\n2024-01-01,other,x\n")
    meta = json.dumps({k: {f: v for f, v in META.items() if f != "series_id"} for k in ("w", "c")})
    now = dt.datetime(2024, 1, 5)
    with pytest.raises(ValueError, match="missing_value"):
        master.import_master(s, str(path), meta, now)
    got = {r["series_id"]: r["inserted"] for r in master.import_master(s, str(path), meta, now, skip_missing=True).collect()}
    assert got == {"w": 1, "c": 1}
    with pytest.raises(ValueError, match="no rows"):
        master.import_master(s, str(path), json.dumps([META | {"series_id": "none"}]), now, skip_missing=True)
    with pytest.raises(ValueError, match="reserved"):
        master.read_metadata(json.dumps([META | {"series_id": "EUR_PLN"}]))
    doc = XML.format('<Cube time="2024-01-02"><Cube currency="PLN" rate="4.4"/><Cube currency="USD" rate="1.1"/></Cube>').encode()
    with pytest.raises(ValueError, match="future"):
        master.update_rates(s, doc, now, D("2024-01-01"))
    assert master.update_rates(s, doc, dt.datetime(2024, 1, 6), D("2024-01-02")).count() == 3
    assert [r["value"] for r in s.read("USD_PLN").collect()] == [pytest.approx(4)]


def test_report(spark):
    from almanac.operators import monthly
    from almanac.render.report import seasonal_report

    df = _rows(spark, ("2023-01-01", 10), ("2024-01-02", 12))
    page = seasonal_report(monthly.seasonal_profile(df, D("2024-01-05"), 5), monthly.seasonal_current(df, D("2024-01-05"), 5), "A <title>", "EUR/t")
    assert "A &lt;title&gt;" in page and page.count("<tr>") == 13 and "<svg" in page
    two = df.union(df.withColumn("series_id", F.lit("x")))
    with pytest.raises(ValueError, match="one series"):
        seasonal_report(monthly.seasonal_profile(two, D("2024-01-05"), 5), monthly.seasonal_current(two, D("2024-01-05"), 5), "A", "EUR/t")
