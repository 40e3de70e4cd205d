"""Readers on small texts of each format."""

import io
import zipfile

import pytest

from tallyforge.sources import readers as R


def texts(spark, *values, key="doc_id long"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{key}, value string")


def test_model_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"sectorOrder": ["a", "b"], /* note */ "A": [[0.1, 0.2], [0.3, 0.1]]}')
    assert {(r.i, r.j): r.a for r in R.io_model(spark, str(tmp_path / "m.json")).collect()} == {(0, 0): 0.1, (0, 1): 0.2, (1, 0): 0.3, (1, 1): 0.1}
    (tmp_path / "bad.json").write_text('{"sectorOrder": ["a", "b"], "A": [[0.1], [0.3, 0.1]]}')
    with pytest.raises(Exception, match="square"):
        R.io_model(spark, str(tmp_path / "bad.json")).collect()


def test_tables_of_numbers(spark):
    lines = texts(spark, "11   22   1.5", "11   23   .", "12   22", "13   22   x")
    assert [tuple(r) for r in R.fixed_width(lines, {"row": (1, 5), "col": (6, 5), "v": (11, 8)}, ("v",)).collect()] == [("11", "22", 1.5)]
    rows = R.long_table(texts(spark, '[{"RowCode": "1", "ColCode": "2", "DataValue": "1,234.5"}, {"RowCode": "1", "ColCode": "3", "DataValue": "(D)"}]'))
    assert [r.value for r in rows.orderBy("column").collect()] == [1234.5, 0.0]


def test_facts_and_submissions(spark):
    facts = '{"facts": {"Revenues": {"units": {"USD": [{"end": "2023-09-30", "val": 383e9, "fy": 2023, "fp": "FY", "form": "10-K"}, {"end": "2022-09-30", "val": 1}]}}}}'
    rows = R.company_facts(texts(spark, facts, key="cik long")).orderBy("seq").collect()
    assert [(r.concept, r.unit, r.end, r.val, r.form) for r in rows] == [("Revenues", "USD", "2023-09-30", 383e9, "10-K"), ("Revenues", "USD", "2022-09-30", 1.0, None)]
    subs = '{"cik": "0000320193", "accessionNumber": ["1-2-3", "4-5-6"], "form": ["10-K", "8-K", "4"], "reportDate": ["2023-09-30", ""], "primaryDocument": ["a.htm"]}'
    rows = R.submissions(texts(spark, subs)).collect()
    assert [(r.form, r.reportDate, r.url) for r in rows] == [("10-K", "2023-09-30", "https://example.org/data/320193/123/a.htm"), ("8-K", None, None), ("4", None, None)]
    tickers = spark.createDataFrame([(1, "B", 1), (1, "A", 0), (2, "C", 2)], "cik long, ticker string, pos int")
    assert {r.cik: r.ticker for r in R.ticker_map(tickers).collect()} == {1: "A", 2: "C"}
    again = spark.createDataFrame([(1, "a", 3), (2, "A", 1), (3, "b", 0)], "cik long, ticker string, pos int")
    assert {r.ticker: r.cik for r in R.ticker_inverse(again).collect()} == {"A": 2, "B": 3}


def test_tagged_documents(spark):
    xml = """<context id="c1"><entity><segment><explicitMember dimension="us-gaap:StatementBusinessSegmentsAxis">x:AmericasSegmentMember</explicitMember></segment></entity><period><endDate>2023-09-30</endDate></period></context>
    <context id="c2"><segment><m dimension="us-gaap:StatementBusinessSegmentsAxis">x:A</m><m dimension="srt:ProductOrServiceAxis">x:P</m></segment><period><instant>2022-09-24</instant></period></context>
    <us-gaap:Revenues contextRef="c1" decimals="-6">162560</us-gaap:Revenues><us-gaap:Revenues contextRef="c2">x</us-gaap:Revenues>"""
    found = [tuple(r)[1:] for r in R.instance_contexts(texts(spark, xml)).collect()]
    assert found == [("c1", "AmericasSegmentMember", "2023-09-30", False), ("c2", "A", "2022-09-24", True)]
    assert [tuple(r)[1:] for r in R.instance_facts(texts(spark, xml), {"us-gaap:Revenues": "revenue"}).collect()] == [("c1", "revenue", 162560.0), ("c2", "revenue", None)]
    names = spark.createDataFrame([(["a_cal.xml", "FilingSummary.xml", "b.xml", "c_htm.xml"],), (["a_lab.xml", "b.xml"],), (["x.htm"],)], "n array<string>")
    assert [r[0] for r in names.select(R.instance_file(names["n"])).collect()] == ["c_htm.xml", "b.xml", None]
    summary = "<Report><HtmlFileName>R2.htm</HtmlFileName><ShortName>P &amp; L &lt;x&gt; &#8212; &quot;y&quot;</ShortName><MenuCategory>Statements</MenuCategory></Report><Report><ShortName>none</ShortName></Report>"
    assert [tuple(r)[1:] for r in R.summary_reports(texts(spark, summary)).collect()] == [(0, "R2.htm", 'P & L <x> — "y"', "Statements")]


def test_charts_and_tables(spark):
    rows = R.weekly_chart(texts(spark, '{"timestamp": [1704067200, 1704672000, 1705276800], "volume": [5, null]}', key="company_id long")).collect()
    assert [(str(r.week), r.volume) for r in rows] == [("2024-01-01", 5)]
    page = '<table class="wikitable"><tr><th>x</th></tr></table><table id="constituents"><tr><th>Security</th><th>Symbol</th><th>CIK</th></tr><tr><td>Apple</td><td><a>AAPL</a> </td><td>320193</td></tr><tr><th>M</th><td>MSFT</td></tr></table>'
    assert [tuple(r)[1:] for r in R.constituents(texts(spark, page, None, "<p>")).collect()] == [(0, "AAPL", "320193"), (1, "MSFT", None)]


def test_workbooks(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Ticker</t></si><si><t>Weight</t></si><si><t>AAPL</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>Fund</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="A3" t="s"><v>2</v></c><c r="C3"><v>7.25</v></c></row><row><c r="A4"><v></v></c></row></sheetData></worksheet>')
    files = spark.createDataFrame([("f.xlsx", bytearray(data.getvalue()))], "path string, content binary")
    assert [tuple(r) for r in R.holdings(files).collect()] == [("f.xlsx", 0, "AAPL", 7.25)]


GOOD = '{"a": [[0.1, 0.2], [0.3, 0.1]], "labor": [1, 2], "energy": [0, 0], "capital": [1, 1], "taxes": [0, 0], "d": [5, 6], "sectorOrder": ["x", "y"]}'


def test_tolerant_models_and_quarantine(spark, tmp_path):
    files = {
        "a.json": GOOD,
        "b.json": '// one\n{"SECTORORDER": ["x", "y",], "A": [[0.1, 0.2,], [0.3, 0.1],], /* "d": [], */ "Labor": [1, 2], "ENERGY": [0, 0], "capital": [1, 1], "taxes": [0, 0], "finalDemand": [5, 6,], "source": "// no comment, ]", }',
        "c.json": GOOD.replace('["x", "y"]', '["y", "x"]'),
        "d.json": GOOD.replace("[0.3, 0.1]", "[0.3]"),
        "e.json": GOOD.replace('"d": [5, 6]', '"d": [5]'),
        "f.json": GOOD.replace("0.2", "-0.2"),
        "g.json": GOOD.replace("0.3", "0.95"),
        "h.json": GOOD.replace("[1, 2]", "[1, -2]"),
        "i.json": "[1, 2]", "j.json": "{", "k.json": " ",
        "l.json": GOOD.replace('"taxes": [0, 0], ', ""),
        "m.json": GOOD.replace("0.1]", "null]"),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    good, bad = R.models(R.model_texts(spark, str(tmp_path)), ("x", "y"))
    rows = {}
    for r in good.collect():
        rows.setdefault(r.model_id[-6:], {})[(r.part, r.i, r.j)] = r.v
    want = {("a", 0, 0): 0.1, ("a", 0, 1): 0.2, ("a", 1, 0): 0.3, ("a", 1, 1): 0.1} | {(k, i, None): float(v[i]) for k, v in {"labor": (1, 2), "energy": (0, 0), "capital": (1, 1), "taxes": (0, 0), "d": (5, 6)}.items() for i in (0, 1)}
    assert rows == {"a.json": want, "b.json": want}
    assert {r.model_id[-6]: r.reason for r in bad.collect()} == {
        "c": "other sectors", "d": "not square", "e": "d of another length", "f": "negative coefficient", "g": "column sum of one or more", "h": "negative value added",
        "i": "no JSON object", "j": "no JSON object", "k": "no JSON object", "l": "taxes of another length", "m": "not square",
    }
