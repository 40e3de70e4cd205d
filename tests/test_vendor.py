"""Vendors' files as a data source: schemas, symbols that choose files, statements merged from a folder."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import facts as X
from tallyforge.operators import indices as I
from tallyforge.sources import vendor as V

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


@pytest.fixture
def source(spark):
    spark.dataSource.register(V.VendorFiles)
    return lambda folder, kind, **more: spark.read.format("vendor_files").options(kind=kind, **more).load(str(folder))


def write(folder, kind, **files):
    for symbol, rows in files.items():
        (folder / f"{kind}-{symbol}.json").write_text(json.dumps(rows))


def workbook(cells, sheet="xl/worksheets/first.xml"):
    """A workbook of inline strings; None is a cell that isn't there."""
    rows = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{c}</t></is></c>' for k, c in enumerate(r) if c is not None) + "</row>" for i, r in enumerate(cells, 1))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(sheet, f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return data.getvalue()


def test_statements_of_a_folder_are_merged(source, tmp_path):
    write(
        tmp_path, "income",
        abc=[{"date": "2023-12-31", "fiscalYear": "2023", "period": "FY", "revenue": 200, "grossProfit": 50}, {"DATE": "2023-03-31", "FISCALYEAR": 2023, "Period": "q1", "Revenue": "80.5", "other": [1]}, {"fiscalYear": "n/a", "period": "FY"}],
        xyz=[{"fiscalYear": "2022", "period": "FY", "revenue": "much", "netIncome": True}],
    )
    write(tmp_path, "ratios", abc=[{"fiscalYear": "2023", "period": "FY", "currentRatio": 1.5}, {"fiscalYear": "2023", "period": "FY", "currentRatio": 9}, {"fiscalYear": "2023", "period": "Q1", "grossProfitMargin": 0.3}])
    write(tmp_path, "balance", abc=[{"fiscalYear": "2023", "period": "FY", "totalDebt": 70}], xyz=[])
    write(tmp_path, "cash", xyz=[{"fiscalYear": "2022", "period": "FY", "freeCashFlow": -3}])

    def side(kind, **names):
        return source(tmp_path, kind).select(F.col("symbol").alias("company_id"), F.col("fiscalYear").alias("fiscal_year"), F.upper("period").alias("period"), "seq", *(F.col(a).alias(b) for a, b in names.items()))

    merged = X.merge_statements(
        side("income", revenue="revenue", grossProfit="gross_profit", netIncome="net_income").drop("seq"),
        side("ratios", grossProfitMargin="gross_margin", currentRatio="current_ratio"),
        side("balance", totalDebt="total_debt"),
        side("cash", freeCashFlow="free_cash_flow"),
    )
    found = {(r.company_id, r.fiscal_year, r.period): (r.revenue, r.gross_margin, r.current_ratio, r.total_debt, r.free_cash_flow, r.net_income) for r in merged.collect()}
    assert found == {("ABC", 2023, "FY"): (200, 0.25, 1.5, 70, None, None), ("ABC", 2023, "Q1"): (80.5, 0.3, None, None, None, None), ("XYZ", 2022, "FY"): (None, None, None, None, -3, None)}


def test_symbols_choose_files(source, tmp_path):
    write(tmp_path, "profile", **{f"s{k}": [{"companyName": f"n{k}", "cik": k, "marketCap": k * 1e9}] for k in range(6)})
    (tmp_path / "profile-broken.json").write_text("{not json")
    rows = source(tmp_path, "profile", symbols="s1, S4,S9")  # the broken file is never opened
    assert [(r.symbol, r.companyName, r.cik, r.marketCap) for r in rows.where("marketCap > 1e9").collect()] == [("S4", "n4", "4", 4e9)]
    assert rows.where("symbol = 'S1'").alias("a").join(rows.alias("b")).count() == 2  # no filter of one side reaches the other
    assert source(tmp_path, "profile", symbols="").count() == 0
    with pytest.raises(Exception, match="Expecting property name|JSONDecodeError|PYTHON|Python"):
        source(tmp_path, "profile").collect()
    with pytest.raises(Exception, match="not$|not one of|create Python data source"):
        source(tmp_path, "nothing").collect()


def test_files_are_packed_into_partitions(tmp_path, monkeypatch):
    from pyspark.sql.types import StructType

    monkeypatch.setattr(V, "PARTITION_BYTES", 100)
    for k, size in enumerate((60, 60, 30, 200, 10)):
        (tmp_path / f"cash-{k}.json").write_text(" " * size)
    reader = V.VendorReader(str(tmp_path), "cash", StructType())
    assert [[s for _, s in p.files] for p in reader.partitions()] == [["0"], ["1", "2"], ["3"], ["4"]]
    assert [p.files for p in V.VendorReader(str(tmp_path), "income", StructType()).partitions()] == [[]]


def test_workbooks_of_funds(source, tmp_path):
    head = [["As of", "today"], [None, "Fund Name:", None, " Broad Fund "], [], ["Name", "Ticker symbol", None, "Weight (%)"]]
    (tmp_path / "holdings-daily-us-en-brd.xlsx").write_bytes(workbook([*head, ["One", "AAA", "x", "0.6"], ["Two", "B.B", None, "0.4"], ["Cash", None, None, "5"], ["Three", "CCC", None, "n/a"], ["Four", "DDD"]]))
    (tmp_path / "holdings-daily-us-en-non.xlsx").write_bytes(workbook([["Fund Name", "No table"]]))
    rows = source(tmp_path, "holdings").orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [("BRD", 0, "Broad Fund", "AAA", 0.6), ("BRD", 1, "Broad Fund", "B.B", 0.4), ("BRD", 2, "Broad Fund", "CCC", None), ("BRD", 3, "Broad Fund", "DDD", None)]
    scaled = I.scaled_weights(source(tmp_path, "holdings").select(F.col("symbol").alias("index_id"), F.col("ticker").alias("id"), "weight"))
    assert {r.id: r.weight for r in scaled.collect()} == {"AAA": 60, "B.B": 40, "CCC": None, "DDD": None}
