"""Readers of the outside formats the domain is filled from, each a DataFrame of plain rows.

Text columns come in as DataFrames, so that any Spark source can feed them; nothing is
parsed on the driver.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "sectorOrder array<string>, A array<array<double>>, labor array<double>, energy array<double>, capital array<double>, taxes array<double>, finalDemand array<double>"
FACTS = "facts map<string, struct<units: map<string, array<struct<end: string, val: double, fy: int, fp: string, form: string>>>>>"
SUBMISSIONS = "cik string, accessionNumber array<string>, form array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>"
CHART = "timestamp array<long>, volume array<long>"


def io_model(spark: SparkSession, path: str) -> DataFrame:
    """A model file as (i, j, a) rows; comments are allowed. Rows that aren't as long as the sector list are an error."""
    raw = spark.read.schema(MODEL).option("multiLine", True).option("allowComments", True).json(path)
    n = F.size("sectorOrder")
    square = (F.size("A") == n) & F.forall("A", lambda r: F.size(r) == n)
    checked = raw.select(F.when(square, F.col("A")).otherwise(F.raise_error(F.lit("the matrix is not square over its sectors"))).alias("A"))
    return checked.select(F.posexplode("A").alias("i", "row")).select("i", F.posexplode("row").alias("j", "a"))


#: Comments and commas before a closing bracket, with strings, which are left alone, and the parts of a model by the names of their keys.
COMMENTS, COMMAS = r'("(?:[^"\\]|\\.)*")|/\*(?s:.*?)\*/|//[^\n]*', r'("(?:[^"\\]|\\.)*")|,(?=\s*[\]}])'
MODEL_KEYS = {"sectors": ("sectororder",), "a": ("a",), "labor": ("labor",), "energy": ("energy",), "capital": ("capital",), "taxes": ("taxes",), "d": ("d", "finaldemand")}
FACTORS = ("labor", "energy", "capital", "taxes")


def model_texts(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, value): the texts of all model files under a path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("model_id"), "value")


def models(texts: DataFrame, sectors: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Model files (model_id, value) as long rows (model_id, part, i, j, v), and those that are put aside (model_id, reason).

    Keys may be in any case; comments and commas after a last element are allowed. A model is
    put aside as a whole, for the first of: no JSON object, sectors that aren't the given ones in
    order, a matrix that isn't square over them, another vector of another length, a negative
    coefficient, a column whose coefficients reach one, or negative value added.
    """
    plain = F.regexp_replace(F.regexp_replace("value", COMMENTS, "$1"), COMMAS, "$1")
    parsed = texts.select("model_id", F.try_parse_json(plain).alias("m"))
    parsed = parsed.select("model_id", F.map_entries(F.when(F.schema_of_variant("m").startswith("OBJECT"), F.col("m")).cast("map<string,variant>")).alias("entries"))

    def part(name: str, kind: str) -> Column:
        found = F.get(F.filter("entries", lambda e: F.lower(e["key"]).isin(*MODEL_KEYS[name])), F.lit(0))["value"]
        return F.try_variant_get(found, "$", kind).alias(name)

    vectors = [*FACTORS, "d"]
    rows = parsed.select("model_id", F.col("entries").isNotNull().alias("is_object"), part("sectors", "array<string>"), part("a", "array<array<double>>"), *(part(v, "array<double>") for v in vectors))
    n = len(sectors)
    columns = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.aggregate("a", F.lit(0.0), lambda s, r: s + F.get(r, j)))
    no = lambda c: F.coalesce(~c, F.lit(True))
    checks = [
        (no(F.col("is_object")), "no JSON object"),
        (no(F.col("sectors") == F.array(*map(F.lit, sectors))), "other sectors"),
        (no((F.size("a") == n) & F.forall("a", lambda r: (F.size(r) == n) & F.forall(r, lambda x: x.isNotNull()))), "not square"),
        *((no((F.size(v) == n) & F.forall(v, lambda x: x.isNotNull())), f"{v} of another length") for v in vectors),
        (F.exists("a", lambda r: F.exists(r, lambda x: x < 0)), "negative coefficient"),
        (F.exists(columns, lambda s: s >= 1), "column sum of one or more"),
        *((F.exists(v, lambda x: x < 0), "negative value added") for v in FACTORS),
    ]
    reason = F.coalesce(*(F.when(c, F.lit(said)) for c, said in checks))
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason IS NULL")
    matrix = good.select("model_id", F.posexplode("a").alias("i", "row")).select("model_id", F.lit("a").alias("part"), "i", F.posexplode("row").alias("j", "v"))
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("part"), F.col(v).alias("x")) for v in vectors)))
    other = good.select("model_id", pairs.alias("p")).select("model_id", "p.part", F.posexplode("p.x").alias("i", "v"))
    out = matrix.unionByName(other.withColumn("j", F.lit(None).cast("int")))
    return out, judged.where("reason IS NOT NULL").select("model_id", "reason")


def fixed_width(lines: DataFrame, columns: dict[str, tuple[int, int]], numbers: tuple[str, ...]) -> DataFrame:
    """Columns by offset (from 1) and width; rows whose numbers are blank, a dot or no number are left out."""
    cut = lines.select(*(F.trim(F.substring("value", at, size)).alias(n) for n, (at, size) in columns.items()))
    cut = cut.withColumns({n: F.col(n).try_cast("double") for n in numbers})
    return cut.dropna(subset=list(numbers))


def long_table(rows: DataFrame) -> DataFrame:
    """(row, column, value) of a long JSON table, thousands separators dropped, bad values zero."""
    data = F.from_json("value", "array<struct<RowCode: string, ColCode: string, DataValue: string>>")
    return rows.select(F.inline(data)).select(F.col("RowCode").alias("row"), F.col("ColCode").alias("column"), F.coalesce(F.regexp_replace("DataValue", ",", "").try_cast("double"), F.lit(0.0)).alias("value"))


def company_facts(rows: DataFrame) -> DataFrame:
    """(cik, concept, unit, seq, end, val, fy, fp, form) of tagged facts."""
    concepts = rows.select("cik", F.explode(F.from_json("value", FACTS)["facts"]).alias("concept", "c"))
    units = concepts.select("cik", "concept", F.explode("c.units").alias("unit", "list"))
    return units.select("cik", "concept", "unit", F.posexplode("list").alias("seq", "f")).select("cik", "concept", "unit", "seq", "f.*")


def submissions(rows: DataFrame, base: str = "https://example.org/data") -> DataFrame:
    """Parallel arrays zipped by position, missing elements null; an address where accession and document are known."""
    parsed = rows.select(F.from_json("value", SUBMISSIONS).alias("s")).select("s.*")
    names = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")
    parsed = parsed.select("cik", *(F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in names))
    zipped = parsed.select("cik", F.inline(F.arrays_zip(*names)))
    url = F.concat_ws("/", F.lit(base), F.regexp_replace("cik", "^0+", ""), F.replace("accessionNumber", F.lit("-"), F.lit("")), F.col("primaryDocument"))
    known = (F.col("accessionNumber") != "") & (F.col("primaryDocument") != "")
    return zipped.withColumn("url", F.when(known, url)).withColumn("reportDate", F.nullif("reportDate", F.lit("")))


def ticker_map(rows: DataFrame) -> DataFrame:
    """cik to its first ticker by position."""
    return rows.groupBy("cik").agg(F.min_by("ticker", "pos").alias("ticker"))


def ticker_inverse(rows: DataFrame) -> DataFrame:
    """Ticker, in capitals, to the first cik by position that has it in any case."""
    return rows.groupBy(F.upper("ticker").alias("ticker")).agg(F.min_by("cik", "pos").alias("cik"))


def instance_contexts(rows: DataFrame) -> DataFrame:
    """(doc_id, context_id, member, end, product_axis) of the contexts in tagged documents."""
    blocks = rows.select("doc_id", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<(?:xbrli:)?context\b.*?</(?:xbrli:)?context>"), F.lit(0))).alias("x"))
    pick = lambda p: F.nullif(F.regexp_extract("x", p, 1), F.lit(""))
    member = pick(r'(?s)dimension="[^"]*StatementBusinessSegmentsAxis"[^>]*>\s*(?:[\w-]+:)?([\w-]+?)\s*<')
    return blocks.select("doc_id", pick(r'id="([^"]+)"').alias("context_id"), member.alias("member"), F.coalesce(pick(r"<(?:xbrli:)?endDate>\s*([0-9-]+)"), pick(r"<(?:xbrli:)?instant>\s*([0-9-]+)")).alias("end"), F.contains("x", F.lit("ProductOrServiceAxis")).alias("product_axis"))


def instance_facts(rows: DataFrame, concepts: dict[str, str]) -> DataFrame:
    """(doc_id, context_id, concept, value) of the named tags."""
    out = None
    for tag, name in concepts.items():
        found = rows.select("doc_id", F.explode(F.regexp_extract_all("value", F.lit(rf'<{tag}\b[^>]*contextRef="[^"]+"[^>]*>[^<]*<'), F.lit(0))).alias("x"))
        part = found.select("doc_id", F.regexp_extract("x", 'contextRef="([^"]+)"', 1).alias("context_id"), F.lit(name).alias("concept"), F.regexp_extract("x", ">([^<]*)<", 1).try_cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def instance_file(names: Column) -> Column:
    """Of a filing's file names the first *_htm.xml, else the first .xml that is no linkbase and no summary."""
    first = F.filter(names, lambda n: F.endswith(n, F.lit("_htm.xml")))
    other = F.filter(names, lambda n: F.endswith(n, F.lit(".xml")) & ~F.regexp_like(n, F.lit(r"(_cal|_def|_lab|_pre)\.xml$|^FilingSummary")))
    return F.coalesce(F.get(first, F.lit(0)), F.get(other, F.lit(0)))


def summary_reports(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, file, name, category) of a filing summary's reports; those without a file are left out."""
    found = rows.select("doc_id", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<Report\b.*?</Report>"), F.lit(0))).alias("pos", "x"))
    read = found.select("doc_id", "pos", F.from_xml("x", "HtmlFileName string, ShortName string, MenuCategory string", {"rowTag": "Report"}).alias("r"))
    tag = lambda t: F.trim(F.coalesce(F.col(f"r.{t}"), F.lit("")))
    return read.select("doc_id", "pos", tag("HtmlFileName").alias("file"), tag("ShortName").alias("name"), tag("MenuCategory").alias("category")).where("file <> ''")


def weekly_chart(rows: DataFrame) -> DataFrame:
    """(company_id, week, volume): timestamps and volumes zipped, weeks without a volume dropped."""
    zipped = rows.select("company_id", F.from_json("value", CHART).alias("c")).select("company_id", F.inline(F.arrays_zip("c.timestamp", "c.volume")))
    return zipped.where("volume is not null").select("company_id", F.to_date(F.timestamp_seconds("timestamp")).alias("week"), "volume")


class Table(HTMLParser):
    """Rows of cells of the constituents table: the one with that id, else the first wikitable."""

    def __init__(self):
        super().__init__()
        self.tables: list[tuple[bool, list[list[str]]]] = []
        self.open = self.cell = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            named = a.get("id") == "constituents"
            self.open = named or "wikitable" in (a.get("class") or "")
            if self.open:
                self.tables.append((named, []))
        elif self.open and tag == "tr":
            self.tables[-1][1].append([])
        elif self.open and tag in ("td", "th") and self.tables[-1][1]:
            self.tables[-1][1][-1].append("")
            self.cell = True

    def handle_endtag(self, tag):
        self.cell = self.cell and tag not in ("td", "th")
        self.open = self.open and tag != "table"

    def handle_data(self, data):
        if self.open and self.cell:
            self.tables[-1][1][-1][-1] += data

    def rows(self) -> list[list[str]]:
        return next((r for named, r in self.tables if named), self.tables[0][1] if self.tables else [])


def constituents(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, symbol, cik) from a page's table, whose header says where symbol or ticker and cik stand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, value in zip(batch["doc_id"], batch["value"]):
                table = Table()
                table.feed(value or "")
                head, *body = table.rows() or [[]]
                labels = [h.strip().lower() for h in head]
                at = {k: next((i for i, h in enumerate(labels) if any(w in h for w in ws)), None) for k, ws in (("symbol", ("symbol", "ticker")), ("cik", ("cik",)))}
                if at["symbol"] is None:
                    continue
                get = lambda r, i: r[i].strip() if i is not None and i < len(r) else None
                out += [(doc_id, k, get(r, at["symbol"]), get(r, at["cik"])) for k, r in enumerate(body) if get(r, at["symbol"])]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "symbol", "cik"])

    return pages.select("doc_id", "value").mapInPandas(run, "doc_id long, pos int, symbol string, cik string")


def workbook_cells(content: bytes) -> list[list[str]]:
    """Rows of the first sheet of a workbook, shared and inline strings resolved, cells at their columns."""
    name = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{name}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        first = next((n for n in z.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml")), None)
        if first is None:
            return []
        sheet = ElementTree.fromstring(z.read(first))
    rows = []
    for r in sheet.iter(f"{name}row"):
        cells: dict[int, str] = {}
        for c in r.iter(f"{name}c"):
            at = 0
            for letter in "".join(x for x in c.get("r", "A") if x.isalpha()):
                at = at * 26 + ord(letter) - 64
            value = "".join(t.text or "" for t in c.iter(f"{name}t")) if c.get("t") == "inlineStr" else (c.findtext(f"{name}v") or "")
            cells[at - 1] = shared[int(value)] if c.get("t") == "s" and value else value
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def fund_holdings(rows: list[list[str]]) -> tuple[str | None, list[tuple[str, float | None]]]:
    """A fund's name and its (ticker, weight) rows; the header is the first row with both labels in its cells.

    The name stands after a label before the header. Rows without a ticker are left out, as are
    all rows if there is no header; weights that are no number are null.
    """
    labels = [[c.lower() for c in r] for r in rows]
    at = lambda cells, label: next((k for k, c in enumerate(cells) if label in c), None)
    head = next((k for k, r in enumerate(labels) if at(r, "ticker") is not None and at(r, "weight") is not None), None)
    named = (r[k + 1 :] for r, low in zip(rows[:head], labels) if (k := at(low, "fund name")) is not None)
    name = next((c.strip() for cells in named for c in cells if c.strip()), None)
    if head is None:
        return name, []
    t, w = at(labels[head], "ticker"), at(labels[head], "weight")
    get = lambda r, k: r[k].strip() if k < len(r) else ""
    return name, [(get(r, t), number if pd.notna(number := pd.to_numeric(get(r, w), errors="coerce")) else None) for r in rows[head + 1 :] if get(r, t)]


def holdings(files: DataFrame) -> DataFrame:
    """(path, pos, ticker, weight) of funds' workbooks, read as binary files; see fund_holdings()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(path, k, *row) for path, content in zip(batch["path"], batch["content"]) for k, row in enumerate(fund_holdings(workbook_cells(content))[1])]
            yield pd.DataFrame(out, columns=["path", "pos", "ticker", "weight"])

    return files.select("path", "content").mapInPandas(run, "path string, pos int, ticker string, weight double")


# Fields of a vendor's statements and company profile, one JSON array for each endpoint.
VENDOR_SCHEMAS = {
    "income": "symbol string, date string, fiscalYear string, period string, reportedCurrency string, revenue double, costOfRevenue double, grossProfit double, operatingIncome double, ebitda double, netIncome double, eps double",
    "ratios": "symbol string, fiscalYear string, period string, grossProfitMargin double, operatingProfitMargin double, netProfitMargin double, currentRatio double, debtToEquityRatio double",
    "balance": "symbol string, fiscalYear string, period string, cashAndShortTermInvestments double, totalDebt double",
    "cash": "symbol string, fiscalYear string, period string, operatingCashFlow double, freeCashFlow double",
    "profile": "symbol string, companyName string, cik string, industry string, sector string, marketCap double, description string",
}


def vendor(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of one endpoint's JSON arrays; fields in any case, unknown ones left out, missing ones null."""
    return spark.read.schema(VENDOR_SCHEMAS[kind]).option("multiLine", True).json(path)
