"""Queries of a sector model from a raw table of uses.

Every line item is a line of such a table: what its seller's country makes is bought by its
buyer's. Open lines are value added. There are two files, whose headers have other offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.checkpoints import checkpointed
from tallyforge.operators import io_model as io
from tallyforge.operators import use_table as U
from tallyforge.plans.economy import EACH, rounded, series
from tallyforge.plans.indices import RULES
from tallyforge.registry import query
from tallyforge.sources.domain import table

#: A code for each country; two have no sector, one is a government electric utility.
CODES = (
    "1111A0", "113000", "211000", "212100", "212230", "213111", "213113", "221100", "230101", "311111", "325412", "314110", "321113",
    "324110", "S00402", "334111", "331110", "336111", "336411", "445000", "4A0000", "52A000", "531000", "515000", "S00101",
)
TITLES = {"a.txt": "Commodity Industry  Detail  PurVal          IOYear", "b.txt": "Industry  PurVal               IOYear    Commodity"}
#: The columns of each file in their order, with their widths.
LAYOUT = {"a.txt": (("row", 10), ("column", 10), ("detail", 8), ("amount", 16), ("year", 6)), "b.txt": (("column", 10), ("amount", 21), ("year", 10), ("row", 9))}
SECTORS = tuple(sorted({s for _, s in RULES if s}))

SELLER_ROW = "CASE WHEN rf = 'N' THEN CASE WHEN line % 7 = 0 THEN 'T00500' WHEN line % 3 = 0 THEN 'V00200' WHEN ls = 'O' THEN 'V00100' ELSE 'V00300' END WHEN line = 6 AND size % 2 = 0 THEN 's00300' ELSE {} END"
SECTOR = "CASE " + " ".join(f"WHEN starts_with({{0}}, '{p}') THEN {repr(s) if s else 'NULL'}" for p, s in RULES) + " END"
BASE = f"""codes AS (SELECT [{", ".join(f"'{c}'" for c in CODES)}] AS c),
lines AS (SELECT sn.s_nationkey AS sk, cn.c_nationkey AS ck, l_returnflag AS rf, l_linestatus AS ls, l_linenumber AS line, l_orderkey AS size, round(l_extendedprice::DECIMAL(12, 2) * (1 - l_discount::DECIMAL(4, 2)), 2)::DOUBLE AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer cn ON o_custkey = c_custkey JOIN supplier sn ON l_suppkey = s_suppkey),
flows AS (SELECT upper({SELLER_ROW.format("c[sk + 1]")}) AS r, c[ck + 1] AS k, value FROM lines, codes WHERE value <> 0),
u AS (SELECT r, k, value, {SECTOR.format("r")} AS rs, {SECTOR.format("k")} AS s, CASE WHEN starts_with(r, 'V001') THEN 'labor' WHEN starts_with(r, 'V002') THEN 'taxes' WHEN starts_with(r, 'V003') THEN 'capital' WHEN left(r, 1) IN ('V', 'T', 'F') THEN 'total' ELSE 'input' END AS kind FROM flows),
z AS (SELECT rs AS i, s AS j, sum(value) AS z FROM u WHERE kind = 'input' AND rs IS NOT NULL AND s IS NOT NULL GROUP BY ALL),
x AS (SELECT s AS j, sum(value) AS x, coalesce(sum(value) FILTER (kind = 'labor'), 0) AS labor, coalesce(sum(value) FILTER (kind = 'energy'), 0) AS energy, coalesce(sum(value) FILTER (kind = 'capital'), 0) AS capital, coalesce(sum(value) FILTER (kind = 'taxes'), 0) AS taxes
  FROM u WHERE s IS NOT NULL AND kind <> 'total' GROUP BY s)"""


def sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BASE, *more]) + "\n" + body


def headers(spark: SparkSession) -> DataFrame:
    """(file, value): the first line of either file."""
    return spark.createDataFrame(list(TITLES.items()), "file string, value string")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, value): the text of both files, headers among them."""
    code = lambda key: F.get(F.array(*map(F.lit, CODES)), F.col(key))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", code("c_nationkey").alias("column"))
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", code("s_nationkey").alias("made"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    net = F.expr("cast(round(cast(l_extendedprice AS decimal(12, 2)) * (1 - cast(l_discount AS decimal(4, 2))), 2) AS decimal(14, 2))")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("size"), net.alias("net"))
    found = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    found = found.withColumns({"row": F.expr(SELLER_ROW.format("made")), "amount": F.lpad(F.col("net").cast("string"), 14, " "), "detail": F.lit("."), "year": F.lit("2002")})
    text = lambda f: F.concat(*(F.rpad(c, n, " ") for c, n in LAYOUT[f]))
    file = F.when(F.col("line") % 2 == 0, "a.txt").otherwise("b.txt")
    body = found.select(file.alias("file"), F.when(file == "a.txt", text("a.txt")).otherwise(text("b.txt")).alias("value"))
    return headers(spark).unionByName(body)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most a row for each pair of codes; several readers follow, so it's written once."""
    rules = spark.createDataFrame([(p, s) for p, s in RULES], "prefix string, sector string")
    return checkpointed(U.classified(U.use_lines(lines(spark, sf_dir), headers(spark)), rules))


@query("use_table_z", sql("SELECT i, j, round(z, 2) AS z FROM z"))
def use_table_z(spark, d):
    return rounded(U.sales(classified(spark, d)), z=2)


@query("use_table_accounts", sql("SELECT x.j AS sector, round(labor, 2) AS labor, round(energy, 2) AS energy, round(capital, 2) AS capital, round(taxes, 2) AS taxes, round(x, 2) AS x, round(x - coalesce(s, 0), 2) AS d FROM x LEFT JOIN (SELECT i, sum(z) AS s FROM z GROUP BY i) q ON q.i = x.j"))
def use_table_accounts(spark, d):
    """Value added, output and final demand, output less what is sold to sectors, of each sector."""
    rows = classified(spark, d)
    account = U.accounts(rows)
    demand = io.final_demand(U.sales(rows), account.select(F.col("sector").alias("j"), "x")).select(F.col("i").alias("sector"), "d")
    return rounded(account.join(demand, "sector"), labor=2, energy=2, capital=2, taxes=2, x=2, d=2)


@query("use_table_intensities", sql("SELECT j AS sector, round(labor / x, 8) AS labor, round(energy / x, 8) AS energy, round(capital / x, 8) AS capital, round(taxes / x, 8) AS taxes, round((labor + energy + capital + taxes) / x, 8) AS v FROM x"))
def use_table_intensities(spark, d):
    return rounded(U.intensities(U.accounts(classified(spark, d))), labor=8, energy=8, capital=8, taxes=8, v=8)


@query("use_table_coefficients", sql("SELECT i, x.j, round(z / x, 8) AS a FROM z JOIN x ON z.j = x.j"))
def use_table_coefficients(spark, d):
    rows = classified(spark, d)
    output = U.accounts(rows).select(F.col("sector").alias("j"), "x")
    return rounded(io.coefficients(U.sales(rows).withColumn("model_id", F.lit("use")), output).select("i", "j", "a"), a=8)


@query("use_table_ledger", sql("""SELECT side, code, fate, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT 'column' AS side, k AS code, 'dropped' AS fate, value FROM u WHERE s IS NULL
  UNION ALL SELECT 'row', r, CASE kind WHEN 'total' THEN 'ignored' ELSE 'output only' END, value FROM u WHERE s IS NOT NULL AND (kind = 'total' OR kind = 'input' AND rs IS NULL)) GROUP BY ALL"""))
def use_table_ledger(spark, d):
    """Codes without a sector, on either side, and what became of them."""
    return rounded(U.ledger(classified(spark, d)), value=2)


@query("use_table_concordance", sql("SELECT DISTINCT code, sector FROM (SELECT k AS code, s AS sector FROM u UNION ALL SELECT r, rs FROM u WHERE s IS NOT NULL AND kind = 'input') WHERE sector IS NOT NULL"))
def use_table_concordance(spark, d):
    """The codes in use and their sectors."""
    rows = classified(spark, d)
    used = rows.where("kind = 'input' AND sector IS NOT NULL").select(F.col("row").alias("code"), F.col("row_sector").alias("sector"))
    return used.union(rows.select("column", "sector")).where("sector IS NOT NULL").distinct()


@query("use_table_multipliers", sql("SELECT c AS sector, round(sum(v), 6) AS multiplier FROM p GROUP BY c", "a AS (SELECT i, x.j, z / x AS a FROM z JOIN x ON z.j = x.j)", series("p", "a", EACH)))
def use_table_multipliers(spark, d):
    """What a unit of each sector's final demand takes of all sectors' output."""
    rows = classified(spark, d)
    output = U.accounts(rows).select(F.col("sector").alias("j"), "x")
    place = F.create_map(*(x for k, s in enumerate(SECTORS) for x in (F.lit(s), F.lit(k))))
    a = io.coefficients(U.sales(rows).withColumn("model_id", F.lit("use")), output).select("model_id", place[F.col("i")].alias("i"), place[F.col("j")].alias("j"), "a")
    return rounded(io.multipliers(io.inverse(a)).select(F.get(F.array(*map(F.lit, SECTORS)), F.col("i")).alias("sector"), "multiplier"), multiplier=6)
