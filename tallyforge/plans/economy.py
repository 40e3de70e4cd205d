"""Queries of the input-output economy: regions trade, by seller's and buyer's region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.checkpoints import checkpointed
from tallyforge.operators import io_model as io
from tallyforge.registry import query
from tallyforge.sources import domain
from tallyforge.sources.domain import table

ORIGIN, UNIT = 1, 1.0
ROUNDS = 70  # of the SQL's power series; its rest is under 1e-12

BASE = """f AS (SELECT sn.n_regionkey AS i, cn.n_regionkey AS j, l_returnflag AS rf, l_linestatus AS ls, sum(l_extendedprice * (1 - l_discount)) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY ALL),
z AS (SELECT i, j, sum(v) AS z FROM f WHERE rf <> 'N' GROUP BY ALL),
va AS (SELECT j, sum(CASE WHEN ls = 'F' THEN v ELSE 0 END) AS labor, sum(CASE WHEN ls = 'O' THEN v ELSE 0 END) AS capital FROM f WHERE rf = 'N' GROUP BY j),
x AS (SELECT j, coalesce(b, 0) + coalesce(labor, 0) + coalesce(capital, 0) AS x FROM (SELECT j, sum(z) AS b FROM z GROUP BY j) FULL JOIN va USING (j)),
a AS (SELECT i, z.j, z / x AS a FROM z JOIN x ON z.j = x.j),
d AS (SELECT x.j AS i, x, x - coalesce(s, 0) AS d FROM x LEFT JOIN (SELECT i, sum(z) AS s FROM z GROUP BY i) q ON x.j = q.i)"""


def sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BASE, *more]) + "\n" + body


def series(name: str, matrix: str, start: str, transposed: bool = False) -> str:
    """name(r, c, i, v): rounds of the power series from each starting column c."""
    row, column = ("j", "i") if transposed else ("i", "j")
    return f"""{name} AS (SELECT 0 AS r, c, i, v FROM ({start})
  UNION ALL SELECT p.r + 1, p.c, m.{row}, sum(m.a * p.v) FROM {name} p JOIN {matrix} m ON m.{column} = p.i WHERE p.r < {ROUNDS} GROUP BY p.r, p.c, m.{row})"""


EACH = "SELECT j AS c, k.j2 AS i, CASE WHEN j = k.j2 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM x, (SELECT j AS j2 FROM x) k"
ONE = f"SELECT 0 AS c, j AS i, CASE WHEN j = {ORIGIN} THEN {UNIT} ELSE 0.0 END::DOUBLE AS v FROM x"
GHOSH = "b AS (SELECT a.i, a.j, a.a * xj.x / xi.x AS a FROM a JOIN x xj ON a.j = xj.j JOIN x xi ON a.i = xi.j)"
INVERSE = (series("p", "a", EACH), "l AS (SELECT i, c AS j, sum(v) AS l FROM p GROUP BY i, c)")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, rf, ls, v): net value from seller region i to buyer region j by flag and status."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")  # 25 rows
    buyer = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("j"))
    seller = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("i"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    found = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    return found.groupBy("i", "j", "rf", "ls").agg(F.sum("net").alias("v"))


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """z, value added, output and coefficients of the one model. At most 100 rows of flows are kept, and read once."""
    f = checkpointed(flows(spark, sf_dir))
    z = f.where("rf <> 'N'").groupBy("i", "j").agg(F.sum("v").alias("z")).withColumn("model_id", F.lit("trade"))
    side = lambda s: F.sum(F.when(F.col("ls") == s, F.col("v")).otherwise(0.0))
    va = f.where("rf = 'N'").groupBy("j").agg(side("F").alias("labor"), side("O").alias("capital"))
    x = io.outputs(z, va)
    return z, va, x, io.coefficients(z, x)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Rounded columns, as sums of doubles depend on their order; never minus zero."""
    return df.withColumns({c: F.round(c, n) + 0.0 for c, n in digits.items()})


def shock(spark: SparkSession, origin: int = ORIGIN, size: float = UNIT) -> DataFrame:
    return spark.createDataFrame([(origin, size)], "k int, s double")


@query("io_build_z", sql("SELECT i, j, round(z, 2) AS z FROM z"))
def build_z(spark, d):
    return rounded(parts(spark, d)[0].select("i", "j", "z"), z=2)


@query("io_value_added", sql("SELECT j, round(labor, 2) AS labor, 0.0::DOUBLE AS energy, round(capital, 2) AS capital, 0.0::DOUBLE AS taxes, round(labor + capital, 2) AS v FROM va"))
def value_added(spark, d):
    va = parts(spark, d)[1].select("j", "labor", F.lit(0.0).alias("energy"), "capital", F.lit(0.0).alias("taxes"), (F.col("labor") + F.col("capital")).alias("v"))
    return rounded(va, labor=2, capital=2, v=2)


@query("io_coefficients", sql("SELECT i, j, round(a, 8) AS a FROM a"))
def coefficients(spark, d):
    return rounded(parts(spark, d)[3].select("i", "j", "a"), a=8)


@query("io_model_long", sql("SELECT 'a' AS part, i, j, round(a, 8) AS v FROM a UNION ALL SELECT 'd', i, NULL, round(d, 2) FROM d UNION ALL SELECT 'labor', j, NULL, round(labor, 2) FROM va UNION ALL SELECT 'capital', j, NULL, round(capital, 2) FROM va"))
def model_long(spark, d):
    z, va, x, a = parts(spark, d)
    none = F.lit(None).cast("int").alias("j")
    row = lambda df, part, at, v, n: rounded(df.select(F.lit(part).alias("part"), F.col(at).alias("i"), none, F.col(v).alias("v")), v=n)
    out = rounded(a.select(F.lit("a").alias("part"), "i", "j", F.col("a").alias("v")), v=8)
    return out.unionByName(row(io.final_demand(z, x), "d", "i", "d", 2)).unionByName(row(va, "labor", "j", "labor", 2)).unionByName(row(va, "capital", "j", "capital", 2))


@query("io_final_demand", sql("SELECT i, round(x, 2) AS x, round(d, 2) AS d FROM d"))
def final_demand(spark, d):
    z, _, x, _ = parts(spark, d)
    return rounded(io.final_demand(z, x), x=2, d=2)


@query("io_hawkins_simon", sql("SELECT j, round(sum(a), 8) AS colsum, sum(a) < 1 AS ok FROM a GROUP BY j"))
def hawkins_simon(spark, d):
    sums = parts(spark, d)[3].groupBy("j").agg(F.sum("a").alias("colsum"))
    return rounded(sums.withColumn("ok", F.col("colsum") < 1), colsum=8)


@query("io_leontief", sql("SELECT i, j, round(l, 6) AS l FROM l", *INVERSE))
def leontief(spark, d):
    return rounded(io.inverse(parts(spark, d)[3]).select("i", "j", "l"), l=6)


@query("io_baseline_output", sql("SELECT l.i, round(sum(l.l * d.d), 0) AS x FROM l JOIN d ON l.j = d.i GROUP BY l.i", *INVERSE))
def baseline_output(spark, d):
    z, _, x, a = parts(spark, d)
    demand = io.final_demand(z, x).select(F.col("i").alias("k"), F.col("d").alias("s"))
    return rounded(io.respond(io.inverse(a), demand).select("i", F.col("v").alias("x")), x=0)


@query("io_demand", sql("SELECT i, round(sum(v), 6) AS v FROM p GROUP BY i", series("p", "a", ONE)))
def demand(spark, d):
    return rounded(io.respond(io.inverse(parts(spark, d)[3]), shock(spark)), v=6)


@query("io_rank", sql("SELECT i, round(v, 6) AS v, (row_number() OVER (ORDER BY abs(v) DESC, i))::INT AS rank FROM (SELECT i, sum(v) AS v FROM p GROUP BY i) WHERE abs(v) > 1e-9", series("p", "a", ONE)))
def rank(spark, d):
    return rounded(io.ranked(io.respond(io.inverse(parts(spark, d)[3]), shock(spark))), v=6)


@query("io_price", sql("SELECT i, round(sum(v), 6) AS v FROM p GROUP BY i", series("p", "a", ONE, True)))
def price(spark, d):
    return rounded(io.respond(io.inverse(parts(spark, d)[3]), shock(spark), transposed=True), v=6)


@query("io_ghosh", sql("SELECT i, j, round(g, 6) AS g FROM (SELECT i, c AS j, sum(v) AS g FROM p GROUP BY i, c)", GHOSH, series("p", "b", EACH)))
def ghosh(spark, d):
    _, _, x, a = parts(spark, d)
    return rounded(io.inverse(io.allocation(a, x)).select("i", "j", F.col("l").alias("g")), g=6)


@query("io_supply", sql("SELECT i, round(sum(v), 6) AS v FROM p GROUP BY i", GHOSH, series("p", "b", ONE, True)))
def supply(spark, d):
    _, _, x, a = parts(spark, d)
    return rounded(io.respond(io.inverse(io.allocation(a, x)), shock(spark), transposed=True), v=6)


@query("io_multipliers", sql("SELECT j AS i, round(sum(l), 6) AS multiplier FROM l GROUP BY j", *INVERSE))
def multipliers(spark, d):
    return rounded(io.multipliers(io.inverse(parts(spark, d)[3])), multiplier=6)


@query("io_centrality", sql("SELECT i, round(s / avg(s) OVER (), 6) AS centrality FROM (SELECT i, sum(l) AS s FROM l GROUP BY i)", *INVERSE))
def centrality(spark, d):
    return rounded(io.row_centrality(io.inverse(parts(spark, d)[3])), centrality=6)


@query("io_diagnostics")
def diagnostics(spark, d):
    """Eigenvalues have no SQL; tests hold this against numpy."""
    return rounded(io.diagnostics(parts(spark, d)[3]), condition=6, radius=6)


@query("io_sector_profiles", sql("SELECT i, round(s, 6) AS share, CASE WHEN s < 0.35 THEN 'Upstream' WHEN s > 0.55 THEN 'Downstream' ELSE 'Mixed' END AS orientation, CASE WHEN s < 0.35 THEN 'Supply' ELSE 'Demand' END AS shock FROM (SELECT i, CASE WHEN x = 0 THEN 0 ELSE d / x END AS s FROM d)"))
def sector_profiles(spark, d):
    z, _, x, _ = parts(spark, d)
    return rounded(io.profiles(io.final_demand(z, x)), share=6)


ENDED = "e AS (SELECT coalesce((SELECT min(r) FROM (SELECT r, max(abs(v)) AS m FROM p GROUP BY r) WHERE m < 1e-9 AND r > 0), 70) AS last)"


@query("io_cascade_trace", sql("SELECT r AS round, i, round(v, 6) AS v FROM p, e WHERE r <= last", series("p", "a", ONE), ENDED))
def cascade_trace(spark, d):
    """Every round, up to the first in which nothing counts any more."""
    return rounded(io.cascade(parts(spark, d)[3], ORIGIN, UNIT).select("round", "i", "v"), v=6)


@query("io_cascade_total", sql("SELECT i, round(sum(v), 6) AS total, last AS depth, true AS converged FROM p, e WHERE r <= last GROUP BY i, last", series("p", "a", ONE, True), ENDED))
def cascade_total(spark, d):
    """What a cost shock's rounds add up to, how many there are, and that they die out."""
    return rounded(io.traced(io.cascade(parts(spark, d)[3], ORIGIN, UNIT, transposed=True)).drop("model_id"), total=6)


@query("io_trace_topk", sql("SELECT round, i, v FROM (SELECT r AS round, i, round(v, 6) AS v, row_number() OVER (PARTITION BY r ORDER BY abs(v) DESC, i) AS n FROM p, e WHERE r <= last) WHERE n <= 6", series("p", "a", ONE), ENDED))
def trace_topk(spark, d):
    """Six sectors of every round: the limit is the feature."""
    top = Window.partitionBy("round").orderBy(F.abs("v").desc(), "i")
    found = io.cascade(parts(spark, d)[3], ORIGIN, UNIT).withColumn("n", F.row_number().over(top)).where("n <= 6")
    return rounded(found.select("round", "i", "v"), v=6)


CHECKS = """SELECT 'coefficients_not_negative' AS name, min(a) >= 0 AS ok FROM a
UNION ALL SELECT 'column_sums_below_one', max(s) < 1 FROM (SELECT sum(a) AS s FROM a GROUP BY j)
UNION ALL SELECT 'value_added_not_negative', min(labor + capital) >= 0 FROM va
UNION ALL SELECT 'inverse_not_negative', min(l) >= -1e-6 FROM l
UNION ALL SELECT 'own_response_at_least_one', min(l) >= 1 FROM l WHERE i = j
UNION ALL SELECT 'multipliers_at_least_one', min(s) >= 1 FROM (SELECT sum(l) AS s FROM l GROUP BY j)
UNION ALL SELECT 'radius_below_one', max(m) < 1 FROM (SELECT r, max(abs(v)) AS m FROM p WHERE r = 70 GROUP BY r)
UNION ALL SELECT 'no_shock_no_response', max(abs(s)) <= 1e-6 FROM (SELECT sum(l * 0.0) AS s FROM l GROUP BY i)
UNION ALL SELECT 'twice_the_shock_twice_the_response', max(abs(t - 2 * s)) <= 1e-6 FROM (SELECT sum(l * 2.0) AS t, sum(l) AS s FROM l WHERE j = 0 GROUP BY i)
UNION ALL SELECT 'baseline_price_is_one', max(abs(p - 1)) <= 1e-6 FROM (SELECT l.j, sum(l.l * (1 - c.s)) AS p FROM l JOIN (SELECT j, sum(a) AS s FROM a GROUP BY j) c ON l.i = c.j GROUP BY l.j)"""


@query("io_invariants", sql(CHECKS, *INVERSE))
def invariants(spark, d):
    _, va, _, a = parts(spark, d)
    inv, sums = io.inverse(a), a.groupBy("j").agg(F.sum("a").alias("s"))
    prices = io.respond(inv, sums.select(F.col("j").alias("k"), (1 - F.col("s")).alias("s")), transposed=True)
    twice = io.respond(inv, shock(spark, 0, 1.0)).join(io.respond(inv, shock(spark, 0, 2.0)).withColumnRenamed("v", "t"), "i")
    row = lambda df, name, ok: df.agg(ok.alias("ok")).select(F.lit(name).alias("name"), "ok")
    out = row(a, "coefficients_not_negative", F.min("a") >= 0)
    for more in (
        row(sums, "column_sums_below_one", F.max("s") < 1),
        row(va, "value_added_not_negative", F.min(F.col("labor") + F.col("capital")) >= 0),
        row(inv, "inverse_not_negative", F.min("l") >= -1e-6),
        row(inv.where("i = j"), "own_response_at_least_one", F.min("l") >= 1),
        row(io.multipliers(inv), "multipliers_at_least_one", F.min("multiplier") >= 1),
        row(io.power_radius(a), "radius_below_one", F.max("radius") < 1),
        row(io.respond(inv, shock(spark, 0, 0.0)), "no_shock_no_response", F.max(F.abs("v")) <= 1e-6),
        row(twice, "twice_the_shock_twice_the_response", F.max(F.abs(F.col("t") - 2 * F.col("v"))) <= 1e-6),
        row(prices, "baseline_price_is_one", F.max(F.abs(F.col("v") - 1)) <= 1e-6),
    ):
        out = out.unionByName(more)
    return out


# A region's response reaches the companies of its countries; its industries are theirs.
MEMBERS = f"members AS (SELECT c.id, c.industry, c.revenue_total, n.bloc_id::INT AS sector FROM ({domain.SQL['companies']}) c JOIN ({domain.SQL['countries']}) n ON c.country_id = n.id WHERE NOT c.deleted)"
ALLOCATED = """r AS (SELECT i AS sector, sum(v) AS v FROM p GROUP BY i),
t AS (SELECT sector, sum(revenue_total) FILTER (revenue_total > 0) AS total, count(*) AS n FROM members GROUP BY sector),
al AS (SELECT m.sector, m.id, coalesce(m.industry, 'Unclassified') AS industry, CASE WHEN t.total > 0 THEN CASE WHEN m.revenue_total > 0 THEN m.revenue_total / t.total ELSE 0 END ELSE 1.0 / t.n END AS weight, r.v
  FROM members m JOIN t ON m.sector = t.sector JOIN r ON m.sector = r.sector WHERE abs(r.v) > 1e-9)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = domain.countries(spark, sf_dir).select(F.col("id").alias("country_id"), F.col("bloc_id").cast("int").alias("sector"))
    return domain.companies(spark, sf_dir).where("not deleted").drop("sector").join(F.broadcast(where), "country_id")


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.respond(io.inverse(parts(spark, sf_dir)[3]), shock(spark, size=1e6)).withColumnRenamed("i", "sector")


@query("io_company_allocation", sql("SELECT sector, id, industry, round(weight, 9) AS weight, round(weight * v * 1e6, 3) AS value FROM al", series("p", "a", ONE), MEMBERS, ALLOCATED))
def company_allocation(spark, d):
    return rounded(io.allocate(members(spark, d), deltas(spark, d)), weight=9, value=3)


@query("io_industry_rollup", sql("SELECT sector, industry, count(*) AS companies, round(sum(weight * v * 1e6), 2) AS value FROM al GROUP BY sector, industry", series("p", "a", ONE), MEMBERS, ALLOCATED))
def industry_rollup(spark, d):
    found = io.allocate(members(spark, d), deltas(spark, d))
    return rounded(found.groupBy("sector", "industry").agg(F.count("*").alias("companies"), F.sum("value").alias("value")), value=2)


@query("io_impact_full", sql("""SELECT kind, i, round(v, 6) AS v, (row_number() OVER (PARTITION BY kind ORDER BY abs(v) DESC, i))::INT AS rank FROM (
  SELECT 'Demand' AS kind, i, sum(v) AS v FROM p GROUP BY i UNION ALL SELECT 'Cost', i, sum(v) FROM q GROUP BY i UNION ALL SELECT 'Supply', i, sum(v) FROM s GROUP BY i) WHERE abs(v) > 1e-9""",
    series("p", "a", ONE), series("q", "a", ONE, True), GHOSH, series("s", "b", ONE, True)))
def impact_full(spark, d):
    """A unit shock of each kind on one region, ranked."""
    _, _, x, a = parts(spark, d)
    inv, one = io.inverse(a), shock(spark)
    kinds = {"Demand": io.respond(inv, one), "Cost": io.respond(inv, one, True), "Supply": io.respond(io.inverse(io.allocation(a, x)), one, True)}
    rows = None
    for kind, found in kinds.items():
        part = found.where(F.abs("v") > io.NEGLIGIBLE).select(F.lit(kind).alias("kind"), "i", "v")
        rows = part if rows is None else rows.unionByName(part)
    return rounded(rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.abs("v").desc(), "i"))), v=6)


@query("io_impact_result", sql("""SELECT kind, i, round(v, 4) AS v, is_price, depth, companies, round(top_value, 2) AS top_value FROM (
  SELECT kind, r.i, r.v, r.is_price, r.depth, count(m.id) AS companies, max(CASE WHEN r.is_price THEN coalesce(m.revenue_total, 0) * r.v ELSE r.v * CASE WHEN t.total > 0 THEN CASE WHEN m.revenue_total > 0 THEN m.revenue_total / t.total ELSE 0 END ELSE 1.0 / t.n END END) AS top_value
  FROM (SELECT 'Demand' AS kind, i, sum(v) AS v, false AS is_price, (SELECT last FROM e) AS depth FROM p GROUP BY i UNION ALL SELECT 'Cost', i, sum(v), true, (SELECT last FROM e2) FROM q GROUP BY i UNION ALL SELECT 'Supply', i, sum(v), false, NULL FROM s GROUP BY i) r
  LEFT JOIN members m ON m.sector = r.i LEFT JOIN t ON t.sector = r.i WHERE abs(r.v) > 1e-9 GROUP BY ALL)""",
    series("p", "a", ONE), series("q", "a", ONE, True), GHOSH, series("s", "b", ONE, True), ENDED, ENDED.replace("e AS", "e2 AS").replace("FROM p", "FROM q"), MEMBERS, ALLOCATED.partition("t AS")[1] + ALLOCATED.partition("t AS")[2].partition("\nal AS")[0].rstrip(",")))
def impact_result(spark, d):
    """A unit shock of each kind: sectors' responses, whether they are prices, the cascade's depth (none for supply), and who is hit most.

    The inverse is solved once for two kinds, and companies are aggregated by sector once for all
    three: the largest change of a company is the response times the largest or the least weight
    (or revenue, for prices), by its sign.
    """
    _, _, x, a = parts(spark, d)
    inv, one = checkpointed(io.inverse(a)), shock(spark)  # a row for each pair of sectors
    ghosh = io.inverse(io.allocation(a, x))
    kind = lambda df, name, price: df.select(F.lit(name).alias("kind"), "i", "v", F.lit(price).alias("is_price"))
    responses = kind(io.respond(inv, one), "Demand", False).unionByName(kind(io.respond(inv, one, True), "Cost", True)).unionByName(kind(io.respond(ghosh, one, True), "Supply", False))
    deep = lambda name, transposed: io.cascade(a, ORIGIN, UNIT, transposed).agg(F.max("round").alias("depth")).select(F.lit(name).alias("kind"), "depth")
    depths = deep("Demand", False).unionByName(deep("Cost", True))
    hit = responses.where(F.abs("v") > io.NEGLIGIBLE).join(F.broadcast(depths), "kind", "left")  # two rows
    found = hit.join(F.broadcast(io.extremes(members(spark, d)).withColumnRenamed("sector", "i")), "i", "left")  # a row for each sector
    largest = lambda most, least: F.col("v") * F.when(F.col("v") >= 0, F.col(most)).otherwise(F.col(least))
    top = F.when(F.col("is_price"), largest("most_revenue", "least_revenue")).otherwise(largest("most_weight", "least_weight"))
    rows = found.select("kind", "i", "v", "is_price", F.coalesce("companies", F.lit(0)).alias("companies"), top.alias("top_value"), "depth")
    return rounded(rows, v=4, top_value=2)


@query("io_factor_scenario", sql("SELECT i, round(sum(v), 6) AS v FROM p GROUP BY i", series("p", "a", "SELECT 0 AS c, x.j AS i, 0.5 * coalesce(labor, 0) / x + CASE x.j WHEN 2 THEN 1.0 ELSE 0.0 END AS v FROM x LEFT JOIN va USING (j)", True)))
def factor_scenario(spark, d):
    """A scenario of a factor shock, half of labour's share in every sector's output, and a sector shock: their responses add up."""
    _, va, x, a = parts(spark, d)
    factor = x.join(va, "j", "left").select(F.col("j").alias("k"), (0.5 * F.coalesce("labor", F.lit(0.0)) / F.col("x")).alias("s"))
    both = factor.unionByName(spark.createDataFrame([(2, 1.0)], "k int, s double")).groupBy("k").agg(F.sum("s").alias("s"))
    return rounded(io.respond(io.inverse(a), both, transposed=True), v=6)


@query("io_scenario_ext", sql("SELECT i, round(sum(v), 6) AS v FROM p GROUP BY i", series("p", "a", "SELECT 0 AS c, j AS i, CASE j WHEN 0 THEN 2.0 WHEN 3 THEN -1.0 ELSE 0.0 END::DOUBLE AS v FROM x")))
def scenario(spark, d):
    """Shocks add up, as the model is linear: an extension, the original keeps scenarios without solving them."""
    two = spark.createDataFrame([(0, 2.0), (3, -1.0)], "k int, s double")
    return rounded(io.respond(io.inverse(parts(spark, d)[3]), two), v=6)


NAMES = tuple(f"R{k}" for k in range(5))
SPOILED = {"ok": None, "order": "other sectors", "row": "not square", "short": "capital of another length", "minus": "negative coefficient", "heavy": "column sum of one or more", "owed": "negative value added", "text": "no JSON object"}


def model_files(spark, d):
    """(model_id, value): the trade model written as a file with comments, commas too many and keys in any case, and seven that are spoiled."""
    z, va, x, a = parts(spark, d)
    row = F.sort_array(F.collect_list(F.struct("j", "a")))["a"]
    matrix = F.sort_array(F.collect_list(F.struct("i", "row")))["row"]
    rows = a.groupBy("i").agg(row.alias("row")).agg(matrix.alias("A"))
    both = io.final_demand(z, x).join(va, F.col("i") == F.col("j"))
    vector = lambda c: F.sort_array(F.collect_list(F.struct("i", F.coalesce(c, F.lit(0.0)).alias("v"))))["v"]
    vectors = both.agg(*(vector(F.col(c)).alias(k) for k, c in (("d", "d"), ("labor", "labor"), ("capital", "capital"))), vector(F.lit(0.0)).alias("zero"))
    one = rows.crossJoin(F.broadcast(vectors))  # one row each
    kinds = one.select("*", F.explode(F.array(*map(F.lit, SPOILED))).alias("k"))
    named = F.when(F.col("k") == "order", F.reverse(F.array(*map(F.lit, NAMES)))).otherwise(F.array(*map(F.lit, NAMES)))
    spoil = lambda k, bad, good: F.when(F.col("k") == k, bad).otherwise(good)
    m = spoil("row", F.slice("A", 1, 4), spoil("minus", F.transform("A", lambda r: F.transform(r, lambda v: -v)), spoil("heavy", F.transform("A", lambda r: F.transform(r, lambda v: v * 9)), F.col("A"))))
    bits = [F.lit("// a model\n{\"SectorOrder\": "), F.to_json(named), F.lit(", /* \" , ] */ \"a\": "), F.to_json(m)]
    for key, value in (("LABOR", spoil("owed", F.transform("labor", lambda v: -v), F.col("labor"))), ("energy", F.col("zero")), ("Capital", spoil("short", F.slice("capital", 1, 3), F.col("capital"))), ("taxes", F.col("zero")), ("D", F.col("d"))):
        bits += [F.lit(f", \"{key}\": "), F.regexp_replace(F.to_json(value), r"\]$", ",]")]
    return kinds.select(F.col("k").alias("model_id"), F.concat(*bits, spoil("text", F.lit(","), F.lit(", }"))).alias("value"))


@query("io_model_files", sql("SELECT 'ok' AS model_id, 'a' AS part, i, j, round(a, 8) AS v FROM a UNION ALL SELECT 'ok', 'd', i, NULL, round(d, 2) FROM d UNION ALL SELECT 'ok', p, j, NULL, round(CASE p WHEN 'labor' THEN labor WHEN 'capital' THEN capital ELSE 0 END, 2) FROM va, (SELECT unnest(['labor', 'energy', 'capital', 'taxes']) AS p)"))
def io_model_files(spark, d):
    """The good models of some files, as long rows."""
    from tallyforge.sources.readers import models

    found, _ = models(model_files(spark, d), NAMES)
    return found.withColumn("v", F.when(F.col("part") == "a", F.round("v", 8)).otherwise(F.round("v", 2)) + 0.0)


@query("io_model_quarantine", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{why}')" for k, why in SPOILED.items() if why) + ") AS q(model_id, reason)")
def io_model_quarantine(spark, d):
    """The others, each with what is wrong with it."""
    from tallyforge.sources.readers import models

    return models(model_files(spark, d), NAMES)[1]
