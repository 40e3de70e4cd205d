"""Queries of financial facts: orders stand for facts, events for bars of volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import facts as X
from tallyforge.operators.reads import active
from tallyforge.registry import query
from tallyforge.sources import domain as D
from tallyforge.sources.domain import table, with_views

KEYS = "o_custkey AS company_id, year(o_orderdate)::VARCHAR AS fiscal_year, CASE WHEN o_orderkey % 5 = 0 THEN 'fy' ELSE 'q' || quarter(o_orderdate) END AS period"


def statements(spark, d):
    """Income, ratios, balance and cash rows of each company; one order in five is annual, some periods and years are bad."""
    o = table(spark, d, "orders")
    period = F.when(F.col("o_orderkey") % 5 == 0, "fy").otherwise(F.concat(F.lit("q"), F.quarter("o_orderdate")))
    rows = o.select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").cast("string").alias("fiscal_year"), period.alias("period"), "o_orderkey", "o_totalprice")
    income = X.first_per(rows, ["company_id", "fiscal_year", "period"], [F.col("o_orderkey")])
    income = income.select("company_id", F.when(F.col("o_orderkey") % 29 == 0, "n/a").otherwise(F.col("fiscal_year")).alias("fiscal_year"), F.when(F.col("o_orderkey") % 23 == 0, "h1").otherwise(F.col("period")).alias("period"), F.col("o_totalprice").alias("revenue"), F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice / 4) END").cast("double").alias("gross_profit"))
    side = rows.withColumn("period", F.upper("period"))
    pick = lambda test, name, value: side.where(test).select("company_id", "fiscal_year", "period", F.col("o_orderkey").alias("seq"), F.expr(value).alias(name))
    return income, pick("o_orderkey % 2 = 0", "gross_margin", "CASE WHEN o_orderkey % 4 = 0 THEN 0.5D END"), pick("o_orderkey % 3 = 0", "total_debt", "o_totalprice"), pick("o_orderkey % 7 = 0", "free_cash_flow", "-o_totalprice")


@query("statement_merge", f"""WITH r AS (SELECT {KEYS}, o_orderkey AS k, o_totalprice AS p FROM orders),
i AS (SELECT company_id, try_cast(CASE WHEN k % 29 = 0 THEN 'n/a' ELSE fiscal_year END AS INT) AS fiscal_year, upper(CASE WHEN k % 23 = 0 THEN 'h1' ELSE period END) AS period, p AS revenue, CASE WHEN k % 3 <> 0 THEN floor(p / 4) END AS gross_profit
  FROM r QUALIFY row_number() OVER (PARTITION BY company_id, fiscal_year, r.period ORDER BY k) = 1),
s AS (SELECT company_id, fiscal_year::INT AS fiscal_year, upper(period) AS period, k, p FROM r),
a AS (SELECT *, CASE WHEN k % 4 = 0 THEN 0.5 END AS gross_margin FROM s WHERE k % 2 = 0 QUALIFY row_number() OVER (PARTITION BY company_id, fiscal_year, period ORDER BY k) = 1),
b AS (SELECT *, p AS total_debt FROM s WHERE k % 3 = 0 QUALIFY row_number() OVER (PARTITION BY company_id, fiscal_year, period ORDER BY k) = 1),
c AS (SELECT *, -p AS free_cash_flow FROM s WHERE k % 7 = 0 QUALIFY row_number() OVER (PARTITION BY company_id, fiscal_year, period ORDER BY k) = 1)
SELECT i.company_id, i.fiscal_year, i.period, revenue, gross_profit, round(coalesce(gross_margin, gross_profit / nullif(revenue, 0)), 6)::DOUBLE AS gross_margin, total_debt, free_cash_flow
FROM i LEFT JOIN a USING (company_id, fiscal_year, period) LEFT JOIN b USING (company_id, fiscal_year, period) LEFT JOIN c USING (company_id, fiscal_year, period)
WHERE fiscal_year IS NOT NULL AND period IN ('FY', 'Q1', 'Q2', 'Q3', 'Q4')""")  # fmt: skip
def statement_merge(spark, d):
    found = X.merge_statements(*statements(spark, d)).withColumn("gross_margin", F.round("gross_margin", 6))
    return found.select("company_id", "fiscal_year", "period", "revenue", "gross_profit", "gross_margin", "total_debt", "free_cash_flow")


@query("fallback_source", """WITH f AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), y AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1)
SELECT id, n, 'first' AS source FROM f UNION ALL SELECT id, n, 'second' FROM y WHERE id NOT IN (SELECT id FROM f)""")  # fmt: skip
def fallback_source(spark, d):
    """The second source serves companies for which the first has no row at all."""
    count = lambda p, s: table(spark, d, "orders").where(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")).withColumn("source", F.lit(s))
    first, second = count("1-URGENT", "first"), count("2-HIGH", "second")
    return first.unionByName(second.join(first, "id", "left_anti"))


CONCEPTS = ["1-URGENT", "3-MEDIUM", "5-LOW"]
FACTS = "f AS (SELECT o_custkey AS company_id, o_orderpriority AS concept, o_totalprice AS val, o_orderdate::DATE AS \"end\", o_orderkey AS seq, CASE WHEN o_orderstatus = 'O' THEN '10-Q' ELSE '10-K' END AS form FROM orders), k AS (SELECT *, list_position(['1-URGENT', '3-MEDIUM', '5-LOW'], concept) AS p FROM f WHERE form = '10-K' AND concept IN ('1-URGENT', '3-MEDIUM', '5-LOW'))"


def facts(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("concept"), F.col("o_totalprice").alias("val"), F.to_date("o_orderdate").alias("end"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "10-Q").otherwise("10-K").alias("form"))


@query("latest_annual", f"WITH {FACTS} SELECT company_id, concept, val, year(\"end\")::VARCHAR AS label FROM k QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY p, \"end\" DESC, seq) = 1")
def latest_annual(spark, d):
    return X.latest_fact(facts(spark, d), CONCEPTS).select("company_id", "concept", "val", F.year("end").cast("string").alias("label"))


@query("annual_for_end", f"""WITH {FACTS}, w AS (SELECT company_id, CASE WHEN company_id % 2 = 0 THEN min("end") ELSE DATE '1900-01-01' END AS wanted FROM k GROUP BY company_id),
e AS (SELECT k.company_id, val FROM k JOIN w ON k.company_id = w.company_id AND k."end" = wanted QUALIFY row_number() OVER (PARTITION BY k.company_id ORDER BY p, seq) = 1),
l AS (SELECT company_id, val FROM k QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY p, "end" DESC, seq) = 1)
SELECT w.company_id, coalesce(e.val, l.val) AS val, e.val IS NOT NULL AS is_exact FROM w LEFT JOIN e USING (company_id) LEFT JOIN l USING (company_id)""")  # fmt: skip
def annual_for_end(spark, d):
    f = facts(spark, d)
    ends = f.where(F.col("concept").isin(CONCEPTS) & (F.col("form") == "10-K")).groupBy("company_id").agg(F.min("end").alias("first"))
    ends = ends.select("company_id", F.when(F.col("company_id") % 2 == 0, F.col("first")).otherwise(F.lit("1900-01-01").cast("date")).alias("wanted"))
    return X.fact_for_end(f, CONCEPTS, ends)


SEGMENTS = "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS context_id, CASE WHEN l_linenumber < 7 THEN 'Segment' || l_suppkey % 50 END AS member, l_shipdate::DATE AS \"end\", l_quantity % 3 = 0 AS product_axis, l_extendedprice AS revenue, l_extendedprice * l_discount * 11 AS oi FROM lineitem"


@query("segment_cost", f"""WITH s AS ({SEGMENTS}), o AS (SELECT * FROM s WHERE member IS NOT NULL AND NOT product_axis), t AS (SELECT max("end") AS e FROM o)
SELECT member, revenue, round(oi, 4) AS operating_income, round(revenue - oi, 4) AS cost, revenue - oi >= 0 AND revenue - oi <= revenue AS reconciles FROM o, t WHERE "end" = e QUALIFY row_number() OVER (PARTITION BY member ORDER BY context_id) = 1""")  # fmt: skip
def segment_cost(spark, d):
    return X.segment_costs(contexts(spark, d)).withColumns({c: F.round(c, 4) for c in ("operating_income", "cost")})


def contexts(spark, d):
    """One row for each context, with its facts beside it: one scan."""
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    return table(spark, d, "lineitem").select(ident.alias("context_id"), F.when(F.col("l_linenumber") < 7, F.concat(F.lit("Segment"), F.col("l_suppkey") % 50)).alias("member"), F.to_date("l_shipdate").alias("end"), (F.col("l_quantity") % 3 == 0).alias("product_axis"), F.col("l_extendedprice").alias("revenue"), (F.col("l_extendedprice") * F.col("l_discount") * 11).alias("operating_income"))


@query("segment_revenue", f"""WITH s AS ({SEGMENTS}), o AS (SELECT * FROM s WHERE member IS NOT NULL AND NOT product_axis), t AS (SELECT max("end") AS e FROM o)
SELECT member, revenue FROM o, t WHERE "end" = e QUALIFY row_number() OVER (PARTITION BY member ORDER BY context_id) = 1""")  # fmt: skip
def segment_revenue(spark, d):
    """Segments' revenue stands without an operating income."""
    lacking = contexts(spark, d).withColumn("operating_income", F.when(F.col("member") != "Segment1", F.col("operating_income")))
    return X.segment_revenues(lacking)


@query("xbrl_view", f"""WITH s AS ({SEGMENTS}), o AS (SELECT * FROM s WHERE member IS NOT NULL AND NOT product_axis), t AS (SELECT max("end") AS e FROM o),
f AS (SELECT member, revenue FROM o, t WHERE "end" = e QUALIFY row_number() OVER (PARTITION BY member ORDER BY context_id) = 1),
a AS (SELECT sum(l_extendedprice) AS total FROM lineitem, t WHERE l_shipdate::DATE = e AND l_linenumber < 7 AND l_quantity::INT % 3 <> 0)
SELECT 'total' AS part, NULL AS member, round(total, 2) AS revenue, CASE WHEN total > 0 THEN abs((SELECT sum(revenue) FROM f) - total) <= 0.01 * total END AS ties FROM a UNION ALL SELECT 'segment', member, round(revenue, 2), NULL FROM f""")  # fmt: skip
def xbrl_view(spark, d):
    """A filing's totals and segments with whether they tie: all contexts of the latest period stand for the total."""
    rows = contexts(spark, d)
    segments = X.segment_revenues(rows)
    total = X.at_target(rows).agg(F.sum("revenue").alias("total"))
    sums = segments.agg(F.sum("revenue").alias("s"))
    head = total.crossJoin(F.broadcast(sums)).select(F.lit("total").alias("part"), F.lit(None).cast("string").alias("member"), F.round("total", 2).alias("revenue"), X.ties(F.col("s"), F.col("total")).alias("ties"))  # one row each
    return head.unionByName(segments.select(F.lit("segment").alias("part"), "member", F.round("revenue", 2).alias("revenue"), F.lit(None).cast("boolean").alias("ties")))


@query("edgar_refresh", """WITH y AS (SELECT o_custkey AS company_id, year(o_orderdate) AS fy, max(o_orderdate)::DATE AS "end", sum(o_totalprice) AS revenue, sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END) AS cogs FROM orders GROUP BY ALL),
l AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY fy DESC) = 1)
SELECT company_id, 'REVENUE' AS kind, 'Revenue ' || fy AS name, round(revenue, 2) AS value FROM l UNION ALL SELECT company_id, 'COGS', 'Cost of revenue ' || CASE WHEN company_id % 2 = 0 THEN fy ELSE year("end") END, round(cogs, 2) FROM l WHERE cogs IS NOT NULL UNION ALL SELECT company_id, 'OPEX', 'Operating expenses n/a', round(revenue - 1, 2) FROM l""")  # fmt: skip
def edgar_refresh(spark, d):
    """Three rows of a company's latest year; the label is the fiscal year, else the period's end, else n/a."""
    o = table(spark, d, "orders")
    by_year = o.groupBy(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year")).agg(F.to_date(F.max("o_orderdate")).alias("end"), F.sum("o_totalprice").alias("revenue"), F.sum(F.when(F.col("o_orderpriority").like("1%"), F.col("o_totalprice"))).alias("cogs"))
    last = by_year.groupBy("company_id").agg(F.max_by(F.struct("fiscal_year", "end", "revenue", "cogs"), "fiscal_year").alias("y")).select("company_id", "y.*")
    row = lambda value, year, end: last.select("company_id", year.alias("fiscal_year"), end.alias("end"), value.alias("value"))
    year, end, none = F.col("fiscal_year"), F.col("end"), F.lit(None)
    annual = {"REVENUE": row(F.col("revenue"), year, end), "COGS": row(F.col("cogs"), F.when(F.col("company_id") % 2 == 0, year), end), "OPEX": row(F.col("revenue") - 1, none.cast("int"), none.cast("date"))}
    return X.refreshed(annual, "company_id").withColumn("value", F.round("value", 2))


@query("sum_check", """SELECT id, CASE WHEN total > 0 AND s IS NOT NULL THEN abs(s - total) <= 0.01 * total END AS ok FROM (SELECT o_orderkey AS id, o_totalprice AS total, sum(l_extendedprice) AS s FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber < 7) ON l_orderkey = o_orderkey GROUP BY ALL)""")
def sum_check(spark, d):
    s = table(spark, d, "lineitem").where("l_linenumber < 7").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    return table(spark, d, "orders").join(s, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), X.ties(F.col("s"), F.col("o_totalprice")).alias("ok"))


MEMBER = "CASE p_partkey % 6 WHEN 0 THEN 'Segment' WHEN 1 THEN 'GreaterChinaSegment' WHEN 2 THEN 'iPhone4Member' WHEN 3 THEN regexp_replace(p_brand, '[^A-Za-z]', '') || 'UnitSegment' WHEN 4 THEN 'R2D2Unit' ELSE 'AmericasSegmentMember' END"


@query("pretty_segment", f"SELECT p_partkey AS id, CASE WHEN s = '' THEN m ELSE s END AS label FROM (SELECT p_partkey, m, regexp_replace(regexp_replace(m, 'Segment$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g') AS s FROM (SELECT p_partkey, {MEMBER.replace(chr(39) + chr(39) + ')', chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS m FROM part))")
def pretty_segment(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.pretty_segment(F.expr(MEMBER)).alias("label"))


WEEKS = "w AS (SELECT user_id AS company_id, date_trunc('week', ts)::DATE AS week, count(*) AS n, round(sum(value::DECIMAL(18, 6)), 4)::DOUBLE AS volume FROM events WHERE value IS NOT NULL GROUP BY ALL)"


def weeks(spark, d):
    return X.weekly(table(spark, d, "events").withColumnRenamed("user_id", "company_id"))


@query("weekly_volume", f"WITH {WEEKS} SELECT * FROM w")
def weekly_volume(spark, d):
    return weeks(spark, d)


@query("volume_append", f"""WITH {WEEKS}, st AS (SELECT * FROM w WHERE company_id % 3 <> 0 AND week <= (SELECT min(week) FROM w) + 7), m AS (SELECT company_id, max(week) AS last FROM st GROUP BY 1)
SELECT company_id, week, n, volume FROM st UNION ALL SELECT w.company_id, week, n, volume FROM w LEFT JOIN m USING (company_id) WHERE last IS NULL OR week > last""")  # fmt: skip
def volume_append(spark, d):
    w = weeks(spark, d)
    first = w.agg(F.min("week").alias("first"))
    stored = w.join(F.broadcast(first)).where("company_id % 3 <> 0 and week <= date_add(first, 7)").drop("first")
    return X.append_newer(stored, w)


@query("volume_last_n", f"WITH {WEEKS} SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY week DESC) <= 3")
def volume_last_n(spark, d):
    return X.last_n(weeks(spark, d), 3)


@query("stale_volume", f"WITH {WEEKS} SELECT company_id, max(week) AS last FROM w GROUP BY 1 HAVING max(week) <= DATE '2024-01-24'")
def stale_volume(spark, d):
    return weeks(spark, d).groupBy("company_id").agg(F.max("week").alias("last")).where("last <= date '2024-01-24'")


@query("staleness", "SELECT o_custkey AS company_id, max(o_orderdate)::DATE AS last, max(o_orderdate)::DATE < DATE '1998-08-02' - 400 AS stale FROM orders GROUP BY 1")
def staleness(spark, d):
    """As of a given day, never the clock's."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.to_date(F.max("o_orderdate")).alias("last"))
    return last.withColumn("stale", F.col("last") < F.date_sub(F.lit("1998-08-02").cast("date"), 400))


@query("missing_financials", with_views("SELECT id FROM companies WHERE NOT deleted AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')", "companies"))
def missing_financials(spark, d):
    have = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"))
    return active(D.companies(spark, d)).join(have, "id", "left_anti").select("id")
