"""Queries that list, search and describe the company graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import reads as R
from tallyforge.operators.ranking import global_rank
from tallyforge.registry import query
from tallyforge.sources import domain as D
from tallyforge.sources.domain import table, with_views


@query("company_country", with_views("SELECT c.id, c.name, c.cik, n.name AS country, n.region FROM companies c LEFT JOIN countries n ON c.country_id = n.id WHERE NOT c.deleted", "companies", "countries"))
def company_country(spark, d):
    n = D.countries(spark, d).select(F.col("id").alias("country_id"), F.col("name").alias("country"), "region")
    return R.active(D.companies(spark, d)).join(F.broadcast(n), "country_id", "left").select("id", "name", "cik", "country", "region")


SUB = "CASE WHEN id % 7 <> 0 THEN industry || '_UNIT_SUB' END"


@query("company_profile", with_views(f"""SELECT c.id, c.name, coalesce(replace(sector, '_', ' '), '—') AS sector_label, coalesce(replace(industry, '_', ' '), '—') AS industry_label, coalesce(replace(regexp_replace({SUB.replace('id', 'c.id', 1)}, '_SUB$', ''), '_', ' '), '—') AS sub_industry_label, n.code AS country_code, revenue_total
FROM companies c LEFT JOIN countries n ON c.country_id = n.id WHERE NOT c.deleted""", "companies", "countries"))  # fmt: skip
def company_profile(spark, d):
    n = D.countries(spark, d).select(F.col("id").alias("country_id"), F.col("code").alias("country_code"))
    found = R.active(D.companies(spark, d)).join(F.broadcast(n), "country_id", "left")
    return found.select("id", "name", T.label(F.col("sector")).alias("sector_label"), T.label(F.col("industry")).alias("industry_label"), T.label(F.expr(SUB), "_SUB").alias("sub_industry_label"), "country_code", "revenue_total")


@query("company_events", with_views("SELECT c.id, string_agg(e.id || ':' || e.title, ',' ORDER BY e.id) AS events FROM companies c JOIN evts e ON e.company_id = c.id WHERE NOT c.deleted AND NOT e.deleted GROUP BY c.id", "companies", "evts"))
def company_events(spark, d):
    """A company with shallow references to its events, by id; companies without one have no row."""
    refs = R.nested(R.active(D.events(spark, d)), "company_id", "id", "title")
    c = R.active(D.companies(spark, d)).select("id").join(refs.withColumnRenamed("company_id", "id"), "id")
    return c.select("id", F.array_join(F.transform("refs", lambda r: F.concat(r["id"], F.lit(":"), r["name"])), ",").alias("events"))


EIGHT = {"cik": "cik", "sector": "sector", "industry": "industry", "subIndustry": "CASE WHEN id % 7 <> 0 THEN industry END", "revenueTotal": "revenue_total", "grossMargin": "CASE WHEN id % 4 <> 0 THEN market_cap END", "country": "country_id", "asOf": "CASE WHEN id % 5 = 0 THEN ' ' WHEN id % 5 = 1 THEN name END"}


@query("profile_missing_fields", with_views("SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {v} IS NULL OR trim(({v})::VARCHAR) = '' THEN '{k}' END" for k, v in EIGHT.items()) + "], lambda x: x IS NOT NULL), ',') AS missing FROM companies WHERE NOT deleted", "companies"))
def profile_missing_fields(spark, d):
    return R.active(D.companies(spark, d)).select("id", F.array_join(R.missing_fields({k: F.expr(v) for k, v in EIGHT.items()}), ",").alias("missing"))


@query("contrib_approved", with_views("SELECT b.id, s.s_name AS seller, c.name AS buyer, b.value, row_number() OVER (PARTITION BY s.s_name ORDER BY c.name, b.id)::INT AS place FROM contributions b LEFT JOIN supplier s ON b.company_id = s.s_suppkey LEFT JOIN companies c ON b.related_company_id = c.id WHERE b.status = 'Approved' AND NOT b.deleted", "contributions", "companies"))
def contrib_approved(spark, d):
    """With each row's place in its company's list, which is ordered by name."""
    from pyspark.sql import Window

    seller = table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("seller"))
    buyer = table(spark, d, "customer").select(F.col("c_custkey").alias("related_company_id"), F.col("c_name").alias("buyer"))
    found = R.public(D.contributions(spark, d)).join(seller, "company_id", "left").join(buyer, "related_company_id", "left")
    return found.select("id", "seller", "buyer", "value", F.row_number().over(Window.partitionBy("seller").orderBy("buyer", "id")).alias("place"))


@query("log_page", "SELECT event_id AS id, event_type AS line FROM events WHERE user_id = 1 ORDER BY event_id OFFSET 5")
def log_page(spark, d):
    """Lines of one log from a number on: the offset is the feature."""
    return table(spark, d, "events").where("user_id = 1").orderBy("event_id").offset(5).select(F.col("event_id").alias("id"), F.col("event_type").alias("line"))


TERM = "0000"


@query("search_company_prefix", with_views(f"SELECT c.id, c.name, c.cik FROM companies c LEFT JOIN countries n ON c.country_id = n.id WHERE NOT c.deleted AND (c.name ILIKE '{TERM}%' OR c.cik ILIKE '{TERM}%' OR n.name ILIKE '{TERM}%')", "companies", "countries"))
def search_company_prefix(spark, d):
    n = D.countries(spark, d).select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    return R.matching(R.active(D.companies(spark, d)).join(F.broadcast(n), "country_id", "left"), TERM, "name", "cik", "country").select("id", "name", "cik")


@query("search_variants", with_views(f"""SELECT 'company_lookup' AS kind, id::VARCHAR AS id FROM companies WHERE NOT deleted AND (name ILIKE '{TERM}%' OR cik ILIKE '{TERM}%')
UNION ALL SELECT 'country', id::VARCHAR FROM countries WHERE name ILIKE 'n1%' OR code ILIKE 'n1%' OR region ILIKE 'n1%' UNION ALL SELECT 'country_lookup', id::VARCHAR FROM countries WHERE name ILIKE 'nation_1%'
UNION ALL SELECT 'contribution', b.id FROM contributions b LEFT JOIN companies c ON c.id = b.related_company_id WHERE NOT b.deleted AND (b.id ILIKE '%3-1%' OR c.name ILIKE '%3-1%')
UNION ALL SELECT 'filing', o_orderkey::VARCHAR FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey::VARCHAR ILIKE '%00%' OR o_orderpriority ILIKE '%00%' OR c_name ILIKE '%00%'
UNION ALL SELECT 'bloc', r_regionkey::VARCHAR FROM region WHERE r_name ILIKE '%ia%' OR r_regionkey::VARCHAR ILIKE '%ia%'
UNION ALL SELECT 'scenario', n_nationkey::VARCHAR FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name ILIKE '%on_1%' OR r_name ILIKE '%on_1%' UNION ALL SELECT 'advantage', p_partkey::VARCHAR FROM part WHERE p_name ILIKE '%el%' OR p_type ILIKE '%el%'
UNION ALL SELECT 'shock', c_custkey::VARCHAR FROM customer WHERE c_mktsegment ILIKE '%bu%' OR c_name ILIKE '%bu%' OR c_nationkey::VARCHAR ILIKE '%bu%'
UNION ALL SELECT 'details', c.id::VARCHAR FROM companies c LEFT JOIN countries n ON n.id = c.country_id WHERE c.sector ILIKE '%an%' OR n.name ILIKE '%an%'""", "companies", "countries", "contributions"))  # fmt: skip
def search_variants(spark, d):
    """Every search's own columns: prefixes for lookups, anywhere for the rest."""
    c, n = D.companies(spark, d), D.countries(spark, d)
    where = n.select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    buyers = c.select(F.col("id").alias("related_company_id"), "name")
    filings = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("form"), F.col("o_custkey").alias("c_custkey")).join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    blocs = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))
    found = {
        "company_lookup": R.matching(R.active(c), TERM, "name", "cik"),
        "country": R.matching(n, "n1", "name", "code", "region"),
        "country_lookup": R.matching(n, "nation_1", "name"),
        "contribution": R.matching(R.active(D.contributions(spark, d)).join(buyers, "related_company_id", "left"), "3-1", "id", "name", contains=True),
        "filing": R.matching(filings, "00", "id", "form", "c_name", contains=True),
        "bloc": R.matching(blocs, "ia", "name", "id", contains=True),
        "scenario": R.matching(n, "on_1", "name", "region", contains=True),
        "advantage": R.matching(table(spark, d, "part").withColumn("id", F.col("p_partkey")), "el", "p_name", "p_type", contains=True),
        "shock": R.matching(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_name", F.col("c_nationkey").cast("string").alias("target")), "bu", "c_mktsegment", "c_name", "target", contains=True),
        "details": R.matching(c.join(F.broadcast(where), "country_id", "left"), "an", "sector", "country", contains=True),
    }
    out = None
    for kind, rows in found.items():
        part = rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("search_contains", with_views("SELECT id, title, impact FROM evts WHERE NOT deleted AND (title ILIKE '%ic%' OR props ILIKE '%ic%')", "evts"))
def search_contains(spark, d):
    return R.matching(R.active(D.events(spark, d)), "ic", "title", "props", contains=True).select("id", "title", "impact")


FINANCIALS = """fin AS (SELECT o_custkey AS company_id, year(o_orderdate)::INT AS fiscal_year, 'Q' || quarter(o_orderdate) AS period, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY ALL
UNION ALL SELECT o_custkey, year(o_orderdate)::INT, 'FY', round(sum(o_totalprice), 2) FROM orders GROUP BY ALL)"""


def financials(spark, d):
    """Revenue of each company by quarter, and by year as period FY."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("period"), "o_totalprice")
    total = F.round(F.sum("o_totalprice"), 2).alias("revenue")
    quarters = o.groupBy("company_id", "fiscal_year", "period").agg(total)
    years = o.groupBy("company_id", "fiscal_year").agg(total).select("company_id", "fiscal_year", F.lit("FY").alias("period"), "revenue")
    return quarters.unionByName(years)


@query("search_year_or_name", f"WITH {FINANCIALS} SELECT company_id, c_name AS name, fiscal_year, period, revenue FROM fin JOIN customer ON company_id = c_custkey WHERE fiscal_year = 1996 OR c_name ILIKE '%1996%'")
def search_year_or_name(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))
    return R.year_or_name(financials(spark, d).join(names, "company_id"), "1996", "fiscal_year", "name").select("company_id", "name", "fiscal_year", "period", "revenue")


@query("financials_ordered", f"""WITH {FINANCIALS}, p(period, ordinal) AS (VALUES ('FY', 0), ('Q1', 1), ('Q2', 2), ('Q3', 3), ('Q4', 4))
SELECT company_id, fiscal_year, period, revenue, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC, ordinal)::INT AS place FROM fin JOIN p USING (period)""")  # fmt: skip
def financials_ordered(spark, d):
    from pyspark.sql import Window

    ordinal = F.when(F.col("period") == "FY", 0).otherwise(F.substring("period", 2, 1).cast("int"))
    return financials(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"), ordinal)))


@query("global_search", with_views("""SELECT kind, label, detail, n AS place FROM (SELECT kind, label, detail, row_number() OVER (PARTITION BY kind ORDER BY label, detail)::INT AS n FROM (
  SELECT 'CO' AS kind, name AS label, nullif(concat_ws(' · ', cik, sector), '') AS detail FROM companies WHERE NOT deleted AND name ILIKE 'c%' UNION ALL SELECT 'CTRY', name, code || ' · ' || region FROM countries WHERE name ILIKE 'c%'
  UNION ALL SELECT DISTINCT 'EVT', title, NULL FROM evts WHERE NOT deleted AND title ILIKE '%c%')) WHERE n <= 5""", "companies", "countries", "evts"))  # fmt: skip
def global_search(spark, d):
    """Five of each kind with a line of detail, null if there is none; a kind with no match has no row."""
    from pyspark.sql import Window

    pick = lambda df, kind, label, *detail: df.select(F.lit(kind).alias("kind"), F.col(label).alias("label"), T.dotted(*(F.col(c) for c in detail)).alias("detail"))
    found = pick(R.matching(R.active(D.companies(spark, d)), "c", "name"), "CO", "name", "cik", "sector")
    found = found.unionByName(pick(R.matching(D.countries(spark, d), "c", "name"), "CTRY", "name", "code", "region"))
    found = found.unionByName(pick(R.matching(R.active(D.events(spark, d)), "c", "title", contains=True), "EVT", "title").distinct())
    return found.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("label", "detail"))).where("place <= 5")


@query("end_date_order", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END, TIMESTAMP '0001-01-01') DESC, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) END DESC NULLS LAST, o_orderkey)::INT AS place FROM orders")
def end_date_order(spark, d):
    """Newest end first, no end last, then the fiscal year, none of it last."""
    from pyspark.sql import Window

    end = F.coalesce(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp")), F.lit("0001-01-01").cast("timestamp"))
    year = F.when(F.col("o_orderkey") % 3 != 0, F.year("o_orderdate"))
    order = Window.partitionBy("o_custkey").orderBy(end.desc(), year.desc_nulls_last(), "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.row_number().over(order).alias("place"))


@query("lookup_top10", with_views("SELECT id, name FROM companies WHERE NOT deleted AND name ILIKE 'customer%' ORDER BY name, id LIMIT 10", "companies"))
def lookup_top10(spark, d):
    """The ten first names: the limit is the feature."""
    return R.matching(R.active(D.companies(spark, d)), "customer", "name").orderBy("name", "id").limit(10).select("id", "name")


GDP = "CASE WHEN id % 6 <> 0 THEN id * 37 % 101 * 12345000000.0 END"


@query("ticker_feed", with_views(f"""SELECT * FROM (SELECT 'event' AS kind, id, title AS label, strftime(ts, '%Y-%m-%d') AS value, CASE WHEN impact < 0 THEN 'down' ELSE 'up' END AS tone FROM evts WHERE NOT deleted ORDER BY ts DESC, id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'company', id, name, 'REV $' || format('{{:,.1f}}', revenue_total / 1e9) || 'B', CASE WHEN market_cap < 0 THEN 'down' ELSE 'up' END FROM companies WHERE NOT deleted AND revenue_total IS NOT NULL ORDER BY revenue_total DESC, id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'country', id, code || ' ' || name, 'GDP $' || format('{{:,.1f}}', gdp / 1e9) || 'B', 'up' FROM (SELECT *, {GDP} AS gdp FROM countries) WHERE gdp IS NOT NULL ORDER BY gdp DESC, id LIMIT 8)""", "evts", "companies", "countries"))  # fmt: skip
def ticker_feed(spark, d):
    """The newest events, the companies that earn most and the countries that produce most, each with a line; the limits are the feature."""
    tone = lambda c: F.when(F.col(c) < 0, "down").otherwise("up").alias("tone")
    e = R.active(D.events(spark, d)).orderBy(F.desc("ts"), "id").limit(8).select(F.lit("event").alias("kind"), "id", F.col("title").alias("label"), F.date_format("ts", "yyyy-MM-dd").alias("value"), tone("impact"))
    c = R.active(D.companies(spark, d)).where("revenue_total IS NOT NULL").orderBy(F.desc("revenue_total"), "id").limit(8)
    c = c.select(F.lit("company").alias("kind"), "id", F.col("name").alias("label"), T.amount_line("REV", F.col("revenue_total")).alias("value"), tone("market_cap"))
    n = D.countries(spark, d).withColumn("gdp", F.expr(GDP).cast("double")).where("gdp IS NOT NULL").orderBy(F.desc("gdp"), "id").limit(8)
    n = n.select(F.lit("country").alias("kind"), "id", F.concat_ws(" ", "code", "name").alias("label"), T.amount_line("GDP", F.col("gdp")).alias("value"), F.lit("up").alias("tone"))
    return e.unionByName(c).unionByName(n)


@query("event_members", with_views("SELECT e.id AS event_id, c.id AS company_id, n.id AS country_id FROM evts e JOIN companies c ON e.company_id = c.id JOIN countries n ON c.country_id = n.id WHERE NOT e.deleted AND NOT c.deleted", "evts", "companies", "countries"))
def event_members(spark, d):
    """Links of active events to active companies, and through them to countries."""
    c = R.active(D.companies(spark, d)).select(F.col("id").alias("company_id"), "country_id")
    return R.active(D.events(spark, d)).join(c, "company_id").select(F.col("id").alias("event_id"), "company_id", "country_id")


@query("country_companies", with_views("SELECT n.name AS country, c.name, row_number() OVER (PARTITION BY n.id ORDER BY c.name, c.id)::INT AS place FROM companies c JOIN countries n ON c.country_id = n.id WHERE NOT c.deleted", "companies", "countries"))
def country_companies(spark, d):
    """Companies by country and name: numbered over all countries by ranges, less the number each country starts at."""
    n = D.countries(spark, d).select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    found = global_rank(R.active(D.companies(spark, d)).select("country_id", "name", "id"), [F.col("country_id"), F.col("name"), F.col("id")], "number")
    first = found.groupBy("country_id").agg(F.min("number").alias("first"))
    return found.join(F.broadcast(first.join(n, "country_id")), "country_id").select("country", "name", (F.col("number") - F.col("first") + 1).alias("place"))


@query("caps_by_ids", with_views("SELECT id, market_cap FROM companies WHERE NOT deleted AND id IN (SELECT DISTINCT user_id FROM events)", "companies"))
def caps_by_ids(spark, d):
    wanted = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return R.active(D.companies(spark, d)).join(wanted, "id", "left_semi").select("id", "market_cap")


# A company's revenue sources are its sales, its cost sources those of the buyers that keep books of them, every third.
COSTED = "related_company_id % 3 = 0"


@query("deletable_companies", with_views(f"SELECT id FROM companies c WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM contributions b WHERE b.company_id = c.id AND NOT b.deleted) AND NOT EXISTS (SELECT 1 FROM contributions b WHERE b.related_company_id = c.id AND NOT b.deleted AND {COSTED})", "companies", "contributions"))
def deletable_companies(spark, d):
    """Companies without any active revenue or cost source, whatever its value or status."""
    rows = D.contributions(spark, d)
    ends = rows.select("deleted", F.explode(F.array(F.col("company_id"), F.when(F.expr(COSTED), F.col("related_company_id")))).alias("owner"))
    return R.unreferenced(R.active(D.companies(spark, d)), ends.where("owner IS NOT NULL"), "owner").select("id")


SELLERS = "SELECT s_suppkey AS id, s_nationkey::BIGINT AS country_id, s_suppkey % 4 = 0 AS deleted FROM supplier"


@query("deletable_countries", with_views(f"SELECT id FROM countries n WHERE NOT EXISTS (SELECT 1 FROM ({SELLERS}) s WHERE s.country_id = n.id AND NOT s.deleted)", "countries"))
def deletable_countries(spark, d):
    """Countries without an active company; sellers are the companies here."""
    sellers = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("country_id"), (F.col("s_suppkey") % 4 == 0).alias("deleted"))
    return R.unreferenced(D.countries(spark, d), sellers, "country_id").select("id")


@query("deletable_blocs", f"SELECT n_nationkey::BIGINT AS id FROM nation n WHERE NOT EXISTS (SELECT 1 FROM ({SELLERS}) s WHERE s.country_id % 25 = n.n_nationkey * 7 % 25 AND NOT s.deleted)")
def deletable_blocs(spark, d):
    """Blocs, one for each country and made of another, without an active member."""
    blocs = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    members = table(spark, d, "supplier").select((F.col("s_nationkey").cast("long") * 18 % 25).alias("bloc_id"), (F.col("s_suppkey") % 4 == 0).alias("deleted"))  # 7 times 18 is 1 modulo 25
    return R.unreferenced(blocs, members, "bloc_id").select("id")


@query("status_envelope", with_views("""SELECT w.id, CASE WHEN c.id IS NULL THEN 'not_found' WHEN c.cik IS NULL THEN 'unavailable' WHEN f.company_id IS NULL THEN 'missing' ELSE 'present' END AS status, coalesce(f.n, 0) AS rows
FROM (SELECT DISTINCT user_id AS id FROM events UNION SELECT c_custkey + 1000000 FROM customer WHERE c_custkey < 5) w LEFT JOIN (SELECT * FROM companies WHERE NOT deleted) c USING (id)
LEFT JOIN (SELECT o_custkey AS company_id, count(*) AS n FROM orders GROUP BY 1) f ON f.company_id = w.id""", "companies"))  # fmt: skip
def status_envelope(spark, d):
    """What a tool answers for a company: not_found, unavailable (no CIK), missing (no data) or present."""
    ids = table(spark, d, "events").select(F.col("user_id").alias("id")).union(table(spark, d, "customer").where("c_custkey < 5").select(F.col("c_custkey") + 1000000)).distinct()
    c = R.active(D.companies(spark, d)).select("id", F.lit(True).alias("known"), "cik")
    f = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    status = F.when(F.col("known").isNull(), "not_found").when(F.col("cik").isNull(), "unavailable").when(F.col("n").isNull(), "missing").otherwise("present")
    return ids.join(c, "id", "left").join(f, "id", "left").select("id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("rows"))
