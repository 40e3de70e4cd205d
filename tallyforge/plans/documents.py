"""Queries of companies as documents, and of what each of the seven tools answers from one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import documents as N
from tallyforge.operators.reads import active, missing_fields, public
from tallyforge.plans.reads import EIGHT, FINANCIALS, financials
from tallyforge.plans.statements import WEEKS, weeks
from tallyforge.registry import query
from tallyforge.sources import domain as D
from tallyforge.sources.domain import table, with_views

#: Weeks and filings that a payload has at most, and days after which data is stale.
WEEKS_CAP, FILINGS_CAP, STALE_DAYS = 52, 25, {"financials": 400, "volume": 30}
#: The day that staleness is told by, never the clock's.
TODAY = {"financials": "1998-08-02", "volume": "2024-02-20"}
#: Orders of these priorities stand for a company's risks, and all its orders for its filings.
SCOPES = {"1-URGENT": "FINANCIAL", "2-HIGH": "OPERATIONAL"}
CODE = "CASE WHEN id % 29 = 3 THEN 503 WHEN id % 31 = 5 THEN 500 WHEN id % 37 = 7 THEN 422 WHEN cik IS NULL THEN 409 ELSE 200 END"

VIEWS = f"""ch AS (SELECT 'events' AS kind, company_id, epoch_us(ts)::DOUBLE AS ord, id::VARCHAR AS tie, title || '|' || strftime(ts, '%Y-%m-%d') AS item FROM evts WHERE NOT deleted
UNION ALL SELECT 'revenue', company_id, -value, b.id, 'CUSTOMER|' || c.name || '|' || printf('%.2f', value) || '|' || related_company_id FROM contributions b JOIN companies c ON c.id = related_company_id WHERE status = 'Approved' AND NOT b.deleted
UNION ALL SELECT 'costs', related_company_id, -value, b.id, 'COGS|' || c.name || '|' || printf('%.2f', value) || '|' || company_id FROM contributions b JOIN companies c ON c.id = company_id WHERE status = 'Approved' AND NOT b.deleted
UNION ALL SELECT 'revenue_from', related_company_id, -value, b.id, c.name || '|' || printf('%.2f', value) FROM contributions b JOIN companies c ON c.id = company_id WHERE status = 'Approved' AND NOT b.deleted
UNION ALL SELECT 'cost_from', company_id, -value, b.id, c.name || '|' || printf('%.2f', value) FROM contributions b JOIN companies c ON c.id = related_company_id WHERE status = 'Approved' AND NOT b.deleted
UNION ALL SELECT 'risks', o_custkey, o_orderkey, o_orderkey::VARCHAR, CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SCOPES.items())} END || '|' || 'Risk ' || o_orderkey || '|' || CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE '' END FROM orders WHERE o_orderpriority IN ({', '.join(f"'{k}'" for k in SCOPES)})
UNION ALL SELECT 'financials', company_id, -fiscal_year, CASE period {' '.join(f"WHEN '{p}' THEN '{i}'" for i, p in enumerate(('Q4', 'Q3', 'Q2', 'Q1', 'FY')))} END, fiscal_year || '|' || period || '|' || printf('%.2f', revenue) FROM fin),
nd AS (SELECT company_id AS id, kind, count(*) AS n, string_agg(item, chr(10) ORDER BY ord, tie) AS items FROM ch GROUP BY ALL),
wanted AS (SELECT DISTINCT user_id AS id FROM events UNION SELECT s_suppkey FROM supplier UNION SELECT c_custkey + 1000000 FROM customer WHERE c_custkey < 5),
co AS (SELECT * FROM companies WHERE NOT deleted)"""


def sql(body: str, *more: str) -> str:
    return with_views("\x00", "contributions", "companies", "countries", "evts").replace("\n\x00", ",\n" + ",\n".join([FINANCIALS, VIEWS, *more]) + "\n" + body)


def children(spark: SparkSession, d: str, *kinds: str) -> list[DataFrame]:
    """Tagged rows of the wanted collections; contributions are read once, and their ends' names joined once, for all four that come of them."""
    out = []
    if "events" in kinds:
        e = active(D.events(spark, d))
        out.append(N.tagged(e, "events", "company_id", F.unix_micros(F.col("ts").cast("timestamp")), F.col("id"), title=F.col("title"), date=F.date_format("ts", "yyyy-MM-dd")))
    sides = {"revenue": ("company_id", "related_company_id", "CUSTOMER"), "costs": ("related_company_id", "company_id", "COGS"), "revenue_from": ("related_company_id", "company_id", None), "cost_from": ("company_id", "related_company_id", None)}
    if wanted := [k for k in sides if k in kinds]:
        seen = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(own).alias("own"), F.col(other).alias("other"), F.lit(label).cast("string").alias("label")) for k, (own, other, label) in sides.items() if k in wanted)))
        names = D.table(spark, d, "customer").select(F.col("c_custkey").alias("other"), F.col("c_name").alias("name"))
        rows = public(D.contributions(spark, d)).select("id", "value", seen.alias("s")).select("id", "value", "s.*").join(names, "other")
        item = F.to_variant_object(F.struct(F.col("label").alias("classification"), "name", F.format_string("%.2f", "value").alias("value"), F.col("other").cast("string").alias("related")))
        out.append(rows.select(F.col("own").alias("company_id"), "kind", (-F.col("value")).alias("at"), F.col("id").alias("tie"), item.alias("item")))
    o = table(spark, d, "orders")
    if "risks" in kinds:
        scope = F.create_map(*(F.lit(x) for pair in SCOPES.items() for x in pair))[F.col("o_orderpriority")]
        out.append(N.tagged(o.where(scope.isNotNull()), "risks", "o_custkey", F.col("o_orderkey"), F.col("o_orderkey"), scope=scope, name=F.concat(F.lit("Risk "), "o_orderkey"), note=F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))))
    if "financials" in kinds:
        newest_first = F.array_position(F.array(*map(F.lit, ("Q4", "Q3", "Q2", "Q1", "FY"))), F.col("period"))
        out.append(N.tagged(financials(spark, d), "financials", "company_id", -F.col("fiscal_year"), newest_first, year=F.col("fiscal_year").cast("string"), period=F.col("period"), revenue=F.format_string("%.2f", "revenue")))
    return out


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(id, known, ..) of the companies that tools are asked for, some of which aren't tracked."""
    ids = table(spark, d, "events").select(F.col("user_id").alias("id")).union(table(spark, d, "supplier").select("s_suppkey")).union(table(spark, d, "customer").where("c_custkey < 5").select(F.col("c_custkey") + 1000000)).distinct()
    return ids.join(active(D.companies(spark, d)).withColumn("known", F.lit(True)), "id", "left")


KINDS = ("events", "revenue", "costs", "revenue_from", "cost_from", "risks", "financials")
SHOWN = {"events": ("title", "date"), "revenue": ("classification", "name", "value", "related"), "costs": ("classification", "name", "value", "related"), "revenue_from": ("name", "value"), "cost_from": ("name", "value"), "risks": ("scope", "name", "note"), "financials": ("year", "period", "revenue")}


@query("company_document", sql("SELECT c.id, c.name, n.name AS country, 0 AS page, " + ", ".join(f"coalesce({k}.n, 0)::INT AS n_{k}, coalesce({k}.items, '') AS {k}" for k in KINDS) + " FROM co c LEFT JOIN countries n ON n.id = c.country_id " + " ".join(f"LEFT JOIN nd {k} ON {k}.id = c.id AND {k}.kind = '{k}'" for k in KINDS)))
def company_document(spark, d):
    """Every company with its seven collections."""
    n = D.countries(spark, d).select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    parents = active(D.companies(spark, d)).join(F.broadcast(n), "country_id", "left").select("id", "name", "country")
    found = N.nested(parents, children(spark, d, *KINDS), list(KINDS))
    return found.select("id", "name", "country", "page", *(c for k in KINDS for c in (F.size(k).alias(f"n_{k}"), N.listed(k, *SHOWN[k]).alias(k))))


TERMS = [f"Customer#{k:09d}"[:16] for k in range(0, 60, 10)] + ["Nobody#000000000"]


@query("tool_find_company", with_views(f"""SELECT t.term, CASE WHEN n IS NULL THEN 'no_match' ELSE 'present' END AS status, CASE WHEN n IS NULL THEN 'No tracked company matches ''' || t.term || '''.' ELSE n || ' match(es).' END AS note, coalesce(matches, '') AS matches FROM (SELECT unnest([{', '.join(f"'{t}'" for t in TERMS)}]) AS term) t
LEFT JOIN (SELECT term, count(*) AS n, string_agg(item, chr(10) ORDER BY name, id) AS matches FROM (SELECT left(c.name, 16) AS term, c.name, c.id, concat_ws('|', c.id, c.name, coalesce(c.cik, ''), coalesce(c.sector, ''), coalesce(n.name, '')) AS item, row_number() OVER (PARTITION BY left(c.name, 16) ORDER BY c.name, c.id) AS k FROM companies c LEFT JOIN countries n ON n.id = c.country_id WHERE NOT c.deleted) WHERE k <= 10 GROUP BY term) m ON m.term = t.term""", "companies", "countries"))  # fmt: skip
def tool_find_company(spark, d):
    """The ten first companies by name for each of some terms of equal length: a join on the prefix."""
    from pyspark.sql import Window

    n = D.countries(spark, d).select(F.col("id").alias("country_id"), F.col("name").alias("country"))
    found = active(D.companies(spark, d)).withColumn("term", F.substring("name", 1, 16)).where(F.col("term").isin(TERMS)).join(F.broadcast(n), "country_id", "left")
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy("name", "id"))).where("k <= 10")
    item = F.concat_ws("|", "id", "name", *(F.coalesce(c, F.lit("")) for c in ("cik", "sector", "country")))
    matches = found.groupBy("term").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.struct("k", item.alias("item"))))["item"], "\n").alias("matches"))
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    note = F.when(F.col("n").isNull(), F.concat(F.lit("No tracked company matches '"), "term", F.lit("'."))).otherwise(F.concat("n", F.lit(" match(es).")))
    return terms.join(matches, "term", "left").select("term", N.status((F.col("n").isNull(), "no_match")).alias("status"), note.alias("note"), F.coalesce("matches", F.lit("")).alias("matches"))


NOT_FOUND = "'No company with id ' || w.id || ' is tracked.'"
MISSING = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {v.replace('id ', 'c.id ')} IS NULL OR trim(({v.replace('id ', 'c.id ')})::VARCHAR) = '' THEN '{k}' END" for k, v in EIGHT.items()) + "], lambda x: x IS NOT NULL), ', ')"


def untracked(note):
    """``note``, or that the company isn't tracked."""
    return F.when(F.col("known").isNull(), F.concat(F.lit("No company with id "), "id", F.lit(" is tracked."))).otherwise(note)


@query("tool_profile", sql(f"SELECT w.id, CASE WHEN c.id IS NULL THEN 'not_found' ELSE 'present' END AS status, CASE WHEN c.id IS NULL THEN {NOT_FOUND} WHEN m = '' THEN 'Full profile present.' ELSE 'Present; no value for: ' || m || '.' END AS note, c.name, c.sector, c.industry, n.code AS country_code, c.revenue_total FROM wanted w LEFT JOIN (SELECT c.*, {MISSING} AS m FROM co c) c ON c.id = w.id LEFT JOIN countries n ON n.id = c.country_id"))
def tool_profile(spark, d):
    n = D.countries(spark, d).select(F.col("id").alias("country_id"), F.col("code").alias("country_code"))
    rows = asked(spark, d).join(F.broadcast(n), "country_id", "left").withColumn("m", F.array_join(missing_fields({k: F.expr(v) for k, v in EIGHT.items()}), ", "))
    note = F.when(F.col("m") == "", F.lit("Full profile present.")).otherwise(F.concat(F.lit("Present; no value for: "), "m", F.lit(".")))
    return rows.select("id", N.status((F.col("known").isNull(), "not_found")).alias("status"), untracked(note).alias("note"), "name", "sector", "industry", "country_code", "revenue_total")


@query("tool_financials", sql(f"""SELECT w.id, CASE WHEN c.id IS NULL THEN 'not_found' WHEN f.n IS NULL THEN 'missing' ELSE 'present' END AS status, CASE WHEN c.id IS NULL THEN {NOT_FOUND} WHEN f.n IS NULL THEN 'No financial history is loaded for this company yet.' WHEN k.stale THEN 'Present but possibly stale: newest captured ' || strftime(k.newest, '%Y-%m-%d') || '.' ELSE 'Present.' END AS note,
CASE WHEN c.id IS NULL OR f.n IS NULL THEN false ELSE k.stale END AS stale, CASE WHEN c.id IS NOT NULL THEN coalesce(f.items, '') ELSE '' END AS periods FROM wanted w LEFT JOIN co c ON c.id = w.id LEFT JOIN nd f ON f.id = w.id AND f.kind = 'financials'
LEFT JOIN (SELECT o_custkey AS id, max(o_orderdate)::DATE AS newest, max(o_orderdate)::DATE < DATE '{TODAY["financials"]}' - {STALE_DAYS["financials"]} AS stale FROM orders GROUP BY 1) k ON k.id = w.id"""))  # fmt: skip
def tool_financials(spark, d):
    newest = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_date(F.max("o_orderdate")).alias("newest"))
    rows = N.nested(asked(spark, d), children(spark, d, "financials"), ["financials"]).join(newest, "id", "left")
    there = F.col("known").isNotNull() & (F.size("financials") > 0)
    old = there & (F.col("newest") < F.date_sub(F.lit(TODAY["financials"]).cast("date"), STALE_DAYS["financials"]))
    note = F.when(~there, F.lit("No financial history is loaded for this company yet.")).when(old, F.concat(F.lit("Present but possibly stale: newest captured "), F.date_format("newest", "yyyy-MM-dd"), F.lit("."))).otherwise(F.lit("Present."))
    periods = F.when(F.col("known").isNotNull(), N.listed("financials", *SHOWN["financials"])).otherwise(F.lit(""))
    return rows.select("id", N.status((F.col("known").isNull(), "not_found"), (~there, "missing")).alias("status"), untracked(note).alias("note"), F.coalesce(old, F.lit(False)).alias("stale"), periods.alias("periods"))


@query("tool_risks", sql(f"SELECT w.id, CASE WHEN c.id IS NULL THEN 'not_found' WHEN r.n IS NULL THEN 'missing' ELSE 'present' END AS status, CASE WHEN c.id IS NULL THEN {NOT_FOUND} WHEN r.n IS NULL THEN 'No risk factors are extracted for this company yet.' ELSE r.n || ' risk factor(s).' END AS note, CASE WHEN c.id IS NULL THEN 0 ELSE coalesce(r.n, 0) END::INT AS n, CASE WHEN c.id IS NULL THEN '' ELSE coalesce(r.items, '') END AS risks FROM wanted w LEFT JOIN co c ON c.id = w.id LEFT JOIN nd r ON r.id = w.id AND r.kind = 'risks'"))
def tool_risks(spark, d):
    rows = N.nested(asked(spark, d), children(spark, d, "risks"), ["risks"])
    n = F.when(F.col("known").isNull(), 0).otherwise(F.size("risks"))
    note = F.when(n == 0, F.lit("No risk factors are extracted for this company yet.")).otherwise(F.concat(n, F.lit(" risk factor(s).")))
    return rows.select("id", N.status((F.col("known").isNull(), "not_found"), (n == 0, "missing")).alias("status"), untracked(note).alias("note"), n.alias("n"), F.when(n > 0, N.listed("risks", *SHOWN["risks"])).otherwise(F.lit("")).alias("risks"))


@query("tool_relationships", sql(f"""SELECT w.id, CASE WHEN c.id IS NULL THEN 'not_found' WHEN r.n IS NULL AND k.n IS NULL THEN 'missing' ELSE 'present' END AS status,
CASE WHEN c.id IS NULL THEN {NOT_FOUND} WHEN r.n IS NULL AND k.n IS NULL THEN 'No revenue or cost sources are recorded for this company.' ELSE coalesce(r.n, 0) || ' revenue source(s), ' || coalesce(k.n, 0) || ' cost source(s).' END AS note,
CASE WHEN c.id IS NULL THEN '' ELSE coalesce(r.items, '') END AS revenue, CASE WHEN c.id IS NULL THEN '' ELSE coalesce(k.items, '') END AS costs FROM wanted w LEFT JOIN co c ON c.id = w.id LEFT JOIN nd r ON r.id = w.id AND r.kind = 'revenue' LEFT JOIN nd k ON k.id = w.id AND k.kind = 'costs'"""))  # fmt: skip
def tool_relationships(spark, d):
    rows = N.nested(asked(spark, d), children(spark, d, "revenue", "costs"), ["revenue", "costs"])
    none, known = (F.size("revenue") == 0) & (F.size("costs") == 0), F.col("known").isNotNull()
    note = F.when(none, F.lit("No revenue or cost sources are recorded for this company.")).otherwise(F.concat(F.size("revenue"), F.lit(" revenue source(s), "), F.size("costs"), F.lit(" cost source(s).")))
    return rows.select("id", N.status((~known, "not_found"), (none, "missing")).alias("status"), untracked(note).alias("note"), *(F.when(known, N.listed(k, *SHOWN[k])).otherwise(F.lit("")).alias(k) for k in ("revenue", "costs")))


@query("tool_volume", sql(f"""SELECT w.id, CASE WHEN c.id IS NULL THEN 'not_found' WHEN v.n IS NULL THEN 'missing' ELSE 'present' END AS status, CASE WHEN c.id IS NULL THEN {NOT_FOUND} WHEN v.n IS NULL THEN 'No weekly volume has been ingested for this company.' WHEN v.stale THEN 'Present but latest bar is ' || v.latest || ': may be stale.' ELSE 'Present; showing last ' || least(v.n, {WEEKS_CAP}) || ' of ' || v.n || ' weeks.' END AS note,
coalesce(c.id IS NOT NULL AND v.stale, false) AS stale, CASE WHEN c.id IS NOT NULL THEN v.latest END AS latest_week, CASE WHEN c.id IS NULL THEN 0 ELSE coalesce(v.n, 0) END AS total_weeks, CASE WHEN c.id IS NULL THEN '' ELSE coalesce(v.items, '') END AS series
FROM wanted w LEFT JOIN co c ON c.id = w.id LEFT JOIN (SELECT company_id AS id, any_value(total) AS n, max(week)::VARCHAR AS latest, max(week) < DATE '{TODAY["volume"]}' - {STALE_DAYS["volume"]} AS stale, string_agg(week || '|' || printf('%.4f', volume), chr(10) ORDER BY week) FILTER (k <= {WEEKS_CAP}) AS items
  FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY week DESC) AS k, count(*) OVER (PARTITION BY company_id) AS total FROM w) GROUP BY 1) v ON v.id = w.id""", WEEKS))  # fmt: skip
def tool_volume(spark, d):
    """A company's last weeks: as many as it has are told, the series ends with the newest."""
    made = weeks(spark, d).groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"), F.max("week").alias("latest"), F.sort_array(F.collect_list(F.struct("week", "volume"))).alias("all"))  # a company has a week but once
    rows = asked(spark, d).join(made, "id", "left")
    known, there = F.col("known").isNotNull(), F.col("known").isNotNull() & F.col("n").isNotNull()
    old = there & (F.col("latest") < F.date_sub(F.lit(TODAY["volume"]).cast("date"), STALE_DAYS["volume"]))
    recent = F.slice("all", F.greatest(F.size("all") - WEEKS_CAP + 1, F.lit(1)), WEEKS_CAP)
    series = F.array_join(F.transform(recent, lambda x: F.concat_ws("|", x["week"].cast("string"), F.format_string("%.4f", x["volume"]))), "\n")
    note = F.when(~there, F.lit("No weekly volume has been ingested for this company.")).when(old, F.concat(F.lit("Present but latest bar is "), F.col("latest").cast("string"), F.lit(": may be stale."))).otherwise(F.concat(F.lit("Present; showing last "), F.least("n", F.lit(WEEKS_CAP)), F.lit(" of "), "n", F.lit(" weeks.")))
    return rows.select("id", N.status((~known, "not_found"), (~there, "missing")).alias("status"), untracked(note).alias("note"), F.coalesce(old, F.lit(False)).alias("stale"), F.when(there, F.col("latest").cast("string")).alias("latest_week"), F.when(there, F.col("n")).otherwise(0).alias("total_weeks"), F.when(there, series).otherwise(F.lit("")).alias("series"))


@query("tool_filings", sql(f"""SELECT w.id, CASE WHEN c.id IS NULL THEN 'not_found' WHEN code = 200 THEN CASE WHEN f.n IS NULL THEN 'missing' ELSE 'present' END WHEN code = 422 THEN 'missing' WHEN code = 409 THEN 'unavailable' ELSE 'error' END AS status, CASE WHEN code = 200 THEN least(coalesce(f.n, 0), {FILINGS_CAP}) ELSE 0 END::INT AS n, CASE WHEN code = 200 THEN coalesce(f.items, '') ELSE '' END AS filings
FROM wanted w LEFT JOIN (SELECT *, {CODE} AS code FROM co) c ON c.id = w.id LEFT JOIN (SELECT o_custkey AS id, count(*) AS n, string_agg(CASE WHEN o_orderkey % 4 <> 0 THEN '10-K' ELSE '' END || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|acc-' || o_orderkey, chr(10) ORDER BY o_orderdate DESC, o_orderkey) FILTER (k <= {FILINGS_CAP}) AS items
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) GROUP BY 1) f ON f.id = w.id"""))  # fmt: skip
def tool_filings(spark, d):
    """What the source of filings answers: its newest filings, or why there are none. The limit is the feature."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    item = F.concat_ws("|", F.when(F.col("o_orderkey") % 4 != 0, "10-K").otherwise(F.lit("")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("acc-"), "o_orderkey"))
    newest = table(spark, d, "orders").withColumn("k", F.row_number().over(order)).where(F.col("k") <= FILINGS_CAP)
    listed = newest.groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("k", item.alias("item")))).alias("items"))
    rows = asked(spark, d).join(listed, "id", "left").withColumn("code", F.when(F.col("known").isNull(), 404).otherwise(F.expr(CODE)))
    n = F.coalesce(F.size("items"), F.lit(0))
    well = F.col("code") == 200
    return rows.select("id", N.answered(F.col("code"), n).alias("status"), F.when(well, n).otherwise(0).alias("n"), F.when(well & (n > 0), F.array_join(F.col("items")["item"], "\n")).otherwise(F.lit("")).alias("filings"))
