"""Queries of writes, reviews and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.checkpoints import checkpointed
from tallyforge.functions import text as T
from tallyforge.operators import changes as C
from tallyforge.operators import graph as G
from tallyforge.operators.reads import active, public
from tallyforge.registry import query
from tallyforge.sources import domain as D
from tallyforge.sources.domain import table, with_views

FILED = "SELECT o_orderkey AS id, o_orderkey % 9 = 0 AS deleted, CASE WHEN o_orderkey % 4 <> 0 THEN '10-K' END AS form, 'acc-' || o_orderkey AS accession, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS dated FROM orders"
LEAVES = f"""fl AS ({FILED}),
sd AS (SELECT 'rev' AS kind, company_id, related_company_id AS other, id, status, deleted, value, 'Buyer of ' || company_id AS own_name, 'CUSTOMER' AS type FROM contributions
  UNION ALL SELECT 'cost', related_company_id, company_id, id, status, deleted, CASE WHEN company_id % 10 <> 0 THEN value END, 'Seller to ' || related_company_id, 'COGS' FROM contributions),
lv AS (SELECT s.company_id, s.kind, s.id, CASE WHEN c.deleted IS FALSE THEN c.name ELSE s.own_name END AS label, s.type || ' · $' || printf('%.2f', round(coalesce(s.value, 0)::DECIMAL(20, 2) / 1000000000, 2)) || 'B' AS title, s.value, CASE WHEN c.deleted IS FALSE THEN s.other END AS nav_id, CASE WHEN c.deleted IS FALSE THEN c.market_cap END AS market_cap,
    CASE WHEN NOT f.deleted THEN coalesce(f.form, 'Filing') END AS filing_form, CASE WHEN NOT f.deleted THEN f.accession || coalesce(' · ' || strftime(f.dated, '%Y-%m-%d'), '') END AS filing_detail
  FROM sd s LEFT JOIN companies c ON c.id = s.other LEFT JOIN fl f ON f.id = s.company_id * 7 + s.other WHERE s.status = 'Approved' AND NOT s.deleted
  UNION ALL SELECT company_id, 'event', id::VARCHAR, title, 'event · ' || strftime(ts, '%Y-%m-%d'), NULL, NULL, NULL, NULL, NULL FROM evts WHERE NOT deleted)"""


def leaves(spark, d):
    """Revenue, cost and event leaves of all companies: one pass over the contributions, seen from either side."""
    rows = public(D.contributions(spark, d))
    both = F.explode(F.array(
        F.struct(F.lit("rev").alias("kind"), F.col("company_id").alias("company_id"), F.col("related_company_id").alias("other"), F.col("value").alias("value"), F.concat(F.lit("Buyer of "), "company_id").alias("own_name"), F.lit("CUSTOMER").alias("type")),
        F.struct(F.lit("cost").alias("kind"), F.col("related_company_id").alias("company_id"), F.col("company_id").alias("other"), F.when(F.col("company_id") % 10 != 0, F.col("value")).alias("value"), F.concat(F.lit("Seller to "), "related_company_id").alias("own_name"), F.lit("COGS").alias("type")),
    ))
    sides = rows.select("id", both.alias("s")).select("id", "s.*").withColumn("filing_id", F.col("company_id") * 7 + F.col("other"))
    known = active(D.companies(spark, d)).select(F.col("id").alias("nav_id"), "name", "market_cap")
    o = table(spark, d, "orders")
    filings = o.select(F.col("o_orderkey").alias("filing_id"), (F.col("o_orderkey") % 9 == 0).alias("filing_deleted"), F.when(F.col("o_orderkey") % 4 != 0, "10-K").alias("filing_form"), F.concat(F.lit("acc-"), "o_orderkey").alias("filing_accession"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("filing_date"))
    linked = sides.join(known, sides["other"] == known["nav_id"], "left").join(filings.withColumn("filing_there", F.lit(True)), "filing_id", "left")
    linked = linked.withColumn("filing_id", F.when(F.col("filing_there"), F.col("filing_id")))
    sources = linked.select("company_id", "kind", "id", F.coalesce("name", "own_name").alias("label"), F.concat(F.col("type"), F.lit(" · "), G.amount(F.col("value"))).alias("title"), "value", "nav_id", "market_cap", *G.chip("filing"))
    e = active(D.events(spark, d))
    nothing = {"value": "double", "nav_id": "long", "market_cap": "double", "filing_form": "string", "filing_detail": "string"}
    happened = e.select("company_id", F.lit("event").alias("kind"), F.col("id").cast("string").alias("id"), F.col("title").alias("label"), F.concat(F.lit("event · "), F.date_format("ts", "yyyy-MM-dd")).alias("title"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    return sources.unionByName(happened)


def leaf_sql(body: str) -> str:
    return with_views("\x00", "contributions", "evts", "companies", "countries").replace("\n\x00", ",\n" + LEAVES + "\n" + body)


HUB = "SELECT company_id, kind, count(*) AS n, CASE WHEN kind <> 'event' THEN round(sum(coalesce(value, 0)::DECIMAL(18, 2)), 2)::DOUBLE END AS total FROM lv GROUP BY company_id, kind"


@query("graph_nodes", leaf_sql(f"""SELECT 'company:' || c.id AS node, 'center' AS kind, c.name AS label, coalesce(c.sector, 'Unclassified') || ' · ' || coalesce(n.code, '') AS title, c.revenue_total AS value, NULL::BIGINT AS nav_id, NULL::DOUBLE AS market_cap, NULL::VARCHAR AS filing_form, NULL::VARCHAR AS filing_detail FROM companies c LEFT JOIN countries n ON c.country_id = n.id WHERE NOT c.deleted
UNION ALL SELECT 'hub:' || kind || ':' || company_id, 'hub-' || kind, CASE kind WHEN 'rev' THEN 'REVENUE SOURCES' WHEN 'cost' THEN 'COST SOURCES' ELSE 'EVENTS' END, n || ' items', total, NULL, NULL, NULL, NULL FROM ({HUB})
UNION ALL SELECT kind || ':' || id, kind, label, title, value, nav_id, market_cap, filing_form, filing_detail FROM lv"""))  # fmt: skip
def graph_nodes(spark, d):
    n = D.countries(spark, d).select(F.col("id").alias("country_id"), F.col("code").alias("country_code"))
    return G.nodes(active(D.companies(spark, d)).join(F.broadcast(n), "country_id", "left"), checkpointed(leaves(spark, d)))


@query("graph_edges", leaf_sql("SELECT 'company:' || company_id AS source, 'hub:' || kind || ':' || company_id AS target, count(*)::VARCHAR AS label FROM lv GROUP BY kind, company_id UNION ALL SELECT 'hub:' || kind || ':' || company_id, kind || ':' || id, CASE WHEN kind <> 'event' THEN '$' || printf('%.1f', round(value::DECIMAL(20, 2) / 1000000000, 1)) || 'B' END FROM lv"))
def graph_edges(spark, d):
    return G.edges(checkpointed(leaves(spark, d)))


@query("graph_hubs", leaf_sql(HUB))
def graph_hubs(spark, d):
    return G.hubs(leaves(spark, d))


@query("linked_sources", with_views("SELECT company_id AS id, 'revenue' AS kind, 'owned' AS direction, related_company_id AS other, value FROM contributions WHERE status = 'Approved' AND NOT deleted UNION ALL SELECT related_company_id, 'revenue', 'inverse', company_id, value FROM contributions WHERE status = 'Approved' AND NOT deleted UNION ALL SELECT related_company_id, 'cost', 'owned', company_id, value FROM contributions WHERE status = 'Approved' AND NOT deleted UNION ALL SELECT company_id, 'cost', 'inverse', related_company_id, value FROM contributions WHERE status = 'Approved' AND NOT deleted", "contributions"))
def linked_sources(spark, d):
    """A company's own revenues and costs, and those in which others name it; contributions are read once for all four."""
    side = lambda kind, way, a, b: F.struct(F.col(a).alias("id"), F.lit(kind).alias("kind"), F.lit(way).alias("direction"), F.col(b).alias("other"))
    ends = ("company_id", "related_company_id")
    sides = F.array(side("revenue", "owned", *ends), side("revenue", "inverse", *ends[::-1]), side("cost", "owned", *ends[::-1]), side("cost", "inverse", *ends))
    return public(D.contributions(spark, d)).select("value", F.inline(sides)).select("id", "kind", "direction", "other", "value")


@query("contributor_ids", "SELECT user_id AS id FROM events UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def contributor_ids(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id")).union(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")).distinct()


@query("role_diff", "SELECT 'add' AS change, id FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) UNION ALL SELECT 'remove', id FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def role_diff(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    want, have = ids.where("id % 2 = 0"), ids.where("id % 3 = 0")
    return want.subtract(have).select(F.lit("add").alias("change"), "id").unionByName(have.subtract(want).select(F.lit("remove").alias("change"), "id"))


PENDING = "SELECT company_id, 'revenue' AS kind FROM contributions WHERE status = 'Pending' AND NOT deleted UNION ALL SELECT related_company_id, 'cost' FROM contributions WHERE status = 'Pending' AND NOT deleted UNION ALL SELECT o_custkey, 'risk' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"


@query("pending_counts", with_views(f"SELECT company_id, count(*) FILTER (kind = 'revenue') AS revenue, count(*) FILTER (kind = 'cost') AS cost, count(*) FILTER (kind = 'risk') AS risk, count(*) AS total FROM ({PENDING}) GROUP BY company_id", "contributions"))
def pending_counts(spark, d):
    """What waits for review, of each company's revenues, costs and risks; urgent orders in progress stand for risks."""
    p = active(D.contributions(spark, d)).where("status = 'Pending'")
    sides = p.select(F.inline(F.array(*(F.struct(F.col(c).alias("company_id"), F.lit(k).alias("kind")) for c, k in (("company_id", "revenue"), ("related_company_id", "cost"))))))
    risks = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')").select(F.col("o_custkey").alias("company_id"), F.lit("risk").alias("kind"))
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return sides.unionByName(risks).groupBy("company_id").agg(*map(count, ("revenue", "cost", "risk")), F.count("*").alias("total"))


@query("pending_review_detail", with_views("SELECT p.id, p.value, l.id AS live_id, l.value AS live_value FROM contributions p LEFT JOIN (SELECT * FROM contributions WHERE status = 'Approved' AND NOT deleted) l ON l.id = replace(p.id, '-N', '-A') WHERE p.status = 'Pending' AND NOT p.deleted", "contributions"))
def pending_review_detail(spark, d):
    """A pending row beside the live one it supersedes."""
    rows = D.contributions(spark, d)
    live = public(rows).select(F.col("id").alias("live_id"), F.col("value").alias("live_value"))
    return active(rows).where("status = 'Pending'").withColumn("live_id", F.replace("id", F.lit("-N"), F.lit("-A"))).join(live, "live_id", "left").select("id", "value", F.when(F.col("live_value").isNotNull(), F.col("live_id")).alias("live_id"), "live_value")


@query("reciprocal_costs", with_views("SELECT related_company_id AS company_id, company_id AS related_company_id, value, 'COGS' AS classification FROM (SELECT * FROM contributions WHERE status = 'Approved' AND NOT deleted) c WHERE NOT EXISTS (SELECT 1 FROM contributions r WHERE r.status = 'Approved' AND NOT r.deleted AND r.company_id = c.related_company_id AND r.related_company_id = c.company_id AND r.value > 100000)", "contributions"))
def reciprocal_costs(spark, d):
    """The other direction: a revenue is mirrored as a cost; approved rows over an amount stand for costs that are there."""
    rows = D.contributions(spark, d)
    mirrored = C.reciprocal(public(rows).select("company_id", "related_company_id", "value"), rows.where("value > 100000"))
    return mirrored.withColumn("classification", F.lit(C.MIRRORS["REVENUE"][1]))


@query("reciprocal_edges", with_views("SELECT related_company_id AS company_id, company_id AS related_company_id, value FROM (SELECT * FROM contributions WHERE status = 'Pending' AND NOT deleted) c WHERE NOT EXISTS (SELECT 1 FROM contributions r WHERE r.status = 'Approved' AND NOT r.deleted AND r.company_id = c.related_company_id AND r.related_company_id = c.company_id)", "contributions"))
def reciprocal_edges(spark, d):
    rows = D.contributions(spark, d)
    return C.reciprocal(active(rows).where("status = 'Pending'").select("company_id", "related_company_id", "value"), rows)


ACTION = "CASE WHEN related_company_id % 2 = 0 THEN 'approve' WHEN related_company_id % 3 = 0 THEN 'reject' END"


@query("review_fold", with_views(f"""SELECT c.id, CASE WHEN c.status = 'Pending' AND {ACTION} = 'approve' THEN 'Approved' WHEN c.status = 'Pending' AND {ACTION} = 'reject' THEN 'Rejected' ELSE c.status END AS status,
c.deleted OR c.id IN (SELECT replace(id, '-N', '-A') FROM contributions WHERE status = 'Pending' AND {ACTION} = 'approve') AS deleted FROM contributions c""", "contributions"))  # fmt: skip
def review_fold(spark, d):
    rows = D.contributions(spark, d).withColumn("supersedes_id", F.when(F.col("status") == "Pending", F.replace("id", F.lit("-N"), F.lit("-A"))))
    return C.review(rows.withColumn("action", F.expr(ACTION))).select("id", "status", "deleted")


EDITS = """SELECT event_id AS edit_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS row_id, CASE event_id % 4 WHEN 0 THEN 'CUSTOMER' WHEN 1 THEN 'PRODUCT' WHEN 2 THEN 'customer' ELSE 'SEGMENT' END AS classification, event_type AS name, value, CASE WHEN event_id % 5 <> 0 THEN props END AS reference, CASE WHEN event_id % 7 = 0 THEN 'quote' END AS evidence, event_id % 2 = 0 AS reviewer, user_id AS by_user FROM events"""
HELD = "SELECT c_custkey AS id, 'CUSTOMER' AS classification, c_name AS name, c_acctbal AS value, c_phone AS reference, 'old' AS evidence FROM customer".replace("c_phone", "c_mktsegment")


@query("contribution_write", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY edit_id DESC) AS n FROM ({EDITS}) WHERE classification IN ('CUSTOMER', 'PRODUCT', 'SEGMENT')), h AS ({HELD}),
live AS (SELECT row_id, max(edit_id) AS last, max_by(reference, edit_id) FILTER (reference IS NOT NULL) AS reference, max_by(evidence, edit_id) FILTER (evidence IS NOT NULL) AS evidence FROM e WHERE row_id IS NOT NULL AND reviewer GROUP BY row_id)
SELECT 'row-' || h.id AS id, coalesce(e.classification, h.classification) AS classification, coalesce(e.name, h.name) AS name, CASE WHEN e.edit_id IS NOT NULL THEN e.value ELSE h.value END AS value, coalesce(l.reference, h.reference) AS reference, coalesce(l.evidence, h.evidence) AS evidence, 'Approved' AS status, NULL::VARCHAR AS supersedes_id, NULL::BIGINT AS contributed_by
FROM h LEFT JOIN live l ON l.row_id = h.id LEFT JOIN e ON e.edit_id = l.last
UNION ALL SELECT 'new-' || edit_id, e.classification, e.name, e.value, e.reference, e.evidence, CASE WHEN reviewer THEN 'Approved' ELSE 'Pending' END, CASE WHEN row_id IS NOT NULL THEN 'row-' || row_id END, CASE WHEN NOT reviewer THEN by_user END FROM e WHERE row_id IS NULL OR NOT reviewer AND row_id IN (SELECT id FROM h)""")  # fmt: skip
def contribution_write(spark, d):
    """Reviewers' edits in place, others' as pending rows beside what they would supersede, and new rows."""
    e = table(spark, d, "events")
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN 'CUSTOMER' WHEN 1 THEN 'PRODUCT' WHEN 2 THEN 'customer' ELSE 'SEGMENT' END")
    edits = e.select(F.col("event_id").alias("edit_id"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("row-"), "user_id")).alias("row_id"), kind.alias("classification"), F.col("event_type").alias("name"), "value", F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("reference"), F.when(F.col("event_id") % 7 == 0, "quote").alias("evidence"), (F.col("event_id") % 2 == 0).alias("reviewer"), F.col("user_id").alias("by_user"))
    held = table(spark, d, "customer").select(F.concat(F.lit("row-"), "c_custkey").alias("id"), F.lit("CUSTOMER").alias("classification"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("reference"), F.lit("old").alias("evidence"), F.lit("Approved").alias("status"), F.lit(None).cast("string").alias("supersedes_id"), F.lit(None).cast("long").alias("contributed_by"))
    return C.write(held, edits, ("CUSTOMER", "PRODUCT", "SEGMENT"), ["classification", "name", "value"], ["reference", "evidence"])


@query("filing_upsert", """WITH st AS (SELECT o_orderkey AS accession, o_orderpriority AS form, o_custkey AS company_id, o_orderkey % 10 = 0 AS deleted FROM orders WHERE o_orderkey % 3 <> 0), fr AS (SELECT o_orderkey AS accession, CASE WHEN o_orderkey % 4 <> 0 THEN '10-K' END AS form, o_custkey AS company_id FROM orders WHERE o_orderkey % 5 = 0)
SELECT accession, coalesce(fr.form, st.form) AS form, coalesce(fr.company_id, st.company_id) AS company_id, CASE WHEN fr.accession IS NOT NULL THEN false ELSE st.deleted END AS deleted FROM st FULL JOIN fr USING (accession)""")  # fmt: skip
def filing_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_orderpriority").alias("form"), F.col("o_custkey").alias("company_id"))
    stored = o.where("accession % 3 <> 0").withColumn("deleted", F.col("accession") % 10 == 0)
    fresh = o.where("accession % 5 = 0").withColumn("form", F.when(F.col("accession") % 4 != 0, "10-K"))
    return C.upsert(stored, fresh, "accession", ["form", "company_id"])


@query("cluster_delete", with_views("SELECT id, deleted OR company_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0) AS deleted FROM contributions", "contributions"))
def cluster_delete(spark, d):
    """All rows that cite a filing go with it: here, all of a seller's."""
    rows = D.contributions(spark, d)
    gone = table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("company_id"))
    return C.soft_delete(rows, rows.join(gone, "company_id", "left_semi").select("id")).select("id", "deleted")


@query("refresh_replace", """WITH st AS (SELECT o_custkey AS company_id, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'MANUAL' ELSE 'FEED' END AS source FROM orders WHERE o_orderstatus = 'F'), fr AS (SELECT o_custkey AS company_id, o_orderkey AS id, 'FEED' AS source FROM orders WHERE o_orderstatus = 'P')
SELECT * FROM st WHERE source = 'MANUAL' OR company_id NOT IN (SELECT company_id FROM fr) UNION ALL SELECT * FROM fr""")  # fmt: skip
def refresh_replace(spark, d):
    """Fed rows of a company are replaced, manual ones stay; a company without fresh rows keeps what it has."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    stored = o.where("o_orderstatus = 'F'").select("company_id", "id", F.when(F.col("id") % 4 == 0, "MANUAL").otherwise("FEED").alias("source"))
    fresh = o.where("o_orderstatus = 'P'").select("company_id", "id", F.lit("FEED").alias("source"))
    return C.refresh(stored, fresh, ["company_id"], F.col("source") == "MANUAL")


@query("coalesce_merge", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS sector FROM customer")
def coalesce_merge(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"))
    fetched = stored.where("id % 2 = 0").select("id", F.upper("name").alias("name"), F.when(F.col("id") % 3 == 0, "NEW").alias("sector"))
    return C.coalesce_merge(stored, fetched, "id", ["name", "sector"])


@query("soft_delete_view", with_views("SELECT id, deleted OR id % 4 = 0 AS deleted FROM companies", "companies"))
def soft_delete_view(spark, d):
    rows = D.companies(spark, d).select("id", "deleted")
    return C.soft_delete(rows, rows.where("id % 4 = 0").select("id"))


@query("validate_split", "SELECT event_id AS id, CASE WHEN event_type IS NULL OR event_id % 23 = 0 THEN 'title' WHEN NOT coalesce(value BETWEEN -10 AND 100, false) THEN 'impact' WHEN event_id % 6 = 1 THEN 'end' WHEN user_id % 2 = 1 THEN 'company' END AS rejected_for FROM events")
def validate_split(spark, d):
    """A title that isn't blank, an impact in range, an end, if any, no earlier than the start, and a company that may be named."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 23 == 0, "  ").otherwise(F.col("event_type")).alias("title"), "value", "ts", "user_id")
    e = e.withColumn("end", F.when(F.col("id") % 6 == 1, F.expr("ts - interval 1 second")).when(F.col("id") % 6 == 2, F.col("ts")).when(F.col("id") % 6 == 3, F.expr("ts + interval 1 day")))
    checks = {"title": C.required("title"), "impact": F.col("value").between(-10, 100), "end": C.not_before("end", "ts"), "company": F.col("user_id") % 2 == 0}
    return C.split_valid(e, checks).select("id", "rejected_for")


@query("counterparty_resolve", with_views("SELECT e.id, coalesce(a.id, b.id) AS company_id, CASE WHEN a.id IS NOT NULL THEN 'name' WHEN b.id IS NOT NULL THEN 'cik' ELSE 'stub' END AS how FROM evts e LEFT JOIN companies a ON a.name = 'Customer#' || lpad((e.company_id * 2)::VARCHAR, 9, '0') AND NOT a.deleted LEFT JOIN companies b ON b.cik = lpad((e.company_id * 37)::VARCHAR, 10, '0') AND NOT b.deleted", "evts", "companies"))
def counterparty_resolve(spark, d):
    """By name, else by CIK, else a stub is due."""
    c = active(D.companies(spark, d))
    e = D.events(spark, d).select("id", F.concat(F.lit("Customer#"), F.lpad((F.col("company_id") * 2).cast("string"), 9, "0")).alias("name"), T.norm_cik((F.col("company_id") * 37).cast("string")).alias("cik"))
    found = e.join(c.select("name", F.col("id").alias("a")), "name", "left").join(c.select("cik", F.col("id").alias("b")), "cik", "left")
    return found.select("id", F.coalesce("a", "b").alias("company_id"), F.when(F.col("a").isNotNull(), "name").when(F.col("b").isNotNull(), "cik").otherwise("stub").alias("how"))


@query("distinct_ci", "SELECT lower(t) AS key, arg_min(t, (o, t)) AS t, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS t, o_orderkey AS o FROM orders) GROUP BY 1")
def distinct_ci(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("t"), F.col("o_orderkey").alias("o"))
    return C.distinct_ci(o, "t", "o")


@query("index_upsert", """WITH st AS (SELECT p_brand AS code, 'id-' || p_brand AS id, 'Old ' || p_brand AS name, 'OLD' AS sector, 'EU' AS region, 1.0::DOUBLE AS total_cap FROM part WHERE p_size % 2 = 0 GROUP BY p_brand),
fr AS (SELECT p_brand AS code, 'New ' || p_brand AS name, 'US' AS region, 'HINT' AS hint FROM part WHERE p_size % 3 = 0 GROUP BY p_brand),
m AS (SELECT p_brand AS code, split_part(p_type, ' ', 1) AS sector, CASE WHEN right(p_brand, 1) = '1' THEN 0 ELSE p_retailprice END AS cap FROM part WHERE p_size % 3 = 0),
g AS (SELECT code, sector, sum(1.0) AS n FROM m GROUP BY ALL), s AS (SELECT code, arg_max(sector, (n, sector)) AS sector, max(n) / sum(n) AS share FROM g GROUP BY code), c AS (SELECT code, sum(cap) AS cap FROM m GROUP BY code)
SELECT coalesce(fr.code, st.code) AS code, coalesce(st.id, 'new-' || fr.code) AS id, coalesce(fr.name, st.name) AS name, CASE WHEN fr.code IS NULL THEN st.sector WHEN s.share >= 0.8 THEN s.sector ELSE hint END AS sector, coalesce(fr.region, st.region) AS region,
round(CASE WHEN fr.code IS NULL THEN st.total_cap WHEN c.cap > 0 THEN c.cap END, 2) AS total_cap FROM st FULL JOIN fr ON st.code = fr.code LEFT JOIN s ON s.code = fr.code LEFT JOIN c ON c.code = fr.code""")  # fmt: skip
def index_upsert(spark, d):
    """Brands stand for indices: stored ones, what came for some, and new ones."""
    p = table(spark, d, "part").withColumn("code", F.col("p_brand"))
    stored = p.where("p_size % 2 = 0").select("code").distinct().select("code", F.concat(F.lit("id-"), "code").alias("id"), F.concat(F.lit("Old "), "code").alias("name"), F.lit("OLD").alias("sector"), F.lit("EU").alias("region"), F.lit(1.0).alias("total_cap"))
    came = p.where("p_size % 3 = 0")
    fresh = came.select("code").distinct().select("code", F.concat(F.lit("New "), "code").alias("name"), F.lit("US").alias("region"), F.lit("HINT").alias("hint"))
    members = came.select("code", F.get(F.split("p_type", " "), F.lit(0)).alias("sector"), F.lit(None).cast("double").alias("weight"), F.when(F.substring("p_brand", -1, 1) == "1", 0.0).otherwise(F.col("p_retailprice")).alias("market_cap"))
    return C.index_upsert(stored, fresh, members).withColumn("total_cap", F.round("total_cap", 2))


@query("import_resume", "SELECT DISTINCT user_id AS id, CASE WHEN user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'done' WHEN user_id IN (SELECT c_custkey FROM customer) THEN 'relink' ELSE 'fetch' END AS step FROM events")
def import_resume(spark, d):
    """What an import that stopped half way still has to do for each key."""
    wanted = table(spark, d, "events").select(F.col("user_id").alias("id"))
    linked = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return C.resumed(wanted, linked, table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id")


@query("counterparty_stubs", with_views("""WITH a AS (SELECT e.id, CASE WHEN e.id % 9 = 0 THEN ' ' WHEN e.id % 2 = 0 THEN ' ' || upper(e.title) || ' ' ELSE e.title || (e.company_id % 5) END AS name, CASE WHEN e.id % 4 = 0 THEN 'T' || (e.id % 3) END AS ticker, c.id AS company_id FROM evts e LEFT JOIN companies c ON c.id = e.company_id * 13 AND NOT c.deleted)
SELECT lower(trim(name)) AS key, trim(arg_min(name, id)) AS name, arg_min(coalesce(ticker, ''), id) AS t, count(*) AS asked FROM a WHERE company_id IS NULL AND trim(name) <> '' GROUP BY 1""".replace("WITH a AS", "SELECT key, name, nullif(t, '') AS ticker, CASE WHEN t = '' THEN 'PRIVATE' ELSE 'PUBLIC' END AS type, asked FROM (WITH a AS", 1) + ")", "evts", "companies"))  # fmt: skip
def counterparty_stubs(spark, d):
    """Stub companies for counterparties that no company stands for."""
    e = D.events(spark, d)
    c = active(D.companies(spark, d)).select(F.col("id").alias("matched"))
    name = F.when(F.col("id") % 9 == 0, " ").when(F.col("id") % 2 == 0, F.concat(F.lit(" "), F.upper("title"), F.lit(" "))).otherwise(F.concat("title", F.col("company_id") % 5))
    asked = e.join(c, F.col("company_id") * 13 == F.col("matched"), "left").select("id", name.alias("name"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("T"), F.col("id") % 3)).alias("ticker"), F.col("matched").alias("company_id"))
    return C.stubs(asked)


@query("vendor_company", """WITH pr AS (SELECT c_custkey::VARCHAR AS symbol, CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS companyName, CASE WHEN c_custkey % 5 <> 0 THEN 'CIK ' || c_custkey END AS cik, CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' Soft ware ' END AS industry, CASE c_custkey % 4 WHEN 0 THEN 'Financial Services' WHEN 1 THEN 'Real-Estate' WHEN 2 THEN 'Crypto' END AS sector, c_acctbal AS cap, repeat('note ', (c_custkey % 500)::INT) AS description FROM customer),
inc AS (SELECT o_custkey::VARCHAR AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE o_custkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' END AS cur, sum(CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE floor(o_totalprice) END) AS revenue, sum(floor(o_totalprice)) / 4 AS gp FROM orders GROUP BY ALL),
l AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
SELECT pr.symbol, coalesce(companyName, pr.symbol) AS name, lpad(nullif(regexp_replace(cik, '[^0-9]', '', 'g'), ''), 10, '0') AS cik, nullif(trim(industry), '') AS vendor_industry, CASE sector WHEN 'Financial Services' THEN 'FINANCIALS' WHEN 'Real-Estate' THEN 'REAL_ESTATE' END AS sector, cap AS market_cap, left(description, 2000) AS notes, CASE WHEN revenue <> 0 THEN round(gp / revenue, 2) END AS gross_margin, date::DATE AS as_of, CASE WHEN upper(cur) = 'USD' THEN revenue END AS revenue_total FROM pr LEFT JOIN l USING (symbol)""")  # fmt: skip
def vendor_company(spark, d):
    """Customers stand for profiles, days of orders for income statements."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("c_custkey")
    profiles = c.select(k.cast("string").alias("symbol"), F.when(k % 6 != 0, F.col("c_name")).alias("companyName"), F.when(k % 5 != 0, F.concat(F.lit("CIK "), k)).alias("cik"), F.when(k % 3 == 0, " ").when(k % 3 == 1, " Soft ware ").alias("industry"), F.when(k % 4 == 0, "Financial Services").when(k % 4 == 1, "Real-Estate").when(k % 4 == 2, "Crypto").alias("sector"), F.col("c_acctbal").alias("marketCap"), F.expr("repeat('note ', cast(c_custkey % 500 AS int))").alias("description"))
    n = F.col("o_custkey")
    incomes = o.groupBy(n.cast("string").alias("symbol"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(n % 3 == 0, "usd").when(n % 3 == 1, "EUR").alias("reportedCurrency")).agg(F.sum(F.when(n % 7 == 0, 0.0).otherwise(F.floor("o_totalprice").cast("double"))).alias("revenue"), (F.sum(F.floor("o_totalprice").cast("double")) / 4).alias("grossProfit"))
    return C.company_rows(profiles, incomes)
