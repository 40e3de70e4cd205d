"""Queries of writes through references, and of classification in stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import changes as C
from tallyforge.operators import classes as K
from tallyforge.operators import links as W
from tallyforge.operators.reads import active
from tallyforge.registry import query
from tallyforge.sources import classes
from tallyforge.sources import domain as D
from tallyforge.sources.domain import table, with_views

# An event's links: its company, the company's country and that country's bloc. Every third event is
# edited: to two other companies, a neighbouring country and two blocs, or to nothing.
LINKS = """st AS (SELECT e.id AS owner, 'company' AS kind, company_id AS target FROM evts e UNION ALL SELECT e.id, 'country', c.country_id FROM evts e JOIN companies c ON c.id = e.company_id UNION ALL SELECT e.id, 'bloc', n.bloc_id FROM evts e JOIN companies c ON c.id = e.company_id JOIN countries n ON n.id = c.country_id),
ed AS (SELECT e.id AS owner, kind, CASE WHEN e.id % 2 = 0 THEN [] WHEN kind = 'company' THEN [company_id, company_id * 2, company_id * 2] WHEN kind = 'country' THEN [(company_id + e.id) % 25, (company_id + e.id) % 25 + 1] ELSE [company_id % 7, 1] END AS targets FROM evts e, (SELECT unnest(['company', 'country', 'bloc']) AS kind) WHERE e.id % 3 = 0 AND NOT (kind = 'bloc' AND e.id % 5 = 0)),
ac AS (SELECT 'company' AS kind, id AS target FROM companies WHERE NOT deleted UNION ALL SELECT 'country', id FROM countries UNION ALL SELECT DISTINCT 'bloc', bloc_id FROM countries),
wa AS (SELECT DISTINCT owner, kind, target FROM (SELECT owner, kind, unnest(targets) AS target FROM ed) JOIN ac USING (kind, target)),
he AS (SELECT DISTINCT owner, kind, target FROM st JOIN (SELECT owner, kind FROM ed) USING (owner, kind)),
lc AS (SELECT owner, kind, target, CASE WHEN h.x AND w.x THEN 'keep' WHEN w.x THEN 'insert' ELSE 'delete' END AS change FROM (SELECT *, true AS x FROM he) h FULL JOIN (SELECT *, true AS x FROM wa) w USING (owner, kind, target))"""


def link_parts(spark, d):
    e = D.events(spark, d).select(F.col("id").alias("owner"), "company_id")
    where = D.companies(spark, d).select(F.col("id").alias("company_id"), "country_id")
    blocs = D.countries(spark, d).select(F.col("id").alias("country_id"), "bloc_id")  # 25 rows
    placed = e.join(where, "company_id", "left").join(F.broadcast(blocs), "country_id", "left")
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("target"))
    stored = placed.select("owner", F.inline(F.array(pair("company", "company_id"), pair("country", "country_id"), pair("bloc", "bloc_id")))).where("target IS NOT NULL")
    wants = {"company": ["company_id", "company_id * 2", "company_id * 2"], "country": ["(company_id + owner) % 25", "(company_id + owner) % 25 + 1"], "bloc": ["company_id % 7", "1L"]}
    lists = F.array(*(F.struct(F.lit(k).alias("kind"), F.when(F.col("owner") % 2 == 0, F.array().cast("array<bigint>")).otherwise(F.array(*map(F.expr, v))).alias("targets")) for k, v in wants.items()))
    edits = e.where("owner % 3 = 0").select("owner", F.inline(lists)).where("NOT (kind = 'bloc' AND owner % 5 = 0)")
    live = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("target")).distinct()
    n = D.countries(spark, d)
    targets = live("company", active(D.companies(spark, d)), "id").unionByName(live("country", n, "id")).unionByName(live("bloc", n, "bloc_id"))
    return stored, edits, targets


@query("event_link_changes", with_views("\x00", "evts", "companies", "countries").replace("\n\x00", f",\n{LINKS}\nSELECT * FROM lc"))
def event_link_changes(spark, d):
    """What an edit of events' companies, countries and blocs inserts, keeps and deletes."""
    return W.link_changes(*link_parts(spark, d))


@query("event_links_after", with_views("\x00", "evts", "companies", "countries").replace("\n\x00", f",\n{LINKS}\nSELECT owner, kind, target FROM st WHERE (owner, kind) NOT IN (SELECT (owner, kind) FROM ed) UNION ALL SELECT owner, kind, target FROM lc WHERE change <> 'delete'"))
def event_links_after(spark, d):
    stored, edits, targets = link_parts(spark, d)
    return W.linked(stored, edits, W.link_changes(stored, edits, targets))


CONSTITUENTS = """st AS (SELECT c_nationkey::BIGINT AS index_id, c_custkey AS company_id, c_acctbal AS weight FROM customer WHERE c_custkey % 2 = 0),
fr AS (SELECT c_nationkey::BIGINT AS index_id, c_custkey AS company_id, c_acctbal * 2 AS weight FROM customer WHERE c_custkey % 3 = 0),
ed AS (SELECT n_nationkey::BIGINT AS index_id, DATE '2024-01-01' + n_nationkey AS as_of FROM nation WHERE n_nationkey % 3 <> 1)"""


@query("constituents_replace", f"WITH {CONSTITUENTS} SELECT * FROM st WHERE index_id NOT IN (SELECT index_id FROM ed) UNION ALL SELECT * FROM fr WHERE index_id IN (SELECT index_id FROM ed) AND index_id % 5 <> 0")
def constituents_replace(spark, d):
    """The constituents of two in three indices are replaced, those of every fifth by none."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("index_id"), F.col("c_custkey").alias("company_id"), F.col("c_acctbal").alias("weight"))
    fresh = c.where("company_id % 3 = 0 AND index_id % 5 <> 0").withColumn("weight", F.col("weight") * 2)
    edited = table(spark, d, "nation").where("n_nationkey % 3 <> 1").select(F.col("n_nationkey").cast("long").alias("index_id"))
    return W.replaced(c.where("company_id % 2 = 0"), fresh, edited, "index_id")


@query("constituents_as_of", f"WITH {CONSTITUENTS} SELECT n_nationkey::BIGINT AS index_id, coalesce(ed.as_of, CASE WHEN n_nationkey % 2 = 0 THEN DATE '2020-02-02' END)::DATE AS as_of FROM nation LEFT JOIN ed ON ed.index_id = n_nationkey")
def constituents_as_of(spark, d):
    """The day of an index's constituents, where they are replaced, by none too."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("index_id"))
    stored = n.withColumn("as_of", F.when(F.col("index_id") % 2 == 0, F.lit("2020-02-02").cast("date")))
    edited = n.where("index_id % 3 <> 1").withColumn("as_of", F.date_add(F.lit("2024-01-01").cast("date"), F.col("index_id").cast("int")))
    return W.stamped(stored, edited, "index_id", "as_of")


SOURCES = """so AS (SELECT 'REVENUE' AS node, id, CASE WHEN (company_id + related_company_id) % 4 <> 0 THEN company_id * 7 + related_company_id END AS filing_id, deleted FROM contributions UNION ALL SELECT 'COST', id, CASE WHEN company_id % 3 <> 0 THEN company_id * 7 + related_company_id END, deleted OR related_company_id % 13 = 0 FROM contributions),
fi AS (SELECT o_orderkey AS id, o_orderkey % 9 = 0 AS deleted FROM orders),
pk AS (SELECT node, id, filing_id FROM so WHERE (node = 'REVENUE' AND id LIKE '%4-A') OR (node = 'COST' AND id LIKE '%7-N'))"""


def cluster(spark, d):
    c = D.contributions(spark, d)
    filing = F.col("company_id") * 7 + F.col("related_company_id")
    node = lambda name, cites, gone: F.struct(F.lit(name).alias("node"), F.when(cites, filing).alias("filing_id"), gone.alias("deleted"))
    both = F.inline(F.array(node("REVENUE", (F.col("company_id") + F.col("related_company_id")) % 4 != 0, F.col("deleted")), node("COST", F.col("company_id") % 3 != 0, F.col("deleted") | (F.col("related_company_id") % 13 == 0))))
    sources = c.select("id", both)
    filings = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9 == 0).alias("deleted"))
    chosen = sources.where("node = 'REVENUE' AND id LIKE '%4-A' OR node = 'COST' AND id LIKE '%7-N'").select("node", "id")
    return W.cluster_deleted(sources, filings, chosen)


@query("source_cluster_delete", with_views("\x00", "contributions").replace("\n\x00", f",\n{SOURCES}\nSELECT node, id, filing_id, deleted OR coalesce(filing_id IN (SELECT filing_id FROM pk WHERE filing_id IS NOT NULL), false) OR (filing_id IS NULL AND (node, id) IN (SELECT (node, id) FROM pk)) AS deleted FROM so"))
def source_cluster_delete(spark, d):
    """Sources after some are deleted with all that cites the same filing."""
    return cluster(spark, d)[0]


@query("filing_cluster_delete", with_views("\x00", "contributions").replace("\n\x00", f",\n{SOURCES}\nSELECT id, deleted OR id IN (SELECT filing_id FROM pk WHERE filing_id IS NOT NULL) AS deleted FROM fi"))
def filing_cluster_delete(spark, d):
    """The filings themselves, after the same deletion."""
    return cluster(spark, d)[1]


N = len(classes.ROWS)
STORED = f"""{classes.SQL}, sr AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN a.sub WHEN p_partkey % 2 = 0 THEN 'NOT_A_CLASS' END AS sub, CASE WHEN p_partkey % 8 <> 0 THEN b.industry END AS industry, c.sector
  FROM part JOIN dim a ON a.n = p_partkey % {N} JOIN dim b ON b.n = (p_partkey + p_size % 3) % {N} JOIN dim c ON c.n = (p_partkey + p_size % 5 * 7) % {N})"""


@query("class_rollup", f"WITH {STORED} SELECT id, sr.sub, coalesce(d.industry, sr.industry) AS industry, coalesce(d.sector, i.sector, sr.sector) AS sector, concat_ws(',', CASE WHEN coalesce(d.industry, sr.industry) IS DISTINCT FROM sr.industry THEN 'industry' END, CASE WHEN coalesce(d.sector, i.sector, sr.sector) IS DISTINCT FROM sr.sector THEN 'sector' END) AS overruled FROM sr LEFT JOIN dim d ON d.sub = sr.sub LEFT JOIN (SELECT DISTINCT industry, sector FROM dim) i ON i.industry = sr.industry")
def class_rollup(spark, d):
    """The hierarchy overrules stored industries and sectors, and says where."""
    dim = classes.dimension(spark)
    names = F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(("sub", "industry", "sector"), r))) for r in classes.ROWS))
    at = lambda n: F.get(names, (n % N).cast("int"))
    k, s = F.col("p_partkey"), F.col("p_size")
    sub = F.when(k % 9 != 0, at(k)["sub"]).when(k % 2 == 0, "NOT_A_CLASS")
    rows = table(spark, d, "part").select(k.alias("id"), sub.alias("sub"), F.when(k % 8 != 0, at(k + s % 3)["industry"]).alias("industry"), at(k + s % 5 * 7)["sector"].alias("sector"))
    return K.rolled_up(rows, dim).select("id", "sub", "industry", "sector", "overruled")


REPLY = "CASE {k} % {m} WHEN 0 THEN '{{\"subIndustry\": null}}' WHEN 1 THEN 'sorry' WHEN 2 THEN '{{\"other\": 1}}' WHEN 3 THEN '{{\"subIndustry\": \"NO_SUCH\"}}' ELSE {hit} END"
HIT = "'{{\"subIndustry\": \"' || {sub} || '\"}}'"
ANSWERS = f"""{classes.SQL}, co AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN s.sector END AS sector, CASE WHEN c_custkey % 6 = 0 THEN ' ' WHEN c_custkey % 17 <> 0 THEN ' Label ' || (c_custkey % 40) END AS label, c_custkey % 13 = 0 AS locked, c_custkey % 11 = 0 AS bypass, CASE WHEN c_custkey % 19 = 0 THEN 'NoFit' ELSE 'Pending' END AS state, NULL::VARCHAR AS sub,
  {REPLY.format(k="c_custkey", m=7, hit=HIT.format(sub="a.sub").replace("{{", "{").replace("}}", "}"))} AS constrained, {REPLY.format(k="c_custkey", m=9, hit=HIT.format(sub="b.sub").replace("{{", "{").replace("}}", "}"))} AS free
  FROM customer JOIN dim s ON s.n = c_custkey % 40 * 4 JOIN dim a ON a.n = least(c_custkey % 40 * 4 + c_custkey % 3, {N - 1}) JOIN dim b ON b.n = c_custkey % {N}),
ca AS (SELECT 'Label ' || k AS label, d.sub, 2 AS version FROM (SELECT unnest([5, 6, 7]) AS k) JOIN dim d ON d.n = k),
r AS (SELECT co.*, nullif(trim(label), '') AS key, a.sub AS a, a.sector AS a_sector, b.sub AS b FROM co LEFT JOIN dim a ON constrained = '{{"subIndustry": "' || a.sub || '"}}' LEFT JOIN dim b ON free = '{{"subIndustry": "' || b.sub || '"}}'),
q AS (SELECT r.*, ca.sub AS cached, NOT (locked OR state = 'NoFit') AND NOT (key IS NULL AND NOT bypass) AS asked, coalesce(a_sector = sector, false) AS fits FROM r LEFT JOIN ca ON ca.label = r.key),
fs AS (SELECT key, min(id) AS first_id, min_by(a, id) AS learned FROM q WHERE asked AND NOT bypass AND key IS NOT NULL AND cached IS NULL AND fits GROUP BY key),
g AS (SELECT q.*, CASE WHEN NOT bypass THEN coalesce(cached, CASE WHEN id > first_id THEN learned END) END AS by_cache FROM q LEFT JOIN fs USING (key))"""


def staged(spark, d):
    names = F.array(*(F.struct(F.lit(s).alias("sub"), F.lit(c).alias("sector")) for s, _, c in classes.ROWS))
    at = lambda n: F.get(names, n.cast("int"))
    k = F.col("c_custkey")
    hit = lambda sub: F.concat(F.lit('{"subIndustry": "'), sub, F.lit('"}'))
    reply = lambda m, sub: F.when(k % m == 0, '{"subIndustry": null}').when(k % m == 1, "sorry").when(k % m == 2, '{"other": 1}').when(k % m == 3, '{"subIndustry": "NO_SUCH"}').otherwise(hit(sub))
    own = k % 40 * 4
    companies = table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 10 != 0, at(own)["sector"]).alias("sector"), F.when(k % 6 == 0, " ").when(k % 17 != 0, F.concat(F.lit(" Label "), k % 40)).alias("label"), (k % 13 == 0).alias("locked"), (k % 11 == 0).alias("bypass"),
        F.when(k % 19 == 0, K.NO_FIT).otherwise(K.PENDING).alias("state"), F.lit(None).cast("string").alias("sub"), reply(7, at(F.least(own + k % 3, F.lit(N - 1)))["sub"]).alias("constrained"), reply(9, at(k % N)["sub"]).alias("free"),
    )
    cache = spark.createDataFrame([(f"Label {n}", classes.ROWS[n][0], 2) for n in (5, 6, 7)], "label string, sub string, version int")
    return K.staged(companies, cache, classes.dimension(spark))


@query("classify_staged", f"WITH {ANSWERS} SELECT id, CASE WHEN locked THEN 'Locked' WHEN state = 'NoFit' THEN state WHEN key IS NULL AND NOT bypass THEN 'Pending' WHEN c IS NULL THEN 'NoFit' ELSE 'Resolved' END AS state, CASE WHEN asked THEN c ELSE g.sub END AS sub, d.sector, CASE WHEN asked THEN CASE WHEN by_cache IS NOT NULL THEN 'cache' WHEN fits THEN 'constrained' WHEN b IS NOT NULL THEN 'free' END END AS stage FROM (SELECT *, coalesce(by_cache, CASE WHEN fits THEN a END, b) AS c FROM g) g LEFT JOIN dim d ON d.sub = CASE WHEN asked THEN c ELSE g.sub END")
def classify_staged(spark, d):
    """Cache, constrained and free answers, each where the one before has none; rows without a label stay pending."""
    return staged(spark, d)[0]


@query("classify_cache", f"WITH {ANSWERS} SELECT * FROM ca UNION ALL SELECT key, learned, 3 FROM fs")
def classify_cache(spark, d):
    """The cache afterwards: what was learned has the next version."""
    return staged(spark, d)[1]


@query("label_cache_edit", """WITH ca AS (SELECT lower(p_name) AS label, min(p_type) AS sub FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), ed AS (SELECT p_partkey AS seq, lower(p_name) AS label, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS sub FROM part WHERE p_partkey % 3 = 0),
l AS (SELECT label, sub FROM ed QUALIFY row_number() OVER (PARTITION BY label ORDER BY seq DESC) = 1)
SELECT label, CASE WHEN l.label IS NOT NULL THEN l.sub ELSE ca.sub END AS sub FROM ca FULL JOIN l USING (label) WHERE CASE WHEN l.label IS NOT NULL THEN l.sub ELSE ca.sub END IS NOT NULL""")
def label_cache_edit(spark, d):
    """Labels that are inserted, changed and removed; the last edit of each counts."""
    p = table(spark, d, "part")
    cache = p.where("p_partkey % 2 = 0").groupBy(F.lower("p_name").alias("label")).agg(F.min("p_type").alias("sub"))
    edits = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("seq"), F.concat(F.lit(" "), F.upper("p_name")).alias("label"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("sub"))
    return C.cache_edited(cache, edits)


PARSED = "CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN '2024-01-' || (10 + event_id % 25) WHEN 2 THEN event_id::VARCHAR WHEN 3 THEN (event_id % 90) || '.25' WHEN 4 THEN 'n/a' WHEN 5 THEN '-' || event_id WHEN 6 THEN '2023-02-29' WHEN 7 THEN '1e3' WHEN 8 THEN '99999999999' ELSE '2024-02-29' END"


@query("try_parse", f"SELECT event_id AS id, CASE WHEN regexp_matches(s, '^[+-]?[0-9]+$') THEN try_cast(s AS INT) END AS whole, try_cast(s AS DOUBLE) AS number, CASE WHEN regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast(s AS DATE) END AS day FROM (SELECT event_id, {PARSED} AS s FROM events)")
def try_parse(spark, d):
    """Texts as whole numbers, numbers and days, null where they are none."""
    s = F.expr(PARSED.replace("::VARCHAR", "").replace("THEN event_id WHEN", "THEN cast(event_id AS string) WHEN"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), s.alias("s"))
    whole = F.when(F.regexp_like("s", F.lit("^[+-]?[0-9]+$")), F.col("s").try_cast("int"))
    day = F.when(F.regexp_like("s", F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.col("s").try_cast("date"))
    return rows.select("id", whole.alias("whole"), F.col("s").try_cast("double").alias("number"), day.alias("day"))
