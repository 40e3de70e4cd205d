"""Queries of indices, names and codes. A nation stands for an index, its customers for members."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import indices as I
from tallyforge.operators.reads import active
from tallyforge.registry import query
from tallyforge.sources import domain as D
from tallyforge.sources import readers
from tallyforge.sources.domain import table, with_views

MEMBERS = "(SELECT country_id AS index_id, id, name, sector, industry, market_cap, CASE WHEN market_cap > 0 THEN market_cap / 100 END AS weight FROM companies WHERE NOT deleted)"


def members(spark, d):
    return active(D.companies(spark, d)).select(F.col("country_id").alias("index_id"), "id", "name", "sector", "industry", "market_cap", F.when(F.col("market_cap") > 0, F.col("market_cap") / 100).alias("weight"))


#: A name in capitals and underscores as words.
TITLED = "list_aggregate(list_transform(string_split({0}, '_'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"


@query("index_cap_weights", with_views(f"SELECT index_id, id, round_even(c / sum(c) OVER (PARTITION BY index_id) * 100, 4) AS weight_pct FROM (SELECT *, CASE WHEN market_cap > 0 THEN market_cap END AS c FROM {MEMBERS})", "companies"))
def index_cap_weights(spark, d):
    return I.cap_weights(members(spark, d))


@query("index_breakdown_sector", with_views(f"SELECT index_id, coalesce(sector, 'UNCLASSIFIED') AS sector, {TITLED.format("coalesce(sector, 'UNCLASSIFIED')")} AS label, count(*) AS members, round_even(sum(coalesce(weight, 0)), 2) AS weight FROM {MEMBERS} GROUP BY ALL", "companies"))
def index_breakdown_sector(spark, d):
    return I.breakdown(members(spark, d), "sector", "UNCLASSIFIED").withColumn("label", T.humanise(F.col("sector")))


@query("index_breakdown_industry", with_views(f"SELECT index_id, coalesce(industry, 'Unclassified') AS industry, count(*) AS members, round_even(sum(coalesce(weight, 0)), 2) AS weight FROM {MEMBERS} GROUP BY ALL", "companies"))
def index_breakdown_industry(spark, d):
    return I.breakdown(members(spark, d), "industry", "Unclassified")


@query("index_summary", with_views(f"SELECT index_id, count(id) AS members, round_even(sum(weight), 2) AS covered, nullif(round(sum(market_cap) FILTER (market_cap > 0), 2), 0) AS total_cap FROM {MEMBERS} GROUP BY index_id", "companies"))
def index_summary(spark, d):
    return members(spark, d).groupBy("index_id").agg(F.count("id").alias("members"), F.bround(F.sum("weight"), 2).alias("covered"), F.round(F.sum(F.when(F.col("market_cap") > 0, F.col("market_cap"))), 2).alias("total_cap"))


LINES = "(SELECT s_nationkey::BIGINT AS index_id, s_suppkey % 4 AS id, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / 100 END AS weight FROM supplier)"


def lines(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("index_id"), (F.col("s_suppkey") % 4).alias("id"), F.expr("CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / 100 END").alias("weight"))


@query("index_dual_class", f"SELECT index_id, id, round_even(sum(weight), 4) AS weight FROM {LINES} GROUP BY ALL")
def index_dual_class(spark, d):
    return I.summed_weights(lines(spark, d))


@query("index_dominant_sector", with_views(f"""SELECT index_id, CASE WHEN share >= 0.8 THEN sector END AS sector, round(share, 6) AS share FROM (
  SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY share DESC, sector DESC) AS r FROM (SELECT index_id, sector, CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p ELSE n / sum(n) OVER p END AS share FROM (
    SELECT index_id, sector, sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS w, count(*)::DOUBLE AS n FROM {MEMBERS} WHERE sector IS NOT NULL GROUP BY ALL) WINDOW p AS (PARTITION BY index_id))) WHERE r = 1""", "companies"))  # fmt: skip
def index_dominant_sector(spark, d):
    return I.dominant_sector(members(spark, d))


@query("weight_scale", f"SELECT index_id, id, round(weight * CASE WHEN sum(weight) OVER (PARTITION BY index_id) BETWEEN 1e-300 AND 2 THEN 100 ELSE 1 END, 6) AS weight FROM (SELECT index_id, id, weight / CASE WHEN index_id % 2 = 0 THEN 1000 ELSE 1 END AS weight FROM {LINES})")
def weight_scale(spark, d):
    found = lines(spark, d).withColumn("weight", F.col("weight") / F.when(F.col("index_id") % 2 == 0, 1000).otherwise(1))
    return I.scaled_weights(found).withColumn("weight", F.round("weight", 6))


@query("ambiguous_labels", "SELECT label, count(DISTINCT resolved) AS classes, min(resolved) AS least FROM (SELECT lower(regexp_replace(p_name, '[^\\p{L}\\p{Nd}]', '', 'g')) AS label, p_type AS resolved FROM part) GROUP BY label HAVING count(DISTINCT resolved) > 1")
def ambiguous_labels(spark, d):
    return I.ambiguous_labels(table(spark, d, "part").select(T.norm_label(F.col("p_name")).alias("label"), F.col("p_type").alias("resolved")))


@query("ambiguous_flags", "WITH l AS (SELECT p_partkey AS id, lower(regexp_replace(p_name, '[^\\p{L}\\p{Nd}]', '', 'g')) AS label, CASE WHEN p_partkey % 10 <> 0 THEN p_type END AS resolved FROM part) SELECT id, label, coalesce(c > 1, false) AS ambiguous FROM l LEFT JOIN (SELECT label, count(DISTINCT resolved) AS c FROM l GROUP BY label) USING (label)")
def ambiguous_flags(spark, d):
    """Every row with whether its label has resolved to several classes."""
    return I.flagged(table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.norm_label(F.col("p_name")).alias("label"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_type")).alias("resolved"))).select("id", "label", "ambiguous")


@query("unclassified_report", with_views("SELECT id, name, CASE WHEN sector IS NULL THEN 'NoFit' ELSE 'Pending' END AS state, row_number() OVER (ORDER BY sector IS NULL DESC, name, id)::INT AS place FROM companies WHERE NOT deleted AND industry IS NULL", "companies"))
def unclassified_report(spark, d):
    """Companies without an industry, those that fit nowhere first. Places are counted by range, not in one task."""
    from tallyforge.operators.ranking import global_rank

    found = active(D.companies(spark, d)).where("industry is null").select("id", "name", F.when(F.col("sector").isNull(), "NoFit").otherwise("Pending").alias("state"))
    return global_rank(found, [F.col("state"), F.col("name"), F.col("id")], "place")


ROLLUP = "rollup_dim AS (SELECT p_type AS sub, split_part(p_type, ' ', 2) AS industry, split_part(p_type, ' ', 1) AS sector FROM part GROUP BY ALL)"


@query("gics_rollup", f"WITH {ROLLUP} SELECT p_partkey AS id, sub, d.industry, d.sector FROM part JOIN rollup_dim d ON p_type = sub")
def gics_rollup(spark, d):
    """A class's industry and sector come from the class alone, whatever is stored beside it."""
    parts = table(spark, d, "part")
    words = F.split("sub", " ")
    dim = parts.select(F.col("p_type").alias("sub")).distinct().select("sub", F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("industry"), F.get(words, F.lit(0)).alias("sector"))
    return parts.join(dim, F.col("p_type") == F.col("sub")).select(F.col("p_partkey").alias("id"), "sub", "industry", "sector")


VENDOR = "CASE c_custkey % 5 WHEN 0 THEN 'Financial Services' WHEN 1 THEN 'Health-Care' WHEN 2 THEN ' technology' WHEN 3 THEN 'Consumer Cyclical' ELSE 'Other' END"


@query("sector_map", f"SELECT c_custkey AS id, CASE lower(regexp_replace({VENDOR}, '[^A-Za-z]', '', 'g')) WHEN 'financialservices' THEN 'FINANCIALS' WHEN 'healthcare' THEN 'HEALTH_CARE' WHEN 'technology' THEN 'INFORMATION_TECHNOLOGY' WHEN 'consumercyclical' THEN 'CONSUMER_DISCRETIONARY' END AS sector FROM customer")
def sector_map(spark, d):
    known = F.create_map(*(F.lit(x) for pair in T.VENDOR_SECTORS.items() for x in pair))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), known[T.norm_label(F.expr(VENDOR))].alias("sector"))


# Industry codes to sectors, None where there is none; the first prefix that fits counts.
RULES = (
    ("S00101", "UTILITIES"), ("S00202", "UTILITIES"), ("S00800", "REAL_ESTATE"), ("HS", "REAL_ESTATE"), ("ORE", "REAL_ESTATE"),
    ("S00201", "INDUSTRIALS"), ("S", None), ("G", None), ("F", None), ("V", None), ("T", None), ("3254", "HEALTH_CARE"), ("3391", "HEALTH_CARE"),
    ("3361", "CONSUMER_DISCRETIONARY"), ("3362", "CONSUMER_DISCRETIONARY"), ("3363", "CONSUMER_DISCRETIONARY"), ("3364", "INDUSTRIALS"),
    ("3365", "INDUSTRIALS"), ("3366", "INDUSTRIALS"), ("3369", "INDUSTRIALS"), ("5112", "INFORMATION_TECHNOLOGY"), ("5415", "INFORMATION_TECHNOLOGY"),
    ("518", "INFORMATION_TECHNOLOGY"), ("519", "INFORMATION_TECHNOLOGY"), ("514", "INFORMATION_TECHNOLOGY"), ("211", "ENERGY"), ("2121", "ENERGY"),
    ("212", "MATERIALS"), ("213111", "ENERGY"), ("213112", "ENERGY"), ("21311", "MATERIALS"), ("213", "ENERGY"), ("486", "ENERGY"),
    ("711", "COMMUNICATION_SERVICES"), ("712", "COMMUNICATION_SERVICES"), ("713", "CONSUMER_DISCRETIONARY"), ("113", "MATERIALS"),
    ("11", "CONSUMER_STAPLES"), ("22", "UTILITIES"), ("23", "INDUSTRIALS"), ("311", "CONSUMER_STAPLES"), ("312", "CONSUMER_STAPLES"),
    ("313", "CONSUMER_DISCRETIONARY"), ("314", "CONSUMER_DISCRETIONARY"), ("315", "CONSUMER_DISCRETIONARY"), ("316", "CONSUMER_DISCRETIONARY"),
    ("321", "MATERIALS"), ("322", "MATERIALS"), ("323", "INDUSTRIALS"), ("324", "ENERGY"), ("325", "MATERIALS"), ("326", "MATERIALS"),
    ("327", "MATERIALS"), ("331", "MATERIALS"), ("332", "INDUSTRIALS"), ("333", "INDUSTRIALS"), ("334", "INFORMATION_TECHNOLOGY"),
    ("335", "INDUSTRIALS"), ("336", "INDUSTRIALS"), ("337", "CONSUMER_DISCRETIONARY"), ("339", "CONSUMER_DISCRETIONARY"), ("42", "INDUSTRIALS"),
    ("445", "CONSUMER_STAPLES"), ("4A", "CONSUMER_DISCRETIONARY"), ("44", "CONSUMER_DISCRETIONARY"), ("45", "CONSUMER_DISCRETIONARY"),
    ("48", "INDUSTRIALS"), ("49", "INDUSTRIALS"), ("51", "COMMUNICATION_SERVICES"), ("52", "FINANCIALS"), ("53", "REAL_ESTATE"),
    ("54", "INDUSTRIALS"), ("55", "INDUSTRIALS"), ("56", "INDUSTRIALS"), ("61", "CONSUMER_DISCRETIONARY"), ("62", "HEALTH_CARE"),
    ("71", "CONSUMER_DISCRETIONARY"), ("72", "CONSUMER_DISCRETIONARY"), ("81", "CONSUMER_DISCRETIONARY"),
)
CODE = "CASE p_partkey % 9 WHEN 0 THEN 'S00101' WHEN 1 THEN 'hs' WHEN 2 THEN 'GFE' WHEN 3 THEN '3361MV' ELSE {} END"


@query("naics_to_gics", "SELECT id, code, CASE " + " ".join(f"WHEN starts_with(code, '{p}') THEN {repr(s) if s else 'NULL'}" for p, s in RULES) + " END AS sector FROM (SELECT p_partkey AS id, upper(" + CODE.format("(p_partkey * 7919 % 900000 + 100000)::VARCHAR") + ") AS code FROM part)")
def naics_to_gics(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper(F.expr(CODE.format("cast(p_partkey * 7919 % 900000 + 100000 AS string)"))).alias("code"))
    sector = F.lit(None).cast("string")
    for prefix, name in reversed(RULES):
        sector = F.when(F.startswith("code", F.lit(prefix)), F.lit(name)).otherwise(sector)
    return rows.withColumn("sector", sector)


SUFFIX = "CASE s_suppkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Holdings, LLC' WHEN 2 THEN ' & Co' ELSE '' END"
STOP = ", ".join(f"'{t}'" for t in T.STOP_TOKENS)
NORM = "array_to_string(list_filter(string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN (" + STOP + ")), ' ')"


@query("norm_name", f"SELECT s_suppkey AS id, {NORM.format(f'(s_name || {SUFFIX})')} AS norm FROM supplier")
def norm_name(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), T.norm_name(F.concat("s_name", F.expr(SUFFIX))).alias("norm"))


RAW_CIK = "CASE c_custkey % 6 WHEN 0 THEN '0000000' WHEN 1 THEN ' CIK-' || (c_custkey * 7) || ' ' WHEN 2 THEN '' WHEN 3 THEN 'none' WHEN 4 THEN '00' || c_custkey || '123456789' ELSE lpad(c_custkey, 10, '0') END".replace("lpad(c_custkey,", "lpad(cast(c_custkey AS {0}),")


@query("norm_cik", f"WITH r AS (SELECT c_custkey AS id, {RAW_CIK.format('VARCHAR')} AS raw FROM customer), d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM r) SELECT id, CASE WHEN digits <> '' THEN repeat('0', greatest(0, 10 - length(digits))) || digits END AS cik, ltrim(raw, '0') AS bare, regexp_replace(raw, '[^1-9]', '', 'g') = '' AS missing FROM d")
def norm_cik(spark, d):
    """Zeros, marks around digits, no digits, and more than ten of them."""
    raw = F.expr(RAW_CIK.format("STRING"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.norm_cik(raw).alias("cik"), T.trim_cik(raw).alias("bare"), T.missing_cik(raw).alias("missing"))


QUOTED = "CASE p_partkey % 9 WHEN 0 THEN ' brk.' || p_size || '[1] US' WHEN 1 THEN 'bf.b' WHEN 2 THEN p_name WHEN 3 THEN '' WHEN 4 THEN '[1]abc' WHEN 5 THEN ' a.b.c' || chr(9) || 'q' WHEN 6 THEN p_brand || chr(10) || 'x' WHEN 7 THEN '.' || p_type END"


@query("norm_ticker", f"SELECT p_partkey AS id, upper(replace(regexp_extract(trim({QUOTED}), '^([^ \\t\\n\\[]*)', 1), '.', '-')) AS ticker FROM part")
def norm_ticker(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.norm_ticker(F.expr(QUOTED)).alias("ticker"))


@query("name_match", f"SELECT s_suppkey AS id, min(c_custkey) AS matched FROM supplier LEFT JOIN customer ON {NORM.format('(s_name || chr(32) || chr(73) || chr(110) || chr(99))')} = replace({NORM.format('c_name')}, 'customer', 'supplier') GROUP BY s_suppkey")
def name_match(spark, d):
    """Companies whose normalised names agree; of several the smallest id."""
    left = table(spark, d, "supplier").select("s_suppkey", T.norm_name(F.concat("s_name", F.lit(" Inc"))).alias("key"))
    right = table(spark, d, "customer").select("c_custkey", F.replace(T.norm_name(F.col("c_name")), F.lit("customer"), F.lit("supplier")).alias("key")).groupBy("key").agg(F.min("c_custkey").alias("matched"))
    return left.join(right, "key", "left").select(F.col("s_suppkey").alias("id"), "matched")


@query("cik_match", with_views("SELECT e.id, c.id AS company_id FROM (SELECT id, lpad((company_id * 37)::VARCHAR, 10, '0') AS cik FROM evts) e JOIN companies c ON e.cik = c.cik WHERE NOT c.deleted", "evts", "companies"))
def cik_match(spark, d):
    e = D.events(spark, d).select("id", T.norm_cik(F.concat(F.lit("CIK "), (F.col("company_id") * 37).cast("string"))).alias("cik"))
    return e.join(active(D.companies(spark, d)).select(F.col("id").alias("company_id"), "cik"), "cik").select("id", "company_id")


@query("backfill_cik", with_views(f"""WITH k AS (SELECT {NORM.format('c_name')} AS key, lpad((c_custkey * 37)::VARCHAR, 10, '0') AS cik FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT {NORM.format('c_name')}, lpad((c_custkey * 41)::VARCHAR, 10, '0') FROM customer WHERE c_custkey % 10 = 0),
u AS (SELECT key, min(cik) AS cik FROM k GROUP BY key HAVING count(DISTINCT cik) = 1)
SELECT c.id, c.name, u.cik FROM companies c JOIN countries n ON c.country_id = n.id JOIN u ON u.key = {NORM.format('c.name')} WHERE NOT c.deleted AND n.name = 'NATION_3' AND c.cik IS NULL""".replace("WITH k AS", "SELECT id, name, cik FROM (WITH k AS", 1) + ")", "companies", "countries"))  # fmt: skip
def backfill_cik(spark, d):
    """Companies of one country without a CIK get that of their name, if it stands for no other."""
    c = table(spark, d, "customer").select(T.norm_name(F.col("c_name")).alias("key"), "c_custkey")
    code = lambda n: F.lpad((F.col("c_custkey") * n).cast("string"), 10, "0").alias("cik")
    known = c.where("c_custkey % 2 = 0").select("key", code(37)).unionByName(c.where("c_custkey % 10 = 0").select("key", code(41)))
    n = D.countries(spark, d).where("name = 'NATION_3'").select(F.col("id").alias("country_id"))
    lacking = active(D.companies(spark, d)).where(T.missing_cik(F.col("cik"))).join(F.broadcast(n), "country_id", "left_semi")
    return I.backfilled(lacking.select("id", "name", T.norm_name(F.col("name")).alias("key")), known).select("id", "name", "cik")


@query("first_wins_map", "SELECT p_brand AS cik, arg_min(p_name, p_size * 1000000 + p_partkey) AS ticker, count(*) AS lines FROM part GROUP BY p_brand")
def first_wins_map(spark, d):
    """Of a company's lines the first counts."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("cik"), F.col("p_name").alias("ticker"), (F.col("p_size") * 1000000 + F.col("p_partkey")).alias("pos"))
    return readers.ticker_map(rows).join(rows.groupBy("cik").agg(F.count("*").alias("lines")), "cik")


@query("first_wins_inverse", "SELECT upper(p_type) AS ticker, arg_min(p_brand, p_size * 1000000 + p_partkey) AS cik FROM part GROUP BY upper(p_type)")
def first_wins_inverse(spark, d):
    """From a ticker, in any case, back to the first company with it."""
    case = F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    return readers.ticker_inverse(table(spark, d, "part").select(F.col("p_brand").alias("cik"), case.alias("ticker"), (F.col("p_size") * 1000000 + F.col("p_partkey")).alias("pos")))


@query("two_hop_resolve", with_views("SELECT s_suppkey AS id, c.id AS company_id FROM supplier LEFT JOIN (SELECT cik, min(id) AS id FROM companies WHERE NOT deleted GROUP BY cik) c ON c.cik = lpad((s_suppkey * 37)::VARCHAR, 10, '0')", "companies"))
def two_hop_resolve(spark, d):
    """Ticker to CIK to company; the first company of a CIK counts, unmatched lines stay with null."""
    tickers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lpad((F.col("s_suppkey") * 37).cast("string"), 10, "0").alias("cik"))
    first = active(D.companies(spark, d)).groupBy("cik").agg(F.min("id").alias("company_id"))
    return tickers.join(first, "cik", "left").select("id", "company_id")


@query("country_resolve", with_views("""SELECT r.id, coalesce(a.id, b.id, m.id, r.owner) AS country_id FROM (SELECT c_custkey AS id, c_nationkey::BIGINT AS owner, CASE c_custkey % 4 WHEN 0 THEN 'n' || (c_custkey % 40) WHEN 1 THEN upper('na' || chr((97 + c_custkey % 26)::INT)) WHEN 2 THEN 'Nation_' || (c_custkey % 30) WHEN 3 THEN CASE WHEN c_custkey % 8 = 3 THEN ' nation_7 ' END END AS called FROM customer) r
LEFT JOIN countries a ON lower(a.code) = lower(trim(r.called)) LEFT JOIN countries b ON 'na' || chr((97 + b.id)::INT) = lower(trim(r.called)) LEFT JOIN countries m ON lower(m.name) = lower(trim(r.called))""", "countries"))  # fmt: skip
def country_resolve(spark, d):
    """By two-letter code, else by three-letter one, else by name, in any case; else the owner's country."""
    n = D.countries(spark, d)
    called = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('n', c_custkey % 40) WHEN 1 THEN upper(concat('na', char(97 + c_custkey % 26))) WHEN 2 THEN concat('Nation_', c_custkey % 30) WHEN 3 THEN CASE WHEN c_custkey % 8 = 3 THEN ' nation_7 ' END END")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("owner"), F.lower(F.trim(called)).alias("called"))
    names = n.select(F.lower("code").alias("a_key"), F.expr("concat('na', char(97 + id))").alias("b_key"), F.lower("name").alias("m_key"), "id")
    for k in "abm":
        rows = rows.join(F.broadcast(names.select(F.col(f"{k}_key").alias("called"), F.col("id").alias(k))), "called", "left")
    return rows.select("id", F.coalesce("a", "b", "m", "owner").alias("country_id"))


@query("classify_apply", f"WITH {ROLLUP} SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'Locked' WHEN d.sub IS NULL THEN 'NoFit' ELSE 'Resolved' END AS state, CASE WHEN p_size % 10 <> 0 THEN d.sector END AS sector FROM part LEFT JOIN rollup_dim d ON d.sub = CASE WHEN p_partkey % 6 <> 0 THEN p_type END")
def classify_apply(spark, d):
    """A hit resolves and rolls up, a miss doesn't fit, locked rows stay as they are."""
    parts = table(spark, d, "part")
    dim = parts.select(F.col("p_type").alias("sub")).distinct().select("sub", F.get(F.split("sub", " "), F.lit(0)).alias("sector"))
    rows = parts.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10 == 0).alias("locked"), F.expr("CASE WHEN p_partkey % 6 <> 0 THEN p_type END").alias("label"))
    state = F.when(F.col("locked"), "Locked").when(F.col("sub").isNull(), "NoFit").otherwise("Resolved")
    return rows.join(dim, F.col("label") == F.col("sub"), "left").select("id", state.alias("state"), F.when(~F.col("locked"), F.col("sector")).alias("sector"))


@query("fx_convert", "SELECT o_orderkey AS id, round(o_totalprice * CASE o_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.08 WHEN 2 THEN 0.01 END::DOUBLE, 4) AS usd FROM orders")
def fx_convert(spark, d):
    """To dollars by the latest rate; an unknown currency gives null."""
    rates = spark.createDataFrame([(0, 1.0), (1, 1.08), (2, 0.01)], "currency long, rate double")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("currency"), "o_totalprice")
    return rows.join(F.broadcast(rates), "currency", "left").select("id", F.round(F.col("o_totalprice") * F.col("rate"), 4).alias("usd"))


ADDRESSES = ["' /wiki/Index_' || id || ' '", "'https://en.wikipedia.org/wiki/S%26P_' || id", "'HTTP://EN.WIKIPEDIA.ORG/wiki/A_' || id || '?x=/wiki/'", "'https://de.wikipedia.org/w/index.php?title=' || id", "'https://example.org/wiki/' || id", "'wiki/Foo'", "'https://user@fr.wikipedia.org:443/wiki/B_' || id || '#part'", "'https://notwikipedia.org/wiki/' || id", "'https://en.wikipedia.org.example.com/wiki/' || id", "'ftp://wikipedia.org/wiki/C'", "''", "NULL", "'//en.wikipedia.org/wiki/D'", "'https://wikipedia.org'", "'/Wiki/E'"]
TICKERS = ["' spy '", "'QQQ'", "'none!'", "'A1'", "'TOOLONG'", "''", "NULL", "'b.k'", "'sixlet'"]
SUGGESTED = "CASE {} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(ADDRESSES)) + " END", "CASE {} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(TICKERS)) + " END"


@query("wiki_paths", rf"""WITH s AS (SELECT id, trim({SUGGESTED[0].format(f"id % {len(ADDRESSES)}")}) AS page, upper(trim({SUGGESTED[1].format(f"id % {len(TICKERS)}")})) AS ticker FROM (SELECT event_id AS id FROM events))
SELECT id, CASE WHEN starts_with(page, '/wiki/') THEN page WHEN ends_with(lower(regexp_extract(page, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), 'wikipedia.org') AND starts_with(regexp_extract(page, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/wiki/') THEN regexp_extract(page, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END AS path, CASE WHEN regexp_matches(ticker, '^[A-Z]{{1,6}}$') THEN ticker END AS ticker FROM s""")  # fmt: skip
def wiki_paths(spark, d):
    """Suggested pages and funds of indices: addresses of many forms, of which articles' paths are kept."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"))
    page, ticker = (F.expr(x.format(f"id % {n}")) for x, n in zip(SUGGESTED, (len(ADDRESSES), len(TICKERS))))
    return rows.select("id", T.wiki_path(page).alias("path"), T.fund_ticker(ticker).alias("ticker"))
