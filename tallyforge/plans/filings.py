"""Queries of filing text: documents and pages stand for filings, props of events for answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import filings as L
from tallyforge.registry import query
from tallyforge.sources.domain import table

LINES = """ln AS (SELECT doc_id, i::INT AS pos, CASE WHEN (doc_id + i) % 4 = 0 THEN '## Item ' || (1 + (doc_id + i) // 4 % 3) || 'a. ' || p[i] ELSE p[i] END AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def lines(spark, d):
    """Lines of documents; every fourth one is made an item heading."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("pos", F.col("at") + 1)
    head = F.concat(F.lit("## Item "), F.expr("1 + (doc_id + pos) div 4 % 3"), F.lit("a. "), "raw")
    return rows.select("doc_id", "pos", F.when((F.col("doc_id") + F.col("pos")) % 4 == 0, head).otherwise(F.col("raw")).alias("line"))


def _score(x: str, node: str) -> str:
    return " + ".join([f"CASE WHEN contains({x}, '<td') THEN 5 ELSE 0 END", *(f"contains(lower({x}), '{k.lower()}')::INT" for k in L.KEYWORDS[node])])


FORMS = "CASE p_partkey % 8 WHEN 0 THEN '8-K' WHEN 1 THEN ' 8-k/A ' WHEN 2 THEN '10-K' WHEN 3 THEN '10-8-K' WHEN 4 THEN '' WHEN 5 THEN '8K' WHEN 6 THEN '8-K12B' END"
ASKED = "CASE p_size % 4 WHEN 0 THEN 'RISK' WHEN 1 THEN 'COST' WHEN 2 THEN 'REVENUE' ELSE 'OTHER' END"


@query("item_routing", f"SELECT p_partkey AS id, CASE {ASKED} WHEN 'RISK' THEN '1A,7A' WHEN 'COST' THEN '1,7,8' WHEN 'REVENUE' THEN CASE WHEN starts_with(upper(trim({FORMS})), '8-K') THEN '1.01,2.02,8.01' ELSE '1,1A,7,8' END END AS items FROM part")
def item_routing(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), L.item_routes(F.expr(ASKED), F.expr(FORMS)).alias("items"))


PLAIN_HTML = "(?i)<html|<body|<div|<p|<table"


@query("looks_html", f"SELECT page_id AS id, regexp_matches(substr(html, 1, 2000), '{PLAIN_HTML}') AS yes FROM pages UNION ALL SELECT doc_id + 1000000, regexp_matches(substr(text, 1, 2000), '{PLAIN_HTML}') FROM documents")
def looks_html(spark, d):
    a = table(spark, d, "pages").select(F.col("page_id").alias("id"), L.looks_html(F.col("html")).alias("yes"))
    return a.unionByName(table(spark, d, "documents").select((F.col("doc_id") + 1000000).alias("id"), L.looks_html(F.col("text")).alias("yes")))


def _plain(x: str) -> str:
    for tag in ("script", "style", "head"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</(p|div|tr|li|h[1-6]|table)>|<br>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    # HTML knows these names without their semicolon too, as in a title that is cut inside a reference
    for name, char in (("&nbsp;?", "\u00a0"), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{name}', '{char}', 'g')"
    return x


@query("html_to_text", rf"""WITH raw AS (SELECT page_id AS id, {_plain('html')} AS text FROM pages UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE NOT regexp_matches(substr(text, 1, 2000), '{PLAIN_HTML}')),
l AS (SELECT id, list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x{{a0}}]+', ' ', 'g'), ' ' || chr(9) || chr(11) || chr(12))) AS a FROM raw)
SELECT id, array_to_string(list_filter(a, lambda x, i: x <> '' OR i = 1 OR a[i - 1] <> ''), chr(10)) || chr(10) AS text FROM l""")  # fmt: skip
def html_to_text(spark, d):
    """Pages as HTML, documents as plain text; tests hold tables against fixtures."""
    from tallyforge.operators import markup

    docs = table(spark, d, "documents").where(~L.looks_html(F.col("text"))).select((F.col("doc_id") + 1000000).alias("id"), F.col("text").alias("html"))
    return markup.with_text(table(spark, d, "pages").select(F.col("page_id").alias("id"), "html").unionByName(docs))


REPORT_ROWS = "'<tr><td>' || p_name || '</td><td></td><td>$</td><td>' || p_size || ',000</td></tr>'"


@query("table_render", f"""SELECT p_brand AS id, 0 AS place, '<table><tr><td>Item</td><td>' || p_brand || '</td></tr>' || string_agg('<tr><td>' || p_name || '</td><td>$' || p_size || ',000</td></tr>', '' ORDER BY p_partkey) || '</table>' AS "table" FROM part GROUP BY p_brand""")
def table_render(spark, d):
    """Tables with spacer columns and signs in cells of their own; tests hold merged headers and the rest against fixtures."""
    from tallyforge.operators import markup

    row = F.expr("concat('<tr><td>', p_name, '</td><td></td><td>$</td><td>', p_size, ',000</td></tr>')")
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("rows"))
    html = F.concat(F.lit("<table><tr><th></th></tr><tr><td>Item</td><td colspan=2></td><td>"), "id", F.lit("</td></tr>"), F.array_join(F.transform("rows", lambda r: r["r"]), ""), F.lit("</table>"))
    return markup.with_tables(rows.select("id", html.alias("html")))


CELL = "CASE p_partkey % 5 WHEN 0 THEN '$ (' || p_size || ',000)' WHEN 1 THEN p_size || '.5 %' WHEN 2 THEN p_name WHEN 3 THEN '-' ELSE '' END"


@query("cell_clean", rf"SELECT p_partkey AS id, length({CELL}) BETWEEN 1 AND 39 AND regexp_matches({CELL}, '[0-9]') AND regexp_matches({CELL}, '^[$()\-\s0-9,.%]+$') AS is_number FROM part")
def cell_clean(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), L.is_numeric_cell(F.expr(CELL)).alias("is_number"))


ITEM = "coalesce(nullif(upper(regexp_extract(line, '" + L.HEADING + "', 1)), ''), " + ", ".join(f"CASE WHEN regexp_matches(line, '(?i)^[#>*_\\s]*{t}[.:\\s]*$') THEN '{k}' END" for k, t in ((k, t.replace("'", "''")) for k, t in L.TITLES.items())) + ")"


@query("item_boundaries", f"WITH {LINES}, m AS (SELECT doc_id, pos, {ITEM} AS item FROM ln) SELECT * FROM m WHERE item IS NOT NULL")
def item_boundaries(spark, d):
    return L.item_lines(lines(spark, d)).select("doc_id", "pos", "item")


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
BODIES = rf"""m AS (SELECT *, {ITEM} AS item FROM ln),
f AS (SELECT *, last_value(item IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS now FROM m),
t AS (SELECT *, CASE WHEN now IS NOT NULL AND now IS DISTINCT FROM lag(now) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS turn FROM f),
b AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM t WHERE now IS NOT NULL),
g AS (SELECT doc_id, now AS item, part, min(pos) AS first, trim(string_agg(CASE WHEN turn = 1 THEN regexp_extract(line, '{L.HEADING}(.*)$', 2) ELSE line END, chr(10) ORDER BY pos), {BLANK}) AS body FROM b GROUP BY ALL),
body AS (SELECT doc_id, item, first, body FROM g WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY length(body) DESC, first) = 1)"""


@query("section_body", f"WITH {LINES}, {BODIES} SELECT * FROM body")
def section_body(spark, d):
    return L.sections(lines(spark, d))


LIMIT = 1000
PARAS = """src AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (doc_id + i) % 7 = 0 THEN '<table>' || x ELSE x END) AS a FROM documents),
para AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, p FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, trim(unnest(a), """ + BLANK + f""") AS p FROM src) WHERE p <> ''),
r AS (SELECT doc_id, 0 AS i, '' AS cur, '' AS prev, NULL::VARCHAR AS one, NULL::VARCHAR AS two FROM src
UNION ALL SELECT r.doc_id, p.i, CASE WHEN length(p) > {LIMIT} THEN '' WHEN cur <> '' AND length(cur) + length(p) > {LIMIT} THEN cap || p ELSE cur || CASE WHEN cur <> '' THEN chr(10) || chr(10) ELSE '' END || p END, left(p, 501),
  CASE WHEN cur <> '' AND (length(p) > {LIMIT} OR length(cur) + length(p) > {LIMIT}) THEN cur END, CASE WHEN length(p) > {LIMIT} THEN CASE WHEN tab THEN cap || p ELSE left(p, {LIMIT}) END END
  FROM r JOIN (SELECT *, starts_with(lower(p), '<table') AS tab FROM para) p ON p.doc_id = r.doc_id AND p.i = r.i + 1, LATERAL (SELECT CASE WHEN tab AND length(prev) BETWEEN 1 AND 500 THEN prev || chr(10) || chr(10) ELSE '' END AS cap)),
o AS (SELECT doc_id, i, 0 AS k, one AS text FROM r WHERE one IS NOT NULL UNION ALL SELECT doc_id, i, 1, two FROM r WHERE two IS NOT NULL UNION ALL SELECT doc_id, i, 2, cur FROM r WHERE cur <> '' QUALIFY i = max(i) OVER (PARTITION BY doc_id)),
c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS chunk, text FROM o)"""
# the last state of a document is the one after its last paragraph, whether or not it is empty
PARAS = PARAS.replace("SELECT doc_id, i, 2, cur FROM r WHERE cur <> '' QUALIFY i = max(i) OVER (PARTITION BY doc_id)", "SELECT doc_id, i, 2, cur FROM (SELECT * FROM r QUALIFY i = max(i) OVER (PARTITION BY doc_id)) WHERE cur <> ''")


def paragraphs(spark, d):
    """Documents whose lines are paragraphs, one in seven of them a table."""
    made = F.transform(F.split("text", "\n"), lambda x, i: F.when((F.col("doc_id") + i + 1) % 7 == 0, F.concat(F.lit("<table>"), x)).otherwise(x))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(made, "\n\n").alias("text"))


@query("chunk_pack", f"WITH RECURSIVE {PARAS} SELECT * FROM c")
def chunk_pack(spark, d):
    return L.pack(paragraphs(spark, d), LIMIT)


@query("chunk_caps", f"WITH RECURSIVE {PARAS}, n AS (SELECT *, (SCORE)::INT AS score FROM c) SELECT doc_id, chunk, score, length(text)::INT AS n_chars FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk) <= 6".replace("SCORE", " + ".join(["CASE WHEN contains(text, '<td') THEN 5 ELSE 0 END", *(f"contains(lower(text), '{k.lower()}')::INT" for k in L.KEYWORDS["COST"])])))
def chunk_caps(spark, d):
    """The six most relevant chunks of a section: the cap is the feature."""
    found = L.pack(paragraphs(spark, d), LIMIT).withColumn("score", L.score(F.col("text"), "COST"))
    return L.capped(found, "doc_id", [F.desc("score"), F.col("chunk")], 6).select("doc_id", "chunk", "score", F.length("text").alias("n_chars"))


@query("section_build", f"WITH RECURSIVE {PARAS}, n AS (SELECT *, ({_score('text', 'REVENUE')})::INT AS score FROM c), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk) <= 4) SELECT doc_id, chunk, score, row_number() OVER (PARTITION BY doc_id ORDER BY chunk)::INT AS place, text FROM b")
def section_build(spark, d):
    """The four most relevant chunks of a section, in document order: the cap is the feature."""
    return L.build_section(L.pack(paragraphs(spark, d), LIMIT), "doc_id", "chunk", "REVENUE", 4).select("doc_id", "chunk", "score", "place", "text")


@query("chunk_fair", f"""WITH RECURSIVE {PARAS}, n AS (SELECT doc_id // 20 AS filing, doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS n FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY doc_id, chunk) AS place, lag(n) OVER (PARTITION BY filing ORDER BY doc_id, chunk) AS before FROM n WHERE n <= 12)
SELECT filing, doc_id, chunk FROM k WHERE place <= 48 OR place = 49 AND before = 12""")  # fmt: skip
def chunk_fair(spark, d):
    """Twelve chunks of a section, 48 of a filing; twenty documents stand for a filing's sections."""
    found = L.pack(paragraphs(spark, d), LIMIT).select((F.floor(F.col("doc_id") / 20)).alias("filing"), "doc_id", "chunk")
    return L.fair_share(found, "filing", "doc_id", "chunk", 12, 48)


@query("chunk_rank", f"WITH {LINES} SELECT doc_id, pos, score FROM (SELECT doc_id, pos, ({_score('line', 'RISK')})::INT AS score FROM ln) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 5")
def chunk_rank(spark, d):
    found = lines(spark, d).withColumn("score", L.score(F.col("line"), "RISK"))
    return L.capped(found, "doc_id", [F.desc("score"), F.col("pos")], 5).select("doc_id", "pos", "score")


REPORT = "CASE p_partkey % 9 WHEN 0 THEN 'CONSOLIDATED STATEMENTS OF OPERATIONS' WHEN 1 THEN 'Statements of Comprehensive Income' WHEN 2 THEN 'Segment information (Details)' WHEN 3 THEN 'Statements of Income (PARENTHETICAL)' WHEN 4 THEN 'Leases (Details)' WHEN 5 THEN 'Statements of Operations and Comprehensive Income' WHEN 6 THEN 'Revenue - additional information (Details)' WHEN 7 THEN 'Supply costs (Details)' ELSE p_name END"
MENU = "CASE p_size % 4 WHEN 0 THEN 'Statements' WHEN 1 THEN 'Details' WHEN 2 THEN 'Notes' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'Details' ELSE 'Statements' END END"
NODE = "CASE p_size % 5 WHEN 0 THEN 'RISK' WHEN 1 THEN 'COST' WHEN 2 THEN 'COST' ELSE 'REVENUE' END"


@query("report_select", f"""SELECT id, CASE WHEN node = 'RISK' OR name ILIKE '%parenthetical%' OR name ILIKE '%additional information%' THEN false
WHEN menu = 'Statements' THEN regexp_matches(regexp_replace(name, '(?i)comprehensive income', '', 'g'), '(?i)operations|income|earnings')
WHEN menu = 'Details' THEN CASE node WHEN 'COST' THEN ({_score('name', 'COST')}) > 0 ELSE ({_score('name', 'REVENUE')}) > 0 END ELSE false END AS chosen
FROM (SELECT p_partkey AS id, {REPORT} AS name, {MENU} AS menu, {NODE} AS node FROM part)""")  # fmt: skip
def report_select(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), L.wanted_report(F.expr(REPORT), F.expr(MENU), F.expr(NODE)).alias("chosen"))


JOINED = """p AS (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY pos) AS i FROM ({pieces})),
r AS (SELECT filing, 0 AS i, '' AS item, '' AS cur, CAST([] AS VARCHAR[]) AS titles, false AS fresh FROM p GROUP BY filing
UNION ALL SELECT r.filing, p.i, p.item, CASE WHEN f.full_ THEN piece ELSE cur || CASE WHEN cur <> '' THEN chr(10) || chr(10) ELSE '' END || piece END, CASE WHEN f.full_ THEN [title] ELSE list_append(titles, title) END, f.full_
  FROM r JOIN p ON p.filing = r.filing AND p.i = r.i + 1, LATERAL (SELECT cur <> '' AND (r.item <> p.item OR length(cur) + length(piece) > {limit}) AS full_) f),
e AS (SELECT filing, item, cur AS text, titles, i, coalesce(lead(fresh) OVER (PARTITION BY filing ORDER BY i), true) AS closes FROM r WHERE i > 0),
u AS (SELECT filing, (row_number() OVER (PARTITION BY filing ORDER BY i) - 1)::INT AS chunk, item, text, titles FROM e WHERE closes)
SELECT filing, chunk, item, text, (SELECT string_agg(t, ',' ORDER BY k) FROM (SELECT t, min(k) AS k FROM (SELECT unnest(u.titles) AS t, unnest(range(len(u.titles))) AS k) GROUP BY t)) AS titles FROM u"""


@query("report_pack", "WITH RECURSIVE " + JOINED.format(pieces="SELECT p_brand AS filing, p_partkey AS pos, '<table>' || p_name || repeat(' x', p_size) || '</table>' AS piece, 'Item 8' AS item, p_type AS title FROM part", limit=300))
def report_pack(spark, d):
    """Rendered tables of a filing up to the budget; one over it goes whole; titles each once."""
    p = table(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("filing"), F.col("p_partkey").alias("pos"), F.expr("concat('<table>', p_name, repeat(' x', p_size), '</table>')").alias("piece"), F.lit("Item 8").alias("item"), F.col("p_type").alias("title"))
    return L.joined_packs(rows, "filing", "pos", "item", 300).withColumn("titles", F.array_join("titles", ","))


@query("heading_pack", "WITH RECURSIVE " + JOINED.format(pieces="SELECT p_brand AS filing, p_partkey AS pos, '## ' || p_type || chr(10) || p_name || repeat(' x', p_size) AS piece, 'Item ' || (p_partkey // 40 % 3) AS item, p_type AS title FROM part", limit=300))
def heading_pack(spark, d):
    """Headings with their bodies, item by item, up to the budget."""
    p = table(spark, d, "part")
    piece = F.expr("concat('## ', p_type, '\n', p_name, repeat(' x', p_size))")
    rows = p.select(F.col("p_brand").alias("filing"), F.col("p_partkey").alias("pos"), piece.alias("piece"), F.expr("concat('Item ', p_partkey div 40 % 3)").alias("item"), F.col("p_type").alias("title"))
    return L.joined_packs(rows, "filing", "pos", "item", 300).withColumn("titles", F.array_join("titles", ","))




@query("html_headings")
def html_headings(spark, d):
    """Visual lines of pages that are wholly bold, have a letter and up to 400 characters. Elements that stay open have no SQL; tests hold lines against fixtures."""
    from tallyforge.operators import markup

    found = markup.with_lines(table(spark, d, "pages").select(F.col("page_id").alias("id"), "html"))
    return found.where(F.col("bold") & L.is_heading(F.col("line"))).select("id", "pos", F.col("line").alias("title"))


MARKED = "CASE (doc_id + pos) % 5 WHEN 0 THEN '## ' || line || ' ##' WHEN 1 THEN '**' || line || '**' WHEN 2 THEN '####### ' || line ELSE line END"
TITLE = r"trim(regexp_replace(coalesce(nullif(regexp_extract(line, '^#{1,6}\s+(.+?)\s*#*$', 1), ''), CASE WHEN NOT contains(regexp_extract(line, '^\*\*(.+?)\*\*$', 1), '**') THEN nullif(regexp_extract(line, '^\*\*(.+?)\*\*$', 1), '') END), '[*_`]', '', 'g'))"


def marked(spark, d):
    rows = lines(spark, d)
    return rows.withColumn("line", F.when(F.regexp_like("line", F.lit("^## Item")), F.col("line")).otherwise(F.expr("CASE (doc_id + pos) % 5 WHEN 0 THEN concat('## ', line, ' ##') WHEN 1 THEN concat('**', line, '**') WHEN 2 THEN concat('####### ', line) ELSE line END")))


MARKS = f"{LINES}, mk AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^## Item') THEN line ELSE {MARKED} END AS line FROM ln)"


@query("md_headings", rf"WITH {MARKS}, h AS (SELECT doc_id, pos, {TITLE} AS title FROM mk) SELECT * FROM h WHERE length(title) <= 400 AND regexp_matches(title, '\p{{L}}')")
def md_headings(spark, d):
    return marked(spark, d).select("doc_id", "pos", L.atx_or_bold(F.col("line")).alias("title")).where(L.is_heading(F.col("title")))


def outlined_sql(items: str) -> str:
    """Common tables up to o2, the outline of the given items."""
    return rf"""WITH {MARKS}, m AS (SELECT *, {ITEM} AS item, {TITLE} AS title FROM mk WHERE trim(line) <> ''), f AS (SELECT *, last_value(item IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS now FROM m),
k AS (SELECT *, CASE WHEN item IS NOT NULL THEN trim(regexp_replace(line, '[*_`]', '', 'g')) WHEN length(title) <= 400 AND regexp_matches(title, '\p{{L}}') THEN title END AS head FROM f WHERE now IN ({items})),
t AS (SELECT *, sum((head IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM k),
z AS (SELECT *, coalesce(sum(CASE WHEN head IS NULL THEN length(line) + 1 END) OVER (PARTITION BY doc_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size FROM t),
g AS (SELECT doc_id, part, 'Item ' || min(now) AS section, max(head) AS title, min(pos) AS first, string_agg(line, chr(10) ORDER BY pos) FILTER (head IS NULL AND size < 6000) AS body FROM z GROUP BY doc_id, part),
o AS (SELECT doc_id, section, title, arg_max(body, (length(body), -first)) AS body, min(first) AS first FROM g WHERE body IS NOT NULL GROUP BY doc_id, section, title),
o2 AS (SELECT doc_id, section, title, body, first FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first) <= 120)"""  # fmt: skip


@query("heading_outline", outlined_sql("'1A', '2A'") + " SELECT * FROM o2")
def heading_outline(spark, d):
    """Headings inside two items, with what stands under them."""
    rows = marked(spark, d).where("trim(line) <> ''")
    return L.outline(rows, ("1A", "2A"), L.atx_or_bold(F.col("line")))


@query("heading_dedup", "SELECT lang || '|' || coalesce(source, '') || '|' || string_split(text, chr(10))[1] AS title, max(length(text)) AS n_chars, arg_min(doc_id, (-length(text), doc_id)) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def heading_dedup(spark, d):
    """Of bodies under one section and title, the first line, the longest stays, the first of equals."""
    rows = table(spark, d, "documents").where("text is not null").select(F.concat("lang", F.lit("|"), F.coalesce("source", F.lit("")), F.lit("|"), F.get(F.split("text", "\n"), F.lit(0))).alias("title"), F.length("text").cast("long").alias("n"), "doc_id")
    return rows.groupBy("title").agg(F.max("n").alias("n_chars"), F.min_by("doc_id", F.struct(-F.col("n"), F.col("doc_id"))).alias("doc_id"))


@query("thin_items", rf"""WITH {LINES}, h AS (SELECT doc_id, upper(regexp_extract(line, '(?i)^[#>*_\s]*Item\s+(\d+[A-Z]?)\b', 1)) AS item FROM ln), c AS (SELECT doc_id, item, count(*) AS n FROM h WHERE item <> '' GROUP BY ALL),
t AS (SELECT doc_id, count(*) FILTER (n < 5) AS thin, sum(n) FILTER (n >= 5) AS used FROM c GROUP BY doc_id)
SELECT doc_id, thin, CASE WHEN thin > 0 THEN greatest(6, floor((48 - coalesce(used, 0)) / thin))::BIGINT END AS per_item FROM t""")  # fmt: skip
def thin_items(spark, d):
    """Items with under five headings share what is left of the budget, six at least."""
    c = L.item_lines(lines(spark, d)).groupBy("doc_id", "item").agg(F.count("*").alias("n"))
    t = c.groupBy("doc_id").agg(F.count_if(F.col("n") < 5).alias("thin"), F.sum(F.when(F.col("n") >= 5, F.col("n"))).alias("used"))
    return t.select("doc_id", "thin", F.when(F.col("thin") > 0, F.greatest(F.lit(6).cast("long"), F.floor((48 - F.coalesce("used", F.lit(0))) / F.col("thin")))).alias("per_item"))


@query("thin_outline", outlined_sql("'1A', '2A', '3A'") + """, c2 AS (SELECT d.doc_id, i.item, count(o2.title) AS n FROM documents d CROSS JOIN (SELECT unnest(['Item 1A', 'Item 2A', 'Item 3A']) AS item) i LEFT JOIN o2 ON o2.doc_id = d.doc_id AND o2.section = i.item GROUP BY ALL),
s2 AS (SELECT doc_id, count(*) FILTER (n < 5) AS thin, coalesce(sum(n) FILTER (n >= 5), 0)::BIGINT AS used FROM c2 GROUP BY doc_id)
SELECT doc_id, thin, used, CASE WHEN thin > 0 THEN greatest(6, floor((48 - used) / thin))::BIGINT END AS per_item FROM s2""")
def thin_outline(spark, d):
    """How many of three items have under five headings, none among them, and what of the budget each of these may read."""
    rows = marked(spark, d).where("trim(line) <> ''")
    items = ("1A", "2A", "3A")
    return L.thin_shares(table(spark, d, "documents").select("doc_id"), L.outline(rows, items, L.atx_or_bold(F.col("line"))), items)



WHOLE = "'{\"ids\": [' || (event_id % 7) || ', ' || (event_id % 50) || ']}'"
ANSWER = f"CASE event_id % 6 WHEN 0 THEN 'ok ' || {WHOLE} || ' bye' WHEN 1 THEN {WHOLE} WHEN 2 THEN '{{\"ids\": [' || (event_id % 7) || ', ' || (event_id % 50) WHEN 3 THEN 'none' WHEN 4 THEN 'x {{\"ids\": [{{\"n\": 1}}, ' || (event_id % 50) || ', {{\"n\": 2}} cut' ELSE '}} ' || event_type || ' {{' END"


@query("json_salvage", f"""WITH a AS (SELECT event_id AS id, nullif(regexp_extract({ANSWER}, '(?s)\\{{.*\\}}', 0), '') AS cut FROM events)
SELECT id, CASE WHEN json_valid(cut) THEN json_extract(cut, '$.ids[1]')::INT WHEN json_valid(cut || ']}}') THEN json_extract(cut || ']}}', '$.ids[1]')::INT END AS second FROM a""")  # fmt: skip
def json_salvage(spark, d):
    """Answers of a model, whole, cut short in a number or after an object, or no JSON at all."""
    answer = F.expr(ANSWER.replace("'{{", "'{").replace("}}", "}"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.try_variant_get(T.json_salvage(answer), "$.ids[1]", "int").alias("second"))


IDS = """CASE event_id % 8 WHEN 0 THEN '{"ids": [' || (event_id % 7) || ', "' || (event_id % 7) || '", ' || (event_id % 50) || ']}' WHEN 1 THEN 'Sure: {"ids": ["' || (event_id % 30) || '", -1, 1.5, null, "x", [2]]} done' WHEN 2 THEN '{"ids": [' || (event_id % 9) || ', 3'
WHEN 3 THEN '{"ids": []}' WHEN 4 THEN 'none of them' WHEN 5 THEN '{"ids": {"a": 1}}' WHEN 6 THEN '{"ids": [99, 20, " 19 "]}' ELSE '{"other": [1]}' END"""


@query("json_ids", """WITH a AS (SELECT event_id AS id, (event_id % 3 * 10)::INT AS n, CASE event_id % 8 WHEN 0 THEN [event_id % 7, event_id % 50] WHEN 1 THEN [event_id % 30] WHEN 6 THEN [99, 20, 19] ELSE [] END AS got FROM events),
f AS (SELECT id, n, list_sort(list_distinct(list_filter(got, lambda x: x >= 0 AND x < n))) AS ids FROM a)
SELECT id, array_to_string(CASE WHEN len(ids) > 0 THEN ids ELSE range(0, n) END, ',') AS ids FROM f""")
def json_ids(spark, d):
    """Ids as numbers or strings, in range, each once; an answer that names none, or is none, means all of them."""
    count = (F.col("event_id") % 3 * 10).cast("int")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.array_join(T.triage_ids(F.expr(IDS), count), ",").alias("ids"))


NUMBER_TEXT = "CASE event_id % 12 WHEN 0 THEN '$ ' || event_id || ',000' WHEN 1 THEN (event_id % 90) || '.5 %' WHEN 2 THEN 'null' WHEN 3 THEN 'about ten' WHEN 4 THEN '(' || event_id || ',5)' WHEN 5 THEN '-' || event_id WHEN 6 THEN event_id || '-' WHEN 7 THEN '' WHEN 8 THEN '1e' || (event_id % 5) WHEN 9 THEN '.5' WHEN 10 THEN ' +' || event_id || ' ' ELSE '5 6' END"


@query("json_num", rf"""WITH t AS (SELECT event_id AS id, trim(regexp_replace({NUMBER_TEXT}, '[$,%]', '', 'g')) AS s FROM events),
n AS (SELECT id, CASE WHEN regexp_matches(s, '^\([^()+-]*\)$') THEN '-' || trim(s[2:-2]) WHEN regexp_matches(s, '^[^()+-]*-$') THEN '-' || trim(s[1:-2]) ELSE s END AS s FROM t)
SELECT id, CASE WHEN regexp_matches(s, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN s::DOUBLE END AS value FROM n""")  # fmt: skip
def json_num(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), T.json_num(F.expr(NUMBER_TEXT)).alias("value"))


@query("json_strings", """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN event_type END AS strict, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'NULL' WHEN 3 THEN (event_id % 100)::VARCHAR END AS loose FROM events""")
def json_strings(spark, d):
    """A field as text: the strict form takes strings alone and no "null", the looser one numbers as well."""
    value = F.expr("CASE event_id % 5 WHEN 0 THEN concat('\"', event_type, '\"') WHEN 1 THEN '\"NULL\"' WHEN 2 THEN '\" \"' WHEN 3 THEN cast(event_id % 100 AS string) ELSE '[1]' END")
    answer = F.try_parse_json(F.concat(F.lit('{"f": '), value, F.lit("}")))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), T.json_str(answer, "$.f").alias("strict"), T.json_text(answer, "$.f").alias("loose"))


@query("cite_resolve", "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'HTTP://x/' || event_id WHEN 1 THEN ['a', 'b', 'c'][1 + event_id % 5] WHEN 2 THEN 'b' WHEN 3 THEN ['a', 'b', 'c'][event_id % 5] WHEN 4 THEN 'c' END AS url FROM events")
def cite_resolve(spark, d):
    """An address, [n], a note, n, an address that is none with [n] in the note, or nothing; numbers out of range give null."""
    k, none = F.col("event_id") % 6, F.lit(None).cast("string")
    url = F.when(k == 0, F.concat(F.lit("HTTP://x/"), "event_id")).when(k == 4, "see below")
    index = F.when(k == 1, F.concat(F.lit("["), F.col("event_id") % 5 + 1, F.lit("]"))).when(k == 3, (F.col("event_id") % 5).cast("string")).otherwise(F.lit(""))
    note = F.when(k == 2, "as shown [2] and [1]").when(k == 4, "in [3]").otherwise(F.lit(""))
    cites = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.coalesce(T.cite_resolve(url, index, note, cites), none).alias("url"))


SOURCE_URLS = ["\"HTTPS://x/' || event_id || '\"", "\"[2]\"", "\" 3 \"", "\"null\"", "1", "[\"x\", 3, 1]", "[]", "{\"a\": 1}", "null", "\"see it\"", "99", "\"[0]\""]
CITING = "'{\"source_url\": ' || CASE event_id % 13 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(SOURCE_URLS)) + " ELSE '2' END || CASE WHEN event_id % 2 = 0 THEN ', \"note\": \"as in [1] and [2]\"' WHEN event_id % 3 = 0 THEN ', \"note\": 5' ELSE '' END || CASE WHEN event_id % 17 = 0 THEN '' ELSE '}' END"


@query("cite_fields", """WITH a AS (SELECT event_id AS id, event_id % 13 AS k, event_id % 17 = 0 AS cut FROM events),
f AS (SELECT *, CASE k WHEN 0 THEN 'HTTPS://x/' || id WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 4 THEN 'a' WHEN 5 THEN 'c' WHEN 12 THEN 'b' END AS field FROM a)
SELECT id, CASE WHEN NOT cut THEN coalesce(field, CASE WHEN id % 2 = 0 THEN 'a' END) END AS url FROM f""")
def cite_fields(spark, d):
    """Sources of answers in every shape: addresses, numbers, strings and arrays of them, and markers in notes; answers cut short have none."""
    answer = F.try_parse_json(F.expr(CITING))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), T.cited(answer, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("url"))


SUGGESTIONS = """SELECT user_id, CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS name, 'Item ' || (event_id % 3) AS section, CASE WHEN event_id % 4 = 0 THEN 'CUSTOMER' END AS classification, CASE WHEN event_id % 3 = 1 THEN value END AS value, CASE WHEN event_id % 5 = 0 THEN value / 2 END AS percentage,
CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 < 3 THEN 'c' || event_id END AS related, CASE WHEN event_id % 3 = 0 THEN props ELSE ' ' END AS note, CASE WHEN event_id % 6 = 1 THEN '' WHEN event_id % 2 = 0 THEN 'quote ' || event_id ELSE 'as ' || event_id END AS evidence, event_id AS seq FROM events"""


@query("merge_findings", f"""WITH s AS (SELECT * FROM ({SUGGESTIONS}) WHERE trim(name) <> '')
SELECT user_id, lower(name) AS key, arg_min(name, seq) AS name, arg_min(section, seq) AS section, arg_min(classification, seq) FILTER (classification IS NOT NULL) AS classification, arg_min(value, seq) FILTER (value IS NOT NULL) AS value, arg_min(percentage, seq) FILTER (percentage IS NOT NULL) AS percentage,
arg_min(related, seq) FILTER (trim(related) <> '') AS related, arg_min(note, seq) FILTER (trim(note) <> '') AS note, coalesce(nullif(trim(arg_min(evidence, seq) FILTER (value IS NOT NULL)), ''), arg_min(evidence, seq) FILTER (trim(evidence) <> '')) AS evidence, count(*) AS n FROM s GROUP BY user_id, lower(name)""")  # fmt: skip
def merge_findings(spark, d):
    return L.merged_findings(table(spark, d, "events").selectExpr(*_columns(SUGGESTIONS)), "user_id")


def _columns(sql: str) -> list[str]:
    """The select list of a statement, for selectExpr."""
    body, out, depth = sql.removeprefix("SELECT ").rpartition(" FROM ")[0], [""], 0
    for part in body.replace("\n", " ").split(","):
        out[-1] += ("," if depth else "") + part
        depth += part.count("(") - part.count(")")
        if not depth:
            out.append("")
    return [x.strip() for x in out if x]


@query("context_budget", f"""WITH RECURSIVE {PARAS}, k AS (SELECT doc_id // 10 AS filing, doc_id, doc_id::VARCHAR AS section, chunk, text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS i FROM c),
w AS (SELECT filing, 6000 // count(DISTINCT section) AS share FROM k GROUP BY filing),
s AS (SELECT k.filing, k.doc_id, 0 AS i, 0::BIGINT AS used, false AS taken FROM k GROUP BY 1, 2
UNION ALL SELECT k.filing, k.doc_id, k.i, CASE WHEN used + length(text) <= share THEN used + length(text) ELSE used END, used + length(text) <= share FROM s JOIN k ON k.doc_id = s.doc_id AND k.i = s.i + 1 JOIN w ON w.filing = k.filing)
SELECT k.filing, string_agg('[' || section || ']' || chr(10) || text || chr(10) || chr(10), '' ORDER BY k.doc_id, k.chunk) AS context FROM k JOIN s ON s.doc_id = k.doc_id AND s.i = k.i WHERE taken GROUP BY k.filing""")  # fmt: skip
def context_budget(spark, d):
    """A budget shared evenly by the sections of a filing, for which ten documents stand; a chunk that doesn't fit is skipped."""
    found = L.pack(paragraphs(spark, d), LIMIT).select(F.floor(F.col("doc_id") / 10).alias("filing"), F.col("doc_id").cast("string").alias("section"), F.struct("doc_id", "chunk").alias("at"), "text")
    return L.within_budget(found, "filing", "section", "at", 6000).where("context <> ''")


FOLDED = r"lower(trim(regexp_replace(translate({0}, '" + L.FOLD[0].replace("'", "''") + L.INVISIBLE + "', '" + L.FOLD[1].replace("'", "''") + r"'), '[ \t\n\x{0b}\f\r]+', ' ', 'g')))".replace("{0b}", "{{0b}}")
QUOTE = r"""CASE doc_id % 6 WHEN 0 THEN substr(text, 1 + length(text) // 3, 60) WHEN 1 THEN array_to_string(w[3:12], ' ') || ' ... ' || array_to_string(w[30:40], ' ') WHEN 2 THEN translate(array_to_string(w[5:14], '  '), 'abcdefghijklm', 'ABCDEFGHIJKLM') || ' zzz qqq'
WHEN 3 THEN 'Xyz heading glued on: ' || array_to_string(w[8:16], ' ') WHEN 4 THEN 'nothing of the kind is here at all' ELSE '“' || replace(substr(text, 2, 50), ' ', chr(8203) || chr(160)) || '”' END"""


@query("evidence_match", rf"""WITH d AS (SELECT doc_id, {FOLDED.format('text')} AS t, {FOLDED.format('(' + QUOTE + ')')} AS q FROM (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)),
f AS (SELECT doc_id, t, regexp_replace(q, '^["''.\s]+|["''.\s]+$', '', 'g') AS q FROM d), g AS (SELECT *, string_split(q, ' ') AS w FROM f),
c AS (SELECT doc_id, t, q, list_filter(list_transform(regexp_split_to_array(q, '\s*\.{{3,}}\s*'), lambda x: trim(x)), lambda x: len(string_split(x, ' ')) >= 5 AND x <> q) AS sides,
  list_transform(range(len(w) - 1, 4, -1), lambda n: array_to_string(w[1:n], ' ')) AS runs,
  list_filter(list_transform(string_split(regexp_replace(q, '([.;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(string_split(x, ' ')) >= 5) AS parts FROM g),
h AS (SELECT doc_id, t, q, CASE WHEN contains(t, q) THEN q ELSE coalesce(list_filter(sides, lambda x: contains(t, x))[1], list_filter(runs, lambda x: contains(t, x))[1], list_filter(list_transform(list_sort(list_transform(range(1, len(parts) + 1), lambda i: {{'n': -length(parts[i]), 'i': i}})), lambda p: parts[p.i]), lambda x: contains(t, x))[1]) END AS hit FROM c)
SELECT doc_id, instr(t, hit)::INT AS start, length(hit)::INT AS n, hit = q AS exact FROM h WHERE hit IS NOT NULL AND q <> ''""")  # fmt: skip
def evidence_match(spark, d):
    """Quotes whole, elided, diverging at the end or the start, in other marks, and of nothing that is there."""
    words = F.split("text", " ")
    part = lambda a, b, by=" ": F.array_join(F.slice(words, a, b - a + 1), by)
    k = F.col("doc_id") % 6
    quote = F.when(k == 0, F.expr("substr(text, 1 + length(text) div 3, 60)")).when(k == 1, F.concat(part(3, 12), F.lit(" ... "), part(30, 40))).when(k == 2, F.concat(F.translate(part(5, 14, "  "), "abcdefghijklm", "ABCDEFGHIJKLM"), F.lit(" zzz qqq")))
    quote = quote.when(k == 3, F.concat(F.lit("Xyz heading glued on: "), part(8, 16))).when(k == 4, F.lit("nothing of the kind is here at all")).otherwise(F.concat(F.lit("“"), F.replace(F.substring("text", 2, 50), F.lit(" "), F.lit("​ ")), F.lit("”")))
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.inline(F.array_compact(F.array(L.evidence(F.col("text"), quote)))))  # a filter and three columns would search again each
