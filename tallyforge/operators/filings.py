"""Deterministic text work on filings: routing, boundaries, sections, packing, ranking, findings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.checkpoints import checkpointed

# Words that make a chunk relevant to a question, matched in any case.
KEYWORDS = {
    "REVENUE": ("Revenue", "Net Sales", "Segment", "Geographic", "Product", "Customer", "Disaggregat", "Performance Obligation", "Concentration", "Equity Method"),
    "COST": ("Cost", "Expense", "Operating Income", "Segment", "Geographic", "Supply", "Purchase Obligation"),
    "RISK": ("Concentration", "Depend", "Single Source", "Sole Source", "Litigation", "Regulat", "Interest Rate", "Foreign Currency", "Exchange Rate", "Cyber", "Supply", "Tariff"),
}
# How a line heads an item, by number or by the whole title that stands for one.
HEADING = r"(?i)^[#>*_\s]*Item\s+(\d+(?:\.\d+)?[A-Z]?)\b"
TITLES = {
    "1A": r"Risk\s+Factors",
    "7A": r"Quantitative\s+and\s+Qualitative\s+Disclosures?\s+About\s+Market\s+Risk",
    "7": r"Management'?.?s\s+Discussion\s+and\s+Analysis(?:\s+of\s+Financial\s+Condition.*)?",
    "8": r"Financial\s+Statements\s+and\s+Supplementary\s+Data",
}


#: A table's lead-in, a heading, the text under one, headings of a document, words of an anchor.
CAPTION, LONGEST_HEADING, BODY, MOST_HEADINGS, ANCHOR = 500, 400, 6000, 120, 5
BLANK = " \t\n\x0b\f\r\xa0"
# Characters that evidence is compared through, and those that it's compared without.
FOLD = ("   ‘’‚′“”„″‐‑‒–—−…", " " * 3 + "'" * 4 + '"' * 4 + "-" * 6 + ".")
INVISIBLE = "​"


def item_routes(node: Column, form: Column) -> Column:
    """Items of a form that a question reads, comma-joined; 8-K and its variants are current reports."""
    current = F.coalesce(F.trim(form).ilike("8-K%"), F.lit(False))
    return F.when(node == "RISK", "1A,7A").when(node == "COST", "1,7,8").when(node == "REVENUE", F.when(current, "1.01,2.02,8.01").otherwise("1,1A,7,8"))


def looks_html(text: Column) -> Column:
    return F.regexp_like(F.substring(text, 1, 2000), F.lit(r"(?i)<html|<body|<div|<p|<table"))


def is_numeric_cell(cell: Column) -> Column:
    return F.length(cell).between(1, 39) & F.regexp_like(cell, F.lit("[0-9]")) & F.regexp_like(cell, F.lit(r"^[$()\-\s0-9,.%]+$"))


def item_of(line: Column) -> Column:
    """The item that a line heads, in upper case, else null."""
    found = F.nullif(F.upper(F.regexp_extract(line, HEADING, 1)), F.lit(""))
    for item, title in TITLES.items():
        found = F.coalesce(found, F.when(F.regexp_like(line, F.lit(rf"(?i)^[#>*_\s]*{title}[.:\s]*$")), item))
    return found


def item_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, line) that head an item, with the item."""
    return lines.withColumn("item", item_of(F.col("line"))).where("item is not null")


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, item, first, body): of an item's bodies, from after a heading to the next different item, the longest, first of equals.

    A repeated heading of the same item starts no new body but is part of the one it stands
    in; the body from the first of them is the longest. Bodies without a text have no row.
    """
    by = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.withColumn("item", item_of(F.col("line")))
    filled = marked.withColumn("now", F.last("item", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("now").over(by)
    turn = F.col("now").isNotNull() & (before.isNull() | (before != F.col("now")))
    numbered = filled.withColumn("turn", turn.cast("int")).withColumn("part", F.sum("turn").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("now is not null")
    rest = F.when(F.col("turn") == 1, F.regexp_extract("line", HEADING + "(.*)$", 2)).otherwise(F.col("line"))
    rows = numbered.groupBy("doc_id", F.col("now").alias("item"), "part").agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", rest.alias("line")))).alias("rows"))
    bodies = rows.select("doc_id", "item", "first", F.btrim(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit(BLANK)).alias("body")).where("body <> ''")
    best = F.struct(F.length("body").alias("n"), (-F.col("first")).alias("first"))
    return bodies.groupBy("doc_id", "item").agg(F.max_by("first", best).alias("first"), F.max_by("body", best).alias("body"))


#: How a chunk starts: with its paragraphs as they are, with the one before as a caption, or as one that is clipped.
PLAIN, WITH_CAPTION, CLIPPED = 1, 2, 3


def pack(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """Greedy chunks of each document's paragraphs, which blank lines part: (doc_id, chunk, text).

    A paragraph starts a chunk if what is there and itself exceed the limit, separators not
    counted. One longer than the limit stands alone, clipped unless it is a table. A table
    that starts a chunk takes the short paragraph before it along as its caption. The running
    state resets, which no window frame expresses, so it folds over each document's own
    paragraphs: over their lengths, to where chunks start and how; texts are cut once, at the end.
    """
    kind = "struct<starts:array<bigint>,open:int,last:int>"
    state = lambda starts, open_, last: F.struct(starts.alias("starts"), open_.alias("open"), last.alias("last")).cast(kind)

    def step(s: Column, p: Column) -> Column:
        captioned = p["table"] & s["last"].between(1, CAPTION)
        begun = lambda how: F.array_append(s["starts"], (p["i"] * 8 + how).cast("bigint"))
        how = F.when(p["n"] > limit, F.when(captioned, WITH_CAPTION).when(p["table"], PLAIN).otherwise(CLIPPED)).otherwise(F.when(captioned & (s["open"] > 0), WITH_CAPTION).otherwise(PLAIN))
        starts_one = (p["n"] > limit) | (s["open"] == 0) | (s["open"] + p["n"] > limit)
        size = F.when(p["n"] > limit, 0).when(~starts_one, s["open"] + 2 + p["n"]).when(captioned & (s["open"] > 0), s["last"] + 2 + p["n"]).otherwise(p["n"])
        return state(F.when(starts_one, begun(how)).otherwise(s["starts"]), size, p["n"])

    paras = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    sizes = F.transform("paras", lambda x, i: F.struct(i.alias("i"), F.length(x).alias("n"), F.startswith(F.lower(F.substring(x, 1, 6)), F.lit("<table")).alias("table")))
    cut = docs.select("doc_id", paras.alias("paras"))
    folded = cut.select("doc_id", "paras", F.aggregate(sizes, state(F.array().cast("array<bigint>"), F.lit(0), F.lit(0)), step)["starts"].alias("starts"))

    def chunk(start: Column, k: Column) -> Column:
        first, how = F.shiftright(start, 3).cast("int"), start.bitwiseAND(F.lit(7))
        end = F.coalesce(F.shiftright(F.get("starts", k + 1), 3).cast("int"), F.size("paras"))
        body = F.array_join(F.slice("paras", first + 1, end - first), "\n\n")
        return F.when(how == WITH_CAPTION, F.concat(F.get("paras", first - 1), F.lit("\n\n"), body)).when(how == CLIPPED, F.substring(body, 1, limit)).otherwise(body)

    return folded.select("doc_id", F.posexplode(F.transform("starts", chunk)).alias("chunk", "text"))


def next_starts(n: np.ndarray, turns: np.ndarray, limit: int) -> np.ndarray:
    """For each piece the one that would start the next chunk if it started one itself; len(n) if none does.

    ``n`` has lengths, ``turns`` says where the group changes. A piece after p of m characters
    in all, separators among them, is one too many beyond the limit. Empty pieces that start a
    chunk leave it as it was, so it is the chunk of the first one that isn't empty.
    """
    size = len(n)
    ends = np.r_[0, np.cumsum(n + 2)]
    full = np.searchsorted(ends, limit + 4 + ends[:-1], side="right") - 1
    at = np.arange(size)
    turn = np.minimum.accumulate(np.r_[np.where(turns, at, size), size][::-1])[::-1][1:]
    found = np.minimum(np.maximum(full, at + 1), turn)
    filled = np.minimum.accumulate(np.where(n > 0, at, size)[::-1])[::-1]
    return np.r_[found, size][filled]


def stretch(table: pa.Table, limit: int, block: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(places of its pieces, next starts among them, how many are its own, the first one's place) of a block with the head of the next one."""
    table = table.sort_by("seq")
    seq = table.column("seq").to_numpy()
    first = int(table.column("block")[0].as_py()) * block
    own = int(np.searchsorted(seq, first + block))
    turns = table.column("turn").to_numpy(zero_copy_only=False)
    found = next_starts(table.column("n").to_numpy(), turns, limit)
    if len(seq) == own + ahead(limit) and own == block and (found[:own] == len(seq)).any():
        raise ValueError(f"over {ahead(limit)} pieces on end are no more than {limit} characters: too many empty ones")
    return seq, found, own, first


def ahead(limit: int) -> int:
    """Pieces of a chunk at most, and one: each has a separator of two characters at least."""
    return limit // 2 + 3


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``seq``, their number from 0 in order within ``by``: numbered in ranges, whose sizes are added up, so that no task gathers all of one ``by``."""
    part = checkpointed(rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), (F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = part.withColumn("_own", F.row_number().over(Window.partitionBy("_part", by).orderBy(*order)) - 1)
    return own.join(before, own[by].eqNullSafe(before["_by"]) & (own["_part"] == before["_p"])).withColumn("seq", F.col("_own") + F.col("_before")).drop("_by", "_p", "_part", "_own", "_before", "_n")


def joined_packs(rows: DataFrame, by: str, order: str, group: str, limit: int, block: int = 4096) -> DataFrame:
    """Pieces (by, order, group, title, piece) packed in order: (by, chunk, group, text, titles).

    A new chunk starts where the group changes or the budget is passed; a piece over the
    budget goes whole. Titles are those that a chunk bundles, each once. Ties of order are
    told apart by group, title and piece. A null piece is an empty one.

    Where a chunk ends depends on its first piece alone. So each block of a filing's pieces says,
    for every piece that may start its first chunk, which piece starts the first chunk of the
    next block and how many chunks start between; one row a block is followed from the first on,
    and blocks then number their chunks. A task holds one block, and one row for each of a filing.
    """
    block, near, kind = max(block, ahead(limit)), ahead(limit), rows.schema[by].dataType.simpleString()
    keys = [order, group, "title", "piece"]
    placed = checkpointed(numbered(rows.select(by, order, group, "title", F.coalesce("piece", F.lit("")).alias("piece")), by, keys).withColumn("block", F.floor(F.col("seq") / block)))
    # the group before a block's first piece is that of the block before: heads carry it along
    heads = placed.where(F.col("seq") % block < near).withColumn("block", F.col("block") - 1).where("block >= 0")
    both = placed.select(by, "block", "seq", F.length("piece").alias("n"), group).unionByName(heads.select(by, "block", "seq", F.length("piece").alias("n"), group))
    earlier = F.lag(group).over(Window.partitionBy(by, "block").orderBy("seq"))
    pieces = checkpointed(both.withColumn("turn", F.coalesce(F.col(group) != earlier, F.lit(False))).select(F.col(by).alias("by"), "block", "seq", "n", "turn"))

    def leads(table: pa.Table) -> pa.Table:
        seq, found, own, first = stretch(table, limit, block)
        exits, chunks = found.astype(np.int64), np.ones(len(found), np.int64)
        for k in range(own - 1, -1, -1):
            if (x := found[k]) < own:
                exits[k], chunks[k] = exits[x], chunks[x] + 1
        some = min(own, near)
        return pa.table({"by": table.column("by")[:1], "block": table.column("block")[:1], "exits": pa.array([(exits[:some] + first).tolist()], pa.list_(pa.int64())), "chunks": pa.array([chunks[:some].tolist()], pa.list_(pa.int64()))})

    def follow(table: pa.Table) -> pa.Table:
        table, entries, counts, at, n = table.sort_by("block"), [], [], 0, 0
        numbers = table.column("block").to_pylist()
        for k, number in enumerate(numbers):
            entries.append(at)
            counts.append(n)
            if (k_at := at - number * block) < len(exits := table.column("exits")[k]):
                at, n = exits[k_at].as_py(), n + table.column("chunks")[k][k_at].as_py()
        return pa.table({"by": table.column("by"), "block": table.column("block"), "entry": pa.array(entries, pa.int64()), "before": pa.array(counts, pa.int64())})

    def number(table: pa.Table) -> pa.Table:
        seq, found, own, first = stretch(table, limit, block)
        starts, at = np.zeros(own, np.int64), int(table.column("entry")[0].as_py()) - first
        while at < own:
            starts[at] = 1
            at = int(found[at])
        chunk = np.cumsum(starts) + table.column("before")[0].as_py() - 1
        return pa.table({"by": pa.chunked_array([table.column("by").combine_chunks().take(pa.array(np.zeros(own, np.int64)))]), "seq": pa.array(seq[:own], pa.int64()), "chunk": pa.array(chunk, pa.int32())})

    led = pieces.groupBy("by", "block").applyInArrow(leads, f"by {kind}, block bigint, exits array<bigint>, chunks array<bigint>")
    ways = led.groupBy("by").applyInArrow(follow, f"by {kind}, block bigint, entry bigint, before bigint").withColumnsRenamed({"by": "_by", "block": "_block"})
    entered = pieces.join(ways, pieces["by"].eqNullSafe(ways["_by"]) & (pieces["block"] == ways["_block"])).drop("_by", "_block")
    chunks = entered.groupBy("by", "block").applyInArrow(number, f"by {kind}, seq bigint, chunk int").withColumnsRenamed({"by": "_by", "seq": "_seq"})
    found = placed.join(chunks, placed[by].eqNullSafe(chunks["_by"]) & (placed["seq"] == chunks["_seq"]))
    one = F.sort_array(F.collect_list(F.struct("seq", F.col(group).alias("item"), "title", "piece"))).alias("own")  # of one chunk
    gathered = found.groupBy(by, "chunk").agg(one)
    # empty pieces before the first text have no separator
    text = F.aggregate("own", F.lit(""), lambda t, p: F.concat(t, F.when(t != "", F.lit("\n\n")).otherwise(F.lit("")), p["piece"]))
    titles = F.array_distinct(F.col("own.title"))
    return gathered.select(by, "chunk", F.element_at("own", -1)["item"].alias(group), text.alias("text"), titles.alias("titles")).where("text <> ''")


def fair_share(chunks: DataFrame, filing: str, section: str, order: str, per: int, overall: int) -> DataFrame:
    """Chunks of a filing in order: ``per`` of each section, and no more once there are ``overall``.

    The end is looked for after a chunk that isn't its section's last allowed one, so a
    section that fills up just there lets one more through.
    """
    numbered = chunks.withColumn("n", F.row_number().over(Window.partitionBy(filing, section).orderBy(order))).where(F.col("n") <= per)
    by = Window.partitionBy(filing).orderBy(section, order)
    placed = numbered.withColumn("place", F.row_number().over(by)).withColumn("before", F.lag("n").over(by))
    return placed.where((F.col("place") <= overall) | (F.col("place") == overall + 1) & (F.col("before") == per)).drop("n", "place", "before")


def atx_or_bold(line: Column) -> Column:
    """The title of a line that is a heading in markdown, an ATX line or one wholly in bold, without inline marks; else null."""
    atx = F.nullif(F.regexp_extract(line, r"^#{1,6}\s+(.+?)\s*#*$", 1), F.lit(""))
    bold = F.nullif(F.regexp_extract(line, r"^\*\*(.+?)\*\*$", 1), F.lit(""))
    found = F.coalesce(atx, F.when(~F.contains(bold, F.lit("**")), bold))
    return F.trim(F.regexp_replace(found, "[*_`]", ""))


def is_heading(title: Column) -> Column:
    return F.coalesce((F.length(title) <= LONGEST_HEADING) & F.regexp_like(title, F.lit(r"\p{L}")), F.lit(False))


def outline(lines: DataFrame, items: tuple[str, ...], title: Column) -> DataFrame:
    """(doc_id, section, title, body, first) of the headings inside the items; ``title`` is a line's, null if it is none.

    A heading's body is the lines up to the next heading or item, until it has BODY
    characters; the item's own line is a heading for what comes before the first one. Of one
    title in one section the longest body stays, first of equals, and of a document the first
    MOST_HEADINGS. Headings without a body have no row.
    """
    by = Window.partitionBy("doc_id").orderBy("pos")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("item", item_of(F.col("line"))).withColumn("now", F.last("item", ignorenulls=True).over(so_far)).where(F.col("now").isin(*items))
    head = F.when(F.col("item").isNotNull(), F.trim(F.regexp_replace("line", "[*_`]", ""))).when(is_heading(title), title)
    turned = marked.withColumn("head", head).withColumn("part", F.sum(F.col("head").isNotNull().cast("int")).over(so_far))
    inside = Window.partitionBy("doc_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum(F.when(F.col("head").isNull(), F.length("line") + 1)).over(inside), F.lit(0))
    kept = turned.withColumn("size", size).where((F.col("size") < BODY) | F.col("head").isNotNull())
    text = F.sort_array(F.collect_list(F.when(F.col("head").isNull(), F.struct("pos", "line"))))
    rows = kept.groupBy("doc_id", "part").agg(F.concat(F.lit("Item "), F.min("now")).alias("section"), F.max("head").alias("title"), F.min("pos").alias("first"), text.alias("rows"))
    rows = rows.where(F.size("rows") > 0).select("doc_id", "section", "title", "first", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"))
    best = F.struct(F.length("body").alias("n"), (-F.col("first")).alias("first"))
    once = rows.groupBy("doc_id", "section", "title").agg(F.max_by("body", best).alias("body"), F.min("first").alias("first"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))).where(F.col("n") <= MOST_HEADINGS).drop("n")


def thin_shares(docs: DataFrame, outlined: DataFrame, items: tuple[str, ...], least: int = 5, budget: int = 48, floor: int = 6) -> DataFrame:
    """(doc_id, thin, used, per_item): of the wanted items those with under ``least`` headings in the outline, what the others use, and each thin one's share of the rest."""
    counts = outlined.groupBy("doc_id", "section").agg(F.count("*").alias("n"))
    asked = docs.select("doc_id", F.explode(F.array(*(F.lit(f"Item {i}") for i in items))).alias("section"))
    n = F.coalesce("n", F.lit(0))
    t = asked.join(counts, ["doc_id", "section"], "left").groupBy("doc_id").agg(F.count_if(n < least).alias("thin"), F.sum(F.when(n >= least, n).otherwise(0)).alias("used"))
    share = F.greatest(F.lit(floor).cast("long"), F.floor((budget - F.col("used")) / F.col("thin")))
    return t.select("doc_id", "thin", "used", F.when(F.col("thin") > 0, share).alias("per_item"))


def income_statement(name: Column) -> Column:
    """Operations, Income or Earnings, after "Comprehensive Income" is taken out; in any case."""
    return F.regexp_like(F.regexp_replace(name, "(?i)Comprehensive Income", ""), F.lit("(?i)Operations|Income|Earnings"))


def wanted_report(name: Column, category: Column, node: Column) -> Column:
    """Whether a rendered report is read for a question: the income statement, and details that name a keyword."""
    off = (node == "RISK") | F.regexp_like(name, F.lit("(?i)Parenthetical|Additional Information"))
    topic = lambda n: F.regexp_like(name, F.lit("(?i)" + "|".join(KEYWORDS[n])))
    details = F.when(node == "COST", topic("COST")).otherwise(topic("REVENUE"))
    return F.when(off, False).when(category == "Statements", income_statement(name)).when(category == "Details", details).otherwise(False)


def score(text: Column, node: str) -> Column:
    """Five for a table cell, one for each keyword."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(k.lower())).cast("int") for k in KEYWORDS[node]), F.when(F.contains(text, F.lit("<td")), 5).otherwise(0))


def capped(chunks: DataFrame, by: str, order: list[Column], per: int) -> DataFrame:
    """The best chunks of each group, in document order again by their own position."""
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= per).drop("_n")


def build_section(chunks: DataFrame, by: str, order: str, node: str, take: int) -> DataFrame:
    """A section's chunks as a node's workers get them: the ``take`` most relevant, ties to the earlier one, numbered by ``place`` in document order.

    A section of no more chunks keeps all. Ranks and places are each of one section alone.
    """
    best = capped(chunks.withColumn("score", score(F.col("text"), node)), by, [F.desc("score"), F.col(order)], take)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def within_budget(chunks: DataFrame, doc: str, section: str, order: str, budget: int) -> DataFrame:
    """(doc, context): chunks in order that fit their section's even share of the budget; one that doesn't is skipped and the next are tried."""
    kind = "struct<used:map<string,int>,text:string>"
    start = F.struct(F.create_map().cast("map<string,int>").alias("used"), F.lit("").alias("text")).cast(kind)
    rows = chunks.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("order"), F.col(section).alias("section"), "text"))).alias("rows"))
    rows = rows.withColumn("share", F.floor(F.lit(budget) / F.size(F.array_distinct(F.transform("rows", lambda r: r["section"])))))

    def step(s: Column, r: Column) -> Column:
        used = F.coalesce(F.try_element_at(s["used"], r["section"]), F.lit(0)) + F.length(r["text"])
        others = F.map_filter(s["used"], lambda k, _: k != r["section"])
        taken = F.struct(F.map_concat(others, F.create_map(r["section"], used)).alias("used"), F.concat(s["text"], F.lit("["), r["section"], F.lit("]\n"), r["text"], F.lit("\n\n")).alias("text")).cast(kind)
        return F.when(used <= F.col("share"), taken).otherwise(s)

    return rows.select(doc, F.aggregate("rows", start, step)["text"].alias("context"))


def merged_findings(rows: DataFrame, by: str) -> DataFrame:
    """Findings of one name, in any case, in order of ``seq``: partial views of one source put together.

    Name and section are the first's. Classification, value and percentage are the first that
    aren't null, related company and note the first that aren't blank. Evidence is that of
    the record which gave the value, else the first that isn't blank. Blank names are skipped.
    """
    said = lambda c: F.when(F.trim(c) != "", F.col(c))

    def first(name: str, value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(name)

    groups = rows.where(F.trim("name") != "").groupBy(by, F.lower("name").alias("key"))
    found = groups.agg(
        F.min_by("name", "seq").alias("name"),
        F.min_by("section", "seq").alias("section"),
        *(first(c, F.col(c)) for c in ("classification", "value", "percentage")),
        *(first(c, said(c)) for c in ("related", "note", "evidence")),
        F.min_by(said("evidence"), F.when(F.col("value").isNotNull(), F.col("seq"))).alias("of_value"),
        F.count("*").alias("n"),
    )
    return found.withColumn("evidence", F.coalesce("of_value", "evidence")).drop("of_value")


def folded(text: Column) -> Column:
    """For evidence search: typographic marks as ASCII, no zero-width ones, white space as one space, lower case."""
    marks = F.translate(text, FOLD[0] + INVISIBLE, FOLD[1])
    return F.lower(F.btrim(F.regexp_replace(marks, r"[ \t\n\x0B\f\r]+", " ")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often ``body`` names it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def evidence(text: Column, quote: Column) -> Column:
    """Where a quote stands in a text, both folded: struct(start from 1, n characters, exact), or null.

    As a whole; else one side of an elision, else its longest leading run of words, else its
    longest sentence, each of ANCHOR words or more. Text and quote are folded once.
    """

    def searched(v: Column) -> Column:
        t, full, words = v["t"], v["full"], v["words"]
        at = lambda x: F.call_function("instr", t, x)
        long = lambda x: F.size(F.split(x, " ")) >= ANCHOR
        sides = F.filter(F.transform(F.split(full, r"\s*\.{3,}\s*"), lambda x: F.trim(x)), lambda x: long(x) & (x != full))
        run = lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")
        lengths = F.when(F.size(words) > ANCHOR, F.sequence(F.size(words) - 1, F.lit(ANCHOR), F.lit(-1)))
        runs = let(F.get(F.filter(lengths, lambda k: at(run(k)) > 0), F.lit(0)), lambda n: F.when(n.isNotNull(), run(n)))
        parts = F.filter(F.transform(F.split(full, r"(?<=[.;:])\s+"), lambda x: F.trim(x)), long)
        ordered = lambda p: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.struct((-F.length(F.get(p, i))).alias("n"), i.alias("i"))))
        first = lambda some: F.get(F.filter(some, lambda x: at(x) > 0), F.lit(0))
        sentences = let(parts, lambda p: F.when(F.size(p) > 0, first(F.transform(ordered(p), lambda x: F.get(p, x["i"])))))
        hit = lambda x, exact: F.struct(at(x).alias("start"), F.length(x).alias("n"), F.lit(exact).alias("exact"))
        loose = let(F.coalesce(first(sides), runs, sentences), lambda x: F.when(x.isNotNull(), hit(x, False)))
        return F.when(full == "", None).when(at(full) > 0, hit(full, True)).otherwise(loose)

    both = F.struct(folded(text).alias("t"), F.regexp_replace(folded(quote), r"^[\"'.\s]+|[\"'.\s]+$", "").alias("full"))
    return let(both, lambda b: let(F.struct(b["t"].alias("t"), b["full"].alias("full"), F.split(b["full"], " ").alias("words")), searched))
