"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: what any match must
contain. The index has a row (trigram, row) for each trigram of these queries that a
document's lower-case text holds, where row is a hash of doc_id and text. Intersecting its
postings leaves, for each rule, a few candidates to verify with the regex; a rule whose regex
demands no trigram scans every text. Candidates go to where the texts are, as long as there
are few enough of them, so texts don't move.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


@dataclass(frozen=True)
class Rule:
    """A regex, in the common subset of Java, Python and RE2. ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base kinds. Runs of hex digits under 16 and keys under 18 characters
#: never match: a maximal run is long enough as a whole or nowhere.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
)
BASE = 3

#: Candidates up to which they are broadcast (two longs each); beyond, texts are shuffled by row.
BROADCAST_CANDIDATES = 1_000_000

#: A query: None (no demand), a trigram, or ("and" | "or", queries).
Query = None | str | tuple
#: Most strings that a part of a regex may stand for and still be spelled out.
SPELLED = 24


def both(op: str, parts: list[Query]) -> Query:
    if op == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return parts[0] if len(parts) == 1 else (op, tuple(parts)) if parts else None


def demand(strings: set[str]) -> Query:
    """What a text holds if it holds one of the strings; what demands more than another string is left out."""
    held = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return both("or", [both("and", sorted(h)) for h in sorted(held, key=sorted) if not any(x < h for x in held)])


def derive(items) -> tuple[set[str] | None, Query]:
    """Of a parsed regex: all strings it stands for, if few, else None and a query on trigrams."""
    now: set[str] = {""}
    asked: list[Query] = []
    for op, arg in items:
        exact, query = {""}, None
        if op is sre.LITERAL:
            exact = {chr(arg).lower()}
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
            exact = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            exact, query = derive(arg[3])
        elif op is sre.BRANCH:
            parts = [derive(p) for p in arg[1]]
            exact = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
            query = both("or", [demand(e) if e is not None else q for e, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            exact, query = derive(arg[2])
            exact, query = (exact | {""}, None) if exact is not None else (None, None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            exact, query = derive(arg[2])
            exact, query = None, (demand(exact) if exact is not None else query) if arg[0] else None
        elif op is not sre.AT:
            exact = None
        if exact is not None and len(now) * len(exact) <= SPELLED:
            now = {a + b for a, b in product(now, exact)}
        else:
            asked += [demand(now), query if exact is None else demand(exact)]
            now = {""}
            if exact is not None:
                now = exact
    return (now, None) if not asked else (None, both("and", [*asked, demand(now)]))


def trigram_query(rule: Rule) -> Query:
    exact, query = derive(sre.parse(rule.pattern))
    return demand(exact) if exact is not None else query


def trigrams(query: Query) -> list[str]:
    return [] if query is None else [query] if isinstance(query, str) else [t for q in query[1] for t in trigrams(q)]


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules ask for."""
    return sorted({t for r in rules for t in trigrams(trigram_query(r))})


def row_key(docs: DataFrame) -> Column:
    """A hash of doc_id and text: rows that share an id alone are told apart, equal rows are one."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index: (trigram, row) for each asked trigram in a document's lower-case text."""
    low = docs.select(row_key(docs).alias("row"), F.lower(docs["text"]).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary(rules))))
    return low.select(F.explode(held).alias("trigram"), "row")


def answer(query: Query, place: dict[str, int]) -> Column:
    """The query on an array of bit words, one bit for each trigram of the vocabulary."""
    if isinstance(query, str):
        return F.col("held")[place[query] // 60].bitwiseAND(F.lit(1 << place[query] % 60)) != 0
    parts = [answer(q, place) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, rules): bit i is set if the postings leave the document to rule i. Documents with no rule have no row."""
    words = vocabulary(rules)
    place = {t: i for i, t in enumerate(words)}
    numbered = F.create_map(*(F.lit(x) for t, i in place.items() for x in (t, i)))[F.col("trigram")]
    bit = index.select("row", numbered.alias("i"))
    sums = [F.bit_or(F.when(F.floor(F.col("i") / 60) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") % 60).cast("int"))).otherwise(F.lit(0).cast("long"))) for k in range(len(words) // 60 + 1)]
    held = bit.groupBy("row").agg(F.array(*sums).alias("held"))
    hits = [F.when(answer(q, place), F.lit(1 << i)).otherwise(0) for i, r in enumerate(rules) if (q := trigram_query(r)) is not None]
    return held.select("row", sum(hits[1:], hits[0]).cast("long").alias("rules")).where("rules <> 0")


def lengths(rule: Rule, text: Column) -> Column:
    """Where a regex matches at all: lengths of the matches, of what lies between them, and of the checked group."""
    size = lambda x: F.transform(x, lambda y: F.length(y))
    hits = lambda group: size(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)))
    parts = [hits(0).alias("hits"), size(F.split(text, rule.pattern, -1)).alias("gaps"), hits(rule.group).alias("checked")]
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), F.struct(*parts))


def placed(rule: Rule) -> Column:
    """Spans (start, end) from the column of lengths() that has the rule's name."""
    hits, gaps, checked = (F.col(rule.kind)[x] for x in ("hits", "gaps", "checked"))
    total = lambda x, n: F.aggregate(F.slice(x, F.lit(1), n), F.lit(0), lambda a, b: a + b)
    at = F.filter(F.sequence(F.lit(1), F.size(hits)), lambda i: F.get(checked, i - 1) >= rule.least)
    spans = F.transform(at, lambda i: F.struct((total(gaps, i) + total(hits, i - 1)).alias("start"), F.get(hits, i - 1).alias("n")))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end")))
    return F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_ of each base kind, base_sha256 and spans, one row for each row of ``docs``.

    A null text counts as empty. Rows are told apart by doc_id, which may be null, and text;
    equal rows share their candidates and each has its result. Very long texts are scanned
    whole. Of spans that start together the rules' order decides. Offsets are code points. No
    other column of ``docs`` is read.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    asked = checkpointed(candidates(postings(docs, rules), rules))
    few = asked.count() <= BROADCAST_CANDIDATES
    joined = docs.withColumn("row", row_key(docs)).join(F.broadcast(asked) if few else asked, "row", "left")
    left = F.coalesce(F.col("rules"), F.lit(0))
    asks = [trigram_query(r) is not None for r in rules]
    measured = [F.when(left.bitwiseAND(F.lit(1 << i)) != 0, m) if asks[i] else m for i, r in enumerate(rules) for m in [lengths(r, F.col("text"))]]
    # each step is a projection of its own, so that no regex runs again inside a lambda
    spans = joined.select("doc_id", *(m.alias(r.kind) for m, r in zip(measured, rules))).select("doc_id", *(placed(r).alias(r.kind) for r in rules))

    def tagged(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"], F.lit(i).alias("i"), F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"]).alias("span")))

    def listed(some: list[tuple[int, Rule]]) -> Column:
        return F.array_join(F.transform(F.array_sort(F.concat(*(tagged(i, r.kind) for i, r in some))), lambda s: s["span"]), ",")

    numbered = list(enumerate(rules))
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in rules[:BASE]]
    return spans.select("doc_id", *counts, F.sha2(listed(numbered[:BASE]), 256).alias("base_sha256"), listed(numbered).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for scan()."""
    quoted = lambda r: "'" + r.pattern.replace("'", "''") + "'"
    one = "\nUNION ALL ".join(
        f"SELECT r, {k} AS k, '{rule.kind}' AS kind, regexp_extract_all(text, {quoted(rule)}) AS hits, regexp_extract_all(text, {quoted(rule)}, {rule.group}) AS checked, string_split_regex(text, {quoted(rule)}) AS gaps, {rule.least} AS least FROM d"
        for k, rule in enumerate(rules)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({one}),
e AS (SELECT r, k, kind, hits, gaps, checked, least, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
p AS (SELECT r, k, kind, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a,
  length(hits[i]) AS n FROM e WHERE length(checked[i]) >= least),
s AS (SELECT r, k, a, kind || ':' || a || ':' || (a + n) AS span FROM p),
g AS (SELECT r, {", ".join(f"count(*) FILTER (k = {k}) AS n_{rule.kind}" for k, rule in enumerate(rules[:BASE]))},
  string_agg(span, ',' ORDER BY a, k) FILTER (k < {BASE}) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0)::BIGINT AS n_{rule.kind}" for rule in rules[:BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""
