"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger holds the measurements and one
long whose bit i says that rule i failed. A policy is a version's set of rules, so applying
one, comparing two, or asking what a rule adds is bit arithmetic on the ledger and never
reads a text again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free, map_rows

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Words that count as abuse. A parameter of measure(); these are the default.
FLAGGED = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
#: Measurements in the ledger's order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echoes", "n_upper", "n_lower", "n_bangs", "n_flagged")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` of the measurements is true; it works on numbers and on columns."""

    name: str
    fails: Callable


#: In bit order; new rules go to the end, so that old ledgers keep their meaning.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("echoed_words", lambda m: 100 * m["n_echoes"] > 20 * m["n_words"]),
    Rule("capitals", lambda m: m["n_upper"] > m["n_lower"]),
    Rule("exclamations", lambda m: 10 * m["n_bangs"] > 3 * m["n_words"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("abuse", lambda m: (m["n_flagged"] > 1) & (1000 * m["n_flagged"] > 2 * m["n_words"])),
)
#: Versions of the rule set, by the names of their rules. Base rules hold in every version.
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": (*BASE, "symbols", "repeated_lines", "echoed_words", "capitals", "exclamations", "short_words", "long_words"),
    "v3": tuple(r.name for r in RULES),
}
CURRENT = "v3"


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.name in names)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words that the text has twice or more.

    Windows are compared by a 64-bit hash of their words' numbers.
    """
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.array([number(w, len(known)) for w in words], np.uint64)
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + ids[i : i + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None, flagged: tuple[str, ...] = FLAGGED) -> tuple[int, ...]:
    """The measurements of one text in the order of MEASURES; a null text has no words."""
    text = text or ""
    data = text.encode()
    words = data.split()  # of bytes: cut at \x20 and \x09-\x0D
    seen: set[str] = set()
    n_lines = n_dup_lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n_lines += 1
            n_dup_lines += line in seen
            seen.add(line)
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=128)
    n_flagged, low = 0, data.lower()
    if any(w.encode() in low for w in flagged):
        n_flagged = len(re.findall(rb"\b(?:" + "|".join(flagged).encode() + rb")\b", low))
    return (
        len(words),
        len(text) - int(sum(counts[ord(c)] for c in SPACES)),
        int(sum(counts[ord(c)] for c in SYMBOLS)),
        n_dup_lines,
        repeated_words(words),
        n_lines,
        sum(map(bytes.__eq__, words, words[1:])),
        int(counts[65:91].sum()),
        int(counts[97:123].sum()),
        int(counts[33]),
        n_flagged,
    )


def failed(measures: tuple[int, ...]) -> int:
    """Bits of the rules that fail."""
    m = dict(zip(MEASURES, measures))
    return sum(1 << i for i, r in enumerate(RULES) if r.fails(m))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``: one row for each row of ``docs``, with no shuffle.

    Null and empty texts have no words and fail few_words. Repeated rows are judged each by
    itself. Other columns of ``docs`` are not read.
    """

    def rows(doc_id: list, text: list) -> dict[str, list]:
        made = [measure(t) for t in text]
        return {"doc_id": doc_id, "failed": [failed(m) for m in made]} | {k: list(v) for k, v in zip(MEASURES, zip(*made) if made else [[]] * len(MEASURES))}

    names = ("doc_id", *MEASURES, "failed")
    return map_rows(docs.select(docs["doc_id"].cast("long"), docs["text"]), rows, pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} bigint" for n in names))


def kept(bits: str | Column, policy: str = CURRENT) -> Column:
    """Whether a document stays under a version of the rules."""
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger of ``docs`` with base_failed and kept under a policy, one row for each row."""
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return ledger(docs).select("doc_id", *MEASURES, base.alias("base_failed"), (~base & kept("failed", policy)).alias("kept"), "failed")


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns as they are.

    The ledger's bits are written beside each row, where it is, and the policy is applied to
    them. Null, empty and wordless texts fail few_words and go; very long texts are measured
    whole; repeated rows stay or go together.
    """
    bounded_batches(docs.sparkSession)
    at, name = docs.columns.index("text"), free(docs, "failed_bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([failed(measure(t)) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, bits], schema=batch.schema.append(pa.field(name, pa.int64())))

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.mapInArrow(run, schema).where(kept(name, policy)).drop(name)


def versions(book: DataFrame) -> DataFrame:
    """policy, documents, kept and newly_failed (documents that the policy before, by name, keeps) of every policy."""
    names = sorted(POLICIES)
    before = [0, *(mask(POLICIES[n]) for n in names)]
    some = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), F.lit(mask(POLICIES[n])).cast("long").alias("now"), F.lit(b).cast("long").alias("old")) for n, b in zip(names, before)))).alias("p")
    summed = book.groupBy("failed").agg(F.count("*").alias("n")).select("failed", "n", some).select("failed", "n", "p.*")
    fits = lambda bits: F.col("failed").bitwiseAND(F.col(bits)) == 0
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return summed.groupBy("policy").agg(F.sum("n").alias("documents"), count(fits("now")).alias("kept"), count(fits("old") & ~fits("now")).alias("newly_failed"))


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """What each rule of a policy does: documents it fails, those it alone drops, and what stays without it.

    The ledger is first summed by its bits, which have at most 2 ** len(RULES) values.
    """
    bits, own = mask(POLICIES[policy]), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    rules = F.explode(F.array(*(F.struct(F.lit(i).alias("bit"), F.lit(r.name).alias("rule")) for i, r in enumerate(RULES) if r.name in POLICIES[policy]))).alias("r")
    summed = book.groupBy("failed").agg(F.count("*").alias("n")).select(F.col("failed").bitwiseAND(F.lit(bits)).alias("hit"), "n", rules).select("hit", "n", "r.*")
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return summed.groupBy("bit", "rule").agg(
        F.sum("n").alias("documents"),
        count(F.col("hit") == 0).alias("kept"),
        count(F.col("hit").bitwiseAND(own) != 0).alias("fails"),
        count(F.col("hit") == own).alias("fails_alone"),
        count(F.col("hit").bitwiseAND(F.bitwise_not(own)) == 0).alias("kept_without"),
    )


def oracle(policy: str = CURRENT) -> str:
    """DuckDB SQL for verdicts()."""
    bits = " | ".join(f"((CASE WHEN {t} THEN 1 ELSE 0 END)::BIGINT << {i})" for i, t in enumerate((
        "n_words < 20", "100 * n_repeat_words > 30 * n_words", "10 * n_symbols > 3 * n_words", "100 * n_dup_lines > 50 * n_lines",
        "100 * n_echoes > 20 * n_words", "n_upper > n_lower", "10 * n_bangs > 3 * n_words", "word_chars < 2 * n_words",
        "word_chars > 20 * n_words", "n_flagged > 1 AND 1000 * n_flagged > 2 * n_words")))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, unnest(lines) AS line FROM d),
dup AS (SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines FROM (
  SELECT r, line, count(*) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
win AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
echo AS (SELECT r, len(list_filter(list_zip(w, w[2:]), lambda x: x[1] = x[2])) AS n_echoes FROM d),
m AS (
  SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, n_repeat_words, n_lines, n_echoes,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, len(regexp_extract_all(text, '(?i)\b({"|".join(FLAGGED)})\b')) AS n_flagged
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN echo USING (r)),
z AS (SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_echoes, 0)::BIGINT AS n_echoes, n_upper::BIGINT AS n_upper, n_lower::BIGINT AS n_lower, n_bangs::BIGINT AS n_bangs, n_flagged::BIGINT AS n_flagged FROM m),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM z)
SELECT doc_id, {", ".join(MEASURES)}, (failed & {mask(BASE)}) <> 0 AS base_failed,
  (failed & {mask(POLICIES[policy]) | mask(BASE)}) = 0 AS kept, failed FROM f"""


def versions_oracle() -> str:
    """DuckDB SQL for versions() of the documents' ledger."""
    names = sorted(POLICIES)
    rows = ", ".join(f"('{n}', {mask(POLICIES[n])}, {b})" for n, b in zip(names, [0, *(mask(POLICIES[x]) for x in names)]))
    return f"""
WITH book AS ({oracle()}), p(policy, now, old) AS (VALUES {rows})
SELECT policy, count(*)::BIGINT AS documents, count(*) FILTER ((failed & now) = 0)::BIGINT AS kept,
  count(*) FILTER ((failed & old) = 0 AND (failed & now) <> 0)::BIGINT AS newly_failed FROM book, p GROUP BY policy"""


def ablation_oracle(policy: str = CURRENT) -> str:
    """DuckDB SQL for ablation() of the documents' ledger."""
    rows = ", ".join(f"({i}, '{r.name}')" for i, r in enumerate(RULES) if r.name in POLICIES[policy])
    hit, own = f"(failed & {mask(POLICIES[policy])})", "(1::BIGINT << bit)"
    return f"""
WITH book AS ({oracle(policy)}), r(bit, rule) AS (VALUES {rows})
SELECT bit::INTEGER AS bit, rule, count(*)::BIGINT AS documents, count(*) FILTER ({hit} = 0)::BIGINT AS kept, count(*) FILTER (({hit} & {own}) <> 0)::BIGINT AS fails,
  count(*) FILTER ({hit} = {own})::BIGINT AS fails_alone, count(*) FILTER (({hit} & ~{own}) = 0)::BIGINT AS kept_without FROM book, r GROUP BY bit, rule"""
