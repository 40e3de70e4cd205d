"""URL filters through a Bloom filter cascade.

Level 0 encodes the listed keys; level 1 those other keys of the corpus that level 0 lets
through; level 2 the listed keys that level 1 lets through; and so on until none is left.
Over the keys it was built from, the complete key universe of the corpus, the cascade
answers exactly, and a page is judged by a few bit tests without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

#: Rules (verdict, rule); a rule is a host and the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words that put a host on named()'s list if one of its labels holds them between its ends and hyphens.
TERMS = ("casino", "bets", "pills", "adult", "spam", "ads", "porn", "viagra", "warez")
#: False positives of a level, and the most bytes of all levels; a larger cascade isn't shipped to tasks.
RATE, MOST_BYTES = 0.02, 64 << 20


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty without one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (of equal ones the first in order), as struct(rule, verdict), or null."""
    tests = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        tests = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(tests)
    return tests


def named(pages: DataFrame, terms=TERMS) -> DataFrame:
    """(key): a list of hosts made of a corpus, for want of one from outside: those of which a label has one of the terms."""
    hosts = pages.select(host(pages["url"]).alias("key")).distinct()
    return hosts.where(F.regexp_like("key", F.lit(rf"(^|[.-])({'|'.join(terms)})([.-]|$)")))


@dataclass
class Level:
    """One Bloom filter: its bits, number of bits and number of hashes."""

    words: np.ndarray
    bits: int
    hashes: int

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for i in range(self.hashes):
            at = (a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(self.bits)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


def hashes(key: str, level: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * level), F.col(key)), F.xxhash64(F.lit(2 * level + 1), F.col(key))


def build_level(keys: DataFrame, n: int, level: int) -> Level:
    """The filter of ``n`` keys. Bits are set in Spark, by words of 64; only the words come to the driver."""
    count = max(1, round(-np.log2(RATE)))
    bits = max(64, int(np.ceil(1.4427 * n * -np.log2(RATE) / 64)) * 64)
    a, b = hashes("key", level)

    def run(batches):
        for batch in batches:
            x, y = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
            at = np.concatenate([(x + np.uint64(i) * (y | np.uint64(1))) % np.uint64(bits) for i in range(count)])
            yield pa.RecordBatch.from_pydict({"word": (at >> np.uint64(6)).astype(np.int64), "mask": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    rows = keys.select(a.alias("a"), b.alias("b")).mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Level(words, bits, count)


def passing(keys: DataFrame, level: Level, depth: int) -> DataFrame:
    a, b = hashes("key", depth)

    def run(batches):
        for batch in batches:
            keep = level.holds(*(batch.column(i).to_numpy().view(np.uint64) for i in (1, 2)))
            yield batch.select(["key"]).filter(pa.array(keep))

    return keys.select("key", a, b).mapInArrow(run, "key string")


def cascade(universe: DataFrame, most_bytes: int = MOST_BYTES) -> list[Level] | None:
    """Levels for the rows (key, is_listed) of ``universe``, each key once; None if they'd exceed ``most_bytes``.

    Ends when a level lets no key of the other side through, so it is exact on the universe.
    """
    inside, outside = universe.where("is_listed").select("key"), universe.where("not is_listed").select("key")
    levels: list[Level] = []
    n = inside.count()
    while n:
        if sum(8 * len(x.words) for x in levels) + n * 1.4427 * -np.log2(RATE) / 8 > most_bytes:
            return None
        levels.append(build_level(inside, n, len(levels)))
        inside, outside = checkpointed(passing(outside, levels[-1], len(levels) - 1)), inside
        n = inside.count()
    return levels


def member(levels: list[Level], hashed: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whether keys are listed: the number of levels that let a key through in a row is odd."""
    n = len(hashed[0][0]) if hashed else 0
    through, depth = np.ones(n, bool), np.zeros(n, np.int64)
    for level, (a, b) in zip(levels, hashed):
        through = through & level.holds(a, b)
        depth += through
    return depth % 2 == 1


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict, one row for each row of ``pages``.

    The longest fitting rule decides; without one, a host that is a key of the table
    ``listed`` is blocked. Keys are hosts in lower case; null ones, repeats and keys that no
    page has make no difference. Null urls and urls without :// have an empty host and path
    and fit no rule. Of equally long rules the first in order decides. Repeated rows are each
    judged, very long urls are read whole. The key universe is every host of ``pages``. If
    the cascade would pass its size bound, a plain join with the listed hosts takes its
    place. No column but page_id, url and key is read.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host(pages["url"]).alias("host"), path(pages["url"]).alias("path"))
    keys = listed.select(listed["key"].alias("key")).where("key is not null").distinct().withColumn("is_listed", F.lit(True))
    universe = rows.select(F.col("host").alias("key")).distinct().join(keys, "key", "left")
    universe = checkpointed(universe.select("key", F.coalesce("is_listed", F.lit(False)).alias("is_listed")))
    levels = cascade(universe, most_bytes)
    rule = rule_for(F.col("host"), F.col("path"), rules)
    if levels is None:
        found = universe.where("is_listed").select(F.col("key").alias("host"), F.lit(True).alias("is_listed"))
        judged = rows.join(found, "host", "left").select("page_id", "host", "path", F.coalesce("is_listed", F.lit(False)).alias("is_listed"))
    else:
        hashed = [h for k in range(len(levels)) for h in hashes("host", k)]

        def run(batches):
            for batch in batches:
                cols = [c.to_numpy().view(np.uint64) for c in batch.columns[3:]]
                found = member(levels, list(zip(cols[::2], cols[1::2]))) if levels else np.zeros(batch.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], names=["page_id", "host", "path", "is_listed"])

        judged = rows.select("*", *hashed).mapInArrow(run, "page_id bigint, host string, path string, is_listed boolean")
    judged = judged.withColumn("r", rule)
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"))


def oracle(rules=RULES, terms=TERMS) -> str:
    """DuckDB SQL for judge()."""
    fits = {rule: (verdict, f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}')") for verdict, rule in rules for d, _, p in [rule.partition("/")]}
    longest = sorted(fits, key=len, reverse=True)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{upper.lower()}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits[r][1]} THEN '{r}'" for r in longest)} END AS rule,
  CASE {" ".join(f"WHEN {fits[r][1]} THEN '{fits[r][0]}'" for r in longest)}
  WHEN regexp_matches(host, '(^|[.-])({"|".join(terms)})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM p"""
