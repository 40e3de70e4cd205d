"""Documents with what operators must stand: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tid long, seed long, fp long, rules long, host string, kept boolean, h int, i int, start int, path string, of long"
EXTRA = (None, "en", "src", 1, 2, 3, 4, 5, "x", True, 6, 7, 8, "p", 9)


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", len(text or ""), 2, 3, 4, 5, "x", True, 6, 7, 8, "p", 9)


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice("abcdefghij") + rng.choice(["na", "to", "ri", "su", "mé"]) + rng.choice(["ka", "lo", "", "pe"]) + rng.choice(["m", "n", ""]) for _ in range(n)]


def documents(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = [row(i, " ".join(words(rng, rng.randint(60, 160)))) for i in range(12)]
    long = " ".join(words(rng, 60_000))
    rows += [row(20, None), row(21, ""), row(22, "   \n\t "), row(23, "one"), row(24, long), row(25, rows[0][1]), row(26, rows[0][1]), row(None, rows[1][1]), rows[2], rows[2], row(27, "x" * 50_000), row(28, rows[3][1] + " tail")]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
