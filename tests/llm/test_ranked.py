import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import ranked as R

from .cases import documents, empty, frame, row, words


def found(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=20):
    texts = [(i, Counter(found(t))) for i, t in docs]
    texts = [(i, c, c.total()) for i, c in texts if c]
    n_docs, length = len(texts), sum(n for *_, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for i, c, n in texts:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in found(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item_id, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def asked(spark, items):
    return spark.createDataFrame([(i, t, "d", 1) for i, t in items], "item_id long, text string, doc_id string, score int")


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    for t in (None, "", "  ", "A-b_C d9 É\x80x\x7fÀy İı K", "\x1c\x85 a\x00b", "日本 😀z"):
        assert [x.decode() for x in R.terms(t)] == found(t)


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "WAITING", 40)
    rng = random.Random(3)
    texts = [(r[0], r[1]) for r in documents()] + [(100 + i, " ".join(words(rng, rng.randint(1, 90)))) for i in range(300)]
    texts += [(900 - i, texts[40][1]) for i in range(60)] + [(None, texts[40][1])]  # more ties than ranks
    items = [(i, " ".join(words(rng, 12))) for i in range(8)] + [(8, texts[40][1]), (9, None), (10, "?!"), (11, "unknownword"), (8, texts[41][1]), (None, texts[42][1]), (12, "aaa " * 40 + texts[43][1])]
    result = R.search(frame(spark, [row(*t) for t in texts]), asked(spark, items))
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(result) == brute(texts, items)


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, " ".join(words(rng, 40))) for i in range(60)]
    items = [(i, " ".join(words(rng, 6))) for i in range(9)]
    monkeypatch.setattr(R, "BLOCK_QUERIES", 3)
    assert got(R.search(frame(spark, [row(*t) for t in texts]), asked(spark, items), 5)) == brute(texts, items, 5)


def test_empty_tables(spark):
    assert R.search(empty(spark), asked(spark, [(1, "a b")])).count() == 0
    assert R.search(frame(spark), asked(spark, [])).count() == 0
    assert R.search(frame(spark, [row(1, None), row(2, "..")]), asked(spark, [(1, "a")])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_and_spare_documents(seed):
    rng = np.random.default_rng(seed)
    n_docs, vocabulary, queries, k = 4000, 300, 6, 10
    weights = np.where(rng.random((vocabulary, queries)) < 0.1, rng.integers(1, 9000, (vocabulary, 1)), 0)
    search, scores = R.Searcher(weights, n_docs, n_docs * 80, k), []
    for first in range(0, n_docs, R.DOCS):
        size = min(R.DOCS, n_docs - first)
        ids = [np.sort(rng.choice(vocabulary, rng.integers(1, 40), replace=False)) for _ in range(size)]
        tf, n = [rng.integers(1, 6, len(i)) for i in ids], rng.integers(40, 200, size)
        f = [R.impacts(c, m, n_docs, n_docs * 80) for c, m in zip(tf, n)]
        up = [-(-x // R.STEP) for x in f]
        assert all((u * R.STEP >= x).all() and ((u - 1) * R.STEP <= x).all() and u.max() <= 255 for u, x in zip(up, f))
        search.add(list(range(first, first + size)), n, np.concatenate(ids), np.concatenate(tf), np.concatenate(up), np.r_[0, np.cumsum([len(i) for i in ids])])
        scores += [(weights[i] * x[:, None]).sum(0) for i, x in zip(ids, f)]
    search.score()
    scores = np.array(scores)
    for q in range(queries):
        want = sorted(range(n_docs), key=lambda d: (-scores[d, q], d))[:k]
        assert [(-s, d) for s, _, d in search.best[q]] == [(scores[d, q], d) for d in want]
    assert search.scored < 0.2 * n_docs * queries
