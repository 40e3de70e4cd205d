import math
import random
import re

import numpy as np
import pytest

from tallyforge.llm import minhash as M

from .cases import documents, empty, frame, row, words

RULE = M.Rule()


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()


def brute(texts):
    """(doc_id, n_shingles, component_id, kept) by all pairs of whole sets."""
    sets = [shingle_set(t) for _, t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)) and 100 * len(x & y) >= 85 * len(x | y):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    rows = [(d, len(s), least.get(top(i)), d == least.get(top(i))) for i, ((d, _), s) in enumerate(zip(texts, sets))]
    return sorted(rows, key=str)


def got(spark, texts):
    out = M.near_duplicates(frame(spark, [row(*t) for t in texts]))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def edited(rng, ws, n):
    ws = list(ws)
    for k in rng.sample(range(len(ws)), min(n, len(ws))):
        ws[k] = rng.choice("uvwxyz") + ws[k]
    return " ".join(ws)


def family(rng, first, size, length, most):
    """Texts around one text, with more and more words replaced."""
    base = words(rng, length)
    return [(first + i, edited(rng, base, rng.randint(0, most))) for i in range(size)]


def test_odd_rows(spark):
    texts = [(r[0], r[1]) for r in documents()] + [(40, "One"), (41, "one  two"), (42, "ONE\ttwo"), (43, "a b c"), (44, "A b\nC"), (None, "a b c d e f g"), (None, "A b c d e f g"), (None, None)]
    assert got(spark, texts) == brute(texts)
    assert M.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_query_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = [(i, " ".join(words(rng, rng.randint(1, 200)))) for i in range(60)]
    for f in range(12):
        texts += family(rng, 1000 + 100 * f, 12, rng.choice([5, 15, 40, 150, 400]), rng.choice([2, 6, 20]))
    texts += [(5000 + i, t) for i, (_, t) in enumerate(texts[60:90])]
    rng.shuffle(texts)
    assert got(spark, texts) == brute(texts)


def test_large_groups_equal_all_pairs(spark, monkeypatch):
    """Groups over many chunks, with sets that no hub is linked with, chains of sets, and values that nearly all texts have."""
    monkeypatch.setattr(M, "CHUNK", 3000)
    monkeypatch.setattr(M, "SHORT", 6)
    monkeypatch.setattr(M, "HOT_VALUE", 100)
    rng = random.Random(7)
    common = " ".join(words(rng, 30))
    texts = family(rng, 0, 150, 120, 14)
    texts += [(200 + i, common + " " + " ".join(words(rng, 3))) for i in range(60)]
    texts += [(300 + i, common + " " + " ".join(words(rng, 60))) for i in range(60)]
    ws = words(rng, 100)
    for i in range(60):  # each text is linked with the next few alone
        texts.append((400 + i, " ".join(ws)))
        ws = ws[2:] + words(rng, 2)
    rng.shuffle(texts)
    want = brute(texts)
    assert got(spark, texts) == want
    assert len({c for _, _, c, _ in want}) > 60


def test_sketches_never_lose_a_linked_pair():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        cut = int(rng.integers(0, 1 + len(base) // 12))
        other = np.unique(np.r_[rng.permutation(base)[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)])
        both = len(np.intersect1d(base, other))
        exact = 100 * both >= 85 * (len(base) + len(other) - both)
        found = RULE.likely(base[: M.K], other[: M.K], len(base), len(other))
        assert found or not exact
        if max(len(base), len(other)) <= M.K:
            assert found == exact


def test_least_common_values():
    """At the share itself fewer common values than ``least`` are met once in a billion."""
    for share in (80, 85, 95):
        p, least = share / 100, M.Rule(share=share).least
        below = lambda t: sum(math.comb(M.K, i) * p**i * (1 - p) ** (M.K - i) for i in range(t))
        assert below(least) <= M.MISSED < below(least + 1)


def test_inverted_index_counts_exactly():
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(1, 50))], np.uint64)) for _ in range(80)]
    index = M.Inverted(sets)
    for s in [*sets, np.array([999], np.uint64)]:
        assert index.links(s, RULE).tolist() == [j for j, t in enumerate(sets) if len(t) and 100 * len({*s.tolist()} & {*t.tolist()}) >= 85 * len({*s.tolist()} | {*t.tolist()})]
