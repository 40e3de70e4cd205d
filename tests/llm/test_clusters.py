import hashlib
import math
import random

import numpy as np

from tallyforge.llm import clusters as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, x string, norms string, distance long, key string"


def row(i, v):
    return (i, v, 1, 2, "x", "n", 3, "k")


def brute(rows, k=16, rounds=3):
    """Plain lists of Python integers, every distance computed."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    cents = [x for _, x in start]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    by = {j: sum(d for _, o, d in found if o == j) for j in range(len(cents))}
    return sorted(((i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def made(rng, n):
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centres)]) for i in range(n)]


def test_query_equals_brute_force(spark):
    rng = random.Random(2)
    rows = made(rng, 300)
    rows += [(400 + i, rows[3][1]) for i in range(40)]  # copies: ties and empty clusters
    rows += [(7, rows[8][1]), (7, rows[8][1]), (None, rows[1][1])]
    rows += [(500, None), (501, []), (502, [0.5] * 63), (503, [None] + [0.1] * 63), (504, [float("nan")] + [0.1] * 63), (505, [float("inf")] + [0.1] * 63), (506, [0.0] * 64), (507, [1.0] * 65)]
    got = C.cluster(spark.createDataFrame([row(*r) for r in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_few_or_no_vectors(spark):
    few = [(1, [0.25] * 64), (2, [-0.25] * 64), (2, [-0.25] * 64)]
    got = C.cluster(spark.createDataFrame([row(*r) for r in few], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(few)
    assert C.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.cluster(spark.createDataFrame([row(None, [1.0] * 64), row(3, [1e30] * 64)], SCHEMA)).count() == 0


def test_sums_beyond_a_long_are_null(spark):
    far = [(i, [2.0e6 * (-1) ** i] * 64) for i in range(40)] + [(99, [0.0] * 64)]
    got = C.cluster(spark.createDataFrame([row(*r) for r in far], SCHEMA), k=1, rounds=0).collect()
    assert len(got) == 41 and all(r.distance >= 0 for r in got) and {r.inertia for r in got} == {None}


def test_bounds_hold_and_screen():
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (16, 64)) * rng.integers(1, 12, (16, 1))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-9, 10, (2000, 64))
    exact = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    low = C.bounds(C.norms(x), C.norms(centres))
    assert (low <= exact).all()
    cluster, distance, taken = C.nearest(x, C.norms(x), centres, C.norms(centres))
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert taken < 0.7 * exact.size
    for s in (0, 1, 2, 3, 4, 8, 9, 10, (1 << 54) - 1, 1 << 54):  # roots are exact
        root = math.isqrt(s)
        assert C.norms(np.array([[root, 0]]), 2)[0, 0] == root


def test_roots_of_large_squares():
    rng = random.Random(1)
    for _ in range(300):
        v = [rng.randint(-(1 << 27), 1 << 27) for _ in range(8)]
        assert C.norms(np.array([v]))[0, 0] == math.isqrt(sum(a * a for a in v))
