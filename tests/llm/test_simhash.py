import random
import re

import numpy as np
import xxhash

from tallyforge.llm import simhash as S
from tallyforge.llm.components import components

from .cases import empty, frame, row, words


def brute(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    hashes = [xxhash.xxh64(" ".join(ws[i : i + width]).encode(), seed=42).intdigest() for i in range(max(1, len(ws) - width + 1))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def groups(points, radius):
    up = list(range(len(points)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array(points, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            x, y = top(i), top(i + 1 + int(j))
            up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(points))]


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " ", "One", "A b C", "É é A\x0bB", *(" ".join(words(rng, n)) for n in (3, 4, 5, 254, 258, 259, 600))]
    for t in texts:
        assert S.fingerprint(t) == brute(t)


def test_links_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 150)  # hot prefixes are dealt over several tasks
    rng = random.Random(5)

    def near(x, most):
        for b in rng.sample(range(64), rng.randint(1, most)):
            x ^= 1 << b
        return x

    base = [rng.getrandbits(64) for _ in range(150)]
    points = {*base, *(near(b, 7) for b in base[:40] for _ in range(20)), *(near(base[0], 5) for _ in range(1500))}
    points = sorted(points)
    reps = spark.createDataFrame([(S.signed(p), i) for i, p in enumerate(points)], "fp long, rep long")
    found = {r.node: r.component for r in components(S.links(reps)).collect()}
    assert [found.get(i, i) for i in range(len(points))] == groups(points, 4)


def test_query_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [row(i, " ".join(words(rng, 120))) for i in range(30)]
    for i in range(30, 60):
        ws = rows[i % 5][1].split()
        ws[rng.randrange(120)] = "other"
        rows.append(row(i, " ".join(ws)))
    rows += [row(90, None), row(91, ""), row(92, rows[7][1]), row(92, rows[7][1])]
    got = {r.doc_id: r for r in S.near_duplicates(frame(spark, rows)).collect()}
    ids = sorted(got)
    texts = {r[0]: r[1] for r in rows}
    want = groups([brute(texts[i]) for i in ids], 4)
    assert all(got[i].component_id == ids[w] and int(got[i].fingerprint, 16) == brute(texts[i]) for i, w in zip(ids, want))
    assert got[91].component_id == 90 and len(got[0].fingerprint) == 16


def test_similar_texts_are_grouped_and_others_left(spark):
    rng = random.Random(8)
    rows = [row(i, " ".join(words(rng, rng.randint(150, 400)))) for i in range(40)]
    for i in range(100, 140):
        ws = rows[i - 100][1].split()
        for k in rng.sample(range(len(ws)), max(1, len(ws) // 120)):
            ws[k] = "changed"
        rows.append(row(i, " ".join(ws)))
    for i in range(200, 240):  # a third of the words are others
        ws = rows[i - 200][1].split()
        rows.append(row(i, " ".join(w if k % 3 else rng.choice("uvwxyz") + w for k, w in enumerate(ws))))
    rows += [row(300, None), row(301, " "), row(302, rows[5][1]), row(None, rows[5][1])]
    texts = {r[0]: r[1] for r in rows}
    for a in range(100, 140):
        assert S.alike(texts[a], texts[a - 100])
    got = {r.doc_id: r.component_id for r in S.similar(frame(spark, rows)).collect()}
    assert sum(got[i] == i - 100 for i in range(100, 140)) >= 34
    assert all(got[i] == i for i in [*range(40), *range(200, 240)])
    assert (got[301], got[302], got[None]) == (300, 5, 5)
    for i, c in got.items():  # a group is held together by texts that are alike
        assert i in (c, None) or any(S.alike(texts[i], texts[j]) for j, d in got.items() if d == c and j != i)
    assert S.similar(empty(spark)).count() == 0


def test_shares_of_shingles():
    rng = random.Random(4)
    for _ in range(200):
        a = words(rng, rng.randint(1, 40))
        b = [w if rng.random() > 0.05 else "x" for w in a]
        x, y = ({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (a, b))
        assert S.alike(" ".join(a), " ".join(b)) == (len(x & y) >= 0.8 * len(x | y))
    assert S.alike(None, " \n") and not S.alike("", "a")


def test_pairs_that_miss_their_hub_are_tried_again(spark):
    """Texts between which the share falls with distance: a band's first text is alike to some of its others only."""
    rng = random.Random(12)
    rows = []
    for g in range(6):
        ws = words(rng, 400)
        for i in range(25):
            rows.append(row(100 * g + i, " ".join(ws)))
            for k in rng.sample(range(400), 6):
                ws[k] = rng.choice("uvwxyz") + ws[k]
    rng.shuffle(rows)
    ids = [r[0] for r in rows]
    sets = [set(S.shingle_hashes(r[1], 5).tolist()) for r in rows]
    up = {i: i for i in ids}
    for _ in ids:
        for i, x in zip(ids, sets):
            for j, y in zip(ids, sets):
                if up[j] < up[i] and len(x & y) >= 0.8 * len(x | y):
                    up[i] = up[j]
    assert {r.doc_id: r.component_id for r in S.similar(frame(spark, rows)).collect()} == up
    assert sorted(r.doc_id for r in S.keep_one(frame(spark, rows)).collect()) == sorted(set(up.values()))


def test_one_of_each_group_stays(spark):
    docs = frame(spark)
    out = S.keep_one(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(2) == 1 and 0 in ids and 25 not in ids and 26 not in ids and ids.count(None) == 1
    assert 20 in ids and 21 not in ids  # wordless texts are one group
    assert S.near_duplicates(empty(spark)).count() == 0 and S.keep_one(empty(spark)).count() == 0


def test_a_shared_doc_id_loses_no_text(spark):
    rng = random.Random(3)
    a, b = (" ".join(words(rng, 80)) for _ in range(2))
    out = S.keep_one(frame(spark, [row(1, a), row(5, a), row(5, b), row(5, b)])).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, a), (5, b)]
    out = S.keep_one(frame(spark, [row(7, a), row(7, b)])).collect()
    assert sorted(r.text for r in out) == sorted([a, b])


def test_components_of_long_paths(spark):
    edges = spark.range(300).selectExpr("id a", "id + 1 b").union(spark.sql("select 1000L, 1001L union all select 1001L, 1000L union all select 7L, 7L"))
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_no_name_of_a_column_clashes(spark):
    rows = [row(i, t) for i, t in enumerate(("a b c d e f", "A b c d e f", None, "x"))]
    want = sorted(r.doc_id for r in S.keep_one(frame(spark, rows)).collect())
    for a, b in (("kept_doc_id", "kept_text_id"), ("_kept_text_", "_kept_doc_id_"), ("kept_text_id_", "kept_doc_id"), ("node", "first")):
        docs = frame(spark, rows).withColumnsRenamed({"lang": a, "source": b})
        made = S.keep_one(docs)
        assert made.columns == docs.columns and sorted(r.doc_id for r in made.collect()) == want
