import random

from tallyforge.llm import passages as P

from .cases import empty, frame, row, words


def pairs(spark, rows):
    return P.passages(frame(spark, rows)).collect()


def test_planted_passages_and_clean_documents(spark):
    rng = random.Random(4)
    docs = {i: words(rng, rng.randint(80, 250)) for i in range(40)}
    shared, edited, short = words(rng, 70), words(rng, 90), words(rng, 30)
    for i in (3, 8, 15, 30):
        docs[i][20:20] = shared
    for i in (5, 21):
        docs[i][10:10] = [w if k % 25 else "changed" + str(i) for k, w in enumerate(edited)]
    for i in (11, 12):
        docs[i][5:5] = short
    found = pairs(spark, [row(i, " ".join(w)) for i, w in docs.items()])
    named = {x for r in found for x in (r.doc_id, r.other_id)}
    assert named == {3, 5, 8, 15, 21, 30}
    for r in found:
        a, b = docs[r.doc_id][r.start : r.end], docs[r.other_id][r.other_start : r.other_end]
        same = P.common([w.encode() for w in a], [w.encode() for w in b])
        assert len(a) >= P.LEAST_WORDS and same >= r.n_equal >= P.LEAST_SHARE * max(len(a), len(b))
    assert {r.doc_id for r in found if r.other_id == min(3, 8, 15, 30) or r.doc_id in (3, 8, 15, 30)} <= {3, 8, 15, 30}


def test_copies_and_odd_rows(spark):
    found = pairs(spark, None)
    copies = {(r.doc_id, r.other_id) for r in found if r.n_equal == r.end - r.start == r.other_end - r.other_start}
    assert {(25, 0), (26, 0)} <= copies
    assert (28, 3) in {(max(r.doc_id, r.other_id), min(r.doc_id, r.other_id)) for r in found}
    assert not {20, 21, 22, 23, None} & {x for r in found for x in (r.doc_id, r.other_id)}
    assert P.passages(empty(spark)).count() == 0


def test_chain_is_the_best_of_all(spark):
    rng = random.Random(2)

    def brute(anchors):
        best = [P.GAIN] * len(anchors)
        for i, (x, y) in enumerate(anchors):
            for j, (a, b) in enumerate(anchors[:i]):
                if a < x and b < y:
                    best[i] = max(best[i], P.GAIN + best[j] - P.GAP * (x - a + y - b))
        return max(best)

    for _ in range(300):
        anchors = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(2, 14))})
        chain = [anchors[i] for i in P.best_chain([a for a, _ in anchors], [b for _, b in anchors])]
        score = P.GAIN * len(chain) - P.GAP * sum(c - a + d - b for (a, b), (c, d) in zip(chain, chain[1:]))
        assert all(a < c and b < d for (a, b), (c, d) in zip(chain, chain[1:]))
        assert abs(score - brute(anchors)) < 1e-9


def test_every_long_common_run_has_a_seed():
    rng = random.Random(9)
    for _ in range(50):
        run = words(rng, P.SEED_WORDS + P.WINDOW - 1)
        a, b = (P.Seeds().of(" ".join([*words(rng, 50), *run, *words(rng, 40)]))[0] for _ in range(2))
        assert set(a.tolist()) & set(b.tolist())


def test_moved_passages_have_chains_of_their_own():
    one, two, three = range(0, 60, 6), range(60, 120, 6), range(120, 180, 6)
    anchors = [*((x, x + 60) for x in one), *((x, x - 60) for x in two), *((x, x) for x in three)]
    assert sorted(p for c in P.chains(anchors) for p in c) == sorted(anchors)
    assert (60, 0) in {c[0] for c in P.chains(anchors)}
    rng = random.Random(6)
    for _ in range(200):  # cut parts are no wider than allowed, rise, and use no match twice
        anchors = list({(rng.randrange(200), rng.randrange(200)) for _ in range(rng.randint(2, 60))})
        made = P.chains(anchors)
        used = [p for c in made for p in c]
        assert len(used) == len(set(used)) and set(used) <= set(anchors) and all(len(c) > 1 for c in made)
        assert all(0 < b[k] - a[k] <= P.WIDEST for c in made for a, b in zip(c, c[1:]) for k in (0, 1))


def edited(rng, passage, rate):
    """The passage with this share of its words replaced."""
    out = list(passage)
    for i in rng.sample(range(len(out)), round(rate * len(out))):
        out[i] = "changed" + str(rng.random())
    return out


def test_edited_passages_are_found(spark):
    """Recall by brute force within the definition: of pairs planted with up to a tenth, and to 15 %, of their words replaced."""
    rng = random.Random(13)
    rows, planted = [], {}
    for i in range(0, 600, 2):
        rate = rng.choice([0.0, 0.02, 0.05, 0.08, 0.1, 0.15])
        passage = words(rng, rng.randint(60, 100))
        for j, p in ((i, passage), (i + 1, edited(rng, passage, rate))):
            rows.append(row(j, " ".join(words(rng, 50) + p + words(rng, 50))))
        planted[i] = rate
    found = {min(r.doc_id, r.other_id): abs(r.doc_id - r.other_id) for r in pairs(spark, rows)}
    assert all(d == 1 for d in found.values())  # no others
    for low, high, least in ((0, 0.05, 0.99), (0.08, 0.1, 0.95), (0.15, 0.15, 0.8)):
        some = [i for i, rate in planted.items() if low <= rate <= high]
        assert sum(i in found for i in some) >= least * len(some), (low, high)


def brute(rows):
    """Pairs of documents with LEAST_WORDS equal words in a row, by every place of every text."""
    where: dict = {}
    for doc_id, text in rows:
        ws = text.lower().split()
        for i in range(len(ws) - P.LEAST_WORDS + 1):
            where.setdefault(tuple(ws[i : i + P.LEAST_WORDS]), set()).add(doc_id)
    return [d for d in where.values() if len(d) > 1]


def test_texts_that_share_a_run_are_linked(spark):
    """Every set of texts with an exact run of fifty words in common is connected by rows, whatever else its lines stand in."""
    rng = random.Random(21)
    lines = [words(rng, 12) for _ in range(30)]
    texts = {i: words(rng, 40) + line + words(rng, 40) for i, line in enumerate(lines)}  # each line alone, in an earlier text
    for i in range(100, 160):  # pages of lines, some with the same five in a row
        at = rng.randrange(6) * 5
        texts[i] = words(rng, 30) + sum(lines[at : at + 5], []) + words(rng, 30)
    for i in range(200, 230):  # repeats within a text
        line = rng.choice(lines[:3])
        texts[i] = words(rng, 10) + line * rng.randint(5, 8) + words(rng, 10)
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    near: dict = {}
    for r in pairs(spark, [row(*x) for x in rows]):
        near.setdefault(r.doc_id, set()).add(r.other_id)
        near.setdefault(r.other_id, set()).add(r.doc_id)
    missed = 0
    sets = brute(rows)
    for some in sets:
        reached, todo = set(), [min(some)]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += near.get(x, ())
        missed += not some <= reached
    assert len(sets) > 100 and missed == 0


def test_repeats_within_a_text_are_each_found(spark):
    rng = random.Random(17)
    passage = words(rng, 60)
    one, two = words(rng, 30) + passage + words(rng, 30), words(rng, 20) + passage + words(rng, 70) + passage + words(rng, 20)
    for a, b in ((one, two), (two, one)):
        found = pairs(spark, [row(1, " ".join(a)), row(2, " ".join(b))])
        places = {(r.start if r.doc_id == (2 if b is two else 1) else r.other_start) // 50 for r in found}
        assert len(places) == 2 and len(found) == 2


def test_moved_passages_are_found_in_either_order(spark):
    rng = random.Random(7)
    rows, texts = [], {}
    for i in range(0, 16, 2):
        one, two, three = (words(rng, 60) for _ in range(3))
        texts[i], texts[i + 1] = one + two + three, two + one + three
    rows = [row(i, " ".join(w)) for i, w in texts.items()]
    found = pairs(spark, rows)
    for i in range(0, 16, 2):
        own = [(r.start, r.end) if r.doc_id == i else (r.other_start, r.other_end) for r in found if {r.doc_id, r.other_id} == {i, i + 1}]
        for start in (0, 60, 120):
            assert any(min(b, start + 60) - max(a, start) >= P.LEAST_WORDS for a, b in own)
