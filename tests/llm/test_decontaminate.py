import random

import regex

from tallyforge.llm import decontaminate as C

from .cases import empty, frame, row

ITEM = "A farmer packs 12 crates of apples and sells 5 crates for 40 dollars each at the village market near Paris on Monday."
OTHER = "So the text began. A farmer packs 31 crates of apples and sells 7 crates for 55 dollars each at the village market near Rome on Monday. And it went on."
WRONG = "A farmer packs 5 crates of apples and sells 5 crates for 40 dollars each at the village market near Oslo on Monday."


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "item_id long, text string")


def found(spark, rows, *texts):
    return {(r.doc_id, r.item_id) for r in C.leaks(frame(spark, rows), items(spark, *texts)).collect()}


def test_same_and_other_values_are_caught(spark):
    rows = [row(1, ITEM), row(2, OTHER), row(3, ITEM.upper()), row(4, "A farmer packs nothing and sells nothing at all, he says."), row(5, None), row(6, "")]
    assert found(spark, rows, ITEM) >= {(1, 1), (2, 1)}
    assert not found(spark, rows, ITEM) & {(4, 1), (5, 1), (6, 1)}


def test_names_in_capitals_are_names(spark):
    item = "A train leaves LONDON at 9 and meets another one from YORK after 3 hours at a bridge near LONDON itself."
    moved = "A train leaves OSLO at 8 and meets another one from BERGEN after 5 hours at a bridge near OSLO itself."
    mixed = "A train leaves OSLO at 8 and meets another one from BERGEN after 5 hours at a bridge near BERGEN itself."
    assert found(spark, [row(1, moved), row(2, "I SAY NOTHING OF THE KIND, AND A LOT OF IT")], item) == {(1, 1)}
    assert C.NAMES and (2, 1) not in found(spark, [row(2, mixed.replace("A train leaves", "The coach left"))], item)


def test_contradicting_slots_are_no_leak(spark):
    twice = "Then Tom counts 5 red balls and 5 blue balls before he gives 5 green balls to the club."
    good = "Then Tom counts 8 red balls and 8 blue balls before he gives 8 green balls to the club."
    bad = "Then Tom counts 8 red balls and 9 blue balls before he gives 7 green balls to the club."
    assert found(spark, [row(1, good), row(2, bad)], twice) == {(1, 1)}


def worded(text):
    """Words and template words by the same definitions, one step after another."""
    typed = regex.sub(C.NAMES, C.NAME, text).lower()
    typed = regex.sub(C.MEASURED, f"{C.NUMBER} {C.UNIT}", regex.sub(C.NUMBERS, C.NUMBER, typed))
    return [[w for w in regex.split(C.BETWEEN, t.strip(C.ENDS)) if w] for t in (text.lower(), typed)]


def brute(docs, items, share=C.SHARE, run=C.RUN):
    """(doc_id, item_id) by trying every window of every item at every place of every document."""
    out = set()
    for item_id, item in items:
        p, t = worded(item or "")
        width = C.WIDTH if len(p) >= C.WIDTH else len(p)
        for doc_id, text in docs:
            q, u = worded(text or "")
            if not p or not q or width < C.LEAST and q != p:
                continue
            met = []  # (shift, j, literal)
            for j in range(len(p) - width + 1):
                for i in range(len(q) - width + 1):
                    if p[j : j + width] == q[i : i + width]:
                        met.append((i - j, j, True))
                    elif width == C.WIDTH and t[j : j + width] == u[i : i + width]:
                        met.append((i - j, j, False))
            slots = lambda j: [k for k in range(j, j + width) if t[k].startswith(C.PLACEHOLDER)]
            strength = lambda j: width - len(slots(j))
            held = set()
            for shift in {m[0] for m in met}:
                here = [m for m in met if m[0] == shift]
                values: dict = {}
                for _, j, _ in here:
                    if t[j : j + width] == u[j + shift : j + shift + width]:
                        for k in slots(j):
                            values.setdefault(p[k], set()).add(q[k + shift])
                some = any(lit or strength(j) >= C.STRONG for _, j, lit in here)
                for _, j, lit in here:
                    sound = all(len(values[p[k]]) == 1 for k in slots(j)) if not lit else True
                    if lit or some and sound and strength(j):
                        held.add(j)
            best = max((n for j in held for n in range(1, len(p) + 1) if all(j + k in held for k in range(n))), default=0)
            n = len(p) - width + 1
            if held and (len(held) >= share * n or best + width - 1 >= run):
                out.add((doc_id, item_id))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(11)
    verbs, things, places = "packs sells counts buys".split(), "crates apples balls books".split(), "Paris Rome Oslo Lima".split()

    def part():
        return rng.choice([f"{rng.choice(verbs)} {rng.randint(1, 9)} {rng.choice(things)}", f"near {rng.choice(places)},", f"in {rng.randint(2, 4)} km", "and then goes on.", f"for {rng.randint(1, 3)} {rng.randint(1, 3)}", "he said: \"no\"!"])

    items = [" ".join(part() for _ in range(rng.randint(1, 7))) for _ in range(25)] + ["Is 91 prime ?", "yes", "no way", None, "", "?!", "a b c"]
    docs = []
    for k in range(120):
        text = rng.choice(items) or ""
        for old, new in (("1", "7"), ("2", "8"), ("Paris", "Rome"))[: rng.randint(0, 3)]:
            text = text.replace(old, new, rng.choice([1, 9]))
        docs.append(rng.choice([text, text.upper(), f"{part()} {text} {part()}", text + "..."]))
    docs += ["so, is 91 prime?", "Yes!", "yes yes", None, "", "  "]
    want = brute(list(enumerate(docs)), list(enumerate(items)))
    made = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = C.leaks(frame(spark, [row(i, t) for i, t in enumerate(docs)]), made).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len({(r.row_key, r.item_id) for r in got})
    assert len(want) > 100 and any(i == 25 for _, i in want)


def test_copies_are_caught_whatever_their_slots(spark):
    item = "In the first round Tom bought 5 red hats and after that he sold 5 of the blue hats that his brother had left in the old shop by the river before it rained all day long on market Street."
    one_changed = item.replace("sold 5", "sold 6")
    rows = [row(1, one_changed), row(2, item.upper()), row(3, "Well. " + item + '"'), row(4, item.replace("5 of", "5. of"))]
    assert found(spark, rows, item) == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert found(spark, [row(1, "see: Is 91 prime? or not"), row(2, "is 92 prime?")], "Is 91 prime ?") == {(1, 1)}


def test_rows_that_share_an_id_are_judged_apart(spark):
    half = len(ITEM) // 2
    rows = [row(1, ITEM[:half]), row(1, ITEM[half:]), row(2, ITEM), row(2, "Then Tom counts nothing."), row(None, ITEM), row(None, "Something else is written in this one.")]
    made = items(spark, ITEM)
    assert {(r.doc_id, r.item_id) for r in C.leaks(frame(spark, rows), made).collect()} == {(2, 1), (None, 1)}
    out = C.clean(frame(spark, rows), made).collect()
    assert sorted(r.text for r in out) == sorted([rows[0][1], rows[1][1], rows[3][1], rows[5][1]])
    long = " ".join(f"word{k}" for k in range(60_000))
    junk = ". , " * 50_000 + "1.1," * 50_000 + " " * 50_000 + "!" * 50_000
    assert found(spark, [row(1, f"{long} {OTHER} {long}"), row(2, f"{junk} {OTHER} {junk}")], ITEM) == {(1, 1), (2, 1)}


def test_clean_keeps_columns_and_other_rows(spark):
    rows = [row(1, OTHER), row(2, "nothing of the kind is written in this one"), row(None, "no id"), row(3, None)]
    out = C.clean(frame(spark, rows), items(spark, ITEM, "too short", None))
    assert out.columns == frame(spark, rows).columns
    assert {r.doc_id for r in out.collect()} == {2, 3, None}
    assert C.clean(empty(spark), items(spark, ITEM)).count() == 0
    assert C.clean(frame(spark, rows), items(spark, ITEM).limit(0)).count() == 4
    assert C.leaks(frame(spark), items(spark, ITEM)).count() == 0


def test_large_benchmarks_join_by_shuffle(spark, monkeypatch):
    rows = [row(1, OTHER), row(2, "nothing of the kind is written in this one")]
    few = found(spark, rows, ITEM)
    monkeypatch.setattr(C, "BROADCAST_WINDOWS", 0)
    assert found(spark, rows, ITEM) == few == {(1, 1)}


def test_native(spark):
    plan = C.leaks(frame(spark), items(spark, ITEM))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
