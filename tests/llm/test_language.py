import math
import random
import zlib

import numpy as np

from tallyforge.llm import language as L

from .cases import empty, frame, row

SYLLABLES = {"aa": ["th", "er", "ing", "on", "and"], "bb": ["sch", "ung", "ein", "keit", "ver"], "cc": ["ción", "ado", "ue", "los", "ñ"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [row(i, text(rng, lang, rng.randint(3, 40)), lang) for i in range(600) for lang in [rng.choice(sorted(SYLLABLES))]]
    rows += [row(700, None, "aa"), row(701, "", "aa"), row(702, "12 %% 3", "aa"), row(703, text(rng, "bb", 30), None), row(None, text(rng, "aa", 30), None), row(704, text(rng, "cc", 200_000), None)]
    found = L.identify(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows if r[0] is not None)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and not by[i].accepted for i in (700, 701, 702))
    assert (by[703].lang_pred, by[704].lang_pred) == ("bb", "cc")
    tested = [r for r in rows[:600] if by[r[0]].held_out]
    assert sum(by[r[0]].lang_pred == r[2] for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_of_held_out_rows_are_never_read(spark):
    rng = random.Random(2)
    rows = [row(i, text(rng, lang, 20), lang) for i in range(200) for lang in [rng.choice(sorted(SYLLABLES))]]
    changed = [row(r[0], r[1], "zz" if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[2]) for r in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in L.identify(frame(spark, x)).collect()) for x in (rows, changed))
    assert a == b


def test_predictions_equal_plain_sums():
    """Scores against subwords counted one by one, and a table of logits read one row at a time."""
    rng = random.Random(4)
    labels = [rng.choice(sorted(SYLLABLES)) for _ in range(120)]
    model = L.train([text(rng, lang, 15) for lang in labels], labels)
    model.temperature, model.threshold = 0.7, 0.5
    for t in ["A", "Straße ñandú", " x\n\ty  z ", *(text(rng, rng.choice(labels), n) for n in (1, 3, 50))]:
        data = b" " + b" ".join(t.lower().encode().split()) + b" "
        total, n = [0.0] * len(model.langs), 0
        for size in L.SIZES:
            for i in range(len(data) - size + 1):
                h = size
                for byte in data[i : i + size]:
                    h = (h ^ byte) * 0x01000193 % 2**32
                bucket = (h ^ (h >> 15)) % L.BUCKETS
                total = [a + float(b) for a, b in zip(total, model.logits[bucket])]
                n += 1
        z = [(a / n + b) / model.temperature for a, b in zip(total, model.bias)]
        e = [math.exp(v - max(z)) for v in z]
        best = max(range(len(e)), key=e.__getitem__)
        lang, score = model.predict(t)
        assert lang == model.langs[best] and abs(score - e[best] / sum(e)) < 1e-9


def test_ties_repeats_and_long_training_rows(spark):
    even = L.Model(["aa", "bb"], np.zeros((L.BUCKETS, 2), np.float32), np.zeros(2))
    assert even.predict("word") == ("aa", 0.5)
    rng = random.Random(6)
    rows = [row(i, text(rng, lang, 20), lang) for i in range(100) for lang in [rng.choice(sorted(SYLLABLES))]]
    long = [row(500 + i, text(rng, "aa", 20_000), "zz") for i in range(10)]
    found = L.identify(frame(spark, rows + rows + long)).collect()
    assert len(found) == 210 and len({(r.doc_id, r.lang_pred, r.score) for r in found}) == 110
    assert "zz" not in {r.lang_pred for r in found}


def test_nothing_to_learn(spark):
    rows = [row(i, "some text here", None) for i in range(5)]
    assert {(r.lang_pred, r.score) for r in L.identify(frame(spark, rows)).collect()} == {("und", 0.0)}
    assert L.identify(empty(spark)).count() == 0
