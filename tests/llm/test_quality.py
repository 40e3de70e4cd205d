import random
import re

from tallyforge.llm import quality as Q

from .cases import empty, frame, words


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    repeated = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            repeated |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_measurements():
    rng = random.Random(3)
    base = words(rng, 9)
    texts = [None, "", " \n ", "a", "x\nx\n x\n\nx", " ".join(base * 3), "# a | b\n# a | b", "é ü\x0bß\x0cß\u00a0ß"]
    texts += [" ".join(rng.choice(["a", "b", "c\n", "#d"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for t in texts:
        assert Q.measure(t)[:5] == brute(t), t


def test_ledger_policies_and_ablation(spark):
    book = Q.ledger(frame(spark)).cache()
    rows = book.collect()
    assert len(rows) == frame(spark).count()
    for r in rows:
        assert r.failed == Q.failed(tuple(r[m] for m in Q.MEASURES))
    for policy, names in Q.POLICIES.items():
        bits = Q.mask(names)
        alive = sum(not r.failed & bits for r in rows)
        for a in Q.ablation(book, policy).collect():
            own = 1 << a.bit
            assert (a.documents, a.kept) == (len(rows), alive)
            assert a.fails == sum(bool(r.failed & own) for r in rows)
            assert a.fails_alone == sum(r.failed & bits == own for r in rows)
            assert a.kept_without == sum(not r.failed & bits & ~own for r in rows)


def test_versions(spark):
    book = Q.ledger(frame(spark)).cache()
    bits = [r.failed for r in book.collect()]
    before = 0
    for r in Q.versions(book).orderBy("policy").collect():
        now = Q.mask(Q.POLICIES[r.policy])
        assert (r.documents, r.kept) == (len(bits), sum(not b & now for b in bits))
        assert r.newly_failed == sum(not b & before and bool(b & now) for b in bits)
        before = now
    assert Q.versions(book.limit(0)).count() == 0 and Q.ablation(book.limit(0)).count() == 0


def test_verdicts_agree_with_keep(spark):
    docs = frame(spark)
    out = Q.keep(docs)
    assert out.schema == docs.schema
    kept = sorted((str(r.doc_id) for r in Q.verdicts(docs).where("kept").collect()))
    assert kept == sorted(str(r.doc_id) for r in out.collect()) and "20" not in kept and "0" in kept
    assert all(not r.kept for r in Q.verdicts(docs).where("base_failed").collect())
    assert Q.verdicts(empty(spark)).count() == 0 and Q.keep(empty(spark)).count() == 0


def test_abuse_goes_and_plain_text_stays():
    clean = "the quick brown fox jumps over the lazy dog while nobody minds and all is well here today my friends"
    policy = Q.mask(Q.POLICIES[Q.CURRENT])
    assert not Q.failed(Q.measure(clean)) & policy
    assert Q.failed(Q.measure(clean + " you stupid idiot")) & policy


def test_no_name_of_a_column_clashes(spark):
    docs = frame(spark)
    for name in ("failed", "failed_bits", "Failed_Bits_", "_failed_"):
        made = Q.keep(docs.withColumnRenamed("source", name))
        assert made.columns == docs.withColumnRenamed("source", name).columns and made.count() == Q.keep(docs).count()
    both = docs.withColumnsRenamed({"source": "failed_bits", "path": "failed_bits_"})
    assert Q.keep(both).count() == Q.keep(docs).count()
