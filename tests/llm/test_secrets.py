import hashlib
import random
import re

from tallyforge.llm import secrets as S

from .cases import empty, frame, row

ASSIGN = re.compile(r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [sum(k == i for _, k, _ in found) for i in range(3)], ",".join(x for *_, x in sorted(found))


def test_base_spans(spark):
    rng = random.Random(5)
    pieces = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcdefghijkl", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "é", "\n", "secret", "deadbeef", "😀"]
    rows = [row(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    rows += [row(2000, None), row(2001, "secret=token:abcdefghijklmnop"), row(None, "token=0123456789abcdef"), row(5, "token=0123456789abcdef")]
    want = sorted((str(r[0]), *brute(r[1])[0], hashlib.sha256(brute(r[1])[1].encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in S.scan(frame(spark, rows)).collect()) == want


def test_further_rules_and_odd_rows(spark):
    texts = ["-----BEGIN RSA PRIVATE KEY-----", "x ghp_" + "x" * 36, "xoxb-1234567890-abc", "AIza" + "B" * 35, "postgres://me:pw@db/x", "nothing here"]
    got = {r.doc_id: r.spans for r in S.scan(frame(spark, [row(i, t) for i, t in enumerate(texts)])).collect()}
    assert [got[i].split(":")[0] for i in range(6)] == ["private_key", "github", "slack", "google", "url_login", ""]
    assert got[1] == "github:2:42"
    assert S.scan(frame(spark)).count() == frame(spark).count() and S.scan(empty(spark)).count() == 0


def test_queries_hold_for_every_match():
    samples = {"assign": "PassWord = 'abcdefghijklmnop'", "access": "AKIA0123456789ABCD", "private_key": "-----BEGIN EC PRIVATE KEY-----", "github": "gho_" + "x" * 36, "slack": "xoxp-0123456789", "google": "AIza" + "x" * 35, "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.abc", "url_login": "a://b:c@d"}

    def holds(query, text):
        return True if query is None else query in text if isinstance(query, str) else (all if query[0] == "and" else any)(holds(q, text) for q in query[1])

    for rule in S.RULES:
        query = S.trigram_query(rule)
        assert (query is None) == (rule.kind == "hex")
        if rule.kind in samples:
            assert re.search(rule.pattern, samples[rule.kind]) and holds(query, samples[rule.kind].lower())


def test_native(spark):
    plan = S.scan(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
