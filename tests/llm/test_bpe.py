import hashlib
import random
import struct

import pytest

from tallyforge.llm import bpe as B
from tallyforge.llm.queries import TOKENIZER

from .cases import empty, frame

PIECES = ["a", "b", "é", "Ñ", "ß", "c.", "÷", "µ", "_", " ", "\n", "A", "'s", "́", "Σ", "İ", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "\xa0", "​", "😀", "1", "٣", "中", "!!", "\x00", "\x85", "'LL", "ﬁ", "the", "ing"]


@pytest.fixture(scope="module")
def whole():
    return B.brute_force(TOKENIZER)


def test_round_trip_against_the_library(whole):
    encoder, rng = B.encoder(TOKENIZER), random.Random(1)
    for text in [None, "", *("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(6000))]:
        ids, decoded = encoder.encode(text)
        assert (list(memoryview(ids).cast("I")), decoded.decode()) == whole(text), repr(text)


def test_cuts_are_where_no_token_joins():
    e = B.encoder(TOKENIZER)
    for word in ("hello", "zqxjkv", "ÃłÃł", "xqzxqz"):
        parts = e.fragments(word)
        assert "".join(parts) == word
        assert all((a[-1], b[0]) not in e.joined for a, b in zip(parts, parts[1:]))


def test_forgetting_changes_nothing(whole, monkeypatch):
    monkeypatch.setattr(B, "CACHE_BYTES", 2000)
    e, rng = B.Encoder(TOKENIZER), random.Random(2)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdé.1") for _ in range(6)) for _ in range(20))
        assert list(memoryview(e.encode(text)[0]).cast("I")) == whole(text)[0]


def test_frames(spark, whole):
    rows = {r.doc_id: r for r in B.encode(frame(spark), TOKENIZER).collect()}
    digests = {r.doc_id: r for r in B.encode(frame(spark), TOKENIZER, digest=True).collect()}
    for r in frame(spark).collect():
        ids, decoded = whole(r.text)
        assert (rows[r.doc_id].ids, rows[r.doc_id].decoded, rows[r.doc_id].n_tokens) == (ids, decoded, len(ids))
        assert digests[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert digests[r.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert B.encode(empty(spark), TOKENIZER).count() == 0
