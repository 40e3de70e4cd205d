"""Byte-pair encoding by forced boundaries.

A pair of neighbouring bytes that no vocabulary token contains can never end up inside one
token, so every such pair is a certain cut: the fragments between cuts are encoded by
themselves and their ids concatenated. White space, which this tokenizer's pre-tokenizer
drops, and the strings of its special tokens are certain cuts too. Equal chunks between
white space are encoded once for each worker and looked up afterwards.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from .common import map_rows

#: Bytes of encoded chunks and words that a worker remembers before it starts anew.
CACHE_BYTES = 64 << 20
#: Chunks of ASCII without apostrophes and of Latin letters that need no normal form, and
#: their pre-tokens once in lower case; all others go through the library's own steps.
PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
PLAIN_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_alphabet() -> dict[int, int]:
    """Bytes as the printable characters of byte-level vocabularies: 256 onwards for the others."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder:
    """Encodes and decodes as the tokenizer file says, with no special tokens added."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = models.BPE(model["vocab"], merges, end_of_word_suffix=self.suffix or None)
        self.inner = models.BPE(model["vocab"], merges)
        self.names = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.joined = {p for t in model["vocab"] for p in zip(t.removesuffix(self.suffix), t.removesuffix(self.suffix)[1:])}
        self.alphabet = byte_alphabet()
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.cached = 0

    def fragments(self, word: str) -> list[str]:
        """A pre-token, in the byte alphabet, cut wherever two neighbours share no token."""
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def learn_word(self, word: str) -> tuple[bytes, bytes]:
        """Bytes of a pre-token's ids, and of its decoded text."""
        *first, end = self.fragments(word)
        ids = [t.id for f in first for t in self.inner.tokenize(f)] + [t.id for t in self.last.tokenize(end)]
        return self.remember(self.words, word, struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids]).encode())

    def learn(self, chunk: bytes) -> tuple[bytes, bytes]:
        """The same of a chunk of text; special tokens' strings stand for themselves."""
        text, parts = chunk.decode(), []
        if PLAIN.fullmatch(text):  # already in normal form; the pre-tokenizer's classes are plain here
            words = [w.encode().decode("latin-1").translate(self.alphabet) for w in PLAIN_WORDS.findall(text.lower())]
            parts = [self.words.get(w) or self.learn_word(w) for w in words]
        else:
            for part in self.at_special.split(text) if self.at_special else [text]:
                if part in self.special:
                    parts.append((self.special[part].to_bytes(4, "little"), part.encode()))
                elif part:
                    for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                        parts.append(self.words.get(w) or self.learn_word(w))
        return self.remember(self.chunks, chunk, b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts]))

    def remember(self, cache: dict, key: str | bytes, ids: bytes, decoded: bytes) -> tuple[bytes, bytes]:
        if self.cached > CACHE_BYTES:
            self.words.clear()
            self.chunks.clear()
            self.cached = 0
        self.cached += 250 + len(key) + len(ids) + len(decoded)
        cache[key] = found = ids, decoded
        return found

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8.

        Only the six ASCII characters of white space cut here; other white space stays in
        its chunk and is dropped by the pre-tokenizer.
        """
        get, learn = self.chunks.get, self.learn
        parts = [get(c) or learn(c) for c in (text or "").encode().split()]
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts if p[0]])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder, with what it remembers."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids with the decoded text, or with ``digest`` their SHA-256.

    One row for each row of ``docs``; a null text counts as empty and gives no ids and the
    empty string. Very long texts are encoded whole. Other columns of ``docs`` are not read.
    """

    def rows(doc_id: list, text: list) -> dict[str, list]:
        made = [encoder(path).encode(t) for t in text]
        out: dict[str, list] = {"doc_id": doc_id, "n_tokens": [len(a) // 4 for a, _ in made]}
        if digest:
            return out | {"ids_sha256": [hashlib.sha256(a).hexdigest() for a, _ in made], "decoded_sha256": [hashlib.sha256(b).hexdigest() for _, b in made]}
        return out | {"ids": [memoryview(a).cast("I").tolist() for a, _ in made], "decoded": [b.decode() for _, b in made]}

    more, ddl = ([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], "ids_sha256 string, decoded_sha256 string") if digest else ([("ids", pa.list_(pa.int64())), ("decoded", pa.string())], "ids array<bigint>, decoded string")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *more])
    return map_rows(docs.select(docs["doc_id"].cast("long"), docs["text"]), rows, schema, f"doc_id bigint, n_tokens bigint, {ddl}")


def brute_force(path: str) -> Callable[[str | None], tuple[list[int], str]]:
    """The whole text through the library at once: what encode() must equal."""
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()

    def run(text: str | None) -> tuple[list[int], str]:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        return ids, whole.decode(ids, skip_special_tokens=False)

    return run
