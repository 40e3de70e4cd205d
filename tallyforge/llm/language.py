"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of two to four bytes of the lower-case text, with one space for any white
space, hashed into a fixed table of embeddings. A text is the average of its subwords'
embeddings. Table and softmax are trained together by stochastic gradient descent in numpy
on a bounded sample; a temperature fitted on rows left out of training calibrates the
score, and a threshold on it rejects.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

BUCKETS, SIZES, WIDTH = 1 << 15, (2, 3, 4), 16
#: Most labelled rows that training and calibration read, shared equally by the languages, the
#: longest text among them in characters (so that the sample is bounded in bytes; texts are
#: never cut, longer ones only aren't learned from), and the precision that accepted
#: predictions should have on the calibration rows.
SAMPLE, LONGEST, PRECISION = 4000, 20_000, 0.99
EPOCHS, RATE, SEED, CHUNK = 4, 4.0, 7, 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of the text's subwords, repeats included."""
    data = b" " + b" ".join(text.lower().encode().split()) + b" "
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    found = []
    for n in SIZES:
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint32(0x01000193)
            found.append((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(found)


def pieces(text: str):
    """The text in pieces of bounded memory."""
    return (text[i : i + CHUNK] for i in range(0, len(text), CHUNK))


@dataclass
class Model:
    """Languages, the logits that each bucket adds, their bias, temperature and threshold."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def raw(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for part in pieces(text):
            at = subwords(part)
            total += self.logits[at].sum(0, dtype=np.float64)
            n += len(at)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` with 0 for a text without a letter, or if nothing was learned."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        p = softmax(self.raw(text) / self.temperature)
        return self.langs[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(texts: list[str], labels: list[str]) -> Model:
    """Fit on rows in the given order; every fifth row is kept for calibration."""
    langs = sorted(set(labels))
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))
    fit, held = [], []
    for k, (text, label) in enumerate(zip(texts, labels)):
        words = text.split()
        if not LETTER.search(text):
            continue
        a = int(rng.integers(0, max(1, len(words) - 6)))
        for part in (text, " ".join(words[a : a + 6])):  # whole texts, and a few words of each for short texts
            if LETTER.search(part):
                at, n = np.unique(subwords(part), return_counts=True)
                (held if k % 5 == 0 else fit).append((part, at, n / n.sum(), number[label]))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fit)):
            _, at, share, y = fit[i]
            x = share @ table[at]
            g = softmax(x @ out + bias)
            g[y] -= 1
            back = out @ g
            out -= 0.1 * rate * np.outer(x, g)
            bias -= 0.01 * rate * g
            table[at] -= rate * share[:, None] * back
    model = Model(langs, (table @ out).astype(np.float32), bias)
    if held:
        z, y = np.array([model.raw(t) for t, *_ in held]), np.array([h[3] for h in held])
        score = lambda t: np.array([softmax(v / t) for v in z])
        loss = lambda t: -np.log(np.maximum(score(t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = min(np.geomspace(0.05, 10, 60).tolist(), key=loss)
        p = score(model.temperature)
        order = np.argsort(-p.max(1), kind="stable")
        right = np.cumsum(p.argmax(1)[order] == y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= PRECISION)
        model.threshold = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """At most SAMPLE labelled rows of up to LONGEST characters that aren't held out, about as many of each language, chosen by a hash of doc_id."""
    usable = docs.where("doc_id is not null and lang is not null and text is not null").where(F.length("text") <= LONGEST).where(~held_out(docs["doc_id"])).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()}
    if not counts:
        return usable.limit(0)
    each = SAMPLE // len(counts)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * each / n))))
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    return picked.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE)


def learn(docs: DataFrame) -> Model:
    """A model of the labels of ``docs``; none (no languages) if no row has one. Only the sample reaches the driver."""
    rows = sample(docs).collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted, one row for each row of ``docs``; no shuffle.

    The model, a table of BUCKETS rows with a float for each language, goes with the tasks.
    Whole texts count, however long. Of languages that tie the first by name is predicted;
    repeated rows are each predicted, and learned from, by itself. lang_pred is ``und`` with score 0 where the text is null or has no
    letter. Rows with a null doc_id aren't held out and aren't learned from. Labels are
    read for training alone.
    """
    model = model or learn(docs)

    def rows(doc_id: list, out: list, text: list) -> dict[str, list]:
        made = [model.predict(t) for t in text]
        return {"doc_id": doc_id, "held_out": out, "lang_pred": [a for a, _ in made], "score": [b for _, b in made], "accepted": [a != "und" and b >= model.threshold for a, b in made]}

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
    chosen = docs.select(docs["doc_id"].cast("long"), held_out(docs["doc_id"]).alias("held_out"), docs["text"])
    return map_rows(chosen, rows, schema, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")
