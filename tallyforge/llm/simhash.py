"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some word lies within r bits of both.
So every distinct fingerprint stands for all words ("variants") within half the radius, and
fingerprints that meet in a variant are links. Variants with equal leading bits travel
together: a fingerprint is sent once to each of the prefixes that its 2081 variants have
(137 for radius 4 and 16 bits of prefix), and the receiving task lists the variants below
that prefix. The shuffle so carries a fifteenth of the rows, and meets the same variants.
Beyond a million fingerprints prefixes lengthen with their logarithm, so that each keeps
under some thousand rows; the rows of a fingerprint grow as that logarithm's square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import bounded_batches, checkpointed, free, map_rows, shingle_hashes
from .components import components

#: Least bits of prefix, the variants that one task lists at a time, and from how many rows on
#: a prefix is dealt over several tasks, each with a share of its variants.
PREFIX, TASK_VARIANTS, HOT_ROWS = 16, 4 << 20, 4096
#: Prefixes up to which the hot ones among them are broadcast, as two ints each.
BROADCAST_PREFIXES = 1 << 20
#: The bits of a byte as eight counters of a byte each.
SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; no words: zero."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    padded = np.zeros((-(-len(hashes) // 255) * 255, 8), np.uint8)
    padded[: len(hashes)] = hashes.view(np.uint8).reshape(-1, 8)  # counters of a byte hold 255 hashes
    counts = SPREAD[padded].reshape(-1, 255, 8).sum(1).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row."""

    def rows(doc_id: list, text: list) -> dict[str, list]:
        return {"doc_id": doc_id, "fp": [signed(fingerprint(t, width)) for t in text]}

    return map_rows(docs.select(docs["doc_id"].cast("long"), docs["text"]), rows, pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]), "doc_id bigint, fp bigint")


def flips(bits: int, most: int) -> list[int]:
    """Words of so many bits with at most ``most`` of them set."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def variants(fp: np.ndarray, bucket: np.ndarray, part: np.ndarray, parts: np.ndarray, half: int, prefix: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (variant, row): the variants that have the row's prefix and fall into its part."""
    low = 64 - prefix
    far = np.bitwise_count((fp >> np.uint64(low)) ^ bucket)
    base = (bucket << np.uint64(low)) | (fp & np.uint64((1 << low) - 1))
    for d in range(half + 1):
        masks = np.array(flips(low, half - d), np.uint64)
        at = np.flatnonzero(far == d)
        step = max(1, (1 << 19) // len(masks))
        for k in range(0, len(at), step):
            own = at[k : k + step]
            v, row = (base[own, None] ^ masks).ravel(), np.repeat(own, len(masks))
            if (n := parts[row].astype(np.uint64)).max() > 1:
                v, row = v[keep := mixed(v) % n == part[row].astype(np.uint64)], row[keep]
            yield v, row


def forest(node: np.ndarray, hub: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges, each tree a star at its smallest node."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for a, b in zip(node.tolist(), hub.tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in up]


def meet(fp: np.ndarray, rep: np.ndarray, bucket: np.ndarray, part: np.ndarray, parts: np.ndarray, radius: int, prefix: int) -> list[tuple[int, int]]:
    """Links between the rows of a task that share a variant, checked bit by bit."""
    if not len(fp):
        return []
    v, row = map(np.concatenate, zip(*variants(fp, bucket, part, parts, radius // 2, prefix)))
    ordered = np.sort(v)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return []
    at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
    v, row = v[here := shared[at] == v], row[here]
    order = np.lexsort((rep[row], v))
    v, row = v[order], row[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    hub = np.repeat(row[first], np.diff(np.r_[first, len(v)]))
    close = np.bitwise_count(fp[row] ^ fp[hub]) <= radius
    pairs = np.unique(np.stack([rep[row], rep[hub]], 1)[close & (row != hub)], axis=0)
    return forest(pairs[:, 0], pairs[:, 1])


def links(reps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs within ``radius`` bits do.

    ``reps``: distinct fp, each with a number rep of its own. radius is even. A prefix that
    many fingerprints share is dealt over several tasks, each with a share of its variants.
    """
    half = radius // 2
    bounded_batches(reps.sparkSession)
    n = reps.count()
    prefix = min(30, max(PREFIX, n.bit_length() - 4))
    top = F.shiftrightunsigned("fp", 64 - prefix)
    sent = reps.select("fp", "rep", F.explode(F.array(*(F.lit(m) for m in flips(prefix, half)))).alias("flip"))
    sent = sent.select("fp", "rep", top.bitwiseXOR(F.col("flip")).cast("int").alias("bucket"))
    hot = sent.groupBy("bucket").count().where(F.col("count") > HOT_ROWS).select("bucket", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("parts"))
    few = 1 << prefix <= BROADCAST_PREFIXES
    sent = sent.join(F.broadcast(hot) if few else hot, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = max(12, n * len(flips(64, half)) // TASK_VARIANTS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in range(5)] for b in batches if b.num_rows]
        if got:
            fp, rep, bucket, part, parts = map(np.concatenate, zip(*got))
            pairs = meet(fp.view(np.uint64), rep, bucket.astype(np.uint64), part, parts, radius, prefix)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return sent.repartition(tasks, "bucket", "part").select("fp", "rep", "bucket", "part", "parts").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of ``docs``.

    A null or wordless text has fingerprint zero and links like any other; a text of fewer
    words than ``width`` is one shingle. Equal texts have equal fingerprints, so groups of
    copies count once when variants are listed. component_id is the smallest doc_id that
    links reach (null if the group has no doc_id at all). Repeated rows each have a row; very
    long texts are hashed whole; ties of bits leave a bit unset. No columns but doc_id and
    text are read.
    """
    fps = checkpointed(fingerprints(docs, width))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(reps.where("rep is not null"), radius))
    label = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(label, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: What near copies have in common: four fifths of their five-word shingles. Wordless texts are copies of each other.
NEAR = minhash.Rule(words=5, share=80, wordless=True)


def alike(a: str | None, b: str | None) -> bool:
    """Whether two texts have the share of all their distinct shingles in common; wordless texts are alike."""
    x, y = NEAR.shingles(a), NEAR.shingles(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(NEAR.linked(both, len(x), len(y))) if len(x) and len(y) else not len(x) and not len(y)


def marked(text: str | None) -> int:
    """A text's fingerprint as a signed long."""
    return signed(fingerprint(text))


def proposed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of tids that connect what fingerprints (tid, mark) within four bits of each other connect, by ball hashing; each once."""
    reps = checkpointed(nodes.groupBy(F.col("mark").alias("fp")).agg(F.min("tid").alias("rep")))
    equal = nodes.join(reps, nodes["mark"] == reps["fp"]).where("tid <> rep").select(F.col("tid").alias("a"), F.col("rep").alias("b"))
    return checkpointed(links(reps).distinct().unionByName(equal))  # many prefixes find the same pair


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """minhash.grouped() of the texts that are alike; fingerprints and sketches propose, whole sets decide."""
    return minhash.grouped(docs, NEAR, marked, proposed)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of groups whose texts are alike, one row for each row of ``docs``.

    Fingerprints within four bits are candidates, found by ball hashing. At four fifths of
    shingles in common most fingerprints are further apart; bottom-k sketches find these. What
    either finds is compared on whole sets of shingles. Equal texts count once. Null and wordless texts are one group; rows without a doc_id are in their text's group, and
    component_id is null where no row of a group has a doc_id.
    """
    rows, labels = grouped(docs)
    return rows.join(labels, "tid").select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of similar(), the one with the smallest doc_id, all columns as they are.

    What stays is decided by doc_id and text together, so a doc_id that two texts share loses
    neither's group. Of rows that repeat both, one stays, whichever. Null and wordless texts
    are one group, very long texts are compared whole, rows without a doc_id stay.
    """
    doc_id, text_id = free(docs, "kept_doc_id"), free(docs, "kept_text_id")
    _, labels = grouped(docs)
    first = labels.select("of", "first").distinct().where("first is not null").select(F.col("first.doc_id").alias(doc_id), F.col("first.text_id").alias(text_id))
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    found = docs.join(first, (docs["doc_id"] == first[doc_id]) & (text_hash == first[text_id]))
    return found.dropDuplicates([doc_id, text_id]).drop(doc_id, text_id).unionByName(docs.where(docs["doc_id"].isNull()))
