"""Substring deduplication: fuzzy passages by collinear chaining.

Texts share seeds: hashes of four words, of which only the smallest of any eight in a row
are kept, so every common run of eleven words has one. Joining seeds gives matches of word
positions. For each pair of texts the matches are chained in order, where gaps cost, by
dynamic programming over a Fenwick tree; chains are aligned word by word, and those of
fifty words or more with four fifths of them equal are passages.

A seed that many texts share links each of them to the first text that has it, so a passage
in n texts makes n - 1 pairs and no group is ever paired out. Seeds that a few texts in a
sample show to be very frequent are dealt over several tasks, each with a first text of its
own, and those are linked to the first of all. Where the seeds of a text run on for a
passage but scatter over texts that hold only parts of it, a second round joins runs of
three seeds instead, so that texts meet in the first one that has the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, hot_counts, hot_keys, map_rows

SEED_WORDS, WINDOW = 4, 8
LEAST_WORDS, LEAST_SHARE = 50, 0.8
#: What a match adds to a chain, what a word of gap takes, the widest gap, and how far an end is extended.
GAIN, GAP, WIDEST, REACH = 5.0, 0.1, 40, 48
#: Matches that a chain has at least, and seeds that make a key of the second round.
LEAST_MATCHES, RUN = 3, 3
#: Words' hashes, and hashes of texts already read in this partition, that a task remembers.
CACHE_WORDS, CACHE_TEXTS = 200_000, 200_000
#: One text in SAMPLE tells which seeds are hot: those with over HOT of its rows, and more than
#: one in MOST_HOT, so that no more than MOST_HOT seeds are and their table may be broadcast.
SAMPLE, HOT = 64, 64
#: Texts with a chain up to which their ids are broadcast (16 bytes each) to find the texts.
BROADCAST_TEXTS = 1_000_000
SPACE = r"[\x20\x09-\x0D]+"

ANCHORS = "tid bigint, hub bigint, x int, y int, seed bigint"


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The smallest or largest of every ``width`` values in a row."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = best(x[:-step], x[step:])
        span += step
    return x


class Seeds:
    """Seeds of texts, with a memory of words' hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and word positions; a text of fewer than LEAST_WORDS words holds no passage and has none."""
        words = (text or "").encode().lower().split()
        if len(words) < LEAST_WORDS:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        get, put, digest = self.known.get, self.known.setdefault, xxhash.xxh64_intdigest
        h = np.array([get(w) or put(w, digest(w)) for w in words], np.uint64)
        k = folded(h, SEED_WORDS)
        least = sliding(k, WINDOW, np.minimum)
        pad = np.zeros(WINDOW - 1, np.uint64)
        at = np.flatnonzero(sliding(np.r_[pad, least, pad], WINDOW, np.maximum) == k)
        return thinned(k[at], at)


def thinned(k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one seed's places that follow each other within WINDOW words, as in a word said on and on, one for every WINDOW words."""
    order = np.lexsort((at, k))
    k, at = k[order], at[order]
    start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (at[1:] - at[:-1] >= WINDOW)]) if len(at) else np.zeros(0, np.int64)
    step = (at - np.repeat(at[start], np.diff(np.r_[start, len(at)]))) // WINDOW
    keep = np.r_[True, step[1:] != step[:-1]] if len(at) else np.zeros(0, bool)
    keep[start] = True
    keep = order[keep]
    keep.sort()
    back = np.argsort(order)
    return k[back][keep], at[back][keep]


def folded(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` hashes in a row."""
    n = len(h) - width + 1
    k = np.zeros(n, np.uint64)
    for i in range(width):
        k = (k ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(32)
    return k


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and tid, a hash of the text: equal texts are one."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("tid"))


def seeds(texts: DataFrame) -> DataFrame:
    """(seed, tid, at) of all texts; of copies that one task reads nearby only the first has rows."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, read = Seeds(), set()
        for batch in batches:
            tids, made = [], []
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tid not in read:
                    tids.append(tid)
                    made.append(maker.of(text))
                    read.add(tid)
            if len(read) > CACHE_TEXTS:
                read.clear()
            if made:
                tid = np.repeat(np.array(tids, np.int64), [len(a) for a, _ in made])
                yield pa.RecordBatch.from_pydict({"seed": np.concatenate([a for a, _ in made]).view(np.int64), "tid": tid, "at": np.concatenate([b for _, b in made]).astype(np.int32)})

    return texts.select("tid", "text").mapInArrow(run, "seed bigint, tid bigint, at int")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of runs of whole groups; rows come sorted by their first ``keys`` columns.

    What is held is a batch and one group.
    """
    rest: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if not len(cols[0]):
            continue
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:keys]], 0)) + 1
        first = [c[0] for c in cols[:keys]]
        if rest and [c[-1] for c in rest[-1][:keys]] != first:
            yield [np.concatenate(c) for c in zip(*rest)]
            rest = []
        if len(new):
            cut = new[-1]
            yield [np.concatenate([*(r[i] for r in rest), c[:cut]]) for i, c in enumerate(cols)]
            rest = [[c[cut:] for c in cols]]
        else:
            rest.append(cols)
    if rest:
        yield [np.concatenate(c) for c in zip(*rest)]


def meet(seed: np.ndarray, part: np.ndarray, tid: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Matches between the texts of each (seed, part) and the first text there; rows are sorted by seed, part, tid and at.

    A text's k-th place of a seed is matched with the first text's k-th from the start and
    from the end, or its last and first if it has fewer, so repeats cost two rows a place.
    The first text's own places are rows as well, matched with themselves.
    """
    n = len(seed)
    new = np.r_[True, (seed[1:] != seed[:-1]) | (part[1:] != part[:-1])]
    text = np.r_[True, new[1:] | (tid[1:] != tid[:-1])]
    group, run = np.cumsum(new) - 1, np.cumsum(text) - 1
    start, run_start = np.flatnonzero(new), np.flatnonzero(text)
    run_size = np.diff(np.r_[run_start, n])
    places = run_size[run[start]]  # of the first text
    shared = np.diff(np.r_[start, n]) > places
    rank = np.arange(n) - run_start[run]
    back = run_size[run] - 1 - rank
    keep = shared[group]
    hub = tid[start][group]
    own = hub == tid
    last = places[group] - 1
    y1 = at[start[group] + np.where(own, rank, np.minimum(rank, last))]
    y2 = at[start[group] + np.where(own, rank, np.maximum(last - back, 0))]
    two = keep & (y1 != y2)
    rows = np.r_[np.flatnonzero(keep), np.flatnonzero(two)]
    return {"tid": tid[rows], "hub": hub[rows], "x": at[rows], "y": np.r_[y1[keep], y2[two]], "seed": seed[rows]}


def matches(found: DataFrame, sampled: DataFrame) -> DataFrame:
    """(tid, hub, x, y, seed): positions at which texts share seeds with the first text that has them.

    One exchange of ``found`` (seed, tid, at). Seeds that ``sampled``, the rows of one text in
    SAMPLE, shows to be hot are dealt by text over several tasks; the first texts of these,
    picked out of the same exchange, are linked to the first of all.
    """
    hot = hot_keys(sampled, "seed", HOT)
    part = F.coalesce(F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    dealt = found.join(F.broadcast(hot), "seed", "left").select("seed", part, "tid", "at", F.col("parts").isNotNull().cast("int").alias("hot")).repartition("seed", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in groups(batches, 2):
            yield pa.RecordBatch.from_pydict(meet(*cols[:4]))

    linked = dealt.sortWithinPartitions("seed", "part", "tid", "at").mapInArrow(run, ANCHORS)
    if hot.isEmpty():
        return linked

    def only_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch.column(4).to_numpy() == 1)).select(["seed", "part", "tid", "at"])

    # in Arrow, as a filter of Spark's would be pushed below the exchange, which then isn't the same
    few = dealt.mapInArrow(only_hot, "seed bigint, part int, tid bigint, at int")
    firsts = few.groupBy("seed", "part").agg(F.min(F.struct("tid", "at")).alias("first"))
    all_firsts = firsts.groupBy("seed").agg(F.min("first").alias("hub"))
    up = firsts.join(all_firsts, "seed").where("first.tid <> hub.tid")
    return linked.unionByName(up.select(F.col("first.tid").alias("tid"), F.col("hub.tid").alias("hub"), F.col("first.at").alias("x"), F.col("hub.at").alias("y"), "seed"))


def best_chain(xs: list[int], ys: list[int]) -> list[int]:
    """Indexes of the best chain: x and y both rise, a match adds GAIN, each word between two costs GAP.

    ``xs`` doesn't fall. The Fenwick tree holds, by rank of y, the best score so far with
    the chain's own place added back, so that the cost of a gap needs no second look.
    """
    rank = {y: i for i, y in enumerate(sorted(set(ys)), 1)}
    tree: list[tuple[float, int]] = [(-1.0, -1)] * (len(rank) + 1)
    score, before = [0.0] * len(xs), [-1] * len(xs)
    i = 0
    while i < len(xs):
        j = i
        while j < len(xs) and xs[j] == xs[i]:  # equal x: none may follow another
            r, top = rank[ys[j]] - 1, (-1.0, -1)
            while r:
                top = max(top, tree[r])
                r &= r - 1
            carried = top[0] - GAP * (xs[j] + ys[j])
            score[j], before[j] = (GAIN + carried, top[1]) if top[1] >= 0 and carried > 0 else (GAIN, -1)
            j += 1
        for m in range(i, j):
            r, entry = rank[ys[m]], (score[m] + GAP * (xs[m] + ys[m]), m)
            while r <= len(rank):
                tree[r] = max(tree[r], entry)
                r += r & -r
        i = j
    at, chain = max(range(len(xs)), key=score.__getitem__), []
    while at >= 0:
        chain.append(at)
        at = before[at]
    return chain[::-1]


def clusters(anchors: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The sorted matches, by which of them may stand in one part of a chain, directly or through others.

    Single matches are left out. Parts of chains don't cross clusters, so each is chained alone.
    """
    up = list(range(len(anchors)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, (x, y) in enumerate(anchors):
        for j in range(i + 1, len(anchors)):
            dx, dy = anchors[j][0] - x, anchors[j][1] - y
            if dx > WIDEST:
                break
            if dx > 0 and 0 < dy <= WIDEST and GAP * (dx + dy) < GAIN:
                up[top(j)] = top(i)
                if dx == dy:  # what follows on this diagonal is linked from there
                    break
    found: dict[int, list[tuple[int, int]]] = {}
    for i, pair in enumerate(anchors):
        found.setdefault(top(i), []).append(pair)
    return [c for c in found.values() if len(c) > 1]


def chains(anchors: list[tuple[int, int]], least: int = 2) -> list[list[tuple[int, int]]]:
    """Chains of ``least`` or more matches, best first in each cluster, each cut at gaps over WIDEST.

    A part uses up the matches inside it in both texts; those in a bridged gap, single ones
    and passages in another order are left for further chains.
    """
    out = []
    waiting = clusters(sorted(anchors))
    while waiting:
        left = waiting.pop()
        if len(left) < least:
            continue
        best = [left[i] for i in best_chain([a for a, _ in left], [b for _, b in left])]
        if len(best) < 2:
            continue
        parts = [[best[0]]]
        for a, b in zip(best, best[1:]):
            if b[0] - a[0] > WIDEST or b[1] - a[1] > WIDEST:
                parts.append([])
            parts[-1].append(b)
        found = [c for c in parts if len(c) > 1]
        out += [c for c in found if len(c) >= least]
        boxes = [(c[0], c[-1]) for c in found] or [(best[0], best[0])]
        waiting += clusters([(x, y) for x, y in left if not any(p[0] <= x <= q[0] and p[1] <= y <= q[1] for p, q in boxes)])
    return out


def common(a: list[bytes], b: list[bytes]) -> int:
    """Words of a longest common subsequence."""
    if a == b:
        return len(a)
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def extension(a: list[bytes], b: list[bytes]) -> int:
    """How many words two runs go on together, over single other words: +1 a match, -2 a mismatch, until 5 below the best."""
    score = best = length = 0
    for i, (x, y) in enumerate(zip(a, b), 1):
        score += 1 if x == y else -2
        if score > best:
            best, length = score, i
        if score < best - 5:
            break
    return length


def align(a: list[bytes], b: list[bytes], chain: list[tuple[int, int]]) -> tuple[int, int, int, int, int]:
    """Spans [a0, a1) and [b0, b1) of the chain's passage, ends extended, and how many words are equal."""
    (a0, b0), same = chain[0], 0
    i, j = a0, b0
    for x, y in [*chain[1:], (chain[-1][0] + SEED_WORDS, chain[-1][1] + SEED_WORDS)]:
        if x > i and y > j:
            same += common(a[i:x], b[j:y])
        i, j = max(i, x), max(j, y)
    n = extension(a[max(0, a0 - REACH) : a0][::-1], b[max(0, b0 - REACH) : b0][::-1])
    m = extension(a[i : i + REACH], b[j : j + REACH])
    same += sum(map(bytes.__eq__, a[a0 - n : a0], b[b0 - n : b0])) + sum(map(bytes.__eq__, a[i : i + m], b[j : j + m]))
    return a0 - n, i + m, b0 - n, j + m, same


def scattered(at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of the second round: RUN seeds in a row, where shared seeds go on for a passage."""
    order = np.argsort(at, kind="stable")
    at, seed = at[order], seed[order]
    new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    at, seed = at[new], seed[new].view(np.uint64)
    ends = np.flatnonzero(np.r_[at[1:] - at[:-1] > WINDOW, True]) + 1 if len(at) else np.zeros(0, np.int64)
    keys, places, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for end in ends.tolist():
        if end - start >= RUN and at[end - 1] - at[start] + SEED_WORDS + 2 * WINDOW >= LEAST_WORDS:
            keys.append(folded(seed[start:end], RUN))
            places.append(at[start : end - RUN + 1])
        start = end
    return np.concatenate(keys), np.concatenate(places)


def chained(anchors: DataFrame, again: bool) -> DataFrame:
    """(tid, hub, xs, ys, keys): the chains of each pair of texts that can become a passage, keys null.

    If ``again``, rows with hub null have what a second round starts from: keys of runs of
    seeds in ys' stead and their positions xs, where a text's shared seeds are in no chain
    that is about as long as a passage. A text's matches, at most two for each of its seeds,
    meet in one task.
    """
    schema = pa.schema([("tid", pa.int64()), ("hub", pa.int64()), ("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64()))])

    def text(tid: int, hub: np.ndarray, x: np.ndarray, y: np.ndarray, seed: np.ndarray) -> Iterator[tuple]:
        covered = np.zeros(len(x), bool)
        ends = np.flatnonzero(np.r_[hub[1:] != hub[:-1], True]) + 1
        start = 0
        for end in ends.tolist():
            if hub[start] != tid and end - start >= LEAST_MATCHES:
                pairs = sorted(set(zip(x[start:end].tolist(), y[start:end].tolist())))
                for c in chains(pairs, LEAST_MATCHES):
                    yield tid, hub[start], [p[0] for p in c], [p[1] for p in c], None
                    if c[-1][0] - c[0][0] + SEED_WORDS + 2 * WINDOW >= LEAST_WORDS:
                        covered |= (x >= c[0][0]) & (x <= c[-1][0])
            start = end
        if again:
            keys, places = scattered(x[~covered], seed[~covered])
            if len(keys):
                yield tid, None, places.tolist(), None, keys.view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tid, *cols in groups(batches, 1):
            ends = np.flatnonzero(np.r_[tid[1:] != tid[:-1], True]) + 1
            for step in range(0, len(ends), 2000):
                some = ends[step : step + 2000].tolist()
                start, made = int(ends[step - 1]) if step else 0, []
                for end in some:
                    made += text(int(tid[start]), *(c[start:end] for c in cols))
                    start = end
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    return anchors.repartition("tid").sortWithinPartitions("tid", "hub", "x", "y").mapInArrow(run, "tid bigint, hub bigint, xs array<int>, ys array<int>, keys array<bigint>")


def candidates(docs: DataFrame) -> DataFrame:
    """(tid, hub, xs, ys): chains of both rounds; ``docs`` has tid and text."""
    sampled = seeds(docs.where(F.pmod("tid", F.lit(SAMPLE)) == 0))
    first = checkpointed(chained(matches(seeds(docs), sampled), again=True))
    left = first.where("hub is null").select("tid", F.explode(F.arrays_zip("keys", "xs")).alias("k")).select(F.col("k.keys").alias("seed"), "tid", F.col("k.xs").alias("at"))
    second = chained(matches(left, left.where(F.pmod("tid", F.lit(SAMPLE)) == 0)), again=False)
    return checkpointed(first.where("hub is not null").unionByName(second).select("tid", "hub", "xs", "ys").distinct())


def sliced(chains: DataFrame, texts: DataFrame, key: str, at: str) -> DataFrame:
    """``chains`` with the doc_id of their text ``key`` and the words around positions ``at``, in lower case.

    A text's chains travel to it together, so it is split once; those of texts with very many
    are dealt over several tasks.
    """
    fields = [c for c in chains.columns if c != key]
    own = texts.withColumnRenamed("tid", key).withColumnRenamed("doc_id", f"{key}_doc")
    hot = hot_keys(chains, key, HOT * 16)

    def cut(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
        grouped = rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("chains"))
        words = F.split(F.btrim(F.lower("text"), F.lit(" \t\n\v\f\r")), SPACE)
        spread = grouped.join(other, keys).select(f"{key}_doc", words.alias("words"), "chains").select(f"{key}_doc", "words", F.explode("chains").alias("c"))
        first = F.greatest(F.get(f"c.{at}", F.lit(0)) - REACH, F.lit(0))
        found = F.slice("words", first + 1, F.element_at(f"c.{at}", -1) + SEED_WORDS + REACH - first)
        return spread.select(f"{key}_doc", "c.*", F.array_join(found, " ").alias(f"{at}_words"))

    if hot.isEmpty():
        return cut(chains, own, [key])
    plain = chains.join(F.broadcast(hot.select(key)), key, "left_anti")
    dealt = chains.join(F.broadcast(hot), key).withColumn("part", F.pmod(F.xxhash64(*fields), F.col("parts")).cast("int")).drop("parts")
    copied = own.join(F.broadcast(hot), key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return cut(plain, own, [key]).unionByName(cut(dealt, copied, [key, "part"]))


def words_in(text: str) -> F.Column:
    return F.size(F.split(F.btrim(text, F.lit(" \t\n\v\f\r")), SPACE))


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tid, doc_id, rows): the smallest doc_id of each text and how many rows have both, and (doc_id, other_id, n) of every further one.

    Copies are counted before any join, so only texts that have some take part, and only
    these are split into words; the most copied ones are joined where their rows are.
    """
    ids = checkpointed(docs.where(F.length("text") >= 2 * LEAST_WORDS - 1).groupBy("tid", "doc_id").agg(F.count("*").alias("rows")))
    reps = checkpointed(ids.groupBy("tid").agg(F.min(F.struct("doc_id", "rows")).alias("first"), F.count("*").alias("size")))
    reps = reps.select("tid", F.col("first.doc_id").alias("rep"), F.col("first.rows").alias("rows"), "size")
    many = reps.where("size > 1")
    wanted = many.select("tid", F.col("rep").alias("doc_id"))
    few = many.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    sized = docs.join(F.broadcast(wanted) if few else wanted, ["tid", "doc_id"], "left_semi").select("tid", "doc_id", words_in("text").alias("n"))
    many = checkpointed(many.select("tid", "rep", "size").join(sized.where(F.col("n") >= LEAST_WORDS).select("tid", "n").distinct(), "tid"))
    hot = hot_counts(many.select("tid", F.col("size").alias("count")), "tid", HOT * SAMPLE).select("tid")
    most = F.broadcast(many.join(F.broadcast(hot), "tid", "left_semi").select("tid", "rep", "n"))
    rest = ids.join(F.broadcast(hot), "tid", "left_anti").join(many.select("tid", "rep", "n"), "tid")
    found = ids.join(most, "tid").unionByName(rest).where("doc_id <> rep")
    return reps.select("tid", F.col("rep").alias("doc_id"), "rows"), found.select("doc_id", F.col("rep").alias("other_id"), "n")


def passages(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, other_id, start, end, other_start, other_end, n_equal) of passages in two documents, in words.

    Equal texts of LEAST_WORDS words or more give one row for each further copy, from the
    first to the last word, against the smallest doc_id that has the text; every other row
    is between two such smallest doc_ids. Null, empty and shorter texts have no passage;
    repeated rows count once. Of texts that tie for the first with a seed there is none, as
    the hash of the text orders them; a passage that a text has twice gives a row for each
    place, against the other's nearest in order. Passages within one text are no rows. Very
    long texts are read whole. Rows without a doc_id are left out. No column but doc_id and
    text is read.
    """
    docs = keyed(docs.where("doc_id is not null and text is not null"))
    reps, others = copies(docs)
    others = others.select("doc_id", "other_id", F.lit(0).alias("start"), F.col("n").alias("end"), F.lit(0).alias("other_start"), F.col("n").alias("other_end"), F.col("n").alias("n_equal"))

    found = candidates(docs)
    needed = checkpointed(found.select("tid").unionByName(found.select(F.col("hub").alias("tid"))).distinct().join(reps, "tid"))
    few = needed.count() <= BROADCAST_TEXTS
    texts = docs.join(F.broadcast(needed.select("tid", "doc_id")) if few else needed.select("tid", "doc_id"), ["tid", "doc_id"], "left_semi").select("tid", "doc_id", "text")
    if not needed.where("rows > 1").isEmpty():
        texts = texts.dropDuplicates(["tid"])
    once = sliced(found, texts, "tid", "xs").withColumnRenamed("tid_doc", "doc_id")
    both = sliced(once, texts, "hub", "ys").select("doc_id", F.col("hub_doc").alias("other_id"), "xs", "ys", "xs_words", "ys_words")

    def rows(doc_id: list, other_id: list, xs: list, ys: list, a: list, b: list) -> dict[str, list]:
        out: list[list] = [[] for _ in range(7)]
        for t, h, x, y, p, q in zip(doc_id, other_id, xs, ys, a, b):
            ox, oy = max(x[0] - REACH, 0), max(y[0] - REACH, 0)
            a0, a1, b0, b1, same = align(p.encode().split(b" "), q.encode().split(b" "), [(i - ox, j - oy) for i, j in zip(x, y)])
            if a1 - a0 >= LEAST_WORDS and same >= LEAST_SHARE * max(a1 - a0, b1 - b0):
                for column, value in zip(out, (t, h, a0 + ox, a1 + ox, b0 + oy, b1 + oy, same)):
                    column.append(value)
        return dict(zip(("doc_id", "other_id", *names), out))

    names = ("start", "end", "other_start", "other_end", "n_equal")
    schema = pa.schema([("doc_id", pa.int64()), ("other_id", pa.int64()), *((n, pa.int32()) for n in names)])
    aligned = map_rows(both, rows, schema, "doc_id bigint, other_id bigint, start int, end int, other_start int, other_end int, n_equal int")
    return aligned.unionByName(others)
