"""MinHash near-duplicates by bottom-k sketches of one hash function.

A text's set is its distinct shingles, as 64-bit hashes; equal sets count once. The K smallest
hashes are its sketch. Inverted lists of retained values find pairs, in four steps:

1. Of the K smallest hashes of two sets' union, one in both sets falls into both sketches. Sets
   that reach the share have at least ``least`` such values, but for one pair in a billion. So if
   values are ordered by how many sets retain them, some common value is among the rarest
   K - least + 1 of either sketch, and inverted lists of these meet every pair.
2. In a list of few sets, pairs whose union's sketch makes the share likely are joined; all sets
   of a longer list are. What is joined forms groups, outside of which nothing is linked.
3. Every group compares full sets, exactly, by an inverted index of its own. Groups beyond CHUNK
   shingles are split by size (linked sets are of like sizes) and hash; each chunk first compares
   its own sets with each other and with a few hubs.
4. What has not joined the largest component of such a group by then is compared with all its
   chunks of like size. So no linked pair in two components is left out, although sets that the
   largest component holds already are not compared with each other.

A task holds one chunk and one visitor at a time; what leaves it is a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dealt_join, hot_counts, map_rows, release, shingle_hashes
from .components import components

#: Values of a sketch, and how rarely two linked sets may have fewer of them in common than ``least``.
K, MISSED = 64, 1e-9
#: Sets of a list up to which its pairs are estimated.
SHORT = 64
#: Shingles compared in one task, and hubs of a larger group for each range of sizes.
CHUNK, HUBS = 1 << 17, 8
#: Rows of one value from which on they are dealt over several tasks.
HOT_VALUE = 4096

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@dataclass(frozen=True)
class Rule:
    """Which texts are linked: by runs of so many words, from so many hundredths of them in common on, and whether wordless texts are equal."""

    words: int = 3
    share: int = 85
    wordless: bool = False

    @cached_property
    def least(self) -> int:
        """How many of a union's K smallest values two linked sets have in common at least, but for one pair in 1 / MISSED."""
        p, rest, t = self.share / 100, 0.0, 0
        while (rest := rest + math.comb(K, t) * p**t * (1 - p) ** (K - t)) <= MISSED:
            t += 1
        return t

    @property
    def width(self) -> float:
        """How much the logarithms of sizes in one bucket differ: somewhat more than linked sets' may."""
        return math.log(100 / (self.share - 1))

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of the text's shingles."""
        return np.unique(shingle_hashes(text, self.words))

    def linked(self, both: np.ndarray | int, x: np.ndarray | int, y: np.ndarray | int) -> np.ndarray | bool:
        """Whether sets of sizes x and y with so many common shingles reach the share."""
        return 100 * both >= self.share * (x + y - both)

    def likely(self, x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
        """Whether two sketches (sorted, of sets of sizes nx and ny) allow the share; exact if both hold the whole sets."""
        both = np.sort(np.concatenate([x, y]))
        twice = both[1:] == both[:-1]
        if nx <= K and ny <= K:
            return bool(self.linked(int(twice.sum()), nx, ny))
        distinct = np.cumsum(np.r_[True, ~twice])
        return int((twice & (distinct[1:] <= K)).sum()) >= self.least


class Forest:
    """Components of small numbers; ``edges`` has those that joined two of them."""

    def __init__(self, n: int) -> None:
        self.up, self.edges = list(range(n)), []

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))


class Inverted:
    """An inverted index of some sets in memory, for exact sizes of intersections."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner, flat = owner[order], flat[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        self.values, self.start = flat[first], np.r_[first, len(flat)]

    def links(self, s: np.ndarray, rule: Rule) -> np.ndarray:
        """Numbers of the sets that are linked with ``s``."""
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        count = self.start[at + 1] - self.start[at]
        places = np.arange(count.sum()) + np.repeat(self.start[at] - np.r_[0, np.cumsum(count)[:-1]], count) if len(at) else np.zeros(0, np.int64)
        both = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & rule.linked(both, len(s), self.sizes))


def inner(sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Linked pairs of some sets that connect what all linked pairs do."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if rule.linked(both, len(sets[0]), len(sets[1])) else []
    index, forest = Inverted(sets), Forest(len(sets))
    for i, s in enumerate(sets):
        for j in index.links(s, rule).tolist():
            if j > i:
                forest.join(i, j)
    return forest.edges


def estimated(tids: list[int], sizes: list[int], sketches: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Likely pairs of one list that connect what all its likely pairs do."""
    order = sorted(range(len(tids)), key=sizes.__getitem__)
    forest = Forest(len(tids))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if 100 * sizes[i] < rule.share * sizes[j]:
                break
            if forest.top(i) != forest.top(j) and rule.likely(sketches[i], sketches[j], sizes[i], sizes[j]):
                forest.join(i, j)
    return [(tids[i], tids[j]) for i, j in forest.edges]


def pairs_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], schema=EDGES)


def sketched(docs: DataFrame, rule: Rule, mark: Callable[[str | None], int] | None = None) -> DataFrame:
    """doc_id, text_id, tid (a hash of the set), n (its size), the sketch and the text's mark, a row for each row of ``docs``.

    Without a word tid is null, unless wordless texts are equal. Without ``mark`` marks are null.
    """
    text_id = F.xxhash64(F.coalesce(docs["text"], F.lit("")))

    def rows(doc_id: list, text_id: list, text: list) -> dict[str, list]:
        sets = [rule.shingles(t) for t in text]
        return {
            "doc_id": doc_id,
            "text_id": text_id,
            "tid": [xxhash.xxh64_intdigest(s.tobytes(), 1) >> 1 if len(s) or rule.wordless else None for s in sets],
            "n": [len(s) for s in sets],
            "sketch": [s[:K].view(np.int64) for s in sets],
            "mark": [mark(t) if mark else None for t in text],
        }

    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("tid", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64())), ("mark", pa.int64())])
    return map_rows(docs.select(docs["doc_id"].cast("long"), text_id, docs["text"]), rows, schema, "doc_id bigint, text_id bigint, tid bigint, n bigint, sketch array<bigint>, mark bigint")


def prefixes(nodes: DataFrame, rule: Rule) -> DataFrame:
    """(value, tid): of each sketch the rarest retained values of which linked sets share one, without those that no other sketch retains."""
    values = nodes.select("tid", "n", F.explode("sketch").alias("value"))
    counts = checkpointed(values.groupBy("value").count().where(F.col("count") > 1))
    shared = dealt_join(values, counts, "value", hot_counts(counts, "value", HOT_VALUE))
    own = shared.groupBy("tid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("count", "value"))).alias("own"))  # at most K values
    size, whole = F.least("n", F.lit(K)), F.ceil(F.col("n") * rule.share / 100)
    least = F.when(F.col("n") * 100 < K * rule.share, whole).otherwise(F.least(whole, F.lit(rule.least)))
    room = (size - least + 1 - (size - F.size("own"))).cast("int")
    return own.where(room > 0).select("tid", F.explode(F.slice("own", F.lit(1), room)["value"]).alias("value"))


def groups(nodes: DataFrame, rule: Rule, proposed: DataFrame | None = None) -> DataFrame:
    """(tid, of) of the sets that may be linked with others: linked ones have the same ``of``, and so have the ends of ``proposed`` pairs (a, b)."""
    own = checkpointed(prefixes(nodes, rule))
    lists = checkpointed(own.groupBy("value").agg(F.count("*").alias("count"), F.min("tid").alias("least")).where(F.col("count") > 1))
    hot = hot_counts(lists.select("value", "count"), "value", HOT_VALUE)
    long = dealt_join(own, lists.where(F.col("count") > SHORT).select("value", "least"), "value", hot)
    joined = long.where("tid <> least").select(F.col("tid").alias("a"), F.col("least").alias("b")).distinct()
    short = own.join(lists.where(F.col("count") <= SHORT).select("value"), "value")
    short = short.groupBy("value").agg(F.sort_array(F.collect_list("tid")).alias("tids")).select("tids").distinct()  # at most SHORT sets
    short = short.select(F.xxhash64("tids").alias("list"), F.explode("tids").alias("tid")).join(nodes.select("tid", "n", "sketch"), "tid")
    short = short.groupBy("list").agg(F.collect_list(F.struct("tid", "n", "sketch")).alias("sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = batch.column(0), []
            tid, n, sketch = of.flatten().flatten()
            tid, n, end = tid.to_pylist(), n.to_pylist(), 0
            flat, cut = sketch.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(sketch.value_lengths().to_numpy())]
            for size in of.value_lengths().to_pylist():
                start, end = end, end + size
                found += estimated(tid[start:end], n[start:end], [flat[cut[k] : cut[k + 1]] for k in range(start, end)], rule)
            yield pairs_of(found)

    found = joined.unionByName(short.select("sets").mapInArrow(run, "a bigint, b bigint"))
    edges = checkpointed(found if proposed is None else found.unionByName(proposed))
    release(own, lists)
    found = components(edges)
    return edges.select(F.explode(F.array("a", "b")).alias("tid")).distinct().join(found, F.col("tid") == found["node"], "left").select("tid", F.coalesce("component", "tid").alias("of"))


def placed(nodes: DataFrame, rule: Rule, proposed: DataFrame | None = None) -> DataFrame:
    """(tid, of, big, bucket, parts, place, chunk): where each set of a group is compared. Big groups are split by size and hash."""
    found = checkpointed(groups(nodes, rule, proposed).join(nodes.select("tid", "n"), "tid"))
    bucket = F.floor(F.log(F.col("n").cast("double")) / rule.width).cast("int")
    sizes = found.groupBy("of").agg(F.sum("n").alias("all")).where(F.col("all") > CHUNK).select("of", F.lit(True).alias("big"))
    members = found.join(sizes, "of", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    members = members.withColumn("bucket", F.when(F.col("big"), bucket).otherwise(F.lit(0)))
    parts = members.where("big").groupBy("of", "bucket").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("parts"))
    members = members.join(parts, ["of", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    made = checkpointed(members.select("tid", "of", "big", "bucket", "parts", place().alias("place"), F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int").alias("chunk")))
    release(found)
    return made


def place() -> Column:
    return F.xxhash64("of", "bucket")


def with_sets(docs: DataFrame, members: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``members`` with the shingles of each as bytes; ``texts`` has one doc_id and text_id for each tid."""
    wanted = members.join(texts, "tid")
    text_id = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    found = docs.select(docs["doc_id"].cast("long").alias("own_id"), text_id.alias("own_text"), docs["text"].alias("text"))
    kept = found.join(wanted, found["own_id"].eqNullSafe(wanted["doc_id"]) & (found["own_text"] == wanted["text_id"])).dropDuplicates(["tid"])

    def rows(tid: list, text: list) -> dict[str, list]:
        return {"tid": tid, "shingles": [rule.shingles(t).tobytes() for t in text]}

    made = map_rows(kept.select("tid", "text"), rows, pa.schema([("tid", pa.int64()), ("shingles", pa.binary())]), "tid bigint, shingles binary")
    return checkpointed(made.join(members, "tid"))


def compared(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between each chunk's own sets, and between these and its guests.

    Where sets have a component already, only guests are held against own sets, of other components.
    """

    def run(table: pa.Table) -> pa.Table:
        tids, data, guest, component = (table.column(c).to_pylist() for c in ("tid", "shingles", "guest", "component"))
        own = [i for i, g in enumerate(guest) if not g]
        guests = [i for i, g in enumerate(guest) if g] if own else []
        sets = [np.frombuffer(data[i], np.uint64) for i in own]
        first = own and component[own[0]] is None
        found = [(own[i], own[j]) for i, j in inner(sets, rule)] if first else []
        index, forest = Inverted(sets) if guests else None, Forest(len(tids))
        for i in guests:
            for j in index.links(np.frombuffer(data[i], np.uint64), rule).tolist():
                if tids[i] != tids[own[j]] and (first or component[i] != component[own[j]]):
                    forest.join(i, own[j])
        found += forest.edges
        return pa.Table.from_batches([pairs_of([(tids[i], tids[j]) for i, j in found])])

    return rows.select("tid", "shingles", "guest", "component", "place", "chunk").groupBy("place", "chunk").applyInArrow(run, "a bigint, b bigint")


def visiting(guests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``guests`` once for each chunk of its group and of a like size. ``chunks``: place and how many pieces it has."""
    near = guests.drop("place", "parts", "chunk").withColumn("bucket", F.explode(F.array(*(F.col("bucket") + d for d in (-1, 0, 1))))).withColumn("place", place())
    counts = near.groupBy("place").count()
    out = dealt_join(near, chunks, "place", hot_counts(counts, "place", HOT_VALUE))
    return out.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")


def links(docs: DataFrame, nodes: DataFrame, rule: Rule, proposed: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of tids that reach the share and connect what all such pairs connect."""
    members = placed(nodes, rule, proposed)
    own = with_sets(docs, members, nodes.select("tid", "doc_id", "text_id"), rule)
    alone = own.select("tid", "shingles", "of", "big", "bucket", "place", "chunk", F.lit(False).alias("guest"), F.lit(None).cast("long").alias("component"))
    chunks = checkpointed(members.where("big").select("place", F.col("parts").alias("pieces")).distinct())
    if chunks.isEmpty():
        return checkpointed(compared(alone, rule))
    chosen = F.explode(F.array_distinct(F.array(*(F.min_by("tid", F.xxhash64("tid", F.lit(i))) for i in range(HUBS)))))
    hubs = own.where("big").join(members.where("big").groupBy("of", "bucket").agg(chosen.alias("tid")).select("tid"), "tid", "left_semi")
    guests = visiting(hubs, chunks).withColumns({"guest": F.lit(True), "component": F.lit(None).cast("long")})
    first = checkpointed(compared(alone.unionByName(guests.select(alone.columns)), rule))
    found = components(first)
    big = own.where("big").join(found, F.col("tid") == found["node"], "left").withColumn("component", F.coalesce("component", "tid")).drop("node")
    big = checkpointed(big)
    most = big.groupBy("of", "component").count().groupBy("of").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    rest = big.join(most, "of").where(F.col("component") != F.col("main")).drop("main").withColumn("guest", F.lit(True))
    second = visiting(rest, chunks).select(alone.columns).unionByName(big.withColumn("guest", F.lit(False)).select(alone.columns))
    return checkpointed(first.unionByName(compared(second, rule)))


def grouped(docs: DataFrame, rule: Rule, mark: Callable[[str | None], int] | None = None, propose: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_id, tid, n) of ``docs``, and for each tid its group: (tid, of, first).

    ``of`` is one tid of the group and ``first`` a struct of the group's smallest doc_id and the
    text that has it, null if no row of the group has a doc_id. ``propose`` makes pairs (a, b) of
    tids out of (tid, mark), whose whole sets are compared beside those that sketches find.
    """
    rows = checkpointed(sketched(docs, rule, mark))
    own = F.struct("doc_id", "text_id")
    each = rows.where("tid is not null").groupBy("tid").agg(F.min(own).alias("text"), F.min(F.when(F.col("doc_id").isNotNull(), own)).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("mark").alias("mark"))
    nodes = checkpointed(each.select("tid", "n", "sketch", "rep", "text.doc_id", "text.text_id", "mark"))
    proposed = propose(nodes.where("n > 0").select("tid", "mark")) if propose else None
    found = components(links(docs, nodes, rule, proposed))
    labels = nodes.select("tid", "rep").join(found, F.col("tid") == found["node"], "left").select("tid", "rep", F.coalesce("component", "tid").alias("of"))
    first = labels.groupBy("of").agg(F.min("rep").alias("first"))
    return rows.drop("sketch", "mark"), labels.join(first, "of").select("tid", "of", "first")


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of ``docs``.

    A text of fewer words than a shingle is one shingle; null and wordless texts have the empty
    set and are linked with nothing, not even each other. component_id is the smallest doc_id
    that links reach, through rows without a doc_id too, and null if they reach none. kept says
    that the row has that doc_id (both may be null). Repeated rows and rows that share a doc_id
    each have a row and are judged by their text; very long texts are compared whole. Sets are
    told apart by 63 bits of hash, shingles by 64. Only doc_id and text are read.
    """
    rows, labels = grouped(docs, rule)
    out = rows.join(labels, "tid", "left")
    component = F.when(F.col("tid").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def oracle(rule: Rule = Rule()) -> str:
    """DuckDB SQL for near_duplicates() over documents: every pair that shares a shingle, on whole shingles."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {words} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {rule.words} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {rule.words - 2}), lambda i: array_to_string(ws[i:i + {rule.words - 1}], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {rule.share} * (na.n + nb.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""
