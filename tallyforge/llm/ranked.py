"""Ranked lexical search over a two-level quantised index.

A posting's share of a score is its term's weight times an integer impact below a million that
depends on the document alone. The first level of the index holds the impact rounded up to a
byte, so that the sum of weights times bytes bounds a score from above, and from below if each
byte is one less. The second level holds the counts from which impacts are exact. Each task
searches the documents it has: it keeps, for each query, the k highest lower bounds seen so
far, and only documents whose upper bound reaches the least of these are scored exactly, in
64-bit integers. A task hands on its k best rows a query, and these are ranked again.

Only terms that some query asks for are indexed. Queries come in blocks of bounded size, so a
block's terms and weights fit in every task; documents are never gathered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

#: Rows returned for each query.
K = 20
#: Queries and bytes of query text in one block.
BLOCK_QUERIES, BLOCK_BYTES = 1024, 4 << 20
#: What a byte stands for: impacts are under 255 of these.
STEP = -(-1_000_000 // 255)
#: Documents bounded at a time, and postings of these at most.
DOCS, POSTINGS = 128, 1 << 14
#: Pairs that wait to be scored exactly.
WAITING = 1 << 14
#: Parts in which tasks' rows of one query are first ranked.
PARTS = 64

KEPT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
INDEX = "doc_id bigint, n bigint, terms array<int>, counts array<int>"


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode().translate(KEPT).split()


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The second level: doc_id, n (its terms with repeats), the vocabulary's terms in it and their counts; texts without a term have no row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, ids, counts = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if found := terms(text):
                    tf = Counter(found)
                    known = sorted((vocabulary[t], c) for t, c in tf.items() if t in vocabulary)
                    rows.append(k)
                    n.append(len(found))
                    ids.append([i for i, _ in known])
                    counts.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "counts"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, INDEX)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The exact impact of terms that occur ``tf`` times in documents of ``n`` terms."""
    m = 75 + (25 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list starts, with the end."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def quantised(index: DataFrame, documents: int, length: int) -> DataFrame:
    """Both levels: what counted() gives, and ``bytes``, the impacts rounded up to multiples of STEP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf, starts = lists(batch.column(3))
            f = impacts(tf, np.repeat(batch.column(1).to_numpy(), np.diff(starts)), documents, length)
            up = (-(-f // STEP)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([up[a:b] for a, b in zip(starts, starts[1:])], pa.binary())], names=[*batch.schema.names, "bytes"])

    return index.mapInArrow(run, INDEX + ", bytes binary")


@dataclass
class Searcher:
    """The search of one task. ``weights``: for each term (row) and query (column) weight times occurrences in the query."""

    weights: np.ndarray
    documents: int
    length: int
    k: int

    def __post_init__(self) -> None:
        queries = self.weights.shape[1]
        self.floats = self.weights.astype(np.float64)  # sums stay far below 2**53
        self.lower = np.zeros((queries, self.k))
        self.best: list[list[tuple[int, float, int | None]]] = [[] for _ in range(queries)]
        self.waiting: list[tuple] = []
        self.pairs = self.scored = 0

    def add(self, doc_ids: list, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, up: np.ndarray, starts: np.ndarray) -> None:
        """Bound some documents, each with one term or more; ``starts`` has where each one's postings start, and the end."""
        own = self.floats[terms]
        matched = np.add.reduceat(own, starts[:-1], axis=0)
        own *= up[:, None]
        upper = np.add.reduceat(own, starts[:-1], axis=0)
        lower = np.maximum(upper - matched, 0) * STEP
        upper *= STEP
        queries = np.flatnonzero((lower > self.lower.min(1)).any(0))
        if len(queries):
            both = np.concatenate([self.lower[queries], lower[:, queries].T], axis=1)
            self.lower[queries] = np.partition(both, -self.k, axis=1)[:, -self.k :]
        reach = (upper > 0) & (upper >= self.lower.min(1))
        for d in np.flatnonzero(reach.any(1)):
            at = slice(starts[d], starts[d + 1])
            asked = np.flatnonzero(reach[d])
            self.waiting.append((doc_ids[d], n[d], terms[at], counts[at], asked, upper[d, asked]))
            self.pairs += len(asked)
        if self.pairs > WAITING:
            self.score()

    def score(self) -> None:
        """Score the waiting documents exactly for queries whose kth lower bound they still reach; each query keeps its k best."""
        least, touched = self.lower.min(1), set()
        for doc_id, n, terms, counts, asked, upper in self.waiting:
            asked = asked[upper >= least[asked]]
            if len(asked):
                f = impacts(counts, n, self.documents, self.length)
                self.scored += len(asked)
                order = (doc_id is None, doc_id or 0)
                for q, s in zip(asked.tolist(), (self.weights[np.ix_(terms, asked)] * f[:, None]).sum(0).tolist()):
                    if s > 0:
                        self.best[q].append((-s, order, doc_id))
                        touched.add(q)
        for q in touched:
            self.best[q] = sorted(self.best[q], key=lambda x: x[:2])[: self.k]
            if len(self.best[q]) == self.k:  # exact scores are lower bounds too
                self.lower[q] = np.maximum(np.sort(self.lower[q]), sorted(-s for s, _, _ in self.best[q]))
        self.waiting, self.pairs = [], 0


def searched(index: DataFrame, weights: np.ndarray, item_ids: list, documents: int, length: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): of each task's documents the k best for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(weights, documents, length, k)
        for batch in batches:
            doc_ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            (found, starts), (counts, _) = lists(batch.column(2)), lists(batch.column(3))
            up = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8)
            some = np.flatnonzero(np.diff(starts))  # documents with a term that is asked for
            first = 0
            while first < len(some):
                last = min(first + DOCS, len(some))
                last = first + max(1, int(np.searchsorted(starts[some[first:last] + 1], starts[some[first]] + POSTINGS, "right")))
                own = some[first:last]
                edge = np.r_[starts[own], starts[own[-1] + 1]]
                at = slice(edge[0], edge[-1])
                search.add([doc_ids[d] for d in own], n[own], found[at], counts[at], up[at], edge - edge[0])
                first = last
        search.score()
        rows = [(q, item_ids[q], doc_id, -s) for q, best in enumerate(search.best) for s, _, doc_id in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["query", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "query int, item_id bigint, doc_id bigint, score bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank, in two steps, as every task has handed on k of them."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score: the k highest-scoring documents of each item, if their score is above 0.

    Every row of ``items`` is a query and every row of ``docs`` a document, repeated ones too;
    null, empty and termless texts are neither found nor counted, and items without a term or
    without a match have no row. Texts are read whole. Equal scores go by ascending doc_id,
    rows without one last. Columns other than doc_id, item_id and text aren't read.
    """
    spark = docs.sparkSession
    asked = checkpointed(items.select(items["item_id"].cast("long").alias("item_id"), items["text"]).where("text is not null"))
    size = asked.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks, out = max(1, -(-size.rows // BLOCK_QUERIES), -(-size.bytes // BLOCK_BYTES)), None
    for b in range(blocks):
        queries = [(r.item_id, Counter(terms(r.text))) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, q in queries for t in q}))}
        if not vocabulary:
            continue
        index = checkpointed(counted(docs, vocabulary))
        documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row for each term of the block
        weight = np.array([np.floor(1000 * np.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))]).astype(np.int64)
        weights = np.zeros((len(vocabulary), len(queries)), np.int64)
        for q, (_, counts) in enumerate(queries):
            for t, c in counts.items():
                weights[vocabulary[t], q] = weight[vocabulary[t]] * c
        both = checkpointed(quantised(index, documents, length))
        found = ranked(searched(both, weights, [i for i, _ in queries], documents, length, k), k)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out


def oracle(k: int = K) -> str:
    """DuckDB SQL for search() over documents and benchmark: every score, no bounds."""
    found = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), t AS (SELECT r, doc_id, {found} AS term FROM d),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT r, count(*) AS n FROM t GROUP BY r),
s AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark), qt AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, {found} AS term FROM b) GROUP BY ALL),
x AS (SELECT q, item_id, doc_id, r, CAST(sum(c * CAST(floor(1000 * ln(CAST(2 * N_ + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * N_) // L_)))) AS BIGINT) AS score
  FROM qt JOIN p USING (term) JOIN l USING (r) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= {k}"""
