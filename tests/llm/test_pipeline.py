"""The pipeline against plain Python on the smallest documents."""

import duckdb
import pytest

import corpus_pipeline
from tallyforge.llm import bpe, decontaminate, pii, quality, simhash
from tallyforge.llm.queries import QUERIES, TOKENIZER

from .cases import empty, frame

DATA = "/root/testdata/sf0.001"


def alike_groups(docs):
    """The smallest doc_id that each document reaches over pairs that are alike, by all pairs."""
    first = {i: i for i, _ in docs}
    pairs = [(i, j) for k, (i, a) in enumerate(docs) for j, b in docs[:k] if simhash.alike(a, b)]
    for _ in docs:
        for i, j in pairs:
            first[i] = first[j] = min(first[i], first[j])
    return first


def test_run_equals_plain_python(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    policy = quality.mask(quality.POLICIES[quality.CURRENT])
    docs = [(i, t) for i, t in docs if not quality.failed(quality.measure(t)) & policy]
    first = alike_groups(docs)
    docs = [d for d in docs if first[d[0]] == d[0]]
    leaked = {r.doc_id for r in decontaminate.leaks(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    whole = bpe.brute_force(TOKENIZER)
    want = {i: whole(pii.redacted(t)) for i, t in docs if i not in leaked}
    got = {r.doc_id: (r.ids, r.decoded) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and len(got) > 50


def test_near_copies_by_shingles_go(spark):
    """The near-dedup stage keeps what a comparison of all pairs on five-word shingles keeps."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    first = alike_groups(docs)
    out = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert sorted(r.doc_id for r in out.collect()) == sorted({*first.values()})
    assert first[177] == 1  # 0.83 of their shingles in common, fingerprints nine bits apart


def test_leaks_are_the_items_texts(spark):
    """Every document with an item's words in a row is found, and no other."""
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    want = {i for i, t in docs if any(" ".join(x.split()) in " ".join(t.split()) for _, x in items if len(x.split()) >= 5)}
    got = {r.doc_id for r in QUERIES["op3_decontaminate"](spark, DATA).collect()}
    assert want <= got and len(got - want) <= 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_stand_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, frame(spark), DATA)
    assert out.count() > 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == frame(spark).columns
    assert stage(spark, empty(spark), DATA).count() == 0


def test_near_dedup_takes_candidates_from_fingerprints(spark):
    """Ball hashing proposes pairs to the near-dedup stage, and whole sets decide on them when sketches propose nothing."""
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), " ".join([*base[:399], "other"]), " ".join(f"v{k}" for k in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bin(simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).count("1") <= 4 and simhash.alike(texts[0], texts[1])
    nodes = spark.createDataFrame([(k, simhash.marked(t)) for k, t in enumerate(texts)], "tid long, mark long")
    assert [set(r) for r in simhash.proposed(nodes).collect()] == [{0, 1}]
    before, simhash.minhash.prefixes = simhash.minhash.prefixes, lambda nodes, rule: spark.createDataFrame([], "tid long, value long")
    try:
        assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()) == [0, 2]
    finally:
        simhash.minhash.prefixes = before
