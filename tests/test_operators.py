"""Operators on small fixtures, where the tables have no such cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import changes as C
from tallyforge.operators import facts as X
from tallyforge.operators import filings as L
from tallyforge.operators import indices as I
from tallyforge.operators import io_model as io
from tallyforge.operators.ranking import global_rank
from tallyforge.operators.reads import matching, missing_fields


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first().r


TOY = [[0.1, 0.2], [0.3, 0.1]]


@pytest.fixture()
def toy(spark):
    return spark.createDataFrame([("t", i, j, TOY[i][j]) for i in range(2) for j in range(2)], "model_id string, i int, j int, a double")


def test_inverse_and_linearity(spark, toy):
    inv = io.inverse(toy).cache()
    found = {(r.i, r.j): r.l for r in inv.collect()}
    assert found == pytest.approx({(0, 0): 1.2, (0, 1): 0.266667, (1, 0): 0.4, (1, 1): 1.2}, abs=1e-6)
    shock = lambda *rows: spark.createDataFrame(list(rows), "k int, s double")
    answer = lambda *rows: np.array([r.v for r in io.respond(inv, shock(*rows)).orderBy("i").collect()])
    assert not answer((0, 0.0), (1, 0.0)).any()
    assert answer((0, 2.0), (1, -3.0)) == pytest.approx(2 * answer((0, 1.0)) - 3 * answer((1, 1.0)))
    total = {r.i: r.v for r in io.cascade(toy, 0, 1.0).groupBy("i").agg(F.sum("v").alias("v")).collect()}
    assert total == pytest.approx({0: 1.2, 1: 0.4}, abs=1e-8)
    assert all(r.multiplier >= 1 for r in io.multipliers(inv).collect())


def test_allocation_rules(spark):
    members = spark.createDataFrame([("a", 1, "x", 30.0), ("a", 2, None, 10.0), ("a", 3, "x", -5.0), ("b", 4, "y", None), ("b", 5, "y", 0.0), (None, 6, "z", 9.0)], "sector string, id long, industry string, revenue_total double")
    deltas = spark.createDataFrame([("a", 8.0), ("b", 4.0), ("c", 1.0)], "sector string, v double")
    share = {r.id: (r.weight, r.value) for r in io.allocate(members, deltas).collect()}
    assert share == {1: (0.75, 6.0), 2: (0.25, 2.0), 3: (0.0, 0.0), 4: (0.5, 2.0), 5: (0.5, 2.0)}
    assert {r.id: r.value for r in io.allocate(members, deltas, price=True).collect()}[3] == -40.0


@pytest.mark.parametrize(("name", "want"), [("The Coca-Cola Company", "coca cola"), ("ACME Holdings, LLC", "acme"), ("Société Générale S.A.", "société générale s a"), ("", ""), (None, None)])
def test_names(spark, name, want):
    assert one(spark, name, T.norm_name) == want


@pytest.mark.parametrize(("cik", "want"), [("0000000000", "0000000000"), ("none", None), (" CIK-320193 ", "0000320193"), ("12345678901", "12345678901"), ("", None), (None, None)])
def test_ciks(spark, cik, want):
    assert one(spark, cik, T.norm_cik) == want


def test_text_functions(spark):
    assert [one(spark, x, T.pretty_segment) for x in ("GreaterChinaSegment", "Segment", "iPhone4Unit", "AmericasSegmentMember")] == ["Greater China", "Segment", "i Phone4Unit", "Americas Segment Member"]
    assert [one(spark, x, T.missing_cik) for x in ("000", "", None, "n/a", "0010")] == [True, True, True, True, False]
    assert [one(spark, x, T.billions, "double") for x in (1.25e9, 0.0, None, 3.4e7)] == ["$1.3B", "$0.0B", None, "$0.0B"]
    assert one(spark, " financial services ", lambda c: T.sector_name(c, ("FINANCIAL_SERVICES",))) == "FINANCIAL_SERVICES" and one(spark, "x", lambda c: T.sector_name(c, ("Y",))) is None
    assert [one(spark, x, T.value_added_kind) for x in ("V001", "V002", "V003", "T005")] == ["labor", "taxes", "capital", None]
    assert one(spark, "SOFT_WARE_SUB", lambda c: T.label(c, "_SUB")) == "SOFT WARE" and one(spark, None, T.label) == "—"
    assert one(spark, " ", lambda c: T.dotted(c, F.lit("a"), F.lit("b"))) == "a · b" and one(spark, None, lambda c: T.dotted(c, F.lit(" "))) is None
    assert one(spark, "2023-09-30", lambda c: T.period_label(F.lit(None), c)) == "2023" and one(spark, None, lambda c: T.period_label(c, c)) == "n/a"
    assert one(spark, 2.5e9, T.money, "double") == "$2.50B" and one(spark, -1234.0, T.money, "double") == "$-1.23k"
    assert one(spark, " brk.b [2] x", T.norm_ticker) == "BRK-B"
    assert one(spark, "HEALTH_CARE", T.humanise) == "Health Care"
    assert [one(spark, x, T.json_num) for x in ("$1,200", "45 %", "null", "", "ten", None, "(5)", "(1,234)", "7-", "1e3", "5 6")] == [1200.0, 45.0, None, None, None, None, -5.0, -1234.0, -7.0, 1000.0, None]
    cut = lambda x: one(spark, x, lambda c: F.try_variant_get(T.json_salvage(c), "$.a[0].b", "int"))
    assert [cut(x) for x in ('{"a": [{"b": 1}, {"b"', '{"a": [{"b": 1', 'say {"a": [{"b": 1}]} so', "} {")] == [1, None, 1, None]
    assert one(spark, "5 %", lambda c: F.try_variant_get(T.json_salvage(F.concat(F.lit('x {"a": [1, {"b": "'), c, F.lit('"}]} y'))), "$.a[1].b", "string")) == "5 %"
    assert one(spark, 2.5, lambda c: F.bround(c, 0), "double") == 2.0 and one(spark, 0.125, lambda c: F.bround(c, 2), "double") == 0.12


def test_searches(spark):
    rows = spark.createDataFrame([(1, "Apple"), (2, "apricot"), (3, None), (4, "a%b")], "id int, name string")
    assert {r.id for r in matching(rows, " ap ", "name").collect()} == {1, 2}
    assert matching(rows, "  ", "name").count() == 4
    assert {r.id for r in matching(rows, "a%b", "name").collect()} == {4}
    assert rows.select(missing_fields({"id": F.col("id"), "name": F.col("name")}).alias("m")).where("id = 3").first().m == ["name"]


def test_dominant_sector_threshold(spark):
    rows = [(k, s, w) for k, share in enumerate((79.9, 80.0, 80.1)) for s, w in (("x", share), ("y", 100 - share))] + [(9, "x", None), (9, "x", 0.0), (9, "y", None), (10, None, 5.0)]
    found = {r.index_id: r.sector for r in I.dominant_sector(spark.createDataFrame(rows, "index_id int, sector string, weight double")).collect()}
    assert found == {0: None, 1: "x", 2: "x", 9: None}
    lines = spark.createDataFrame([(1, 1, None), (1, 1, None), (1, 2, None), (1, 2, 2.5), (1, 3, 2.5), (1, 3, 1.0)], "index_id int, id int, weight double")
    assert {r.id: r.weight for r in I.summed_weights(lines).collect()} == {1: None, 2: 2.5, 3: 3.5}
    funds = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.6), (2, 1, 40.0), (2, 2, 60.0)], "index_id int, id int, weight double")
    assert {(r.index_id, r.id): r.weight for r in I.scaled_weights(funds).collect()} == {(1, 1): 40.0, (1, 2): 60.0, (2, 1): 40.0, (2, 2): 60.0}


def test_segments(spark):
    contexts = spark.createDataFrame([("c1", "Americas", "2023", False), ("c0", "Americas", "2022", False), ("c2", "Europe", "2023", False), ("c3", "Japan", "2023", False), ("c4", "Americas", "2023", True)], "context_id string, member string, end string, product_axis boolean")
    values = spark.createDataFrame([(c, k, v) for c, r, o in (("c1", 162.56, 60.508), ("c0", 999.0, 1.0), ("c2", 94.294, 36.098), ("c3", 24.257, 30.0), ("c4", 50.0, 10.0)) for k, v in (("revenue", r), ("operating_income", o))], "context_id string, concept string, value double")
    contexts = X.in_columns(contexts.join(values, "context_id"), ("revenue", "operating_income"))
    revenues = X.segment_revenues(contexts.withColumn("operating_income", F.lit(None).cast("double"))).collect()
    assert {r.member: r.revenue for r in revenues} == {"Americas": 162.56, "Europe": 94.294, "Japan": 24.257}
    for target in ("2023", None, "1999"):
        found = {r.member: (round(r.cost, 3), r.reconciles) for r in X.segment_costs(contexts, target).collect()}
        assert found == {"Americas": (102.052, True), "Europe": (58.196, True), "Japan": (-5.743, False)}


def test_review_is_idempotent(spark):
    rows = spark.createDataFrame([("a", "Approved", None, False), ("b", "Pending", "a", False), ("c", "Pending", None, False), ("d", "Rejected", None, False)], "id string, status string, supersedes_id string, deleted boolean")
    actions = spark.createDataFrame([("b", "approve"), ("c", "reject"), ("d", "approve")], "id string, action string")
    once = C.review(rows.join(actions, "id", "left"))
    want = {"a": ("Approved", True), "b": ("Approved", False), "c": ("Rejected", False), "d": ("Rejected", False)}
    assert {r.id: (r.status, r.deleted) for r in once.collect()} == want
    assert {r.id: (r.status, r.deleted) for r in C.review(once.join(actions, "id", "left")).collect()} == want


def test_packing(spark):
    def pack(*sizes):
        return [len(r.text) for r in L.pack(spark.createDataFrame([(1, "\n \n".join("x" * n for n in sizes))], "doc_id long, text string"), 10).orderBy("chunk").collect()]

    assert pack(4, 4, 4) == [10, 4]  # the separator doesn't count in the test, but in what is there
    assert pack(12, 3) == [10, 3] and pack(3, 30) == [3, 10] and pack(10, 10) == [10, 10]
    found = lambda text, quote: one(spark, text, lambda c: L.evidence(c, F.lit(quote)))
    text = "He said “the  end”, twice. Net sales rose four per cent in the year to May; all of it came from abroad and none from home."
    assert tuple(found(text, 'said "the end"')) == (4, 13, True)
    assert tuple(found(text, "net sales rose four per cent ... it came from abroad and none"))[0] == found(text, "net sales rose four per cent")[0]
    assert tuple(found(text, "rose four per cent in the month of June"))[1:] == (len("rose four per cent in the"), False)
    assert found(text, "Heading glued; all of it came from abroad and none from home").exact is False
    assert found(text, "nothing of it is here at all") is None and found(text, "...") is None and found(None, "x") is None


def test_ranks_over_ranges(spark):
    rows = spark.range(1000).selectExpr("id", "id * 7919 % 1000 v")
    found = global_rank(rows, [F.col("v"), F.col("id")], "place").collect()
    assert all(r.place == r.v + 1 for r in found)


def test_declared_schemas_are_those_of_the_files(spark):
    from tallyforge.sources import domain

    for name in domain.SCHEMAS:
        assert domain.table(spark, "/root/testdata/sf0.001", name).schema == spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").schema


def test_packs_over_blocks(spark):
    """Blocks far smaller than a filing give the chunks of one loop over all its pieces, empty pieces and changes of group at their ends among them."""
    import random

    r, rows, want = random.Random(3), [], []
    for f in range(8):
        chunks, text, item, titles = [], "", None, []
        for k in range((1, 5, 60, 400)[f % 4]):
            i, t, piece = r.choice("AAAAAB"), r.choice("xyz"), "" if f > 3 and r.random() < 0.3 else "p" * r.choice((1, 2, 9, 20, 44))
            rows.append((f, k, i, t, piece))
            if text and (i != item or len(text) + len(piece) > 40):
                chunks.append((item, text, titles))
                text, titles = piece, [t]
            else:
                text, titles = text + ("\n\n" if text else "") + piece, [*titles, t]
            item = i
        chunks += [(item, text, titles)] if text else []
        want += [(f, c, i, t, list(dict.fromkeys(s))) for c, (i, t, s) in enumerate(chunks)]
    pieces = spark.createDataFrame(rows, "filing int, pos long, item string, title string, piece string").repartition(5)
    found = L.joined_packs(pieces, "filing", "pos", "item", 40, block=16)
    assert sorted((r.filing, r.chunk, r.item, r.text, r.titles) for r in found.collect()) == sorted(want)


def test_evidence_folds_once(spark):
    """The plan folds text and quote once each, and the query searches once for a filter and three columns."""
    docs = spark.createDataFrame([("Cost of “Sales” rose. It was a long and hard year for all.", "it was a long and hard month"), (None, "x"), ("x", None), ("abc", "")], "text string, quote string")
    found = docs.select(L.evidence(F.col("text"), F.col("quote")).alias("at"))
    assert [r["at"] and tuple(r["at"]) for r in found.collect()] == [(23, 22, False), None, None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2
    from tallyforge import registry

    plan = registry.queries()["evidence_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") <= 7 and "Generate inline" in plan
