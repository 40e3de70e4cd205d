"""Replaced links, clusters around a filing, the class hierarchy, and staged classification."""

import pytest

from tallyforge.operators import classes as K
from tallyforge.operators import links as W
from tallyforge.sources import classes


def links(spark, *rows):
    return spark.createDataFrame(rows, "owner long, kind string, target long")


def test_links_are_replaced_by_difference(spark):
    stored = links(spark, (1, "a", 10), (1, "a", 11), (1, "b", 10), (2, "a", 10), (3, "a", 12), (4, "a", 13))
    edits = spark.createDataFrame([(1, "a", [11, 12, 12, 99]), (2, "a", []), (3, "a", None), (5, "a", [10])], "owner long, kind string, targets array<long>")
    active = spark.createDataFrame([("a", t) for t in (10, 11, 12)], "kind string, target long")
    changes = W.link_changes(stored, edits, active)
    found = {(r.owner, r.kind, r.target): r.change for r in changes.collect()}
    assert found == {(1, "a", 10): "delete", (1, "a", 11): "keep", (1, "a", 12): "insert", (2, "a", 10): "delete", (3, "a", 12): "delete", (5, "a", 10): "insert"}
    after = {tuple(r) for r in W.linked(stored, edits, changes).collect()}
    assert after == {(1, "a", 11), (1, "a", 12), (1, "b", 10), (4, "a", 13), (5, "a", 10)}
    again = W.link_changes(W.linked(stored, edits, changes), edits, active)
    assert {r.change for r in again.collect()} == {"keep"}
    gone = W.link_changes(stored, edits, active.where("target <> 11"))  # a kept target that is no longer active
    assert {r.change for r in gone.where("owner = 1 AND target = 11").collect()} == {"delete"}


def test_groups_are_replaced_even_by_nothing(spark):
    stored = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "w")], "g long, v string")
    fresh = spark.createDataFrame([("n", 1), ("m", 3)], "v string, g long")
    named = spark.createDataFrame([(1,), (2,), (2,)], "g long")
    assert sorted(tuple(r) for r in W.replaced(stored, fresh, named, "g").collect()) == [(1, "n"), (3, "w")]
    parents = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "g long, day int")
    days = spark.createDataFrame([(1, 9), (1, 8), (2, 6)], "g long, day int")
    assert sorted((r.g, r.day) for r in W.stamped(parents, days, "g", "day").collect()) == [(1, 9), (2, 6), (3, 7)]


def deleted(spark, sources, chosen):
    rows = spark.createDataFrame(sources, "node string, id long, filing_id long, deleted boolean")
    filings = spark.createDataFrame([(7, False), (8, False), (9, True)], "id long, deleted boolean")
    a, b = W.cluster_deleted(rows, filings, spark.createDataFrame(chosen, "node string, id long"))
    return {(r.node, r.id) for r in a.collect() if r.deleted}, {r.id for r in b.collect() if r.deleted}


def test_a_cluster_goes_with_its_filing(spark):
    sources = [("R", 1, 7, False), ("R", 2, 7, False), ("C", 1, 7, False), ("R", 3, 8, False), ("C", 4, None, False), ("R", 4, None, False), ("C", 5, 9, True)]
    assert deleted(spark, sources, [("R", 1)]) == ({("R", 1), ("R", 2), ("C", 1), ("C", 5)}, {7, 9})
    assert deleted(spark, sources, [("C", 1)]) == ({("R", 1), ("R", 2), ("C", 1), ("C", 5)}, {7, 9})
    assert deleted(spark, sources, [("R", 4)]) == ({("R", 4), ("C", 5)}, {9})  # cites none: goes alone
    assert deleted(spark, sources, [("R", 99)]) == ({("C", 5)}, {9})


def test_hierarchy_is_closed(spark):
    assert len(classes.ROWS) == 163 and len({s for s, *_ in classes.ROWS}) == 163
    assert len({i for _, i, _ in classes.ROWS}) == 74 and len(classes.SECTORS) == 11
    assert K.proved(classes.dimension(spark)).count() == 163
    two = spark.createDataFrame([("s", "i", "x"), ("s", "j", "x"), ("t", "j", "y")], "sub string, industry string, sector string")
    with pytest.raises(Exception, match="several"):
        K.proved(two).collect()


def test_hierarchy_overrules_what_is_stored(spark):
    sub, industry, sector = classes.ROWS[0]
    other, other_sector = next((i, s) for _, i, s in classes.ROWS if s != sector)
    rows = spark.createDataFrame([(1, sub, industry, sector), (2, sub, other, sector), (3, sub, None, None), (4, None, other, sector), (5, "X", "Y", "Z"), (6, None, None, sector)], "id long, sub string, industry string, sector string")
    found = {r.id: (r.industry, r.sector, r.overruled) for r in K.rolled_up(rows, classes.dimension(spark)).collect()}
    assert found == {1: (industry, sector, ""), 2: (industry, sector, "industry"), 3: (industry, sector, "industry,sector"), 4: (other, other_sector, "sector"), 5: ("Y", "Z", ""), 6: (None, sector, "")}


DIM = [("A1", "A", "S"), ("A2", "A", "S"), ("B1", "B", "T")]
COLUMNS = "id long, sector string, label string, locked boolean, bypass boolean, state string, sub string, constrained string, free string"


def say(sub):
    return f'{{"subIndustry": "{sub}"}}'


def fold(spark, rows, cache=()):
    dim = spark.createDataFrame(DIM, "sub string, industry string, sector string")
    known = spark.createDataFrame(list(cache), "label string, sub string, version int")
    found, after = K.staged(spark.createDataFrame(rows, COLUMNS), known, dim)
    return {r.id: (r.state, r.sub, r.sector, r.stage) for r in found.collect()}, {(r.label, r.sub, r.version) for r in after.collect()}


def test_answers_are_tried_in_stages(spark):
    row = lambda i, label, a, b, sector="S", locked=False, bypass=False, state="Pending", sub=None: (i, sector, label, locked, bypass, state, sub, a, b)
    rows = [
        row(1, "solar", say("B1"), say("B1")),  # another sector's: free, and not cached
        row(2, "solar", say("A1"), None),  # the first that fits is cached
        row(3, " solar ", say("A2"), None),  # and decides for later ones
        row(4, "solar", say("A2"), None, bypass=True),
        row(5, "", say("A1"), None), row(6, None, say("A1"), None, bypass=True),
        row(7, "x", "oops", "[]"), row(8, "x", '{"subIndustry": null}', say("C9")),
        row(9, "y", say("A1"), say("B1"), sector=None),
        row(10, "y", say("A1"), None, locked=True, sub="B1"), row(11, "y", say("A1"), None, state="NoFit"),
        row(12, "old", say("A1"), None),
    ]
    found, cache = fold(spark, rows, [("old", "A2", 4)])
    assert found == {
        1: ("Resolved", "B1", "T", "free"), 2: ("Resolved", "A1", "S", "constrained"), 3: ("Resolved", "A1", "S", "cache"), 4: ("Resolved", "A2", "S", "constrained"),
        5: ("Pending", None, None, None), 6: ("Resolved", "A1", "S", "constrained"), 7: ("NoFit", None, None, None), 8: ("NoFit", None, None, None),
        9: ("Resolved", "B1", "T", "free"), 10: ("Locked", "B1", "T", None), 11: ("NoFit", None, None, None), 12: ("Resolved", "A2", "S", "cache"),
    }
    assert cache == {("old", "A2", 4), ("solar", "A1", 5)}
    again, same = fold(spark, rows, cache)  # a replay learns nothing more; what came before the label was known takes it now
    assert same == cache and again == found | {1: ("Resolved", "A1", "S", "cache"), 2: ("Resolved", "A1", "S", "cache")}
