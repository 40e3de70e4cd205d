"""Collections nested in companies: order, pages, empty ones, states of answers."""

from pyspark.sql import functions as F

from tallyforge.operators import documents as N


def made(spark, page):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    rows = spark.createDataFrame([(1, k % 4 if k % 5 else None, k) for k in range(23)] + [(2, 1, 100), (9, 1, 101)], "company long, rank int, k int")
    dots = N.tagged(rows, "dots", "company", F.col("rank"), F.format_string("%03d", "k"), name=F.col("k").cast("string"), note=F.when(F.col("k") > 5, F.lit("n")))
    dashes = N.tagged(rows.where("company = 2"), "dashes", "company", F.col("k"), F.col("k"), name=F.lit("-"))
    return N.nested(parents, [dots, dashes], ["dots", "dashes"], page).select("id", "name", "page", N.listed("dots", "name", "note").alias("dots"), F.size("dashes").alias("dashes")).collect()


def test_collections_are_nested_in_order(spark):
    got = {r.id: r for r in made(spark, 100)}
    order = sorted(range(23), key=lambda k: (k % 5 == 0, k % 4 if k % 5 else 0, k))
    assert got[1].dots == "\n".join(f"{k}|{'n' if k > 5 else ''}" for k in order)
    assert (got[2].dots, got[2].dashes, got[3].dots, got[3].dashes, got[3].page) == ("100|n", 1, "", 0, 0)
    assert sorted(got) == [1, 2, 3]  # children of unknown companies have no document


def test_companies_with_many_children_have_pages(spark):
    rows = [r for r in made(spark, 4) if r.id == 1]
    assert sorted(r.page for r in rows) == sorted({r.page for r in rows}) and 1 < len(rows) <= 6
    found = [int(x.split("|")[0]) for r in rows for x in r.dots.split("\n")]
    assert sorted(found) == list(range(23))
    for r in rows:  # each page is in order
        page = [int(x.split("|")[0]) for x in r.dots.split("\n")]
        assert page == sorted(page, key=lambda k: (k % 5 == 0, k % 4 if k % 5 else 0, k))


def test_states_of_answers(spark):
    codes = spark.createDataFrame([(200, 3), (200, 0), (404, 0), (409, 0), (422, 0), (503, 0), (500, 0)], "code int, n int")
    got = [r.s for r in codes.select(N.answered(F.col("code"), F.col("n")).alias("s")).collect()]
    assert got == ["present", "missing", "not_found", "unavailable", "missing", "error", "error"]
    assert spark.range(1).select(N.status((F.lit(False), "a"), (F.lit(True), "b"), (F.lit(True), "c")).alias("s")).first().s == "b"


def test_items_are_ordered_by_keys(spark):
    """Items without an order follow (at, tie), nulls last and equal keys as they came, and no comparator runs row by row."""
    rows = spark.createDataFrame([([(2.0, "b", "x"), (None, "a", "y"), (1.0, "c", "z"), (2.0, "a", "w"), (2.0, "b", "v")],), ([],)], "r array<struct<at:double,tie:string,item:string>>")
    found = rows.select(N.in_order(F.col("r")).alias("items"))
    assert [r["items"] for r in found.collect()] == [["z", "w", "x", "v", "y"], []]
