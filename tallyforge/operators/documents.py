"""Companies as documents: all their collections nested in one row, from one exchange of tagged rows.

Collections are never joined to each other. Each child is a row (company_id, kind, at, tie, item)
whose item is a variant, all kinds are united and gathered by company at once, and every kind
becomes an array in the order of (at, tie). A company with very many children has several pages,
so no task gathers more than some PAGE of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.checkpoints import checkpointed

#: Children on one page.
PAGE = 4096


def tagged(rows: DataFrame, kind: str, company: str, at: Column, tie: Column, **fields: Column) -> DataFrame:
    """Children of one kind. ``at`` is a number or null (last), ``tie`` breaks ties; nulls among the fields stay out of the item."""
    item = F.to_variant_object(F.struct(*(c.alias(k) for k, c in fields.items())))
    return rows.select(F.col(company).alias("company_id"), F.lit(kind).alias("kind"), at.cast("double").alias("at"), tie.cast("string").alias("tie"), item.alias("item"))


def paged(children: DataFrame, page: int = PAGE) -> DataFrame:
    """``children`` with their page: 0 but for companies with more than a page of them, whose children are dealt by hash."""
    counts = children.groupBy("company_id").count().where(F.col("count") > page)
    many = checkpointed(counts.select("company_id", F.ceil(F.col("count") / page).alias("pages")))
    if many.isEmpty():
        return children.withColumn("page", F.lit(0))
    dealt = F.pmod(F.xxhash64("kind", "at", "tie"), F.col("pages")).cast("int")
    return children.join(many, "company_id", "left").withColumn("page", F.coalesce(dealt, F.lit(0))).drop("pages")


def in_order(rows: Column) -> Column:
    """The items of structs (at, tie, item) by at, nulls last, then by tie. Items have no order, so keys are sorted with the place of their item."""
    keys = F.transform(rows, lambda x, i: F.struct(x["at"].isNull().alias("n"), x["at"].alias("at"), x["tie"].alias("tie"), i.alias("i")))
    return F.transform(F.array_sort(keys), lambda k: F.get(rows, k["i"])["item"])


def nested(parents: DataFrame, children: list[DataFrame], kinds: list[str], page: int = PAGE) -> DataFrame:
    """``parents`` with page and an array of items for each kind; parents without children have empty arrays on page 0."""
    rows = paged(reduce(DataFrame.unionByName, children), page)
    one = F.struct("at", "tie", "item")
    gathered = rows.groupBy(F.col("company_id").alias("id"), "page").agg(*(F.collect_list(F.when(F.col("kind") == k, one)).alias(k) for k in kinds))
    found = parents.join(gathered, "id", "left").withColumn("page", F.coalesce("page", F.lit(0)))
    return found.withColumns({k: F.coalesce(in_order(F.col(k)), F.array().cast("array<variant>")) for k in kinds})


def fields(item: Column, *names: str, kind: str = "string") -> Column:
    """Fields of an item as one text, joined by bars; missing ones are empty."""
    return F.concat_ws("|", *(F.coalesce(F.variant_get(item, f"$.{n}", kind), F.lit("")) for n in names))


def listed(column: str, *names: str) -> Column:
    """The items of an array as one text, a line each."""
    return F.array_join(F.transform(column, lambda x: fields(x, *names)), "\n")


def status(*cases: tuple[Column, str]) -> Column:
    """The first state whose condition holds, else present."""
    out = F.lit("present")
    for condition, name in reversed(cases):
        out = F.when(condition, name).otherwise(out)
    return out


#: What a source of filings answers, by its code; any other is an error.
ANSWERS = {404: "not_found", 409: "unavailable", 422: "missing", 503: "error"}


def answered(code: Column, items: Column) -> Column:
    """The state of an answer: by its code, and missing where it is well but empty."""
    known = F.create_map(*(F.lit(x) for pair in ANSWERS.items() for x in pair))
    return F.when(code == 200, F.when(items == 0, "missing").otherwise("present")).otherwise(F.coalesce(known[code], F.lit("error")))
