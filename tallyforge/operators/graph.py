"""Hub-and-spoke graphs of companies: nodes and edges as rows.

Leaves (company_id, kind, id, label, title, value, nav_id, market_cap, filing_form, filing_detail)
are built once, written by the caller where several results need them, and united with hubs;
children of different kinds are never joined to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import billions

HUBS = {"rev": "REVENUE SOURCES", "cost": "COST SOURCES", "event": "EVENTS"}


def amount(value: Column) -> Column:
    """$x.xxB of a value, null counting as nothing."""
    worth = F.round(F.coalesce(value, F.lit(0.0)).cast("decimal(20,2)") / F.lit(1_000_000_000).cast("decimal(10,0)"), 2)
    return F.concat(F.lit("$"), F.format_string("%.2f", worth.cast("double")), F.lit("B"))


def chip(filing: str) -> tuple[Column, Column]:
    """Form and detail of the filing that a source cites; none if it is missing or deleted."""
    there = F.col(f"{filing}_id").isNotNull() & ~F.coalesce(F.col(f"{filing}_deleted"), F.lit(False))
    detail = F.concat_ws(" · ", f"{filing}_accession", F.date_format(f"{filing}_date", "yyyy-MM-dd"))
    return F.when(there, F.coalesce(f"{filing}_form", F.lit("Filing"))).alias("filing_form"), F.when(there, detail).alias("filing_detail")


def hubs(leaves: DataFrame) -> DataFrame:
    """(company_id, kind, n, total) of each hub; hubs without leaves have no row, those of events no total."""
    total = F.round(F.sum(F.coalesce("value", F.lit(0.0)).cast("decimal(18,2)")), 2).cast("double")
    return leaves.groupBy("company_id", "kind").agg(F.count("*").alias("n"), F.when(F.col("kind") != "event", total).alias("total"))


def nodes(companies: DataFrame, leaves: DataFrame) -> DataFrame:
    """Centres, hubs and leaves: (node, kind, label, title, value, nav_id, market_cap, filing_form, filing_detail)."""
    none = {"nav_id": F.lit(None).cast("long"), "market_cap": F.lit(None).cast("double"), "filing_form": F.lit(None).cast("string"), "filing_detail": F.lit(None).cast("string")}
    rest = [c.alias(k) for k, c in none.items()]
    title = F.concat(F.coalesce("sector", F.lit("Unclassified")), F.lit(" · "), F.coalesce("country_code", F.lit("")))
    centre = companies.select(F.concat(F.lit("company:"), "id").alias("node"), F.lit("center").alias("kind"), F.col("name").alias("label"), title.alias("title"), F.col("revenue_total").alias("value"), *rest)
    names = F.create_map(*(F.lit(x) for pair in HUBS.items() for x in pair))
    hub = hubs(leaves).select(F.concat_ws(":", F.lit("hub"), "kind", "company_id").alias("node"), F.concat(F.lit("hub-"), "kind").alias("kind"), names[F.col("kind")].alias("label"), F.concat("n", F.lit(" items")).alias("title"), F.col("total").alias("value"), *rest)
    leaf = leaves.select(F.concat_ws(":", "kind", "id").alias("node"), "kind", "label", "title", "value", *none)
    return centre.unionByName(hub).unionByName(leaf)


def edges(leaves: DataFrame) -> DataFrame:
    """Centre to hub with the count, hub to leaf with the amount: $x.xB, or null without one and for events."""
    h = hubs(leaves).select(F.concat(F.lit("company:"), "company_id").alias("source"), F.concat_ws(":", F.lit("hub"), "kind", "company_id").alias("target"), F.col("n").cast("string").alias("label"))
    leaf = leaves.select(F.concat_ws(":", F.lit("hub"), "kind", "company_id").alias("source"), F.concat_ws(":", "kind", "id").alias("target"), F.when(F.col("kind") != "event", billions(F.col("value"))).alias("label"))
    return h.unionByName(leaf)
