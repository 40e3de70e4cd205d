"""Financial facts: statement merge, tagged-fact selection, segment costs, weekly volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge_statements(income: DataFrame, ratios: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Income rows with whatever the others have for the same company, year and period.

    Rows whose year is no number or whose period is none of FY, Q1 to Q4 are dropped; of
    duplicates in a secondary statement the first (by seq) counts. All four sides are dealt
    by the same keys, so that the joins share their exchanges.
    """
    keys = ["company_id", "fiscal_year", "period"]
    drive = income.withColumn("fiscal_year", F.col("fiscal_year").try_cast("int")).withColumn("period", F.upper("period"))
    drive = drive.where(F.col("fiscal_year").isNotNull() & F.col("period").isin("FY", "Q1", "Q2", "Q3", "Q4"))
    for side in (ratios, balance, cash):
        found = first_per(side.withColumn("fiscal_year", F.col("fiscal_year").try_cast("int")), keys, [F.col("seq")]).drop("seq")
        drive = drive.join(found, keys, "left")
    return drive.withColumn("gross_margin", F.coalesce("gross_margin", F.try_divide("gross_profit", "revenue")))


def latest_fact(facts: DataFrame, concepts: list[str]) -> DataFrame:
    """Per company the fact of the first concept in order that it has at all, with the latest end; ties by seq."""
    order = F.array_position(F.array(*map(F.lit, concepts)), F.col("concept"))
    known = facts.where(F.col("concept").isin(concepts) & F.col("val").isNotNull() & F.col("end").isNotNull() & (F.col("form") == "10-K"))
    return first_per(known, ["company_id"], [order, F.desc("end"), F.col("seq")])


def fact_for_end(facts: DataFrame, concepts: list[str], ends: DataFrame) -> DataFrame:
    """The fact with exactly the wanted end, by concept order, else the latest one."""
    order = F.array_position(F.array(*map(F.lit, concepts)), F.col("concept"))
    known = facts.where(F.col("concept").isin(concepts) & F.col("val").isNotNull() & (F.col("form") == "10-K"))
    exact = first_per(known.join(ends, "company_id").where("end = wanted"), ["company_id"], [order, F.col("seq")]).select("company_id", F.col("val").alias("exact"))
    latest = latest_fact(facts, concepts).select("company_id", F.col("val").alias("latest"))
    return ends.join(exact, "company_id", "left").join(latest, "company_id", "left").select("company_id", F.coalesce("exact", "latest").alias("val"), F.col("exact").isNotNull().alias("is_exact"))


def at_target(contexts: DataFrame, target: str | None = None) -> DataFrame:
    """Contexts of segments alone (no product axis) at the target period, else the latest one."""
    ours = contexts.where("member is not null and not product_axis")
    latest = ours.agg(F.max("end").alias("latest"), F.max(F.when(F.col("end") == target, F.col("end"))).alias("given"))
    return ours.join(F.broadcast(latest)).where(F.col("end") == F.coalesce("given", "latest"))  # one row


def segment_costs(contexts: DataFrame, target: str | None = None) -> DataFrame:
    """Per segment of the target period (else the latest): revenue, operating income, implied cost, whether it reconciles.

    contexts: context_id, member, end, product_axis, revenue, operating_income, a row each,
    null where there is no such fact; of several for a member the first by id counts.
    """
    both = at_target(contexts, target).where("revenue is not null and operating_income is not null")
    found = first_per(both, ["member"], [F.col("context_id")])
    cost = F.col("revenue") - F.col("operating_income")
    return found.select("member", "revenue", "operating_income", cost.alias("cost"), ((cost >= 0) & (cost <= F.col("revenue"))).alias("reconciles"))


def segment_revenues(contexts: DataFrame, target: str | None = None) -> DataFrame:
    """(member, revenue) of each segment of the target period, whether or not there is an operating income."""
    return first_per(at_target(contexts, target).where("revenue is not null"), ["member"], [F.col("context_id")]).select("member", "revenue")


def in_columns(facts: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """Facts (context_id, .., concept, value) as one row for each context, a column for each concept: one pass, no join."""
    keys = [c for c in facts.columns if c not in ("concept", "value")]
    return facts.where(F.col("concept").isin(*concepts)).groupBy(*keys).agg(*(F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c) for c in concepts))


def refreshed(annual: dict[str, DataFrame], company: str) -> DataFrame:
    """Rows that a refresh writes: revenue, cost of goods and operating expense of the latest year, labelled by it.

    Each DataFrame has ``company``, fiscal_year, end and value, a row for each company; a concept that a company lacks has no row.
    """
    names = {"REVENUE": "Revenue", "COGS": "Cost of revenue", "OPEX": "Operating expenses"}
    out = None
    for kind, rows in annual.items():
        title = F.concat(F.lit(names[kind] + " "), F.coalesce(F.col("fiscal_year").cast("string"), F.substring(F.col("end").cast("string"), 1, 4), F.lit("n/a")))
        part = rows.where("value is not null").select(company, F.lit(kind).alias("kind"), title.alias("name"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def ties(segments: Column, total: Column, share: float = 0.01) -> Column:
    """Whether the segments' sum is within one per cent of the total; null without segments or a positive total."""
    return F.when((total > 0) & segments.isNotNull(), F.abs(segments - total) <= share * total)


def weekly(events: DataFrame) -> DataFrame:
    """Count and sum of values by company and week."""
    return events.where("value is not null").groupBy("company_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")), 4).cast("double").alias("volume"))


def append_newer(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored weeks and the fresh ones after the last stored week of a company, or all if it has none."""
    last = stored.groupBy("company_id").agg(F.max("week").alias("last"))
    newer = fresh.join(last, "company_id", "left").where("last is null or week > last").drop("last")
    return stored.unionByName(newer)


def last_n(weeks: DataFrame, n: int) -> DataFrame:
    return weeks.withColumn("_n", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("week")))).where(F.col("_n") <= n).drop("_n")
