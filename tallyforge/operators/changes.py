"""Writes as snapshots: every operator takes the stored rows and returns the new ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T


def soft_delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows named by ids become deleted; deleting twice changes nothing."""
    marked = ids.select("id", F.lit(True).alias("_gone")).distinct()
    return rows.join(marked, "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def refresh(stored: DataFrame, fresh: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """For the groups that fresh rows name, stored rows make way for them, but for those to keep; other groups stay."""
    named = fresh.select(*keys).distinct().withColumn("_named", F.lit(True))
    left = stored.join(named, keys, "left").where(F.col("_named").isNull() | keep).drop("_named")
    return left.unionByName(fresh)


def upsert(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """By natural key: a fresh value wins where it isn't null, and a deleted row that comes again lives."""
    f = fresh.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_came"))
    both = stored.join(f, key, "full_outer")
    merged = [F.coalesce(f"_{c}", c).alias(c) for c in columns]
    return both.select(key, *merged, F.when(F.col("_came"), False).otherwise(F.col("deleted")).alias("deleted"))


def coalesce_merge(stored: DataFrame, fetched: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fetched values overwrite only where they aren't null."""
    f = fetched.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    return stored.join(f, key, "left").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in columns))


def review(rows: DataFrame) -> DataFrame:
    """Apply each row's ``action``, approve or reject, to pending rows; an approved row takes the place of the one it supersedes. Others don't change."""
    pending = F.col("status") == "Pending"
    taken = pending & F.coalesce(F.col("action") == "approve", F.lit(False))
    state = F.when(taken, "Approved").when(pending & (F.col("action") == "reject"), "Rejected").otherwise(F.col("status"))
    replaced = rows.where(taken & F.col("supersedes_id").isNotNull()).select(F.col("supersedes_id").alias("id"))
    return soft_delete(rows.withColumn("status", state).drop("action"), replaced)


def write(held: DataFrame, edits: DataFrame, known: tuple[str, ...], fields: list[str], proof: list[str]) -> DataFrame:
    """Rows after edits (edit_id, row_id, fields, proof, reviewer, by_user), in order of edit_id.

    A reviewer's edit of a row takes effect in place: fields are the last edit's, null or not,
    and parts of the proof the last that aren't null. Anyone else's edit of a row is a pending
    row that would supersede it. An edit without row_id is a new row, approved if a reviewer's.
    Edits of an unknown classification or of a row that isn't there are dropped.
    """
    good = edits.where(F.col("classification").isin(*known))
    last = good.where("row_id is not null and reviewer").groupBy(F.col("row_id").alias("id")).agg(
        F.max_by(F.struct(*fields), "edit_id").alias("_new"),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("edit_id"))).alias(f"_{c}") for c in proof),
    )
    there = F.col("_new").isNotNull()
    rest = [c for c in held.columns if c not in ("id", *fields, *proof)]
    live = held.join(last, "id", "left").select("id", *(F.when(there, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in fields), *(F.coalesce(f"_{c}", c).alias(c) for c in proof), *rest)
    new = good.where("row_id is null or not reviewer").join(held.select(F.col("id").alias("row_id"), F.lit(True).alias("_there")), "row_id", "left").where("row_id is null or _there")
    added = new.select(F.concat(F.lit("new-"), "edit_id").alias("id"), *fields, *proof, F.when(F.col("reviewer"), "Approved").otherwise("Pending").alias("status"), F.col("row_id").alias("supersedes_id"), F.when(~F.col("reviewer"), F.col("by_user")).alias("contributed_by"))
    return live.unionByName(added)


# What a side's row is mirrored as, and the classification of the mirror.
MIRRORS = {"COST": ("REVENUE", "CUSTOMER"), "REVENUE": ("COST", "COGS")}


def reciprocal(rows: DataFrame, others: DataFrame) -> DataFrame:
    """For each row with a counterparty its mirror on the other side (MIRRORS), unless an approved one is there; it works in both directions."""
    mirror = rows.where("related_company_id is not null").select(F.col("related_company_id").alias("company_id"), F.col("company_id").alias("related_company_id"), "value")
    there = others.where("status = 'Approved' and not deleted").select("company_id", "related_company_id")
    return mirror.join(there, ["company_id", "related_company_id"], "left_anti")


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Each row with the first check it fails, or null."""
    failing = reduce(lambda rest, item: F.when(~F.coalesce(item[1], F.lit(False)), item[0]).otherwise(rest), reversed(checks.items()), F.lit(None).cast("string"))
    return rows.withColumn("rejected_for", failing)


def required(name: str) -> Column:
    """A check: a string that isn't blank."""
    return F.coalesce(F.trim(name) != "", F.lit(False))


def not_before(name: str, other: str) -> Column:
    """A check: no date, or one no earlier than the other."""
    return F.col(name).isNull() | (F.col(name) >= F.col(other))


def cache_edited(cache: DataFrame, edits: DataFrame) -> DataFrame:
    """A label cache (label, sub) after edits (seq, label, sub): of a label's edits the last counts, a null sub removes it.

    Labels are told apart without case and outer spaces; the cache has one row for each.
    """
    key = F.lower(F.trim("label"))
    last = edits.groupBy(key.alias("label")).agg(F.max_by(F.struct("sub"), "seq").alias("new"))
    both = cache.select(key.alias("label"), "sub").join(last, "label", "full_outer")
    return both.select("label", F.when(F.col("new").isNotNull(), F.col("new.sub")).otherwise(F.col("sub")).alias("sub")).where("sub IS NOT NULL")


def distinct_ci(rows: DataFrame, column: str, order: str) -> DataFrame:
    """One row for each value regardless of case: the first in order."""
    return rows.groupBy(F.lower(column).alias("key")).agg(F.min_by(column, F.struct(order, column)).alias(column), F.count("*").alias("n"))


def company_rows(profiles: DataFrame, incomes: DataFrame) -> DataFrame:
    """Companies of a vendor's profiles, with margin, date and revenue of their latest income statement.

    The margin is gross profit over revenue, to two digits; revenue counts in dollars alone;
    an unknown sector is null; notes have 2,000 characters at most.
    """
    known = F.create_map(*(F.lit(x) for pair in T.VENDOR_SECTORS.items() for x in pair))
    last = incomes.groupBy("symbol").agg(F.max_by(F.struct("date", "reportedCurrency", "revenue", "grossProfit"), "date").alias("i")).select("symbol", "i.*")
    found = profiles.join(last, "symbol", "left")
    margin = F.when(F.col("revenue") != 0, F.bround(F.col("grossProfit") / F.col("revenue"), 2))
    dollars = F.upper("reportedCurrency") == "USD"
    return found.select(
        "symbol",
        F.coalesce("companyName", "symbol", F.lit("")).alias("name"),
        T.norm_cik(F.col("cik")).alias("cik"),
        F.nullif(F.trim("industry"), F.lit("")).alias("vendor_industry"),
        known[T.norm_label(F.col("sector"))].alias("sector"),
        F.col("marketCap").alias("market_cap"),
        F.substring("description", 1, 2000).alias("notes"),
        margin.alias("gross_margin"),
        F.try_to_date("date", "yyyy-MM-dd").alias("as_of"),
        F.when(dollars, F.col("revenue")).alias("revenue_total"),
    )


def index_upsert(stored: DataFrame, fresh: DataFrame, members: DataFrame) -> DataFrame:
    """Indices by code: a known code keeps its id, what came replaces all else of it; a new one has its code as id.

    ``fresh`` has code, name, region, hint; ``members`` has code, sector, weight and
    market_cap of what it now holds. The sector is that of four fifths of the members'
    weight, else the hint; the size is the members' capitalisation, if there is any.
    """
    from tallyforge.operators.indices import dominant_sector

    rows = members.withColumnRenamed("code", "index_id")
    sector = dominant_sector(rows).select(F.col("index_id").alias("code"), F.col("sector").alias("most"))
    size = members.groupBy("code").agg(F.sum("market_cap").alias("cap"))
    new = fresh.join(sector, "code", "left").join(size, "code", "left").select("code", F.col("name").alias("_name"), F.coalesce("most", "hint").alias("_sector"), F.col("region").alias("_region"), F.when(F.col("cap") > 0, F.col("cap")).alias("_cap"), F.lit(True).alias("_came"))
    both = stored.join(new, "code", "full_outer")
    pick = lambda c, n: F.when(F.col("_came"), F.col(n)).otherwise(F.col(c)).alias(c)
    return both.select("code", F.coalesce("id", F.concat(F.lit("new-"), "code")).alias("id"), pick("name", "_name"), pick("sector", "_sector"), pick("region", "_region"), pick("total_cap", "_cap"))


def resumed(wanted: DataFrame, linked: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Each wanted key with what an import that is run again does about it: done (linked already), relink (fetched before) or fetch."""
    done = linked.select(key, F.lit(True).alias("_done")).distinct()
    have = fetched.select(key, F.lit(True).alias("_have")).distinct()
    step = F.when(F.col("_done"), "done").when(F.col("_have"), "relink").otherwise("fetch")
    return wanted.select(key).distinct().join(done, key, "left").join(have, key, "left").select(key, step.alias("step"))


def stubs(asked: DataFrame) -> DataFrame:
    """Companies to make for counterparties (name, ticker, company_id) that nothing matched, one for each name in any case: the first's, private without a ticker."""
    due = asked.where("company_id is null and trim(name) <> ''")
    one = due.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min_by(F.struct(F.trim("name").alias("name"), F.nullif(F.trim("ticker"), F.lit("")).alias("ticker")), "id").alias("s"), F.count("*").alias("asked"))
    return one.select("key", "s.name", "s.ticker", F.when(F.col("s.ticker").isNull(), "PRIVATE").otherwise("PUBLIC").alias("type"), "asked")
