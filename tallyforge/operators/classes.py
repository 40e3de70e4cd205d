"""Classification: a hierarchy that overrules what is stored, and answers folded into a cache in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may become of a company.
LOCKED, RESOLVED, NO_FIT, PENDING = "Locked", "Resolved", "NoFit", "Pending"


def proved(dim: DataFrame) -> DataFrame:
    """The hierarchy (sub, industry, sector), or an error if a sub has two industries or an industry two sectors."""

    def parents(child: str, parent: str) -> DataFrame:
        return dim.groupBy(child).agg(F.count_distinct(parent).alias(f"{child}_parents"))

    def one(child: str, parent: str) -> Column:
        said = F.concat(F.lit(f"{child} "), child, F.lit(f" has several {parent} values"))
        return F.when(F.col(f"{child}_parents") == 1, F.col(parent)).otherwise(F.raise_error(said).cast("string"))

    both = dim.distinct().join(parents("sub", "industry"), "sub").join(parents("industry", "sector"), "industry")
    return both.select("sub", one("sub", "industry").alias("industry"), one("industry", "sector").alias("sector"))


def rolled_up(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """``rows`` (.., sub, industry, sector) by the hierarchy, a table of fixed size, and what it overruled.

    A known sub decides industry and sector whatever is stored; without one, or with an unknown
    one, a known industry decides the sector; else both stay. ``overruled`` names the columns
    that changed, and null counts as a value.
    """
    by_sub = proved(dim).select("sub", F.col("industry").alias("own_industry"), F.col("sector").alias("own_sector"))
    by_industry = proved(dim).select("industry", F.col("sector").alias("industry_sector")).distinct()
    found = rows.join(F.broadcast(by_sub), "sub", "left").join(F.broadcast(by_industry), "industry", "left")
    industry, sector = F.coalesce("own_industry", "industry"), F.coalesce("own_sector", "industry_sector", "sector")
    changed = [F.when(~new.eqNullSafe(F.col(name)), F.lit(name)) for name, new in (("industry", industry), ("sector", sector))]
    rest = [c for c in rows.columns if c not in ("industry", "sector")]
    return found.select(*rest, industry.alias("industry"), sector.alias("sector"), F.concat_ws(",", *changed).alias("overruled"))


def picked(reply: Column) -> Column:
    """What a reply names as sub-industry; null if it is no JSON object or names none."""
    return F.from_json(reply, "subIndustry string", {"mode": "PERMISSIVE"})["subIndustry"]


def staged(companies: DataFrame, cache: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold answers into states, in order of id, and into the cache: (companies, cache).

    companies: id, sector, label, locked, bypass, state, sub, constrained, free; the last two are
    the replies to the constrained and to the free question. cache: label, sub, version.

    Locked rows and rows that had no fit stay; rows without a label stay pending, unless they
    bypass the cache. Of the rest, a cached label decides, unless bypassed. Else the constrained
    reply does, if there is a sector and the sub named lies in it; it is cached for its label
    from then on, unless bypassed, so later companies with the label take it. Else the free
    reply does, whatever its sector, and isn't cached. Else there is no fit. New labels have the
    next version; folding the result again over the same rows adds nothing.
    """
    known = F.broadcast(dim.select(F.col("sub").alias("known_sub"), F.col("sector").alias("known_sector")))
    label = F.nullif(F.trim("label"), F.lit(""))
    rows = companies.withColumns({"key": label, "a": picked(F.col("constrained")), "b": picked(F.col("free"))})
    for name in "ab":
        rows = rows.join(known.withColumnsRenamed({"known_sub": name, "known_sector": f"{name}_sector"}), name, "left")
    rows = rows.join(cache.select(F.col("label").alias("key"), F.col("sub").alias("cached")), "key", "left")
    stays = F.col("locked") | (F.col("state") == NO_FIT)
    unlabelled = F.col("key").isNull() & ~F.col("bypass")
    rows = rows.withColumn("asked", ~stays & ~unlabelled)
    fits = F.col("a_sector").isNotNull() & (F.col("a_sector") == F.col("sector"))
    learns = F.col("asked") & ~F.col("bypass") & F.col("key").isNotNull() & F.col("cached").isNull() & fits
    first = rows.where(learns).groupBy("key").agg(F.min("id").alias("first_id"), F.min_by("a", "id").alias("learned"))
    rows = rows.join(first, "key", "left")
    by_cache = F.when(~F.col("bypass"), F.coalesce("cached", F.when(F.col("id") > F.col("first_id"), F.col("learned"))))
    chosen = F.coalesce(by_cache, F.when(fits, F.col("a")), F.when(F.col("b_sector").isNotNull(), F.col("b")))
    stage = F.when(by_cache.isNotNull(), "cache").when(fits, "constrained").when(F.col("b_sector").isNotNull(), "free")
    state = F.when(F.col("locked"), LOCKED).when(stays, F.col("state")).when(unlabelled, PENDING).when(chosen.isNull(), NO_FIT).otherwise(RESOLVED)
    found = rows.select("id", state.alias("state"), F.when(F.col("asked"), chosen).otherwise(F.col("sub")).alias("sub"), F.when(F.col("asked"), stage).alias("stage"))
    sectors = known.select(F.col("known_sub").alias("sub"), F.col("known_sector").alias("sector"))
    version = cache.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version"))
    learned = first.select(F.col("key").alias("label"), F.col("learned").alias("sub")).join(F.broadcast(version))  # one row
    return found.join(sectors, "sub", "left").select("id", "state", "sub", "sector", "stage"), cache.unionByName(learned)
