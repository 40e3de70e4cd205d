"""Writes that replace or remove through references: links, constituents, clusters around a filing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_changes(stored: DataFrame, edits: DataFrame, active: DataFrame) -> DataFrame:
    """(owner, kind, target, change) of the owners that are edited: what is inserted, kept or deleted.

    stored: owner, kind, target. edits: owner, kind, targets, the whole list that shall be; an
    empty or null one clears the kind's links. Only active targets (kind, target) are linked, so
    one that is gone loses its link. Lists may repeat a target. Stored and wanted links meet in
    one exchange.
    """
    named = edits.select("owner", "kind").distinct()
    wanted = edits.select("owner", "kind", F.explode("targets").alias("target")).join(active, ["kind", "target"], "left_semi")
    held = stored.join(named, ["owner", "kind"], "left_semi")
    flag = lambda df, here, wanted: df.select("owner", "kind", "target", F.lit(here).alias("here"), F.lit(wanted).alias("wanted"))
    both = flag(held, True, False).unionByName(flag(wanted, False, True)).groupBy("owner", "kind", "target").agg(F.max("here").alias("here"), F.max("wanted").alias("wanted"))
    change = F.when(F.col("here") & F.col("wanted"), "keep").when(F.col("wanted"), "insert").otherwise("delete")
    return both.select("owner", "kind", "target", change.alias("change"))


def linked(stored: DataFrame, edits: DataFrame, changes: DataFrame) -> DataFrame:
    """The links after the changes: those of owners that aren't edited, and what is kept or inserted."""
    named = edits.select("owner", "kind").distinct()
    return stored.select("owner", "kind", "target").join(named, ["owner", "kind"], "left_anti").unionByName(changes.where("change <> 'delete'").drop("change"))


def replaced(stored: DataFrame, fresh: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows after all rows of the named groups gave way to fresh ones: a group without any is empty then, other groups stay."""
    named = groups.select(key).distinct()
    return stored.join(named, key, "left_anti").unionByName(fresh.join(named, key, "left_semi").select(stored.columns))


def stamped(parents: DataFrame, groups: DataFrame, key: str, column: str) -> DataFrame:
    """``parents`` with ``column`` as the named groups have it; of several values the latest."""
    new = groups.groupBy(key).agg(F.max(column).alias("_new"))
    return parents.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def cluster_deleted(sources: DataFrame, filings: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, filings) after the chosen sources (node, id) were deleted with all that cites the same filing.

    sources: node, id, filing_id, deleted. filings: id, deleted. A chosen source that cites no
    filing goes alone; one that cites takes the filing and every source of either node that
    cites it. What is deleted stays so.
    """
    picked = sources.join(chosen.select("node", "id").distinct(), ["node", "id"], "left_semi")
    cited = picked.where("filing_id IS NOT NULL").select("filing_id", F.lit(True).alias("_cited")).distinct()
    alone = picked.where("filing_id IS NULL").select("node", "id", F.lit(True).alias("_alone")).distinct()
    marked = sources.join(cited, "filing_id", "left").join(alone, ["node", "id"], "left")
    gone = F.col("deleted") | F.coalesce("_cited", "_alone", F.lit(False))
    filed = filings.join(cited.withColumnRenamed("filing_id", "id"), "id", "left")
    return marked.select("node", "id", "filing_id", gone.alias("deleted")), filed.select("id", (F.col("deleted") | F.coalesce("_cited", F.lit(False))).alias("deleted"))
