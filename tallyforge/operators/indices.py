"""Index weights, breakdowns and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOMINANT = 0.8


#: Rows of totals, one for each index or fund, up to which they are broadcast.
BROADCAST_TOTALS = 1_000_000


def small(totals: DataFrame) -> DataFrame:
    """Totals marked for broadcast if they are few, counted; else for a shuffle, which adaptive plans split where it is skewed."""
    return F.broadcast(totals) if totals.limit(BROADCAST_TOTALS + 1).count() <= BROADCAST_TOTALS else totals


def backfilled(lacking: DataFrame, known: DataFrame) -> DataFrame:
    """``lacking`` with the code that ``known`` has for its key; a key that stands for two codes is never used."""
    sure = known.groupBy("key").agg(F.min("cik").alias("cik"), F.max("cik").alias("last")).where("cik = last").drop("last")
    return lacking.join(sure, "key")


def cap_weights(members: DataFrame) -> DataFrame:
    """Each member's percentage of its index's capitalisation; without a positive one, none. Totals are summed apart."""
    caps = members.withColumn("cap", F.when(F.col("market_cap") > 0, F.col("market_cap")))
    total = caps.groupBy("index_id").agg(F.sum("cap").alias("total"))
    return caps.join(small(total), "index_id").select("index_id", "id", F.bround(F.col("cap") / F.col("total") * 100, 4).alias("weight_pct"))


def breakdown(members: DataFrame, by: str, absent: str) -> DataFrame:
    """Members and weight of each group of an index; a null weight adds nothing, a null group has a name."""
    return members.groupBy("index_id", F.coalesce(by, F.lit(absent)).alias(by)).agg(F.count("*").alias("members"), F.bround(F.sum(F.coalesce("weight", F.lit(0.0))), 2).alias("weight"))


def dominant_sector(members: DataFrame) -> DataFrame:
    """The sector with four fifths or more of an index's weight, by members if none has weight; members without one don't count."""
    known = members.where("sector is not null").groupBy("index_id", "sector").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("w"), F.count("*").cast("double").alias("n"))
    total = known.groupBy("index_id").agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    share = F.when(F.col("tw") > 0, F.col("w") / F.col("tw")).otherwise(F.col("n") / F.col("tn"))
    best = known.join(total, "index_id").withColumn("share", share).groupBy("index_id").agg(F.max(F.struct("share", "sector")).alias("best"))
    return best.select("index_id", F.when(F.col("best.share") >= DOMINANT, F.col("best.sector")).alias("sector"), F.round("best.share", 6).alias("share"))


def summed_weights(lines: DataFrame) -> DataFrame:
    """Weights of a company's share classes added; all null stays null."""
    return lines.groupBy("index_id", "id").agg(F.bround(F.sum("weight"), 4).alias("weight"))


def scaled_weights(lines: DataFrame) -> DataFrame:
    """Weights in per cent: those of a fund that sum to two or less are fractions."""
    total = lines.groupBy("index_id").agg(F.sum("weight").alias("total"))
    factor = F.when((F.col("total") > 0) & (F.col("total") <= 2), 100.0).otherwise(1.0)
    return lines.join(small(total), "index_id").select("index_id", "id", (F.col("weight") * factor).alias("weight"))


def ambiguous_labels(rows: DataFrame) -> DataFrame:
    """Labels that resolved to more than one class, least first."""
    return rows.groupBy("label").agg(F.count_distinct("resolved").alias("classes"), F.min("resolved").alias("least")).where("classes > 1")


def flagged(rows: DataFrame) -> DataFrame:
    """``rows`` with whether their label is ambiguous; classes are counted by label first, partially, and joined back."""
    several = ambiguous_labels(rows).select("label", F.lit(True).alias("ambiguous"))
    return rows.join(several, "label", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
