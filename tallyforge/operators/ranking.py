"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.checkpoints import checkpointed


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows in order: rows are dealt by range, numbered in each range, and ranges' sizes are added up.

    Only one count for each range meets in a task. The dealt rows are written once, so both
    readers see the same ranges.
    """
    part = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = part.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_own", "_before")
