"""Weekly volume as a stream: each week of a company is written once, when it is over, and never again.

Events are told apart by their ids for as long as the watermark lets any come, so one that comes
in two files counts once, and files may come in any order within that time. A week is written
with the first batch after the watermark has passed its end; what comes later still is left out,
as a stored week isn't changed. Each batch writes a folder of its own, which it replaces if it
runs again; compact() gathers folders, so a reader opens few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late an event may come, against the latest seen.
LATE = "21 days"
#: Rows of one file after compaction.
FILE_ROWS = 4_000_000


def weekly_stream(events: DataFrame, late: str = LATE) -> DataFrame:
    """(company_id, week, n, volume) of weeks that are over, from a stream of events (event_id, company_id, ts, value)."""
    once = events.where("value is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    week = F.window("ts", "7 days", startTime="4 days")  # the epoch's first Monday
    sums = once.groupBy("company_id", week.alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("volume"))
    return sums.select("company_id", F.to_date("w.start").alias("week"), "n", F.round("volume", 4).cast("double").alias("volume"))


def run_available(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, files: int = 1, late: str = LATE) -> None:
    """Read what is there and write the weeks that it ends; calling it again takes only what is new."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).withColumnRenamed("user_id", "company_id")

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = weekly_stream(events, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).foreachBatch(add).start().awaitTermination()


def folders(spark: SparkSession, sink: str) -> tuple[int, list[str]]:
    """The last batch that is compacted (-1: none), and the whole folders to read: that one and all later batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return -1, []
    whole = [s.getPath() for s in store.listStatus(path) if s.isDirectory() and store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbered = [(kind, int(number), p.toString()) for p in whole for kind, _, number in [p.getName().partition("=")]]
    last = max((n for kind, n, _ in numbered if kind == "upto"), default=-1)
    return last, [p for kind, n, p in sorted(numbered) if n == last and kind == "upto" or n > last and kind == "batch"]


def weekly(spark: SparkSession, sink: str) -> DataFrame:
    """(company_id, week, n, volume) of all that has been written."""
    _, found = folders(spark, sink)
    return spark.read.parquet(*found) if found else spark.createDataFrame([], "company_id long, week date, n long, volume double")


def compact(spark: SparkSession, sink: str) -> int:
    """Gather all folders into one and give the number of the last batch in it.

    Readers take the new folder once it is whole. The old ones stay for those that read them
    now; drop_compacted() deletes them. Not to be called while a stream writes.
    """
    last, found = folders(spark, sink)
    batches = [int(p.rpartition("=")[2]) for p in found]
    if not found or max(batches) == last:
        return last
    rows = spark.read.parquet(*found)
    rows.repartitionByRange(rows.count() // FILE_ROWS + 1, "week", "company_id").sortWithinPartitions("week", "company_id").write.mode("overwrite").parquet(f"{sink}/upto={max(batches)}")
    return max(batches)


def drop_compacted(spark: SparkSession, sink: str) -> None:
    """Delete the folders whose rows are in a later, compacted one."""
    last, found = folders(spark, sink)
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in store.listStatus(path):
        name = s.getPath().getName().partition("=")
        if name[0] in ("batch", "upto") and int(name[2]) <= last and s.getPath().toString() not in found:
            store.delete(s.getPath(), True)
