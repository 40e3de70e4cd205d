"""The stream of weekly volume gives the batch query's rows, and never changes what it has written."""

from pyspark.sql import functions as F

from tallyforge.plans.statements import weeks
from tallyforge.streaming.volume import compact, drop_compacted, folders, run_available, weekly

DATA = "/root/testdata/sf0.001"
SCHEMA = "event_id long, user_id long, ts timestamp, value double"
END = (-1, -1, "2030-01-07 00:00:00", 0.0)  # an event that ends all weeks before it


def rows(df):
    return sorted(tuple(r) for r in df.select("company_id", "week", "n", "volume").collect())


class Feed:
    def __init__(self, spark, folder):
        self.spark, self.source, self.sink, self.state = spark, f"{folder}/in", f"{folder}/out", f"{folder}/state"

    def send(self, *events, late="21 days"):
        """Write one file of events and run the stream over what is there."""
        made = self.spark.createDataFrame(list(events), "event_id long, user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
        made.coalesce(1).write.mode("append").parquet(self.source)
        self.run(late=late)

    def run(self, late="21 days"):
        run_available(self.spark, self.source, self.spark.createDataFrame([], SCHEMA).schema, self.sink, self.state, late=late)

    def weeks(self):
        return [(c, str(w), n, v) for c, w, n, v in rows(weekly(self.spark, self.sink))]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    feed = Feed(spark, tmp_path)
    events.repartition(3).write.parquet(feed.source)  # in no order
    feed.run(late="40 days")
    feed.send(END, late="40 days")
    for _ in range(2):  # a call that finds nothing new writes nothing new
        feed.run(late="40 days")
    assert rows(weekly(spark, feed.sink)) == sorted(rows(weeks(spark, DATA)))


def test_repeats_in_other_files_count_once(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.send((1, 7, "2024-01-02 00:00:00", 1.5), (2, 7, "2024-01-03 00:00:00", 2.0), (2, 7, "2024-01-03 00:00:00", 2.0))
    feed.send((1, 7, "2024-01-02 00:00:00", 1.5), (3, 7, "2024-01-10 00:00:00", 4.0))
    feed.send((3, 7, "2024-01-10 00:00:00", 4.0), (4, 7, "2024-01-04 00:00:00", None))
    assert feed.weeks() == []  # no week is over yet
    feed.send(END)
    assert feed.weeks() == [(7, "2024-01-01", 2, 3.5), (7, "2024-01-08", 1, 4.0)]


def test_stored_weeks_never_change(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.send((1, 7, "2024-01-02 00:00:00", 1.5), late="1 day")
    feed.send((2, 7, "2024-01-20 00:00:00", 1.0), late="1 day")
    feed.send((3, 7, "2024-01-19 12:00:00", 1.0), late="1 day")  # late, but within its time
    assert feed.weeks() == [(7, "2024-01-01", 1, 1.5)]
    feed.send((4, 7, "2024-01-03 00:00:00", 9.0), (5, 8, "2024-01-03 00:00:00", 9.0), late="1 day")  # their week is stored
    feed.send(END, late="1 day")
    assert feed.weeks() == [(7, "2024-01-01", 1, 1.5), (7, "2024-01-15", 2, 2.0)]


def test_compaction_changes_no_row(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    assert feed.weeks() == [] and compact(spark, feed.sink) == -1
    for k in range(4):
        feed.send((k, k % 2, f"2024-0{k + 1}-03 00:00:00", 1.0 + k))
    before = feed.weeks()
    last = compact(spark, feed.sink)
    assert feed.weeks() == before and [f.rpartition("/")[2] for f in folders(spark, feed.sink)[1]] == [f"upto={last}"]
    drop_compacted(spark, feed.sink)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {f"upto={last}"} and compact(spark, feed.sink) == last
    feed.send(END)
    assert feed.weeks() == [(0, "2024-01-01", 1, 1.0), (0, "2024-02-26", 1, 3.0), (1, "2024-01-29", 1, 2.0), (1, "2024-04-01", 1, 4.0)]
    assert len(folders(spark, feed.sink)[1]) > 1 and compact(spark, feed.sink) > last
    drop_compacted(spark, feed.sink)
    assert len(feed.weeks()) == 4
