"""What the corpus operators share: reading tables, Arrow batches of rows, checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and a Python worker. Texts can be very
#: long, so batches are held far under Spark's default of 10,000 rows.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Keys that may be hot at once.
MOST_HOT = 10_000
#: Seed of hashes of shingles.
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be none of the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, in lower case (A-Z only), joined by spaces."""
    words = (text or "").encode().lower().split()  # of bytes: cut at \x20 and \x09-\x0D
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([digest(line, SEED)], np.uint64)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(line)]
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def bounded_batches(spark: SparkSession) -> None:
    """Keep the memory of Python workers small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, rows: Callable[..., dict[str, list]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Apply ``rows`` to the columns of each Arrow batch.

    ``rows`` gets one Python list for each column of ``df`` and returns the columns of the
    result by name. It runs where the rows are: no shuffle, and memory of one batch.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def map_column(df: DataFrame, column: str, change: Callable[[list], list]) -> DataFrame:
    """Replace one string column batch by batch; all other columns pass unchanged."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array(change(batch.column(at).to_pylist()), batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], new, *batch.columns[at + 1 :]], schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def hot_counts(counts: DataFrame, key: str, least: int) -> DataFrame:
    """(key, parts) of the rows (key, count) with over ``least`` rows and over one in MOST_HOT of them all:
    at most MOST_HOT keys, so the table may be broadcast, and over how many tasks to deal each."""
    counts = checkpointed(counts.where(F.col("count") > least))
    total = counts.agg(F.sum("count")).first()[0] or 0
    size = max(least, -(-total // MOST_HOT))
    return checkpointed(counts.where(F.col("count") > size).select(key, F.ceil(F.col("count") / size).cast("int").alias("parts")))


def hot_keys(rows: DataFrame, key: str, least: int) -> DataFrame:
    """hot_counts() of the keys of ``rows``, counted partially before their exchange."""
    return hot_counts(rows.groupBy(key).count(), key, least)


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, test: Column | None = None) -> DataFrame:
    """Inner join by ``key``, and ``test`` if any, where rows of ``left`` with a hot key are dealt over several tasks.

    ``right`` is copied to each of these. Its other columns are not in ``left``.
    """

    def join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        found = a.join(b, keys) if test is None else a.join(b.withColumnsRenamed({k: f"_{k}" for k in keys}), [*(F.col(k) == F.col(f"_{k}") for k in keys), test])
        return found.select(*left.columns, *(c for c in right.columns if c != key))

    if hot.isEmpty():
        return join(left, right, [key])
    keys = F.broadcast(hot)
    plain = join(left.join(keys, key, "left_anti"), right, [key])
    dealt = left.join(keys, key).withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.col("parts")).cast("int")).drop("parts")
    copied = right.join(keys, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return plain.unionByName(join(dealt, copied, [key, "_part"]))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by files in the folder of spark.checkpoint.dir, which survive lost executors.

    What was shuffled to make them is deleted with the job that wrote them. A folder of our own
    is set only where the session names none and is a local one, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint()  # a plan takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that checkpointed() gave, once nothing will read them any more."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
