"""Cutting lineage where several jobs read one intermediate table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsframe.scratch import delete, scratch_path, shared_dir, write_to, written

__all__ = ["BATCH", "Scratch", "delete", "scratch_path", "shared_dir", "small_batches", "unused", "written"]

#: Rows of an Arrow batch; Spark's default of 10,000 rows that hold texts or sets fills tens of MB for each task, on both sides.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """For sessions that run text operators: rows travel to Python in batches of ``BATCH_ROWS``, unless the session asks for fewer."""
    spark.conf.set(BATCH, str(min(BATCH_ROWS, int(spark.conf.get(BATCH)))))


class Scratch:
    """Intermediate tables that are deleted together when the ``with`` block ends; what outlives it must be ``written`` elsewhere.

    Inside the block rows travel to Python in small batches, and shuffles have
    ``FINER`` times the session's partitions, so that a task sorts little at a
    time; adaptive execution joins those that are small.  The session's own
    settings return at the end.
    """

    PARTITIONS, ADVISORY, FINER = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", 4

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch_path(spark, name)
        self.count = 0

    def __enter__(self) -> Scratch:
        self.own = {key: self.spark.conf.get(key) for key in (BATCH, self.PARTITIONS, self.ADVISORY)}
        small_batches(self.spark)
        self.spark.conf.set(self.PARTITIONS, str(self.FINER * int(self.own[self.PARTITIONS])))
        self.spark.conf.set(self.ADVISORY, "4m")
        return self

    def __exit__(self, *_: object) -> None:
        for key, value in self.own.items():
            self.spark.conf.set(key, value)
        delete(self.spark, self.path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        # hashes do not compress, and codecs hold direct memory of executors long after a task
        return write_to(df, f"{self.path}/{self.count:03d}-{name}", "none")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
