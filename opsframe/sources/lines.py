"""Lines of text files with their numbers, whatever the size of a file.

Spark splits large files, so that many tasks read one.  A line has its place
inside its split, as a split's rows come in order; what lies before a split is a
running sum over one row for each split of the file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.scratch import delete, written


#: Spark's setting for the tasks that list folders: up to 10,000 by default, each of which costs more than to list a folder.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def listed(spark: SparkSession, read: Callable[[], DataFrame]) -> DataFrame:
    """``read()``, whose folders are listed by four tasks for each core; the session's own setting is put back."""
    own = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(own), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return read()
    finally:
        spark.conf.set(LISTING, own)


def _read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    d = listed(spark, lambda: spark.read.option("recursiveFileLookup", True).text(path))
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _placed(splits: DataFrame) -> DataFrame:
    """``splits`` (``path, split, first, n``) with the lines before each and those of its file."""
    own = W.partitionBy("path")
    before = own.orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    return splits.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "n_lines": F.sum("n").over(own)})


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, line_no, line, n_lines``: all lines, from 0, and the number of lines of their file.

    The lines are written once, as another reading might split the files
    otherwise.  Lines end at ``\\n``, ``\\r`` or ``\\r\\n``; the end of the last line
    begins none, so an empty file has no line.
    """
    d = written(_read(spark, path), "lines")
    splits = _placed(d.groupBy("path", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    return d.join(splits, ["path", "split"]).select("path", (F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "line", "n_lines")


def matching_lines(spark: SparkSession, path: str | list[str], match: Callable[[Column], Column]) -> DataFrame:
    """``path, line_no, line`` of the lines for which ``match`` holds, numbered from 0 among all lines of their file.

    One reading: a split becomes one row with its number of lines and those that
    match, so no task gathers more than a split.
    """
    hit = F.when(F.coalesce(match(F.col("line")), F.lit(False)), F.struct("at", "line"))
    splits = _read(spark, path).groupBy("path", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.collect_list(hit).alias("hits"))
    found = _placed(splits).select("path", "first", "before", F.explode("hits").alias("hit"))
    return found.select("path", (F.col("hit.at") - F.col("first") + F.col("before")).alias("line_no"), "hit.line")


def _write(root: str, staging: str, name: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(root)
        aside = fs.FileSystem.from_uri(staging)[1]
        own, out, lines = None, None, 0
        staged = f"{aside}/{uuid.uuid4().hex}"
        store.create_dir(aside)
        done: list[tuple[str, int]] = []

        def finish() -> None:
            out.close()
            store.create_dir(f"{inside}/{own}")
            store.move(staged, f"{inside}/{own}/{name}")
            done.append((own, lines))

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"folder": pa.array([f for f, _ in done], pa.string()), "lines": pa.array([n for _, n in done], pa.int64())})

        for batch in batches:
            folders, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, done = 0, []
            while at < len(folders):
                upto = at + 1
                while upto < len(folders) and folders[upto] == folders[at]:
                    upto += 1
                if folders[at] != own:
                    if out is not None:
                        finish()
                    own, out, lines = folders[at], store.open_output_stream(staged), 0
                out.write("".join(f"{t or ''}\n" for t in texts[at:upto]).encode())
                lines += upto - at
                at = upto
            yield finished()
        done = []
        if out is not None:
            finish()
            yield finished()

    return write


def write_lines(rows: DataFrame, root: str, folder: Column, order: Sequence[str], line: str = "line", name: str = "part-0.txt") -> None:
    """Writes ``line`` of all rows into one file for each value of ``folder``, a path below ``root``, in the given order.

    Spark's own partitioned writer sorts rows by folder once more and drops the
    order inside a folder.  Here a task streams the sorted rows of its folders
    into one file after the other.  Folders are dealt over at least four tasks for
    each core, however few bytes they hold, as each file has its price.  A file is
    written aside and moved when it is whole, so a task that is run again leaves
    whole files only.  ``root`` is a path or URI that every executor can write to.
    """
    staging, spark = f"{root.rstrip('/')}-staging", rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    d = rows.withColumn("_folder", F.coalesce(folder, F.lit("")))  # without a folder: in the root
    d = d.repartition(tasks, "_folder").sortWithinPartitions("_folder", *order).select("_folder", line)
    d.mapInArrow(_write(root.rstrip("/"), staging, name), "folder string, lines long").write.format("noop").mode("overwrite").save()
    delete(spark, staging)
