"""Shortened URLs: validation, unique codes, look-up and click counts."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.scratch import delete, hadoop_path, scratch_path, write_to

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def valid_url(url: Column) -> Column:
    """A http or https scheme and a host that is not empty."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#\s]+"), F.lit(False))


def short_code(url: Column, salt: Column, length: int = 6) -> Column:
    """``length`` characters in base 62 of a hash of the URL and a salt."""
    h = F.pmod(F.xxhash64(url, salt), F.lit(62**length))
    digit = lambda i: F.substring(F.lit(ALPHABET), (F.floor(h / F.lit(62**i)) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(i) for i in range(length)])


def assign_unique_codes(new: DataFrame, existing: DataFrame, length: int = 6, rounds: int = 8) -> DataFrame:
    """``original_url, short_code`` of distinct valid new URLs; no code is in ``existing`` or given twice.

    A URL that clashes gets another salt in the next round; a round leaves about
    (rows / 62 ** length) of its rows over, so a few rounds do.  If URLs are left
    after ``rounds``, the codes are too short for so many and an error says so.
    """
    spark = new.sparkSession
    urls = new.where(valid_url(F.col("original_url"))).select("original_url").distinct()
    folder, rounds_done = scratch_path(spark, "codes"), []
    taken = existing.select("short_code")
    for salt in range(rounds):
        coded = urls.withColumn("short_code", short_code(F.col("original_url"), F.lit(salt), length))
        w = W.partitionBy("short_code").orderBy("original_url")
        free = coded.join(taken, "short_code", "left_anti").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        # each round is written, so that the next one reads it instead of working it out again
        free = write_to(free.select("original_url", "short_code"), f"{folder}/{salt}")
        rounds_done.append(f"{folder}/{salt}")
        urls = write_to(urls.join(free, "original_url", "left_anti"), f"{folder}/left-{salt}")
        taken = taken.unionByName(free.select("short_code"))
        if urls.isEmpty():
            break
    else:
        raise ValueError(f"codes of {length} characters are too few: some URLs clash after {rounds} rounds")
    return spark.read.schema(free.schema).parquet(*rounds_done)


REGISTRY = "original_url string, short_code string, clicks long, created_at timestamp"


def _commits(spark: SparkSession, path: str) -> dict[str, str] | None:
    """Committed batches and their folders, in order; None while a commit is being written."""
    folder, files = hadoop_path(spark, f"{path}/_commits")
    found = sorted(files.listStatus(folder), key=lambda f: f.getPath().getName()) if files.exists(folder) else []
    told = []
    for f in found:
        stream = files.open(f.getPath())
        told.append(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
    return dict(t.split("\t") for t in told) if all(told) else None


def _commit(spark: SparkSession, path: str, number: int, text: str) -> bool:
    """Create commit ``number``, which can be done once only; False if another writer has it."""
    file, files = hadoop_path(spark, f"{path}/_commits/{number:010d}")
    files.mkdirs(file.getParent())
    try:
        stream = files.create(file, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All registered URLs: the rows of committed batches, and of no others."""
    folders = list((_commits(spark, path) or {}).values())
    return spark.read.schema(REGISTRY).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], REGISTRY)


def register_urls(new: DataFrame, path: str, batch: str, tries: int = 20, wait_seconds: float = 0.2) -> DataFrame:
    """Append accepted URLs with a new code and no clicks; no code is ever given twice.  Returns the batch's rows.

    Claim: codes that no committed batch has are written into a folder that nobody
    reads yet.  Check and commit: the file of the next commit number is created,
    which only one writer can do; if another one has it, its rows are read and the
    codes are claimed again.  ``batch`` names the rows for good: a rerun with the
    same name returns what was committed under it.  A URL that is registered keeps
    its code and adds no row.  A writer that dies while it writes its commit leaves
    an empty file; others then wait and stop with an error.
    """
    spark = new.sparkSession
    for _ in range(tries):
        done = _commits(spark, path)
        if done is None:
            time.sleep(wait_seconds)
            continue
        if batch in done:
            return spark.read.schema(REGISTRY).parquet(f"{path}/{done[batch]}")
        known = spark.read.schema(REGISTRY).parquet(*[f"{path}/{f}" for f in done.values()]) if done else spark.createDataFrame([], REGISTRY)
        urls = new.join(known.select("original_url"), "original_url", "left_anti")
        rows = assign_unique_codes(urls, known).withColumns({"clicks": F.lit(0).cast("long"), "created_at": F.current_timestamp()})
        folder = f"batches/{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{folder}")
        if _commit(spark, path, len(done), f"{batch}\t{folder}"):
            return spark.read.schema(REGISTRY).parquet(f"{path}/{folder}")
        delete(spark, f"{path}/{folder}")
    raise RuntimeError(f"no commit after {tries} tries: another writer's commit in {path}/_commits is not finished, or others were faster each time")


def resolve_short_codes(clicks: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clicks with their URL, and clicks on unknown codes."""
    return clicks.join(urls.select("short_code", "original_url"), "short_code"), clicks.join(urls, "short_code", "left_anti")


def click_counts(urls: DataFrame, clicks: DataFrame) -> DataFrame:
    """The table with the new clicks added to the stored counters; counted before they meet the URLs, so a hot code is one row."""
    n = clicks.groupBy("short_code").agg(F.count(F.lit(1)).alias("_n"))
    return urls.join(n, "short_code", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def list_urls(urls: DataFrame, limit: int | None = None) -> DataFrame:
    out = urls.orderBy(F.desc("created_at"), F.desc("id"))
    return out.limit(limit) if limit else out
