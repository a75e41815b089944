"""File inventories and text search in files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions.classify import strip
from opsframe.functions.match import glob_pattern
from opsframe.scratch import delete, scratch_path, write_to
from opsframe.sources.lines import listed, matching_lines

# Folder names that searches do not enter, whatever their case.
EXCLUDED = (".venv", "venv", "env", "__pycache__", ".git", "node_modules", "$RECYCLE.BIN", "System Volume Information")
ENTRY = "path string, name string, parent string, is_folder boolean, length long, modified timestamp, listed boolean, error string"
#: Folders that one listing task enters below the folder it was given before it hands the rest on.
FOLDERS_AT_ONCE = 200
#: Entries after which a listing task hands out a batch.
AT_ONCE = 10_000


def _children(folder: str) -> list[tuple[str, bool, int | None, datetime | None]]:
    """What is directly in a folder of any store that Arrow knows by its URI, or of a path that all executors see."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(folder)
    return [(f.base_name, f.type == fs.FileType.Directory, f.size, f.mtime) for f in store.get_file_info(fs.FileSelector(inside))]


def _walk(excluded: frozenset[str], most: int):
    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []  # of many roots: a batch for each costs more than to list it
        for batch in batches:
            for root in batch.column("path").to_pylist():
                waiting, entered = [root], 0
                while waiting:
                    if len(rows) >= AT_ONCE:
                        yield _entries(rows)
                        rows = []
                    folder = waiting.pop()
                    if entered >= most:  # another task goes on here
                        rows.append((folder, folder.rsplit("/", 1)[-1], None, True, None, None, False, None))
                        continue
                    entered += 1
                    try:
                        found, error = _children(folder), None
                    except OSError as e:
                        found, error = [], str(e)[:200]
                    rows.append((folder, folder.rsplit("/", 1)[-1], folder.rsplit("/", 1)[0], True, None, None, True, error))
                    for name, is_folder, size, modified in found:
                        path = f"{folder.rstrip('/')}/{name}"
                        if not is_folder:
                            at = modified.replace(tzinfo=timezone.utc) if modified is not None and modified.tzinfo is None else modified
                            rows.append((path, name, folder, False, size, at, False, None))
                        elif name.lower() not in excluded:
                            waiting.append(path)
        yield _entries(rows)

    return walk


_TYPES = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_(), pa.string()]


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], [x.split()[0] for x in ENTRY.split(", ")])


def tree_entries(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, folders_at_once: int = FOLDERS_AT_ONCE) -> DataFrame:
    """``path, name, parent, is_folder, length, modified, listed, error``: all folders and files under a root.

    Folders are listed by tasks, a round for what the round before has left:
    a task enters up to ``folders_at_once`` folders and hands the others on, which
    are dealt over all tasks again.  A folder whose name is ``excluded``, in any
    case, is neither entered nor reported.  A folder that cannot be read is
    reported with its ``error``.  ``root`` is a path or a URI that every executor
    can read; links are not followed into cycles, as stores report them as files.
    """
    root = root.rstrip("/") or "/"
    walk = _walk(frozenset(x.lower() for x in excluded), folders_at_once)
    folder = scratch_path(spark, "tree")
    frontier, rounds = spark.createDataFrame([(root,)], "path string"), []
    while True:
        found = write_to(frontier.mapInArrow(walk, ENTRY), f"{folder}/{len(rounds)}")
        rounds.append(f"{folder}/{len(rounds)}")
        left = found.where("is_folder and not listed").select("path")
        if left.isEmpty():
            break
        frontier = left.repartition(spark.sparkContext.defaultParallelism * 4)
    every = spark.read.schema(ENTRY).parquet(*rounds)
    return every.where("not is_folder or listed")


def file_inventory(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, glob: str | None = None) -> DataFrame:
    """``path, name, length, modified`` of all files under a root; excluded folders are not entered, contents not read."""
    files = tree_entries(spark, root, excluded).where("not is_folder").select("path", "length", "modified", "name")
    return search_files(files, glob) if glob else files


def search_files(files: DataFrame, glob: str) -> DataFrame:
    return files.where(F.lower("name").rlike(glob_pattern(glob.lower())))


def with_extension(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    return files.where(F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).isin(*[e.lower() for e in extensions]))


def find_large_files(files: DataFrame, min_bytes: int, limit: int | None = 25) -> DataFrame:
    out = files.where(F.col("length") >= min_bytes).orderBy(F.desc("length"), "path")
    return out.limit(limit) if limit else out


def folder_sizes(files: DataFrame, root: str) -> DataFrame:
    """Files, bytes and folders under every folder below ``root``, all in one job: each file counts for all folders above it."""
    inside = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), r"[^/]*\z", "")
    parts = F.filter(F.split(inside, "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    each = files.select("path", "length", F.explode(above).alias("folder"))
    sums = each.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    folders = sums.where("folder <> ''").select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("folder", "/")) - 1), lambda n: F.concat_ws("/", F.slice(F.split("folder", "/"), 1, n)))).alias("folder"))
    return sums.join(folders.groupBy("folder").agg(F.count(F.lit(1)).alias("n_folders")), "folder", "left").fillna(0, ["n_folders"])


def list_folder(entries: DataFrame, folder: str) -> DataFrame:
    """Folders, then files, directly in a folder, by name, with kind, size and time, from ``tree_entries``."""
    own = entries.where(F.col("parent") == (folder.rstrip("/") or "/"))
    kind = F.when(F.col("is_folder"), "folder").otherwise("file")
    return own.select("name", kind.alias("kind"), "length", "modified", "path").orderBy(F.desc("kind"), F.lower("name"), "name")


def file_metadata(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Kind, size, extension and time of the asked paths (``path``) that are there."""
    own = asked.select("path").distinct().join(entries, "path")
    extension = F.when(~F.col("is_folder"), F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    return own.select("path", "name", F.when(F.col("is_folder"), "folder").otherwise("file").alias("kind"), extension.alias("extension"), "length", "modified")


def files_exist(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Asked paths (``path``) that are there."""
    return asked.join(files.select("path"), "path", "left_semi")


def grep_files(spark: SparkSession, root: str, text: str, extensions: tuple[str, ...], limit: int | None = 50, max_bytes: int | None = None, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """``path, line_no, line`` of lines that hold a text, whatever its case, and ``path, length, reason`` of files not searched.

    Files of the extensions are split, so that many tasks search a large one; line
    numbers count from 1 over the whole file.  A file is left out, and reported,
    if its extension is not among the asked ones, or if it is over ``max_bytes``
    where that is given.  Bytes that are no UTF-8 become replacement characters.
    Files and folders whose names begin with a dot or an underscore are invisible
    here, as they are to all of Spark's readers.
    """
    files = listed(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)).select("path", "length").withColumn("name", F.substring_index("path", "/", -1))
    wanted = with_extension(files, extensions)
    skipped = files.join(wanted.select("path"), "path", "left_anti").withColumn("reason", F.lit("extension"))
    if max_bytes is not None:
        skipped = skipped.unionByName(wanted.where(F.col("length") > max_bytes).withColumn("reason", F.lit("size")))
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    found = matching_lines(spark, root, lambda line: F.contains(F.lower(line), F.lit(text.lower())))
    found = found.where(extension.isin(*[e.lower() for e in extensions]))
    if max_bytes is not None:
        found = found.join(skipped.where("reason = 'size'").select("path"), "path", "left_anti")
    out = found.select("path", (F.col("line_no") + 1).alias("line_no"), strip(F.col("line")).alias("line")).orderBy("path", "line_no")
    return (out.limit(limit) if limit else out), skipped.select("path", "length", "reason")
