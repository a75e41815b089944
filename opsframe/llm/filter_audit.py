"""What filters remove alone and in every order, kept up to date by a stream that takes earlier counts back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from itertools import permutations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from opsframe.llm.stages import delete, scratch_path, written

WORD = r"[^\x20\x09-\x0D]+"
#: Letter of the filter that fails texts which an earlier document has.
COPY = "E"
#: Texts whose states lie in one page; rows that a task gathers before it sends sums on.
PAGE_TEXTS, HELD_ROWS = 128, 50_000
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    PROVIDER: ROCKS,  # states lie on disk, not in the heap of executors
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores sets some MB of disk aside
    "spark.sql.streaming.minBatchesToRetain": "2",
}
COUNTERS = "part string, mask int, quality int, toxic int, n long"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of the filters A to D over a text and the array of its words."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def masked(docs: DataFrame, filters=text_filters, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, digest, mask, part``: a bit of ``mask`` for each filter that the text fails, in the order of ``filters``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    fails = filters(F.col("text"), F.col("words")).values()
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    return d.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.cast("int").alias("mask"), "part")


class _Held:
    """Rows of one task by text: those of the smallest id so far, and sums of the others, which fail as copies whatever comes."""

    def __init__(self) -> None:
        self.least: dict[bytes, tuple[int, int, dict]] = {}
        self.later: dict[tuple, int] = {}
        self.free: dict[tuple, int] = {}

    def add(self, digest: bytes, doc_id: int | None, mask: int, kind: tuple, n: int) -> None:
        if doc_id is None:  # no id is smaller or larger: never a copy, and makes none
            self.free[(digest, mask, kind)] = self.free.get((digest, mask, kind), 0) + n
            return
        held = self.least.get(digest)
        if held and held[0] < doc_id:
            self.later[(digest, mask, kind)] = self.later.get((digest, mask, kind), 0) + n
            return
        if held and held[0] > doc_id:
            for k, m in held[2].items():
                self.later[(digest, mask, k)] = self.later.get((digest, mask, k), 0) + m
            held = None
        kinds = held[2] if held else {}
        kinds[kind] = kinds.get(kind, 0) + n
        self.least[digest] = (doc_id, mask, kinds)

    def rows(self) -> Iterator[tuple]:
        for digest, (doc_id, mask, kinds) in self.least.items():
            yield from ((digest, doc_id, mask, *kind, n, False) for kind, n in kinds.items())
        yield from ((digest, None, mask, *kind, n, True) for (digest, mask, kind), n in self.later.items())
        yield from ((digest, None, mask, *kind, n, False) for (digest, mask, kind), n in self.free.items())


_FIELDS = ["digest", "doc_id", "mask", "part", "quality", "toxic", "n", "later"]
_ARRIVAL = "digest binary, doc_id long, mask int, part string, quality int, toxic int, n long, later boolean"
_TYPES = [pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side sums: of a text's rows in a task, those of the smallest id and counts of the rest."""
    held, seen = _Held(), 0

    def out() -> pa.RecordBatch:
        columns = zip(*held.rows(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _FIELDS)

    for batch in batches:
        for digest, doc_id, mask, part, quality, toxic in zip(*[batch.column(c).to_pylist() for c in ("digest", "doc_id", "mask", "part", "quality", "toxic")], strict=True):
            held.add(digest, doc_id, mask, (part, quality, toxic), 1)
        seen += batch.num_rows
        if seen >= HELD_ROWS:
            yield out()
            held, seen = _Held(), 0
    if seen:
        yield out()


#: The state of a page: for each kind of rows of a text's smallest id, one entry of these lists.
_STATE = "digest array<binary>, doc_id array<long>, mask array<int>, part array<string>, quality array<int>, toxic array<int>, n array<long>"


def _page_changes(copy_bit: int):
    def changes(key: tuple, arrivals: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Changes of the counters by what arrives at a page of texts, and its new state.

        A text's state is its smallest id with the rows that have it.  When a
        smaller id arrives, those rows were counted as no copies: that count is
        taken back and they count as copies.
        """
        least: dict[bytes, tuple[int, int, dict]] = {}
        if state.exists:
            for digest, doc_id, mask, part, quality, toxic, n in zip(*state.get, strict=True):
                least.setdefault(bytes(digest), (doc_id, mask, {}))[2][(part, quality, toxic)] = n
        change: dict[tuple, int] = {}

        def count(mask: int, kind: tuple, n: int) -> None:
            change[(mask, kind)] = change.get((mask, kind), 0) + n

        for pdf in arrivals:
            ids = [int(i) if has else None for i, has in zip(pdf["doc_id"], pdf["has_id"], strict=True)]
            for digest, doc_id, mask, part, quality, toxic, n, later in zip(
                pdf["digest"], ids, pdf["mask"].tolist(), pdf["part"], pdf["quality"].tolist(), pdf["toxic"].tolist(), pdf["n"].tolist(), pdf["later"].tolist(), strict=True
            ):
                kind = (part, quality, toxic)
                if doc_id is None:
                    count(mask | copy_bit if later else mask, kind, n)
                    continue
                held = least.get(digest)
                if held and held[0] < doc_id:
                    count(mask | copy_bit, kind, n)
                    continue
                if held and held[0] > doc_id:
                    for k, m in held[2].items():
                        count(mask, k, -m)
                        count(mask | copy_bit, k, m)
                    held = None
                kinds = held[2] if held else {}
                kinds[kind] = kinds.get(kind, 0) + n
                least[digest] = (doc_id, mask, kinds)
                count(mask, kind, n)
        lists = list(zip(*[(d, i, m, *k, n) for d, (i, m, kinds) in least.items() for k, n in kinds.items()], strict=True))
        if lists:
            state.update(tuple(map(list, lists)))
        out = [(k[0], m, k[1], k[2], n) for (m, k), n in change.items() if n]
        yield pd.DataFrame({c: np.array([r[i] for r in out], object if c == "part" else np.int64) for i, c in enumerate(("part", "mask", "quality", "toxic", "n"))})

    return changes


def stream_counters(arrivals: DataFrame, labels: DataFrame, pages: int, bits: int, id_col: str = "doc_id") -> DataFrame:
    """Stream of changes of the counters by part, mask, quality and toxic; ``arrivals`` is a stream of ``masked`` rows.

    States of texts are kept in ``pages`` pages by the first bits of their digest, so
    that a call serves many texts; a page holds some 128 texts if ``pages`` fits
    the table.
    """
    flags = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    d = arrivals.join(flags, "doc_id", "left").select("doc_id", "digest", "mask", "part", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")])
    page = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long") % pages
    d = d.mapInArrow(_gathered, _ARRIVAL).withColumns({"page": page, "has_id": F.col("doc_id").isNotNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    return d.groupBy("page").applyInPandasWithState(_page_changes(1 << bits), COUNTERS, _STATE, "update", GroupStateTimeout.NoTimeout)


def counters(spark: SparkSession, path: str, labels: DataFrame, filters=text_filters, micro_batches: int = 4, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents by part, mask of the filters that they fail, and labels, from all files at ``path`` as available-now micro-batches.

    Each micro-batch takes the same number of files, ``micro_batches`` in all.
    The stream's checkpoint, its states and the changes that each micro-batch
    adds are in the shared folder; a micro-batch that is run again writes the
    same file again.  What is left of them at the end is the sum of the changes.
    """
    table = spark.read.parquet(path)
    pages = max(1, ceil(table.count() / PAGE_TEXTS))
    files = max(1, ceil(len(table.inputFiles()) / micro_batches))
    folder = scratch_path(spark, "filter-audit")
    settings = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        # a pattern that only the path itself matches: a stream takes single files by pattern alone
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
        n_bits = len(filters(F.lit(""), F.array(F.lit(""))))
        changes = stream_counters(masked(stream, filters, id_col, text_col, part_col), labels, pages, n_bits, id_col)

        def add(batch: DataFrame, number: int) -> None:
            batch.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

        query = changes.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(add).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
        total = spark.read.schema(COUNTERS).parquet(f"{folder}/changes/batch=*").groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"))
        return written(total.where(F.col("n") != 0), "filter-counters")
    finally:
        for k, v in settings.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        delete(spark, folder)


def order_report(counted: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters ``letters`` step by step, from ``counters``: bit i of a mask belongs to letter i.

    Sums over at most 2**len(letters) masks for each part: no document is looked
    at again.
    """
    bit: Mapping[str, int] = {x: 1 << i for i, x in enumerate(letters)}
    by_mask = counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("bad"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    rows = by_mask.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    before = sum((F.when(F.locate(x, F.col("filter_order")) < F.col("step"), b).otherwise(0) for x, b in bit.items()), F.lit(0))
    rows = rows.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    own = F.coalesce(*[F.when(F.col("letter") == x, b) for x, b in bit.items()])
    rows = rows.withColumns({"here": F.col("mask").bitwiseAND(before) == 0, "fails": F.col("mask").bitwiseAND(own) != 0, "alone": F.col("mask") == own})
    total = lambda c, value="n": F.sum(F.when(c, F.col(value)).otherwise(0)).cast("long")
    here, fails = F.col("here"), F.col("fails")
    out = rows.groupBy("part", "filter_order", "step", "letter").agg(
        total(here & ~fails).alias("kept"), total(here & fails).alias("removed"), total(~here & fails).alias("redundant"), total(F.col("alone")).alias("unique_fails"),
        total(here & fails, "good").alias("good_lost"), total(here & fails, "bad").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, filters=text_filters, **columns: str) -> DataFrame:
    """Kept, removed, redundant and lost documents for each part, order of the filters and step.

    ``path`` is a Parquet table; its files are taken as micro-batches of a
    stream.  The filters ``filters`` judge a text by itself, the last one, ``E``,
    fails a document if an identical text has a smaller id anywhere in the table.
    Keyed state holds the smallest id of each text; a smaller id that comes later
    takes the earlier rows' counts back.  Rows of a text are summed in each task
    before they are shuffled, so a text with many copies is a few rows.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``; ``shapley`` sums what the step's filter
    removes over all orders.

    Null text: empty.  Null part: the empty string.  Null id: never a copy, and
    makes none.  Rows of the same id and text are no copies of each other.  A
    document without a label is neither good nor toxic; with several, one is
    enough.  Empty table: no rows.  Other columns are not looked at.
    """
    letters = "".join(filters(F.lit(""), F.array(F.lit("")))) + COPY
    return order_report(counters(spark, path, labels, filters, **columns), letters)
