"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.stages import unused, written
from opsframe.llm.textkit import Words, chunks, mix, roll, running_windows, text_buffers

#: Rows of seeds, items or keys up to which a table is sent to all tasks; larger ones are joined by shuffling.
SEND_ROWS = 500_000
#: Bits of the sieve for each seed of the benchmark, most bits of the sieve (16 MB), and bits that a seed sets.
SIEVE_BITS, SIEVE_MOST, SIEVE_MARKS = 64, 1 << 27, 6
#: Pairs of a task that tiles them, about.
TASK_PAIRS = 5_000


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (place in item, place in text, length).

    The longest match of unmarked words comes first and is marked in both; then
    the next, down to ``least`` words.  Matches of a length are found by running
    Karp-Rabin hashes of all unmarked windows; of equally long ones the first in
    the item wins, then the first in the text.  The next length is searched by
    halving, since a match holds matches of all smaller lengths.
    """
    tiles: list[tuple[int, int, int]] = []
    free = [np.ones(len(item), bool), np.ones(len(text), bool)]
    sums = [running_windows(item), running_windows(text)]

    def windows(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for mask, (total, inverse) in zip(free, sums, strict=True):
            taken = np.concatenate(([0], np.cumsum(~mask)))
            at = np.flatnonzero(taken[size:] == taken[: len(mask) - size + 1]) if size <= len(mask) else np.zeros(0, np.int64)
            out.append((at, mix((total[at + size] - total[at]) * inverse[at])))
        return out

    def met(size: int) -> bool:
        (_, a), (_, b) = windows(size)
        return bool(np.isin(a, b).any())

    most = min(len(item), len(text))
    while most >= least and met(least):
        lo, hi = least, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if met(mid) else (lo, mid - 1)
        (places, a), (spots, b) = windows(lo)
        order = np.argsort(b, kind="stable")
        known = b[order]
        starts: dict[int, int] = {}
        for k in np.flatnonzero(np.isin(a, b)):
            p, h = places[k], int(a[k])
            if not free[0][p : p + lo].all():
                continue
            # places in the text that are taken stay so: each is passed once
            i = starts.get(h, int(np.searchsorted(known, a[k])))
            while i < len(known) and known[i] == a[k] and not free[1][spots[order[i]] : spots[order[i]] + lo].all():
                i += 1
            starts[h] = i
            if i < len(known) and known[i] == a[k]:
                t = spots[order[i]]
                free[0][p : p + lo] = free[1][t : t + lo] = False
                tiles.append((int(p), int(t), lo))
        most = lo - 1
    return tiles


def _items(benchmark: DataFrame, least: int) -> DataFrame:
    """``item, item_id, n, words, seeds, times``: each item with its word hashes, the distinct hashes of its ``least``-word windows (of all its words, if it has fewer) and how often it has each."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            w = Words(raw, offsets)
            each = [w.hash[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
            seeds = [np.unique(roll(h, min(least, len(h))), return_counts=True) if len(h) else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for h in each]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + len(each))), batch.column("item_id"), pa.array([len(h) for h in each], pa.int64()), pa.array([h.tobytes() for h in each], pa.binary()), pa.array([u.view(np.int64) for u, _ in seeds], pa.list_(pa.int64())), pa.array([n for _, n in seeds], pa.list_(pa.int64()))],
                ["item", "item_id", "n", "words", "seeds", "times"],
            )
            at += len(each)

    return benchmark.mapInArrow(run, f"item long, item_id {kind}, n long, words binary, seeds array<long>, times array<long>").where("n > 0")


def _marks(seeds: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of the sieve that the seeds set."""
    for k in range(SIEVE_MARKS):
        yield (mix(seeds + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64)


def _sieve(seeds: DataFrame) -> np.ndarray:
    """A bit map of fixed size that all seeds (``seed``) pass; what else passes it is sorted out by a join."""
    n = seeds.count()
    bits = min(SIEVE_MOST, 1 << max(10, math.ceil(math.log2(max(1, n * SIEVE_BITS)))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.asarray(batch.column("seed")).view(np.uint64)
            for m in _marks(s, bits):
                yield pa.RecordBatch.from_arrays([pa.array(m >> 6), pa.array((np.uint64(1) << (m & 63).astype(np.uint64)).view(np.int64))], ["cell", "mark"])

    cells = seeds.mapInArrow(run, "cell long, mark long").groupBy("cell").agg(F.bit_or("mark").alias("mark")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("mark").to_numpy()
    return out.view(np.uint8)


def _hits(docs: DataFrame, sieve: np.ndarray, widths: list[int]) -> DataFrame:
    """``doc_id, text_key, words, hits``: texts with windows that pass the sieve; those windows' words, and hashes.

    Words outside such windows are left out; each gap becomes one word that no item has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sieve)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for lo, hi in chunks(raw, offsets):
                w = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found = []
                for width in widths:
                    rolled = roll(w.hash, width)
                    at = np.arange(len(rolled))
                    for m in _marks(rolled, 8 * len(known)) if len(rolled) else ():
                        at = at[(known[m[at] >> 3] >> (m[at] & 7) & 1).astype(bool)]
                    text = np.searchsorted(w.bounds, at, side="right") - 1
                    inside = at + width <= w.bounds[text + 1]
                    found.append((at[inside], text[inside], rolled[at[inside]], np.full(int(inside.sum()), width)))
                at, text, seed, width = (np.concatenate(c) for c in zip(*found, strict=True))
                rows, words, hits = [], [], []
                for t in np.unique(text):
                    mine = text == t
                    seen = np.unique(np.concatenate([at[mine & (width == k)][:, None] + np.arange(k) for k in widths], axis=None))
                    gap = np.flatnonzero(np.diff(seen) > 1) + 1
                    rows.append(lo + t)
                    words.append(np.insert(w.hash[seen], gap, np.uint64(0)).tobytes())
                    hits.append(np.unique(seed[mine]).view(np.int64))
                if rows:
                    k = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(k), batch.column("text_key").take(k), pa.array(words, pa.binary()), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "text_key", "words", "hits"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, f"doc_id {kind}, text_key string, words binary, hits array<long>")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SEND_ROWS else table


def _tiled(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """Rows with a seed (``doc_id, text_key, passages``), and ``passages, item_id, coverage, n_tiles`` of each different set of passages and item that match.

    ``docs``: doc_id, text_key, text; ``benchmark``: item_id, text.  ``passages`` is
    a digest of what the sieve leaves of a text: texts that share the same phrases
    with the benchmark, and nothing else, are tiled as one.
    """
    items = written(_items(benchmark, least), "items")
    need = F.when(F.col("n") < least, 1).otherwise(F.ceil(F.lit(coverage) * F.col("n") / least - F.lit(1e-9)))
    each = items.select("item", need.cast("long").alias("need"), F.explode(F.arrays_zip("seeds", "times")).alias("s"))
    seeds = written(each.select("item", "need", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times")), "seeds")
    widths = [r.width for r in items.select(F.least("n", F.lit(least)).cast("int").alias("width")).distinct().collect()] or [least]
    rows = written(_hits(docs, _sieve(seeds.select("seed").distinct()), sorted(widths)).withColumn("passages", F.md5("words")), "hits")
    texts = written(rows.groupBy("passages").agg(F.first("words").alias("text_words"), F.first("hits").alias("hits")), "hit-texts")
    met = texts.select("passages", F.explode("hits").alias("seed")).join(_small(seeds), "seed").groupBy("passages", "item").agg(F.sum("times").alias("places"), F.max("need").alias("need"))
    # tiles that cover enough of an item hold at least so many places of its windows
    pairs = written(met.where("places >= need").select("passages", "item"), "pairs")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs.count() / TASK_PAIRS))
    pairs = pairs.join(_small(items.select("item", "item_id", "words")), "item").join(texts.select("passages", "text_words"), "passages")
    pairs = pairs.repartition(parts, "passages", "item")  # by pairs, not by bytes, whatever phrase they share
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, part, n = [], [], []
            for i, (a, b) in enumerate(zip(batch.column("words"), batch.column("text_words"), strict=True)):
                item, text = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                short = len(item) < least
                window = np.isin(roll(item, min(least, len(item))), roll(text, min(least, len(item))))
                covered = np.convolve(window, np.ones(min(least, len(item)))) > 0
                if covered.sum() < (1.0 if short else coverage) * len(item):
                    continue  # tiles cannot cover more than all shared windows do
                tiles = greedy_tiles(item, text, min(least, len(item)))
                done = sum(size for *_, size in tiles) / len(item)
                if done >= (1.0 if short else coverage):
                    at.append(i)
                    part.append(done)
                    n.append(len(tiles))
            k = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("passages").take(k), batch.column("item_id").take(k), pa.array(part, pa.float64()), pa.array(n, pa.int32())], ["passages", "item_id", "coverage", "n_tiles"])

    found = pairs.select("passages", "item_id", "words", "text_words").mapInArrow(run, f"passages string, item_id {kind}, coverage double, n_tiles int")
    return rows.select("doc_id", "text_key", "passages"), written(found, "tiled")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold a benchmark item, in one piece or in several in any order.

    Words are lower-cased (A-Z).  Tiles have ``least`` or more words; a pair is
    reported if the tiles cover ``coverage`` of the item's words.  An item with
    fewer than ``least`` words must occur whole.  One pass over the documents
    keeps windows that pass a sieve of the benchmark's seeds, at most 16 MB
    whatever the benchmark; a join on the seeds finds the pairs that share enough
    of them, and each pair of different passages and an item is tiled once.  Pairs
    are dealt to tasks by their number.

    Returns ``doc_id, item_id, coverage, n_tiles``, one row for each pair found
    (rows of repeated documents and of repeated items repeat).  Null and empty
    texts, and items without a word, match nothing.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    rows, found = _tiled(d, benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), least, coverage)
    return rows.join(_small(found), "passages").select("doc_id", "item_id", "coverage", "n_tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``find_contamination`` would report; all columns and all other rows stay.

    Rows are told by their text, so ids may be null or repeated.
    """
    key = unused(docs, "text_key")
    d = docs.select(F.lit(None).cast("int").alias("doc_id"), F.md5(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    rows, found = _tiled(d, benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), least, coverage)
    gone = written(rows.join(_small(found.select("passages").distinct()), "passages").select(F.col("text_key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, F.md5(F.col(text_col))).join(_small(gone), key, "left_anti").select(*docs.columns)
