"""Importance resampling towards a target distribution over hashed word n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.llm.stages import written
from opsframe.llm.textkit import chunks, released, text_buffers

#: Distances from a span's end that the position table holds; longer spans are folded in blocks of so many bytes.
BLOCK = 64
#: Bytes of text, and of feature spans, handled at once.
STRETCH, SPAN_BYTES = 1 << 18, 1 << 20


def _position_table() -> np.ndarray:
    """[distance from the end, byte] -> what that byte adds (XOR) to the linear part of a CRC-32."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    table = np.empty((BLOCK, 256), np.uint32)
    table[0] = step
    for d in range(1, BLOCK):
        table[d] = (table[d - 1] >> 8) ^ step[table[d - 1] & 0xFF]
    return table


_TABLE = _position_table()
_FLAT = _TABLE.ravel()
#: Shifts of a state by BLOCK * 2**j bytes: four tables of 256, one for each byte of the state.
_SHIFTS = [np.stack([_TABLE[BLOCK - 1 - i] for i in range(4)])]


def _shifted(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][state & 0xFF] ^ tables[1][(state >> 8) & 0xFF] ^ tables[2][(state >> 16) & 0xFF] ^ tables[3][state >> 24]


def _folded(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States moved on by ``blocks`` blocks of zero bytes, a binary digit at a time."""
    j = 0
    while (blocks >> j).any():
        while len(_SHIFTS) <= j:
            _SHIFTS.append(_shifted(_SHIFTS[-1], _SHIFTS[-1]))
        moved = np.flatnonzero((blocks >> j) & 1)
        state[moved] = _shifted(state[moved], _SHIFTS[j])
        j += 1
    return state


def _constants() -> np.ndarray:
    """CRC-32 of 0 to BLOCK zero bytes: what a span's length alone adds."""
    out = np.zeros(BLOCK + 1, np.uint32)
    state = 0xFFFFFFFF
    for n in range(1, BLOCK + 1):
        state = (state >> 8) ^ int(_TABLE[0][state & 0xFF])
        out[n] = state ^ 0xFFFFFFFF
    return out


_LENGTH = _constants()


def span_crcs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every byte span [start, end) of ``raw``; spans may overlap and must not be empty.

    Bytes' contributions by distance from the end are looked up and joined by XOR
    over each block of a span; blocks before the last are moved on by the bytes
    behind them.  Spans go through in groups of bounded bytes, a long one in
    several.
    """
    size = end - start
    n_blocks = -(-size // BLOCK)
    first = np.cumsum(n_blocks) - n_blocks
    behind = np.repeat(first + n_blocks, n_blocks) - 1 - np.arange(int(n_blocks.sum()))
    stop = np.repeat(end, n_blocks) - behind * BLOCK
    width = np.minimum(stop - np.repeat(start, n_blocks), BLOCK)
    state = np.empty(len(stop), np.uint32)
    bounds = np.concatenate(([0], np.cumsum(width)))
    lo = 0
    while lo < len(stop):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SPAN_BYTES, side="right")) - 1)
        w = width[lo:hi]
        at = bounds[lo:hi] - bounds[lo]
        distance = np.repeat(at + w, w) - 1 - np.arange(int(w.sum()))
        byte = raw[np.repeat(stop[lo:hi], w) - 1 - distance]
        state[lo:hi] = np.bitwise_xor.reduceat(_FLAT[distance * 256 + byte], at)
        lo = hi
    out = np.bitwise_xor.reduceat(_folded(state, behind), first) if len(start) else np.zeros(0, np.uint32)
    long = np.flatnonzero(size > BLOCK)
    out ^= _LENGTH[np.minimum(size, BLOCK)]
    if len(long):  # the constant of BLOCK bytes gives way to that of the true length
        ones = np.bitwise_xor.reduce(_TABLE[[BLOCK - 1, BLOCK - 2, BLOCK - 3, BLOCK - 4], 0xFF])
        rest = size[long] - BLOCK
        moved = _folded(np.full(len(long), ones, np.uint32), rest // BLOCK)
        odd = rest % BLOCK
        for step in np.flatnonzero(np.bincount(odd, minlength=1)[1:]) + 1:
            at = odd == step
            moved[at] = _bytes_on(moved[at], int(step))
        out[long] ^= _LENGTH[BLOCK] ^ moved ^ np.uint32(0xFFFFFFFF)
    return out


def _bytes_on(state: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        state = (state >> 8) ^ _TABLE[0][state & 0xFF]
    return state


_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _stretches(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """(bytes, offsets, first text, whether the first word was counted before) of lower-cased texts, a long one in several stretches.

    A later stretch of a text begins with the last word of the one before, so
    that no run of two words is lost.
    """
    for lo, hi in chunks(raw, offsets, STRETCH):
        part = _LOWER[raw[offsets[lo] : offsets[hi]]]
        if hi - lo > 1 or len(part) <= STRETCH:
            yield part, offsets[lo : hi + 1] - offsets[lo], lo, False
            continue
        at, tail = 0, part[:0]
        while at < len(part):
            stop = min(at + STRETCH, len(part))
            while stop < len(part) and _WORD[part[stop - 1]] and _WORD[part[stop]]:  # not inside a word
                inside = _WORD[part[stop : stop + STRETCH]]
                stop += len(inside) if inside.all() else int(np.argmin(inside))
            piece = np.concatenate((tail, np.array([0x20], np.uint8), part[at:stop])) if len(tail) else part[at:stop]
            yield piece, np.array([0, len(piece)]), lo, len(tail) > 0
            solid = np.flatnonzero(_WORD[piece])
            if len(solid):
                end = int(solid[-1]) + 1
                gaps = np.flatnonzero(~_WORD[piece[:end]])
                tail = piece[int(gaps[-1]) + 1 if len(gaps) else 0 : end]
            at = stop


def feature_hashes(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each feature, CRC-32 of each feature, text of each word) of consecutive texts, in stretches.

    Features are words and runs of two words joined by one space.
    """
    for part, at, first_text, seen in _stretches(raw, offsets):
        solid = _WORD[part]
        begin, final = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        final[:-1] &= ~solid[1:]
        starts, ends = at[:-1][at[:-1] < len(part)], at[1:][at[1:] > 0] - 1
        begin[starts], final[ends] = solid[starts], solid[ends]
        start, end = np.flatnonzero(begin), np.flatnonzero(final) + 1
        text = np.searchsorted(at, start, side="right") - 1
        # the words alone, one space after each: runs of words are spans of this
        size = end - start
        put = np.cumsum(size + 1) - size - 1
        packed = np.full(int((size + 1).sum()), 0x20, np.uint8)
        packed[np.repeat(put - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = part[solid]
        pairs = np.flatnonzero(text[1:] == text[:-1])
        single = np.arange(int(seen), len(start))
        spans = np.concatenate((put[single], put[pairs])), np.concatenate((put[single] + size[single], put[pairs + 1] + size[pairs + 1]))
        yield np.concatenate((text[single], text[pairs])) + first_text, span_crcs(packed, *spans), text[single] + first_text


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """Features of all texts in each bucket: ``bucket, n``.  Every task sends one sum for each bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, crc, _ in feature_hashes(*text_buffers(batch.column(0))):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        released()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    found = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000) -> list[int]:
    """Gain of each bucket: 1000 times the log of its smoothed share in the target over that in the documents, floored."""
    own, wanted = ({r.bucket: r.n for r in bucket_counts(x, text_col, buckets).collect()} for x in (docs, target))  # a row for each bucket
    s, t = sum(own.values()), sum(wanted.values())
    ratio = lambda b: float(wanted.get(b, 0) + 1) * float(s + buckets) / (float(own.get(b, 0) + 1) * float(t + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def importance_scores(docs: DataFrame, gains: list[int], seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row.

    ``weight`` is the floored mean of the gains over all features, 0 without
    any.  ``score`` adds Gumbel noise drawn from the id alone, so that the
    highest scores are a draw without replacement in proportion to
    exp(weight / 1000), the same in every run; without an id it is null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n = batch.num_rows
            words, features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for text, crc, word_text in feature_hashes(*text_buffers(batch.column("text"))):
                words += np.bincount(word_text, minlength=n)
                features += np.bincount(text, minlength=n)
                np.add.at(total, text, gain[crc % np.uint32(len(gain))])
            weight = total // np.maximum(features, 1)
            noise = [None if h is None else math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column("h").to_pylist()]
            scores = pa.array([None if x is None else w + x for w, x in zip(weight.tolist(), noise, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, features, weight)), scores], ["doc_id", "n_words", "n_features", "weight", "score"])
        released()

    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), draw.alias("h"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def draw_ranks(scored: DataFrame, share: tuple[int, int] = (25, 100), min_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 … over the drawn rows, by score from the highest and then by the smaller id; null for others.

    Scores are whole numbers within a range that does not grow with the data (a
    gain lies between ±50,000, the noise between -3,200 and 22,200), so counts by
    score are a small table: its running sums give each score's first rank and
    the lowest score that is drawn.  Rows are numbered inside their score only,
    and only from that score up.
    """
    eligible = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    counts = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    higher = W.orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    starts = written(counts.withColumn("ahead", F.coalesce(F.sum("n").over(higher), F.lit(0))), "resample-starts")
    # a document without an id has words, but no noise to be drawn by: it counts in the share
    size = scored.where(F.col("n_words") >= min_words).count() * share[0] // share[1]
    lowest = starts.where(F.col("ahead") < size).agg(F.min("score")).first()[0]
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = F.coalesce(eligible & (F.col("score") >= lowest), F.lit(False))
    inside = F.row_number().over(W.partitionBy("score").orderBy("doc_id"))
    top = scored.where(near).join(F.broadcast(starts.select("score", "ahead")), "score").withColumn("place", F.col("ahead") + inside)
    top = top.withColumn("rank", F.when(F.col("place") <= size, F.col("place")).cast("long")).select(*scored.columns, "rank")
    return top.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), min_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's weight, score and rank in a draw of ``share`` of the documents towards the texts of ``target``.

    Words are runs of ASCII letters and digits and all other code points beyond
    ASCII, A-Z lower-cased; features, words and pairs of words, fall into
    ``buckets`` by CRC-32.  The driver and each task hold one number for each
    bucket, whatever the data.

    Returns ``doc_id, n_features, weight, score, rank``, a row for each input
    row.  Null or empty text: no features, weight 0, never drawn.  Null id:
    score and rank null.  Equal ids of equal score are put in either order.  No
    target texts: gains of the smoothing alone.  Other columns are not looked at.
    """
    gains = bucket_gains(docs, target, text_col, buckets)
    scored = written(importance_scores(docs, gains, seed, id_col, text_col), "resample-scores")
    return draw_ranks(scored, share, min_words).select("doc_id", "n_features", "weight", "score", "rank")
