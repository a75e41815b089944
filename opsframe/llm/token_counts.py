"""Token counts by a two-tier lookup of pre-token lengths."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A text with a space put before it falls into these pieces; no vocabulary piece crosses their borders:
#: in the vocabulary the mark U+2581, which stands for a space, only begins pieces, and no piece holds a line end.
PRE_TOKEN = re.compile("\n|[ ▁]*[^ ▁\n]+|[ ▁]+")
TABLE_SIZE = 65_536
#: Characters of pre-tokens that a worker's cache holds, and of the longest pre-token that it takes.
CACHE_CHARS, CACHED = 8_000_000, 256


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _lengths(processor, pieces: list[str]) -> list[int]:
    """Tokens of each pre-token.  The library puts a space before what it encodes:
    it takes the place of a piece's first space, or stands before an extra line end."""
    texts = [p[1:] if p[0] in " ▁" else p if p == "\n" else "\n" + p for p in pieces]
    extra = [(-1 if len(p) == 1 else 0) if p[0] in " ▁" else 1 if p == "\n" else 2 for p in pieces]  # a lone space is one token, an empty text none
    return [len(ids) - e for ids, e in zip(processor.encode(texts, num_threads=1), extra, strict=True)]


def check_vocabulary(model: bytes) -> None:
    """Refuse a vocabulary with pieces that cross pre-token borders."""
    p = _processor(model)
    for i in range(p.get_piece_size()):
        piece = p.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token border")


class Lengths:
    """Both tiers in one worker: the shared table, and a cache of what it lacks, emptied when its characters are used up."""

    def __init__(self, model: bytes, table: dict[str, int]):
        self.processor, self.table, self.cache, self.held = _processor(model), table, {}, 0

    def count(self, texts: list[str]) -> list[int]:
        pieces = [PRE_TOKEN.findall(" " + t) if t else () for t in texts]
        wanted = set().union(*pieces) - self.table.keys()
        misses = list(wanted - self.cache.keys())
        now = dict(zip(misses, _lengths(self.processor, misses), strict=True))
        known = self.table | {p: self.cache[p] for p in wanted if p in self.cache} | now
        kept = {p: n for p, n in now.items() if len(p) <= CACHED}
        size = sum(map(len, kept))
        if self.held + size > CACHE_CHARS:
            self.cache, self.held = {}, 0
        self.cache |= kept
        self.held += size
        get = known.__getitem__
        return [sum(map(get, p)) for p in pieces]


def _groups(column: pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of a column in groups of about ``limit`` characters."""
    group, size = [], 0
    for x in column:
        group.append(x.as_py() or "")
        size += len(group[-1])
        if size > limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def frequent_pre_tokens(docs: DataFrame, text_col: str = "text", rows: int = 4_000, size: int = 16_384) -> list[str]:
    """The ``TABLE_SIZE`` most frequent pre-tokens of a sample of about ``rows`` texts of at most ``size`` bytes, taken by a hash of the text.

    What is in the table only saves time, so a bounded sample will do, and no
    pre-token is ever shuffled: the sampled texts go to the driver as they are.
    """
    short = docs.where(F.octet_length(text_col) <= size).select(F.col(text_col).alias("text"))
    unit = F.shiftrightunsigned(F.xxhash64("text", F.lit(17)), 11) / float(1 << 53)
    seen: Counter[str] = Counter()
    for r in short.where(unit < rows / max(short.count(), 1)).limit(2 * rows).collect():
        seen.update(x for x in PRE_TOKEN.findall(" " + r.text) if len(x) <= 64)
    return [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TABLE_SIZE]]


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text as the sentencepiece library counts them, without begin or end tokens.

    First tier: a table of the lengths of the most frequent pre-tokens of a
    bounded sample, sent to all tasks (at most a few MB whatever the input).
    Second tier: what the table lacks is encoded once and kept in the worker's
    own cache, whose characters are bounded too.  Both tiers only save time:
    every length comes from the library.

    Returns ``doc_id, n_bytes, n_tokens, over_limit``, a row for each input row;
    a null text counts as empty: 0 bytes, 0 tokens.
    """
    check_vocabulary(model)
    pieces = frequent_pre_tokens(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model, dict(zip(pieces, _lengths(_processor(model), pieces), strict=True))))

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(*shared.value)
        for batch in batches:
            n = [x for group in _groups(batch.column("text")) for x in lengths.count(group)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(tokens, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
