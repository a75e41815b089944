"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.stages import unused
from opsframe.llm.textkit import text_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
_TAPS = max(WIDTHS)
_WIDE = FILTERS * len(WIDTHS)
#: 1 where a filter of its width has a tap
_MASK = np.repeat(np.array([[k < w for w in WIDTHS] for k in range(_TAPS)]), FILTERS, axis=1).astype(np.float32)


@dataclass
class ByteConvNet:
    """Embedding, filters of several widths, max pooling over a window, softmax."""

    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # taps x EMBED x all filters
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fit(cls, windows: list[bytes], labels: list[str], epochs: int = 8, seed: int = 3) -> ByteConvNet:
        """Train on labelled windows; short cuts of them are mixed in, so that short texts are known too."""
        rng = np.random.default_rng(seed)
        langs = sorted(set(labels))
        y = np.searchsorted(np.array(langs), np.array(labels))
        x = np.zeros((len(windows), WINDOW), np.uint8)
        size = np.zeros(len(windows), np.int64)
        for i, w in enumerate(windows):
            w = w[:WINDOW]
            x[i, : len(w)] = np.frombuffer(w, np.uint8)
            size[i] = len(w)
        p = {
            "embed": rng.normal(0, 0.3, (256, EMBED)), "filters": rng.normal(0, 0.25, (_TAPS, EMBED, _WIDE)) * _MASK[:, None],
            "bias": np.zeros(_WIDE), "dense": rng.normal(0, 0.2, (_WIDE, len(langs))), "dense_bias": np.zeros(len(langs)),
        }
        p = {k: v.astype(np.float32) for k, v in p.items()}
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        share = np.bincount(y, minlength=len(langs)) / len(y)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), 64):
                rows = order[lo : lo + 64]
                xb = x[rows].copy()
                cut = np.where(rng.random(len(rows)) < 0.4, rng.integers(6, 80, len(rows)), WINDOW)
                xb[np.arange(WINDOW)[None] >= np.minimum(cut, size[rows])[:, None]] = 0
                grads = cls._gradients(p, xb, y[rows], 1 / (share[y[rows]] * len(langs)))
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= np.float32(4e-3) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                p["filters"] *= _MASK[:, None]
        return cls(langs, **p)

    @staticmethod
    def _gradients(p: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        n, rows = WINDOW - _TAPS + 1, np.arange(len(x))
        e = p["embed"][x]
        z = sum(e[:, k : k + n] @ p["filters"][k] for k in range(_TAPS)) + p["bias"]
        at = z.argmax(1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0]
        h = np.maximum(top, 0)
        logits = h @ p["dense"] + p["dense_bias"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[rows, y] -= 1
        q = (q * weight[:, None] / len(x)).astype(np.float32)
        dh = (q @ p["dense"].T) * (top > 0)  # only the place of the maximum passes anything on
        g = {"dense": h.T @ q, "dense_bias": q.sum(0), "bias": dh.sum(0), "embed": np.zeros_like(p["embed"]), "filters": np.zeros_like(p["filters"])}
        for k in range(_TAPS):
            seen = x[rows[:, None], at + k]
            g["filters"][k] = np.einsum("bfe,bf->ef", p["embed"][seen], dh)
            np.add.at(g["embed"], seen.ravel(), (dh[..., None] * p["filters"][k].T[None]).reshape(-1, EMBED))
        return g

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a pair of bytes adds to each filter, as its first two taps and as its last two."""
        tap = [self.embed @ self.filters[k] for k in range(_TAPS)]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, _WIDE).astype(np.float32)
        return pair(tap[0], tap[1]) + self.bias, pair(tap[2], tap[3])

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Softmax for each row of windows (n x WINDOW bytes, zeros at the end)."""
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        z = tables[0].take(two[:, :-2], axis=0)
        z += tables[1].take(two[:, 2:], axis=0)
        logits = np.maximum(z.max(1), 0) @ self.dense + self.dense_bias
        q = np.exp(logits - logits.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)


def training_windows(labelled: DataFrame, text_col: str, lang_col: str, rows: int, total: int, seed: int = 11) -> list:
    """Windows of about ``rows`` documents of each language, fewer if all languages together would exceed ``total``; taken by a hash of the text."""
    langs = labelled.groupBy(F.col(lang_col).alias("lang")).count().collect()  # a row for each language
    rows = min(rows, -(-total // max(len(langs), 1)))
    pick = F.xxhash64(F.col(text_col), F.lit(seed))
    share = F.create_map(*[F.lit(v) for r in langs for v in (r.lang, min(1.0, rows / r["count"]))]) if langs else F.create_map(F.lit(""), F.lit(0.0))
    unit = F.shiftrightunsigned(pick, 11) / float(1 << 53)
    taken = labelled.where(unit < F.coalesce(F.try_element_at(share, F.col(lang_col)), F.lit(0.0)))
    room = F.greatest(F.length(text_col) - WINDOW, F.lit(1))
    starts = [F.lit(1), F.pmod(pick, room).cast("int") + 1, F.pmod(F.xxhash64(pick), room).cast("int") + 1]
    windows = F.array_distinct(F.array(*[F.substring(F.col(text_col), s, F.lit(WINDOW)) for s in starts]))
    # copies of a text share its hash: a text taken has its copies taken too, so they count once
    return taken.select(F.col(lang_col).alias("lang"), F.explode(windows).alias("window")).distinct().collect()


def fit_language_model(docs: DataFrame, learn: Column, rows: int = 1500, total: int = 30_000, text_col: str = "text", lang_col: str = "lang") -> ByteConvNet | None:
    """Fit on a sample of the labelled documents where ``learn`` holds; None without any.

    Every language that has a labelled text with a letter is learned.  The
    sample holds about ``rows`` documents of each, or ``total`` shared out
    evenly where there are more than total / rows languages (one at least), with
    up to three windows of each text; copies of a text count once.  A fifth of
    the windows is also learned in capitals.
    """
    labelled = docs.where(learn & F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    found = sorted((r.lang, r.window) for r in training_windows(labelled, text_col, lang_col, rows, total))
    found += [(lang, w.upper()) for lang, w in found[::5]]
    return ByteConvNet.fit([w.encode() for _, w in found], [lang for lang, _ in found]) if found else None


def _predict(net: ByteConvNet | None, tables: tuple | None, texts: pa.Array, named: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place of the likeliest language (-1: none) and its mean probability over all windows, for each text."""
    raw, offsets = text_buffers(texts)
    named = np.asarray(named)
    n = len(named)
    pred, score = np.full(n, -1), np.zeros(n)
    if net is None or not n:
        return pred, score
    each = np.where(named, -(-np.diff(offsets) // WINDOW), 0)
    first = np.concatenate(([0], np.cumsum(each)))
    sums = np.zeros((n, len(net.langs)))
    step = 1024
    for lo in range(0, first[-1], step):
        k = np.arange(lo, min(lo + step, first[-1]))
        doc = np.searchsorted(first, k, side="right") - 1
        begin = offsets[doc] + (k - first[doc]) * WINDOW
        x = raw.take(np.minimum(begin[:, None] + np.arange(WINDOW), len(raw) - 1))
        size = np.minimum(offsets[doc + 1] - begin, WINDOW)
        short = size < WINDOW
        x[short] = np.where(np.arange(WINDOW) < size[short, None], x[short], 0)
        np.add.at(sums, doc, net.probabilities(x, tables) * size[:, None])
    known = each > 0
    sums[known] /= sums[known].sum(1, keepdims=True)
    pred[known] = sums[known].argmax(1)
    score[known] = sums[known].max(1)
    return pred, score


def _has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify_language(docs: DataFrame, model: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: mean of the network's softmax over all its windows.

    Returns ``doc_id`` and the ``keep`` columns, ``lang_pred`` (the likeliest
    learned language; ``und`` for a text that is null, empty or without a letter,
    or if nothing was learned) and ``score`` (its mean probability; 0 for ``und``).
    Texts are cut into windows of ``WINDOW`` bytes; the last one is filled with zeros.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        langs = [*(net.langs if net else []), "und"]
        for batch in batches:
            pred, score = _predict(net, tables, batch.column("text"), batch.column(named))
            names = pa.array(langs, pa.string()).take(pa.array(np.where(pred < 0, len(langs) - 1, pred)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), names, pa.array(score)], [*kept, "lang_pred", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    kept = ["doc_id", *keep]
    schema = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in kept)
    named = unused(d, "named")
    return d.withColumn(named, _has_letter("text")).mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: ByteConvNet | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or has a score under ``least``; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            pred, score = _predict(net, tables, batch.column(text_col), batch.column(named))
            yield batch.select(columns).filter(pa.array((pred >= 0) & (score >= least)))

    columns, named = docs.columns, unused(docs, "named")
    return docs.withColumn(named, _has_letter(text_col)).mapInArrow(run, docs.schema)
