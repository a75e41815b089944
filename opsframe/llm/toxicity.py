"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.stages import written
from opsframe.llm.textkit import Words, chunks, text_buffers

BLOCK = 64
#: Blocks of a query that are added up before any is skipped.
LEADING = 4
NEIGHBOURS = 15
#: A word's terms: its first bytes, which inflections share, and the word itself.
PREFIXES = (4, 5, 6)


def word_terms(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of term: the words that have one, and the terms' hashes."""
    yield np.arange(len(words.start)), words.hash
    for k in PREFIXES:
        yield words.prefix(k)


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and the range that each is of."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (start - np.cumsum(n) + n)[of], of


@dataclass
class Neighbourhood:
    """Labelled examples as unit TF-IDF vectors, in posting arrays by term, cut into blocks with their largest weight."""

    terms: np.ndarray  # sorted hashes of the vocabulary
    idf: np.ndarray
    ids: np.ndarray  # of the examples, in index order
    toxic: np.ndarray
    example: np.ndarray  # postings by term, then example
    weight: np.ndarray
    first: np.ndarray  # first posting of each block of a term, and the end of all
    block: np.ndarray  # examples // BLOCK
    peak: np.ndarray  # largest weight of each block of a term
    blocks_of: np.ndarray  # first block of each term, and the end of all
    stands_for: np.ndarray  # labelled documents for each example, by label
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def build(cls, terms: np.ndarray, df: np.ndarray, n_docs: int, sampled: dict[int, int], labelled: dict[int, int], rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Neighbourhood:
        """``rows``: id, label, vocabulary places and term counts of each example that has a vocabulary term.

        ``df`` and ``n_docs``: documents of the whole corpus with each term, and with any word.
        ``sampled`` and ``labelled``: examples and all labelled documents of each label.
        """
        idf = np.log1p(n_docs / df).astype(np.float32)
        rows = sorted(rows, key=lambda r: (r[1], r[2][np.argmax(idf[r[2]])], r[0]))  # like examples share blocks, which keeps bounds tight
        place = np.concatenate([r[2] for r in rows])
        example = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        v = (1 + np.log(np.concatenate([r[3] for r in rows]))) * idf[place]
        v = (v / np.sqrt(np.bincount(example, v * v))[example]).astype(np.float32)
        order = np.lexsort((example, place))
        t, e, w = place[order], example[order], v[order]
        key = t * (len(rows) // BLOCK + 1) + e // BLOCK
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        out = cls(
            terms, idf, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float32),
            e.astype(np.int32), w, np.append(first, len(e)), (e[first] // BLOCK).astype(np.int32), np.maximum.reduceat(w, first),
            np.searchsorted(t[first], np.arange(len(terms) + 1)),
            np.array([labelled[k] / sampled[k] for k in (0, 1)]),
        )
        out.calibrate(sampled, (example, place, v))
        return out

    @property
    def weights(self) -> list[np.ndarray]:
        """The index as dense blocks, vocabulary x examples; for small indexes only."""
        n_blocks = max(1, -(-len(self.ids) // BLOCK))
        dense = np.zeros((len(self.terms), n_blocks * BLOCK), np.float32)
        dense[np.repeat(np.arange(len(self.terms)), np.diff(self.first[self.blocks_of])), self.example] = self.weight
        return np.split(dense, n_blocks, axis=1)

    def vectors(self, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors of documents (document, vocabulary place, weight), from each term occurrence."""
        key, tf = np.unique(doc * len(self.terms) + place, return_counts=True)
        doc, place = np.divmod(key, len(self.terms))
        v = (1 + np.log(tf)) * self.idf[place]
        return doc, place, (v / np.sqrt(np.bincount(doc, v * v))[doc]).astype(np.float32)

    def nearest(self, q: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """``search`` for dense vectors."""
        row, place = np.nonzero(q)
        return self.search(row, place, q[row, place], len(q), k)

    def search(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The exact k largest cosines of each of ``n`` vectors and the places of those examples.

        ``row`` is in order.  The blocks with a row's largest bounds (query times
        largest weights) are added up first, then all those whose bound exceeds
        the k-th cosine found in them.
        """
        n_blocks = max(1, -(-len(self.ids) // BLOCK))
        best, who = np.zeros((n, k), np.float32), np.full((n, k), -1)
        for lo in range(0, n, 128):
            m = min(128, n - lo)
            a, b = np.searchsorted(row, (lo, lo + m))
            j, of = _ranges(self.blocks_of[place[a:b]], self.blocks_of[place[a:b] + 1])
            at, cell, q = row[a:b][of] - lo, self.block[j], value[a:b][of]
            bound = np.bincount(at * n_blocks + cell, q * self.peak[j], m * n_blocks).reshape(m, n_blocks) * (1 + 1e-5)  # rounding never hides a block
            lead = np.zeros((m, n_blocks), bool)
            np.put_along_axis(lead, np.argsort(-bound, axis=1)[:, :LEADING], True, 1)
            s = np.zeros((m, n_blocks * BLOCK))
            for turn in range(2):
                if turn:
                    lead = ~lead & (bound > -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k else True)
                use = np.flatnonzero(lead[at, cell])
                p, u = _ranges(self.first[j[use]], self.first[j[use] + 1])
                s += np.bincount(at[use][u] * s.shape[1] + self.example[p], q[use][u] * self.weight[p], s.size).reshape(s.shape)
            some = min(k, s.shape[1])
            top = np.argpartition(-s, some - 1, axis=1)[:, :some]
            top = np.take_along_axis(top, np.lexsort((top, -np.take_along_axis(s, top, 1)), axis=1), 1)
            best[lo : lo + m, :some], who[lo : lo + m, :some] = np.take_along_axis(s, top, 1), top
        who[best <= 0] = -1
        return best, who

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Share of the toxic among the neighbours, weighted by closeness and by how many labelled documents each stands for."""
        w = np.where(who >= 0, 1 / (1.05 - best), 0) * (self.stands_for / self.stands_for.min())[self.toxic[who].astype(int)]
        return (w * self.toxic[who]).sum(1) / (w.sum(1) + 0.1)

    def calibrate(self, sampled: dict[int, int], own_vectors: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Logistic calibration of left-one-out votes; an example stands for as many labelled documents as its label's sample does."""
        best, who = self.search(*own_vectors, len(self.ids), NEIGHBOURS + 1)
        own = who == np.arange(len(self.ids))[:, None]
        v = self.votes(np.where(own, 0, best), np.where(own, -1, who)).astype(np.float64)
        y = self.toxic.astype(np.float64)
        missing = [sampled[k] - (y == k).sum() for k in (0, 1)]  # examples without a vocabulary term get no vote
        v, y = np.append(v, [0.0, 0.0]), np.append(y, [0.0, 1.0])
        w = self.stands_for[y.astype(int)]
        w[-2:] *= missing
        w *= 1000 / w.sum()
        a, b = 4.0, -2.0
        for _ in range(100):  # Newton steps with a little ridge
            p = 1 / (1 + np.exp(-(a * v + b)))
            r, h = w * (p - y), w * p * (1 - p)
            g = np.array([(r * v).sum() + 0.1 * a, r.sum() + 0.1 * b])
            m = np.array([[(h * v * v).sum() + 0.1, (h * v).sum()], [(h * v).sum(), h.sum() + 0.1]])
            step = np.linalg.solve(m, g)
            a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        self.slope, self.shift = float(max(a, 0.1)), float(b)

    def score(self, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * v + self.shift)))


def _term_places(words: Words, terms: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary place and word of each occurrence of a vocabulary term."""
    places, at = [], []
    for have, h in word_terms(words):
        maybe = np.flatnonzero(sieve[h & np.uint64(0xFFFF)])
        i = np.minimum(np.searchsorted(terms, h[maybe]), len(terms) - 1)
        hit = terms[i] == h[maybe]
        places.append(i[hit])
        at.append(have[maybe[hit]])
    return np.concatenate(places), np.concatenate(at)


def _document_counts(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents (``text``) each of the sorted terms stands, and how many have a word at all."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = shared.value, 0
        sieve = np.zeros(1 << 16, bool)
        sieve[terms & np.uint64(0xFFFF)] = True
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for lo, hi in chunks(raw, offsets):
                words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                place, at = _term_places(words, terms, sieve)
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                df += np.bincount(np.unique(doc * len(terms) + place) % len(terms), minlength=len(terms))
                n += int((words.counts > 0).sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], ["place", "n"])

    found = dict(docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).collect())
    return np.array([found.get(i, 0) for i in range(len(terms))]), found.get(-1, 0)


def fit_neighbourhood(
    docs: DataFrame, labels: DataFrame, learn: Column, toxic_rows: int = 2048, clean_rows: int = 4096,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Neighbourhood | None:
    """The index over a bounded sample of the labelled documents where ``learn`` holds; None without both labels.

    The sample is taken by a hash of the id, about ``toxic_rows`` and
    ``clean_rows``.  The vocabulary is all terms whose document counts differ
    between the labels (chi-squared of at least 40, in at least 5 examples); how
    many of the documents have a term is counted over all of ``docs``.  A document
    labelled more than once counts as toxic if any label says so; rows that repeat an id make one example, of all their terms.
    """
    y = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sizes = {r.label: r["count"] for r in y.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    unit = F.shiftrightunsigned(F.xxhash64("id", F.lit(5)), 11) / float(1 << 53)
    share = F.when(F.col("label") == 1, toxic_rows / sizes[1]).when(F.col("label") == 0, clean_rows / sizes[0])
    y = y.where(unit < share).limit(2 * (toxic_rows + clean_rows))

    def terms_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for lo, hi in chunks(raw, offsets):
                words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                doc = np.repeat(np.arange(lo, hi), words.counts)
                have, h = (np.concatenate(x) for x in zip(*word_terms(words), strict=True))
                order = np.lexsort((h, doc[have]))
                h, d = h[order], doc[have][order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(h)))
                rows = pa.array(d[new])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("label").take(rows), pa.array(h[new].view(np.int64)), pa.array(tf.astype(np.int32))], ["id", "label", "term", "tf"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(y), "id").select("id", "label", "text")
    kind = d.schema["id"].dataType.simpleString()
    found = d.mapInArrow(terms_of, f"id {kind}, label int, term long, tf int")
    found = written(found.groupBy("id", "label", "term").agg(F.max("tf").alias("tf")), "toxic-terms")  # rows that repeat an id are one example
    n = dict(found.groupBy("label").agg(F.countDistinct("id")).collect())
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    if not (n1 and n0):
        return None
    a, df = F.sum("label").cast("double"), F.count(F.lit(1)).cast("double")
    each = found.groupBy("term").agg(a.alias("a"), df.alias("df")).where("df >= 5")
    b, c, e = F.col("df") - F.col("a"), n1 - F.col("a"), n0 - (F.col("df") - F.col("a"))
    chi = (n1 + n0) * F.pow(F.col("a") * e - b * c, F.lit(2.0)) / (F.lit(n1 * n0) * F.col("df") * F.greatest(n1 + n0 - F.col("df"), F.lit(0.5)))
    picked = each.withColumn("chi", chi).where("chi >= 40")
    top = picked.select("term").collect()
    if not top:
        return None
    terms = np.sort(np.array([r.term for r in top], np.int64).view(np.uint64))
    df, n_docs = _document_counts(docs.select(F.col(text_col).alias("text")), terms)
    rows = found.join(F.broadcast(picked.select("term")), "term").groupBy("id", "label").agg(F.collect_list("term").alias("t"), F.collect_list("tf").alias("n")).collect()
    rows = [(r.id, r.label, np.searchsorted(terms, np.array(r.t, np.int64).view(np.uint64)), np.array(r.n, np.float64)) for r in rows]
    return Neighbourhood.build(terms, df, n_docs, {0: int(n0), 1: int(n1)}, {k: sizes[k] for k in (0, 1)}, rows)


def score_toxicity(docs: DataFrame, model: Neighbourhood | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score of every whole text from its nearest labelled examples.

    Returns ``doc_id`` and the ``keep`` columns, ``score`` (calibrated, 0 to 1),
    ``predicted`` (1 if the score is 0.5 or more), ``n_neighbours`` and
    ``evidence`` (ids of the three nearest examples).  Null and empty texts, and
    texts without a vocabulary term, have no neighbour and get the calibrated
    score of no toxic vote; without a model all scores are 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sieve = np.zeros(1 << 16, bool)
        if m is not None:
            sieve[m.terms & np.uint64(0xFFFF)] = True
        for batch in batches:
            n = batch.num_rows
            score, count = np.full(n, float(m.score(np.zeros(1))[0]) if m else 0.0), np.zeros(n, np.int64)
            evidence: list[list[int]] = [[] for _ in range(n)]
            raw, offsets = text_buffers(batch.column("text"))
            for lo, hi in chunks(raw, offsets) if m else ():
                words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                place, at = _term_places(words, m.terms, sieve)
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                docs_with, doc = np.unique(doc, return_inverse=True)
                for first in range(0, len(docs_with), 512):
                    some = (doc >= first) & (doc < first + 512)
                    best, who = m.search(*m.vectors(place[some], doc[some] - first), min(512, len(docs_with) - first))
                    rows = lo + docs_with[first : first + 512]
                    score[rows], count[rows] = m.score(m.votes(best, who)), (who >= 0).sum(1)
                    for r, w in zip(rows, who[:, :3], strict=True):
                        evidence[r] = [int(m.ids[x]) for x in w if x >= 0]
            rest = [batch.column(c) for c in kept]
            arrays = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*rest, *arrays], [*kept, "score", "predicted", "n_neighbours", "evidence"])

    d = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    kept = ["doc_id", *keep]
    schema = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in kept)
    return d.mapInArrow(run, f"{schema}, score double, predicted int, n_neighbours long, evidence array<long>")
