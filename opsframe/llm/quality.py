"""Document quality: exact repetition counts and a modified Kneser-Ney character model."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.stages import written
from opsframe.llm.textkit import Words, chunks, roll, text_buffers

ORDER = 4
_BITS = 16
_MASK = [(1 << _BITS * n) - 1 for n in range(ORDER + 1)]
#: n-grams of each order that a language's ``KneserNey`` holds, about; beyond that it is pruned and its back-off weights are renewed.
TABLE_SIZE = 1 << 20
#: n-grams of the highest level, over all languages, whose costs are sent to the tasks (12 bytes each); those of all others are joined.
HELD = 1 << 22
#: Costs are whole numbers of these parts of a bit, so their sums do not depend on the order or on what is held.
PARTS = 1 << 20
#: Different n-grams that a task gathers before it passes them on.
GATHER = 1 << 21


def _symbols(points: np.ndarray) -> np.ndarray:
    """A symbol of 16 bits for each code point: itself, but white space and digits are one each; beyond the 16 bits, one of 2,048 in the private-use area."""
    s = np.where(points < 0x10000, points, 0xF000 + points % 0x800)
    s = np.where((points <= 0x20) | (points == 0xA0), 0x20, s)
    return np.where((points >= 0x30) & (points <= 0x39), 0x30, s).astype(np.uint64)


def _codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams inside single texts, and how many each text has, in text order."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    at = lead[offsets]
    symbols = _symbols(points)
    n = len(symbols) - ORDER + 1
    have = np.maximum(np.diff(at) - ORDER + 1, 0)
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    code = symbols[:n].copy()
    for k in range(1, ORDER):
        code = (code << np.uint64(_BITS)) | symbols[k : k + n]
    first = np.repeat(at[:-1] - np.cumsum(have) + have, have)
    return code[first + np.arange(len(first))], have


def ngram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, code, n``: counts of all character n-grams of all texts by language (null: empty string)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge() -> int:
            for lang, some in parts.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
                parts[lang] = [(keys, np.bincount(inverse, np.concatenate([n for _, n in some])).astype(np.int64))]
            return sum(len(p[0][0]) for p in parts.values())

        def passed_on() -> Iterator[pa.RecordBatch]:
            merge()
            for lang, ((keys, n),) in parts.items():
                for lo in range(0, len(keys), 1 << 16):
                    k = keys[lo : lo + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[lo : lo + (1 << 16)])], ["lang", "code", "n"])
            parts.clear()

        turn = 0
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            langs = np.array([x.as_py() or "" for x in batch.column("lang")], object)
            for lo, hi in chunks(raw, offsets):
                code, have = _codes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                names, of = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                of = np.repeat(of, have)
                for i, name in enumerate(names):
                    parts.setdefault(str(name), []).append(np.unique(code[of == i], return_counts=True))
                turn += 1
                if turn % 16 == 0 and merge() > GATHER:
                    yield from passed_on()
        yield from passed_on()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, "lang string, code long, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from how many n-grams have a count of 1 to 4."""
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    found = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [min(max(f, 0.05), most) for f, most in zip(found, (0.95, 1.95, 2.95), strict=True)]


def _by_language(values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]), F.col("lang"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``lang, level, code, n, logp``: interpolated modified Kneser-Ney probabilities of all n-grams of levels 1 to ORDER,
    and, with a null ``n``, the back-off weights (``logp``) of all contexts (``code``) of each level; base-2 logarithms.

    Counts, continuation counts, discounts and probabilities are Spark groupings
    and joins; the driver sees four sums for each language and level.
    """
    levels = {ORDER: written(counts, "grams")}
    for n in range(ORDER - 1, 0, -1):  # below the top: in how many contexts an n-gram follows
        code = F.col("code").bitwiseAND(F.lit(_MASK[n]))
        levels[n] = written(levels[n + 1].groupBy("lang", code.alias("code")).agg(F.count(F.lit(1)).alias("n")), "grams")
    symbols = {r.lang: r["count"] for r in levels[1].groupBy("lang").count().collect()}
    if not symbols:
        return levels[1].select("lang", F.lit(1).alias("level"), "code", "n", F.lit(0.0).alias("logp"))
    out, lower = None, None
    for n in range(1, ORDER + 1):
        d = levels[n]
        few = [F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
        cuts = {r.lang: _discounts([r.n1, r.n2, r.n3, r.n4]) for r in d.groupBy("lang").agg(*few).collect()}
        cut = [_by_language({lang: c[k] for lang, c in cuts.items()}) for k in range(3)]
        d = d.withColumns({"cut": F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2]), "context": F.shiftrightunsigned("code", _BITS)})
        contexts = d.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("held"))
        contexts = written(contexts.select("lang", "context", "total", (F.col("held") / F.col("total")).alias("back")), "contexts")
        d = d.join(contexts, ["lang", "context"])
        if n == 1:
            below = 1 / _by_language({lang: float(v + 1) for lang, v in symbols.items()})  # one place for what was never seen
        else:
            d = d.withColumn("end", F.col("code").bitwiseAND(F.lit(_MASK[n - 1]))).join(lower.select("lang", F.col("code").alias("end"), "p"), ["lang", "end"])
            below = F.col("p")
        lower = written(d.select("lang", "code", "n", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("back") * below).alias("p")), "probabilities")
        level = lower.select("lang", F.lit(n).alias("level"), "code", "n", F.log2("p").alias("logp"))
        level = level.unionByName(contexts.select("lang", F.lit(n).alias("level"), F.col("context").alias("code"), F.lit(None).cast("long").alias("n"), F.log2("back").alias("logp")))
        out = level if out is None else out.unionByName(level)
    return out


@dataclass
class KneserNey:
    """The model of one language, as sorted arrays of n-gram codes.

    ``keys[n]`` and ``logp[n]``: n-grams and the base-2 logarithms of their
    probabilities; ``contexts[n]`` and ``back[n]``: contexts of n-grams and the
    logarithms of their back-off weights.  An n-gram that is not there has the
    context's weight times the probability of its shorter end.
    """

    keys: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    back: dict[int, np.ndarray]

    @classmethod
    def of(cls, table: pa.Table) -> KneserNey:
        """From rows (level, code, n, logp) of one language."""
        level, seen = table.column("level").to_numpy(), table.column("n").is_valid().to_numpy()
        code, logp = table.column("code").to_numpy().view(np.uint64), table.column("logp").to_numpy().astype(np.float32)
        out = cls({}, {}, {}, {})
        for n in range(1, ORDER + 1):
            for mask, keys, values in ((seen, out.keys, out.logp), (~seen, out.contexts, out.back)):
                mine = np.flatnonzero(mask & (level == n))
                mine = mine[np.argsort(code[mine])]
                keys[n], values[n] = code[mine], logp[mine]
        return out

    def score(self, code: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Base-2 logarithm of the probability of each n-gram's last symbol."""
        if n == 0:
            return np.full(len(code), -math.log2(len(self.keys[1]) + 1), np.float32)
        i = np.minimum(np.searchsorted(self.keys[n], code), len(self.keys[n]) - 1)
        out = self.logp[n][i]
        miss = np.flatnonzero(self.keys[n][i] != code)
        if len(miss):
            rest = code[miss]
            context = rest >> np.uint64(_BITS)
            j = np.minimum(np.searchsorted(self.contexts[n], context), len(self.contexts[n]) - 1)
            back = np.where(self.contexts[n][j] == context, self.back[n][j], np.float32(0))
            out[miss] = back + self.score(rest & np.uint64(_MASK[n - 1]), n - 1)
        return out


def pruned(model: DataFrame, size: int = TABLE_SIZE) -> DataFrame:
    """``lang, level, code, n, logp`` as ``kneser_ney`` gives them, with at most about ``size`` n-grams for each level and language.

    The n-grams with the largest counts stay, and the shorter ends of those that
    stay one level up.  Back-off weights are those of what stays, so that a
    context's probabilities add up to one again: a context gives out what its
    n-grams leave over, in proportion to what their shorter ends leave over.
    Nothing is cut off a model that fits, and its weights come out as they were.
    """
    grams = model.where("n is not null").withColumn("step", F.floor(4 * F.log2("n")).cast("int"))
    least: dict[tuple[str, int], int] = {}
    sums: dict[tuple[str, int], int] = {}
    for r in grams.groupBy("lang", "level", "step").count().orderBy(F.desc("step")).collect():  # some hundred rows a language
        at = (r.lang, r.level)
        sums[at] = sums.get(at, 0) + r["count"]
        if sums[at] <= size or at not in least:
            least[at] = r.step
    if all(n <= size for n in sums.values()):
        return model  # nothing to cut: every weight would come out as it is
    spark = model.sparkSession
    cuts = spark.createDataFrame([(lang, level, step) for (lang, level), step in least.items()], "lang string, level int, least int")
    grams = grams.join(F.broadcast(cuts), ["lang", "level"])  # a row for each language and level
    out, above = None, None
    for n in range(ORDER, 0, -1):
        own = grams.where(F.col("level") == n)
        kept = own.where("step >= least").select("lang", "code", "n", "logp")
        if above is not None:  # every n-gram one level up finds its shorter end
            ends = above.select("lang", F.col("code").bitwiseAND(F.lit(_MASK[n])).alias("code")).distinct()
            kept = kept.unionByName(own.where("step < least").join(ends, ["lang", "code"], "left_semi").select("lang", "code", "n", "logp"))
        above = written(kept, "kept")
        level = above.select("lang", F.lit(n).alias("level"), "code", "n", "logp")
        out = level if out is None else out.unionByName(level)
    kept = written(out, "kept-grams")
    p = F.pow(F.lit(2.0), F.col("logp"))
    symbols = model.where("level = 1 and n is not null").groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("places"))
    weights = None
    for n in range(1, ORDER + 1):
        d = kept.where(F.col("level") == n).select("lang", F.shiftrightunsigned("code", _BITS).alias("context"), F.col("code").bitwiseAND(F.lit(_MASK[n - 1])).alias("end"), p.alias("p"))
        if n == 1:
            d = d.join(F.broadcast(symbols), "lang").withColumn("below", 1 / F.col("places"))
        else:
            d = d.join(kept.where(F.col("level") == n - 1).select("lang", F.col("code").alias("end"), p.alias("below")), ["lang", "end"])
        left = d.groupBy("lang", "context").agg((1 - F.sum("p")).alias("over"), (1 - F.sum("below")).alias("room"))
        was = model.where((F.col("level") == n) & F.col("n").isNull()).select("lang", F.col("code").alias("context"), "logp")
        # where the shorter ends leave nothing over, nothing is backed off to
        left = left.join(was, ["lang", "context"]).withColumn("logp", F.when((F.col("over") > 1e-12) & (F.col("room") > 1e-9), F.log2("over") - F.log2("room")).otherwise(F.col("logp")))
        rows = left.select("lang", F.lit(n).alias("level"), F.col("context").alias("code"), F.lit(None).cast("long").alias("n"), "logp")
        weights = rows if weights is None else weights.unionByName(rows)
    return kept.unionByName(weights)


def fit_models(counts: DataFrame, size: int = TABLE_SIZE) -> dict[str, object]:
    """A broadcast ``KneserNey`` for each language, of at most about ``size`` n-grams a level (some 20 MB each); see ``pruned``.

    For texts that were not counted.  ``quality_rules`` scores the counted texts
    themselves, by ``gram_costs``, which cuts nothing.

    The rows are written by language, so that each is read by itself; the driver
    takes the arrays of one language at a time, and a task loads those of the
    languages that its rows have.
    """
    model = pruned(written(kneser_ney(counts), "model"), size)
    model = written(model.repartitionByRange("lang", "level").sortWithinPartitions("lang", "level"), "arrays")
    out = {}
    for lang in sorted(r.lang for r in model.select("lang").distinct().collect()):
        out[lang] = counts.sparkSession.sparkContext.broadcast(KneserNey.of(model.where(F.col("lang") == lang).select("level", "code", "n", "logp").toArrow()))
    return out


def gram_costs(counts: DataFrame, held: int = HELD) -> tuple[object, DataFrame | None]:
    """What every n-gram costs under its language's whole model, in ``PARTS`` of a bit.

    A text that was counted has no n-gram outside the highest level, so this level
    is all that scores it and nothing is backed off.  Returns a broadcast of the most
    frequent n-grams, ``held`` over all languages at most, as sorted arrays of codes
    and costs by language, and all other n-grams as ``lang, code, cost``, or None
    where there are none.
    """
    grams = kneser_ney(counts).where((F.col("level") == ORDER) & F.col("n").isNotNull())
    cost = F.round(-F.col("logp") * PARTS).cast("int")
    grams = written(grams.select("lang", "code", F.floor(4 * F.log2("n")).cast("int").alias("step"), cost.alias("cost")), "costs")
    least, total = None, 0
    steps = grams.groupBy("step").count().orderBy(F.desc("step")).collect()  # some hundred rows
    for r in steps:
        total += r["count"]
        if total > held:
            break
        least = r.step
    inside = grams.where(F.col("step") >= least) if least is not None else grams.limit(0)
    table = inside.select("lang", "code", "cost").toArrow()
    names, of = np.unique(np.array(table.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    code, costs = table.column("code").to_numpy().view(np.uint64), table.column("cost").to_numpy()
    order = np.lexsort((code, of))
    ends = np.cumsum(np.bincount(of, minlength=len(names)))[:-1]
    parts = zip(np.split(code[order], ends), np.split(costs[order], ends), strict=True)
    sent = counts.sparkSession.sparkContext.broadcast({str(n): p for n, p in zip(names, parts)})
    if total <= held:
        return sent, None
    return sent, (grams.where(F.col("step") < least) if least is not None else grams).select("lang", "code", "cost")


def _repeated_words(words: Words, width: int = 8) -> np.ndarray:
    """Words of each text that lie in windows of ``width`` words found twice or more in the text."""
    rolled, out = roll(words.hash, width), np.zeros(len(words.counts), np.int64)
    for i, n in enumerate(words.counts):
        if n > width:
            lo = words.bounds[i]
            w = rolled[lo : lo + n - width + 1]
            s = np.sort(w)
            twice = s[1:][s[1:] == s[:-1]]
            if len(twice):
                hit = np.isin(w, twice)
                edge = np.zeros(n + 1, np.int64)
                edge[: len(w)] += hit
                edge[width : width + len(w)] -= hit
                out[i] = int((np.cumsum(edge[:n]) > 0).sum())
    return out


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")] if "\n" in text else ()
    return len(lines) - len(set(lines))


_SYMBOL_BYTES = np.zeros(256, bool)
_SYMBOL_BYTES[list(b"#*$%&|<>")] = True

_BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, cost long"
_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def _costs(code: np.ndarray, row: np.ndarray, n_rows: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The costs of each row's held n-grams together, and its other n-grams: row, code and how often."""
    keys, costs = held
    if len(keys):
        i = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        hit = keys[i] == code
        sums = np.bincount(row[hit], costs[i[hit]], n_rows).astype(np.int64)  # whole numbers, exact in doubles up to 2 ** 53
    else:
        hit, sums = np.zeros(len(code), bool), np.zeros(n_rows, np.int64)
    row, code = row[~hit], code[~hit]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))[: len(row)])
    return sums, (row[first], code[first], np.diff(np.concatenate((first, [len(row)]))))


def measure(docs: DataFrame, costs: object, text_col: str, lang_col: str, id_col: str) -> DataFrame:
    """The base counts of every text, a hash of it, how many n-grams it has, the costs of those that ``costs`` holds and the ``others``.

    ``row`` is a number of the row; it holds once the result is written.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            langs = [x.as_py() or "" for x in batch.column("lang")]
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            rest = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for lo, hi in chunks(raw, offsets):
                r, o = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                words = Words(r, o, lower=False)
                lead = np.concatenate(([0], np.cumsum((r & 0xC0) != 0x80)))
                chars = lead[words.end] - lead[words.start]
                upto = np.concatenate(([0], np.cumsum(chars)))
                marks = np.concatenate(([0], np.cumsum(_SYMBOL_BYTES[r])))
                code, have = _codes(r, o)
                cost = np.zeros(hi - lo, np.int64)
                row = np.repeat(np.arange(hi - lo), have)
                names = np.array(langs[lo:hi], object)
                for name in set(langs[lo:hi]):
                    mine = (names == name)[row]
                    sums, (at, others, n) = _costs(code[mine], row[mine], hi - lo, costs.value.get(name, _NONE))
                    cost += sums
                    rest.append((at + lo, others, n))
                lines = np.array([_repeated_lines(x.as_py() or "") for x in batch.column("text")[lo:hi]], np.int64)
                for c, v in zip(cols, (words.counts, upto[words.bounds[1:]] - upto[words.bounds[:-1]], marks[o[1:]] - marks[o[:-1]], lines, _repeated_words(words), have, cost), strict=True):
                    c.append(v)
            arrays = [pa.array((np.concatenate(c) if c else np.zeros(0)).astype(np.int64)) for c in cols]
            at, others, n = (np.concatenate(x) for x in zip(*rest, strict=True))
            order = np.argsort(at, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(langs)))))
            others = pa.StructArray.from_arrays([pa.array(others[order].view(np.int64)), pa.array(n[order].astype(np.int64))], ["code", "n"])
            others = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), others)
            own = [batch.column(c) for c in ("row", "doc_id", "lang", "same")]
            yield pa.RecordBatch.from_arrays([*own, *arrays, others], ["row", "doc_id", "lang", "same", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "cost", "others"])

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"row long, doc_id {kind}, lang string, same long, {_BASE_SCHEMA}, others array<struct<code:long,n:long>>")


def scored(docs: DataFrame, text_col: str, lang_col: str, id_col: str, held: int = HELD) -> DataFrame:
    """``measure`` with ``bits``: each text's cross-entropy a character under the whole model of its language, null with fewer than ORDER characters.

    The costs of n-grams that are not held are joined, so ``held`` decides only
    what is shuffled, never the result.
    """
    costs, rest = gram_costs(ngram_counts(docs, text_col, lang_col), held)
    d = written(measure(docs, costs, text_col, lang_col, id_col), "quality")
    bits = lambda cost: F.when(F.col("n_grams") > 0, cost / F.col("n_grams") / PARTS)
    if rest is None:
        return d.withColumn("bits", bits(F.col("cost"))).drop("row", "others", "cost", "n_grams")
    seen = d.select("row", F.coalesce("lang", F.lit("")).alias("lang"), F.explode("others").alias("o")).select("row", "lang", "o.code", "o.n")
    more = seen.join(rest.withColumnRenamed("cost", "each"), ["lang", "code"]).groupBy("row").agg(F.sum(F.col("n") * F.col("each")).alias("more"))
    whole = d.drop("others").join(more, "row", "left")
    return written(whole.withColumn("bits", bits(F.col("cost") + F.coalesce("more", F.lit(0)))).drop("row", "more", "cost", "n_grams"), "scored")


def quality_rules(docs: DataFrame, width: float = 4.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = HELD) -> DataFrame:
    """Base counts of every text and the verdict of the language's perplexity band.

    A modified Kneser-Ney model of 4 characters is counted over all texts of each
    language.  The band of a language goes ``width`` interquartile ranges beyond
    the quartiles of its different texts' bits a character, below as well as
    above: texts under it repeat themselves or a template, texts over it are noise.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, bits, kept``, a row for each input row.  Null
    texts count as empty and fail the base rules; null languages form a language
    of their own; texts without an n-gram have null ``bits`` and no band verdict.
    ``held``: n-grams that tasks keep in memory; the result does not depend on it.
    """
    d = scored(docs, text_col, lang_col, id_col, held)
    once = d.groupBy("lang", "same").agg(F.first("bits").alias("bits"))  # copies of a text do not move a language's quartiles
    q = once.groupBy("lang").agg(F.percentile_approx("bits", [0.25, 0.75], 1000).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    spread = F.greatest(high - low, F.lit(0.02))
    bands = q.select(F.col("lang").alias("band_lang"), (low - width * spread).alias("low"), (high + width * spread).alias("high"))
    d = d.join(F.broadcast(bands), F.col("lang").eqNullSafe(F.col("band_lang")), "left")  # a row for each language
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "bits", (~failed & inside).alias("kept"),
    )
