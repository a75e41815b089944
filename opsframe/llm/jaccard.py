"""Exact n-gram Jaccard self-join and its connected components, with set-relation skipping."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.components import connected_components
from opsframe.llm.stages import Scratch, written
from opsframe.llm.textkit import Words, chunks, mix, released, shingle_sets, text_buffers

#: Rows up to which a table of ids is sent to all tasks; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Frequent shingles that are put last in the common order; a bound on what is sent, any order gives the same result.
ORDERED_SHINGLES = 500_000
#: Comparisons with one set that a task makes in a row; the set travels once for each such group.
GROUP = 64
STAR_KEYS = 4
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, 8, dtype=np.uint64)


def _small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _words64(x: pa.Scalar) -> np.ndarray:
    """A set, or a part of one, from its bytes."""
    buffer = x.as_buffer() if x.is_valid else None
    return np.frombuffer(buffer, np.uint64) if buffer is not None and buffer.size else np.zeros(0, np.uint64)


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document, and rows of shingles that are frequent in some stretch.

    Of a document: a row number, set size, 128-bit signature, star keys and set.
    The set (sorted 64-bit shingles) is only kept where its signature is new in
    the stretch.  A star key is the smallest shingle under a permutation: highly
    similar sets mostly share it.  A stretch is a million shingles of one
    task; it reports the shingles of at least four of its different sets, in
    rows without a number (``a`` the shingle, ``n`` its count).
    """
    fields = ["doc_id", "row", "n", "a", "b", "keys", "set"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        seen: set[tuple[int, int]] = set()
        stretch: list[np.ndarray] = []
        held, id_type = 0, None

        def frequent() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(stretch), return_counts=True)
            k, n = k[n >= 4], n[n >= 4]
            none = lambda t: pa.nulls(len(k), t)
            return pa.RecordBatch.from_arrays([none(id_type), none(pa.int64()), pa.array(n, pa.int64()), pa.array(k.view(np.int64)), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.binary())], fields)

        for batch in batches:
            id_type = batch.column("doc_id").type
            raw, offsets = text_buffers(batch.column("text"))
            for lo, hi in chunks(raw, offsets):
                words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                size, sign = np.zeros(hi - lo, np.int64), np.zeros((2, hi - lo), np.uint64)
                keys: list[np.ndarray | None] = [None] * (hi - lo)
                sets: list[bytes | None] = [None] * (hi - lo)
                for i, s in enumerate(shingle_sets(words, width)):
                    size[i] = len(s)
                    if len(s):
                        m = mix(s ^ _SEEDS[0])
                        sign[0, i], sign[1, i] = m.sum(), mix(s ^ _SEEDS[1]).sum()
                        mark = (int(sign[0, i]), int(sign[1, i]))
                        if mark not in seen:
                            seen.add(mark)
                            stretch.append(s)
                            held += len(s)
                            keys[i] = np.array([(m * _SEEDS[2 + k] ^ _SEEDS[3]).min() ^ np.uint64(k) for k in range(STAR_KEYS)]).view(np.int64)
                            sets[i] = s.tobytes()
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(np.arange(at, at + n)), pa.array(size), *(pa.array(x.view(np.int64)) for x in sign), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], fields
                )
                at += n
                if held > 1 << 20:
                    yield frequent()
                    stretch.clear()
                    seen.clear()
                    held = 0
        if stretch:
            yield frequent()
        stretch.clear()
        released()

    return docs.mapInArrow(run, f"doc_id {kind}, row long, n long, a long, b long, keys array<long>, set binary")


class _Order:
    """The common order of shingles: by hash, the frequent ones last by estimated frequency."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        rank = np.argsort(tokens)
        self.tokens, self.counts = tokens[rank], counts[rank]

    def known(self, s: np.ndarray) -> np.ndarray:
        """Estimated frequency of each shingle, 0 for those that are not frequent."""
        if not len(self.tokens):
            return np.zeros(len(s), np.int64)
        i = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[i] == s, self.counts[i], 0)

    def prefix(self, s: np.ndarray, length: int) -> np.ndarray:
        n = self.known(s)
        return s[np.argsort(n, kind="stable")[:length]] if n.any() else s[:length]


def _central(sets: DataFrame, order: object) -> DataFrame:
    """``row, central``: share of a set's shingles that are frequent; edited copies lack some of those of their original."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = [float((order.value.known(_words64(x)) > 0).mean()) for x in batch.column("set")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(share, pa.float64())], ["row", "central"])

    return sets.select("row", "set").mapInArrow(run, "row long, central double")


class _Sets:
    """Comparisons of sets that are stored by row number."""

    def __init__(self, table: DataFrame, work: Scratch):
        self.table, self.work = table.select("row", "set"), work

    def of(self, ids: DataFrame, name: str) -> DataFrame:
        """``name, set`` for the given ids (one column)."""
        ids = _small(self.work.written(ids.toDF("asked").distinct(), "ids"))
        return self.table.join(ids, F.col("row") == F.col("asked"), "left_semi").select(F.col("row").alias(name), "set")

    def compared(self, pairs: DataFrame, differences: bool = False) -> DataFrame:
        """``pairs`` (x, y) with both sizes ``nx``, ``ny`` and the intersection's, ``both``; also what x has more (``plus``) and less (``minus``), if asked for."""
        mine = self.of(pairs.select("x"), "x").withColumnRenamed("set", "mine").withColumn("less", F.lit(None).cast("binary"))
        return self._against(pairs.select("x", "y", F.lit(0).cast("long").alias("start")), mine, differences)

    def derived(self, rows: DataFrame, beyond: DataFrame) -> DataFrame:
        """``x, y, both``: |x & y|, derived from |p & y| (``start``) of a similar set p by what x has more (``mine``) and less (``less``) than p.

        ``rows``: x, y, start; ``beyond``: x, mine, less.
        """
        return self._against(rows, beyond, False).select("x", "y", "both")

    def _against(self, rows: DataFrame, mine: DataFrame, differences: bool) -> DataFrame:
        """Rows (x, y, start) with what x has meet the set of their y, which is sent once for each ``GROUP`` of them."""
        hot = self.work.written(rows.groupBy(F.col("y").alias("hot")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP), "hot")
        part = F.coalesce(F.pmod(F.xxhash64("x"), F.ceil(F.col("k") / GROUP)), F.lit(0))
        rows = rows.join(_small(hot), F.col("y") == F.col("hot"), "left").withColumn("part", part).drop("hot", "k")
        ends = self.work.written(rows.select("y", "part").distinct(), "ends")
        sets = ends.join(self.of(ends.select("y"), "y"), "y")
        sets = sets.select(F.lit(None).cast("long").alias("x"), "y", F.col("set").alias("mine"), F.lit(None).cast("binary").alias("less"), F.lit(0).cast("long").alias("start"), "part")
        placed = sets.unionByName(rows.join(mine, "x")).repartition("y", "part").sortWithinPartitions("y", "part", F.col("x").asc_nulls_first())

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current = np.zeros(0, np.uint64)
            for batch in batches:
                rows, nx, ny, both, plus, minus = [], [], [], [], [], []
                named = np.asarray(batch.column("x").is_valid())
                start = batch.column("start").to_pylist()
                for i, m in enumerate(batch.column("mine")):
                    s = _words64(m)
                    if not named[i]:
                        current = s.copy()  # the batch does not outlive its turn
                        continue
                    hit = np.isin(s, current, assume_unique=True)
                    less = _words64(batch.column("less")[i])
                    rows.append(i)
                    nx.append(len(s))
                    ny.append(len(current))
                    both.append(start[i] + int(hit.sum()) - int(np.isin(less, current, assume_unique=True).sum()))
                    if differences:
                        plus.append(s[~hit].tobytes())
                        minus.append(np.setdiff1d(current, s, assume_unique=True).tobytes())
                at = pa.array(rows, pa.int64())
                out = [batch.column("x").take(at), batch.column("y").take(at), *(pa.array(c, pa.int64()) for c in (nx, ny, both))]
                yield pa.RecordBatch.from_arrays([*out, *((pa.array(c, pa.binary()) for c in (plus, minus)) if differences else ())], fields)
            released()

        fields = ["x", "y", "nx", "ny", "both", *(("plus", "minus") if differences else ())]
        return placed.mapInArrow(run, "x long, y long, nx long, ny long, both long" + (", plus binary, minus binary" if differences else ""))


def _entries(sets: DataFrame, order: object, num: int, den: int) -> DataFrame:
    """Entries of the inverted lists: the prefix shingles of every set, with size, place and block of sizes.

    ``sets``: row, set, unit (of stars: the pivot).  Blocks hold sizes within a
    factor of (den / num) ** 4; a set so near its block's upper end that the
    next block holds similar sets is ``over``.
    """
    reach = math.log(den / num) * (1 + 1e-9)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, n, rows = [], [], []
            for i, x in enumerate(batch.column("set")):
                s = _words64(x)
                p = order.value.prefix(s, len(s) - (num * len(s) + den - 1) // den + 1)
                tokens.append(p)
                n.append(len(s))
                rows.append(len(p))
            if not tokens:
                continue
            size = np.log(np.maximum(np.array(n), 1))
            block = np.floor(size / (4 * reach)).astype(np.int32)
            over = np.floor((size + reach) / (4 * reach)).astype(np.int32) > block
            each = np.repeat(np.arange(len(rows)), rows)
            place = np.arange(len(each)) - np.repeat(np.cumsum(rows) - rows, rows)
            t, n = np.concatenate(tokens).view(np.int64), np.array(n)
            for lo in range(0, len(t), 1 << 16):
                k = slice(lo, lo + (1 << 16))
                at = pa.array(each[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[k]), batch.column("unit").take(at), batch.column("starred").take(at), pa.array(n[each[k]].astype(np.int32)), pa.array(place[k].astype(np.int32)), pa.array(block[each[k]]), pa.array(over[each[k]])],
                    ["token", "unit", "starred", "n", "place", "block", "over"],
                )
        released()

    return sets.select("unit", "starred", "set").mapInArrow(run, "token long, unit long, starred boolean, n int, place int, block int, over boolean")


def _meetings(entries: DataFrame, num: int, den: int) -> DataFrame:
    """``x, y``: units that may hold similar sets, from lists whose blocks are skipped by size and entries by place.

    A list (shingle) is split into blocks of sizes: entries meet within their
    block, and the ``over`` ones in the next; all other blocks are skipped.  The
    sets of a star have one entry in a block, with the bounds of their sizes and
    places.  At the first shingle that two similar sets share, what follows in
    both is enough for the overlap; at later ones, what came before counts too.
    Beyond the prefixes two sets share no more than the longer rest.
    """
    keys = ["token", "unit", "block"]
    single = entries.where("not starred").select(*keys, F.col("n").alias("lo"), F.col("n").alias("hi"), F.col("place").alias("first"), F.col("place").alias("last"), "over")
    star = entries.where("starred").groupBy(*keys).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("place").alias("first"), F.max("place").alias("last"), F.bool_or("over").alias("over"))
    both = single.unionByName(star)
    cells = F.when(F.col("over"), F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))
    both = both.select("*", F.explode(cells).alias("cell"))
    # four words an entry, since all entries are sorted: a hash of shingle and cell (a clash only costs a comparison), unit, sizes, places
    pair = lambda x, y: F.shiftleft(F.col(x).cast("long"), 32).bitwiseOR(F.col(y).cast("long"))
    places = F.shiftleft(pair("first", "last"), 1).bitwiseOR((F.col("block") == F.col("cell")).cast("long"))
    both = both.select(F.xxhash64("token", "cell").alias("key"), "unit", pair("lo", "hi").alias("sizes"), places.alias("places"))
    p, q = both.alias("p"), both.alias("q")
    c = F.col
    high, low = lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    lo, hi = lambda s: high(c(f"{s}.sizes")), lambda s: low(c(f"{s}.sizes"))
    first, last = lambda s: F.shiftright(c(f"{s}.places"), 33), lambda s: low(F.shiftright(c(f"{s}.places"), 1))
    home = c("p.places").bitwiseOR(c("q.places")).bitwiseAND(F.lit(1)) == 1
    sizes = (den * hi("p") >= num * lo("q")) & (den * hi("q") >= num * lo("p"))
    rest = F.least(hi("p") - first("p"), hi("q") - first("q"))
    enough = lambda before: (num + den) * (before + rest) >= num * (lo("p") + lo("q"))
    meet = p.join(q, (c("p.key") == c("q.key")) & (c("p.unit") < c("q.unit")) & home & sizes & enough(F.least(last("p"), last("q"))))
    meet = meet.groupBy(c("p.unit").alias("x"), c("q.unit").alias("y")).agg(
        F.count(F.lit(1)).alias("shared"), F.bool_or(enough(F.lit(0))).alias("first"),
        F.min(lo("p")).alias("plo"), F.max(hi("p")).alias("phi"), F.min(lo("q")).alias("qlo"), F.max(hi("q")).alias("qhi"),
    )
    rest = lambda hi: F.ceil(num * c(hi) / den) - 1
    return meet.where("first").where((num + den) * (c("shared") + F.greatest(rest("phi"), rest("qhi"))) >= num * (c("plo") + c("qlo"))).select("x", "y")


def _linked(nx: str | Column, ny: str | Column, both: str | Column, num: int, den: int) -> Column:
    nx, ny, both = (F.col(v) if isinstance(v, str) else v for v in (nx, ny, both))
    return (num + den) * both >= num * (nx + ny)


def _differences(rows: DataFrame) -> DataFrame:
    """``star, unit, feature``: the shingles that a unit has more (``plus``) or less (``minus``) than the pivot of a star."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.concatenate([_words64(p), _words64(m)]) for p, m in zip(batch.column("plus"), batch.column("minus"))]
            if not both:
                continue
            each, features = np.repeat(np.arange(len(both)), [len(x) for x in both]), np.concatenate(both).view(np.int64)
            for lo in range(0, len(each), 1 << 16):
                at = pa.array(each[lo : lo + (1 << 16)])
                yield pa.RecordBatch.from_arrays([batch.column("star").take(at), batch.column("unit").take(at), pa.array(features[lo : lo + (1 << 16)])], ["star", "unit", "feature"])
        released()

    return rows.select("star", "unit", "plus", "minus").mapInArrow(run, "star long, unit long, feature long")


def _star_answers(sets: _Sets, work: Scratch, open_pairs: DataFrame, members: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of labels (lx, ly) of stars whose members link though their pivots do not.

    ``open_pairs``: x, y, both, lx, ly of pivots that are compared but neither
    linked nor in one component.  The sets of the smaller star visit the pivot p
    of the larger one; those that link with it settle the pair.  For any other
    visitor v, a member m's answer follows from its pivot's:
    |m & v| is |p & v|, less what m lacks of p, more the differences from p
    that m and v share.  So m and v can only link if they share as many
    differences as that leaves wanting (one at least), and are found by their
    rarest ones; members that share none with a visitor are never paired with it.
    """
    weight = num + den
    stats = work.written(members.groupBy(F.col("star").alias("s")).agg(F.count(F.lit(1)).alias("k"), F.max("n_plus").alias("most"), F.min("n").alias("least")), "star-bounds")
    side = lambda s: stats.select(F.col("s").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("k", "most", "least")))
    met = open_pairs.join(side("x"), "x", "left").join(side("y"), "y", "left").withColumn("larger", F.coalesce("k_x", F.lit(0)) >= F.coalesce("k_y", F.lit(0)))
    of = lambda a, b: F.when(F.col("larger"), F.col(a)).otherwise(F.col(b))
    met = met.select(of("x", "y").alias("star"), of("y", "x").alias("small"), "both", of("most_x", "most_y").alias("most"), of("least_x", "least_y").alias("least"), "lx", "ly")
    met = met.join(sizes.select(F.col("row").alias("star"), F.col("n").alias("n_star")), "star").withColumn("least", F.least("least", "n_star"))
    met = work.written(met.drop("n_star"), "star-pairs")

    # a visitor has no more in common with a member than the pivots have, and what both have beyond them
    guests = met.join(members.select(F.col("x").alias("unit"), F.col("star").alias("small"), "n", "n_plus"), "small")
    guests = guests.where(_linked("n", "least", F.least(F.col("both") + F.col("most") + F.col("n_plus"), F.col("n")), num, den))
    labels = ["star", "unit", "lx", "ly"]
    guests = guests.select(*labels).unionByName(met.select("star", F.col("small").alias("unit"), "lx", "ly")).dropDuplicates(["star", "unit"])
    guests = work.written(guests, "visitors")
    seen = work.written(sets.compared(guests.select(F.col("unit").alias("x"), F.col("star").alias("y")), differences=True), "visits")
    settled = seen.where(_linked("nx", "ny", "both", num, den)).select(F.col("x").alias("unit"), F.col("y").alias("star"))
    links = work.written(guests.join(settled, ["star", "unit"]).select("lx", "ly").distinct(), "label-links")

    # a pair wants (cost - spare) / weight shared differences, rounded up
    visits = seen.select(F.col("x").alias("unit"), F.col("y").alias("star"), "both", (weight * F.col("both") - num * F.col("nx")).alias("spare"), "plus", "minus")
    visits = visits.join(settled, ["star", "unit"], "left_anti").join(guests, ["star", "unit"]).join(links, ["lx", "ly"], "left_anti")
    visits = work.written(visits, "open-visits")
    if visits.isEmpty():
        return links
    asked = work.written(visits.groupBy("star").agg(F.max("spare").alias("most_spare")), "asked-stars")
    answer = members.select(F.col("x").alias("unit"), "star", "plus", "minus", (num * F.col("n") + weight * (F.octet_length("minus") / 8).cast("long")).alias("cost"))
    answer = work.written(answer.join(_small(asked), "star"), "asked-members")
    cheapest = answer.groupBy("star").agg(F.min("cost").alias("least_cost"))
    wants = lambda cost, spare: F.ceil((F.col(cost) - F.col(spare)) / weight)
    theirs, mine = work.written(_differences(visits), "visitors-differ"), work.written(_differences(answer), "members-differ")
    counted = lambda d, k: d.groupBy("star", "feature").agg(F.count(F.lit(1)).alias(k))
    shared = counted(mine, "k").join(counted(theirs, "l"), ["star", "feature"]).select("star", "feature", (F.col("k") * F.col("l")).alias("pairs"))
    shared = work.written(shared, "shared-differences")

    def rarest(differences: DataFrame, needs: DataFrame) -> DataFrame:
        """The differences of each unit of which any sufficient match shares one: the rarest, all but ``want`` - 1."""
        unit = Window.partitionBy("star", "unit")
        placed = differences.join(shared, ["star", "feature"]).withColumns({"place": F.row_number().over(unit.orderBy("pairs", "feature")), "held": F.count(F.lit(1)).over(unit)})
        return placed.join(needs, ["star", "unit"]).where(F.col("place") <= F.col("held") - F.col("want") + 1).withColumn("rest", F.col("held") - F.col("place") + 1)

    p = rarest(mine, answer.select("star", "unit", "cost", wants("cost", "most_spare").alias("want"))).select("star", "feature", F.col("unit").alias("m"), "cost", F.col("rest").alias("rest_m"))
    needs = visits.join(cheapest, "star").select("star", "unit", "spare", "both", "lx", "ly", wants("least_cost", "spare").alias("want"))
    q = rarest(theirs, needs).select("star", "feature", F.col("unit").alias("v"), "spare", "both", "lx", "ly", F.col("rest").alias("rest_v"))
    pairs = p.join(q, ["star", "feature"]).where(F.least("rest_m", "rest_v") >= wants("cost", "spare"))
    pairs = work.written(pairs.select(F.col("m").alias("x"), F.col("v").alias("y"), "both", "cost", "spare", "lx", "ly").distinct(), "member-pairs")
    exact = sets.derived(pairs.select("x", "y", F.col("both").alias("start")), members.select("x", F.col("plus").alias("mine"), F.col("minus").alias("less")))
    size = lambda s: sizes.select(F.col("row").alias(s), F.col("n").alias(f"n{s}"))
    found = exact.withColumnRenamed("both", "found").join(size("x"), "x").join(size("y"), "y").where(_linked("nx", "ny", "found", num, den))
    return links.unionByName(work.written(pairs.select("x", "y", "lx", "ly").join(found.select("x", "y"), ["x", "y"]).select("lx", "ly").distinct(), "member-links"))


def jaccard_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the documents whose sets of ``width``-word shingles have a Jaccard similarity of num / den or more.

    Exact, without expanding groups of copies into pairs:

    1. Documents with equal sets form a class, known by the row that holds its set.
    2. Star links: classes that share two star keys with the keys' pivot are
       compared with it; those that link join its star, and keep what they have
       more and less than their pivot.  Work is linear in the classes.
    3. Index: each set enters the inverted lists of its prefix (the shingles of
       which any similar set must share one, in a common order with frequent
       shingles last); sets of a star enter as their pivot.  Blocks of a list
       are skipped by size, entries by place.
    4. Pivots that meet in a list are compared.  Members of pivots that do not
       link derive their answers from the pivots', by the differences from their
       pivot that they share with a visitor of the other star
       (``_star_answers``), only where their two stars are not in one component
       already.

    Words: ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Fewer words than
    ``width`` make one shingle; null or empty texts have none and link with
    nothing.  Returns ``doc_id, n_shingles, component_id`` (the smallest id
    reachable), a row for each input row, with ids of any orderable type.  Rows
    with the same id are one document: where they have different texts, links
    of any of these texts join them.  Rows with a null id link like others and
    report the smallest id that they reach, or null.  Rows without a word
    report their own id.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spark = d.sparkSession
    with Scratch(spark, "jaccard") as work:
        table = work.written(_describe(d, width), "sets")
        described = table.where("row is not null").select("doc_id", "row", "n", "a", "b")
        same = ["a", "b", "n"]
        held = table.where("set is not null")
        classes = described.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("least"))
        holders = held.groupBy(*same).agg(F.min("row").alias("row"), F.min_by("keys", "row").alias("keys"))
        classes = work.written(classes.join(holders, same), "classes")

        common = table.where("row is null").groupBy("a").agg(F.sum("n").alias("n")).where("n >= 16").orderBy(F.desc("n"), "a").limit(ORDERED_SHINGLES).toPandas()
        order = spark.sparkContext.broadcast(_Order(common["a"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64)))
        sets = _Sets(held, work)

        # stars
        keyed = work.written(classes.select(F.explode("keys").alias("key"), "row", "n"), "keys")
        several = work.written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "several")
        keyed = work.written(keyed.join(several, "key"), "keyed")
        central = work.written(_central(sets.of(keyed.select("row"), "row"), order), "central")
        keyed = work.written(keyed.join(central, "row"), "central-keys")
        pivots = work.written(keyed.groupBy("key").agg(F.max(F.struct("central", -F.col("row"), "n")).alias("pivot")).select("key", (-F.col("pivot.col2")).alias("pivot"), F.col("pivot.n").alias("pivot_n")), "pivots")
        near = keyed.join(pivots, "key").where((F.col("row") != F.col("pivot")) & (den * F.least("pivot_n", "n") >= num * F.greatest("pivot_n", "n")))
        near = near.groupBy(F.col("row").alias("x"), F.col("pivot").alias("y")).agg(F.count(F.lit(1)).alias("keys")).where("keys >= 2").select("x", "y")
        star_links = sets.compared(work.written(near, "star-pairs"), differences=True).where(_linked("nx", "ny", "both", num, den))
        star_links = work.written(star_links.select("x", "y", "nx", "both", "plus", "minus"), "star-links")
        # a pivot that joins another star keeps its own members, so all differences are to a compared pivot
        best = star_links.groupBy("x").agg(F.max(F.struct("both", -F.col("y"))).alias("best")).select("x", (-F.col("best.col2")).alias("y"))
        members = star_links.join(best, ["x", "y"]).select("x", F.col("y").alias("star"), F.col("nx").alias("n"), "plus", "minus", (F.octet_length("plus") / 8).cast("long").alias("n_plus"))
        members = work.written(members, "members")

        # index
        centres = members.select(F.col("star").alias("row")).distinct()
        units = members.select(F.col("x").alias("row"), F.col("star").alias("unit"))
        units = units.unionByName(centres.join(members.select(F.col("x").alias("row")), "row", "left_anti").select("row", F.col("row").alias("unit")))
        again = held.select("row").join(classes.select("row"), "row", "left_anti")  # sets of classes that another row holds
        special = work.written(units.unionByName(again.select("row", F.lit(None).cast("long").alias("unit"))).withColumnRenamed("row", "special"), "units")
        entering = held.select("row", "set").join(_small(special), F.col("row") == F.col("special"), "left").where("special is null or unit is not null")
        entering = entering.select(F.coalesce("unit", "row").alias("unit"), F.col("unit").isNotNull().alias("starred"), "set")
        entries = _entries(entering, order, num, den)
        met = work.written(_meetings(entries, num, den), "met")
        compared = work.written(sets.compared(met), "compared")

        # what is linked so far
        links = members.select(F.col("x").alias("u"), F.col("star").alias("v")).unionByName(star_links.select(F.col("x").alias("u"), F.col("y").alias("v")))
        links = links.unionByName(compared.where(_linked("nx", "ny", "both", num, den)).select(F.col("x").alias("u"), F.col("y").alias("v")))
        labels = work.written(connected_components(links.unionByName(_one_document(described, classes, same)), work.written), "labels")

        # stars that are apart though their pivots are close
        apart = compared.where(~_linked("nx", "ny", "both", num, den))
        named = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}"))
        starred = lambda s: centres.select(F.col("row").alias(s), F.lit(True).alias(f"s{s}"))
        apart = apart.join(starred("x"), "x", "left").join(starred("y"), "y", "left").where("sx or sy")
        apart = apart.join(named("x"), "x", "left").join(named("y"), "y", "left").select("x", "y", "both", F.coalesce("lx", "x").alias("lx"), F.coalesce("ly", "y").alias("ly"))
        apart = work.written(apart.where("lx <> ly"), "apart")
        if not apart.isEmpty():
            found = _star_answers(sets, work, apart, members, classes.select("row", "n"), num, den)
            merged = work.written(connected_components(found.toDF("u", "v"), work.written), "merged").toDF("l", "m")
            nodes = labels.unionByName(merged.select(F.col("l").alias("node"), F.col("l").alias("label"))).distinct()
            labels = work.written(nodes.join(merged, nodes["label"] == merged["l"], "left").select("node", F.coalesce("m", "label").alias("label")).distinct(), "all-labels")

        # components of documents
        classes = classes.join(labels, classes["row"] == labels["node"], "left").select(*same, "least", F.coalesce("label", "row").alias("label"))
        classes = work.written(classes, "labelled")
        least = work.written(classes.groupBy("label").agg(F.min("least").alias("component_id")), "components")
        classes = work.written(classes.join(least, "label").select(*same, "component_id"), "named")
        out = described.select("doc_id", *same).join(classes, same, "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return written(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "components")


def _one_document(described: DataFrame, classes: DataFrame, same: list[str]) -> DataFrame:
    """Links (u, v) between the classes of an id that has several texts."""
    named = described.where("n > 0 and doc_id is not null")
    ids = named.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("first"), F.max(F.struct(*same)).alias("last")).where("first <> last").select("doc_id")
    texts = named.join(_small(ids), "doc_id", "left_semi").select("doc_id", *same).distinct().join(classes.select(*same, "row"), same)
    return texts.select("doc_id", F.col("row").alias("u")).join(texts.groupBy("doc_id").agg(F.min("row").alias("v")), "doc_id").select("u", "v")


def keep_one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component and no other; of rows that repeat an id, one stays.

    Rows with a null id cannot be told apart by id and all stay, as do texts
    without a word.  Texts are moved only for rows of repeated ids.
    """
    found = jaccard_components(docs, width, num, den, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    again = written(found.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col), "repeated")
    kept = docs.join(_small(written(gone, "gone")), id_col, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    small = _small(again)
    return kept.join(small, id_col, "left_anti").unionByName(kept.join(small, id_col, "left_semi").dropDuplicates([id_col])).select(*docs.columns)
