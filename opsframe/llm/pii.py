"""Personal data and the terms that disclose it: spans and information-theoretic sanitising."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.stages import unused, written

KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: Disclosing terms, candidate terms or entities up to which a table is sent to all tasks; beyond it they are joined.
SEND_ROWS = 500_000
#: Terms whose document counts a task returns in one array.
COUNTED = 4096
#: Characters of text whose counts a task gathers before it passes them on.
GATHER_CHARS = 8_000_000
#: Pieces of a text's copies when flags are joined, so that no task gets all copies.
SALTS = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only and never given back: both change no match, but keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_WORD = re.compile(r"\w+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches found from their @: the local part is the run before it, as far as the previous match lets it go."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1 if start == at else floor
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of all base spans, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and _luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(kind: int, value: str) -> str:
    value = value.lower() if kind == 0 else "".join(_DIGITS.findall(value)) if kind > 1 else value
    return f"{KINDS[kind]}:{hashlib.blake2b(value.encode(), digest_size=8).hexdigest()}"


def terms_of(text: str) -> set[str]:
    """All distinct words of a text in lower case; the only way in which terms are told, at every size."""
    return set(map(str.lower, set(_WORD.findall(text))))


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """What the spans of a text protect: their values and their kinds."""
    return {KINDS[k] for _, k, _ in spans} | {_entity(k, text[a:b]) for a, k, b in spans}


def _outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words of a text that touch no span."""
    at, reach, k = [], 0, 0
    for a, _, b in spans:  # in order of their starts; together they become ranges apart from each other
        if at and a < reach:
            at[-1][1] = reach = max(reach, b)
        else:
            at.append([a, b])
            reach = b
    for m in _WORD.finditer(text):
        a, b = m.span()
        while k < len(at) and at[k][1] <= a:
            k += 1
        if k == len(at) or at[k][0] >= b:
            yield a, b


def _candidates(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Rows whose text holds a digit or an @; no other can have a span."""
    hit = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)
    for i in pc.indices_nonzero(hit).to_pylist():
        yield i, column[i].as_py()


def protected_texts(docs: DataFrame) -> DataFrame:
    """``text_key, text, n``: the distinct texts that hold a span, and how many rows have each.  ``docs``: text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            hit = [i for i, text in _candidates(column) if base_spans(text)]
            yield pa.RecordBatch.from_arrays([column.take(pa.array(hit, pa.int64()))], ["text"])

    rows = docs.select("text").mapInArrow(run, "text string")
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(F.sha2("text", 256).alias("text_key"), "text", "n")


def protected_entities(texts: DataFrame) -> DataFrame:
    """``entity, n_entity, texts``: rows and different texts that hold each protected entity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names = [], []
            for i, x in enumerate(batch.column("text")):
                text = x.as_py()
                found = sorted(entities_of(text, base_spans(text)))
                at += [i] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column("n").take(pa.array(at, pa.int64()))], ["entity", "n"])

    return texts.select("text", "n").mapInArrow(run, "entity string, n long").groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts"))


def _pair_counts(texts: DataFrame, wanted: object) -> DataFrame:
    """``entity, term, both, texts`` over all words of each text that lie outside its spans; ``wanted``: None for all entities."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single: defaultdict[str, Counter] = defaultdict(Counter)
        copies: defaultdict[str, Counter] = defaultdict(Counter)
        gathered = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for entity, counts in single.items():
                terms, n = list(counts), list(counts.values())
                both = [c + copies[entity][t] for t, c in counts.items()] if entity in copies else n
                for lo in range(0, len(terms), 50_000):
                    some = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([entity] * len(terms[some])), pa.array(terms[some], pa.string()), pa.array(both[some], pa.int64()), pa.array(n[some], pa.int64())], ["entity", "term", "both", "texts"])
            single.clear()
            copies.clear()

        for batch in batches:
            for x, n in zip(batch.column("text"), batch.column("n").to_pylist(), strict=True):
                text = x.as_py()
                spans = base_spans(text)
                terms = {w.lower() for w in {text[a:b] for a, b in _outside(text, spans)}}
                for entity in entities_of(text, spans):
                    if wanted is None or entity in wanted.value:
                        single[entity].update(terms)
                        if n > 1:
                            copies[entity].update(dict.fromkeys(terms, n - 1))
                        gathered += len(text)
                if gathered > GATHER_CHARS:
                    yield from passed_on()
                    gathered = 0
        yield from passed_on()

    rows = texts.select("text", "n").mapInArrow(run, "entity string, term string, both long, texts long")
    return rows.groupBy("entity", "term").agg(F.sum("both").alias("both"), F.sum("texts").alias("texts"))


def _document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df``: in how many of all documents each of the terms stands.

    Few terms are sent to the tasks, which return counts in arrays of ``COUNTED``
    terms; many are joined to the counts of all terms.
    """
    if terms.count() > SEND_ROWS:

        def count_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, gathered = Counter(), 0
            for batch in batches:
                for x in batch.column("text"):
                    if text := x.as_py():
                        df.update(terms_of(text))
                        gathered += len(text)
                        if gathered > GATHER_CHARS:
                            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "df"])
                            df.clear()
                            gathered = 0
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "df"])

        return docs.select("text").mapInArrow(count_all, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).join(terms, "term")
    shared = docs.sparkSession.sparkContext.broadcast(sorted(r.term for r in terms.collect()))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        wanted, df = frozenset(place), Counter()
        for batch in batches:
            for x in batch.column("text"):
                if text := x.as_py():
                    df.update(wanted.intersection(terms_of(text)))
        n = np.zeros(len(place), np.int64)
        n[np.array([place[t] for t in df], np.int64)] = np.array(list(df.values()), np.int64)
        starts = [lo for lo in range(0, len(n), COUNTED) if n[lo : lo + COUNTED].any()]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([n[lo : lo + COUNTED].tobytes() for lo in starts], pa.binary())], ["start", "counts"])

    def add(part: pa.Table) -> pa.Table:
        start = part.column("start")[0].as_py()
        n = sum(np.frombuffer(x.as_py(), np.int64) for x in part.column("counts"))
        return pa.table({"term": pa.array(shared.value[start : start + len(n)], pa.string()), "df": pa.array(n)})

    return docs.select("text").mapInArrow(count, "start long, counts binary").groupBy("start").applyInArrow(add, "term string, df long").where("df > 0")


def disclosing_terms(docs: DataFrame, texts: DataFrame, alpha: float = 1.25, support: int = 5) -> DataFrame:
    """``entity, term, share``: terms that disclose a protected entity, and the part of its information that they give away.

    A term's disclosure of an entity is the pointwise mutual information of
    their occurrence in documents, against the entity's information content:
    ``share`` = PMI / IC.  Terms with a share of 1 / ``alpha`` or more disclose,
    if the two stand together in at least ``support`` different texts.
    """
    # an entity in fewer texts has no pair with support
    entities = written(protected_entities(texts).where(F.col("texts") >= support).drop("texts"), "entities")
    wanted = None
    if entities.count() <= SEND_ROWS:
        wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r.entity for r in entities.collect()))
    joint = written(_pair_counts(texts, wanted).where(F.col("texts") >= support), "joint")
    df = _document_counts(docs, joint.select("term").distinct())
    total = docs.where("text is not null").count()
    pmi = F.log2(F.col("both") * total / (F.col("n_entity") * F.col("df")))
    content = F.log2(F.lit(float(max(total, 1))) / F.col("n_entity"))
    share = F.when(content > 0, pmi / content).otherwise(0.0)
    return joint.join(entities, "entity").join(df, "term").select("entity", "term", share.alias("share")).where(F.col("share") >= 1 / alpha)


def _own_flags(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``text_key, _flags``: the disclosing terms of each distinct text (``text_key, text``), where they are too many to be sent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x in zip(batch.column("text_key"), batch.column("text"), strict=True):
                text = x.as_py()
                own = sorted({w.lower() for w in {text[a:b] for a, b in _outside(text, base_spans(text))}})
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(own), pa.string()), pa.array(own, pa.string())], ["text_key", "term"])

    texts = docs.where("text is not null").dropDuplicates(["text_key"])
    rows = texts.mapInArrow(run, "text_key string, term string").join(terms, "term")
    return rows.groupBy("text_key").agg(F.collect_list(F.struct("term", "share")).alias("_flags"))


def _with_flags(docs: DataFrame, text_col: str, terms: DataFrame) -> tuple[DataFrame, str, object]:
    """The disclosing terms as one value for all tasks if they are few, else as a column of each row's own terms, under a name that ``docs`` lacks.

    Flags follow from a row's text alone, so rows are joined by its hash, whatever their ids.
    """
    flags, key, salt = unused(docs, "flags"), unused(docs, "text_key"), unused(docs, "salt")
    if terms.count() <= SEND_ROWS:
        few = {r.term: r.share for r in terms.collect()}
        return docs.withColumn(flags, F.lit(None).cast("array<struct<term:string,share:double>>")), flags, docs.sparkSession.sparkContext.broadcast(few)
    texts = docs.select(F.sha2(F.col(text_col), 256).alias("text_key"), F.col(text_col).alias("text"))
    own = _own_flags(texts, terms).select(F.col("text_key").alias(key), F.col("_flags").alias(flags), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    keyed = docs.withColumn(key, F.sha2(F.col(text_col), 256)).withColumn(salt, (F.monotonically_increasing_id() % SALTS).cast("int"))
    return keyed.join(own, [key, salt], "left").drop(key, salt), flags, None


def _prepared(docs: DataFrame, text_col: str, alpha: float, support: int) -> DataFrame:
    """``term, share``: each disclosing term with the largest share that it has of any entity."""
    d = docs.select(F.col(text_col).alias("text"))
    pairs = disclosing_terms(d, written(protected_texts(d), "protected"), alpha, support)
    return written(pairs.groupBy("term").agg(F.max("share").alias("share")), "disclosing")


def _found(batch: pa.RecordBatch, place: int, flags: str, shared: object) -> Iterator[tuple[int, str, list, list]]:
    """(row, text, base spans, disclosing terms that touch none of them) of the rows that have either."""
    column = batch.column(place)
    spanned = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_pylist()
    for i, may_span in enumerate(spanned):
        known = shared.value if shared is not None else {f["term"]: f["share"] for f in batch.column(flags)[i].as_py() or ()}
        text = column[i].as_py() if may_span or known else None
        if not text:
            continue
        base, terms = base_spans(text) if may_span else [], []
        if known and not known.keys().isdisjoint(terms_of(text)):
            words = ((a, b, known.get(text[a:b].lower())) for a, b in _outside(text, base))
            terms = [(a, len(KINDS), b, share) for a, b, share in words if share is not None]
        if base or terms:
            yield i, text, base, terms


def find_pii(docs: DataFrame, alpha: float = 1.25, support: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans of every whole text, and its terms that disclose a protected entity of the corpus or its kind.

    A disclosing term gives its entity away wherever it stands, so it is found in
    texts without base spans as well.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, n_term, n_spans,
    base_sha256, spans``, a row for each input row.  Null and empty texts have no spans.
    Counts behind the disclosure are taken over all documents; repeated rows
    count as documents, but copies of a text give no support of their own.
    """
    terms = _prepared(docs, text_col, alpha, support)
    d, flags, shared = _with_flags(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", terms)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [[0] * batch.num_rows for _ in range(6)]
            sha, spans = [none] * batch.num_rows, [""] * batch.num_rows
            for i, _, base, terms in _found(batch, batch.schema.get_field_index("text"), flags, shared):
                for _, k, _ in base:
                    n[k][i] += 1
                n[4][i] = len(terms)
                n[5][i] = len(base) + len(terms)
                text_of = lambda xs: ",".join(f"{(*KINDS, 'term')[k]}:{a}:{b}" for a, k, b in xs)
                sha[i] = hashlib.sha256(text_of(base).encode()).hexdigest()
                spans[i] = text_of(sorted(base + [t[:3] for t in terms]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in n), pa.array(sha), pa.array(spans)], names)

    names = ["doc_id", *(f"n_{k}" for k in (*KINDS, "term", "spans")), "base_sha256", "spans"]
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in (*KINDS, "term", "spans")) + ", base_sha256 string, spans string")


def sanitise_text(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, int, float]]) -> str:
    """Entities become their label; a disclosing term becomes a general word, or goes if it gives the entity away entirely."""
    out, at = [], 0
    for a, k, b, *share in sorted([*base, *terms]):
        if b <= at:
            continue
        a = max(a, at)
        out.append(text[at:a])
        if k < len(KINDS):
            out.append(LABELS[KINDS[k]])
        elif share[0] < 0.999:
            word = text[a:b]
            out.append("[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]")
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, alpha: float = 1.25, support: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in the text; all rows and columns stay."""
    d, flags, shared = _with_flags(docs, text_col, _prepared(docs, text_col, alpha, support))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            column = batch.column(place)
            changed = {i: sanitise_text(text, base, terms) for i, text, base, terms in _found(batch, place, flags, shared)}
            if changed:
                mask = [i in changed for i in range(batch.num_rows)]
                column = pc.replace_with_mask(column, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], column.type))
            yield pa.RecordBatch.from_arrays([column if c == text_col else batch.column(c) for c in docs_columns], docs_columns)

    docs_columns = docs.columns
    return d.mapInArrow(run, docs.schema)
