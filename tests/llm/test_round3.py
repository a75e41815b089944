"""Exact duplicates, the filter audit and importance resampling against SQL and brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import exact_dedup, filter_audit, queries, resample
from opsframe.llm import pii as P
from tests.conftest import SF

duckdb = pytest.importorskip("duckdb")
DOCS = "doc_id long, text string, lang string"


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_filter_audit"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = c.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


# exact duplicates


def groups(rows):
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[t or ""].append(i)
    out = []
    for t, ids in by_text.items():
        best = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, best, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [2, 7, 1 << 14])
def test_exact_groups_with_few_counters(spark, counters):
    rng = random.Random(counters)
    rows = [(rng.randrange(400), rng.choice(["hot", "hot", "warm", "", None, f"t{rng.randrange(60)}", "é" * 9000])) for _ in range(900)]
    rows += [(None, "hot"), (None, "only nulls"), (None, "only nulls"), (5, "twice"), (5, "twice")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_dedup.copy_groups(d, counters)
    assert sorted(map(tuple, got.collect()), key=str) == groups(rows)


def test_misra_gries_finds_every_frequent_digest(spark):
    rng = random.Random(3)
    digests = [f"d{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    found = {r.digest for r in exact_dedup.frequent_digests(spark.createDataFrame([(x,) for x in digests], "digest string").repartition(9), 20).collect()}
    true = Counter(digests)
    assert {x for x, n in true.items() if n >= 2 * len(digests) / 21} <= found
    assert len(found) <= 21


def test_frequent_rows_are_not_shuffled(spark):
    d = spark.range(0, 5000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    plan = exact_dedup.copy_groups(d, 100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("hashpartitioning(digest") == 1


def test_kept_documents_have_all_columns(spark):
    d = spark.createDataFrame([(1, "a", "x", 7), (2, "a", "y", 8), (3, None, None, 9)], "doc_id long, text string, row string, best int")
    assert sorted(map(tuple, exact_dedup.drop_copies(d).collect())) == [(2, "a", "y", 8), (3, None, None, 9)]
    assert exact_dedup.drop_copies(d.limit(0)).columns == d.columns
    assert exact_dedup.copy_groups(d.limit(0)).count() == 0


# filter audit


def audit(rows, labels):
    """(part, order, step) -> counts, straight from the definition."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    flags = defaultdict(lambda: (False, False))
    for i, q, x in labels:
        if i is not None:
            flags[i] = (flags[i][0] or q == 1, flags[i][1] or x == 1)
    docs = []
    for i, t, p in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        docs.append((p or "", fails, *flags[i]))
    out, shap = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in alive if d[1][x]]
                left = [d for d in alive if not d[1][x]]
                failing = sum(d[1][x] for d in mine)
                only = sum(d[1][x] and sum(d[1].values()) == 1 for d in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), only, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shap[part, x] += len(gone)
                alive = left
    return {(p, o, s): (*v, shap[p, o[s - 1]]) for (p, o, s), v in out.items()}


def write_files(spark, path, rows, n):
    for k in range(n):
        spark.createDataFrame(rows[k::n], DOCS).coalesce(1).write.mode("append").parquet(path)


def test_audit_takes_earlier_counts_back(spark, tmp_path):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(250))
    texts = ["short", "SHOUT", "a # b", None, "", long, long + " #", long + " X" * 300, " ".join(["same"] * 300)]
    rows = [(i, rng.choice(texts), rng.choice(["de", "en", None])) for i in range(300, 0, -1)]  # later files bring smaller ids
    rows += [(None, "short", "de"), (None, "never seen", "fr"), (17, "short", "de"), (17, "short", "en"), (-4, "short", "de")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 300, 2)] + [(10, 1, 0), (10, 0, 1), (None, 1, 1)]
    write_files(spark, f"{tmp_path}/documents.parquet", rows, 5)
    got = filter_audit.audit_filters(spark, f"{tmp_path}/documents.parquet", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == want
    assert spark.conf.get(filter_audit.PROVIDER).endswith("HDFSBackedStateStoreProvider")  # the session's own settings return


def test_audit_counters_do_not_depend_on_micro_batches(spark, tmp_path):
    rows = [(i * 7 % 101, f"text {i % 13}", "x") for i in range(400)]
    write_files(spark, f"{tmp_path}/d", rows, 6)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one, six = ({tuple(r) for r in filter_audit.counters(spark, f"{tmp_path}/d", labels, micro_batches=n).collect()} for n in (1, 6))
    assert one == six and sum(r[4] for r in one) == 400


def test_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert filter_audit.audit_filters(spark, f"{tmp_path}/documents.parquet", spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def features_of(t):
    w = words_of(t)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute_resample(docs, target):
    own, wanted = Counter(), Counter()
    for counts, texts in ((own, [t for _, t in docs]), (wanted, target)):
        for t in texts:
            counts.update(zlib.crc32(f.encode()) % 10000 for f in features_of(t))
    s, t = sum(own.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        f = features_of(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, len(words_of(text))])
    able = [r for r in rows if r[5] >= 20]
    drawn = sorted((r for r in able if r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(drawn[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resample_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["Apple", "pear,", "it's", "naïve", "日本", "x1-2", "...", "ΑΒΓ", "z" * 150]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 25, 60])))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "--- !!"), (None, "word " * 30), (7, docs[7][1]), (303, "long " * 60_000 + "end"), (304, "q" * 400_000 + " " + "r" * 70_000)]
    target = ["apple pear naïve " * 9, None, "日本 x1"]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(5)
    got = resample.resample(d, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(docs, target)


def test_resample_of_the_test_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op13_resample(spark, SF).collect()), key=str) == brute_resample(docs, target)


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    assert [r[1:3] for r in resample.resample(some, none).collect()] == [tuple(brute_resample([(1, "a b c")], [])[0][1:3])]


def test_span_crcs_of_any_length_and_stretch(monkeypatch):
    rng = random.Random(2)
    raw = np.frombuffer(rng.randbytes(300_000), np.uint8)
    start = np.array([rng.randrange(200_000) for _ in range(500)] + [0])
    end = start + np.array([rng.choice([1, 2, 63, 64, 65, 127, 128, 129, 1000, 99_999]) for _ in range(500)] + [300_000])
    want = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    for size in (100, 1 << 20):
        monkeypatch.setattr(resample, "SPAN_BYTES", size)
        assert resample.span_crcs(raw, start, end).tolist() == want


@pytest.mark.parametrize("stretch", [5, 40, 1 << 18])
def test_features_do_not_depend_on_stretches(monkeypatch, stretch):
    monkeypatch.setattr(resample, "STRETCH", stretch)
    rng = random.Random(stretch)
    texts = ["".join(rng.choices("aBc9é日 .,\n-{}", k=rng.choice([0, 1, 5, 50, 400]))) for _ in range(80)]
    raw = [t.encode() for t in texts]
    found = defaultdict(list)
    for text, crc, _ in resample.feature_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])):
        for i, c in zip(text.tolist(), crc.tolist(), strict=True):
            found[i].append(c)
    assert all(sorted(found[i]) == sorted(zlib.crc32(f.encode()) for f in features_of(t)) for i, t in enumerate(texts))


# main text of pages


def test_markup_that_must_not_lose_text():
    from opsframe.llm import html_text as H

    for page, want in (
        ("<p>a</p><svg/><p>b</p>", ["a", "b"]), ("<p>a</p><svg><path d='x'/></svg ><p>b</p>", ["a", "b"]), ("<p>a<!-->b</p>", ["ab"]), ("<p>a<!--->b</p>", ["ab"]), ("<p>a<!--x--!>b</p>c", ["ab", "c"]),
        ("<p>a<!-- never closed", ["a"]), ("<p>before <script>if (x < y) {}</script>after</p>", ["before after"]), ("<p>a <style>p {}</style><noscript>n</noscript> b</p>", ["a b"]),
        ("<p>one</p><noscript><p>two</p>", ["one", "two"]), ("<p>one</p><script>rest <p>two</p>", ["one"]), ("</svg>x", ["x"]), ("<math/>y", ["y"]),
    ):
        assert [b.text for b in H.leaf_blocks(page)] == want, page


def test_long_pages_are_labelled_in_stretches(spark):
    from opsframe.llm import html_text as H

    pages = [r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    net = H.BlockLabeller().fit(H.training_pages(sorted(set(pages))[:40], variants=2), epochs=2)
    parsed = [p for p in map(H.leaf_blocks, pages[:40]) if p]
    for p, whole in zip(parsed, net.label(parsed), strict=True):
        assert (net.label_long(p, 5) == whole).all()
    blocks = H.leaf_blocks("<article>" + "<p>some words here</p>" * 9000 + "</article><div class='footer'>no</div>")
    assert len({id(b.at) for b in blocks}) == 2 and (net.label([blocks])[0] == net.label_long(blocks, 10**6)).all()


# benchmark passages


def test_a_phrase_that_many_share_is_tiled_once(spark):
    """400 texts and 300 items share a phrase that is too short for most items; a few texts hold an item."""
    from opsframe.llm import decontaminate as D

    phrase = " ".join(f"p{i}" for i in range(12))
    word = iter(range(10**9))
    fill = lambda n: " ".join(f"w{next(word)}" for _ in range(n))
    items = [(i, f"{fill(20)} {phrase} {fill(20)}") for i in range(300)] + [(300 + i, f"{phrase} {fill(6)}") for i in range(5)] + [(400, phrase), (400, "short one")]
    docs = [(i, f"{fill(30)} {phrase} {fill(30)}") for i in range(400)] + [(1000 + i, f"{fill(5)} {items[i][1]}") for i in range(10)] + [(2000, f"{fill(9)} short one {fill(9)}")]
    b = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    _, tiled = D._tiled(d.withColumn("text_key", F.md5("text")), b, 5, 0.5)
    found = {(r.doc_id, r.item_id) for r in D.find_contamination(d, b).collect()}
    some = [400, *range(300, 305)]  # the phrase covers half of these
    assert found == {(i, t) for i, _ in docs if i < 2000 for t in some} | {(1000 + i, i) for i in range(10)} | {(2000, 400)}
    assert tiled.count() < 100  # not 410 texts
    assert D.drop_contaminated(d, b).count() == 0


# quality model


def test_a_pruned_model_still_adds_up_to_one(spark):
    from opsframe.llm import quality as Q

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = Q.ngram_counts(docs, "text", "lang")
    whole, cut = Q.fit_models(counts), Q.fit_models(counts, size=1500)
    for lang in whole:
        w, c = whole[lang].value, cut[lang].value
        assert len(c.keys[4]) < len(w.keys[4])
        symbols = np.concatenate((w.keys[1], [np.uint64(0xFFFE)]))  # all that were seen, and the place of the others
        for m in (w, c):
            for n in (2, 3, 4):
                for context in m.contexts[n][:: max(1, len(m.contexts[n]) // 15)]:
                    total = np.exp2(m.score((context << np.uint64(16)) | symbols, n).astype(np.float64)).sum()
                    assert abs(total - 1) < 0.01, (lang, n, len(m.keys[4]))


# secrets


def test_a_lone_secret_among_names_is_found(spark):
    import base64
    import string

    from opsframe.llm import secret_scan as S

    rng = random.Random(8)
    parts = "config manager service handler user account default value internal request response cache session v2 queue builder factory adapter controller number string buffer context in my to".split()
    names = ["_".join(rng.choice(parts) for _ in range(rng.choice([4, 5, 6, 8]))) for _ in range(20)] + ["".join(rng.choice(parts).title() for _ in range(6)) for _ in range(20)]
    names += ["/".join(rng.choice(parts) for _ in range(6)) for _ in range(10)] + ["-".join(rng.choice(parts) for _ in range(5)) for _ in range(10)]
    lone = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(6)] + ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(6)]
    found = 0
    for secret in lone:
        d = spark.createDataFrame([(1, " ".join(names)), (2, f"see {secret} there")], "doc_id long, text string")
        r = {x.doc_id: x for x in S.scan_secrets(d).collect()}
        assert r[1].n_random == 0, r[1].spans
        found += r[2].n_random
    assert found >= 10


def test_op1_terms_disclose_in_texts_without_spans(spark, monkeypatch):
    """A term that stands with an address elsewhere goes from texts that hold no address; sent and joined terms agree, copies and nulls too."""
    rows = [(i, f"agent Smithers {i} at x{i}@foo.com please") for i in range(12)] + [(50, "Smithers, please come"), (51, "SMITHERS"), (52, "no one here"), (53, None), (54, "")]
    rows += [(60, "Smithers, please come")] * 3 + [(100 + i, f"the cat {i} at the mat please") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    for send in (500_000, 0):
        monkeypatch.setattr(P, "SEND_ROWS", send)
        found = {r.doc_id: r for r in P.find_pii(d).collect()}
        assert (found[50].spans, found[51].spans, found[60].spans, found[50].n_email) == ("term:0:8", "term:0:8", "term:0:8", 0)
        assert all(found[i].spans == "" for i in (52, 53, 54, 101)) and found[50].base_sha256 == hashlib.sha256(b"").hexdigest()
        clean = {r.doc_id: r.text for r in P.sanitise(d).collect()}
        assert "Smithers" not in clean[50] + clean[60] and "please come" in clean[50] and "SMITHERS" not in clean[51] and (clean[52], clean[53], clean[54]) == ("no one here", None, "")
        assert send or order(P.find_pii(d)) == every
        every = order(P.find_pii(d))
