"""Quality, whitening and divergence against brute force, with nulls, ties, repeats and clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from larkspan.llm import catalogue, divergence, language_id, near_dedup, neighbours, quality, staging, suffix_dedup, whitening
from tests.llm.test_operators import brute_repeated

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, term string, label int, n long"
VECTORS = "vec_id long, embedding array<float>, label int, id long, v int, n int, component int, d int, block int"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, lang, source, 0, -1, "y", "z", 7, 3) for k, t, lang, source in rows], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, -1, 2, 3, 4, 5, 6) for k, v in rows], VECTORS)


# --- 11: quality -------------------------------------------------------------------------------------------------


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 5 == 0


def texts_of_two_kinds(rng, n):
    stems = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra") for b in ("ten", "sor", "lin", "dak")]
    prose = lambda: " ".join(rng.choice(stems) for _ in range(rng.randrange(60, 400))) + "."
    junk = lambda: " ".join(rng.choice(stems).upper() + rng.choice(("!!!", "$$$", "***")) for _ in range(rng.randrange(60, 400)))
    return [(k, prose() if k % 4 else junk(), int(k % 4 > 0)) for k in range(n)]


def test_quality_is_learned_and_held_out_rows_are_right(spark):
    rows = texts_of_two_kinds(random.Random(3), 600)
    docs = documents(spark, [(k, t, "en", "s") for k, t, _ in rows] + [(9001, None, "en", "s"), (9002, "", "en", "s"), (None, rows[1][1], "en", "s"), (1, rows[1][1], "en", "s")])
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows] + [(2, 0, 0), (None, 0, 0), (9003, 1, 0), (4, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 604
    truth = {k: q for k, _, q in rows}
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    checked = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(checked) > 90
    assert np.mean([r.predicted == truth[r.doc_id] for r in checked]) > 0.98
    empty = [r for r in got if r.doc_id in (9001, 9002)]
    assert len({r.score for r in empty}) == 1 and all(r.margin == 0 for r in empty)
    twice = [r.score for r in got if r.doc_id in (1, None)]
    assert len(twice) == 3 and len(set(twice)) == 1


def test_quality_margin_covers_the_whole_text(spark):
    rows = texts_of_two_kinds(random.Random(5), 200)
    docs = documents(spark, [(k, t, "en", "s") for k, t, _ in rows])
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    model = quality.train(docs, labels, quality.F.lit(True))
    good, bad = (" ".join(t for _, t, q in rows if q == k) for k in (1, 0))
    half = model.margin(good[:50_000] + bad[:50_000])
    assert model.margin(bad) < half < model.margin(good)
    assert half == pytest.approx((model.margin(good[:50_000]) + model.margin(bad[:50_000])) / 2, abs=0.02)
    assert model.scale > 0
    # the margin is what two compressors make of the blocks
    compress = model.compressors()
    text = rows[3][1]
    data = text.encode()
    by_hand = [sum(len(c.compress(data[at : at + 1024])) for at in range(0, len(data), 1024)) for c in compress]
    assert model.margin(text) == (by_hand[0] - by_hand[1]) / (len(data) + 16)


def test_quality_without_labels_or_documents(spark):
    docs = documents(spark, [(1, "one", "en", "s"), (2, None, "en", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score_quality(docs, none).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    n = sum(not held(k) for k in (1, 2))
    assert [r.score for r in quality.score_quality(docs, ones).collect()] == pytest.approx([(n + 1) / (n + 2)] * 2)
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(quality.score_quality(docs, both).collect()) == 2
    assert quality.score_quality(docs.limit(0), both).collect() == []
    assert quality.keep_good(docs, none).columns == docs.columns


def test_quality_sample_is_bounded_by_its_parameters(spark):
    rows = texts_of_two_kinds(random.Random(7), 400)
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    ids = quality.chosen(labels, "doc_id", "quality", quality.F.lit(True), 20).collect()
    assert Counter(r.label for r in ids) == {0: 40, 1: 40} and {r.role for r in ids} == {0, 1}
    docs = documents(spark, [(k, t, "en", "s") for k, t, _ in rows])
    small = quality.train(docs, labels, quality.F.lit(True), rows=20, blocks=10)
    right = [(small.scores(np.array([small.margin(t)]))[0] >= 0.5) == q for _, t, q in rows]
    assert np.mean(right) > 0.95


def test_quality_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in catalogue.op11_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    known = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held(r.doc_id) and r.doc_id in got]
    assert np.mean([p == q for p, q in known]) > 0.9
    assert np.mean([p for p, q in known if q == 1]) > 0.95


# --- 12: whitening -----------------------------------------------------------------------------------------------


def brute_whitening(rows, components):
    fit = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in fit]
    n, dims = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dims)]
    off = [[n * r[j] - sums[j] for j in range(dims)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(dims)] for i in range(dims)])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    white = np.array(off) / n @ vecs / np.sqrt(np.maximum(values, 1e-300))
    return fit, [sum(o * o for o in r) for r in off], values, white[:, :components], np.trace(cov)


def mixed_vectors(rng, n, dims):
    base = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) * 0.3
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base.astype(np.float32))]
    rows += [(900, None), (901, [None] + [0.5] * (dims - 1)), (902, [float("nan")] * dims), (903, [float("inf")] + [0.0] * (dims - 1)), (904, [0.5] * (dims + 2)), (905, [])]
    return rows + [rows[3], rows[3], (None, rows[4][1])]


@pytest.mark.parametrize(("n", "dims"), [(120, 40), (60, 5), (30, 33)])
def test_whitening_equals_brute_force(spark, n, dims, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    rows = mixed_vectors(np.random.default_rng(n), n, dims)
    fit, deviation, values, white, trace = brute_whitening([r for r in rows if r[0] not in (904, 905)], 32)
    width = min(32, dims, int((values > 1e-10 * values[0]).sum()))
    got = whitening.whiten(vectors(spark, rows).repartition(7)).collect()
    assert len(got) == len(fit) * width
    assert Counter(r.vec_id for r in got) == {k: c * width for k, c in Counter(k for k, _ in fit).items()}
    first = {}
    for k, (name, _) in enumerate(fit):
        first.setdefault(name, k)
    for r in got:
        assert r.n == len(fit) and r.deviation == deviation[first[r.vec_id]]
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        assert r.identity_error < 1e-6
    for c in range(1, width + 1):
        mine = np.array([r.whitened for r in got if r.component == c])
        theirs = np.array([white[first[r.vec_id], c - 1] for r in got if r.component == c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6


def test_whitening_does_not_depend_on_how_rows_are_dealt(spark):
    rows = mixed_vectors(np.random.default_rng(8), 150, 20)
    one, other = ({(r.vec_id, r.component): r.whitened for r in whitening.whiten(vectors(spark, rows).repartition(p)).collect()} for p in (1, 9))
    assert one == other


def test_projection_of_a_row_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(9)
    x, v = rng.normal(size=(1500, 20)) * 1e3, rng.normal(size=(20, 20))
    known = whitening.Facts(1500, [0] * 20, np.zeros(20, np.int64), np.zeros(20, np.int64))
    model = whitening.Whitening(known, np.ones(20), v, 1.0)
    whole = model.project(x)
    assert whole == pytest.approx(x @ v, abs=1e-8)
    for n in (1, 2, 3, 5, 17, 150, 1025):
        assert np.array_equal(model.project(x[:n]), whole[:n]) and np.array_equal(model.project(x[-n:]), whole[-n:])


def test_whitening_of_large_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate((rng.normal(size=(40, 4)) * [1e9, 1e7, 1, 1e3]).astype(np.float32))]
    _, deviation, values, white, _ = brute_whitening(rows, 32)
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.vec_id: int(r.deviation) for r in got} == dict(enumerate(deviation))
    kept = {r.component for r in got}
    assert kept == set(range(1, int((values > 1e-10 * values[0]).sum()) + 1)) and len(kept) >= 2
    mine = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == 1])
    assert min(np.abs(mine - white[:, 0]).max(), np.abs(mine + white[:, 0]).max()) < 1e-6


def test_whitening_of_nothing_to_divide_by(spark):
    same = [float(c) for c in range(6)]
    assert whitening.whiten(vectors(spark, [(1, same)])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, same), (2, same)])).collect() == []
    empty = whitening.whiten(vectors(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = [(k, [float(k % 3), 1.0, float(k % 3)]) for k in range(9)]
    assert {r.component for r in whitening.whiten(vectors(spark, flat)).collect()} == {1}


def test_whitening_query_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    _, deviation, values, white, trace = brute_whitening([(r.vec_id, r.embedding) for r in table], 32)
    got = catalogue.op12_whitening(spark, sf_dir).collect()
    assert len(got) == 32 * len(table)
    place = {r.vec_id: k for k, r in enumerate(table)}
    assert all(r.deviation == deviation[place[r.vec_id]] and r.identity_error < 1e-9 for r in got)
    for c in (1, 2, 32):
        ours = {r.vec_id: r.whitened for r in got if r.component == c}
        theirs = {k: white[at, c - 1] for k, at in place.items()}
        assert min(max(abs(ours[k] - s * theirs[k]) for k in ours) for s in (1, -1)) < 1e-6


# --- 13: divergence ----------------------------------------------------------------------------------------------


def brute_divergence(rows, least, top):
    count, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        count.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    kept = defaultdict(list)
    for (lang, t), d in docs.items():
        if d >= least:
            kept[lang].append(t)
    out = set()
    for lang in {g[0] for g in groups}:
        terms, sources = sorted(kept[lang], key=str.encode), [s for g, s in groups if g == lang]
        share = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * len(terms))  # noqa: E731, B023
        by = {s: [count[lang, s, t] for t in terms] for s in sources}
        p = {s: [share(c, sum(by[s])) for c in by[s]] for s in sources}
        all_of = [sum(by[s][k] for s in sources) for k in range(len(terms))]
        q = [share(c, sum(all_of)) for c in all_of]
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            mine = [(a - b, t) for a, b, c, t in zip(p[s], q, by[s], terms) if c > 0 and a > b]
            for part, found in (("pair", pairs), ("term", mine)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out.update((lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top)
    return out


def mixed_documents(rng, n):
    vocabulary = [f"{a}{b}" for a in ("Al", "be", "Çé", "日本", "xy", "z") for b in ("ma", "no", "Ü", "tion", "ly", "ß")]
    rows = []
    for k in range(n):
        lang = rng.choice(("en", "de", "xx", None))
        source = rng.choice(("a", "B", "é", "zz", "", None, "hot", "hot", "hot", "hot"))
        words = [rng.choice(vocabulary[: 6 + 6 * len(lang or "")]) for _ in range(rng.randrange(0, 60))]
        rows.append((k, rng.choice((" ", "-", "\n9", "\x00")).join(words), lang, source))
    rows += [(7000, None, "en", "only null"), (7001, "123 !!", "de", "no term"), (7002, "lone term", "lonely", "s"), (7003, None, "bare", "s"), (7004, "", "bare", "t"), (None, "alma", None, None)]
    return rows + [(7005, "alma " * 30_000, "en", "a"), rows[0], rows[0]]


@pytest.mark.parametrize(("block", "slices", "held"), [(1024, 256, 1 << 18), (3, 256, 40), (4, 2, 7)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, slices, held):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SLICE", slices)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = mixed_documents(random.Random(block), 400)
    got = divergence.divergence(documents(spark, rows).repartition(5), least_docs=9, top=4).collect()
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == brute_divergence(rows, 9, 4)
    assert len(got) == len({(r.lang, r.source, r.part, r.item) for r in got})


def test_divergence_by_shuffle_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SMALL_LANGS", 0)
    rows = mixed_documents(random.Random(2), 60)
    got = divergence.divergence(documents(spark, rows), least_docs=3, top=50).collect()
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == brute_divergence(rows, 3, 50)
    assert divergence.divergence(documents(spark, [])).collect() == []


def test_probabilities_stay_exact_beyond_64_bits_of_products():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9 * 10**15)
        c, v = rng.randrange(0, n + 1), rng.randrange(1, 10**6)
        assert int(divergence.probabilities(np.array([c]), n, v)[0]) == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_lost_or_repeated_tasks_do_not_count_twice(spark):
    """Whatever the deal of rows to tasks, counts are those of all rows."""
    rows = mixed_documents(random.Random(6), 120)
    results = [{tuple(r) for r in divergence.divergence(documents(spark, rows).repartition(p), least_docs=4).collect()} for p in (1, 13)]
    assert results[0] == results[1]


# --- what is keyed, sampled or kept --------------------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [(1024, 64), (3, 2)])
def test_repeated_bytes_with_null_and_repeated_identifiers(spark, monkeypatch, buckets):
    monkeypatch.setattr(suffix_dedup, "BUCKET", buckets[0])
    monkeypatch.setattr(suffix_dedup, "RUNS", buckets[1])
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    shared, whole = prose(60), prose(80)
    texts = [whole, whole, prose(90), f"{prose(20)} {shared} {prose(5)}", f"{shared} {prose(9)}", prose(70), None, "", whole, f"{prose(8)} {shared}"]
    ids = [None, 1, None, 2, None, 2, None, None, 2**62 + 1, 2**62 + 1]
    rows = list(zip(ids, texts))
    got = suffix_dedup.repeated_bytes(documents(spark, [(k, t, "en", "s") for k, t in rows]), length=120).drop("removed", "text").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(key((k, *r)) for (k, _), (_, *r) in zip(rows, brute_repeated([(n, t) for n, (_, t) in enumerate(rows)], 120)))
    left = suffix_dedup.drop_repeated(documents(spark, [(k, t, "en", "s") for k, t in rows]), length=120).collect()
    assert sorted(len(r.text or "") for r in left) == sorted(r.n_bytes - r.n_removed for r in got)
    words = suffix_dedup.drop_repeated(documents(spark, [(k, t, "en", "s") for k, t in rows]), length=101, words=51).collect()
    assert len(words) == len(rows) and sum(whole in (r.text or "") for r in words) == 0


def test_samples_of_huge_tables_are_not_empty():
    for n in (10**6, 10**11, 10**18):
        assert 0 < staging.cut_at(20_000 / n) < 1 << 63
    assert staging.cut_at(5.0) == (1 << 63) - 1 and staging.cut_at(0.0) == 0


def test_small_shares_leave_rows_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LEAST_ROWS", 5)
    rows = [(k, "the and of with", "en", "s") for k in range(3000)] + [(3000 + k, "und der mit von", "de", "s") for k in range(4)]
    model = language_id.train(documents(spark, rows).repartition(8), max_rows=100)
    assert model.languages == ["de", "en"]
    assert model.predict(["und mit der", "of the"])[0][0] == "de"
    with pytest.raises(ValueError):
        language_id.train(documents(spark, [(k, "1 2 3", "en", "s") for k in range(300)]), max_rows=10)


def test_sample_of_vectors_is_never_empty_without_notice(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 40)
    rng = np.random.default_rng(1)
    table = vectors(spark, [(k, [float(c) for c in v]) for k, v in enumerate(rng.normal(size=(300, 6)).astype(np.float32))])
    got = neighbours.nearest(table, F.col("id") % 50 == 0).collect()
    assert len(got) == 6 * 5
    monkeypatch.setattr(neighbours, "cut_at", lambda share: -1)
    with pytest.raises(ValueError):
        neighbours.nearest(table, F.col("id") % 50 == 0)


def test_kept_is_true_or_false_for_null_identifiers(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en", "s"), (None, text, "en", "s"), (None, "", "en", "s"), (None, "alone in the world", "en", "s"), (2, "another text of words", "en", "s")]
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (None, 1, False), (None, None, True), (None, None, True), (2, 2, True)], key=str)
