"""That results come out of the methods named, at sizes and in shapes where short cuts would show."""

import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspan.llm import exact_dedup, html_text, language_id, near_dedup, neighbours, packing, sharding, staging
from tests.llm.test_operators import DOCS, PARTS, sets_of, table, words


def test_all_sequences_come_from_the_program(spark):
    """Within 1 % of the lower bound on the lengths of the tables."""
    own = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    lengths = [n for ids in own.ids_many(texts) for n in packing.cut_lengths(len(ids) // 4 + 1, 1024)]
    h = np.bincount(lengths, minlength=1025)
    configs = packing.plan(h, 1024)
    assert (sum(c * n for c, n in configs) == h).all()
    assert sum(n for _, n in configs) <= 1.01 * packing.lower_bound(h, np.arange(1025.0), 1024)


def test_ids_of_odd_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.TokenPieces(path)
    rng = random.Random(13)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.ids_many(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_other_splits_are_refused():
    with pytest.raises(ValueError):
        packing.refuse_other_kinds({"pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "BPE"}})


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_patterned_words_are_not_alike(spark):
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, [(1, f"x y {a}"), (2, f"x y {b}"), (3, f"x {a} y {b} z")]), words=3, percent=85).collect()}
    assert {r.component_id for r in got.values()} == {1, 2, 3} and got[3].n_shingles == 3


@pytest.mark.parametrize("percent", [80, 85])
def test_large_nodes_in_blocks(spark, monkeypatch, percent):
    """Blocks of eight: a group of copies, a chain beside it and documents that only share a line."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    rng = random.Random(14)
    seed, rows = words(rng, 200).split(), []
    for k in range(60):
        w = list(seed)
        for _ in range(3 if k < 40 else 12):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(seed[:30]) + " " + words(rng, 60)) for k in range(30)]
    sets = dict(sets_of(rows, 5))
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows), words=5, percent=percent).collect()}
    for a, b in ((a, b) for a in sets for b in sets if a < b):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            assert found[a] == found[b]
    assert all(found[100 + k] == 100 + k for k in range(30))


def test_trees_reach_the_recall():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** near_dedup.LEVELS) ** near_dedup.trees(percent) <= 1 - near_dedup.RECALL + 1e-12
    assert near_dedup.least_agreeing(40, 85) <= 34


def test_neighbours_are_pruned_and_found(spark, monkeypatch):
    """A third of all rows is one vector; of the others, most are never compared exactly."""
    monkeypatch.setattr(neighbours, "SAMPLE", 3000)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16)) * 3
    x = np.concatenate((centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)), np.tile(rng.normal(size=16), (3000, 1))))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    model = neighbours.fit(neighbours.distinct_vectors(neighbours.usable(vectors, "vec_id", "embedding"), 6), 5)
    assert model.probes * model.share < 0.5 * len(model.centres)
    got = {}
    for r in sorted(neighbours.nearest(vectors, F.col("id") % 50 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    norm, hits = np.sqrt((x**2).sum(axis=1)), 0
    for q in range(0, 9000, 50):
        cos = (x * x[q]).sum(axis=1) / (norm * norm[q])
        cos[q] = -2
        hits += len(set(np.lexsort((np.arange(9000), -cos))[:5].tolist()) & set(got[q]))
    assert hits >= 0.9 * 5 * 180
    assert got[6000] == [6001, 6002, 6003, 6004, 6005] and got[6050] == [6000, 6001, 6002, 6003, 6004]


def test_neighbours_are_fitted_in_little_memory():
    """The driver fits a whole sample, with as many cells as millions of rows get; before, tables of it against all entries and cells took 270 MB."""
    sample = neighbours.unit(np.random.default_rng(4).normal(size=(neighbours.SAMPLE, 8)))
    tracemalloc.start()
    try:
        model = neighbours.Model.fit(sample, 1 << 22, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.centres) == 1024 and peak < 100e6


def test_entries_solve_the_whole_system():
    """Cholesky by block rows gives the least squares solution that the full matrix has."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 48))
    full, right = x.T @ x + 0.1 * np.eye(48), rng.normal(size=(48, 7))
    for size in (48, 16, 1):
        lower = [full[at : at + size, : at + size].copy() for at in range(0, 48, size)]
        assert neighbours.solved(lower, right) == pytest.approx(np.linalg.solve(full, right), abs=1e-9)


def test_neighbours_of_queries_of_another_kind(spark):
    """All rows but the queries lie in tight groups; what suffices for them finds few neighbours of the queries."""
    rng = np.random.default_rng(4)
    n, groups = 6000, rng.normal(size=(40, 32))
    x = groups[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, 32))
    x[::50] = rng.normal(size=(n // 50, 32))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(vectors, F.col("id") % 50 == 0).collect()}
    unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    hits = 0
    for q in range(0, n, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        hits += sum((q, int(k)) in got for k in np.argsort(-cos)[:5])
    assert len(got) == n // 50 * 5 and hits >= 0.9 * len(got)


def test_scores_of_vectors_of_any_size(spark):
    rows = [(0, [3e200, 4e200]), (1, [4e-200, 3e-200]), (2, [1.0, 0.0]), (3, [-1e300, 0.0])]
    got = [(r.vec_id, r.score) for r in sorted(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect(), key=lambda r: r["rank"])]
    assert [k for k, _ in got] == [1, 2, 3] and [s for _, s in got] == pytest.approx([0.96, 0.6, -0.6])


def test_vectors_of_different_lengths(spark):
    rows = [(k, [1.0, float(k)]) for k in range(8)] + [(50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 3.5]), (51, [1.0, 2.0, 3.5]), (None, [1.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    assert [r.vec_id for r in got if r.query_id == 50] == [51]
    assert sorted(r.vec_id for r in got if r.query_id == 0) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("make", [lambda n: '<a "' * n, lambda n: "<div>" * n + "</span>" * n, lambda n: "<li><ul>" + "<div>" * n + "<li></li>" * n, lambda n: "<header>" * n, lambda n: "<a " * n + 'x=">"'])
def test_hostile_pages_take_linear_time(make):
    page = make(60_000)
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 10


def test_parts_of_an_article_without_its_tag():
    long = "".join("<p>" + "word " * 60 + "</p>" for _ in range(5))
    page = f"<body><div><a href=1>home</a> <a href=2>news</a></div><div id=c><h1>T</h1><div>By X</div><div>{long}</div><div>{long}</div></div></body>"
    assert html_text.main_text(page).split().count("word") == 600


def test_a_word_across_a_step_is_whole(monkeypatch):
    text = "abc defghij klm " * 40
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "STEP", 7)
    cut = language_id.counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_language_scores_by_hand(spark):
    rows = [(1, "aa ab", "x"), (2, "ba bb bb", "y"), (3, "aa ab", "x"), (4, None, "x"), (5, "cc", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["ab a", "bb", "zz qq", "bb ab"]
    for text, (lang, score) in zip(texts, model.predict(texts)):
        points = f" {text} "
        grams = [points[k : k + n] for n in (1, 2, 3) for k in range(len(points) - n + 1)]
        seen, n = language_id.counts(text)
        assert n.sum() == len(grams)
        logs = model.prior + language_id.EVIDENCE * sum(model.logs[b] * c for b, c in zip(seen, n))
        p = np.exp(logs - logs.max())
        assert lang == model.languages[int(logs.argmax())] and abs(score - p.max() / p.sum()) < 1e-9


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(k, "text", f"l{k}") for k in range(3)]
    with pytest.raises(ValueError):
        language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_groups_without_identifiers_have_a_shard(spark):
    rows = [(None, "a" * 50), (None, "a" * 50), (None, "b" * 9), (7, "c" * 30), (7, "d" * 5), (8, "e" * 40)]
    got = sharding.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=3).collect()
    loads = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert len(got) == 6 and max(loads.values()) == 102
    for shard in loads:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_another_text_under_the_same_identifier_stays(spark):
    rows = [(1, "same text"), (7, "same text"), (7, "a text of its own")]
    kept = exact_dedup.drop_exact_duplicates(spark.createDataFrame([(k, t, "en", "s", 0, "x", k, "y", "z") for k, t in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "same text"), (7, "a text of its own")]


def test_names_are_free():
    class Table:
        columns = ["Key", "_key", "x"]

    assert staging.free_names(Table, "key", "x", "x") == ["__key", "_x", "__x"]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        staging.shared_root(Session)


def test_encoding_costs_no_more_than_the_merges():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = packing.TokenPieces(path)
    rng = random.Random(3)
    texts = [" ".join(f"{rng.randrange(10**9):x}" for _ in range(2000)) for _ in range(60)]

    def seconds(encode) -> float:
        began = time.process_time()
        encode()
        return time.process_time() - began

    plain = lambda: [np.array(own.ranks.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]
    assert list(own.ids_many(texts)) == plain()
    assert min(seconds(lambda: list(packing.TokenPieces.ids_many(own, texts))) for _ in range(3)) < 1.3 * min(seconds(plain) for _ in range(3))


def test_only_wanted_texts_are_shuffled(spark):
    rows = spark.range(20_000).select("id", F.lit("x").alias("t"))
    wanted = spark.range(0, 20_000, 97).select("id")
    found = near_dedup.marked(rows, wanted)
    ids = {r.id for r in found.collect()}
    assert ids >= set(range(0, 20_000, 97)) and len(ids) < 260
    assert found.columns == ["id", "t"]
    assert near_dedup.marked(rows, wanted.limit(0)).count() == 0
