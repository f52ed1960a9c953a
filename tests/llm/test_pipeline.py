"""The pipeline against brute force on a small corpus, and rows with nulls everywhere."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from larkspan.llm import byte_bpe, exact_dedup, language_id, near_dedup, packing, sharding, suffix_dedup, token_counts
from tests.llm.test_operators import brute_repeated, sets_of, table, words

CAPACITY = 1024


def small_corpus():
    rng = random.Random(8)
    passage = words(rng, 90)
    base = words(rng, 400)
    near = base.split()
    near[10] = "other"
    rows = [(k, words(rng, rng.randrange(20, 120))) for k in range(40)]
    rows += [(50, base), (51, base), (52, " ".join(near)), (53, base.replace(" ", "\n")), (54, "12345 --- 678"), (55, None), (56, "")]
    rows += [(60 + k, words(rng, 60) + " " + passage + " " + words(rng, 60)) for k in range(4)]
    return rows


def expected_texts(rows):
    rows = [(k, t) for k, t in rows if t and any(c.isalpha() for c in t)]
    seen, kept = set(), []
    for k, t in sorted(rows):
        key = " ".join(t.split())
        if key not in seen:
            seen.add(key)
            kept.append((k, t))
    sets, out = dict(sets_of(kept, 5)), []
    for k, t in kept:
        if not any(100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j]) for j, _ in out):
            out.append((k, t))
    length = corpus_pipeline.PASSAGE_BYTES
    texts = {}
    for k, t in out:
        data = t.encode()
        others = [data[:0]] + [u.encode() for j, u in out if j != k]
        hit = np.zeros(len(data), dtype=bool)
        for at in range(len(data) - length + 1):
            piece = data[at : at + length]
            if any(piece in o for o in others) or data.find(piece) != at or data.find(piece, at + 1) >= 0:
                hit[at : at + length] = True
        texts[k] = bytes(np.frombuffer(data, np.uint8)[~hit]).decode()
    return texts


def test_pipeline(spark, tmp_path):
    rows = small_corpus()
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    expected = {}
    for k, t in expected_texts(rows).items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for piece, n in enumerate(packing.cut_lengths(len(ids), CAPACITY)):
            expected.setdefault(k, []).append((piece, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert language_id.keep_identified(docs).count() >= 0.97 * docs.filter(F.col("text").rlike("\\p{L}")).count()


@pytest.fixture(scope="module")
def holes(spark):
    """A row without identifier or text, one without identifier, one with nulls beside its text."""
    rows = [(None, None, None), (None, "some words of a text", "en"), (1, "some words of a text", None), (2, "other words of a text", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_nulls_in_any_column(spark, holes):
    assert exact_dedup.exact_duplicates(holes).count() == 4
    assert {r.keep_id for r in exact_dedup.exact_duplicates(holes).filter("doc_id = 1").collect()} == {1}
    assert sharding.minimax_shards(holes).filter("doc_id IS NOT NULL").count() == 2
    assert suffix_dedup.repeated_bytes(holes).count() == 4
    assert near_dedup.near_duplicates(holes).count() == 4
    assert language_id.identify(holes).count() == 4
    assert token_counts.token_counts(holes, public_tokenizers.path("piece_bpe_32k.model")).count() == 4
    assert byte_bpe.round_trip(holes, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 4
    assert packing.pack(holes, public_tokenizers.path("byte_bpe_50k.json")).count() == 4


def test_repeats_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix_dedup.repeated_bytes(docs, length=300).drop("removed", "text").collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeated(rows, 300))


def test_passages_of_fifty_one_words(spark, sf_dir):
    rng = random.Random(9)
    long = lambda n: [f"unrelated{rng.randrange(10**9)}" for _ in range(n)]
    short = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") for _ in range(n)]
    passage, fifty, left, right = short(51), [f"repeated{k}" for k in range(50)], short(40), short(40)
    ideographs = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60))
    texts = [
        " ".join([*long(30), *passage, *long(30)]),
        " ".join([*passage, *long(40)]),
        " ".join([*long(30), *fifty, *long(30)]),
        " ".join([*long(20), *fifty, *long(20)]),
        # 60 words that two others hold 40 of each: none is of over fifty
        " ".join([*long(9), *left, *right[20:], *long(9)]),
        " ".join([*long(9), *left, *long(9)]),
        " ".join([*long(9), *left[30:], *right[20:], *long(9)]),
        f"{long(1)[0]} {ideographs} {long(1)[0]}",
        f"{long(1)[0]} {ideographs} {long(1)[0]}",
    ]
    assert len(" ".join(passage)) < 300
    got = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, table(spark, list(enumerate(texts))), sf_dir).collect()}
    for k in (0, 1):
        assert not set(passage) & set(got[k].split())
        # the words beside the passage may lose letters that are repeated with it
        assert len(set(texts[k].split()) - set(passage) - set(got[k].split())) <= 2
    assert [got[k] for k in range(2, 7)] == texts[2:7]
    assert not any(set(ideographs) & set(got[k]) for k in (7, 8))


def test_whole_words():
    text = "ab\u00a0c\u3000\u4e2d\u6587d \u0142\u00f3\u017a.\n\u0e01".encode()
    assert [m.group().decode() for m in suffix_dedup.WORD.finditer(text)] == ["ab", "c", "\u4e2d", "\u6587", "d", "\u0142\u00f3\u017a.", "\u0e01"]
