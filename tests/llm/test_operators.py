"""The operators on small tables, against brute force, libraries and round trips."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larkspan.llm import byte_bpe, components, exact_dedup, html_text, language_id, near_dedup, neighbours, packing, sharding, staging, suffix_dedup, token_counts
from larkspan.llm.pretokens import space_chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, t string, rep string"
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "▁", "é", "日本", "🙂", "ing", "'s", "'ll", " ", "　", "<s>", "<|endoftext|>", "\x00", "aaaa", "9", "-", " \n ", "́"]


def table(spark, texts):
    """Documents with further columns whose names operators use inside."""
    rows = [(k, t, "en", "s", 0, "x", -1, "y", "z") for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus():
    """Nulls, empty, short, repeated, near-copied and long texts."""
    rng = random.Random(1)
    base, passage = words(rng, 300), words(rng, 90)
    near = base.split()
    near[7], near[150] = "changed", "words"
    texts = [None, "", "   ", "one", "one two", "One  Two", base, base, base.replace(" ", "  "), " ".join(near), passage, words(rng, 80) + " " + passage + " " + words(rng, 50)]
    texts += [passage + " " + words(rng, 9), "a" * 1500, "é" * 500, words(rng, 20_000), "ab" * 600, words(rng, 70) + " " + passage]
    out = list(enumerate(texts))
    return [*out, out[6], (90, base), (91, None)]


def test_exact_duplicates(spark):
    rows = corpus()
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    same = Counter(key(t) for _, t in rows)
    expected = sorted((k, min(j for j, u in rows if key(u) == key(t)), same[key(t)], hashlib.sha256(key(t).encode()).hexdigest()) for k, t in rows)
    got = exact_dedup.exact_duplicates(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = {r.doc_id for r in exact_dedup.drop_exact_duplicates(table(spark, rows)).collect()}
    assert kept == {k for k, m, *_ in expected if k == m}


def brute_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)

    def needed(c):
        count, room = 1, c
        for s in sizes:
            if s > room:
                count, room = count + 1, c
            room -= s
        return count

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= n else (mid + 1, high)
    return low


def test_minimax_shards(spark):
    rows = corpus()
    got = sharding.minimax_shards(table(spark, rows)).collect()
    assert len(got) == len(rows)
    keys = {}
    for k, t in rows:
        keys.setdefault(t or "", []).append(k)
    groups = sorted((min(ks), len(ks) * (len(t.encode()) + 1)) for t, ks in keys.items())
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) == brute_capacity([s for _, s in groups], 8)
    for shard in loads:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    of = {}
    for r in got:
        of.setdefault(r.keep_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    assert all(r.text_crc32 == zlib.crc32((dict(rows)[r.doc_id] or "").encode()) for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_capacity_search(spark, n):
    rng = random.Random(n)
    sizes = [rng.randrange(1, 400) for _ in range(60)]
    ends = spark.createDataFrame([(k, s, sum(sizes[: k + 1])) for k, s in enumerate(sizes)], "keep_id long, bytes long, ends long")
    assert sharding.smallest_capacity(ends, max(sizes), sum(sizes), n)[0] == brute_capacity(sizes, n)


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS + [" " * 17, " " * 45]) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    texts += ["".join(rng.choice("abcdehinorst") for _ in range(5000)), "a" * 9000, " " * 300]
    assert token_counts.counter(path).count_many(texts) == [len(x) for x in model.encode(texts)]
    got = token_counts.token_counts(table(spark, corpus()), path, limit=100).collect()
    expected = sorted((k, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for k, t in corpus())
    assert sorted(map(tuple, got)) == expected


def test_byte_bpe(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.codec(path, public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + ["a" * 20_000, "".join(rng.choice("abcdehinorst") for _ in range(5000))]
    for t in texts:
        ids = own.ids(t)
        assert ids == library.encode_ordinary(t)
        assert own.encoder.decode(ids) == t.encode()
    for r in byte_bpe.round_trip(table(spark, corpus()), path, public_tokenizers.PATTERN).collect():
        text = dict(corpus())[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_a_token_encodes_to_itself():
    own = byte_bpe.TreeEncoder(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    assert all(own.merged(t) == (t,) for t in own.ranks if len(t) > 1)


def test_chunks_are_the_text():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(PARTS) for _ in range(9))
        assert "".join(space_chunks(text)) == text


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(500):
        s = [rng.randrange(rng.choice((1, 2, 3, 6))) for _ in range(rng.randint(1, 50))]
        found = suffix_dedup.grouped_suffix_array(s)
        assert found == sorted(range(len(s)), key=lambda k: s[k:])


def brute_repeated(rows, length):
    starts = Counter()
    for _, t in rows:
        d = (t or "").encode()
        starts.update(d[k : k + length] for k in range(len(d) - length + 1))
    for k, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d) + 1, dtype=int)
        for at in range(len(d) - length + 1):
            if starts[d[at : at + length]] > 1:
                gone[at] += 1
                gone[at + length] -= 1
        hit = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], hit.astype(int), [0]))) == 1).sum())
        yield k, len(d), int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~hit])).hexdigest()


@pytest.mark.parametrize("length", [400, 120])
def test_repeated_bytes(spark, length):
    rows = corpus()
    got = suffix_dedup.repeated_bytes(table(spark, rows), length=length).drop("removed", "text").collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeated(rows, length))


@pytest.mark.parametrize("bucket", [2, 6, 40])
def test_common_anchors(spark, monkeypatch, bucket):
    """Buckets so small that lines, passages and their edges are cut into stretches and single strings."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(11)
    line, passage = words(rng, 9), words(rng, 70)
    ends = [words(rng, 4), words(rng, 6)]
    rows = [(k, f"{words(rng, 30)} {line} {words(rng, 30)}") for k in range(30)]
    rows += [(k, f"{words(rng, 20)} {rng.choice(ends)} {passage} {rng.choice(ends)} {words(rng, 20)}") for k in range(30, 70)]
    for length in (120, 300):
        got = suffix_dedup.repeated_bytes(table(spark, rows), length=length).drop("removed", "text").collect()
        assert sorted(map(tuple, got)) == sorted(brute_repeated(rows, length))


def test_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rng = random.Random(12)
    passage = words(rng, 300)
    rows = [(1, f"{words(rng, 900)} {passage} {words(rng, 900)}"), (2, f"{words(rng, 333)} {passage}"), (3, words(rng, 2000))]
    got = {r.doc_id: r for r in suffix_dedup.repeated_bytes(table(spark, rows)).collect()}
    assert sorted(tuple(got[k])[:5] for k in got) == sorted(brute_repeated(rows, 400))
    for k, t in rows:
        data = t.encode()
        left = b"".join(data[a:b] for a, b in zip([0] + [y for _, y in got[k].removed], [x for x, _ in got[k].removed] + [len(data)]))
        assert got[k].text == left.decode()


def test_rows_of_a_common_anchor_go_to_several_tasks(spark, monkeypatch):
    """One line in every text, beside other words each time: most segments and most different ones have its anchors."""
    dealt = {}

    def watched(df, name):
        out = staging.staged(df, name)
        if name in ("candidates", "distinct"):  # a task writes a file
            dealt[name] = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
        return out

    monkeypatch.setattr(suffix_dedup, "staged", watched)
    rng = random.Random(17)
    line = words(rng, 18)
    rows = [(k, f"{words(rng, 4)} {line} {words(rng, 4)}") for k in range(2000)]
    confs = {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "32", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(f"spark.sql.{k}", v)
        got = suffix_dedup.repeated_bytes(table(spark, rows), length=60).drop("removed", "text").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert sorted(map(tuple, got)) == sorted(brute_repeated(rows, 60))
    assert all(max(n) <= 0.2 * sum(n) for n in dealt.values()) and len(dealt) == 2, {k: (max(n), sum(n)) for k, n in dealt.items()}


def test_stretches_of_a_common_key_go_to_several_tasks(spark, monkeypatch):
    """One line in every text, beside other words each time: the stretches around an anchor in it share a key."""
    dealt = []

    def watched(df, name):
        out = staging.staged(df, name)
        if name == "kinds":  # a task writes a file
            dealt.append([r["count"] for r in out.groupBy(F.input_file_name()).count().collect()])
        return out

    monkeypatch.setattr(suffix_dedup, "staged", watched)
    rng = random.Random(17)
    line = words(rng, 18)
    rows = [(k, f"{words(rng, 4)} {line} {words(rng, 4)}") for k in range(2000)]
    confs = {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "32", "adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(f"spark.sql.{k}", v)
        got = suffix_dedup.repeated_bytes(table(spark, rows), length=60).drop("removed", "text").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert sorted(map(tuple, got)) == sorted(brute_repeated(rows, 60))
    assert dealt and all(max(n) <= 0.2 * sum(n) for n in dealt), [(max(n), sum(n)) for n in dealt]


def test_rows_of_many_texts_leave_python_together():
    """A frame takes the rows of all its texts, those without any among them, and text keys as well as numbers."""
    texts = pd.DataFrame({"k": ["b", "a", "c"], "h": [2, 1, 1 << 62]})
    found = [(np.array([5, 6]), np.array([0, 1])), (np.zeros(0, np.int64),) * 2, (np.array([7]), np.array([2]))]
    got = suffix_dedup.beside_keys(texts, ["x", "y"], found)
    assert list(got.itertuples(index=False, name=None)) == [("b", 2, 5, 0), ("b", 2, 6, 1), ("c", 1 << 62, 7, 2)]


def test_drop_repeated_keeps_columns(spark):
    docs = table(spark, corpus())
    out = suffix_dedup.drop_repeated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.filter("doc_id = 0").collect()} == {None}


def sets_of(rows, n):
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        yield k, {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    rng = random.Random(6)
    rows = corpus()
    # a large group: each copy of the seed differs in two words
    seed = words(rng, 400).split()
    for k in range(200, 320):
        w = list(seed)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = list(sets_of(rows, n))
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    expected = sorted((k, len(s), find(k), k == find(k)) for k, s in sets)
    assert sorted(map(tuple, near_dedup.near_duplicates(table(spark, rows), words=n, percent=percent).collect())) == expected


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    found = {r.id: r.component_id for r in components.connected_components(links).collect()}
    assert set(found.values()) == {0, 100} and len(found) == 43


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.95
    odd = language_id.predict(table(spark, [(0, None), (1, ""), (2, "12 %&"), (3, "the")]), language_id.train(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in odd}.items() >= {0: "und", 1: "und", 2: "und"}.items()
    assert all(0 <= r.score <= 1 for r in odd)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*dict(corpus()).items(), (300, "x<|endoftext|> y"), (301, "<|endoftext|>")]
    got = sorted(packing.pack(table(spark, rows), path, capacity=128).collect(), key=lambda r: (r.doc_id, r.piece))
    for k, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = [r for r in got if r.doc_id == k]
        assert [r.length for r in own] == packing.cut_lengths(len(ids), 128)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= 1.02 * sum(r.length for r in got) / 128 + 2


def test_plan_covers_the_histogram():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 129, 3000), rng.choice([50, 46, 32, 16], 3000), np.array([128]), np.array([], dtype=int)):
        h = np.bincount(lengths, minlength=129)
        configs = packing.plan(h, 128)
        total = sum((c * n for c, n in configs), np.zeros(129, dtype=int))
        assert (total == h).all()
        assert all((c * np.arange(129)).sum() <= 128 for c, _ in configs)


PAGE = """<html><head><title>t</title></head><body class="has-sidebar"><div id="header">Top <a href=x>a</a></div><nav><ul><li><a href=1>one</a></ul></nav>
<div class="content"><h2>Title &amp; x</h2><p>One two three four five, six seven.<br>Eight <a href=y>link</a> more&nbsp;text<p>Second paragraph of the article.</div>
<div class="comments"><p>a comment that is long enough to look like text, really</p></div><aside>side</aside><form>name <input></form><script>var p = "<p>";</script><footer>end</footer></body></html>"""


def test_html_text(spark):
    expected = "Title & x\n\nOne two three four five, six seven. Eight link more text\n\nSecond paragraph of the article."
    assert html_text.main_text(PAGE) == expected
    rows = spark.createDataFrame([(1, "u", PAGE, "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "plain &lt; text", "c")], "page_id long, url string, html string, id string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(rows).collect()}
    assert got == {1: (expected, len(expected)), 2: ("", 0), 3: ("", 0), 4: ("plain < text", 12)}


def test_html_articles_of_the_tables(spark, sf_dir):
    for r in html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        import html as h

        plain = h.unescape(re.sub("<[^>]+>", " ", inside))
        assert r.text.split() == plain.split()


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype("float32")
    x[700:760] = x[5]  # one very common vector
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] * 16, 0), (2004, [1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = {}
    for r in sorted(neighbours.nearest(vectors, F.col("id") % 50 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    d = x.astype(float)
    norm = np.sqrt((d**2).sum(axis=1))
    found = 0
    assert set(got) == set(range(0, 1500, 50))
    for q in got:
        cos = (d * d[q]).sum(axis=1) / (norm * norm[q])
        cos[q] = -2
        best = np.lexsort((np.arange(1500), -cos))[:5].tolist()
        found += len(set(best) & {i for i, _ in got[q]})
        assert all(abs(cos[i] - s) < 1e-12 for i, s in got[q])
        assert [i for i, _ in got[q]] == sorted((i for i, _ in got[q]), key=lambda i: (-cos[i], i))
    assert found >= 0.9 * 5 * len(got)


def test_empty_tables(spark):
    docs = table(spark, [])
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert sharding.minimax_shards(docs).count() == 0
    assert suffix_dedup.repeated_bytes(docs).count() == 0
    assert near_dedup.near_duplicates(docs).count() == 0
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert language_id.identify(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(vectors, F.col("id") % 50 == 0).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ranks_file():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert ranks[base64.b64decode("IQ==")] == 0
