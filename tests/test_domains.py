"""List tables, public suffixes, lookalikes and the wording automaton against brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.operators import domains, joins, wording

LETTERS = "abcde"


def names(rng, n, low=2, high=12):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def some_hosts(rng, n):
    ends = ["com", "net", "co.uk", "shop"]
    return [".".join([*names(rng, rng.randrange(1, 4), 1, 9), rng.choice(ends)]) for _ in range(n)]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def column(spark, values, name="host"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("most", [joins.BROADCAST_ROWS, 0])
def test_list_table_of_fifty_thousand(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    entries = {h: (f"k{k % 3}", k) for k, h in enumerate({*some_hosts(rng, 52_000), "com", "Upper.Case.NET.".lower().rstrip(".")})}
    hosts = some_hosts(rng, 3000) + [f"w.{h}" for h in rng.sample(sorted(entries), 300)] + ["A.Upper.CASE.net.", "hot.com"] + ["hot.com"] * 50 + [None, "", "."]
    table = spark.createDataFrame([(d, kind, n) for d, (kind, n) in entries.items()], "domain string, kind string, n int")
    rows = spark.createDataFrame(list(enumerate(hosts)), "id long, host string")
    joined = domains.with_listed(rows, table)
    found = {r.id: (r.domain, r.kind, r.n) for r in joined.collect()}
    assert len(found) == len(hosts)
    for k, h in enumerate(hosts):
        own = (h or "").lower().strip().rstrip(".")
        labels = own.split(".")
        best = next((d for d in (".".join(labels[i:]) for i in range(len(labels))) if d in entries), None)
        assert found[k] == ((best, *entries[best]) if best else (None, None, None))
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)


def test_lists_by_kind_below_repeated_and_empty(spark):
    table = spark.createDataFrame([("a.com", "x", 1), ("A.com.", "x", 2), ("b.a.com", "x", 0), ("com", "y", 5), (None, "y", 1), ("", "y", 1)], "domain string, kind string, n int")
    hosts = column(spark, ["b.a.com", "c.b.a.com", "a.com", "com", "d.org"])
    get = lambda **kw: sorted((r.host, r.domain, r.kind, r.n) for r in domains.listed(hosts, table, **kw).collect())
    assert get(by=("kind",)) == [
        ("a.com", "a.com", "x", 2), ("a.com", "com", "y", 5), ("b.a.com", "b.a.com", "x", 0), ("b.a.com", "com", "y", 5),
        ("c.b.a.com", "b.a.com", "x", 0), ("c.b.a.com", "com", "y", 5), ("com", "com", "y", 5),
    ]
    assert get(itself=False) == [("a.com", "com", "y", 5), ("b.a.com", "a.com", "x", 2), ("c.b.a.com", "b.a.com", "x", 0)]
    assert domains.listed(hosts, table.limit(0)).collect() == []
    assert [r.domain for r in domains.with_listed(hosts, table.limit(0)).collect()] == [None] * 5


@pytest.mark.parametrize(
    ("host", "suffix", "registered"),
    [
        ("www.example.com", "com", "example.com"),
        ("Example.COM.", "com", "example.com"),
        ("com", "com", "com"),
        ("a.b.co.uk", "co.uk", "b.co.uk"),
        ("b.c.ck", "c.ck", "b.c.ck"),
        ("a.b.c.ck", "c.ck", "b.c.ck"),
        ("c.ck", "c.ck", "c.ck"),
        ("ck", "", "ck"),
        ("www.ck", "ck", "www.ck"),
        ("a.www.ck", "ck", "www.ck"),
        ("a.公司.cn", "公司.cn", "a.公司.cn"),
        ("x.a.xn--55qx5d.cn", "xn--55qx5d.cn", "a.xn--55qx5d.cn"),
        ("localhost", "", "localhost"),
        ("a.b.unlisted", "", "a.b.unlisted"),
        ("10.0.0.1", "", "10.0.0.1"),
    ],
)
def test_public_suffix(spark, host, suffix, registered):
    rules = column(spark, ["// note", "", None, "com", "uk", "co.uk", "*.ck", "!www.ck", "cn", "公司.cn"], "rule")
    got = domains.public_suffixes(column(spark, [host, host, None, ""]), rules).collect()
    assert [(r.suffix, r.registered) for r in got] == [(suffix, registered)]


def test_public_suffix_default_rule(spark):
    hosts = column(spark, ["localhost", "a.b.unlisted", "ck", "10.0.0.1"])
    got = {r.host: (r.suffix, r.registered) for r in domains.public_suffixes(hosts, column(spark, ["*.ck"], "rule"), default=True).collect()}
    assert got == {"localhost": ("localhost", "localhost"), "a.b.unlisted": ("unlisted", "b.unlisted"), "ck": ("ck", "ck"), "10.0.0.1": ("", "10.0.0.1")}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def mutated(rng, word):
    for _ in range(rng.randrange(0, 4)):
        k = rng.randrange(len(word) + 1)
        word = rng.choice((word[:k] + rng.choice(LETTERS) + word[k:], word[:k] + word[k + 1 :], word[:k] + rng.choice(LETTERS) + word[k + 1 :]))
    return word


@pytest.mark.parametrize("most", [joins.BROADCAST_ROWS, 0])
def test_one_letter_off_and_alike(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
    rng = random.Random(9)
    theirs = sorted({*names(rng, 60, 1, 30), "aaaaaaaaaaaa", "", "a", "ab"})
    mine = sorted({mutated(rng, rng.choice(theirs)) for _ in range(200)} | {*names(rng, 40, 1, 20), "aaaaaaaaaaa", "", "a", "ab"})
    a, b = column(spark, [*mine, None, mine[0]]), column(spark, [*theirs, None, theirs[0]])
    far = {(x, y): edits(x, y) for x in mine for y in theirs}
    got = [tuple(r) for r in domains.one_letter_off(a, b).collect()]
    assert sorted(got) == sorted(p for p, d in far.items() if d == 1)
    pairs = domains.alike(a, b)
    got = [tuple(r) for r in pairs.collect()]
    assert sorted(got) == sorted((x, y) for (x, y), d in far.items() if (1 - d / max(len(x), len(y), 1)) >= 0.85)
    assert len(got) > 20
    for df in (pairs, domains.one_letter_off(a, b)):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)


def test_lookalikes_equal_the_comparison_of_all_with_all(spark):
    rng = random.Random(12)
    official = [f"{w}.com" for w in dict.fromkeys(names(rng, 25, 3, 11))]
    core = lambda h: h.split(".")[-2] if "." in h else h
    hosts = {f"{mutated(rng, core(rng.choice(official)))}.{rng.choice(('com', 'net'))}" for _ in range(150)}
    hosts |= {f"{rng.choice(('www', core(rng.choice(official))))}.{h}" for h in list(hosts)[:60]} | {official[0], f"x.{official[1]}", ".com", "com"}
    rules = column(spark, ["com", "net"], "rule")
    table = spark.createDataFrame([(d, k) for k, d in enumerate(official)] + [(official[3].upper(), 99)], "domain string, ord int")
    got = {r.host: (r.domain, r.confidence) for r in domains.lookalikes(column(spark, [*hosts, None]), table, rules).collect()}
    want = {}
    for h in hosts:
        if any(h == d or h.endswith("." + d) for d in official):
            continue
        labels = h.split(".")
        reg = ".".join(labels[-2:]) if len(labels) > 1 else h
        for d in official:
            label, c = reg.split(".")[0], core(d)
            sure = 0.9 if len(label) <= 8 and edits(label, c) == 1 else 0.85 if 1 - edits(reg, d) / max(len(reg), len(d)) >= 0.85 else 0.8 if c in h else None
            if sure:
                want[h] = (d, sure)
                break
    assert got == want and {s for _, s in got.values()} == {0.9, 0.85, 0.8}


def brute_occurrences(text, words):
    """By the regex form: every start of the word with anything invisible between its letters."""
    out = set()
    low = wording.folded(text)
    for rule, word in words:
        for m in re.finditer(f"(?=({T.spread(wording.folded(word))}))", low):
            out.add((rule, word, m.start(1), m.end(1)))
    return out


@pytest.mark.parametrize("most", [wording.MOST_CHARACTERS, 40])
def test_automaton_equals_regular_expressions(spark, monkeypatch, most):
    monkeypatch.setattr(wording, "MOST_CHARACTERS", most)
    rng = random.Random(2)
    words = [(f"r{k % 4}", w) for k, w in enumerate({*names(rng, 30, 1, 5), "a b", "ab\tc", "b  a", "日本", "é", "aa"})] + [("r9", "ab"), ("r8", "ab")]
    glue = ["", "", "", " ", "​", "\n", "　", "­", ".", "X"]
    texts = ["".join(rng.choice("abcdeABÉ日本") + rng.choice(glue) for _ in range(rng.randrange(0, 80))) for _ in range(120)] + ["", None, "aaaa", "a b", "İab", " ", "ab" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([*words, words[0], (None, "a"), ("r", None), ("r", " "), ("r", "")], "rule string, word string")
    found = wording.occurrences(rows, table).collect()
    got = {(r.id, r.rule, r.word, r.start, r.end) for r in found}
    assert len(got) == len(found)
    assert got == {(k, *x) for k, t in enumerate(texts) if t for x in brute_occurrences(t, words)}
    counted = {(r.id, r.rule): (r.n, r["first"]) for r in wording.hits(rows, table).collect()}
    for key, (n, first) in counted.items():
        own = [x for x in got if x[:2] == key]
        assert (n, first) == (len(own), min(x[3] for x in own))


def test_time_does_not_grow_with_the_words():
    rng = random.Random(1)
    text = " ".join(names(rng, 30_000, 2, 9))
    took = {}
    for n in (10, 10_000):
        own = wording.Automaton([("r", "z" + w) for w in names(rng, n, 6, 14)])
        own.find(text)
        began = time.process_time()
        own.find(text)
        took[n] = time.process_time() - began
    assert took[10_000] < 5 * took[10] + 0.05
