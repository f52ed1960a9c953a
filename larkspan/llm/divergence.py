"""Source divergence audit: how far the sources of a language are apart in their use of terms.

Terms are runs of letters A to Z and of bytes beyond ASCII, only A to Z lower-cased. A language
keeps the terms that at least ``least_docs`` of its documents have. A group is a source within
a language; it gives every kept term the smoothed integer probability

    1 + floor(UNIT * (count + PSEUDO) / (N + PSEUDO * V))

with N the group's occurrences of kept terms and V their number. Two groups are as far apart
as the absolute differences of these add up to over all kept terms; a group's own terms are
those it gives more than the whole language does.

Counts are added up in tasks before anything is shuffled. A language's kept terms are dealt to
blocks of about ``BLOCK`` terms, its groups to slices of about ``SLICE`` groups; a cell is a block
and a pair of slices. A cell holds dense int64 group-by-term tiles of both slices, and broadcasts
each group of one against all of the other. Partial pair sums of the cells are added up by a
grouped sum, and the cells' ``top`` terms of each group (a heap of a cell) merge by rank. A cell is
bounded by the parameters, however many documents a group has, so a hot source weighs no more
than another; rows meet by language only in a table of one row a language.

Defined results: null text, language and source count as empty strings; a group without terms is
a group still, with every count 0; a language without kept terms has pair values of 0 and no
terms; a lone source has no pairs. Repeated rows count as documents of their own.
Further columns are ignored; an empty table gives an empty result. All arithmetic is exact
(64 bits) up to 9e15 occurrences a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.staging import bounded_batches, discard, staged

UNIT_STEPS = 3  # UNIT = 1000 ** 3
PSEUDO = 5
BLOCK = 1024
SLICE = 256
#: Entries of a task's table of counts and documents in it, before it is handed on.
HELD = 1 << 19
#: One document, and above it nothing but documents: below are occurrences, of which a task has fewer than bytes.
DOC_BITS = 40
DOC = 1 << DOC_BITS
#: Languages whose facts are broadcast; beyond, they are joined by shuffle.
SMALL_LANGS = 10_000
#: What each byte of a text becomes: A to Z small, other letters and bytes beyond ASCII as they are, the rest a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def count_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with an empty term for every group."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in held.items():
                both = np.fromiter(own.values(), np.int64, len(own))
                rows = [pa.repeat(lang, len(own)), pa.repeat(source, len(own)), pa.array(own, pa.binary()), pa.array(both & (DOC - 1)), pa.array(both >> DOC_BITS)]
                yield pa.RecordBatch.from_arrays(rows, ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns)):
                own = held.setdefault((lang, source), {b"": 0})
                before = len(own)
                for term, n in Counter(terms_of(text)).items():
                    own[term] = own.get(term, 0) + n + DOC
                size += len(own) - before + 1
                if size >= HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(text_col).cast("binary").alias("t"), whole(lang_col).alias("lang"), whole(source_col).alias("source"))
    parts = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probabilities(counts: np.ndarray, occurrences: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PSEUDO) / (N + PSEUDO * V)): a long division by thousands, so that nothing leaves 64 bits."""
    part = np.asarray(counts, dtype=np.int64) + PSEUDO
    whole = np.asarray(occurrences, dtype=np.int64) + np.int64(PSEUDO * kept)
    out, part = part // whole, part % whole
    for _ in range(UNIT_STEPS):
        part = part * 1000
        out, part = out * 1000 + part // whole, part % whole
    return out + 1


def pair_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sum over terms of absolute differences, every row of ``left`` broadcast against all of ``right``."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for k, row in enumerate(left):
        np.abs(right - row).sum(axis=1, out=out[k])
    return out


def heap_of(values: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest values above 0, the first of equal ones first."""
    at = np.flatnonzero(values > 0)
    return at[np.lexsort((at, -values[at]))[:top]]


def cell(key: tuple, rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """Partial pair sums and heaps of one block of terms and a pair of slices of groups."""
    lang, _, a, b = key
    heads = rows[rows["head"]]
    kept, lang_n = int(heads["kept"].iloc[0]), int(heads["lang_n"].iloc[0])
    found = rows[~rows["head"]]
    terms, column = np.unique(found["term"].to_numpy(dtype=object), return_inverse=True)
    names, counts, given = {}, {}, {}
    for s in {a, b}:
        own = heads[heads["slice"] == s]
        names[s] = own["source"].to_numpy(dtype=object)
        place = {name: k for k, name in enumerate(names[s])}
        here = (found["slice"] == s).to_numpy()
        counts[s] = np.zeros((len(own), len(terms)), dtype=np.int64)
        counts[s][found["source"][here].map(place).to_numpy(dtype=int), column[here]] = found["n"][here]
        given[s] = probabilities(counts[s], own["n"].to_numpy(dtype=np.int64)[:, None], kept)

    sums = pair_sums(given[a], given[b])
    i, j = (~np.eye(len(sums), dtype=bool)).nonzero() if a == b else np.indices(sums.shape).reshape(2, -1)
    one, other, value = names[a][i], names[b][j], sums[i, j]
    if a != b:  # both ways
        one, other, value = np.concatenate((one, other)), np.concatenate((other, one)), np.concatenate((value, value))
    out = [pd.DataFrame({"part": "pair", "lang": lang, "source": one, "item": [x.encode() for x in other], "value": value})]
    if a == b:
        totals = np.zeros(len(terms), dtype=np.int64)
        totals[column] = found["total"]
        usual = probabilities(totals, lang_n, kept)
        for name, own, p in zip(names[a], counts[a], given[a]):
            more = np.where(own > 0, p - usual, 0)
            best = heap_of(more, top)
            out.append(pd.DataFrame({"part": "term", "lang": lang, "source": name, "item": terms[best], "value": more[best]}))
    return pd.concat(out)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank (from 1 a group and part)."""
    counts = staged(count_terms(docs, text_col, lang_col, source_col), "counts")
    used = F.length("term") > 0
    kept = counts.filter(used).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    found = staged(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-counts")

    # one row a group, then one a language
    by_group = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.filter(~used).select("lang", "source").join(by_group, ["lang", "source"], "left").fillna(0, ["n"])
    per_lang = found.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(per_lang, "lang", "left").fillna(0, ["kept", "lang_n"])
    langs = langs.withColumns(
        {"blocks": F.greatest(F.ceil(F.col("kept") / BLOCK), F.lit(1)).cast("int"), "slices": F.ceil(F.col("groups") / SLICE).cast("int")}
    )
    langs = staged(langs, "langs")
    known = F.broadcast(langs) if langs.count() <= SMALL_LANGS else langs

    # rows and headers go to the cells of their block and of their slice with every slice
    own_slice = F.pmod(F.xxhash64("source"), F.col("slices")).cast("int").alias("slice")
    items = found.join(known, "lang").select(
        "lang", "source", "term", "n", "total", own_slice, "slices", "kept", "lang_n",
        F.pmod(F.xxhash64(F.lit(3), "term"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("head"),
    )
    heads = groups.join(known, "lang").select(
        "lang", "source", F.lit(None).cast("binary").alias("term"), "n", F.lit(0).cast("long").alias("total"), own_slice, "slices", "kept", "lang_n",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("head"),
    )
    rows = items.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.withColumns({"a": F.least("slice", "other"), "b": F.greatest("slice", "other")}).drop("other", "slices")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return cell(key, part, top)

    cells = staged(rows.groupBy("lang", "block", "a", "b").applyInPandas(run, "part string, lang string, source string, item binary, value long"), "cells")
    discard(counts)
    discard(found)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = cells.filter("part = 'pair'").groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = cells.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    both = pairs.unionByName(terms)
    return both.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", F.col("rank").cast("int").alias("rank"))
