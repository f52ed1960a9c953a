"""Removal of byte strings that occur more than once, by suffix arrays of candidate stretches.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else
in the corpus, judged on the input.

Candidates. The anchor of a string of ``length`` bytes is the place of its smallest
``ANCHOR``-byte hash. Strings that follow each other and share an anchor form a
segment, so equal strings lie in segments whose anchors have equal hashes, at the same
distance from them. Equal segments are counted, not carried along: all strings of a
segment that occurs twice are repeated. Where an anchor has several different segments,
one copy of each goes to a bucket, and is clipped there to the bytes on either side
of the anchor that it shares with any other one; shorter rests than ``length`` end here.
The strings around an anchor with more than ``BUCKET`` different segments (a licence line in
millions of pages) go to buckets by the bytes that they share on either side of it, closer and
closer to whole strings while a bucket is too large, so that no task gets them all.

Suffix array. What is left of a bucket is one string with a different separator after
each segment. Its suffixes are sorted in linear time by grouping: groups of suffixes
start as equal first symbols; from the highest to the lowest, each group moves the
suffixes that its members' previous-smaller pointers name behind the rest of their
groups, so that at the end a group has the suffixes of one Lyndon prefix. Each suffix
emitted in order then puts the suffixes whose Lyndon prefix ends before it at the
front of their groups. Nothing is renamed or sorted recursively. A string is repeated if
its suffix shares ``length`` bytes with a neighbour in the array.

Keys. A row is known by its identifier and a hash of its text together (row_key()), so that
identifiers may be null or stand for several texts: each text loses its own bytes.

Common anchors. What is known of an anchor is written before rows meet it, so that no aggregation
lies between the shuffle and the join and Spark's adaptive skew join can deal the rows of one
anchor to several tasks.

Defined results: null counts as empty; texts shorter than ``length`` bytes lose nothing;
matches never cross texts; repeated rows are judged as different rows and lose the same
bytes; null identifiers are identifiers like others; an empty table gives an empty
result. Further columns are ignored by repeated_bytes() and kept by drop_repeated().

Passages of words. With ``words``, only strings that hold so many whole words at both
places count; ``length`` is then a lower bound of their bytes. The runs of repeated bytes
are the candidates, and every stretch of ``words`` words inside them is counted in the
corpus, so that short matches with different texts do not add up to a long one. A word is a
run of characters without white space; a character of a script that is written without
spaces is a word of its own. Next to a passage, white space and the part of a word that
is repeated with it go too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm import bytehash
from larkspan.llm.staging import bounded_batches, discard, free_names, staged

LENGTH = 400
#: Bytes of an anchor; a third of short strings, so that there is a choice of places.
ANCHOR = 64
#: Different segments of an anchor that are sorted together at most (a segment has under 2 * length bytes).
BUCKET = 1024
#: Parts that the rows of a common passage are spread over.
RUNS = 64
#: Places of the anchor in the strings of a stretch of a common anchor's segments; each divides the one before.
WIDTHS = (64, 8, 1)
#: Texts whose rows leave Python as one frame; a frame for each text costs more than the work on a short one.
TEXTS = 200
#: Bytes of segments that leave Python as one frame, but for those of one text.
PART_BYTES = 1 << 22
#: Starts that are examined at once; the low bits of a composite hash hold the place among them.
BLOCK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: UTF-8 of white space, and of characters of scripts without spaces (Thai, Lao, Burmese, Khmer, kana, ideographs).
_SPACE = rb"[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_ALONE = rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xf0[\xa0-\xaf][\x80-\xbf]{2}"
WORD = re.compile(rb"(?:" + _ALONE + rb")|(?:[!-\x7f]|(?!" + _SPACE + rb"|" + _ALONE + rb")(?:[\x00-\x08\x0e-\x1b]|[\xc2-\xf4][\x80-\xbf]+))+")


def segments(data: np.ndarray, length: int) -> tuple[np.ndarray, ...] | None:
    """(anchor hash, digest, anchor's distance from the first start, first start, further starts) of the segments of a byte string."""
    if len(data) < length:
        return None
    out = []
    for at in range(0, len(data) - length + 1, BLOCK):
        out.append(_segments(data[at : at + BLOCK + length - 1], length, at))
    return tuple(np.concatenate(x) for x in zip(*out))


def _segments(data: np.ndarray, length: int, base: int) -> tuple[np.ndarray, ...]:
    running = bytehash.sums(data)
    anchor = min(ANCHOR, max(length // 3, 1))
    places = np.arange(len(data) - anchor + 1)
    hashes = bytehash.stretches(running, places, places + anchor)
    width = length - anchor + 1
    compound = (hashes & ~_PLACE) | places.astype(np.uint64)
    rows = np.append(compound, np.full(-len(compound) % width, ~np.uint64(0))).reshape(-1, width)
    # the minimum of any window is that of a block's end and of the next block's beginning
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], n) - 1
    place = place[first]
    digest = bytehash.mixed(bytehash.digests(data.tobytes(), first, last + length).view(np.uint64) + (place - first).astype(np.uint64))
    return hashes[place].view(np.int64), digest.view(np.int64), (place - first).astype(np.int32), (first + base).astype(np.int32), (last - first).astype(np.int32)


def grouped_suffix_array(symbols: list[int]) -> list[int]:
    """The suffix array of ``symbols`` by Lyndon groups; the end of the string is smaller than any symbol."""
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place = [0] * n
    group = [0] * n  # where the group of a suffix starts in ``order``
    size = [0] * n
    start = 0
    for k, s in enumerate(order):
        place[s] = k
        if k and symbols[s] != symbols[order[k - 1]]:
            start = k
        group[s] = start
        size[start] += 1
    previous = [-1] * n
    high = n
    while high > 0:
        low = group[order[high - 1]]
        members = order[low:high] if high - low == 1 else sorted(order[low:high])
        count: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            most = max(count.values())
            by_count = [list(count)] if most == 1 else [[p for p, c in count.items() if c == k] for k in range(most, 0, -1)]
            for same in by_count:
                moved: dict[int, int] = {}
                for p in same:
                    g = group[p]
                    m = moved[g] = moved.get(g, 0) + 1
                    to = g + size[g] - m
                    at = place[p]
                    if at != to:
                        q = order[to]
                        order[at], place[q] = q, at
                        order[to], place[p] = p, to
                for g, m in moved.items():
                    rest = size[g] - m
                    if rest:
                        new = g + rest
                        size[g], size[new] = rest, m
                        for k in range(new, new + m):
                            group[order[k]] = new
        high = low
    out = [-1] * n
    free = list(range(n))  # by a group's start: its next place
    placed = bytearray(n + 1)

    def emit(s: int) -> None:
        while s >= 0 and not placed[s]:
            placed[s] = 1
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = previous[s]

    emit(n - 1)
    for k in range(n):
        emit(out[k] - 1)
    return out


def shared_lengths(symbols: list[int], suffixes: list[int]) -> np.ndarray:
    """For each suffix the symbols it shares with the nearer of its neighbours in the array."""
    n = len(symbols)
    rank = [0] * n
    for k, s in enumerate(suffixes):
        rank[s] = k
    before = [0] * (n + 1)
    h = 0
    for s in range(n):
        k = rank[s]
        if k:
            t = suffixes[k - 1]
            top = n - max(s, t)
            while h < top and symbols[s + h] == symbols[t + h]:
                h += 1
            before[k] = h
            h = h - 1 if h else 0
        else:
            h = 0
    near = np.array(before)
    return np.maximum(near[:-1], near[1:])[np.array(rank, dtype=np.int64)]


def common(a: bytes, b: bytes) -> int:
    """Bytes that two strings share from the front."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax())


def clipped(parts: list[tuple[bytes, int]], length: int) -> list[tuple[int, int]]:
    """For segments (bytes, anchor offset): the stretch around the anchor that others share on either side."""
    reach = []
    for contexts in ([s[o:] for s, o in parts], [s[:o][::-1] for s, o in parts]):
        order = sorted(range(len(parts)), key=contexts.__getitem__)
        best = [0] * len(parts)
        for x, y in zip(order, order[1:]):
            n = common(contexts[x], contexts[y])
            best[x], best[y] = max(best[x], n), max(best[y], n)
        reach.append(best)
    return [(o - left, o + right) if left + right >= length else (0, 0) for (_, o), right, left in zip(parts, *reach)]


def repeated_starts(parts: list[tuple[bytes, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For the segments (bytes, anchor offset, copies) of a bucket: the runs [first, last] of repeated starts."""
    clips = clipped([(s, o) for s, o, _ in parts], length)
    texts: dict[bytes, list[int]] = {}
    for k, (lo, hi) in enumerate(clips):
        if hi - lo >= length:
            texts.setdefault(parts[k][0][lo:hi], []).append(k)
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    distinct = list(texts)
    sole = [len(texts[t]) == 1 and parts[texts[t][0]][2] == 1 for t in distinct]
    repeated: dict[bytes, np.ndarray] = {t: np.ones(len(t) - length + 1, dtype=bool) for t, one in zip(distinct, sole) if not one}
    if any(sole):
        symbols: list[int] = []
        for k, t in enumerate(distinct):
            symbols += [b + len(distinct) for b in t]
            symbols.append(k)
        shared = shared_lengths(symbols, grouped_suffix_array(symbols)) >= length
        at = 0
        for t, one in zip(distinct, sole):
            if one:
                repeated[t] = shared[at : at + len(t) - length + 1]
            at += len(t) + 1
    for t, hit in repeated.items():
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        runs = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))
        for k in texts[t]:
            out[k] = [(a + clips[k][0], b + clips[k][0]) for a, b in runs]
    return out


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """struct(k, h): what a row is known by, its identifier and a hash of its text (and of whether there is an identifier). Never null."""
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    k = F.coalesce(F.col(id_col).cast("long" if whole else "string"), F.lit(0).cast("long") if whole else F.lit(""))
    return F.struct(k.alias("k"), F.xxhash64(F.col(text_col).cast("string"), F.col(id_col).isNull()).alias("h"))


def key_kinds(rows: DataFrame) -> str:
    return f"k {rows.schema['id'].dataType['k'].dataType.simpleString()}, h long"


def beside_keys(texts: pd.DataFrame, names: list[str], found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    """What was found in each text, one below the other, beside the text's k and h."""
    rows = np.repeat(np.arange(len(texts)), [len(x[0]) for x in found])
    keys = {c: texts[c].to_numpy()[rows] for c in ("k", "h")}
    return pd.DataFrame(keys | dict(zip(names, map(np.concatenate, zip(*found)))))


def spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(id, spans): the runs [start, end) of bytes to remove, sorted, of each text (by its row_key()) that has any; a written table."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(row_key(docs, id_col, text_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("data")).filter(F.octet_length("data") >= length)

    names = ["anchor", "digest", "offset", "first", "more"]
    kinds = "anchor long, digest long, offset int, first int, more int"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), TEXTS):
                own = b.iloc[at : at + TEXTS]
                yield beside_keys(own, names, [segments(np.frombuffer(data, np.uint8), length) for data in own["data"]])

    found = rows.select("id.k", "id.h", "data").mapInPandas(find, f"{key_kinds(rows)}, {kinds}")
    everything = staged(found.select(F.struct("k", "h").alias("id"), *names), "segments")
    # an anchor that occurs once has nothing that repeats, which is so for most of them
    often = staged(everything.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors")
    found = staged(everything.join(often, "anchor", "left_semi"), "candidates")
    for table in (everything, often):
        discard(table)
    held = [found]  # tables that are needed until the runs are written
    distinct = found.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "offset", "first", "more")).alias("one"))
    by_anchor = staged(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("fewest")), "by-anchor")
    distinct = staged(distinct.join(by_anchor, "anchor").filter((F.col("copies") > 1) | (F.col("kinds") > 1)), "distinct")
    discard(by_anchor)
    held.append(distinct)
    whole = distinct.filter(F.col("copies") > 1).select("anchor", "digest", F.array(F.lit(0)).alias("begin"), F.array("one.more").alias("end"))
    unsure = distinct.filter((F.col("kinds") > 1) & (F.col("fewest") == 1)).select("one.*", "anchor", "digest", F.least("copies", F.lit(2)).cast("int").alias("copies"), "kinds")

    by_text = unsure.groupBy("id").agg(F.collect_list(F.struct(*names, "copies", "kinds")).alias("cuts"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["anchor", "digest", "copies", "kinds", "offset", "part"]
        for b in batches:
            out, size = [], 0
            for data, cuts in zip(b["data"], b["cuts"]):
                out += [(c["anchor"], c["digest"], c["copies"], c["kinds"], c["offset"], data[c["first"] : c["first"] + c["more"] + length]) for c in cuts]
                size += sum(c["more"] + length for c in cuts)
                if size >= PART_BYTES:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    parts = rows.join(by_text, "id").select("data", "cuts").mapInPandas(extract, "anchor long, digest long, copies int, kinds long, offset int, part binary")
    parts = staged(parts, "parts")  # read for rare and for common anchors, from one pass over the texts
    held.append(parts)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for anchor, own in zip(b["anchor"], b["parts"]):
                runs = repeated_starts([(bytes(p["part"]), p["offset"], p["copies"]) for p in own], length)
                out += [(anchor, p["digest"], [x for x, _ in r], [y for _, y in r]) for p, r in zip(own, runs) if r and p["copies"] == 1]
            yield pd.DataFrame(out, columns=["anchor", "digest", "begin", "end"])

    buckets = parts.filter(F.col("kinds") <= BUCKET).groupBy("anchor").agg(F.collect_list(F.struct("digest", "offset", "copies", "part")).alias("parts"))
    repeated = whole.unionByName(buckets.mapInPandas(sort, "anchor long, digest long, begin array<int>, end array<int>"))
    common = parts.filter(F.col("kinds") > BUCKET).drop("kinds")
    if not common.isEmpty():
        repeated = repeated.unionByName(common_runs(common, length, sort, held))
    runs = found.join(repeated, ["anchor", "digest"]).select("id", F.explode(F.arrays_zip("begin", "end")).alias("r"), "first")
    runs = runs.select("id", F.struct((F.col("first") + F.col("r.begin")).cast("long").alias("start"), (F.col("first") + F.col("r.end") + length).cast("long").alias("end")).alias("span"))
    runs = staged(runs.groupBy("id").agg(F.sort_array(F.collect_set("span")).alias("spans")), "spans")
    for table in held:
        discard(table)
    return runs


def slices(parts: DataFrame, length: int, width: int) -> DataFrame:
    """The strings of each segment with up to ``width`` different places of the anchor in them, stretch by stretch.

    ``key`` is a digest of the bytes that all strings of such a stretch have around the anchor,
    ``content`` one of the whole stretch.
    """
    anchor_bytes = min(ANCHOR, max(length // 3, 1))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for anchor, digest, copies, base, offset, part in zip(b["anchor"], b["digest"], b["copies"], b["base"], b["offset"], b["part"]):
                part = bytes(part)
                # a string that starts at s has the anchor offset - s bytes from its start
                least, most = max(0, offset - (len(part) - length)), min(offset, length - anchor_bytes)
                for low in range(least - least % width, most + 1, width):
                    high = min(low + width - 1, length - anchor_bytes)
                    first, last = offset - min(high, most), offset - max(low, least)
                    own = part[first : last + length]
                    around = part[offset - low : offset + length - high]
                    key = blake2b(around, digest_size=8, salt=low.to_bytes(8, "little"), person=int(anchor).to_bytes(8, "little", signed=True)).digest()
                    content = blake2b(own, digest_size=8, salt=(offset - first).to_bytes(8, "little")).digest()
                    out.append((anchor, digest, copies, base + first, offset - first, int.from_bytes(key, "little", signed=True), int.from_bytes(content, "little", signed=True), own))
            yield pd.DataFrame(out, columns=["anchor", "digest", "copies", "base", "offset", "key", "content", "part"])

    return staged(parts.mapInPandas(cut, "anchor long, digest long, copies int, base int, offset int, key long, content long, part binary"), "slices")


def common_runs(parts: DataFrame, length: int, sort, held: list[DataFrame]) -> DataFrame:
    """(anchor, digest, begin, end) of the repeated starts of segments whose anchor is too common for one bucket.

    Strings go by the bytes that they share around the anchor to buckets of their own; equal
    stretches are counted. Where a bucket is still too large, its stretches are cut finer,
    down to single strings, which need only be counted. The tables that the result reads are put into ``held``.
    """
    repeated = None
    parts = parts.withColumn("base", F.lit(0))
    for width in WIDTHS:
        own = slices(parts, length, width)
        kinds = own.groupBy("key", "content").agg(F.sum("copies").alias("same"), F.min("offset").alias("offset"), F.any_value("part").alias("part"))
        kinds = kinds.withColumn("run", F.pmod(F.xxhash64("content"), F.lit(RUNS)).cast("int"))
        # counts go up by (key, run) and come down the same way, so that the stretches of a common key are spread
        counts = kinds.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"))
        down = counts.select("key", "run").join(counts.groupBy("key").agg(F.sum("n").alias("kinds")), "key")
        kinds = staged(kinds.join(down, ["key", "run"]).filter("kinds > 1 OR same > 1").drop("run"), "kinds")
        held += [own, kinds]
        members = own.filter("copies = 1").select("anchor", "digest", "base", "key", "content", (F.octet_length("part") - length).alias("more"))
        whole = members.join(kinds.filter("same > 1").select("key", "content"), ["key", "content"])
        found = whole.select("anchor", "digest", F.array("base").alias("begin"), F.array(F.col("base") + F.col("more")).alias("end"))
        repeated = found if repeated is None else repeated.unionByName(found)
        if width == 1:
            break
        few = kinds.filter(F.col("kinds").between(2, BUCKET)).withColumn("copies", F.least("same", F.lit(2)).cast("int"))
        buckets = few.select(F.col("key").alias("anchor"), "content", "offset", "copies", "part").groupBy("anchor").agg(F.collect_list(F.struct(F.col("content").alias("digest"), "offset", "copies", "part")).alias("parts"))
        runs = buckets.mapInPandas(sort, "anchor long, digest long, begin array<int>, end array<int>").select(F.col("anchor").alias("key"), F.col("digest").alias("content"), "begin", "end")
        moved = lambda c: F.transform(c, lambda x: x + F.col("base")).alias(c)
        repeated = repeated.unionByName(members.join(runs, ["key", "content"]).select("anchor", "digest", moved("begin"), moved("end")))
        many = kinds.filter(F.col("kinds") > BUCKET).withColumn("times", F.least("same", F.lit(2)).cast("int"))
        if many.isEmpty():
            break
        # one row of each stretch that occurs twice stands for the others
        first = F.min_by(F.struct("anchor", "digest", "base"), F.struct("digest", "base"))
        of = own.groupBy("key", "content").agg(first.alias("one")).select("key", "content", "one.*")
        parts = many.join(of, ["key", "content"]).select("anchor", "digest", F.col("times").alias("copies"), "base", "offset", "part")
    return repeated


def merged(found: list) -> list[tuple[int, int]]:
    """Sorted, possibly overlapping runs as runs that are apart."""
    out: list[list[int]] = []
    for r in found:
        if out and r["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["end"])
        else:
            out.append([r["start"], r["end"]])
    return [(a, b) for a, b in out]


def passages(data: bytes, runs: list[tuple[int, int]], words: int) -> tuple[np.ndarray, ...]:
    """(hash, start, end) of each stretch of ``words`` whole words in the runs; start and end take in what the run has of the white space and the cut words beside it."""
    out = []
    for a, b in runs:
        low = data.rfind(b" ", 0, a) + 1
        high = data.find(b" ", b)
        found = [m.span() for m in WORD.finditer(data, low, len(data) if high < 0 else high)]
        inside = [k for k, (x, y) in enumerate(found) if x >= a and y <= b]
        if len(inside) < words:
            continue
        ends = np.array([found[k] for k in inside])
        first, last = ends[: len(ends) - words + 1, 0], ends[words - 1 :, 1]
        # up to the word before and after, or to the run's end where it cuts that word
        before = np.concatenate(([a], ends[: len(first) - 1, 1]))
        after = np.concatenate((ends[words:, 0], [b]))
        out.append((bytehash.digests(data, first, last), before, after))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def word_spans(docs: DataFrame, id_col: str, text_col: str, length: int, words: int) -> DataFrame:
    """spans() of the strings that hold ``words`` whole words at both places."""
    runs = spans(docs, id_col, text_col, length)
    rows = docs.select(row_key(docs, id_col, text_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("data")).join(runs, "id")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), TEXTS):
                own = b.iloc[at : at + TEXTS]
                yield beside_keys(own, ["hash", "start", "end"], [passages(bytes(data), merged(s), words) for data, s in zip(own["data"], own["spans"])])

    found = rows.select("id.k", "id.h", "data", "spans").mapInPandas(find, f"{key_kinds(rows)}, hash long, start int, end int")
    found = staged(found.select(F.struct("k", "h").alias("id"), "hash", "start", "end"), "passages").withColumn("run", F.pmod(F.xxhash64("id"), F.lit(RUNS)).cast("int"))
    # counts go up by (hash, run) and come down the same way, so that a common passage is spread
    counts = found.groupBy("hash", "run").agg(F.count(F.lit(1)).alias("n"))
    often = counts.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash")
    down = counts.join(often, "hash", "left_semi").select("hash", "run")
    kept = found.join(down, ["hash", "run"], "left_semi").select("id", F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("span"))
    return kept.groupBy("id").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def without(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in gone:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256, removed (array of [start, end) in bytes), text.

    ``text`` is what is left; a character cut in two goes entirely.
    """
    found = spans(docs, id_col, text_col, length)
    rows = docs.select(F.col(id_col).cast("string").alias("key"), row_key(docs, id_col, text_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "text"]
        for b in batches:
            out = []
            for key, data, own in zip(b["key"], b["data"], b["spans"]):
                gone = merged(own) if own is not None else []
                n = sum(y - x for x, y in gone)
                left = without(data, gone) if gone else bytes(data)
                out.append((key, len(data), n, len(gone), hashlib.sha256(left).hexdigest(), [list(r) for r in gone], left.decode("utf-8", "ignore")))
            yield pd.DataFrame(out, columns=names)

    kinds = "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>, text string"
    # identifiers pass Python as text: beside a null, pandas would make numbers inexact
    out = rows.join(found, "id", "left").select("key", "data", "spans").mapInPandas(cut, kinds)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = 0) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the texts; a character cut in two goes entirely. All columns stay.

    With ``words`` only strings of so many whole words count.
    """
    found = word_spans(docs, id_col, text_col, length, words) if words else spans(docs, id_col, text_col, length)
    key, own_spans = free_names(docs, "key", "spans")
    found = found.withColumnsRenamed({"id": key, "spans": own_spans})

    @F.pandas_udf("string")
    def cut(texts: pd.Series, own: pd.Series) -> pd.Series:
        out = [t if s is None or t is None else without(t.encode(), merged(s)).decode("utf-8", "ignore") for t, s in zip(texts, own)]
        return pd.Series(out, dtype=object)

    joined = docs.join(found, row_key(docs, id_col, text_col) == found[key], "left")
    cut_text = F.when(F.col(own_spans).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(own_spans)))
    return joined.withColumn(text_col, cut_text).select(*docs.columns)
