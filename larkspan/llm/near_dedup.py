"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles, hashed to 64 bits from cryptographic hashes of
their words. Documents with equal sets are one from here on. In each of a number of
independent trees a document follows a path of tokens of its set: at each level the one that
is smallest under the level's hash. Documents that chose the same token stand in one node. A
node of at most ``SMALL`` documents is compared as a whole; a larger one branches by the next
level, at most ``LEVELS`` deep, where any node is compared. Two sets of similarity s meet
in a tree with probability s**depth at least; the number of trees follows from the similarity
asked for, so that a link at the threshold whose nodes are all large is missed with a probability
of 1 - ``RECALL`` (0.001: 10 trees for 0.85, 14 for 0.8), and far less in small nodes.

In a node, documents whose minwise tokens agree with no other one's in enough places leave.
The others' whole texts come to the node, every different word gets a number there, and the
full sets of shingles are compared exactly, as sequences of words, by a search that starts at a
document, finds all it has links to among those not yet reached, and goes on from these, so
that groups of copies cost about as much as their size. A node gives each document reached
the smallest one of its group; components of these links are the answer.

A node of more than ``BLOCK`` documents at the last level is dealt to blocks. Each block is
compared together with a few pivots of the whole node, which joins the blocks of a group of
copies. Documents of the node that are not in its largest component then are compared with
all of its blocks, so that no link is lost; no task holds more than two blocks.

Defined results: null texts and texts without words have an empty set and no link; texts
with fewer words than a shingle have one shingle, the whole sequence; repeated rows are
equal sets; equal identifiers share a component; an empty table gives an empty
result. Further columns are ignored by near_duplicates() and kept by drop_near_duplicates().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import bytehash, exact_dedup
from larkspan.llm.components import connected_components
from larkspan.llm.staging import bounded_batches, free_names, staged

RECALL = 0.999
LEVELS = 4
SMALL = 64
BLOCK = 512
PIVOTS = 4
WORDS = 5
SIMILARITY = 80
#: Bits of the map of wanted documents that every task gets (8 MB).
MARKS = 1 << 26
#: Words whose hashes a Python process remembers.
REMEMBERED = 1 << 19


def trees(percent: int, recall: float = RECALL) -> int:
    """Trees for which a link at the threshold meets at the last level of one with probability ``recall``."""
    meet = (percent / 100) ** LEVELS
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def least_agreeing(places: int, percent: int, missed: float = 1e-6) -> int:
    """The number of ``places`` that two sets at the threshold agree in but for a chance of ``missed``."""
    s, below = percent / 100, 0.0
    for k in range(places + 1):
        below += math.comb(places, k) * s**k * (1 - s) ** (places - k)
        if below > missed:
            return max(1, k)
    return places


def level_hashes(places: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(7))
    return random.integers(0, 1 << 63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, places, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


_HASHES = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words apart by space, tab, line feed, vertical tab, form feed and carriage return; A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a whole text."""
    own = words_of(text)
    if not own:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, own), np.uint64, len(own))
    n = min(words, len(hashes))
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = bytehash.mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k] + np.uint64(n))
    return np.unique(total)


def exact_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The shingles of each text as numbers that are equal only for equal sequences of words."""
    number: dict[bytes, int] = {b"": 0}
    lists = []
    for text in texts:
        own = words_of(text)
        own += [b""] * (words - len(own))  # no word is empty, so a short text equals no part of a longer one
        lists.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)))
    flat = np.concatenate(lists)
    n = len(flat) - words + 1
    code, width = flat[:n], len(number)
    for k in range(1, words):
        if width * len(number) >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            width = int(code.max()) + 1
        code = code * len(number) + flat[k : n + k]
        width *= len(number)
    begin = np.cumsum([0] + [len(x) for x in lists])
    return [np.unique(code[b : b + len(x) - words + 1]) for b, x in zip(begin.tolist(), lists)]


def minwise(tokens: np.ndarray, factors: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """The token of a set that is smallest under each of the trees' level hashes."""
    out = np.empty(len(factors), dtype=np.uint64)
    for k, (a, b) in enumerate(zip(factors, addends)):
        h = (tokens ^ b) * a
        out[k] = tokens[(h ^ (h >> np.uint64(29))).argmin()]
    return out


def groups_of(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first one of its group; groups are linked by 100 * intersection >= percent * union."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    bounds = np.append(0, np.cumsum(sizes))
    root = np.full(m, -1)

    def postings(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = np.flatnonzero(left[owner])
        order = use[np.argsort(inverse[use], kind="stable")]
        return owner[order], np.searchsorted(inverse[order], np.arange(len(tokens) + 1))

    left = np.ones(m, dtype=bool)
    lists, starts = postings(left)
    built = m
    for first in range(m):
        if root[first] >= 0:
            continue
        queue = [first]
        root[first], left[first] = first, False
        while queue:
            k = queue.pop()
            if not left.any():
                break
            if 2 * left.sum() < built:
                lists, starts = postings(left)
                built = int(left.sum())
            own = inverse[bounds[k] : bounds[k + 1]]
            begin, n = starts[own], starts[own + 1] - starts[own]
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(lists[at], minlength=m)
            hit = np.flatnonzero(left & (100 * shared >= percent * (sizes[k] + sizes - shared)))
            root[hit], left[hit] = first, False
            queue += hit.tolist()
    return root.tolist()


def live(sketches: np.ndarray, least: int) -> np.ndarray:
    """Which rows agree with some other row in ``least`` places."""
    m = len(sketches)
    out = np.zeros(m, dtype=bool)
    step = max(1, (1 << 22) // max(1, m * sketches.shape[1]))
    for at in range(0, m, step):
        agree = (sketches[at : at + step, None, :] == sketches[None, :, :]).sum(axis=2)
        agree[np.arange(len(agree)), np.arange(at, at + len(agree))] = 0
        out[at : at + step] = (agree >= least).any(axis=1)
    return out


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids`` and a few others, found without a shuffle of ``rows`` by a map of hashed bits."""
    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS)).alias("mark")
    own = ids.select(mark).withColumn("bucket", F.bitmap_bucket_number("mark")).repartition("bucket")
    maps = own.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits"))
    met = rows.select("*", mark).withColumn("bucket", F.bitmap_bucket_number("mark")).join(F.broadcast(maps), "bucket")
    byte = "cast(conv(hex(substring(bits, cast(bitmap_bit_position(mark) div 8 as int) + 1, 1)), 16, 10) as int)"
    return met.filter(F.expr(f"getbit({byte}, cast(bitmap_bit_position(mark) % 8 as int)) = 1")).select(*rows.columns)


def compared(nodes: DataFrame, reps: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): for the members of each node (node, id) the smallest one of their group, where that is another."""
    least = least_agreeing(trees(percent) * LEVELS, percent)
    members = nodes.join(reps.select("id", "sketch"), "id").groupBy("node").agg(F.collect_list(F.struct("id", "sketch")).alias("m"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for own in b["m"]:
                ids = np.array([x["id"] for x in own], dtype=np.int64)
                sketches = np.frombuffer(b"".join(bytes(x["sketch"]) for x in own), np.uint16).reshape(len(ids), -1)
                ids = ids[live(sketches, least)]
                if len(ids) > 1:
                    out.append(np.sort(ids))
            yield pd.DataFrame({"ids": out})

    # different trees often have the same group in a node: it is compared once
    chosen = members.mapInPandas(choose, "ids array<long>").distinct().withColumn("node", F.xxhash64("ids"))
    wanted = staged(chosen.select("node", F.explode("ids").alias("id")), "wanted")
    texts = marked(rows, wanted).join(wanted.groupBy("id").agg(F.collect_list("node").alias("nodes")), "id").dropDuplicates(["id"])
    met = texts.select("id", "t", F.explode("nodes").alias("node"))

    def compare(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id")
        ids = b["id"].to_numpy()
        roots = groups_of(exact_sets(b["t"].tolist(), words), percent)
        return pd.DataFrame({"a": ids, "b": ids[roots]})

    return met.groupBy("node").applyInPandas(compare, "a long, b long").filter("a <> b").distinct()


def in_blocks(large: DataFrame) -> DataFrame:
    """(node, id): the blocks of large nodes (node, id, blocks), each with the pivots of its node."""
    pivots = large.groupBy("node", "blocks").agg(F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(PIVOTS)])).alias("ids"))
    everywhere = pivots.select("node", F.explode("ids").alias("id"), "blocks").select("node", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = large.select("node", "id", block_of("blocks").alias("block"))
    return own.unionByName(everywhere).select(F.xxhash64("node", "block").alias("node"), "id").distinct()


def block_of(blocks: str):
    return F.pmod(F.xxhash64("id", "node"), F.col(blocks)).cast("int")


def across_blocks(large: DataFrame, components: DataFrame) -> DataFrame:
    """(node, id): members outside the largest component of their node, met with each of its blocks."""
    at = large.join(components, "id", "left").select("node", "id", "blocks", F.coalesce("component_id", "id").alias("own"))
    counts = at.groupBy("node", "own").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("node").agg(F.max_by("own", F.struct("n", "own")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0")
    at = at.join(main.withColumn("deals", F.ceil(F.col("others") / BLOCK).cast("int")), "node")
    rest = at.filter("own <> main").select("node", "id", block_of("deals").alias("deal"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    all_ = at.select("node", "id", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), block_of("blocks").alias("block"))
    return rest.unionByName(all_).select(F.xxhash64("node", "deal", "block").alias("node"), "id").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept (id_col = component_id)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    n_trees = trees(percent)
    factors, addends = level_hashes(n_trees * LEVELS)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "n", "digest", "check", "paths", "sketch"]
        for b in batches:
            out = []
            for key, text in zip(b["id"], b["t"]):
                s = shingles(text, words)
                if not len(s):
                    out.append((key, 0, b"", 0, None, None))
                    continue
                low = minwise(s, factors, addends)
                two = np.array([bytehash.mixed(s).sum(), bytehash.mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()])
                check = bytehash.mixed(s + np.uint64(0x1234567)).sum()
                out.append((key, len(s), two.tobytes(), int(np.int64(check.astype(np.int64))), low.view(np.int64), low.astype(np.uint16).tobytes()))
            yield pd.DataFrame(out, columns=names)

    kinds = "id long, n long, digest binary, check long, paths array<long>, sketch binary"
    sets = staged(rows.mapInPandas(sketch, kinds), "sets")
    keyed = sets.select(
        "id", F.pmod(F.xxhash64("id"), F.lit(exact_dedup.N_RUNS)).cast("int").alias("run"), "digest", "check", F.col("n").alias("n_bytes")
    )
    same = staged(exact_dedup.groups(keyed).select("id", F.when(F.col("n_bytes") == 0, F.col("id")).otherwise(F.col("keep_id")).alias("rep"), F.col("n_bytes").alias("n")), "same")

    # one row for each set: a repeated identifier repeats its row
    reps = sets.join(same.filter("id = rep and n > 0").select("id").distinct(), "id").dropDuplicates(["id"])
    reps = staged(reps.select("id", "paths", "sketch"), "reps")
    at = reps.select("id", "paths", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    at = at.select("id", "tree", F.slice("paths", F.col("tree") * LEVELS + 1, LEVELS).alias("path"), F.col("tree").cast("long").alias("node"))
    nodes = None
    for level in range(LEVELS):
        at = at.withColumn("node", F.xxhash64("node", F.lit(level), F.col("path")[level]))
        sizes = at.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        met = at.join(sizes, "node")
        bound = SMALL if level < LEVELS - 1 else BLOCK
        here = met.filter(F.col("size") <= bound).select("node", "id")
        nodes = here if nodes is None else nodes.unionByName(here)
        more = met.filter(F.col("size") > bound)
        if level < LEVELS - 1:
            at = staged(more.select("id", "tree", "path", "node"), "large")
        else:
            large = staged(more.select("node", "id", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "blocks")
    any_large = not large.isEmpty()
    if any_large:
        nodes = nodes.unionByName(in_blocks(large))
    links = compared(nodes, reps, rows, words, percent)
    if any_large:
        links = staged(links, "links")
        apart = staged(across_blocks(large, connected_components(links)), "apart")
        if not apart.isEmpty():
            links = links.unionByName(compared(apart, reps, rows, words, percent))
    found = connected_components(links).select(F.col("id").alias("rep"), "component_id")
    return same.join(found, "rep", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "rep").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "rep")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest identifier; its columns stay as they are."""
    (key,) = free_names(docs, "key")
    gone = near_duplicates(docs, id_col, text_col, words, percent).filter(~F.col("kept")).select(F.col(id_col).alias(key))
    return docs.join(gone, docs[id_col] == gone[key], "left_anti")
