"""Byte-level BPE encoding and decoding as reductions over a tree.

A pre-token is halved until single tokens are left (at the latest, bytes). Encodings of neighbouring halves
are joined at their border: the last tokens of the left half and the first of the
right half form a window, whose bytes are encoded anew. If the first token of the
window comes out as it was (or the window reaches the left end), and likewise the
last one on the right, the tokens outside are stable: a sequence is the encoding of
its bytes exactly if each two neighbours are the encoding of theirs, neighbours
outside the window are as before, and those inside come from an encoding. Otherwise
the window doubles on the side that changed.

The join of encodings is associative, with the empty encoding as its unit. Halves and
windows repeat across a corpus, so each process remembers a bounded number of them.

Decoding concatenates the byte strings of the tokens up a tree.

Defined results: null counts as empty; an empty text has no tokens, and the digests
are those of the empty byte string; special strings are ordinary text; further columns
of the input are ignored; repeated rows give a row each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.pretokens import Memo, batches_of, space_chunks

NONE = 1 << 62
#: Bytes of a window that is merged by scanning; longer ones take a heap and are not remembered.
SHORT = 64
#: Tokens in a leaf of the decoding tree.
LEAF = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class TreeEncoder:
    """Ranks of byte strings, the split pattern, and the tree reductions."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 500_000):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.decimal = [str(k) for k in range(len(self.token_bytes))]
        self.own = {token: token for token in ranks}
        self.remembered = remembered
        self.halves: dict[bytes, tuple[bytes, ...]] = {}
        self.windows: dict[bytes, tuple[bytes, ...]] = {}

    def window(self, piece: bytes) -> tuple[bytes, ...]:
        """The encoding of a short byte string by repeated merging of its lowest-ranked pair, leftmost first."""
        found = self.windows.get(piece)
        if found is not None:
            return found
        if len(piece) > SHORT:
            return self.merged(piece)
        rank, n = self.ranks.get, len(piece)
        cuts = list(range(n + 1))
        pairs = [rank(piece[k : k + 2], NONE) for k in range(n - 1)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            k = pairs.index(best)
            del cuts[k + 1], pairs[k]
            if k:
                pairs[k - 1] = rank(piece[cuts[k - 1] : cuts[k + 1]], NONE)
            if k < len(pairs):
                pairs[k] = rank(piece[cuts[k] : cuts[k + 2]], NONE)
        parts = [piece[x:y] for x, y in zip(cuts, cuts[1:])]
        if len(self.windows) >= self.remembered:
            self.windows.clear()
        found = self.windows[piece] = tuple([self.own[p] for p in parts])
        return found

    def merged(self, piece: bytes) -> tuple[bytes, ...]:
        """As window(), for long byte strings: the pairs wait in a heap by (rank, place)."""
        ranks, n = self.ranks, len(piece)
        ends = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
        starts = list(range(n))  # by the end of a part less one: where it starts
        heap = [(ranks[piece[k : k + 2]], k, k + 2) for k in range(n - 1) if piece[k : k + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, end = heapq.heappop(heap)
            middle = ends[k]
            if not middle or middle >= end or ends[middle] != end:
                continue
            ends[k], ends[middle], starts[end - 1] = end, 0, k
            for a, b in ((k, ends[end] if end < n else 0), (starts[k - 1] if k else -1, end)):
                if a >= 0 and b and (rank := ranks.get(piece[a:b])) is not None:
                    heapq.heappush(heap, (rank, a, b))
        out, at = [], 0
        while at < n:
            out.append(self.own[piece[at : ends[at]]])
            at = ends[at]
        return tuple(out)

    def join(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """The encoding of the concatenation of what ``left`` and ``right`` encode."""
        if not left or not right:
            return left or right
        a, b = 1, 1
        while True:
            new = self.window(b"".join(left[-a:] + right[:b]))
            left_ok = a == len(left) or new[0] == left[-a]
            right_ok = b == len(right) or new[-1] == right[b - 1]
            if left_ok and right_ok:
                return left[: len(left) - a] + new + right[b:]
            a = a if left_ok else min(2 * a, len(left))
            b = b if right_ok else min(2 * b, len(right))

    def reduce(self, piece: bytes) -> tuple[bytes, ...]:
        """The encoding of a byte string by recursive halves; a token's bytes encode to the token."""
        token = self.own.get(piece)
        if token is not None:
            return (token,)
        found = self.halves.get(piece)
        if found is not None:
            return found
        middle = len(piece) // 2
        found = self.join(self.reduce(piece[:middle]), self.reduce(piece[middle:]))
        if len(piece) <= 16:
            if len(self.halves) >= self.remembered:
                self.halves.clear()
            self.halves[piece] = found
        return found

    def encode(self, text: str) -> tuple[int, ...]:
        """Ids of ``text``, each match of the pattern by itself."""
        ranks = self.ranks
        out: list[int] = []
        for match in self.pattern.findall(text):
            piece = match.encode()
            rank = ranks.get(piece)
            if rank is not None:
                out.append(rank)
            else:
                out.extend(ranks[t] for t in self.reduce(piece))
        return tuple(out)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``: leaves are concatenated, then neighbours, level by level."""
        table = self.token_bytes
        level = [b"".join([table[i] for i in ids[at : at + LEAF]]) for at in range(0, len(ids), LEAF)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


class TextCodec:
    """Whole texts: chunks of a text are encoded once and remembered."""

    def __init__(self, encoder: TreeEncoder, limit: int = 300_000):
        self.encoder = encoder
        self.chunks = Memo(lambda many: map(encoder.encode, many), limit)

    def ids_many(self, texts: list[str]) -> Iterator[list[int]]:
        cut = [space_chunks(t) for t in texts]
        known = self.chunks.fill(set(chain.from_iterable(cut)))
        for chunks in cut:
            yield list(chain.from_iterable(map(known.__getitem__, chunks)))

    def ids(self, text: str) -> list[int]:
        return next(self.ids_many([text]))


_CODECS: dict[tuple[str, str], TextCodec] = {}


def codec(path: str, pattern: str) -> TextCodec:
    """The codec of this Python process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TextCodec(TreeEncoder(read_ranks(path), pattern))
    return _CODECS[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col and ids (array of int)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for b in batches:
            at = 0
            for part in batches_of(b["t"]):
                yield pd.DataFrame({"id": b["id"].iloc[at : at + len(part)], "ids": list(own.ids_many(part))})
                at += len(part)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    Encoding and decoding run in one pass, so that no ids leave the executor's Python process.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        decimal = own.encoder.decimal
        for b in batches:
            rows = []
            texts = chain.from_iterable(own.ids_many(part) for part in batches_of(b["t"]))
            for key, ids in zip(b["id"], texts):
                listed = ",".join([decimal[i] for i in ids]).encode()
                rows.append((key, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(own.encoder.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    done = rows.mapInPandas(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.withColumnRenamed("id", id_col)
