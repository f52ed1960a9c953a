"""Token counts of a merge vocabulary by rank-synchronous array merging.

The vocabulary is a piece model with byte fallback: spaces become U+2581, one is
put before the text, and adjacent symbols whose concatenation is a piece merge,
best score first and leftmost among equal scores. No piece has U+2581 after another
character, so the text falls apart before each run of U+2581 into pre-tokens that
merge independently.

Distinct pre-tokens of a batch lie side by side in one flat array of symbol ids with
their offsets. Each step finds the best rank of every sequence and applies it in
all sequences at once: all its occurrences in a sequence, from the left, up to the
first after which a better pair has arisen (or only the leftmost where several pieces
share a score), which equals merging them one by one. Only the pairs beside a new
symbol are looked up again. What survives is counted, a character outside the
vocabulary as its UTF-8 bytes. Pre-tokens of more than ``LONG`` characters take the
same merges from a heap, in n log n steps.

Defined results: null and empty texts have no tokens; special strings in a text are
ordinary text; further columns of the input are ignored; repeated rows give a row each.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.pretokens import Memo, batches_of

SPACE = "▁"
NO_RANK = np.iinfo(np.int64).max
#: A text is cut into parts of about this many characters (at spaces), so that memory stays bounded.
PART = 1 << 20
#: Longer pre-tokens merge with a heap: there, one pass over all symbols for each rank would be quadratic.
LONG = 2048
_CUT = re.compile(r"(?<=[^ ]) ")


class PieceMerges:
    """The merges of a piece model as arrays, and the rank-synchronous count."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses the border of two words")
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in pieces):
            raise ValueError("a piece joins several spaces with a word")
        self.ids = {p: k for k, p in enumerate(pieces)}
        for c in sorted({c for p in pieces for c in p} - self.ids.keys()):
            self.ids[c] = len(self.ids)
        rank_of = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        shared = {rank_of[s] for s, n in Counter(pieces.values()).items() if n > 1}
        rank = {self.ids[p]: rank_of[s] for p, s in pieces.items()}
        keys, made = [], []
        n = len(self.ids)
        self.n = n + 1  # the last id: any character outside the vocabulary
        for p in pieces:
            for cut in range(1, len(p)):
                left, right = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.n + right)
                    made.append(self.ids[p])
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        self.ranks = np.array([rank[m] for m in self.made.tolist()], dtype=np.int64)
        self.shared = np.zeros(self.n, dtype=bool)
        for p, r in rank.items():
            self.shared[p] = r in shared
        self._table()
        self.longest_run = max(len(p) for p in pieces if p and not p.strip(SPACE))
        lengths = np.arange(1, 3 * self.longest_run)
        _, owner = self.merge(np.full(lengths.sum(), self.ids[SPACE]), lengths)
        runs = [0, *np.bincount(owner).tolist()]
        self.runs = runs[: self.longest_run]
        if any(n != self.run(k) for k, n in enumerate(runs)):
            raise ValueError("runs of spaces do not fall into runs of the longest piece")

    def _table(self) -> None:
        """The pairs in an open hash table: slots of two neighbouring entries are probed together."""
        bits = int(np.ceil(np.log2(len(self.keys)))) + 2
        self.shift = np.uint64(64 - bits)
        slots = np.full((1 << bits) + 64, -1, dtype=np.int64)
        self.reach = 1
        for k, h in enumerate(self._slot(self.keys).tolist()):
            at = h
            while slots[at] >= 0:
                at += 1
            slots[at] = k
            self.reach = max(self.reach, at - h + 1)
        self.slots = slots
        self.slot_keys = np.where(slots >= 0, self.keys[slots], -1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of each pair; NO_RANK if it does not merge."""
        pair = left * self.n + right
        at = self._slot(pair)
        found = np.full(len(pair), -1, dtype=np.int64)
        open_ = np.arange(len(pair))
        for _ in range(self.reach):
            key = self.slot_keys[at[open_]]
            hit = key == pair[open_]
            found[open_[hit]] = self.slots[at[open_[hit]]]
            open_ = open_[~hit & (key >= 0)]
            if not len(open_):
                break
            at[open_] += 1
        ok = found >= 0
        return np.where(ok, self.ranks[found], NO_RANK), self.made[found]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(surviving symbols with their place in the flat input, sequence of each) of ragged sequences."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(symbols))
        rank = np.full(len(symbols), NO_RANK)
        made = np.zeros(len(symbols), dtype=np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner], made[inner] = self.look_up(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(first, len(symbols)))
            best = np.minimum.reduceat(rank, first)
            live = best != NO_RANK
            if not live.all():
                keep = np.repeat(live, size)
                over = ~keep
                done.append((symbols[over], place[over], owner[over]))
                symbols, owner, place, rank, made = (x[keep] for x in (symbols, owner, place, rank, made))
                size, best = size[live], best[live]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == np.repeat(best, size))
            # of a run of neighbouring choices every second one, from its left end
            start = np.append(True, chosen[1:] != chosen[:-1] + 1)
            head = np.maximum.accumulate(np.where(start, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - head) % 2 == 0]
            of, new = owner[chosen], made[chosen]
            # the pairs on either side of each new symbol, as they are when the choices to its left have merged
            has_left = np.append(False, owner[1:] == owner[:-1])[chosen]
            left = symbols[chosen - has_left]
            touching = np.append(False, (chosen[1:] == chosen[:-1] + 2) & (of[1:] == of[:-1]))
            left[touching] = new[np.flatnonzero(touching) - 1]
            after = np.minimum(chosen + 2, len(symbols) - 1)
            has_right = (owner[after] == of) & (chosen + 2 < len(symbols))
            several = np.append(of[1:] == of[:-1], False) | np.append(False, of[1:] == of[:-1])
            if several.any():
                stop = self.shared[new]
                for has, a, b in ((has_left, left, new), (has_right, new, symbols[after])):
                    k = np.flatnonzero(has & several)
                    stop[k] |= self.look_up(a[k], b[k])[0] < rank[chosen[k]]
                # choices to the right of a stop in the same sequence wait
                stops = np.cumsum(stop) - stop
                begin = np.append(True, of[1:] != of[:-1])
                take = stops == np.maximum.accumulate(np.where(begin, stops, 0))
                chosen, new = chosen[take], new[take]
            symbols[chosen] = new
            keep = np.ones(len(symbols), dtype=bool)
            keep[chosen + 1] = False
            symbols, owner, place, rank, made = (x[keep] for x in (symbols, owner, place, rank, made))
            at = chosen - np.arange(len(chosen))
            changed = np.concatenate((at, (at - 1)[at > 0]))
            follows = np.append(owner[1:] == owner[:-1], False)[changed]
            rank[changed] = NO_RANK
            changed = changed[follows]
            rank[changed], made[changed] = self.look_up(symbols[changed], symbols[changed + 1])
        if not done:
            return np.empty((2, 0), dtype=np.int64), np.empty(0, dtype=np.int64)
        s, p, o = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(p)
        return np.stack([s[order], p[order]]), o[order]

    def merge_long(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """(surviving symbols, their places) of one long sequence, with a heap of (rank, place)."""
        n, here = len(symbols), np.array(symbols)
        rank, made = self.look_up(here[:-1], here[1:])
        ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols = list(symbols)
        heap = [(r, k, symbols[k], symbols[k + 1], m) for k, (r, m) in enumerate(zip(rank.tolist(), made.tolist())) if r != NO_RANK]
        heapq.heapify(heap)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}

        def push(k: int) -> None:
            pair = (symbols[k], symbols[ahead[k]])
            if pair not in pairs:
                r, m = self.look_up(np.array(pair[:1]), np.array(pair[1:]))
                pairs[pair] = (int(r[0]), int(m[0]))
            r, m = pairs[pair]
            if r != NO_RANK:
                heapq.heappush(heap, (r, k, *pair, m))

        while heap:
            _, k, a, b, m = heapq.heappop(heap)
            if symbols[k] != a or ahead[k] >= n or symbols[ahead[k]] != b:
                continue
            gone = ahead[k]
            symbols[k], symbols[gone] = m, -1
            ahead[k] = ahead[gone]
            if ahead[k] < n:
                back[ahead[k]] = k
                push(k)
            if back[k] >= 0:
                push(back[k])
        left = [k for k in range(n) if symbols[k] >= 0]
        return [symbols[k] for k in left], left

    def count_words(self, words: list[str]) -> list[int]:
        """For each word (no spaces) with a space before it: its tokens; negative if the space stays alone.

        A lone space belongs to the run of spaces before it, so the caller counts it there.
        """
        short = [k for k, w in enumerate(words) if len(w) < LONG]
        out = [0] * len(words)
        if short:
            text = SPACE + SPACE.join([words[k] for k in short])
            lengths = np.array([len(words[k]) + 1 for k in short])
            (symbols, places), owner = self.merge(self.symbols(text), lengths)
            cost = self.cost(symbols, places, text)
            total = np.bincount(owner, weights=cost, minlength=len(short)).astype(np.int64)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            signed = np.where(symbols[first] == self.ids[SPACE], 1 - total, total)
            for k, n in zip(short, signed.tolist()):
                out[k] = n
        for k in range(len(words)):
            if len(words[k]) >= LONG:
                text = SPACE + words[k]
                symbols, places = self.merge_long(self.symbols(text).tolist())
                n = int(self.cost(np.array(symbols), np.array(places), text).sum())
                out[k] = 1 - n if symbols[0] == self.ids[SPACE] else n
        return out

    def symbols(self, text: str) -> np.ndarray:
        get, outside = self.ids.get, self.n - 1
        return np.array([get(c, outside) for c in text], dtype=np.int64)

    def cost(self, symbols: np.ndarray, places: np.ndarray, text: str) -> np.ndarray:
        cost = np.ones(len(symbols), dtype=np.int64)
        for k in np.flatnonzero(symbols == self.n - 1).tolist():
            cost[k] = len(text[places[k]].encode())
        return cost

    def run(self, k: int) -> int:
        """Tokens of ``k`` spaces alone: from the left, as many of the longest run as go in, then the rest."""
        return k // self.longest_run + self.runs[k % self.longest_run]


class PieceCounter:
    """Token counts of whole texts; distinct words are merged once per batch and remembered."""

    def __init__(self, path: str, limit: int = 400_000):
        self.merges = PieceMerges(path)
        self.words = Memo(self.merges.count_words, limit)

    def part(self, parts: list[str], known: dict[str, int]) -> int:
        """Tokens of the words ``parts``, each with a space before it; empty words are spaces only."""
        counts = [known[p] for p in parts]
        if min(counts) > 0:
            return sum(counts)
        total, run = 0, 0
        for p, n in zip(parts, counts):
            run += 1
            if p:
                total += self.merges.run(run - 1) + n if n > 0 else self.merges.run(run) - n
                run = 0
        return total + self.merges.run(run)

    def count_many(self, texts: list[str]) -> list[int]:
        cut = [[w.split(" ") for w in self.cuts(t.replace(SPACE, " "))] for t in texts]
        known = self.words.fill({w for t in cut for part in t for w in part} - {""})
        known[""] = 0
        return [sum(self.part(part, known) for part in t) for t in cut]

    @staticmethod
    def cuts(text: str) -> list[str]:
        """``text`` in parts of about ``PART`` characters, cut at single spaces that are left out."""
        if len(text) <= PART:
            return [text] if text else []
        out, at = [], 0
        while (m := _CUT.search(text, at + PART)) is not None:
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def count(self, text: str) -> int:
        return self.count_many([text])[0]


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """The counter of this Python process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``path`` is the model's place on each executor. One scan, no shuffle.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for b in batches:
            counts = [n for part in batches_of(b["t"]) for n in own.count_many(part)]
            yield pd.DataFrame({"id": b["id"], "n_bytes": b["n_bytes"], "n_tokens": counts})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("n_bytes", F.octet_length("t").cast("long"))
    done = rows.mapInPandas(counted, "id long, n_bytes long, n_tokens long")
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
