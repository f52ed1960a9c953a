"""Packing token pieces into sequences by a configuration linear program.

A document is its token ids and an end id. One longer than a sequence is cut into
full pieces, the first of which may be shorter. Only the histogram of piece lengths
(as many bins as a sequence has tokens, whatever the size of the input) goes to the
driver.

A configuration says how many pieces of each length share a sequence. The linear
program asks for the fewest sequences, as a fractional number of each configuration,
such that all pieces are covered. Multiplicative weights solve it: each length has a
price; the best configuration at these prices is a knapsack, solved by dynamic programming
over the tokens of a sequence and bounded by the pieces there are; lengths that have been
covered get cheaper. Its numbers are rounded down, and the program is solved again for the
pieces that are left over, until none is. On the test tables all of the sequences come out
of it this way, 1 more than the tokens need at sf0.01 (963) and none at sf0.1 (9,871).

A configuration with its number of copies is a run of sequence numbers. The pieces of a
length are numbered by counting per partition, and the number of a piece gives its
sequence and offset by binary search in a table of the configurations' slots, whose size
depends on the sequence length alone. Numbers follow the identifiers within a part, so that
a second evaluation gives the same sequences (equal rows may change places).

Defined results: null text counts as empty, which is the end id alone; a text's special
strings are encoded as the tokenizer does by default; repeated rows are packed one by
one; an empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.staging import bounded_batches, shuffle_width, staged

#: Parts in which pieces of a length are numbered; with the sequence length it bounds what goes to the driver and back.
PARTS = 1024
ROUNDS = 200
#: How much cheaper a length is when all its pieces have been covered (as a power of e).
STEP = 1.0
#: Power of a length that its price starts with. Above 1, so that long pieces go first and short ones stay to fill gaps.
PREFERENCE = 1.05


#: How byte-level vocabularies split a text before merging (the library's own pattern; a file with another one is refused).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary's tokens as bytes. Bytes that do not print stand as the characters from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    return {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items()}


def refuse_other_kinds(settings: dict) -> None:
    """Only plain byte-level merges split by PATTERN can be encoded from their ranks."""
    split, model = settings.get("pre_tokenizer") or {}, settings["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or settings.get("normalizer") or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("not a byte-level vocabulary with the usual split")


class TokenPieces:
    """Ids of whole texts from a tokenizer file. Nothing is remembered between texts: looking up words costs more than merging them.

    The ids of a byte-level vocabulary are the ranks of its merges, so that texts are encoded
    from the ranks. Texts with a special string go to the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        refuse_other_kinds(json.loads(self.tokenizer.to_str()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = {t: k for t, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.ranks = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=byte_ranks(words), special_tokens={})

    def ids_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            if any(s in text for s in self.special):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.ranks.encode_ordinary(text)
            yield array("I", ids).tobytes()


_TOKENIZERS: dict[str, TokenPieces] = {}


def tokenizer(path: str) -> TokenPieces:
    """The tokenizer of this Python process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = TokenPieces(path)
    return _TOKENIZERS[path]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: the first takes what full pieces leave."""
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, number) of every piece.

    ``number`` counts the pieces of a length within ``part``, a partition of the written table.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        for b in batches:
            rows = []
            for key, ids in zip(b["id"], own.ids_many(b["t"])):
                ids += end
                start = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append((key, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start += n
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, "id long, piece int, start long, length long, ids_crc32 long")


def bundles(lengths: np.ndarray, most: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(length, copies) with copies in powers of two, so that any number up to ``most`` is a sum of some."""
    out = []
    for length, n in zip(lengths.tolist(), np.minimum(most, capacity // lengths).tolist()):
        copies = 1
        while n > 0:
            out.append((length, min(copies, n)))
            n -= copies
            copies *= 2
    return out


def best_configuration(prices: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How many pieces of each length (index) a sequence of the highest total price has, at most ``most``, and that price."""
    lengths = np.flatnonzero(most[1 : capacity + 1] > 0) + 1
    items = bundles(lengths, most[lengths], capacity)
    value = np.zeros(capacity + 1)
    took = np.zeros((len(items), capacity + 1), dtype=bool)
    for k, (length, copies) in enumerate(items):
        size = length * copies
        with_it = value[: capacity + 1 - size] + prices[length] * copies
        better = with_it > value[size:]
        took[k, size:] = better
        value[size:] = np.where(better, with_it, value[size:])
    out = np.zeros(len(most), dtype=np.int64)
    room = capacity
    for k in range(len(items) - 1, -1, -1):
        if took[k, room]:
            length, copies = items[k]
            out[length] += copies
            room -= length * copies
    return out, float(value[capacity])


def lower_bound(histogram: np.ndarray, prices: np.ndarray, capacity: int) -> float:
    """Sequences that no packing goes below: the worth of all pieces over the most that a sequence can hold."""
    if not histogram.any():
        return 0.0
    return float((histogram * prices).sum()) / best_configuration(prices, histogram, capacity)[1]


def fractional(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations and fractional numbers of them that cover the histogram little by little, by multiplicative weights."""
    lengths = np.flatnonzero(histogram)
    demand = histogram[lengths].astype(float)
    covered = np.zeros(len(lengths))
    chosen: dict[bytes, list] = {}
    dose = max(float((lengths * demand).sum()) / capacity, 1.0) / rounds  # sequences that a round adds
    prices = np.zeros(capacity + 1)
    for _ in range(rounds):
        prices[lengths] = lengths**PREFERENCE * np.exp(-STEP * covered / demand)
        config, _ = best_configuration(prices, histogram, capacity)
        take = config[lengths]
        used = take > 0
        # no more of a configuration than its scarcest length has pieces in all
        amount = min(dose, float((demand[used] / take[used]).min()))
        covered += amount * take
        entry = chosen.setdefault(config.tobytes(), [config, 0.0])
        entry[1] += amount
        if (covered >= demand).all():
            break
    return [(c, x) for c, x in chosen.values()]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, copies) that hold each piece of the histogram exactly once.

    The program is solved, its numbers are rounded down, and it is solved again for the pieces that
    are left; where rounding down leaves nothing, numbers are rounded up as far as pieces last.
    Every sequence is a configuration that knapsack pricing found.
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    while left.any():
        found = sorted(fractional(left, capacity), key=lambda c: -c[1])
        for whole in (np.floor, np.ceil):
            before = len(out)
            for config, x in found:
                used = config > 0
                copies = min(int(whole(round(x, 9))), int((left[used] // config[used]).min()))
                if copies > 0:
                    out.append((config, copies))
                    left -= config * copies
            if len(out) > before:
                break
    return out


def slots(configs: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first number, first sequence, offset); a row serves as many numbers as its configuration has copies."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for config, copies in configs:
        offset = 0
        for length in np.flatnonzero(config)[::-1].tolist():
            for _ in range(int(config[length])):
                out.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
                taken[length] = taken.get(length, 0) + copies
                offset += length
        sequence += copies
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    table = staged(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    table = table.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(PARTS)).cast("int"))
    counted = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros((PARTS, capacity + 1), dtype=np.int64)
    counts[counted["part"].to_numpy(dtype=int), counted["length"].to_numpy(dtype=int)] = counted["n"].to_numpy(dtype=np.int64)
    configs = plan(counts.sum(axis=0), capacity)
    shared = spark.sparkContext.broadcast((slots(configs), np.cumsum(counts, axis=0) - counts))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_of, before = shared.value
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            sequence = np.empty(len(b), dtype=np.int64)
            offset = np.empty(len(b), dtype=np.int64)
            for (part, length), rows in b.groupby(["part", "length"]).indices.items():
                key = (int(part), int(length))
                n = before[key] + seen.get(key, 0) + np.arange(len(rows))
                seen[key] = seen.get(key, 0) + len(rows)
                own = table_of[key[1]]
                at = np.searchsorted(own[:, 0], n, side="right") - 1
                sequence[rows] = own[at, 1] + n - own[at, 0]
                offset[rows] = own[at, 2]
            yield b.drop(columns="part").assign(sequence_id=sequence, offset=offset)

    dealt = table.repartition(min(PARTS, shuffle_width(spark)), "part").sortWithinPartitions("part", "length", "id", "piece")
    out = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.mapInPandas(place, out).withColumnRenamed("id", id_col)
