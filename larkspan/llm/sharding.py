"""Contiguous shards with the smallest possible largest shard (DataFrame functions only).

Rows of equal text form an atomic group. Groups stand in the order of their
smallest identifier. The capacity is the smallest number of bytes with which a
greedy pass, opening a new shard whenever the next group does not fit, needs at
most ``n_shards`` shards; the cuts are those of that pass.

The greedy pass needs only prefix sums: from a start ``s`` the shard ends at the
largest group end not above ``s + capacity``. Prefix sums are made by range
partitioning, so no task holds all groups. The driver gets a grid of them: the first and
the last group end in each of ``GRID`` intervals, whatever the number of groups. A greedy
pass over the ends that it knows of is possible in fact, one that may end shards anywhere
between them bounds what is, so that binary search over both leaves a narrow range of
capacities. The intervals around its cuts get a finer grid, one job a round, until the two
passes agree; an interval becomes some thousand times narrower in each round.

Defined results: null text has no bytes, so its size is 1, and it is in the
group of empty texts; repeated rows are separate rows of one group; different texts under
one identifier are different groups; groups with null identifiers alone come first; an
empty table gives an empty result; shards may be empty if there are fewer groups than
shards. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm import exact_dedup
from larkspan.llm.staging import shuffle_width, staged

#: Intervals of group ends that go to the driver in a round.
GRID = 1 << 16
LAW = "bytes"


def ranged(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` dealt by ranges of ``order``, written with its partition number as ``pid``."""
    width = shuffle_width(df.sparkSession)
    return staged(df.repartitionByRange(width, *order).withColumn("pid", F.spark_partition_id()), name)


def small_table(spark: SparkSession, names: list[str], rows: list[tuple[int, ...]]) -> DataFrame:
    """A table of a few integers (one row per partition at most), without an RDD."""
    values = ", ".join("(" + ", ".join(f"{int(v)}L" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def prefix_sums(df: DataFrame, name: str, order: list[str], amount: str) -> DataFrame:
    """(*order, amount, ends): the running total of ``amount`` in the order of the columns ``order``, which are unique."""
    parts = ranged(df, name, *order)
    totals = sorted((r["pid"], r["s"]) for r in parts.groupBy("pid").agg(F.sum(amount).alias("s")).collect())
    before, offsets = 0, []
    for pid, total in totals:
        offsets.append((pid, before))
        before += total
    if not offsets:
        return parts.select(*order, amount, F.col(amount).alias("ends"))
    start = small_table(df.sparkSession, ["pid", "before"], offsets)
    running = F.sum(amount).over(Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(start), "pid").select(*order, amount, (running + F.col("before")).alias("ends"))


class KnownEnds:
    """Some of the group ends, and the intervals between two of them that hold others."""

    def __init__(self, total: int):
        self.total = total
        self.known = np.array([0, total], dtype=np.int64)
        self.open = [(0, total)]

    def learn(self, hulls: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> None:
        """``found`` are (first, last, number) of the ends in each interval of a grid over ``hulls``."""
        self.known = np.unique(np.concatenate((self.known, np.array([e for f in found for e in f[:2]], dtype=np.int64))))
        outside = [(a, b) for a, b in self.open if not any(lo <= a and b <= hi for lo, hi in hulls)]
        self.open = sorted(outside + [(first, last) for first, last, n in found if n > 2])

    def around(self, low: int, high: int) -> tuple[int, int] | None:
        """The hull of the open intervals with a place in [low, high]."""
        hit = [(a, b) for a, b in self.open if a < high and low < b]
        return (hit[0][0], hit[-1][1]) if hit else None

    def cuts(self, capacity: int, n_shards: int, possible: bool) -> list[int]:
        """Where the shards of a greedy pass end, at known ends, or (``possible``) wherever ends may be."""
        begins = np.array([a for a, _ in self.open], dtype=np.int64)
        out, at = [], 0
        for _ in range(n_shards):
            top = min(at + capacity, self.total)
            at = int(self.known[np.searchsorted(self.known, top, side="right") - 1])
            k = int(np.searchsorted(begins, top, side="left")) - 1
            if possible and k >= 0 and top < self.open[k][1]:
                at = top
            out.append(at)
        return out

    def least(self, low: int, high: int, n_shards: int, possible: bool) -> int:
        """The smallest capacity from ``low`` to ``high`` whose shards hold all."""
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, n_shards, possible)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low


def grid(ends: DataFrame, hulls: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first, last, number) of the ends in each interval of a grid over ``hulls``: one job."""
    each = max(1, GRID // len(hulls))
    e, place = F.col("ends"), F.lit(None).cast("long")
    for k, (lo, hi) in enumerate(hulls):
        width = -(-(hi - lo) // each)
        place = F.when((e > lo) & (e <= hi), F.lit(k * each).cast("long") + F.floor((e - lo - 1) / F.lit(width))).otherwise(place)
    rows = ends.select("ends", place.alias("place")).filter("place IS NOT NULL").groupBy("place").agg(F.min("ends"), F.max("ends"), F.count(F.lit(1))).collect()
    return [(r[1], r[2], r[3]) for r in sorted(rows)]


def smallest_capacity(ends: DataFrame, largest: int, total: int, n_shards: int) -> tuple[int, list[int]]:
    """(capacity, where the shards end) for groups with the prefix sums ``ends``."""
    own = KnownEnds(total)
    hulls = [(0, total)]
    low = max(largest, -(-total // n_shards))
    high = low + largest  # a greedy shard is closed only with more than high - largest bytes in it
    while True:
        own.learn(hulls, grid(ends, hulls))
        low, high = own.least(low, high, n_shards, True), own.least(low, high, n_shards, False)
        sure, possible = own.cuts(low, n_shards, False), own.cuts(high, n_shards, True)
        if low == high and sure == possible:
            return low, sure
        tops = [(a + low, b + high) for a, b in zip([0, *sure], [0, *possible[:-1]])]
        hulls = []
        for hull in sorted(h for h in (own.around(*t) for t in tops) if h is not None):
            if hulls and hull[0] < hulls[-1][1]:
                hulls[-1] = (hulls[-1][0], max(hull[1], hulls[-1][1]))
            else:
                hulls.append(hull)


def minimax_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8) -> DataFrame:
    """One row per input row: id_col, size, text_crc32, law, shard, slot, grown_shard, keep_id.

    Order in a shard: groups by their smallest identifier, rows of a group by identifier.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.encode("t", "UTF-8"))
    rows = staged(exact_dedup.digests(docs, id_col, text_col, spaces=False, more={"text_crc32": crc}), "sizes")
    order = F.coalesce("keep_id", F.lit(-(1 << 63)).cast("long")).alias("order")
    rows = exact_dedup.groups(rows).select(
        "id", (F.col("n_bytes") + 1).alias("size"), "text_crc32", "keep_id", order, "check", (F.col("group_size") * (F.col("n_bytes") + 1)).alias("bytes")
    )
    rows = ranged(rows, "rows", "order", "check", "id")
    # a repeated row repeats its identifier, so that the group is taken once by value
    atoms = rows.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("order", "check").agg(F.max("bytes").alias("bytes"))
    ends = staged(prefix_sums(atoms, "groups", ["order", "check"], "bytes"), "ends")
    facts = ends.agg(F.max("bytes").alias("largest"), F.max("ends").alias("total")).first()
    cut_keys = []
    if facts["total"] is not None:
        _, at = smallest_capacity(ends, facts["largest"], facts["total"], n_shards)
        inner = sorted({e for e in at if e < facts["total"]})
        # the first group after each cut
        wanted = [F.min(F.when(F.col("ends") > e, F.struct("order", "check"))).alias(f"c{k}") for k, e in enumerate(inner)]
        cut_keys = list(ends.agg(*wanted).first()) if wanted else []
    shard: Column = F.lit(0)
    for key in cut_keys:
        after = (F.col("order") > key["order"]) | ((F.col("order") == key["order"]) & (F.col("check") >= key["check"]))
        shard = shard + F.when(after, 1).otherwise(0)
    rows = rows.withColumn("shard", shard.cast("int"))
    counts = sorted((r["shard"], r["pid"], r["n"]) for r in rows.groupBy("shard", "pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before, last = [], 0, None
    for at_shard, pid, n in counts:
        before = 0 if at_shard != last else before
        offsets.append((at_shard, pid, before))
        before, last = before + n, at_shard
    start = small_table(spark, ["shard", "pid", "before"], offsets or [(0, 0, 0)])
    number = F.row_number().over(Window.partitionBy("shard", "pid").orderBy("order", "check", "id"))
    return rows.join(F.broadcast(start), ["shard", "pid"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (number - 1 + F.col("before")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "keep_id",
    )
