"""Whitening of embeddings by a tiled covariance.

Entries become integers x = floor(``SCALE`` * c) + ``OFFSET``. A first scan adds up x for each
dimension. For the covariance, rows are gathered to row blocks, centred on the integer next to
each dimension's mean, and cut into column blocks of ``TILE`` dimensions. Column blocks are shuffled
by row block; where those of a row block meet, each pair of column blocks (a tile key) is
multiplied, the products are added up per tile in the task and then by a grouped sum over all
tasks. The driver assembles the tiles (dimensions squared, nothing that grows with the rows),
takes out the fractions of the means, and computes eigenvalues and eigenvectors. A second round
of the same tiles over the whitened vectors measures how far their covariance is from the
identity; the last scan gives the result.

The products of integers are exact as long as those of a row block stay below 2**53 and the
sums below 2**63 (entries up to some thousands in size); the covariance is then the exact fraction,
rounded once, and does not depend on how rows were dealt to tasks. Beyond, the same products
are in double precision.

Defined results: rows whose vector is null, or holds a null or non-finite entry, or one whose x
exceeds 2**62, take no part. Neither do vectors of another length than the commonest (the longer,
of lengths as common): they have no covariance with the others. Empty vectors give no rows.
Repeated rows count and come out as often as they are there, null identifiers too.
Components whose eigenvalue is not above ``FLAT`` times the largest have no variance to divide
by and are left out, so a single vector, or only equal ones, give no rows, as does an empty
table. ``deviation`` is a long, or decimal(38,0) where the sum could exceed it. A component's
largest entry is positive. Identifiers keep their type; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
OFFSET = 1_000_000
TILE = 32
BLOCK_ROWS = 4096
#: Bytes of a row block in doubles at most.
BLOCK_BYTES = 32 << 20
FLAT = 1e-10
EXACT = 1 << 53
LONG = 1 << 63
MOST = float(1 << 62)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows whose entries are all there, finite and small enough for x; entries as double."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # not(x < y) is true for NaN, which is above all numbers here
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) * SCALE < MOST, F.lit(False))))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a batch as integers x."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(-1, dims) * SCALE).astype(np.int64) + OFFSET


@dataclass
class Facts:
    """Rows, and for each dimension the sum, the least and the greatest x."""

    n: int
    sums: list[int]
    low: np.ndarray
    high: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def middle(self) -> np.ndarray:
        """The integer next to each mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """sums - n * middle: what is left of the sums of centred integers."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]

    @property
    def reach(self) -> int:
        """The largest distance of an entry from the middle."""
        return int(max((self.high - self.middle).max(), (self.middle - self.low).max(), 1))


def facts(rows: DataFrame) -> Facts | None:
    """One scan; only the commonest length reaches the driver."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            column = b.column(0)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                x = matrix(column.filter(pa.array(lengths == d)), d)
                own = held.setdefault(d, [0, np.zeros(d, dtype=object), x.min(axis=0), x.max(axis=0)])
                own[0] += len(x)
                # halves, so that neither sum leaves 64 bits
                own[1] += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                own[2], own[3] = np.minimum(own[2], x.min(axis=0)), np.maximum(own[3], x.max(axis=0))
        for d, (n, s, low, high) in held.items():
            total = pa.array([Decimal(int(k)) for k in s], pa.decimal128(38, 0))
            at = [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), total, pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(at, ["d", "pos", "n", "s", "low", "high"])

    parts = rows.select("v").mapInArrow(add_up, "d int, pos int, n long, s decimal(38,0), low long, high long")
    each = parts.groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = each.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "s", "low", "high"))).alias("dims"))
    best = whole.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not best:
        return None
    dims = best[0]["dims"]
    return Facts(best[0]["n"], [int(k["s"]) for k in dims], np.array([k["low"] for k in dims]), np.array([k["high"] for k in dims]))


def tile_sums(rows: DataFrame, columns: Callable[[pa.Array], np.ndarray], width: int, block_rows: int, store: str, whole: bool) -> np.ndarray:
    """The sums over all rows of products of any two of the ``width`` columns that ``columns`` makes of a batch.

    ``store`` is the numpy type that column blocks travel in; ``whole``: products are integers.
    """
    n_blocks = -(-width // TILE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        waiting = 0

        def block(x: np.ndarray) -> pa.RecordBatch:
            parts = [np.ascontiguousarray(x[:, k * TILE : (k + 1) * TILE].astype(store)).tobytes() for k in range(n_blocks)]
            name = np.full(n_blocks, (task << 32) + made, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.arange(n_blocks, dtype=np.int32)), pa.array(parts, pa.binary())], ["block", "part", "data"])

        for b in batches:
            held.append(columns(b.column(0)))
            waiting += len(held[-1])
            if waiting >= block_rows:
                x = np.concatenate(held)
                full = len(x) - len(x) % block_rows
                for at in range(0, full, block_rows):
                    yield block(x[at : at + block_rows])
                    made += 1
                held, waiting = [x[full:]], len(x) - full
        if waiting:
            yield block(np.concatenate(held))

    value = "long" if whole else "double"
    names = [f"v{k}" for k in range(TILE)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        name, held = None, []
        for b in batches:
            for own, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if own != name:
                    name, held = own, []
                wide = min(TILE, width - part * TILE)
                y = np.frombuffer(data.as_buffer(), dtype=store).reshape(-1, wide).astype(float)
                held.append((part, y))
                for other, x in held:  # parts come in order, so other <= part
                    product = x.T @ y
                    key = (other, part)
                    product = product.astype(np.int64) if whole else product
                    totals[key] = totals[key] + product if key in totals else product
        for (a, c), t in totals.items():
            padded = np.zeros((len(t), TILE), dtype=t.dtype)
            padded[:, : t.shape[1]] = t
            at = [pa.array(np.full(len(t), k, np.int32)) for k in (a, c)] + [pa.array(np.arange(len(t), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(at + [pa.array(np.ascontiguousarray(col)) for col in padded.T], ["a", "c", "r", *names])

    blocks = rows.select("v").mapInArrow(cut, "block long, part int, data binary")
    met = blocks.repartition("block").sortWithinPartitions("block", "part")
    tiles = met.mapInArrow(multiply, "a int, c int, r int, " + ", ".join(f"{k} {value}" for k in names))
    out = np.zeros((n_blocks * TILE, n_blocks * TILE), dtype=np.int64 if whole else float)
    for t in tiles.groupBy("a", "c", "r").agg(*[F.sum(k).alias(k) for k in names]).collect():
        at = t["a"] * TILE + t["r"]
        out[at, t["c"] * TILE : (t["c"] + 1) * TILE] = [t[k] for k in names]
    out = out[:width, :width]
    return np.triu(out) + np.triu(out, 1).T


def covariance(rows: DataFrame, known: Facts) -> np.ndarray:
    """The covariance of x, divisor n."""
    middle, dims, reach = known.middle, known.dims, known.reach
    room = max(1, BLOCK_BYTES // (8 * dims))
    exact = reach * reach * 2 < EXACT and known.n * reach * reach < LONG
    block_rows = min(BLOCK_ROWS, room, (EXACT - 1) // (reach * reach)) if exact else min(BLOCK_ROWS, room)
    store = next((k for k, bits in (("<i1", 7), ("<i2", 15), ("<i4", 31)) if reach < 1 << bits), "<f8")
    products = tile_sums(rows, lambda column: matrix(column, dims) - middle, dims, block_rows, store, exact)
    if exact:
        rest = np.array(known.rest, dtype=object)
        fraction = known.n * products.astype(object) - np.outer(rest, rest)
        return (fraction / known.n**2).astype(float)
    means = np.array([r / known.n for r in known.rest])
    return products / known.n - np.outer(means, means)


def rows_times(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``x @ columns``, to the last bit the same for a row whatever rows lie beside it: a matrix product adds in an order that depends on their number."""
    out = np.zeros((len(x), columns.shape[1]))
    for at in range(0, len(x), 1024):
        part, total = x[at : at + 1024], out[at : at + 1024]
        for k, entries in enumerate(columns):
            total += part[:, k, None] * entries
    return out


@dataclass
class Whitening:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance, as many as are asked for and have variance."""

    facts: Facts
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @classmethod
    def of(cls, known: Facts, cov: np.ndarray, components: int) -> Whitening:
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = min(components, int((values > max(FLAT * values[0], 0.0)).sum()))
        values, vectors = values[:kept], vectors[:, :kept]
        if kept:
            vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
        return cls(known, values, vectors, float(np.trace(cov)))

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; x - S / n without the loss of large numbers' last digits."""
        centred = (x - self.facts.middle) - np.array([r / self.facts.n for r in self.facts.rest])
        return rows_times(centred, self.vectors) / np.sqrt(self.values)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, from the rows themselves."""
    width, dims, n = len(model.values), model.facts.dims, model.facts.n

    def columns(column: pa.Array) -> np.ndarray:
        w = model.project(matrix(column, dims))
        return np.concatenate((w, np.ones((len(w), 1))), axis=1)  # the ones give the sums

    sums = tile_sums(rows, columns, width + 1, min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * dims))), "<f8", False)
    means = sums[:width, width] / n
    return float(np.abs(sums[:width, :width] / n - np.outer(means, means) - np.eye(width)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """A row per vector and component: id_col, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = usable(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    known = facts(rows)
    model = None
    if known is not None:
        rows = rows.filter(F.size("v") == known.dims)
        model = Whitening.of(known, covariance(rows, known), components)
    n = known.n if known is not None else 0
    small = known is None or known.dims * (n * (known.reach + 1)) ** 2 < LONG
    schema = f"id {kind.simpleString()}, component int, n long, deviation {'long' if small else 'decimal(38,0)'}, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error = identity_error(rows, model)
    width, rest = len(model.values), known.rest
    shares = model.values / model.trace

    def deviations(x: np.ndarray) -> pa.Array:
        """Sums of (n * x - S) ** 2, exact."""
        if small:
            off = n * (x - known.middle) - np.array(rest, dtype=np.int64)
            return pa.array((off * off).sum(axis=1))
        off = n * (x - known.middle).astype(object) - np.array(rest, dtype=object)
        return pa.array([Decimal(int(k)) for k in (off * off).sum(axis=1)], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), known.dims)
            if not len(x):
                continue
            again = pa.array(np.repeat(np.arange(len(x)), width))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(again),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(again), n, np.int64)),
                    deviations(x).take(again),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(again), error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("id", "v").mapInArrow(run, schema).withColumnRenamed("id", id_col)
