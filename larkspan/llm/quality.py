"""Quality classification by compression.

Two zstandard dictionaries are built, one from blocks of texts labelled good, one from
blocks of texts labelled bad. A text is cut into blocks of ``BLOCK`` bytes, each block is
compressed with either dictionary, and the margin of the text is

    (bytes with the bad dictionary - bytes with the good one) / (bytes of the text + ``PRIOR``)

It is large for text that good texts help to compress, negative for text that bad texts
help to compress, and about 0 for text that needs no dictionary, such as one word over and
over. A logistic curve, fitted to labelled texts that the dictionaries were not built from,
turns margins into probabilities of label 1 (to all labelled texts, where those lack a label).

Labels are sampled before any text is touched: per label the ``2 * ROWS`` identifiers with the
smallest hashes, half of them for the dictionaries, half for the curve. These at most
``4 * ROWS`` identifiers are broadcast to one scan of the texts; of the blocks, the ``BLOCKS``
with the smallest hashes of each label build its dictionary. So what reaches the driver is
bounded (``2 * BLOCKS * BLOCK`` bytes and ``4 * ROWS`` margins), whatever the input. Scoring is
one scan without a shuffle; whole texts are read, a block at a time.

Defined results: a null text counts as empty; an empty text has margin 0 and the score of
that. Identifiers with both labels teach nothing, nor do labels other than 0 and 1, null
identifiers and identifiers without a document; equal texts count once a label. Where one
of the labels is missing, all texts get the share of label 1 with one more row of either
label (0.5 without any label). Repeated rows give a row each, further columns are ignored,
and an empty table gives an empty result. Identifiers keep their type.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.language_id import held_out
from larkspan.llm.staging import bounded_batches, discard, staged

BLOCK = 1024
LEVEL = 3
DICTIONARY = 112_640
#: Labelled rows per label and use (dictionary, curve) at most.
ROWS = 8192
#: Blocks per label that its dictionary is built from at most.
BLOCKS = 8192
#: Bytes added to a text's length, so that the frames of a few bytes decide nothing.
PRIOR = 16
RIDGE = 1e-3


def blocks_of(data: bytes) -> list[bytes]:
    return [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]


def dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary, or the blocks themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


class Model:
    """Dictionaries of label 0 and 1 (None without both labels) and the curve: scale and shift of a margin's log odds."""

    def __init__(self, dictionaries: tuple[bytes, bytes] | None, scale: float = 0.0, shift: float = 0.0):
        self.dictionaries = dictionaries
        self.scale = scale
        self.shift = shift
        self._compressors: list[zstandard.ZstdCompressor] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_compressors": []}

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if not self._compressors:
            for d in self.dictionaries:
                known = zstandard.ZstdCompressionDict(d)
                known.precompute_compress(level=LEVEL)
                bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
                self._compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, **bare))
        return self._compressors

    def margin(self, text: str | None) -> float:
        if not text or self.dictionaries is None:
            return 0.0
        data = text.encode()
        bad, good = self.compressors()
        saved = sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks_of(data))
        return saved / (len(data) + PRIOR)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * margins + self.shift, -700, 700)))


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve of the labels over the margins (Newton's method, a small ridge on the scale)."""
    spread = margins.std() or 1.0
    x = np.stack([margins / spread, np.ones_like(margins)], axis=1)
    ridge = np.diag([RIDGE, 0.0])
    w = np.array([0.0, np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - labels * z).sum() + 0.5 * v @ ridge @ v)

    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -700, 700)))
        gradient = x.T @ (p - labels) + ridge @ w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1])


def chosen(labels: DataFrame, id_col: str, label_col: str, usable: Column, rows: int) -> DataFrame:
    """(id, label, role) of at most ``4 * rows`` identifiers: per label those with the smallest hashes; role 0 builds, 1 fits."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & usable).groupBy(F.col(id_col).alias("id"))
    known = one.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
    known = known.filter("label = other").select("id", "label", F.xxhash64(F.lit(23), "id").alias("h"))
    # limit() after orderBy() is a bounded heap a task, so that neither a shuffle nor a sort of all labels follows
    parts = [known.filter(F.col("label") == k).orderBy("h", "id").limit(2 * rows) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("id", "label", F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(2)).cast("int").alias("role"))


def sampled_blocks(texts: DataFrame, limit: int) -> dict[int, list[bytes]]:
    """Of either label's different blocks, those with the smallest hashes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, dict[bytes, bytes]] = {0: {}, 1: {}}
        for b in batches:
            for label, text in zip(b["label"], b["t"]):
                own = held[label]
                for block in blocks_of(text.encode()):
                    own[blake2b(block, digest_size=8).digest()] = block
                    if len(own) > 2 * limit:
                        own = held[label] = {h: own[h] for h in sorted(own)[:limit]}
        for label, own in held.items():
            least = sorted(own)[:limit]
            yield pd.DataFrame({"label": label, "h": least, "block": [own[h] for h in least]})

    found = texts.filter("role = 0").select("label", "t").mapInPandas(cut, "label int, h binary, block binary")
    found = found.groupBy("label", "h").agg(F.first("block").alias("block"))
    return {k: [bytes(r["block"]) for r in found.filter(F.col("label") == k).orderBy("h").limit(limit).collect()] for k in (0, 1)}


def margins(texts: DataFrame, model: Model, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Margins and labels of labelled texts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "margin": [own.margin(t) for t in b["t"]]})

    rows = texts.select("label", "t").mapInPandas(run, "label int, margin double")
    found = rows.orderBy(F.xxhash64("margin", "label"), "margin", "label").limit(limit).toPandas()
    return found["margin"].to_numpy(float), found["label"].to_numpy(float)


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS, blocks: int = BLOCKS
) -> Model:
    """Learn from the documents whose identifier has a label and for which ``usable``, a condition on ``labels``, holds."""
    bounded_batches(docs.sparkSession)
    ids = chosen(labels, id_col, label_col, usable, rows)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # at most 4 * rows identifiers, so the broadcast is bounded; texts are not shuffled but for the few that are found
    texts = staged(own.join(F.broadcast(ids), "id").select("label", "role", "t").distinct(), "labelled")
    found = sampled_blocks(texts, blocks)
    if found[0] and found[1]:
        model = Model((dictionary(found[0]), dictionary(found[1])))
        at, good = margins(texts.filter("role = 1"), model, 4 * rows)
        if not 0 < good.sum() < len(good):  # too few labelled texts for a curve of their own
            at, good = margins(texts, model, 4 * rows)
        model.scale, model.shift = curve(at, good)
    else:
        n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
        model = Model(None, 0.0, float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))))
    discard(texts)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, score, margin. One scan, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            at = np.array([own.margin(t) for t in b["t"]], dtype=float)
            yield pd.DataFrame({"id": b["id"], "score": own.scores(at), "margin": at})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, score double, margin double")
    return rows.withColumnRenamed("id", id_col)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3) -> DataFrame:
    """Learn from the labels that are not held out and score every text: id_col, held_out, score, predicted (1 from ``least`` on), margin."""
    model = train(docs, labels, ~held_out(id_col), id_col, text_col, label_col)
    found = predict(docs, model, id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "margin")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3) -> DataFrame:
    """``docs`` whose text scores at least ``least``; all columns stay."""
    model = train(docs, labels, ~held_out(id_col), id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series(own.scores(np.array([own.margin(t) for t in texts], dtype=float)) >= least)

    return docs.filter(good(F.col(text_col)))
