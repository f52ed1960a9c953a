"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, whatever is not a letter becomes a single space, and the
n-grams (1 to ``MAX_N`` characters) of the result are hashed into ``BUCKETS``
columns. Training adds up the columns per language and turns them into smoothed
log probabilities; that matrix (languages x buckets) is broadcast, its size bounded by
``MAX_LANGUAGES``. Scoring counts the columns of a text and multiplies the counts of a batch
of texts that are not zero with the matrix.

Training reads about ``max_rows`` labelled rows at most, those with the smallest hashes of
the identifier, so that the sample does not depend on the order of the rows; of a language
that would have fewer than ``LEAST_ROWS`` of them it reads about as many more as there are up to that.

Defined results: a text that is null or has no letter gets ``und`` and score 0; so do
all texts if there is no labelled row. Equal scores go to the language first in
alphabetical order. The score is the posterior probability of the predicted language,
per n-gram evidence tempered by ``EVIDENCE``. Rows without a label are predicted, not
learned from; repeated rows give a row each; further columns are ignored by
predict() and kept by keep_identified().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.staging import bounded_batches, cut_at, positive_hash

BUCKETS = 1 << 15
MAX_N = 3
SMOOTHING = 0.5
#: Neighbouring n-grams overlap, so that each counts for this part of an independent observation.
EVIDENCE = 1.0 / MAX_N
#: Labelled rows that training reads at most.
MAX_ROWS = 20_000
#: Rows of a language that are read at least, if it has them (so training reads MAX_ROWS and MAX_LANGUAGES times as many at most).
LEAST_ROWS = 200
#: Labels that training takes at most: with the buckets they bound the matrix that is broadcast (128 MB). More are an error.
MAX_LANGUAGES = 512
#: Places of a text whose n-grams are hashed at once; counts add up over the whole text.
STEP = 1 << 18
#: Products that are added up at once: n-grams of a batch of texts, times languages.
BATCH = 1 << 19
UND = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(0x9E3779B1)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often each occurs) of the n-grams of a whole text."""
    points = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), dtype=np.uint32)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(points), STEP):
        # the n-grams that start here, so that none is cut or counted twice
        part = points[at : at + STEP + MAX_N - 1]
        h = np.zeros(len(part), dtype=np.uint32)
        found = []
        for n in range(1, MAX_N + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * _MIX + part[n - 1 :] + np.uint32(n)
            found.append((h[:STEP] * _MIX) >> np.uint32(17))
        total += np.bincount(np.concatenate(found), minlength=BUCKETS)
    seen = np.flatnonzero(total)
    return seen, total[seen]


class Model:
    """Languages and their log probabilities (buckets x languages)."""

    def __init__(self, languages: list[str], totals: np.ndarray, rows: np.ndarray):
        self.languages = languages
        smoothed = totals + SMOOTHING
        self.logs = np.ascontiguousarray(np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).T) if languages else np.zeros((BUCKETS, 0))
        self.prior = np.log(rows / rows.sum()) if languages else np.zeros(0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: sparse products of the counts of some texts with the matrix, about BATCH numbers at once."""
        out = [(UND, 0.0)] * len(texts)
        rows: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for k, t in enumerate(texts):
            if t and self.languages and _LETTER.search(t):
                rows.append(k)
                found.append(counts(t))
                held += len(found[-1][0]) * len(self.languages)
            if rows and (held >= BATCH or k == len(texts) - 1):
                for r, best, sure in zip(rows, *self.scored(found)):
                    out[r] = (self.languages[best], sure)
                rows, found, held = [], [], 0
        return out

    def scored(self, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[float]]:
        """For the counts of some texts: the number of the best language, and its posterior probability."""
        begin = np.cumsum([0] + [len(seen) for seen, _ in found[:-1]])
        seen, n = (np.concatenate(x) for x in zip(*found))
        scores = self.prior + EVIDENCE * np.add.reduceat(self.logs[seen] * n[:, None], begin, axis=0)
        sure = 1.0 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        return scores.argmax(axis=1).tolist(), sure.tolist()


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Learn from the rows of ``labelled`` that have a language and a letter."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.filter(F.col("t").isNotNull() & F.col("l").isNotNull())
    sizes = rows.groupBy("l").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"there are more labels than the {MAX_LANGUAGES} languages whose matrix can be broadcast")
    n = sum(r["count"] for r in sizes)
    if n > max_rows:
        # the cut of each language's hashes that leaves its rows of the sample: a filter, so that no task sorts the texts
        cuts = [(r["l"], cut_at(max(max_rows / n, LEAST_ROWS / r["count"]))) for r in sizes]
        table = rows.sparkSession.createDataFrame(cuts, "l string, cut long")
        rows = rows.join(F.broadcast(table), "l").filter(positive_hash(F.xxhash64(F.lit(7), F.col("id"))) <= F.col("cut"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["t"], b["l"]):
                if _LETTER.search(text):
                    own = totals.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                    seen, n = counts(text)
                    own[seen] += n
                    own[BUCKETS] += 1
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"l": lang, "bucket": at, "n": own[at]})

    parts = rows.select("t", "l").mapInPandas(add_up, "l string, bucket long, n long")
    sums = parts.groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(sums) and n > max_rows:
        raise ValueError(f"no row with a letter in the sample of {n} labelled rows")
    languages = sorted(sums["l"].unique())
    totals = np.zeros((len(languages), BUCKETS + 1), dtype=np.int64)
    place = {lang: k for k, lang in enumerate(languages)}
    totals[sums["l"].map(place).to_numpy(dtype=int), sums["bucket"].to_numpy(dtype=int)] = sums["n"].to_numpy()
    return Model(languages, totals[:, :BUCKETS], totals[:, BUCKETS])


def held_out(id_col: str, parts: int = 5) -> Column:
    """Rows kept from training: crc32 of the identifier as text, modulo ``parts``, is 0 (never for a null one)."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % parts == 0, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, lang_pred, score. One scan, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            found = own.predict(b["t"].tolist())
            yield pd.DataFrame({"id": b["id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out and predict all: id_col, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col, id_col)
    return predict(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """``docs`` whose text has a language with a score of at least ``least``; all columns stay."""
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([lang != UND and score >= least for lang, score in shared.value.predict(texts.tolist())], dtype=bool)

    return docs.filter(known(F.col(text_col)))
