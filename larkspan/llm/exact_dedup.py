"""Exact duplicate groups by a tree merge of sorted digest runs (DataFrame functions only).

Rows are dealt to ``n_runs`` runs by a hash of their identifier. A run holds one
entry per digest: the smallest identifier and the number of rows. In each round
``fan_in`` neighbouring runs merge into one, keeping the smallest identifier and
adding the counts, until one run is left. The answer then goes back down to the
entries of the first level and from there to the rows. A digest that holds a
third of all rows is one entry in each run from the first level on, and its rows
are joined by (run, digest), so no task gets more than a run's share of it.

Entries are keyed by SHA-256 together with a 64-bit hash of another family and
the byte length, so entries merge only if all three agree.

Defined results: null text counts as empty; empty texts form a group of their
own; repeated rows (same identifier and text) are separate rows of one group, and
all rows that carry the smallest identifier are kept; an empty table gives an empty
result. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.staging import free_names, staged

#: One or more of space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
N_RUNS = 512
FAN_IN = 8
KEY = ["digest", "check", "n_bytes"]


def normalised(text: Column, spaces: bool = True) -> Column:
    """Text with null as empty and, if ``spaces``, each run of white space as one space."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, SPACES, " ") if spaces else text


def digests(docs: DataFrame, id_col: str, text_col: str, spaces: bool = True, more: dict[str, Column] | None = None) -> DataFrame:
    """(id, run, digest, check, n_bytes, *more) of every row, from one scan of the texts."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col), spaces).alias("t"))
    return text.select(
        "id",
        F.pmod(F.xxhash64("id"), F.lit(N_RUNS)).cast("int").alias("run"),
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        *[c.alias(k) for k, c in (more or {}).items()],
    )


def merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: ``fan_in`` neighbouring runs become one, an entry per key, the smallest identifier kept."""
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .groupBy("run", *KEY)
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def groups(rows: DataFrame) -> DataFrame:
    """``rows`` of digests() with keep_id and group_size."""
    level = rows.groupBy("run", *KEY).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    first = level
    left = N_RUNS
    while left > 1:
        level = merge_round(level, FAN_IN)
        left = -(-left // FAN_IN)
    answer = level.drop("run")
    down = first.select("run", *KEY).join(answer, KEY)
    return rows.join(down, ["run", *KEY])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spaces: bool = True) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256."""
    rows = staged(digests(docs, id_col, text_col, spaces), "digests")
    return groups(rows).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text an earlier identifier has; its columns stay as they are."""
    key, sha, other = free_names(docs, "key", "sha", "other")
    gone = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias(key), F.col("text_sha256").alias(other)).distinct()
    own = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    # by text as well: another text under the same identifier stays
    return own.join(gone, (own[id_col] == gone[key]) & (own[sha] == gone[other]), "left_anti").select(*docs.columns)
