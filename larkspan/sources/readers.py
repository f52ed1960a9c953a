"""Readers and writers of cases, samples, text files and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CASES = (
    "case_id string, input_text string, input_type string, base_url string, sender string, attachments array<string>, "
    "qr_urls array<string>, ocr_text string, debug boolean"
)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON lines; arrays are never null."""
    rows = spark.read.schema(CASES).json(path)
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("attachments", "qr_urls")})


def samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples from a JSON document: a list, or an object with a list under ``samples``."""
    text = spark.read.text(path, wholetext=True)
    own = F.from_json("value", f"array<struct<{schema}>>")
    inner = F.from_json("value", f"struct<samples:array<struct<{schema}>>>")["samples"]
    return text.select(F.explode(F.when(F.ltrim("value").startswith("["), own).otherwise(inner)).alias("s")).select("s.*")


#: Entries of a table of confusable characters at most: the characters of Unicode.
MAX_CONFUSABLES = 0x110000


def confusables(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """Pairs (character, what it is taken for) from lines of hexadecimal code points, source ; target ; anything; other lines are skipped."""
    point = lambda x: F.conv(x, 16, 10).cast("int")
    line = r"^\s*([0-9A-Fa-f]{1,6})\s*;\s*([0-9A-Fa-f]{1,6}(?:\s+[0-9A-Fa-f]{1,6})*)\s*(?:;.*)?$"
    rows = spark.read.text(path).filter(F.col("value").rlike(line))
    rows = rows.select(point(F.regexp_extract("value", line, 1)).alias("source"), F.transform(F.split(F.regexp_extract("value", line, 2), r"\s+"), point).alias("target"))
    rows = rows.filter(F.col("source") < MAX_CONFUSABLES).filter(F.forall("target", lambda x: x < MAX_CONFUSABLES))
    # one row a character is left, so that what comes to the driver is bounded by the characters there are
    rows = rows.groupBy("source").agg(F.max("target").alias("target")).orderBy("source")
    return tuple((chr(r["source"]), "".join(map(chr, r["target"]))) for r in rows.collect())


def duplicate_ids(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _as_gb18030(data: bytes | None) -> str | None:
    try:
        return None if data is None else bytes(data).decode("gb18030")
    except UnicodeDecodeError:
        return None


@F.pandas_udf(StringType())
def _gb18030(contents: pd.Series) -> pd.Series:
    return contents.map(_as_gb18030)


def decoded(content: Column) -> Column:
    """UTF-8 text of a binary column without its byte order mark, or GB18030 text if it is not UTF-8; null if it is neither.

    Python runs only for what is not UTF-8.
    """
    text = content.cast("string")
    fine = F.is_valid_utf8(text)
    return F.regexp_replace(F.when(fine, text).otherwise(_gb18030(F.when(~fine, content))), "^﻿", "")


def image_kind(content: Column) -> Column:
    """png, jpeg, webp or null by the leading bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.rlike("^52494646.{8}57454250"), "webp")


# Suffixes of images, and those of the texts beside them, the first of which counts.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".webp")
TRUTH_SUFFIXES = (".txt", ".text", ".gt.txt")


def images_with_truth(spark: SparkSession, images: str, truths: str) -> DataFrame:
    """image (file name), image_path, truth_path, ground_truth, missing: every image of a folder with the text of the same stem.

    Of several texts the one whose suffix comes first in ``TRUTH_SUFFIXES`` counts. The bytes of images are not read; texts are UTF-8, without a mark of
    byte order and without white space at their ends. An image without a text is ``missing``.
    """
    name = F.element_at(F.split("path", "/"), -1)
    shown = "(?i)\\.(" + "|".join(s[1:] for s in IMAGE_SUFFIXES) + ")$"
    files = spark.read.format("binaryFile").load(images).select("path", name.alias("image")).filter(F.col("image").rlike(shown))
    files = files.withColumn("stem", F.regexp_replace("image", shown, ""))
    beside = spark.read.format("binaryFile").load(truths).select("path", name.alias("file"))
    # a name may be read as several stems: a.gt.txt belongs to a and to a.gt
    each = [beside.filter(F.col("file").endswith(s)).select(F.regexp_replace("file", s.replace(".", "\\.") + "$", "").alias("stem"), F.lit(k).alias("at"), "path") for k, s in enumerate(TRUTH_SUFFIXES)]
    best = each[0].unionByName(each[1]).unionByName(each[2]).groupBy("stem").agg(F.min_by("path", F.struct("at", "path")).alias("truth_path"))
    found = files.join(best, "stem", "left").select("image", F.col("path").alias("image_path"), "truth_path")
    texts = spark.read.format("binaryFile").load(truths).select(F.col("path").alias("truth_path"), F.regexp_replace(decoded(F.col("content")), "(?U)^\\s+|\\s+$", "").alias("ground_truth"))
    return found.join(texts, "truth_path", "left").select("image", "image_path", "truth_path", "ground_truth", F.col("truth_path").isNull().alias("missing"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON, without the details of single cases."""
    metrics.drop("details").write.mode("overwrite").json(path)
