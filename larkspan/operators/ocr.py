"""Quality gates and reading order of recognised text blocks (image_id, block_id, text, confidence, x, y, width, height)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.scoring import let

SURE = 0.5


def quality(blocks: DataFrame) -> DataFrame:
    """image_id, n_blocks, average, uncertain_ratio, n_chars, abnormal_ratio, fragmentation, score, status.

    Hard gates decide first; then a composite of confidence, certainty, length, unusual characters and broken URLs.
    """
    low = F.col("confidence") < SURE
    rows = blocks.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        (F.sum(F.rint(F.col("confidence") * 1e6)) / 1e6 / F.count(F.lit(1))).alias("average"),
        (F.count_if(low) / F.count(F.lit(1))).alias("uncertain_ratio"),
        F.sum(F.length("text")).alias("n_chars"),
        F.sum(F.length(F.regexp_replace("text", _USUAL, ""))).alias("unusual"),
        F.count_if(_linked("text")).alias("linked"),
        F.count_if(_linked("text") & F.col("text").rlike("(?i)\\s+[a-z]{2,3}\\b")).alias("broken"),
    )
    rows = rows.withColumn("abnormal_ratio", F.col("unusual") / F.greatest("n_chars", F.lit(1))).withColumn("fragmentation", F.when(F.col("linked") > 0, F.col("broken") / F.col("linked")).otherwise(0.0))
    return rows.withColumn("score", composite(F.col("average"), F.col("uncertain_ratio"), F.col("n_chars"), F.col("abnormal_ratio"), F.col("fragmentation"))).withColumn(
        "status", status(F.col("average"), F.col("uncertain_ratio"), F.col("n_blocks"), F.col("score"))
    ).drop("unusual", "linked", "broken")


#: Characters that are no sign of a bad reading: ASCII, ideographs, and punctuation of their scripts.
_USUAL = "[\\x00-\\x7F\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}“”‘’—…]"


def _linked(column: str) -> Column:
    return F.col(column).rlike("(?i)https?://|www\\.|[a-z]+\\.[a-z]{2,}")


def composite(average: Column, uncertain: Column, n_chars: Column, abnormal: Column, fragmentation: Column) -> Column:
    one = F.lit(1.0)
    parts = ((0.25, F.least(average / 0.70, one)), (0.25, 1 - uncertain), (0.20, F.least(n_chars / 20.0, one)), (0.15, F.greatest(1 - abnormal * 3, F.lit(0.0))), (0.15, 1 - fragmentation))
    return F.bround(sum((weight * part for weight, part in parts), F.lit(0.0)), 4)


def status(average: Column, uncertain: Column, n: Column, score: Column) -> Column:
    return (
        F.when((n == 0) | (average < 0.15) | (uncertain >= 0.95), "insufficient_evidence")
        .when((average < 0.35) | (uncertain >= 0.80), "low_confidence")
        .when(score < 0.25, "insufficient_evidence")
        .when(score < 0.45, "low_confidence")
        .when(score < 0.65, "usable_with_warnings")
        .otherwise("reliable")
    )


def reading_order(blocks: DataFrame, width: float) -> DataFrame:
    """Adds column_no and reading_order for images of ``width``.

    Where the places of three blocks or more spread by over a quarter of the width, a block that lies further
    right of the one before it than twice the median gap opens a new column. Columns are read one by one, from the top.
    """
    image, by_id = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("block_id", "x", "y")
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("image_id").orderBy("x", "block_id", "y"))
    rows = blocks.withColumn("gap", gap).withColumn("step", F.col("x") - F.lag("x").over(by_id))
    spread = (F.count(F.lit(1)).over(image) >= 3) & (F.stddev_pop("x").over(image) > 0.25 * width)
    rows = rows.withColumn("opens", F.when(spread & (F.col("step") > 2 * F.percentile("gap", 0.5).over(image)), 1).otherwise(0))
    rows = rows.withColumn("column_no", F.sum("opens").over(by_id.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("column_no", "y", "block_id", "x"))
    return rows.withColumn("reading_order", order).drop("gap", "step", "opens")


def position(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Where in an image a point lies, by thirds."""
    across = F.when(x / width < 0.33, "left").when(x / width > 0.67, "right").otherwise("middle")
    down = F.when(y / height < 0.33, "top").when(y / height > 0.67, "bottom").otherwise("centre")
    return F.concat_ws(" ", down, across)


# Words that read like a bare domain by chance.
CHANCE_DOMAINS = ("the.com", "is.com", "at.com", "or.com", "in.net", "to.com", "be.org", "of.com", "no.com", "go.com")


def _tail_kind(tail: Column) -> Column:
    """Whether what follows a scheme's name is one mark that reads like a colon, perhaps a slash, and then a name of two characters or more.

    The first character of the name stands beside the mark; the rest of it is a run of letters, digits, dots, hyphens and white space.
    """
    joined = F.regexp_replace(tail, "\\s+", "")
    marked = joined.rlike("^[:;JjI|/\\\\]/?[a-zA-Z0-9]")
    behind = F.regexp_replace(tail, "^\\s*[:;JjI|/\\\\](?:\\s*/)?\\s*.", "")
    name = F.rtrim(F.regexp_extract(behind, "([a-zA-Z0-9][-a-zA-Z0-9\\s.]*)", 1), F.lit(" \t\r\n.-"))
    return marked & (F.length(name) >= 2)


def url_candidate(text: Column) -> Column:
    """struct(candidate, reason, malformed, prefix): whether a block of text may be a URL, also a damaged one.

    A block is taken apart at the names of schemes; what follows each, up to the end, tells whether its prefix is damaged. Else a
    block is a candidate for a www without its dot, for a whole URL, or for a domain at its end.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)^\\s+|\\s+$", "")
    schemes = F.regexp_extract_all(text, F.lit("(?i)\\b(https?)"), F.lit(1))
    pieces = F.split(text, "(?i)\\bhttps?", -1)
    tails = F.transform(schemes, lambda s, k: F.array_join(F.slice(pieces, k + 2, F.size(pieces)), "http"))
    broken = let(F.transform(tails, _tail_kind), lambda flags: F.array_position(flags, True).cast("int"))
    web, site = text.rlike("(?i)https?://\\S{3}"), text.rlike("(?i)www\\.[a-z0-9]\\S")
    pathless = F.regexp_replace(text, "([a-zA-Z0-9][-a-zA-Z0-9]*\\.[a-zA-Z]{2,})[/?#]\\S*$", "$1")
    last = F.regexp_extract(pathless, "([a-zA-Z0-9][-a-zA-Z0-9]*\\.[a-zA-Z]{2,})$", 1)
    ends = F.when(pathless == text, (F.length(last) >= 5) & ~F.lower(last).isin(*CHANCE_DOMAINS)).otherwise(last != "")

    def judged(at: Column) -> Column:
        kind = (
            F.when(F.length(text) < 3, "")
            .when(at > 0, "damaged_http_prefix")
            .when(text.rlike("(?i)\\bwww[\\s:;]+[a-z0-9]"), "www_prefix_damaged")
            .when(web | site, "standard_url_pattern")
            .when(ends, "bare_domain")
            .otherwise("")
        )
        first = F.when(web & (~site | (F.regexp_instr(text, F.lit("(?i)https?://\\S{3}")) <= F.regexp_instr(text, F.lit("(?i)www\\.[a-z0-9]\\S")))), "http").otherwise("www")
        return let(kind, lambda r: F.struct(
            (r != "").alias("candidate"),
            r.alias("reason"),
            r.isin("damaged_http_prefix", "www_prefix_damaged").alias("malformed"),
            F.when(r == "damaged_http_prefix", F.lower(F.get(schemes, at - 1))).when(r == "www_prefix_damaged", "www").when(r == "standard_url_pattern", first).alias("prefix"),
        ))

    return let(broken, judged)
