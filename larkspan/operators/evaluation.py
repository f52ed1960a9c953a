"""Metrics of predictions: confusion counts, intervals, latencies, error rates of recognised text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import urls as U

Z95 = 1.96


def _share(part: Column, whole: Column) -> Column:
    return F.bround(F.when(whole == 0, 0.0).otherwise(part / whole), 6)


def confusion(rows: DataFrame, actual: str, predicted: str, **more: Column) -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy, precision, recall, f1, false_positive_rate (0 where undefined), and ``more`` aggregates under their names."""
    a, p = F.col(actual), F.col(predicted)
    others = [c.alias(k) for k, c in more.items()]
    counts = rows.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn"), *others)
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "tp", "fp", "tn", "fn",
        _share(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _share(fp, fp + tn).alias("false_positive_rate"),
        *more,
    )


def wilson(hits: Column, n: Column) -> Column:
    """struct(low, high): the 95 % Wilson interval of a share, to six digits; 0 without rows."""
    p, z2 = hits / n, Z95 * Z95
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.struct(
        F.when(n == 0, 0.0).otherwise(F.bround(F.greatest(middle - half, F.lit(0.0)), 6)).alias("low"),
        F.when(n == 0, 0.0).otherwise(F.bround(F.least(middle + half, F.lit(1.0)), 6)).alias("high"),
    )


def latencies(rows: DataFrame, column: str) -> DataFrame:
    """One row: n, total, average, p50, p95 (interpolated), largest."""
    c = F.col(column)
    return rows.agg(
        F.count(c).alias("n"),
        F.sum(c).alias("total"),
        F.coalesce(F.bround(F.sum(c) / F.count(c), 2), F.lit(0.0)).alias("average"),
        F.percentile(c, 0.5).alias("p50"),
        F.percentile(c, 0.95).alias("p95"),
        F.max(c).alias("largest"),
    )


def indexed_latencies(rows: DataFrame, column: str) -> DataFrame:
    """One row: n, p50, p95 as values that occur: those at positions n/2 and 0.95 n of the sorted values.

    The positions come from counts of the different values, so that no task sorts all of them.
    """
    counted = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).first()[0]
    if total is None:
        return rows.sparkSession.sql("SELECT 0L AS n, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p95")
    # percentile_disc at (k + 1) / n is the value at position k from 0
    at = lambda k: f"percentile_disc({(k + 0.5) / total}D) WITHIN GROUP (ORDER BY CAST({column} AS DOUBLE))"
    return rows.agg(F.count(column).alias("n"), F.expr(at(total // 2)).alias("p50"), F.expr(at(min(int(total * 0.95), total - 1))).alias("p95"))


def conservative(rows: DataFrame, actual: str, predicted: str, succeeded: str) -> DataFrame:
    """One row of counts and shares (four digits, null where undefined); a failed prediction counts as wrong."""
    a = F.col(actual)
    p = F.when(F.coalesce(F.col(succeeded), F.lit(False)), F.col(predicted)).otherwise(~a)
    n = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(a & p).alias("tp"),
        F.count_if(~a & ~p).alias("tn"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"),
        F.count_if(~F.coalesce(F.col(succeeded), F.lit(False))).alias("failed"),
    )
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    both = (tp + fn > 0) & (tn + fp > 0)
    share = lambda part, whole: F.when(both & (whole > 0), F.bround(part / whole, 4))
    return n.select(
        "total", "tp", "tn", "fp", "fn",
        F.when(F.col("total") > 0, F.bround((tp + tn) / F.col("total"), 4)).otherwise(0.0).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        F.when(both, F.when(tp == 0, 0.0).otherwise(F.bround(2 * tp / (2 * tp + fp + fn), 4))).alias("f1"),
        share(tn, tn + fp).alias("specificity"),
        share(fp, fp + tn).alias("fpr"),
        share(fn, fn + tp).alias("fnr"),
        F.when(F.col("total") > 0, F.bround(F.col("failed") / F.col("total"), 4)).otherwise(0.0).alias("failure_rate"),
    )


# Bounds of the quality gates.
GATES = {"precision": 0.95, "recall": 0.75, "f1": 0.85, "false_positive_rate": 0.05, "contract_pass_rate": 1.0}


def quality_gates(metrics: DataFrame) -> DataFrame:
    """``metrics`` (a row of confusion() with contract_pass_rate) with the names of the gates that fail, and whether all pass."""
    failing = [F.when(F.col(k) > bound if k == "false_positive_rate" else F.col(k) < bound, k) for k, bound in GATES.items()]
    return metrics.withColumn("failed_gates", F.array_compact(F.array(*failing))).withColumn("passed", F.size("failed_gates") == 0)


def hit_counts(evidence: DataFrame, by: str, case: str = "case_id") -> DataFrame:
    """by, hits, cases, rank: rows and cases of each rule or group, the most frequent first, ties by name."""
    counts = evidence.groupBy(by).agg(F.count(F.lit(1)).alias("hits"), F.countDistinct(case).alias("cases"))
    from pyspark.sql import Window

    # one row a rule or group: a few rows in one task
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), by)))


def by_kind(details: DataFrame, kind: str, actual: str, predicted: str, passed: str) -> DataFrame:
    """kind, n, n_positive, correct, passed of each kind of input."""
    return details.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(predicted)).alias("n_positive"), F.count_if(F.col(actual) == F.col(predicted)).alias("correct"), F.count_if(F.col(passed)).alias("passed")
    )


def errors(details: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The wrong rows with their kind: FP or FN."""
    a, p = F.col(actual), F.col(predicted)
    return details.filter(a != p).withColumn("kind", F.when(p, "FP").otherwise("FN"))


def top_contributions(points: dict[str, Column], most: int = 3) -> Column:
    """The names of the ``most`` largest values, largest first, ties by name; nulls take no part."""
    items = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct((-v.cast("double")).alias("v"), F.lit(k).alias("k"))) for k, v in points.items()]))
    return F.transform(F.slice(F.array_sort(items), 1, most), lambda x: x["k"])

def stratified(rows: DataFrame, label: str, id_col: str, per_label: int, seed: int = 42) -> DataFrame:
    """``per_label`` rows of each label in the order of a hash of seed and identifier."""
    from pyspark.sql import Window

    order = Window.partitionBy(label).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col)
    return rows.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= per_label)


def bootstrap_f1(rows: DataFrame, actual: str, predicted: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """low, high: the 95 % interval of F1 over resamples. The four confusion counts are all that a resample needs."""
    counts = rows.select(
        F.count_if(F.col(actual) & F.col(predicted)).alias("tp"),
        F.count_if(~F.col(actual) & F.col(predicted)).alias("fp"),
        F.count_if(~F.col(actual) & ~F.col(predicted)).alias("tn"),
        F.count_if(F.col(actual) & ~F.col(predicted)).alias("fn"),
    )

    def draw(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                n = np.array([row.tp, row.fp, row.tn, row.fn], dtype=float)
                if not n.sum():
                    yield pd.DataFrame({"low": [0.0], "high": [0.0]})
                    continue
                tp, fp, _, fn = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), rounds).T
                f1 = np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0)
                yield pd.DataFrame({"low": [float(np.quantile(f1, 0.025))], "high": [float(np.quantile(f1, 0.975))]})

    return counts.mapInPandas(draw, "low double, high double")


def character_error_rate(found: Column, truth: Column) -> Column:
    """Edit distance by the truth's length; for an empty truth 0 or 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(found) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(found, truth) / F.length(truth))


def word_error_rate(found: Column, truth: Column) -> Column:
    """Edit distance of tokens by the truth's number of them: characters without spaces where either text has ideographs, else words.

    Every different word of a pair stands for one character of the private planes, so that the built-in distance of
    strings is that of words.
    """
    ideographs = F.concat(found, truth).rlike("[\\x{4E00}-\\x{9FFF}]")
    bare = lambda c: F.regexp_replace(c, "[ \\n]", "")
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(c, "\\s+", " ")), " "), lambda w: w != "")
    known = F.array_distinct(F.concat(words(found), words(truth)))
    coded = lambda c: F.array_join(F.transform(words(c), lambda w: _symbol(F.array_position(known, w))), "")
    rate = lambda a, b: F.when(F.length(b) == 0, F.when(F.length(a) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(b))
    return F.when(ideographs, rate(bare(found), bare(truth))).otherwise(rate(coded(found), coded(truth)))


def _symbol(number: Column) -> Column:
    """A character for each number from 1: UTF-32 bytes from U+10000 on."""
    return F.decode(F.unhex(F.lpad(F.hex(number + 0x10000), 8, "0")), "UTF-32")


_URL = "(?i)(https?://[^\\s<>\"'{}\\[\\]()（）\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]*)"


def text_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_URL))


def url_accuracy(found: Column, truth: Column) -> Column:
    """struct(n_truth, n_found, exact, domains, protocols, tlds): the URLs of two texts, compared one by one where their numbers agree."""
    a, b = text_urls(found), text_urls(truth)
    part = lambda u: U.parts(u)
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    last = lambda host: F.regexp_extract(host, "([^.]*)$", 1)
    every = lambda test: F.forall(pairs, lambda x: test(part(x["a"]), part(x["b"]), x))
    none, same = F.size(b) == 0, F.size(a) == F.size(b)
    return F.struct(
        F.size(b).alias("n_truth"),
        F.size(a).alias("n_found"),
        (none | (same & F.forall(pairs, lambda x: x["a"] == x["b"]))).alias("exact"),
        (none | (same & every(lambda p, q, x: p["host"] == q["host"]))).alias("domains"),
        (none | ~same | every(lambda p, q, x: p["scheme"] == q["scheme"])).alias("protocols"),
        (none | ~same | every(lambda p, q, x: last(p["host"]) == last(q["host"]))).alias("tlds"),
    )


# Characters that may become their half-width form.
_WIDE, _NARROW = "：．／＼＠ｈｔｐｓ", ":./\\@htps"


def fabricated(raw: Column, corrected: Column) -> Column:
    """For each pair of URLs of the two texts the characters of the corrected one that the raw one has in no width, sorted."""
    pairs = F.slice(F.arrays_zip(text_urls(raw).alias("a"), text_urls(corrected).alias("b")), 1, F.least(F.size(text_urls(raw)), F.size(text_urls(corrected))))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(pairs, lambda x: F.array_sort(F.array_except(letters(x["b"]), F.concat(letters(x["a"]), letters(F.translate(x["a"], _WIDE, _NARROW))))))


def recognition_summary(rows: DataFrame, found: str, truth: str, raw: str) -> DataFrame:
    """One row: n, average, least and largest character and word error rates, shares of exact URLs and domains, violations."""
    f, t = F.col(found), F.col(truth)
    each = rows.select(
        character_error_rate(f, t).alias("cer"), word_error_rate(f, t).alias("wer"), url_accuracy(f, t).alias("u"), F.size(F.filter(fabricated(F.col(raw), f), lambda x: F.size(x) > 0)).alias("v")
    )
    n = F.count(F.lit(1))
    digits = lambda c, k: F.coalesce(F.bround(c, k), F.lit(0.0))
    of = lambda c: [digits(F.avg(c), 6).alias(f"{c}_average"), digits(F.min(c), 6).alias(f"{c}_least"), digits(F.max(c), 6).alias(f"{c}_largest")]
    return each.agg(
        n.alias("n"), *of("cer"), *of("wer"), digits(F.count_if("u.exact") / n, 4).alias("url_exact_rate"), digits(F.count_if("u.domains") / n, 4).alias("url_domain_rate"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("violations"), F.count_if(F.col("v") > 0).alias("images_with_violations"),
    )


def case_failures(label: Column, level: Column, expected: Column, allowed: Column, required: Column, forbidden: Column, hits: Column) -> Column:
    """Names of the expectations that a case fails. An expected level is a lower bound and goes before a list of allowed ones."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), c), F.lit(0))
    empty = F.array().cast("array<string>")
    asked, allowed = F.coalesce(expected, F.lit("")) != "", F.coalesce(allowed, empty)
    missing = F.array_sort(F.array_except(F.coalesce(required, empty), hits))
    present = F.array_sort(F.array_intersect(F.coalesce(forbidden, empty), hits))
    named = lambda kind, ids: F.transform(ids, lambda r: F.concat(F.lit(f"{kind}:"), r))
    one = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(empty)
    return F.concat(
        one(asked & (rank(level) < rank(expected)), "level below expected"),
        one(~asked & (F.size(allowed) > 0) & ~F.array_contains(allowed, level), "level not allowed"),
        named("missing", missing),
        named("forbidden", present),
        one((label == "normal") & (level != "low"), "normal above low"),
        one((label == "phishing") & (F.size(hits) == 0), "phishing without evidence"),
    )


def contract_failures(level_rank: Column, expected_rank: Column, hits: Column, required: Column, forbidden: Column) -> Column:
    """Names of the expectations that a case fails."""
    return F.array_compact(
        F.array(
            F.when(level_rank < expected_rank, "level"),
            F.when(F.size(F.array_except(required, hits)) > 0, "required"),
            F.when(F.arrays_overlap(forbidden, hits), "forbidden"),
        )
    )
