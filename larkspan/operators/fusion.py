"""Merging evidence of several detectors and fusing their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lower bounds of the fused levels, share of a language model's adjustment, cap without a critical floor.
BOUNDS = (0, 30, 60, 80)
NAMES = ("low", "medium", "high", "critical")
MOST_ADJUSTMENT = 15.0
CAP_WITHOUT_CRITICAL = 79.0


def level_rank(level: Column) -> Column:
    return F.when(level == "critical", 3).when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in NAMES]), rank + 1)


def semantic_floor(score: Column, count: Column, confidence: Column, ocr: Column) -> Column:
    """The level that a language model's verified evidence supports, as a rank."""
    enough = F.when(F.coalesce(ocr, F.lit(0.0)) >= 0.75, 2).otherwise(3)
    return F.when((score >= 85) & (count >= enough) & (confidence >= 0.65), 2).when((score >= 65) & (count >= 2) & (confidence >= 0.5), 1).otherwise(0)


def fused(rule_score: Column, rule_level: Column, rule_confidence: Column, ai_score: Column, ai_confidence: Column, ai_count: Column, ocr: Column) -> Column:
    """struct(score, level, confidence): rules lead, a language model adjusts within bounds; null scores take no part."""
    adjustment = F.coalesce(F.greatest(ai_score - 50, F.lit(0.0)) / 50 * MOST_ADJUSTMENT * ai_confidence, F.lit(0.0))
    floor = F.greatest(level_rank(rule_level), F.coalesce(semantic_floor(ai_score, ai_count, ai_confidence, ocr), F.lit(0)))
    least = F.element_at(F.array(*[F.lit(float(b)) for b in BOUNDS]), floor + 1)
    score = F.greatest(F.coalesce(rule_score, F.lit(0.0)) + adjustment, least)
    score = F.rint(F.least(score, F.when(floor == 3, 100.0).otherwise(CAP_WITHOUT_CRITICAL)))
    by_score = F.when(score >= 80, 3).when(score >= 70, 2).when(score >= 30, 1).otherwise(0)
    confidence = F.bround(F.greatest(F.coalesce(rule_confidence, F.lit(0.0)), F.coalesce(ai_confidence, F.lit(0.0)) * 0.85), 3)
    return F.struct(score.cast("int").alias("score"), level_name(F.greatest(by_score, floor)).alias("level"), confidence.alias("confidence"))


def signal_key(category: Column, text: Column) -> Column:
    return F.concat(category, F.lit(":"), F.lower(F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))))


def merged_signals(signals: DataFrame, request: str = "request_id") -> DataFrame:
    """One row per request and key: sources in first-seen order, the largest severity, the first title.

    ``signals``: request, ord, key, source, severity, title.
    """
    seen = F.array_sort(F.collect_list(F.struct("ord", "source")))
    return signals.groupBy(request, "key").agg(
        F.array_join(F.array_distinct(F.transform(seen, lambda x: x["source"])), ",").alias("sources"),
        F.max("severity").alias("severity"),
        F.min_by("title", "ord").alias("title"),
    )
