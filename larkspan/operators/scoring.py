"""Scores from evidence, in two forms with equal results.

``scored_arrays`` works on an array of evidence per case with higher-order functions: no
shuffle, and it runs on a stream as it is. ``scored_rows`` works on a table of
evidence rows with joins and windows by case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions.text import let
from larkspan.plans import profile as P

EVIDENCE = "array<struct<ord:int,rule_id:string,grp:string,severity:string,base:int,confidence:double,context:double,subject:string>>"


def rule_table(spark: SparkSession) -> DataFrame:
    """rule_ix, rule_id, grp, severity, base, confidence of every rule."""
    rows = ", ".join(f"({k}, '{r}', '{g}', '{s}', {b}, {c}D)" for k, (r, g, s, b, c) in enumerate(P.RULES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule_ix, rule_id, grp, severity, base, confidence)")


def suppression_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in P.SUPPRESSES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(source_rule, rule_id)")


def effective(base: Column, confidence: Column, context: Column) -> Column:
    return F.rint(base * confidence * context).cast("int")


def _by_level(values, level: Column) -> Column:
    out = F.lit(values[-1])
    for k in range(len(values) - 2, -1, -1):
        out = F.when(level == k, F.lit(values[k])).otherwise(out)
    return out


def gated(raw: Column, most_severe: Column, high_groups: Column, any_medium: Column) -> Column:
    """struct(score, level, floor, critical_lock) from the raw score and what the evidence qualifies for.

    ``most_severe``: 0 low, 1 medium, 2 high, -1 none.
    """
    candidate = F.when(raw <= P.TOPS[0], 0).when(raw <= P.TOPS[1], 1).when(raw <= P.TOPS[2], 2).otherwise(3)
    ceiling = F.when(most_severe <= 0, 0).when((most_severe == 1) | (high_groups == 0), 1).otherwise(3)
    floor = F.when(high_groups >= 2, 3).when(high_groups == 1, 2).when(any_medium, 1).otherwise(0)
    level = F.greatest(F.least(candidate, ceiling), floor)
    score = F.greatest(_by_level(P.FLOORS, level), F.least(raw, _by_level(P.TOPS, level)))
    return F.struct(
        score.cast("int").alias("score"), _by_level(P.LEVELS, level).alias("level"), _by_level(P.LEVELS, floor).alias("floor"), (high_groups >= 2).alias("critical_lock")
    )


def active(evidence: Column, everywhere: Sequence[str] = ()) -> Column:
    """Evidence whose rule and subject no other evidence of the case suppresses; rules named in ``everywhere`` do so for any subject."""
    pairs = F.create_map(*[x for target in sorted({b for _, b in P.SUPPRESSES}) for x in (F.lit(target), F.array(*[F.lit(a) for a, b in P.SUPPRESSES if b == target]))])

    def kept(e: Column) -> Column:
        sources = F.coalesce(F.element_at(pairs, e["rule_id"]), F.array().cast("array<string>"))
        same = lambda s: s["subject"].eqNullSafe(e["subject"]) | s["rule_id"].isin(*everywhere) if everywhere else s["subject"].eqNullSafe(e["subject"])
        return ~F.exists(evidence, lambda s: F.array_contains(sources, s["rule_id"]) & same(s))

    return F.filter(evidence, kept)


def group_points(evidence: Column, group: str) -> Column:
    """The capped points of one group's active evidence."""
    cap = float(P.CAPS[group])
    own = F.filter(evidence, lambda e: e["grp"] == group)
    keyed = F.transform(own, lambda e: F.struct((-effective(e["base"], e["confidence"], e["context"])).alias("minus"), e["ord"].alias("ord")))
    factor = lambda i: F.when(i == 0, P.FACTORS[0]).when(i == 1, P.FACTORS[1]).otherwise(P.FACTORS[2])
    add_up = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def cut(scaled: Column) -> Column:
        return let(
            F.struct(add_up(scaled).alias("sum"), F.element_at(scaled, -1).alias("last")),
            lambda t: t["sum"] - t["last"] + F.greatest(t["last"] - F.greatest(t["sum"] - cap, F.lit(0.0)), F.lit(0.0)),
        )

    def limited(points: Column) -> Column:
        return let(add_up(points), lambda total: F.when(total > cap, cut(F.transform(points, lambda x: F.rint(x * (F.lit(cap) / total))))).otherwise(total))

    return let(F.transform(F.array_sort(keyed), lambda x, i: F.rint(-x["minus"] * factor(i))), limited)


def certainty(e: Column) -> Column:
    return e["confidence"] * e["context"]


def confidence_of(evidence: Column) -> Column:
    """The decision confidence of active evidence, to four digits."""
    best = lambda xs: F.coalesce(F.array_max(F.transform(xs, certainty)), F.lit(0.0))
    high = F.filter(evidence, lambda e: (e["severity"] == "high") & (certainty(e) >= P.QUALIFIED_HIGH))
    medium = F.filter(evidence, lambda e: (e["severity"] == "medium") & (certainty(e) >= P.QUALIFIED_MEDIUM))

    def chosen(f: Column) -> Column:
        weakest = F.array_min(F.transform(f["groups"], lambda g: F.array_max(F.transform(F.filter(f["high"], lambda e: e["grp"] == g), certainty))))
        return F.when(F.size(f["groups"]) >= 2, weakest).when(F.size(f["groups"]) == 1, best(f["high"])).when(F.size(f["medium"]) > 0, best(f["medium"])).otherwise(best(evidence))

    found = let(F.struct(high.alias("high"), medium.alias("medium")), lambda f: F.struct(f["high"].alias("high"), f["medium"].alias("medium"), F.array_distinct(F.transform(f["high"], lambda e: e["grp"])).alias("groups")))
    return F.bround(let(found, chosen), 4)


def risk(evidence: Column) -> Column:
    """struct(score, level, floor, critical_lock, raw, confidence) of an array of evidence (empty: low, 0)."""

    def of_active(kept: Column) -> Column:
        raw = F.lit(0.0)
        for group in P.CAPS:
            raw = raw + group_points(kept, group)
        rank = F.transform(kept, lambda e: F.when(e["severity"] == "high", 2).when(e["severity"] == "medium", 1).otherwise(0))
        high = F.filter(kept, lambda e: (e["severity"] == "high") & (certainty(e) >= P.QUALIFIED_HIGH))
        facts = F.struct(
            F.least(raw, F.lit(float(P.RAW_CAP))).cast("int").alias("raw"),
            F.coalesce(F.array_max(rank), F.lit(-1)).alias("worst"),
            F.size(F.array_distinct(F.transform(high, lambda e: e["grp"]))).alias("highs"),
            F.exists(kept, lambda e: (e["severity"] == "medium") & (certainty(e) >= P.QUALIFIED_MEDIUM)).alias("mediums"),
        )
        names = ("score", "level", "floor", "critical_lock")
        gate = let(facts, lambda f: F.struct(f["raw"].alias("raw"), gated(f["raw"], f["worst"], f["highs"], f["mediums"]).alias("g")))
        return let(gate, lambda g: F.struct(*[g["g"][n].alias(n) for n in names], g["raw"].alias("raw"), confidence_of(kept).alias("confidence")))

    return let(active(evidence), of_active)


def scored_arrays(cases: DataFrame, evidence: str = "evidence") -> DataFrame:
    """``cases`` with risk columns in place of nothing else; works on streams."""
    return cases.withColumn("risk", risk(F.col(evidence)))


def suppressed_removed(evidence: DataFrame, everywhere: Sequence[str] = ()) -> DataFrame:
    """Evidence rows without those whose (case, rule, subject) is suppressed. Not transitive: all rows may suppress.

    Rules named in ``everywhere`` suppress their targets for any subject of the case.
    """
    if everywhere:
        wide = F.broadcast(suppression_table(evidence.sparkSession).filter(F.col("source_rule").isin(*everywhere)))
        gone = evidence.select("case_id", F.col("rule_id").alias("source_rule")).join(wide, "source_rule").select("case_id", "rule_id").distinct()
        # what is removed here may still suppress others, so that both removals look at all rows
        return _suppressed_removed(evidence).join(gone, ["case_id", "rule_id"], "left_anti")
    return _suppressed_removed(evidence)


def _suppressed_removed(evidence: DataFrame) -> DataFrame:
    pairs = F.broadcast(suppression_table(evidence.sparkSession))
    targets = evidence.select("case_id", F.col("rule_id").alias("source_rule"), "subject").join(pairs, "source_rule").select("case_id", "rule_id", "subject").distinct()
    same = (evidence["case_id"] == targets["case_id"]) & (evidence["rule_id"] == targets["rule_id"]) & evidence["subject"].eqNullSafe(targets["subject"])
    return evidence.join(targets, same, "left_anti")


def attenuated(evidence: DataFrame) -> DataFrame:
    """Adds eff, rank and points (eff by its rank's factor) within case and group."""
    order = Window.partitionBy("case_id", "grp").orderBy(F.desc("eff"), "ord")
    rows = evidence.withColumn("eff", effective(F.col("base"), F.col("confidence"), F.col("context"))).withColumn("rank", F.row_number().over(order))
    factor = F.when(F.col("rank") == 1, P.FACTORS[0]).when(F.col("rank") == 2, P.FACTORS[1]).otherwise(P.FACTORS[2])
    return rows.withColumn("points", F.rint(F.col("eff") * factor))


def capped(evidence: DataFrame) -> DataFrame:
    """Adds capped: points scaled to the group's cap; the rounding overflow comes off the last one."""
    group = Window.partitionBy("case_id", "grp")
    caps = F.create_map(*[x for g, c in P.CAPS.items() for x in (F.lit(g), F.lit(float(c)))])
    rows = evidence.withColumn("cap", F.element_at(caps, F.col("grp"))).withColumn("total", F.sum("points").over(group))
    rows = rows.withColumn("scaled", F.when(F.col("total") > F.col("cap"), F.rint(F.col("points") * (F.col("cap") / F.col("total")))).otherwise(F.col("points")))
    over = F.greatest(F.sum("scaled").over(group) - F.col("cap"), F.lit(0.0))
    last = F.col("rank") == F.count(F.lit(1)).over(group)
    value = F.when(last & (F.col("total") > F.col("cap")), F.greatest(F.col("scaled") - over, F.lit(0.0))).otherwise(F.col("scaled"))
    return rows.withColumn("capped", value.cast("int")).drop("cap", "total", "scaled")


def scored_rows(evidence: DataFrame) -> DataFrame:
    """case_id, score, level, floor, critical_lock, raw of every case that has evidence."""
    kept = capped(attenuated(suppressed_removed(evidence)))
    sure = F.col("confidence") * F.col("context")
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    cases = kept.groupBy("case_id").agg(
        F.least(F.sum("capped"), F.lit(P.RAW_CAP)).cast("int").alias("raw"),
        F.max(rank).alias("worst"),
        F.size(F.collect_set(F.when((F.col("severity") == "high") & (sure >= P.QUALIFIED_HIGH), F.col("grp")))).alias("highs"),
        F.bool_or((F.col("severity") == "medium") & (sure >= P.QUALIFIED_MEDIUM)).alias("mediums"),
    )
    # a case keeps at least the evidence that suppresses the rest, so that none is lost here
    return cases.select("case_id", "raw", gated(F.col("raw"), F.col("worst"), F.col("highs"), F.col("mediums")).alias("g")).select("case_id", "raw", "g.*")
