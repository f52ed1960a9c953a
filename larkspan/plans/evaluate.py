"""The whole evaluation of a profile over labelled cases: detection, what each case expects, measures and gates.

Labelled cases have the columns of a case and label (normal or phishing), expected_level, allowed_levels,
required_rule_ids, forbidden_rule_ids; all but the label may be null. A case counts as found from ``medium`` on.

Defined results: cases that are not judged (an error code) are low and without evidence, and fail as such; a label other
than ``phishing`` is normal; without cases the counts are 0 and no gate but those of shares without rows fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators import evaluation
from larkspan.operators.scoring import active, risk
from larkspan.plans.cases import case_evidence
from larkspan.plans.profile import DEMO, Profile

EXPECTED = ("label", "expected_level", "allowed_levels", "required_rule_ids", "forbidden_rule_ids")


def details(cases: DataFrame, profile: Profile = DEMO, key: str = "case_id") -> DataFrame:
    """key, label, input_type, error_code, level, score, hits (sorted), failures, passed, actual, positive of every case; no shuffle."""
    kinds = {c: "array<string>" if c.endswith(("ids", "levels")) else "string" for c in EXPECTED}
    missing = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in cases.columns}
    kept = cases.withColumns({**missing, "kind_of_input": F.col("input_type")})
    found = case_evidence(kept, profile, key, (*EXPECTED, "kind_of_input"))
    hits = F.array_sort(F.array_distinct(F.transform(active(F.col("evidence")), lambda e: e["rule_id"])))
    rows = found.select(key, *EXPECTED, F.col("kind_of_input").alias("input_type"), "error_code", risk(F.col("evidence")).alias("risk"), hits.alias("hits"))
    rows = rows.select(key, *EXPECTED, "input_type", "error_code", "risk.level", "risk.score", "hits")
    failures = evaluation.case_failures(*[F.col(c) for c in ("label", "level", "expected_level", "allowed_levels", "required_rule_ids", "forbidden_rule_ids", "hits")])
    failures = F.when(F.col("error_code").isNotNull(), F.array(F.concat(F.lit("error:"), F.col("error_code")))).otherwise(failures)
    rows = rows.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)
    return rows.select(
        key, "label", "input_type", "error_code", "level", "score", "hits", "failures", "passed",
        F.coalesce(F.col("label") == "phishing", F.lit(False)).alias("actual"), (F.col("level") != "low").alias("positive"),
    )


def summary(found: DataFrame) -> DataFrame:
    """One row of details(): the measures of evaluation.confusion(), contract_pass_rate, failed_gates, passed."""
    contract = F.coalesce(F.bround(F.count_if("passed") / F.nullif(F.count(F.lit(1)), F.lit(0)), 6), F.lit(0.0))
    return evaluation.quality_gates(evaluation.confusion(found, "actual", "positive", contract_pass_rate=contract))
