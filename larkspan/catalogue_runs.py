"""Queries of comparison of runs, requested samples, closure of telemetry and rules by registry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.catalogue import query, table
from larkspan.operators import runs
from larkspan.plans.registry import Attempt, Registry

BASE, OTHER = "base", "other"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as samples of two runs; one run has a few more samples, one of them twice."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("actual"))
    k = F.col("doc_id")
    base = labels.select(F.lit(BASE).alias("run_id"), k.alias("pos"), (k % 100_000).alias("sample_id"), "actual", (k % 3 == 0).alias("predicted"))
    other = labels.select(F.lit(OTHER).alias("run_id"), k.alias("pos"), F.when(k % 50 == 7, k + 1_000_000).when(k % 50 == 8, F.lit(-5)).otherwise(k % 100_000).alias("sample_id"), "actual", (k % 4 == 0).alias("predicted"))
    return base.unionByName(other)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("total_evaluated"))
    row = lambda run, strategy, reason, valid, seed: n.select(
        F.lit(run).alias("run_id"), F.lit(strategy).alias("strategy"), F.lit(reason).alias("llm_invalid_reason"), F.lit(valid).alias("llm_evaluation_valid"), F.lit("blind").alias("split"),
        F.lit(seed).alias("seed"), F.lit(None).cast("int").alias("max_samples"), "total_evaluated", F.lit("ab").alias("data_sha256"), F.lit("all").alias("selection_mode"),
    )
    return row(BASE, "rule_only", "not_requested", False, 42).unionByName(row(OTHER, "hybrid", "", True, 43))


_PRED = """p AS (
  SELECT 'base' AS run_id, doc_id AS pos, doc_id % 100000 AS sample_id, toxic = 1 AS actual, doc_id % 3 = 0 AS predicted FROM labels
  UNION ALL SELECT 'other', doc_id, CASE WHEN doc_id % 50 = 7 THEN doc_id + 1000000 WHEN doc_id % 50 = 8 THEN -5 ELSE doc_id % 100000 END, toxic = 1, doc_id % 4 = 0 FROM labels
)"""
_SHARES = {"accuracy": "(tp + tn) / (tp + tn + fp + fn)", "precision": "tp / nullif(tp + fp, 0)", "recall": "tp / nullif(tp + fn, 0)", "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)", "fpr": "fp / nullif(fp + tn, 0)", "fnr": "fn / nullif(fn + tp, 0)"}


@query(
    f"""WITH {_PRED},
    m AS (SELECT run_id, count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (NOT actual AND NOT predicted) AS tn, count(*) FILTER (NOT actual AND predicted) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn FROM p GROUP BY run_id),
    s AS (SELECT *, {', '.join(f'{v.replace(" / ", "::DOUBLE / ")} AS {k}' for k, v in _SHARES.items())} FROM m)
    SELECT 'seed,samples,sample_order,requested' AS failed_gates, false AS comparable,
    {', '.join(f'b.{k} AS base_{k}, o.{k} AS other_{k}, o.{k} - b.{k} AS {k}_change' for k in ('tp', 'tn', 'fp', 'fn'))},
    {', '.join(f'round_even(b.{k}, 6) AS base_{k}, round_even(o.{k}, 6) AS other_{k}, CASE WHEN abs((o.{k} - b.{k}) * 100) < 0.005 THEN 0 ELSE round_even((o.{k} - b.{k}) * 100, 2) END AS {k}_points' for k in _SHARES)}
    FROM s b, s o WHERE b.run_id = 'base' AND o.run_id = 'other'"""
)
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that keep two runs from comparison, and their differences in points."""
    own = predictions(spark, sf_dir)
    asked = own.filter(F.col("pos") % 10 == 0).select("run_id", "pos", F.when(F.col("run_id") == OTHER, F.col("pos") + 1).otherwise(F.col("pos")).alias("sample_id"))
    return runs.compared(manifests(spark, sf_dir), own, asked, BASE, OTHER).withColumn("failed_gates", F.array_join("failed_gates", ","))


@query(
    f"""WITH {_PRED}, b AS (SELECT sample_id FROM p WHERE run_id = 'base'), o AS (SELECT sample_id FROM p WHERE run_id = 'other')
    SELECT sample_id, 'base' AS side, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM o) GROUP BY sample_id
    UNION ALL SELECT sample_id, 'other', count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM b) GROUP BY sample_id"""
)
def run_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that one run has and the other has not, or less often."""
    return runs.sample_differences(predictions(spark, sf_dir), BASE, OTHER)


@query(
    """WITH samples AS (SELECT doc_id AS sample_id, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'blind' END AS split, quality FROM labels),
    asked AS (SELECT event_id AS pos, event_id * 7 % 1500 AS sample_id FROM events),
    f AS (SELECT sample_id, min(pos) AS first FROM asked GROUP BY sample_id),
    s AS (SELECT pos, sample_id, CASE WHEN pos > first THEN 'repeated' WHEN split IS NULL THEN 'unknown' WHEN split <> 'blind' THEN 'wrong_split' ELSE 'found' END AS status, quality FROM asked JOIN f USING (sample_id) LEFT JOIN samples USING (sample_id))
    SELECT pos, sample_id, status, CASE WHEN status = 'found' THEN quality END AS quality FROM s"""
)
def requested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for samples in their order: found, or why not."""
    samples = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("blind").alias("split"), "quality")
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 7 % 1500).alias("sample_id"))
    return runs.requested_samples(samples, asked, "blind").select("pos", "sample_id", "status", "quality")


_OUTCOME = "CASE WHEN user_id % 7 = 3 AND event_type = 'error' THEN 'transport_failure' WHEN user_id % 11 = 5 AND event_type = 'view' THEN 'fallback' WHEN event_id % 4 = 0 THEN 'usable' END"


@query(
    f"""WITH c AS (SELECT event_type AS kind, user_id AS s, event_id % 5 > 0 AS sent, event_type <> 'error' AS ok, value > 1 AS timed, {_OUTCOME} AS outcome FROM events),
    t AS (SELECT kind, count(DISTINCT s) AS req, count(*) FILTER (outcome = 'usable') AS us, count(*) FILTER (outcome = 'transport_failure') AS tf, count(*) FILTER (outcome = 'fallback') AS fb,
          count(*) FILTER (sent) AS att, count(*) FILTER (sent AND ok) AS suc, count(*) FILTER (sent AND NOT ok) AS err, count(*) FILTER (sent AND timed) AS lat, count(*) FILTER (NOT sent) AS hit FROM c GROUP BY kind)
    SELECT kind, CASE WHEN tf > 0 THEN 'terminal_llm_failure' WHEN fb > 0 THEN 'deterministic_fallback_used' WHEN us + tf <> req OR att + hit < req OR att <> suc + err OR lat <> att OR us > suc + hit THEN 'count_mismatch' ELSE '' END AS reason,
    concat_ws(',', CASE WHEN us + tf <> req THEN 'every_request_ends:' || us + tf || '=' || req END, CASE WHEN att + hit < req THEN 'attempts_cover_requests:' || att + hit || '>=' || req END,
      CASE WHEN att <> suc + err THEN 'attempts_end_once:' || att || '=' || suc + err END, CASE WHEN lat <> att THEN 'every_attempt_is_timed:' || lat || '=' || att END,
      CASE WHEN suc + hit < us THEN 'usable_were_answered:' || suc + hit || '>=' || us END) AS broken FROM t"""
)
def telemetry_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of calls by kind, and which of them do not close."""
    k, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    outcome = F.when((u % 7 == 3) & (kind == "error"), "transport_failure").when((u % 11 == 5) & (kind == "view"), "fallback").when(k % 4 == 0, "usable")
    calls = table(spark, sf_dir, "events").select(
        kind.alias("kind"), u.alias("sample_id"), F.when(k % 5 > 0, F.lit(1)).alias("attempt"), (kind != "error").alias("http_ok"), F.when(F.col("value") > 1, F.col("value")).alias("latency_ms"), outcome.alias("outcome")
    )
    stats = runs.telemetry(calls, ["kind"]).withColumns({"total_evaluated": F.lit(0), "llm_requested": F.lit(True), "llm_configured": F.lit(True)})
    found = runs.closed(stats)
    shown = F.transform(F.filter("invariants", lambda x: ~x["holds"]), lambda x: F.concat(x["name"], F.lit(":"), x["left_side"].cast("string"), x["relation"], x["right_side"].cast("string")))
    return found.select("kind", F.col("llm_invalid_reason").alias("reason"), F.array_join(shown, ",").alias("broken"))


def item_rules() -> Registry:
    """Rules over line items, two of which fail on some rows."""
    own = Registry()
    rule = lambda name, **more: own.register(name, ("payload", "low", 5, 0.5), **more)

    @rule("DEAR_FOR_ITS_QUANTITY")
    def _(c, attempt: Attempt):
        return attempt.divide(c["l_extendedprice"], c["l_quantity"] - 10) > 5000

    @rule("MARK_IS_A_NUMBER")
    def _(c, attempt: Attempt):
        return attempt.cast(F.when(c["l_linenumber"] % 2 == 0, c["l_returnflag"]).otherwise(c["l_linenumber"].cast("string")), "int") >= 5

    @rule("WITHOUT_DISCOUNT")
    def _(c, attempt: Attempt):
        return c["l_discount"] == 0

    @rule("SWITCHED_OFF", enabled=False)
    def _(c, attempt: Attempt):
        return F.lit(True)

    return own


@query(
    """SELECT case_id, concat_ws(',', CASE WHEN q <> 10 AND price / nullif(q - 10, 0) > 5000 THEN 'DEAR_FOR_ITS_QUANTITY' END, CASE WHEN n % 2 = 1 AND n >= 5 THEN 'MARK_IS_A_NUMBER' END, CASE WHEN discount = 0 THEN 'WITHOUT_DISCOUNT' END) AS hits,
    concat_ws(',', CASE WHEN q = 10 THEN 'RULE_ERROR:DEAR_FOR_ITS_QUANTITY' END, CASE WHEN n % 2 = 0 THEN 'RULE_ERROR:MARK_IS_A_NUMBER' END) AS warnings
    FROM (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS case_id, l_quantity AS q, l_extendedprice AS price, l_linenumber AS n, l_discount AS discount FROM lineitem)"""
)
def rule_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of registered rules, and the warnings of those that failed on a row."""
    items = table(spark, sf_dir, "lineitem").withColumn("case_id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey"))
    found = item_rules().run(items)
    return found.select("case_id", F.array_join(F.transform("evidence", lambda e: e["rule_id"]), ",").alias("hits"), F.array_join("warnings", ",").alias("warnings"))
