"""Two evaluation runs against each other, requested samples, and whether a run's counts close.

Predictions are rows (run_id, pos, sample_id, actual, predicted); manifests one row a run. Whether two runs judged the
same samples is decided by sums of hashes, with and without the place of a sample, so that neither a sort nor a
join of all rows is needed; only where they differ exceptAll() finds the rows. Samples under one identifier count as
often as they occur.

Defined results: null identifiers are a value like others; a run without predictions has counts of 0 and no shares;
runs that a manifest lacks fail the gate ``manifest``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What two manifests must agree on.
SHARED = ("split", "seed", "max_samples", "total_evaluated", "data_sha256", "selection_mode")
SHARES = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")


def _digest(*columns: Column | str) -> list[Column]:
    """A sum of two hashes each, as decimals: equal for equal multisets of rows, in any order and of any number of parts."""
    one = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return [F.coalesce(one(seed), F.lit(0).cast("decimal(38,0)")) for seed in (11, 12)]


def fingerprints(predictions: DataFrame) -> DataFrame:
    """run_id, n, samples (of the multiset of identifiers), places (of identifiers with their place): one aggregation."""
    return predictions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.array(*_digest("sample_id")).alias("samples"), F.array(*_digest("pos", "sample_id")).alias("places")
    )


def measured(predictions: DataFrame) -> DataFrame:
    """run_id, tp, tn, fp, fn and the shares (null where nothing is divided by)."""
    a, p = F.col("actual"), F.col("predicted")
    rows = predictions.groupBy("run_id").agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn")
    )
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    share = lambda x, whole: F.when(whole > 0, x / whole)
    return rows.select(
        "*",
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        share(fp, fp + tn).alias("fpr"),
        share(fn, fn + tp).alias("fnr"),
    )


def points(base: Column, other: Column) -> Column:
    """other - base in percentage points, to two places; what rounds to nothing is 0, null where one is missing."""
    d = (other - base) * 100.0
    return F.when(F.abs(d) < 0.005, 0.0).otherwise(F.bround(d, 2))


def compared(manifests: DataFrame, predictions: DataFrame, requested: DataFrame, base: str, other: str) -> DataFrame:
    """One row: the gates that fail, both runs' counts and shares, and the differences, other - base.

    ``manifests``: run_id, strategy, llm_invalid_reason, llm_evaluation_valid and the fields of ``SHARED``. ``requested``: run_id,
    pos, sample_id. The base run must be one of rules alone that asked no model, the other a hybrid whose use of the
    model is valid; both must agree on the shared fields, the samples in their order and the requested ones in theirs.
    """
    pair = F.col("run_id").isin(base, other)
    judged = predictions.filter(pair)
    facts = fingerprints(judged).join(measured(judged), "run_id")
    asked = fingerprints(requested.filter(pair)).select("run_id", F.col("places").alias("asked"))
    whole = manifests.filter(pair).withColumn("named", F.lit(True)).join(facts, "run_id", "full_outer").join(asked, "run_id", "left")
    fields = ["named", "strategy", "llm_invalid_reason", "llm_evaluation_valid", *SHARED, "n", "samples", "places", "asked", "tp", "tn", "fp", "fn", *SHARES]
    # two rows at most are left: one of them, and the other beside it
    one = lambda run, side: F.first(F.when(F.col("run_id") == run, F.struct(*fields)), ignorenulls=True).alias(side)
    row = whole.agg(one(base, "b"), one(other, "o"))
    b, o = (lambda k: F.col(f"b.{k}")), (lambda k: F.col(f"o.{k}"))
    number = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    gates = {
        "manifest": b("named").isNotNull() & o("named").isNotNull(),
        "base_strategy": b("strategy") == "rule_only",
        "base_asked_no_model": b("llm_invalid_reason") == "not_requested",
        "other_strategy": o("strategy") == "hybrid",
        "other_valid": o("llm_evaluation_valid"),
        **{k: b(k).eqNullSafe(o(k)) for k in SHARED},
        "counted": (number(b("n")) == number(b("total_evaluated"))) & (number(o("n")) == number(o("total_evaluated"))),
        "samples": b("samples").eqNullSafe(o("samples")),
        "sample_order": b("places").eqNullSafe(o("places")),
        "requested": b("asked").eqNullSafe(o("asked")),
        "measured": (number(b("n")) > 0) & (number(o("n")) > 0),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items()]))
    counts = [c for k in ("tp", "tn", "fp", "fn") for c in (number(b(k)).alias(f"base_{k}"), number(o(k)).alias(f"other_{k}"), (number(o(k)) - number(b(k))).alias(f"{k}_change"))]
    shares = [c for k in SHARES for c in (F.bround(b(k), 6).alias(f"base_{k}"), F.bround(o(k), 6).alias(f"other_{k}"), points(b(k), o(k)).alias(f"{k}_points"))]
    return row.select(failed.alias("failed_gates"), (F.size(failed) == 0).alias("comparable"), *counts, *shares)


def sample_differences(predictions: DataFrame, base: str, other: str) -> DataFrame:
    """sample_id, side (base or other), n: samples that one run has more often than the other. Empty at the cost of one aggregation where there are none."""
    marks = {r["run_id"]: (r["n"], r["samples"]) for r in fingerprints(predictions.filter(F.col("run_id").isin(base, other))).collect()}
    of = lambda run: predictions.filter(F.col("run_id") == run).select("sample_id")
    if marks.get(base) == marks.get(other):
        return of(base).limit(0).select("sample_id", F.lit("base").alias("side"), F.lit(0).cast("long").alias("n"))
    more = [of(x).exceptAll(of(y)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).select("sample_id", F.lit(side).alias("side"), "n") for x, y, side in ((base, other, "base"), (other, base, "other"))]
    return more[0].unionByName(more[1])


def requested_samples(samples: DataFrame, requested: DataFrame, split: str | None = None) -> DataFrame:
    """pos, sample_id, status of every request in its place, with the sample's columns where it is ``found``.

    status: repeated (an earlier request has it), unknown (no sample), wrong_split, ambiguous (several samples of the split),
    found. ``samples`` has sample_id and, if ``split`` is given, split.
    """
    own = samples.withColumn("fits", F.lit(True) if split is None else F.coalesce(F.col("split") == split, F.lit(False)))
    facts = own.groupBy("sample_id").agg(F.count_if("fits").alias("fitting"))
    firsts = requested.groupBy("sample_id").agg(F.min("pos").alias("first"))
    rows = requested.select("pos", "sample_id").join(firsts, "sample_id").join(facts, "sample_id", "left")
    status = (
        F.when(F.col("pos") > F.col("first"), "repeated").when(F.col("fitting").isNull(), "unknown").when(F.col("fitting") == 0, "wrong_split").when(F.col("fitting") > 1, "ambiguous").otherwise("found")
    )
    rows = rows.select("pos", "sample_id", status.alias("status"))
    only = own.filter("fits").drop("fits")
    kept = rows.filter("status = 'found'").join(only, "sample_id").select("pos", "sample_id", "status", *[c for c in only.columns if c != "sample_id"])
    return kept.unionByName(rows.filter("status <> 'found'"), allowMissingColumns=True)


# Telemetry --------------------------------------------------------------------------------------------------------------

COUNTS = (
    "sample_requested", "usable_response", "terminal_validation_failure", "terminal_transport_failure", "deterministic_fallback",
    "request_attempt", "http_success", "http_error", "latency_sample", "cache_hit",
)


@dataclass(frozen=True)
class Invariant:
    """Two sums of counts and how they must stand to each other (``=`` or ``>=``)."""

    name: str
    left: tuple[str, ...]
    relation: str
    right: tuple[str, ...]


INVARIANTS = (
    Invariant("every_sample_requested", ("sample_requested",), "=", ("total_evaluated",)),
    Invariant("every_request_ends", ("usable_response", "terminal_validation_failure", "terminal_transport_failure"), "=", ("sample_requested",)),
    Invariant("attempts_cover_requests", ("request_attempt", "cache_hit"), ">=", ("sample_requested",)),
    Invariant("attempts_end_once", ("request_attempt",), "=", ("http_success", "http_error")),
    Invariant("every_attempt_is_timed", ("latency_sample",), "=", ("request_attempt",)),
    Invariant("usable_were_answered", ("http_success", "cache_hit"), ">=", ("usable_response",)),
)


def telemetry(calls: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the counts of ``COUNTS`` from calls: sample_id, attempt (null: from the cache), http_ok, latency_ms, outcome.

    outcome, on the last call of a sample: usable, validation_failure, transport_failure, fallback.
    """
    last = lambda name: F.count_if(F.col("outcome") == name)
    sent = F.col("attempt").isNotNull()
    return calls.groupBy(*by).agg(
        F.count_distinct("sample_id").alias("sample_requested"), last("usable").alias("usable_response"), last("validation_failure").alias("terminal_validation_failure"),
        last("transport_failure").alias("terminal_transport_failure"), last("fallback").alias("deterministic_fallback"), F.count_if(sent).alias("request_attempt"),
        F.count_if(sent & F.col("http_ok")).alias("http_success"), F.count_if(sent & ~F.coalesce("http_ok", F.lit(False))).alias("http_error"),
        F.count_if(sent & F.col("latency_ms").isNotNull()).alias("latency_sample"), F.count_if(~sent).alias("cache_hit"),
    )


def closed(stats: DataFrame) -> DataFrame:
    """``stats`` (counts of ``COUNTS``, total_evaluated, llm_requested, llm_configured) with invariants, broken, llm_invalid_reason, llm_evaluation_valid.

    invariants: each with the sums of both sides and whether it holds; broken: the names of those that do not, and
    ``counts_are_numbers`` if a count is null or negative. The first that applies is the reason: not_requested,
    not_configured, not_active (no call was made), terminal_llm_failure, deterministic_fallback_used, count_mismatch; else empty.
    A total of 0 or null is not compared.
    """
    total = lambda names: sum((F.coalesce(F.col(k).cast("long"), F.lit(0)) for k in names), F.lit(0).cast("long"))

    def stated(i: Invariant) -> Column:
        left, right = total(i.left), total(i.right)
        holds = left == right if i.relation == "=" else left >= right
        if "total_evaluated" in i.right:
            holds = holds | (right <= 0)
        return F.struct(F.lit(i.name).alias("name"), left.alias("left_side"), F.lit(i.relation).alias("relation"), right.alias("right_side"), holds.alias("holds"))

    numbers = F.forall(F.array(*[F.coalesce(F.col(k) >= 0, F.lit(False)) for k in COUNTS]), lambda ok: ok)
    rows = stats.withColumn("invariants", F.array(*[stated(i) for i in INVARIANTS]))
    wrong = F.transform(F.filter("invariants", lambda x: ~x["holds"]), lambda x: x["name"])
    rows = rows.withColumn("broken", F.when(numbers, wrong).otherwise(F.array_append(wrong, F.lit("counts_are_numbers"))))
    no = lambda k: ~F.coalesce(F.col(k), F.lit(False))
    some = lambda *names: F.greatest(*[F.coalesce(F.col(k), F.lit(0)) for k in names], F.lit(0)) > 0
    reason = (
        F.when(no("llm_requested"), "not_requested")
        .when(no("llm_configured"), "not_configured")
        .when(~some("request_attempt", "cache_hit"), "not_active")
        .when(some("terminal_validation_failure", "terminal_transport_failure"), "terminal_llm_failure")
        .when(some("deterministic_fallback"), "deterministic_fallback_used")
        .when((F.size("broken") > 0) | ~some("sample_requested"), "count_mismatch")
        .otherwise("")
    )
    return rows.withColumn("llm_invalid_reason", reason).withColumn("llm_evaluation_valid", F.col("llm_invalid_reason") == "")


def remarkable_samples(results: DataFrame) -> DataFrame:
    """The samples of a run that a model did not simply answer at once, one row each: retried, failed, or with values put right.

    ``results``: sample_id, llm_status, null_normalized, enum_normalized (counts), null_paths, enum_paths (arrays). Adds paths, the first three.
    Of rows under one identifier that with the greatest status stays.
    """
    asked = F.col("llm_status").isNotNull() & ~F.col("llm_status").isin("not_requested", "not_configured")
    mended = (F.coalesce("null_normalized", F.lit(0)) > 0) | (F.coalesce("enum_normalized", F.lit(0)) > 0)
    empty = F.array().cast("array<string>")
    paths = F.slice(F.concat(F.coalesce("null_paths", empty), F.coalesce("enum_paths", empty)), 1, 3)
    rows = results.filter(asked & (mended | (F.col("llm_status") != "usable_first_attempt"))).withColumn("paths", paths)
    others = [c for c in rows.columns if c not in ("sample_id", "llm_status")]
    one = rows.groupBy("sample_id").agg(F.max_by(F.struct("llm_status", *others), F.struct("llm_status", "null_normalized", "enum_normalized")).alias("x"))
    return one.select("sample_id", "x.*")
