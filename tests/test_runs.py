"""Comparison of runs, requested samples, telemetry, the rule registry, and images with their texts."""

import pytest
from pyspark.sql import functions as F

from larkspan.operators import runs
from larkspan.operators.scoring import risk
from larkspan.plans.registry import Registry
from larkspan.sources import readers

MANIFEST = "run_id string, strategy string, llm_invalid_reason string, llm_evaluation_valid boolean, split string, seed int, max_samples int, total_evaluated long, data_sha256 string, selection_mode string"
GOOD = [("r", "rule_only", "not_requested", False, "blind", 42, None, 4, "ab", "all"), ("h", "hybrid", "", True, "blind", 42, None, 4, "ab", "all")]
PREDICTED = "run_id string, pos int, sample_id string, actual boolean, predicted boolean"
RULES = [("r", 0, "a", True, True), ("r", 1, "b", True, False), ("r", 2, "c", False, True), ("r", 3, "c", False, False)]
HYBRID = [("h", 0, "a", True, True), ("h", 1, "b", True, True), ("h", 2, "c", False, False), ("h", 3, "c", False, False)]


def compared(spark, manifests=GOOD, base=RULES, other=HYBRID, asked=()):
    made = spark.createDataFrame(manifests, MANIFEST), spark.createDataFrame([*base, *other], PREDICTED), spark.createDataFrame(list(asked), "run_id string, pos int, sample_id string")
    rows = runs.compared(*made, "r", "h").collect()
    assert len(rows) == 1
    return rows[0]


def test_runs_of_the_same_samples_compare(spark):
    got = compared(spark)
    assert got.comparable and got.failed_gates == []
    assert (got.base_tp, got.other_tp, got.tp_change, got.fp_change, got.fn_change) == (1, 2, 1, -1, -1)
    assert (got.base_accuracy, got.other_accuracy, got.accuracy_points, got.fpr_points, got.recall_points) == (0.5, 1.0, 50.0, -50.0, 50.0)
    assert got.base_precision == 0.5 and got.precision_points == 50.0


def changed(rows, k, **values):
    names = [c.split()[0] for c in (MANIFEST if len(rows[0]) == 10 else PREDICTED).split(", ")]
    return [tuple(values.get(n, v) if i == k else v for n, v in zip(names, r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(
    ("case", "gates"),
    [
        ({"manifests": changed(GOOD, 0, strategy="hybrid")}, ["base_strategy"]),
        ({"manifests": changed(GOOD, 0, llm_invalid_reason=None)}, ["base_asked_no_model"]),
        ({"manifests": changed(GOOD, 1, llm_evaluation_valid=None, seed=7)}, ["other_valid", "seed"]),
        ({"manifests": changed(GOOD, 1, max_samples=9)}, ["max_samples"]),
        ({"manifests": changed(changed(GOOD, 1, total_evaluated=5), 0, total_evaluated=5)}, ["counted"]),
        ({"other": changed(changed(HYBRID, 0, sample_id="b"), 1, sample_id="a")}, ["sample_order"]),
        ({"other": changed(HYBRID, 3, sample_id="d")}, ["samples", "sample_order"]),
        ({"other": changed(HYBRID, 3, sample_id=None)}, ["samples", "sample_order"]),
        ({"asked": [("r", 0, "a"), ("h", 0, "b")]}, ["requested"]),
        ({"asked": [("r", 0, "a"), ("h", 0, "a")]}, []),
        ({"manifests": GOOD[:1]}, ["manifest", "other_strategy", "other_valid", "split", "seed", "total_evaluated", "data_sha256", "selection_mode", "counted"]),
    ],
)
def test_gates(spark, case, gates):
    assert compared(spark, **case).failed_gates == gates


def test_runs_without_predictions(spark):
    got = compared(spark, base=[], other=[])
    assert got.failed_gates == ["counted", "measured"] and got.base_tp == 0 and got.base_f1 is None and got.f1_points is None


def test_differences_count_repeated_samples(spark):
    make = lambda other: spark.createDataFrame([*RULES, *other], PREDICTED)
    assert runs.sample_differences(make(HYBRID[::-1]), "r", "h").collect() == []
    other = [*changed(HYBRID, 3, sample_id="a"), ("h", 4, None, True, True)]
    got = sorted(((r.sample_id, r.side, r.n) for r in runs.sample_differences(make(other), "r", "h").collect()), key=str)
    assert got == [("a", "other", 1), ("c", "base", 1), (None, "other", 1)]


def test_requested_samples_in_their_order(spark):
    samples = spark.createDataFrame([("a", "blind", 1), ("b", "dev", 2), ("c", "blind", 3), ("c", "blind", 4), ("d", "blind", 5), ("d", "dev", 6)], "sample_id string, split string, v int")
    asked = spark.createDataFrame([(0, "d"), (1, "a"), (2, "x"), (3, "a"), (4, "b"), (5, "c")], "pos int, sample_id string")
    got = [(r.pos, r.sample_id, r.status, r.v) for r in runs.requested_samples(samples, asked, "blind").orderBy("pos").collect()]
    assert got == [(0, "d", "found", 5), (1, "a", "found", 1), (2, "x", "unknown", None), (3, "a", "repeated", None), (4, "b", "wrong_split", None), (5, "c", "ambiguous", None)]


FINE = {"sample_requested": 10, "usable_response": 10, "terminal_validation_failure": 0, "terminal_transport_failure": 0, "deterministic_fallback": 0, "request_attempt": 11, "http_success": 9, "http_error": 2, "latency_sample": 11, "cache_hit": 1}
ASKED = {"total_evaluated": 10, "llm_requested": True, "llm_configured": True}


@pytest.mark.parametrize(
    ("change", "reason", "broken"),
    [
        ({}, "", []),
        ({"total_evaluated": 0}, "", []),
        ({"llm_requested": False}, "not_requested", []),
        ({"llm_configured": None}, "not_configured", []),
        ({"request_attempt": 0, "cache_hit": 0}, "not_active", None),
        ({"terminal_validation_failure": 1, "usable_response": 9}, "terminal_llm_failure", []),
        ({"deterministic_fallback": 1}, "deterministic_fallback_used", []),
        ({"total_evaluated": 11}, "count_mismatch", ["every_sample_requested"]),
        ({"usable_response": 9}, "count_mismatch", ["every_request_ends"]),
        ({"request_attempt": 8, "http_success": 6, "latency_sample": 8}, "count_mismatch", ["attempts_cover_requests", "usable_were_answered"]),
        ({"http_error": 1}, "count_mismatch", ["attempts_end_once"]),
        ({"latency_sample": 10}, "count_mismatch", ["every_attempt_is_timed"]),
        ({"http_success": 8, "http_error": 3, "cache_hit": 1}, "count_mismatch", ["usable_were_answered"]),
        ({"http_error": None}, "count_mismatch", ["attempts_end_once", "counts_are_numbers"]),
        ({"deterministic_fallback": -1}, "count_mismatch", ["counts_are_numbers"]),
    ],
)
def test_telemetry_closes(spark, change, reason, broken):
    row = {**FINE, **ASKED, **change}
    kinds = ", ".join(f"{k} {'boolean' if k.startswith('llm') else 'long'}" for k in row)
    got = runs.closed(spark.createDataFrame([tuple(row.values())], kinds)).first()
    assert got.llm_invalid_reason == reason and got.llm_evaluation_valid is (reason == "")
    assert broken is None or got.broken == broken
    sides = {x.name: (x.left_side, x.right_side) for x in got.invariants}
    assert sides["attempts_end_once"] == (row["request_attempt"], (row["http_success"] or 0) + (row["http_error"] or 0))


def test_remarkable_samples(spark):
    rows = [("a", "usable_first_attempt", 0, None, None, None), ("b", "usable_first_attempt", 2, 0, ["x", "y"], ["z", "w"]), ("c", "recovered", 0, 0, None, None), ("d", "not_requested", 3, 0, None, None), ("e", None, 1, 1, None, None), ("c", "recovered", 0, 0, None, None)]
    table = spark.createDataFrame(rows, "sample_id string, llm_status string, null_normalized int, enum_normalized int, null_paths array<string>, enum_paths array<string>")
    assert sorted((r.sample_id, r.llm_status, tuple(r.paths)) for r in runs.remarkable_samples(table).collect()) == [("b", "usable_first_attempt", ("x", "y", "z")), ("c", "recovered", ())]


def test_registry_isolates_a_failing_rule(spark):
    own = Registry()

    @own.register("RATIO", ("identity", "high", 30, 0.9))
    def ratio(c, attempt):
        return attempt.divide(c["a"], c["b"]) > 2

    @own.register("URL_NON_HTTPS")
    def plain(c, attempt):
        return c["t"].startswith("http:")

    @own.register("THIRD", ("social", "low", 5, 0.5))
    def third(c, attempt):
        return (attempt.element(c["xs"], 2) == "z") | (attempt.cast(c["t"], "int") == 5)

    @own.register("OFF", ("social", "low", 5, 0.5), enabled=False)
    def off(c, attempt):
        return attempt.divide(c["a"], c["a"] - c["a"]) > 0

    rows = [(1, 6.0, 2.0, "http://a", ["x", "y", "z"]), (2, 6.0, 0.0, "5", ["x", "y", "z"]), (3, None, 0.0, "http://b", ["x"]), (4, 1.0, 1.0, None, None), (5, 9.0, 1.0, "6", ["x", "y", None])]
    cases = spark.createDataFrame(rows, "case_id int, a double, b double, t string, xs array<string>")
    got = {r.case_id: ([e.rule_id for e in r.evidence], r.warnings) for r in own.run(cases).collect()}
    assert got == {
        1: (["RATIO", "URL_NON_HTTPS"], ["RULE_ERROR:THIRD"]),
        2: (["THIRD"], ["RULE_ERROR:RATIO"]),
        3: (["URL_NON_HTTPS"], ["RULE_ERROR:THIRD"]),
        4: ([], []),
        5: (["RATIO"], []),
    }
    scored = own.run(cases).select("case_id", risk(F.col("evidence")).alias("r")).select("case_id", "r.score").collect()
    assert {r.case_id for r in scored if r.score > 0} == {1, 2, 3, 5}
    on = own.switched({"OFF": True, "RATIO": False}).run(cases).filter("case_id = 1").first()
    assert on.warnings == ["RULE_ERROR:THIRD", "RULE_ERROR:OFF"] and [e.rule_id for e in on.evidence] == ["URL_NON_HTTPS"]
    assert Registry().run(cases).first().evidence == []


def test_registry_refuses_what_it_cannot_run():
    own = Registry()
    own.register("URL_NON_HTTPS")(lambda c, attempt: F.lit(True))
    for name, definition in (("URL_NON_HTTPS", None), ("small", ("social", "low", 1, 0.5)), ("UNKNOWN", None), ("ODD", ("nowhere", "low", 1, 0.5)), ("ODD", ("social", "low", 1, 1.5))):
        with pytest.raises(ValueError):
            own.register(name, definition)
    with pytest.raises(ValueError):
        own.switched({"NONE": True})


def test_operations_of_an_attempt(spark):
    own = Registry()
    define = ("social", "low", 5, 0.5)
    own.register("JSON", define)(lambda c, attempt: attempt.parse_json(c["t"], "a int")["a"] == 1)
    own.register("DECODED", define)(lambda c, attempt: attempt.url_decode(c["t"]) == "a b")
    own.register("SUM", define)(lambda c, attempt: attempt.add(c["n"], F.lit(2**62)) > 0)
    own.register("PRODUCT", define)(lambda c, attempt: attempt.multiply(c["n"], F.lit(2)) > 0)
    cases = spark.createDataFrame([(1, '{"a": 1}', 1), (2, "a%20b", 2**62), (3, "%zz", None), (4, None, 0)], "case_id int, t string, n long")
    got = {r.case_id: ([e.rule_id for e in r.evidence], r.warnings) for r in own.run(cases).collect()}
    assert got == {
        1: (["JSON", "SUM", "PRODUCT"], []),
        2: (["DECODED"], ["RULE_ERROR:JSON", "RULE_ERROR:SUM", "RULE_ERROR:PRODUCT"]),
        3: ([], ["RULE_ERROR:JSON", "RULE_ERROR:DECODED"]),
        4: (["SUM"], []),
    }


def test_images_with_their_texts(spark, tmp_path):
    images, truths = tmp_path / "i", tmp_path / "t"
    images.mkdir(), truths.mkdir()
    for name in ("a.png", "b.JPG", "c.webp", "d.gif", "e.f.png"):
        (images / name).write_bytes(b"\x89PNG")
    for name, text in (("a.text", "second"), ("a.txt", "﻿first \n"), ("a.gt.txt", "third"), ("b.gt.txt", " b "), ("e.f.text", "e"), ("x.txt", "none")):
        (truths / name).write_text(text, encoding="utf-8")
    got = {r.image: (r.ground_truth, r.missing) for r in readers.images_with_truth(spark, str(images), str(truths)).collect()}
    assert got == {"a.png": ("first", False), "b.JPG": ("b", False), "c.webp": (None, True), "e.f.png": ("e", False)}
