"""Trusted URLs, repaired readings, audits of second readings and the choice between passes."""

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspan import catalogue
from larkspan.operators import ocr, readings, trust

CASES = "case_id string, content string, links array<string>, urls array<string>, link string, input_type string, ocr_quality_status string"
AUDITS = "case_id string, ord int, block_id int, selected_text string, url_verification string, deterministic_eligible boolean, malformed_candidate boolean"
GOOD = "https://good.example.com/a"


def resolved(spark, cases, audits):
    return {r.case_id: r for r in trust.resolved(spark.createDataFrame(cases, CASES), spark.createDataFrame(audits, AUDITS)).collect()}


def test_written_cases_merge_content_and_metadata(spark):
    got = resolved(
        spark,
        [
            ("all", "at http://a.com/x. and shop.xyz, http://a.com/x!", ["to http://b.com/)", None, "http://a.com/x"], ["http://c.com"], "http://d.com;", "email", None),
            ("none", None, None, None, None, "text", None),
            ("many", " ".join(f"http://h{k}.com" for k in range(80)), None, None, None, "sms", "insufficient_evidence"),
            (None, "http://a.com", None, None, None, "text", None),
        ],
        [],
    )
    assert set(got) == {"all", "none", "many"}
    assert got["all"].verified == ["http://a.com/x", "https://shop.xyz", "http://b.com/", "http://c.com", "http://d.com"]
    assert (got["all"].trust_policy, got["all"].accepted_count, got["all"].rejected_count, got["all"].candidates_seen) == ("written", 5, 0, 5)
    assert (got["none"].verified, got["none"].unverified, got["none"].candidates_seen) == ([], [], 0)
    assert got["many"].accepted_count == 80 and got["many"].verified == [f"http://h{k}.com" for k in range(50)]


def test_images_trust_audits_alone(spark):
    fine = ("verified", True, False)
    audits = [
        ("i", 3, 7, GOOD, *fine),
        ("i", 1, 5, f" {GOOD} ", *fine),
        ("i", 2, 6, "https://other.example.com", *fine),
        ("i", 4, 8, "https://x.example.com", "conflict", True, False),
        ("i", 5, 9, "not a url", "verified", None, True),
        ("i", 6, 9, None, None, True, None),
        ("unknown", 1, 1, GOOD, *fine),
        ("bad", 1, 1, GOOD, *fine),
        ("bad", 2, 2, "https://x.example.com", "unverified", True, False),
    ]
    image = [("i", f"{GOOD} http://content.com", ["http://l.com"], None, None, "email", None), ("bad", "", None, None, None, "image_ocr", "insufficient_evidence"), ("empty", "http://a.com", None, None, None, "image_ocr", None)]
    got = resolved(spark, image, audits)
    assert got["i"].trust_policy == "audited" and got["i"].verified == [GOOD, "https://other.example.com"]
    assert (got["i"].accepted_count, got["i"].rejected_count, got["i"].candidates_seen) == (3, 3, 6)
    assert [(u.url, u.reasons) for u in got["i"].unverified] == [
        ("https://x.example.com", ["not_verified"]), ("not a url", ["not_eligible", "syntax", "malformed"]), ("", ["not_verified", "empty"]),
    ]
    assert (got["bad"].verified, got["bad"].accepted_count, got["bad"].rejected_count) == ([], 0, 2)
    assert [u.reasons for u in got["bad"].unverified] == [["quality"], ["not_verified", "quality"]]
    assert (got["empty"].trust_policy, got["empty"].verified, got["empty"].candidates_seen) == ("audited", [], 0)


def test_audits_of_one_place_go_by_their_urls(spark):
    urls = [f"ftp://h{k}.org" for k in range(40)]
    cases = spark.createDataFrame([("i", None, None, None, None, "image_ocr", None)], CASES)
    audits = spark.createDataFrame([("i", 1, 1, u, "conflict", True, False) for u in urls], AUDITS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [u.url for u in trust.resolved(cases, audits.repartition(4)).first().unverified] == sorted(urls)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cases_show_all_of_their_urls(spark):
    hosts = [f"http://h{k}.com" for k in range(80)]
    cases = [("written", " ".join(hosts), None, None, None, "sms", None), ("read", None, None, None, None, "image_ocr", None)]
    audits = [("read", k, k, hosts[k // 2], ("verified", "conflict")[k % 2], True, False) for k in range(160)]
    made = trust.resolved(spark.createDataFrame(cases, CASES), spark.createDataFrame(audits, AUDITS).repartition(4), shown=None)
    got = {r.case_id: r for r in made.collect()}
    assert got["written"].verified == hosts and got["read"].verified == hosts
    assert [(u.url, u.reasons) for u in got["read"].unverified] == [(h, ["not_verified"]) for h in hosts]


def test_query_shows_all_urls_of_a_case(spark, tmp_path):
    spark.createDataFrame([(k, f"http://p{k}.example.org/") for k in (1, 4, 8)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    items = [(1 + k % 2, k, k, k % 7 + 1, float(k % 50)) for k in range(400)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    for name in ("pages", "lineitem"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    named = {r[0]: r for r in c.sql(f"SELECT case_id, accepted_count, rejected_count, verified, unverified FROM ({catalogue.oracle_sql()['trusted_urls']})").fetchall()}
    got = {r.case_id: r for r in catalogue.queries()["trusted_urls"](spark, str(tmp_path)).collect()}
    assert got[4].rejected_count > 100 and got[8].rejected_count == 200
    for k in (4, 8):
        assert len(got[k].unverified.split("|")) == got[k].rejected_count
    assert {k: tuple(r[c] for c in ("case_id", "accepted_count", "rejected_count", "verified", "unverified")) for k, r in got.items()} == named


@pytest.mark.parametrize(("url", "fine"), [(GOOD, True), ("HTTP://A.co", True), ("http://a_b.com", False), ("http://a", False), ("https://a.com:80/x", False), ("https://a.com/ x", False), ("ftp://a.com", False), ("https://a-.com", False), ("https://a.com/[x]?y#z", True), (None, False)])
def test_strict_syntax(spark, url, fine):
    assert spark.createDataFrame([(url,)], "u string").select(trust.strict(F.col("u")).alias("s")).first().s is fine


def mended(spark, text, new=readings.repaired):
    row = spark.createDataFrame([(text,)], "t string").select(new(F.col("t")).alias("r"), readings.edits(F.col("t"), new(F.col("t"))).alias("e"), readings.url_spans(F.col("t")).alias("s")).first()
    return row.r, [tuple(e) for e in row.e], [tuple(s) for s in row.s]


@pytest.mark.parametrize(
    ("raw", "new", "edits"),
    [
        (None, "", []),
        ("plain：text／x", "plain：text／x", []),
        ("http：//A.com/B", "http://a.com/B", [(4, "：", ":"), (7, "A", "a")]),
        ("HTTPS：//A.com", "HTTPS://a.com", [(5, "：", ":"), (8, "A", "a")]),
        ("see http:／／Ab.cd/E ： x", "see http://ab.cd/E ： x", [(9, "／", "/"), (10, "／", "/"), (11, "A", "a")]),
        ("https;//X.org", "https://x.org", [(5, ";", ":"), (8, "X", "x")]),
        ("  http://a.b/C http://D.e  ", "http://a.b/C http://d.e", [(20, "D", "d")]),
        ("http:/a.com", "http:/a.com", []),
        ("http:／a.com", "http:/a.com", [(5, "／", "/")]),
    ],
)
def test_repair_keeps_to_what_was_read(spark, raw, new, edits):
    got, script, _ = mended(spark, raw)
    assert got == new and script == edits
    assert not any(e[1] == "" for e in script)


def test_speculation_adds_characters_that_are_seen(spark):
    got, script, _ = mended(spark, "http:/Ab-cdxyz", readings.speculated)
    assert got == "http://ab-cd.xyz"
    assert script == [(6, "", "/"), (6, "A", "a"), (11, "", ".")]
    assert mended(spark, "http: / a.com", readings.speculated)[0] == "http://a.com"
    assert mended(spark, "abcd", lambda t: F.lit("abd"))[1] == [(2, "", "d"), (2, "cd", "")]


def test_spans_have_their_places(spark):
    assert mended(spark, "x http://a.b y ftp：//n https : //c")[2] == [(2, 12, "http://a.b"), (23, 34, "https : //c")]
    assert mended(spark, "nothing")[2] == mended(spark, None)[2] == []


def test_second_readings(spark):
    rows = [
        (1, 1, "http://a.com/x", 0.5, "http://a.com/x", 0.7),
        (1, 2, "http://a.com/x", 0.5, "http://a.com/x", 0.6),
        (1, 3, "http://a com", 0.5, "http://a.com", 0.9),
        (1, 4, "http://a.com", 0.5, "http://b.com", 0.9),
        (1, 5, "http://a.com", 0.5, "no url", 0.9),
        (1, 6, "httpsJa.com/x", 0.5, "https://a.com/x", 0.9),
        (1, 7, "just words", 0.5, "http://a.com", 0.9),
        (1, 8, "http://A.com", 0.5, None, None),
        (1, 9, None, 0.5, "http://a.com", 0.9),
    ]
    table = spark.createDataFrame(rows, "image_id int, block_id int, text string, confidence double, second_text string, second_confidence double")
    got = {r.block_id: r for r in readings.audited(table).collect()}
    assert {k: r.url_verification for k, r in got.items()} == {1: "verified", 2: "unverified", 3: "verified", 4: "conflict", 5: "unverified", 6: "unverified", 8: "unverified"}
    assert got[3].selected_text == "http://a.com" and got[8].selected_text == "http://a.com" and got[6].malformed_candidate
    assert {k for k, r in got.items() if r.deterministic_eligible} == {1, 3}
    wild = {r.block_id: r for r in readings.audited(table.withColumn("text", F.when(F.col("block_id") == 1, "http:/a.com/x").otherwise(F.col("text"))), speculative=True).collect()}
    assert got[1].deterministic_eligible and not wild[1].deterministic_eligible


def blocks(spark, rows):
    return spark.createDataFrame(rows, "image_id int, pass string, block_id int, text string, confidence double, reading_order int")


def test_passes_are_chosen_with_hysteresis(spark):
    def one(image, name, sure, text="a text of some length"):
        return (image, name, 1, text, sure, None)

    rows = [
        one(1, "safe_base", 0.7), one(1, "mild_enhanced", 0.99),
        one(2, "safe_base", 0.1, "x"), one(2, "mild_enhanced", 0.9),
        one(3, "safe_base", 0.1, "x"), one(3, "mild_enhanced", 0.1, "x"),
        one(4, "safe_base", 0.1, "x"),
        one(5, "mild_enhanced", 0.9), one(6, "raw", 0.9),
        one(7, "safe_base", 0.1, "x"), one(7, "mild_enhanced", 0.1, "xxxxxx"),
    ]
    got = {r.image_id: r for r in readings.chosen_passes(blocks(spark, rows)).collect()}
    assert {k: (r["pass"], r.reason) for k, r in got.items()} == {
        1: ("safe_base", "base_sufficient"), 2: ("mild_enhanced", "mild_better"), 3: ("safe_base", "mild_within_margin"), 4: ("safe_base", "no_mild_pass"),
        5: ("mild_enhanced", "mild_better"), 7: ("safe_base", "mild_within_margin"),
    }
    assert got[7].mild_score - got[7].base_score == pytest.approx(0.05) and got[5].base_score is None


def test_chosen_pass_is_put_together_in_order(spark):
    rows = [
        (1, "safe_base", 3, "http：//A.com", 0.9, 1), (1, "safe_base", 1, "later words of a line", 0.4, 2), (1, "safe_base", 9, None, 0.9, None), (1, "safe_base", 2, "the last", 0.9, None),
        (1, "mild_enhanced", 1, "other", 0.9, 1), (2, "mild_enhanced", 1, "", 0.0, 1),
    ]
    got = {r.image_id: r for r in readings.assembled(blocks(spark, rows)).collect()}
    assert got[1].full_text == "http：//A.com\nlater words of a line\nthe last\n" and got[1].repaired_text == "http://a.com\nlater words of a line\nthe last\n"
    assert (got[1].n_blocks, got[1].average, got[1].uncertain_ids) == (4, 0.775, [1])
    assert got[2]["pass"] in ("safe_base", "mild_enhanced")
    assert readings.assembled(blocks(spark, [])).collect() == []


def test_candidates_from_their_parts(spark):
    shown = {
        "HTTPS ; / evil": ("damaged_http_prefix", True, "https"),
        "http:a http:bc": ("damaged_http_prefix", True, "http"),
        "see https://ok.example now": ("standard_url_pattern", False, "http"),
        "www.x": ("", False, None),
        "www.xy": ("standard_url_pattern", False, "www"),
        "www : x": ("www_prefix_damaged", True, "www"),
        "the.com": ("", False, None),
        "the.com/a": ("bare_domain", False, None),
        "a.co": ("", False, None),
        "ab": ("", False, None),
    }
    rows = spark.createDataFrame([(t,) for t in shown], "t string").select("t", ocr.url_candidate(F.col("t")).alias("u")).collect()
    assert {r.t: (r.u.reason, r.u.malformed, r.u.prefix) for r in rows} == shown
