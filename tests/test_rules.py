"""Rules, scores and text functions on small cases."""

import pytest
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.functions import urls as U
from larkspan.operators import dom, evaluation, rules, scoring, semantic
from larkspan.plans import detect
from larkspan.plans import profile as P
from larkspan.sources import readers
from larkspan.streaming import detect as streaming

PROFILE = P.Profile(official_domains=("acme.com",), brand_words=("acme",), short_links=("sho.rt",), wording={"URGENT_VERIFY_WORDING": ("verify now",)})


def one(spark, column, **values):
    names = ", ".join(f"'{v}' AS {k}" for k, v in values.items()) or "1 AS x"
    return spark.sql(f"SELECT {names}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("url", "rule"),
    [
        ("http://8.8.8.8/login", "URL_IP_DOMAIN"),
        ("https://sho.rt/x", "URL_SHORT_LINK"),
        ("http://acme.com/login", "URL_NON_HTTPS"),
        ("https://acme.com:8443/", "URL_SUSPICIOUS_PORT"),
        ("https://a.b.c.d.e.other.com/", "URL_LONG_SUBDOMAIN"),
        ("https://acme.com@evil.net/", "URL_AT_SYMBOL"),
        ("https://acme.com.evil.net/", "URL_NESTED_OFFICIAL_DOMAIN"),
        ("https://acne.com/", "DOMAIN_SIMILAR_TO_OFFICIAL"),
        ("https://xn--acm-epa.com/", "DOMAIN_PUNYCODE_SUSPICIOUS"),
        ("https://acme-support.net/login", "DOMAIN_KEYWORD_IMPERSONATION"),
    ],
)
def test_url_rules_hit(spark, url, rule):
    found = one(spark, rules.gathered(rules.url_evidence(F.col("u"), PROFILE)), u=url)
    assert rule in [e["rule_id"] for e in found]


def test_confusable_hosts(spark, tmp_path):
    table = tmp_path / "confusables.txt"
    table.write_text("# comment\n0441 ;\t0063 ;\tMA\t# es\n1E96 ; 0068 0331 ; MA\nbad ; line\n\n110000 ; 0061 ; MA\n")
    pairs = readers.confusables(spark, str(table))
    assert pairs == (("\u0441", "c"), ("\u1e96", "h\u0331"))
    text = "a\u0441m\u1e96\U0001f600"
    assert one(spark, T.skeleton(F.lit(text), pairs)) == "acmh\u0331\U0001f600"
    assert one(spark, T.skeleton(F.lit(text), ())) == text
    profile = P.Profile(official_domains=("acme.com",), confusables=pairs)
    rules_of = lambda u: {e["rule_id"] for e in one(spark, rules.gathered(rules.url_evidence(F.lit(u), profile)))}
    assert "DOMAIN_HOMOGRAPH_ATTACK" in rules_of("https://a\u0441me.com/")
    assert "DOMAIN_HOMOGRAPH_ATTACK" not in rules_of("https://acme.com/") | rules_of("https://other.com/")


def test_url_rules_leave_the_official_site_alone(spark):
    assert one(spark, rules.gathered(rules.url_evidence(F.col("u"), PROFILE)), u="https://www.acme.com/news?id=3") == []


@pytest.mark.parametrize(
    ("page", "rule"),
    [
        ('<form><input type="password"></form>', "HTML_PASSWORD_INPUT"),
        ('<form action="http://x.net/a">', "FORM_NON_HTTPS_ACTION"),
        ('<meta http-equiv="refresh" content="0; url=https://x.net">', "META_REFRESH_REDIRECT"),
        ("<script>window.location = 1</script>", "JS_LOCATION_REDIRECT"),
        ('<a style="display:none" href="/x">', "HIDDEN_FORM_OR_LINK"),
        ('<iframe src="https://x.net/login">', "IFRAME_LOGIN_PAGE"),
        ("<img><img><img><img><img>", "HTML_IMAGE_ONLY_CONTENT"),
        ('<a href="https://x.net">1</a><a href="https://y.net">2</a><a href="https://z.net">3</a>', "EXTERNAL_LINK_DOMINANCE"),
    ],
)
def test_html_rules(spark, page, rule):
    found = one(spark, rules.gathered(rules.html_evidence(F.col("h"), F.lit("acme.com"), PROFILE)), h=page)
    assert [e["rule_id"] for e in found] == [rule]


def test_attachments_sender_and_qr(spark):
    names = F.array(F.lit("a.txt"), F.lit("invoice.pdf.exe"))
    found = one(spark, rules.attachment_evidence(names, PROFILE))
    assert [(e["rule_id"], e["subject"]) for e in found] == [("ATTACHMENT_EXECUTABLE", "attachment:1"), ("ATTACHMENT_DOUBLE_EXTENSION", "attachment:1")]
    found = one(spark, rules.gathered(rules.sender_evidence(F.lit("Help <x@bad.net>"), F.array(F.lit("evil.org")), F.lit("Acme 教务处: please LOGIN"), PROFILE)))
    assert [e["rule_id"] for e in found] == ["EMAIL_SENDER_IMPERSONATION", "EMAIL_SENDER_LINK_MISMATCH"]
    found = one(spark, rules.qr_evidence(F.array(F.lit("https://acme.com"), F.lit("https://x.net/login")), PROFILE))
    assert [e["subject"] for e in found] == ["qr:1", "qr:1"]


def evidence(spark, rows):
    fields = ("ord", "rule_id", "grp", "severity", "base", "confidence", "context", "subject")
    return spark.createDataFrame([([dict(zip(fields, r)) for r in rows],)], f"evidence {scoring.EVIDENCE}")


@pytest.mark.parametrize(
    ("rows", "score", "level", "raw"),
    [
        ([], 0, "low", 0),
        ([(0, "URL_NON_HTTPS", "transport", "low", 6, 0.75, 1.0, "url:0")], 4, "low", 4),
        # four items of a group: 30, 10, 2, 2 exceed the cap of 35, the overflow comes off the last
        ([(k, "X", "identity", "medium", b, 0.5, 1.0, None) for k, b in enumerate((60, 40, 20, 20))], 35, "medium", 35),
        ([(0, "A", "identity", "high", 10, 0.85, 1.0, "a"), (1, "B", "credential", "high", 10, 0.95, 1.0, "b")], 80, "critical", 18),
    ],
)
def test_array_scores(spark, rows, score, level, raw):
    got = scoring.scored_arrays(evidence(spark, rows)).first()["risk"]
    assert (got["score"], got["level"], got["raw"]) == (score, level, raw)


def test_suppression_needs_the_same_subject(spark):
    pair = lambda s: [(0, "DOMAIN_HOMOGRAPH_ATTACK", "identity", "high", 30, 1.0, 1.0, "url:0"), (1, "DOMAIN_SIMILAR_TO_OFFICIAL", "identity", "high", 25, 0.9, 1.0, s)]
    kept = lambda s: evidence(spark, pair(s)).select(F.size(scoring.active(F.col("evidence"))).alias("n")).first()["n"]
    assert (kept("url:0"), kept("url:1")) == (1, 2)


def test_text_functions(spark):
    assert one(spark, T.percent_decode(F.col("t")), t="a+b%2520c%zz") == "a+b c%zz"
    assert one(spark, T.redact_emails(F.col("t")), t="x a@b.co ab@b.co abc@b.co") == "x a*@b.co a*b@b.co a***c@b.co"
    assert one(spark, T.redact_secrets(F.col("t")), t="https://u:pw@h/?token=1&b=2") == "https://u:[REDACTED]@h/?token=[REDACTED]&b=2"
    got = one(spark, T.normalized(F.col("t"), F.lit(False)), t="ve​rify &amp; １")
    assert (got["text"], got["operations"]) == ("verify & 1", ["html_entity_decode", "unicode_nfkc", "zero_width_removed"])
    assert one(spark, F.col("t").rlike(T.spread("ab")), t="xa  by") is True
    assert one(spark, T.extension_layers(F.col("t")), t="Report.PDF.exe ") == ["exe", "pdf"]
    assert one(spark, U.registered_domain(F.col("t")), t="a.b.co.uk") == "b.co.uk"
    assert one(spark, semantic.auth_result(F.col("t"), "spf"), t="x SPF=Fail") == "fail"


def test_metrics(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False)], "a boolean, p boolean")
    m = evaluation.confusion(rows, "a", "p").first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"], m["f1"]) == (1, 0, 1, 1, 0.666667)
    low, high = evaluation.bootstrap_f1(rows, "a", "p", rounds=200).first()
    assert 0 <= low <= high <= 1


def test_profile_is_checked():
    with pytest.raises(ValueError):
        P.Profile(wording={"NO_SUCH_RULE": ("x",)})
    with pytest.raises(ValueError):
        P.Profile(official_domains=(".Example.org",))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.page_stream(spark, str(tmp_path / "in"), pages.schema.simpleString()[7:-1].replace(":", " "), 1)
    streaming.write_risks(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, detect.page_risks(pages).collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"samples": [{"id": "a"}, {"id": "b"}, {"id": "a"}]}')
    rows = readers.samples(spark, str(tmp_path / "s.json"), "id:string")
    assert [(r["id"], r["n"]) for r in readers.duplicate_ids(rows, "id").collect()] == [("a", 2)]
    assert one(spark, readers.image_kind(F.unhex(F.lit("89504E470D0A1A0A00")))) == "png"
    assert one(spark, readers.decoded(F.unhex(F.lit("EFBBBF41")))) == "A"


FORM = """<title>Acme mail</title><form action="//evil.net/in"><label for=p>Acme key</label><input id=p type=password>
<label>Bank <input name=bank_card></label><input name=email></form><a href="https://evil.net/x">www.acme.com</a><a href="https://www.acme.com/">acme.com</a>"""


def test_form_rules(spark):
    rows = spark.createDataFrame([(FORM, "https://other.org/a"), ("<input type=password>", "https://acme.com/"), (None, None)], "h string, u string")
    got = [[(e["rule_id"], e["severity"], e["subject"]) for e in r["e"]] for r in rows.select(dom.page_form_evidence(F.col("h"), F.coalesce("u", F.lit("")), PROFILE).alias("e")).collect()]
    assert got[0] == [
        ("HTML_PASSWORD_INPUT", "low", "form:0"),
        ("PASSWORD_FORM_UNTRUSTED_TARGET", "high", "form:0"),
        ("FORM_COLLECTS_SENSITIVE_INFO", "medium", "form:0"),
        ("FORM_COLLECTS_SECRET", "high", "form:0"),
        ("LINK_TEXT_HREF_MISMATCH", "high", "page:0"),
        ("PORTAL_BRAND_EXTERNAL_DOMAIN", "high", "page:0"),
    ]
    assert got[1:] == [[("HTML_PASSWORD_INPUT", "low", "page:0")], []]


def test_detect_pages_with_forms_and_links(spark):
    iframes = '<iframe src="/login/a"></iframe><iframe src="/login/b"></iframe><iframe src="/c"></iframe><form><input type=password></form><p>Verify now</p>'
    rows = spark.createDataFrame([(0, "https://other.org/a", FORM), (1, "https://other.org/a", iframes), (2, None, None)], "page_id long, url string, html string")
    e = rules.page_evidence(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")), PROFILE)
    found = [sorted(x["rule_id"] for x in r["e"]) for r in rows.orderBy("page_id").select(e.alias("e")).collect()]
    assert {"PASSWORD_FORM_UNTRUSTED_TARGET", "FORM_COLLECTS_SENSITIVE_INFO", "FORM_COLLECTS_SECRET", "LINK_TEXT_HREF_MISMATCH", "PORTAL_BRAND_EXTERNAL_DOMAIN"} <= set(found[0])
    assert found[0].count("HTML_PASSWORD_INPUT") == 1
    assert found[1] == ["FORM_COLLECTS_SECRET", "HTML_PASSWORD_INPUT", "IFRAME_LOGIN_PAGE", "IFRAME_LOGIN_PAGE", "URGENT_VERIFY_WORDING"]
    risks = {r["page_id"]: r for r in detect.page_risks(rows, PROFILE).collect()}
    assert risks[0]["level"] == "critical"
    assert risks[1]["n_evidence"] == 5
    assert risks[2]["n_evidence"] == 0


DISGUISED = ("verify&#32;now", "ve\u200brify now", "v e r i f y  n o w", "\uff56\uff45\uff52\uff49\uff46\uff59 now", "verify%20now", "veri\nfy now", "Verify now. x")


def test_disguised_wording(spark):
    rows = spark.createDataFrame([*enumerate(DISGUISED), (90, "verified now"), (91, None)], "id long, t string").withColumn("html", F.concat(F.lit("<p>"), F.col("t"), F.lit("</p>")))
    expected = [(k, 1) for k in range(len(DISGUISED))] + [(90, 0), (91, 0)]
    got = detect.message_risks(rows, "id", "t", PROFILE)
    assert sorted((r["id"], r["n_evidence"]) for r in got.collect()) == expected
    got = detect.page_risks(rows.selectExpr("id AS page_id", "'https://acme.com/' AS url", "html"), PROFILE)
    assert sorted((r["page_id"], r["n_evidence"]) for r in got.collect()) == expected


def test_messages_with_sender_attachments_and_qr(spark):
    kinds = "id long, t string, s string, l array<string>, a array<string>, q array<string>"
    rows = spark.createDataFrame([(0, "Acme 教务处 login", "Help <x@bad.net>", ["https://evil.org/"], ["a.pdf.exe"], ["https://x.net/login"]), (1, "x", None, None, None, None)], kinds)
    got = detect.message_risks(rows, "id", "t", PROFILE, sender="s", links="l", attachments="a", qr_urls="q").collect()
    assert sorted((r["id"], r["n_evidence"]) for r in got) == [(0, 6), (1, 0)]


def test_composite(spark):
    assert one(spark, semantic.composite(F.array(F.lit("urgency"), F.lit("secrecy")))) == 0
    assert one(spark, semantic.composite(F.array(F.lit("urgency"), F.lit("secrecy"), F.lit("info_request")))) == 35


def calls(df):
    """Mentions of Python functions in the physical plan's nodes that run them, by name."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    nodes = [line for line in plan.split("\n") if "ArrowEvalPython" in line]
    return {name: sum(line.count(f"{name}(") for line in nodes) for name in ("_plain", "_entities", "_nfkc")}


def test_normalization_calls_python_once(spark):
    texts = spark.createDataFrame([("a",)], "t string")
    assert sum(calls(texts.select(T.normalized(F.col("t"), F.lit(False)).alias("n"))).values()) == 1
    assert sum(calls(texts.select(T.normal_text(F.col("t")).alias("n"))).values()) == 1


@pytest.mark.parametrize(
    ("given", "text", "operations"),
    [
        (None, "", []),
        ("plain", "plain", []),
        ("a & b", "a & b", []),
        ("&amp;#38;", "&#38;", ["html_entity_decode"]),
        ("&#xFF21;%41", "AA", ["html_entity_decode", "unicode_nfkc", "url_decode"]),
        ("é", "é", []),
        ("%25e2%2580%258b+%zz", "​+%zz", ["url_decode"]),
        ("ａ​％41", "aA", ["unicode_nfkc", "zero_width_removed", "url_decode"]),
    ],
)
def test_normalized_texts(spark, given, text, operations):
    rows = spark.createDataFrame([(given,)], "t string")
    got = rows.select(T.normalized(F.col("t"), F.lit(False)).alias("n"), T.normal_text(F.col("t")).alias("m")).first()
    assert (got.n["text"], got.n["operations"], got.m) == (text, operations, text)
