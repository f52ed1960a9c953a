"""Cases of every kind, hosts in Unicode, settings and answers of language models."""

import time

import pytest
from pyspark.sql import functions as F

from larkspan import catalogue_cases
from larkspan.functions import text as T
from larkspan.functions import urls as U
from larkspan.operators import rules, semantic
from larkspan.plans import cases as C
from larkspan.plans import profile as P

PROFILE = P.Profile(official_domains=("acme.com",), brand_words=("acme",), wording={"URGENT_VERIFY_WORDING": ("verify now",)}, confusables=(("é", "e"),))


def first(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("c")).first()["c"]


def test_cases(spark):
    schema = "case_id string, input_text string, input_type string, base_url string, sender string, attachments array<string>, qr_urls array<string>, ocr_text string"
    rows = [
        ("blank", " ", "text", None, None, None, None, None),
        ("kind", "x", "fax", None, None, None, None, None),
        ("many", "x", "text", None, None, ["a.exe"] * 51, None, None),
        ("mail", "please v e r i f y n o w http://acme-login.net/login and http://acme-login.net:80/login 网络中心", "email", None, "Acme login <a@evil.net>", ["b.pdf.exe"], ["https://q.net/login"], None),
        ("own", "verify now https://acme.com/a", "email", None, "A <a@acme.com>", None, None, None),
        ("read", "hello", "text", None, None, None, None, "verify&#32;now"),
        ("page", '<form action="http://acme.com/p"><input type=password></form><a href="/x">y</a>', "html", "https://acme.com/", None, None, None, None),
    ]
    table = spark.createDataFrame(rows, schema)
    got = {r.case_id: r for r in C.case_evidence(table, PROFILE).collect()}
    assert [got[k].error_code for k in ("blank", "kind", "many", "mail")] == ["EMPTY_INPUT", "INVALID_INPUT_TYPE", "INVALID_CONTEXT", None]
    assert not got["many"].evidence and not got["blank"].urls
    ids = lambda k: {e["rule_id"] for e in got[k].evidence}
    assert [u["subject"] for u in got["mail"].urls] == ["url:0", "qr:0"]
    assert ids("mail") >= {"URGENT_VERIFY_WORDING", "URL_NON_HTTPS", "DOMAIN_KEYWORD_IMPERSONATION", "EMAIL_SENDER_IMPERSONATION", "ATTACHMENT_DOUBLE_EXTENSION", "QR_CREDENTIAL_URL"}
    assert [e["context"] for e in got["own"].evidence if e["rule_id"] == "URGENT_VERIFY_WORDING"] == [0.2]
    assert ids("read") == {"URGENT_VERIFY_WORDING"}
    assert ids("page") >= {"HTML_PASSWORD_INPUT", "FORM_NON_HTTPS_ACTION", "URL_NON_HTTPS"}
    assert [u["kind"] for u in got["page"].urls] == ["a", "form", "base"]
    risks = {r.case_id: r for r in C.case_risks(table, PROFILE).collect()}
    assert risks["mail"].level in ("high", "critical") and risks["blank"].level == "low" and risks["mail"].n_suppressed >= 1


def test_punycode_by_its_decoded_form(spark):
    assert first(spark, U.decoded_host(F.col("h")), h="xn--acm-dma.com") == "acmé.com"
    for host, expected in (("xn--acm-dma.com", True), ("xn--mnchen-3ya.de", False), ("acme.com", False)):
        found = first(spark, rules.gathered(rules.url_evidence(F.col("u"), PROFILE)), u=f"https://{host}/")
        assert ("DOMAIN_PUNYCODE_SUSPICIOUS" in [e["rule_id"] for e in found]) is expected


def test_all_layers_of_a_name(spark):
    name = "x" + ".a" * 60 + ".exe"
    assert first(spark, T.extension_layers(F.col("n")), n=name)[0] == "exe"


def test_long_addresses(spark):
    for host, expected in (("[::1]", False), ("[fe80::1]", False), ("[fd00::1]", False), ("[2600::1]", True), ("8.8.8.8", True), ("100.64.0.1", True), ("198.51.100.7", False)):
        assert first(spark, U.public_ip(F.col("h")), h=host) is expected


def test_suffixes_of_any_length(spark):
    assert first(spark, U.registered_domain(F.col("h"), ("co.uk", "a.b.co.uk")), h="x.y.a.b.co.uk") == "y.a.b.co.uk"


def test_settings():
    made = P.profile_of({"official_domains": ["a.org"], "wording": {"URGENT_VERIFY_WORDING": ["now"]}, "port_exceptions": {"a.org": [81]}})
    assert made.official_domains == ("a.org",) and made.port_exceptions == (("a.org", (81,)),)
    with pytest.raises(ValueError):
        P.profile_of({"colour": 1})
    assert P.suppressions({"A": ["B"], "C": {"suppresses": ["D"], "scope": "global"}}) == [("A", "B", False), ("C", "D", True)]
    with pytest.raises(ValueError):
        P.checked_scoring((0, 30, 61, 80), P.TOPS, P.FACTORS, P.CAPS, 0.75, 0.8)


def test_null_paths_of_an_answer(spark):
    answer = '{"sender": {"address": "a"}, "urls": [{"text": "x"}, {}], "content": {"greeting": "g"}, "overall_impression": "o"}'
    found = first(spark, semantic.null_paths(F.from_json("j", semantic.RAW_FEATURES)), j=answer)
    assert found == sorted(
        [f"raw_features.sender.{k}" for k in ("display_name", "reply_to", "claimed_identity", "notes")]
        + ["raw_features.urls[0].registered_domain", "raw_features.urls[1].registered_domain", "raw_features.urls[1].text", "raw_features.content.signature"]
    )


def test_many_addresses_in_a_text(spark):
    own = [f"http://h{k}.example/{k % 7}" for k in range(4000)]
    text = " ".join([*own, "HTTP://H5.example:80/5", *own])
    started = time.monotonic()
    assert first(spark, U.in_text(F.col("t")), t=text) == own
    assert time.monotonic() - started < 20


def test_plan_of_all_cases_stays_small(spark, sf_dir):
    found = catalogue_cases.case_context_evidence(spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flattened(") == 1
    assert len(plan) < 500_000


def kinds(found):
    return sorted((e["rule_id"], e["subject"]) for e in found)


def judged(spark, profile=PROFILE, **case):
    fields = {"case_id": "string", **C.TYPES}
    row = {"case_id": "c", "input_type": "text", **case}
    table = spark.createDataFrame([tuple(row.get(k) for k in fields)], ", ".join(f"{k} {t}" for k, t in fields.items()))
    return C.case_evidence(table, profile).first()


def test_plain_http_is_weak_evidence(spark):
    found = {e["subject"]: e["confidence"] for e in judged(spark, input_text="see http://other.com/news and https://other.com/x").evidence if e["rule_id"] == "URL_NON_HTTPS"}
    assert found == {"url:0": 0.30}
    page = judged(spark, input_text='<form action="http://f.com/x"></form><a href="http://g.com/login">a</a>', input_type="html", base_url="https://h.com/")
    assert {e["subject"]: e["confidence"] for e in page.evidence if e["rule_id"] == "URL_NON_HTTPS"} == {"url:0": 0.75, "url:1": 0.55}


def test_each_attachment_and_code_gives_its_own_evidence(spark):
    got = judged(
        spark, input_text="x", attachments=["a.pdf.exe", "b.txt", "c.js", "d.tar.gz.scr"],
        qr_urls=["tel:123", "plain words", "https://x.net/login", "https://acme.com/login", "https://y.net/%6Cogin", "https://z.net/?a=&#112;assword", "https://w.net/v"],
    )
    assert kinds(e for e in got.evidence if e["rule_id"].startswith("ATTACHMENT")) == [
        ("ATTACHMENT_DOUBLE_EXTENSION", "attachment:0"), ("ATTACHMENT_DOUBLE_EXTENSION", "attachment:3"),
        ("ATTACHMENT_EXECUTABLE", "attachment:0"), ("ATTACHMENT_EXECUTABLE", "attachment:2"), ("ATTACHMENT_EXECUTABLE", "attachment:3"),
    ]
    assert kinds(e for e in got.evidence if e["rule_id"].startswith("QR_")) == [
        ("QR_CODE_EXTERNAL_URL", "qr:2"), ("QR_CODE_EXTERNAL_URL", "qr:4"), ("QR_CODE_EXTERNAL_URL", "qr:5"), ("QR_CODE_EXTERNAL_URL", "qr:6"),
        ("QR_CREDENTIAL_URL", "qr:2"), ("QR_CREDENTIAL_URL", "qr:4"), ("QR_CREDENTIAL_URL", "qr:5"),
    ]


@pytest.mark.parametrize(
    ("sender", "text", "rules_of_sender"),
    [
        ("x@evil.net", "The ACME 教务处 asks https://evil.net/a", ["EMAIL_SENDER_IMPERSONATION"]),
        ("x@evil.net", "Acme asks", []),
        ("Acme 教务处 login <x@evil.net>", "hello", []),
        ("x@acme.com", "Acme 教务处", []),
        ("x@evil.net", "acme: see https://other.org/", ["EMAIL_SENDER_LINK_MISMATCH"]),
        ("x@evil.net", "hello https://other.org/", []),
    ],
)
def test_senders_are_judged_by_the_text(spark, sender, text, rules_of_sender):
    found = judged(spark, input_text=text, input_type="email", sender=sender).evidence
    assert [e["rule_id"] for e in found if e["subject"] == "sender:0"] == rules_of_sender


def test_redirects(spark):
    got = judged(spark, input_text='<meta http-equiv="Refresh" content="0; URL=\'/next\'"><p>x', input_type="html", base_url="https://h.com/a")
    assert [(u["url"], u["kind"]) for u in got.urls] == [("https://h.com/next", "meta"), ("https://h.com/a", "base")]
    assert "JS_LOCATION_REDIRECT" in {e["rule_id"] for e in judged(spark, input_text="window.location&#61;1", input_type="sms").evidence}
    page = judged(spark, input_text="<script>top.location = 'x'</script>", input_type="html").evidence
    assert [e["rule_id"] for e in page].count("JS_LOCATION_REDIRECT") == 1


def test_forbidden_field_of_a_trusted_service(spark):
    own = P.Profile(trusted_services=(("survey", ("forms.net",), ("email",), ("password", "bank_card")), ("second", ("net",), (), ("token",))))
    form = '<form action="https://a.{d}/p"><input name={n} type={t}></form>'
    get = lambda d, n, t: {e["rule_id"] for e in judged(spark, own, input_text=form.format(d=d, n=n, t=t), input_type="html", base_url="https://h.com/").evidence}
    assert "TRUSTED_SERVICE_FORBIDDEN_FIELD" in get("forms.net", "x", "password") and "FORM_COLLECTS_SECRET" not in get("forms.net", "x", "password")
    assert "TRUSTED_SERVICE_FORBIDDEN_FIELD" in get("forms.net", "my_bank_card", "text")
    assert "TRUSTED_SERVICE_FORBIDDEN_FIELD" not in get("forms.net", "token", "text")
    assert "TRUSTED_SERVICE_FORBIDDEN_FIELD" in get("other.net", "token", "text")
    assert "TRUSTED_SERVICE_FORBIDDEN_FIELD" not in get("other.org", "x", "password") and "FORM_COLLECTS_SECRET" in get("other.org", "x", "password")


@pytest.mark.parametrize(
    ("text", "words", "sentence"),
    [
        ("see a.com now. then verify", ("verify",), 0),
        ("one! two?\n\n  verify", ("verify",), 2),
        ("first quick! then verify", ("verify", "quick"), 1),
        ("first quick! then v e​r i f y", ("quick", "verify"), 0),
        ("veri!fy", ("verify",), 0),
        ("nothing", ("verify",), 0),
    ],
)
def test_sentence_of_the_first_word_of_the_list(spark, text, words, sentence):
    assert first(spark, T.first_sentence_with_spread(F.col("t"), words), t=text) == sentence


@pytest.mark.parametrize(("text", "sentence"), [("One. two? within", 2), ("one... when it was. within", 1), ("two! 。within", 1), ("when", 0), ("none. here", -1)])
def test_full_stops_end_sentences_of_texts(spark, text, sentence):
    assert first(spark, T.first_sentence_with(F.col("t"), ("within", "when")), t=text) == sentence


def test_case_plans_hand_rows_to_python_by_bytes(spark):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf, None)
    spark.conf.unset(conf)
    try:
        C.prepared(spark.createDataFrame([("a", "x", "sms")], "case_id string, input_text string, input_type string"))
        assert int(spark.conf.get(conf)) == 4 << 20
    finally:
        if before is not None:
            spark.conf.set(conf, before)
