"""Labelled cases of the library's own, judged by the whole plan: what each must show, and the quality gates over all."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from larkspan.plans import cases as C
from larkspan.plans import evaluate, profile

CAMPUS = dataclasses.replace(
    profile.STANDARD,
    official_domains=("campus.example",),
    brand_words=("campus", "校园卡", "统一认证"),
    confusables=(("0", "o"), ("а", "a"), ("е", "e")),
    trusted_services=(("forms", ("forms.example.net",), ("phone", "email"), ("password", "sms_code", "bank_card")),),
    port_exceptions=(("lab.campus.example", (8443,)),),
)
BAD, FINE = "phishing", "normal"


def mail(label, text, sender=None, must=(), least=None, **more):
    return {"label": label, "input_type": "email", "input_text": text, "sender": sender, "required_rule_ids": list(must), "expected_level": least, **more}


def url(label, text, must=(), least=None, **more):
    return {"label": label, "input_type": "url", "input_text": text, "base_url": text, "required_rule_ids": list(must), "expected_level": least, **more}


def page(label, text, base, must=(), least=None, **more):
    return {"label": label, "input_type": "html", "input_text": text, "base_url": base, "required_rule_ids": list(must), "expected_level": least, **more}


def note(label, text, must=(), least=None, kind="sms", **more):
    return {"label": label, "input_type": kind, "input_text": text, "required_rule_ids": list(must), "expected_level": least, **more}


ADDRESSES = [
    ("https://campus.example@evil.example.org/login", ["URL_AT_SYMBOL"]),
    ("https://campus.example.evil.example.org/", ["URL_NESTED_OFFICIAL_DOMAIN"]),
    ("https://evil.example.org/campus.example/login", ["URL_NESTED_OFFICIAL_DOMAIN"]),
    ("https://cammpus.com/login", ["DOMAIN_SIMILAR_TO_OFFICIAL"]),
    ("https://canpus.net/verify", ["DOMAIN_SIMILAR_TO_OFFICIAL"]),
    ("https://campus-help.com/login", ["DOMAIN_SIMILAR_TO_OFFICIAL"]),
    ("https://cаmpus.example/", ["DOMAIN_HOMOGRAPH_ATTACK"]),
    ("https://my.cаmpus.example/login", []),
    ("http://8.8.8.8/login", ["URL_IP_DOMAIN", "URL_NON_HTTPS"]),
    ("https://xn--cmpus-3ve.example/login", ["DOMAIN_PUNYCODE_SUSPICIOUS"]),
]
LETTERS = [
    ("【校园卡】您的账号冻结，请在24小时内登录 http://campus-card.top/login 立即验证，提交密码", "教务处 <x@mail.evil.example.org>", ["URGENT_VERIFY_WORDING", "CREDENTIAL_REQUEST_TEXT", "ACCOUNT_DISABLE_THREAT"]),
    ("统一认证升级：请 立 即 验 证 ，打开 https://camqus.com/auth", "信息化 <admin@evil.example.org>", ["URGENT_VERIFY_WORDING"]),
    ("请回复密码以保留您的邮箱，过期作废", "help@evil.example.org", ["CREDENTIAL_REQUEST_TEXT", "TIME_LIMIT_PRESSURE"]),
    ("Campus 教务处：领取奖学金 https://gift.example.org/login 今日截止", "a@evil.example.net", ["EMAIL_SENDER_IMPERSONATION", "REWARD_OR_REFUND_BAIT"]),
    ("您的文件见附件", "b@evil.example.net", ["ATTACHMENT_DOUBLE_EXTENSION"]),
    ("Invoice attached", "c@evil.example.net", ["ATTACHMENT_EXECUTABLE"]),
    ("扫码领取补贴，今日内有效", "d@evil.example.net", ["QR_CREDENTIAL_URL"]),
    ("campus 网络中心通知：邮箱停用，发送验证码到本号", "e@evil.example.net", ["EMAIL_SENDER_IMPERSONATION", "CREDENTIAL_REQUEST_TEXT"]),
    ("您的账户停用，马上认证 https://campus.example.bad.example.org/cas", "f@evil.example.net", ["ACCOUNT_DISABLE_THREAT", "URL_NESTED_OFFICIAL_DOMAIN"]),
    ("验证码到后请填写密码 http://1.1.1.1/verify", None, ["CREDENTIAL_REQUEST_TEXT", "URL_IP_DOMAIN"]),
]
ATTACHED = {4: {"attachments": ["list.txt", "report.pdf.exe"]}, 5: {"attachments": ["setup.exe"]}, 6: {"qr_urls": ["https://evil.example.org/login"]}}
PAGES = [
    ('<title>Campus</title><form action="https://evil.example.org/p"><input type="password" name="p"></form><a href="/a">Campus</a><a href="/b">campus</a>', "https://evil.example.org/", ["PASSWORD_FORM_UNTRUSTED_TARGET", "PORTAL_BRAND_EXTERNAL_DOMAIN"]),
    ('<a href="https://evil.example.org/x">https://campus.example/login</a>', "https://evil.example.org/", ["LINK_TEXT_HREF_MISMATCH"]),
    ('<form action="http://evil.example.org/p"><input type="text" name="bank_card"></form>', "https://evil.example.org/", ["FORM_COLLECTS_SECRET", "FORM_NON_HTTPS_ACTION"]),
    ('<form action="https://forms.example.net/p"><input type="password" name="p"></form>', "https://forms.example.net/s", ["TRUSTED_SERVICE_FORBIDDEN_FIELD"]),
    ('<form action="https://evil.example.org/p"><input name="sms_code"></form><iframe src="/login"></iframe>', "https://evil.example.org/", ["FORM_COLLECTS_SECRET", "IFRAME_LOGIN_PAGE"]),
    ('<meta http-equiv="refresh" content="0;url=https://campus.example.evil.example.org/">', "https://short.example.org/", ["META_REFRESH_REDIRECT", "URL_NESTED_OFFICIAL_DOMAIN"]),
]
WEAK = ["您有补贴可领取", "安全中心提醒：异常登录", "https://bit.ly/x", "http://news.example.org/a"]

PLAIN = [
    "Meeting moved to room 12, see you at three.",
    "Lecture notes are at https://campus.example/notes",
    "The library closes at eight; details: https://library.campus.example/hours",
    "Thanks for the slides! https://docs.example.org/d/1",
    "明天的讨论课改到下午三点，地点不变。",
    "论文修改意见已发，请查收。",
    "食堂周末营业时间有调整。",
    "Minutes: https://wiki.example.org/minutes and https://wiki.example.org/agenda",
    "Your parcel is at the desk.",
    "Reminder: rehearsal tonight.",
]


def golden():
    rows = [url(BAD, a, must, "medium" if must else None) for a, must in ADDRESSES]
    rows += [mail(BAD, text, sender, must, "medium", **ATTACHED.get(k, {})) for k, (text, sender, must) in enumerate(LETTERS)]
    rows += [page(BAD, html, base, must, "medium") for html, base, must in PAGES]
    rows += [note(BAD, text, kind="text") for text in WEAK]
    rows += [note(FINE, text) for text in PLAIN] + [mail(FINE, text, "colleague@campus.example") for text in PLAIN]
    rows += [mail(FINE, text, "friend@other.example.org") for text in PLAIN]
    rows += [url(FINE, u) for u in ("https://campus.example/", "https://lab.campus.example:8443/x", "https://www.example.org/a/b?c=d", "https://a.b.example.net/", "https://campus.example/login", "https://docs.example.org/#top")]
    rows += [page(FINE, f"<h1>News</h1><p>{text}</p>", "https://campus.example/news") for text in PLAIN[:5]]
    rows += [
        page(FINE, '<form action="/search"><input name="q"></form><a href="https://campus.example/">home</a>', "https://campus.example/"),
        page(FINE, '<form action="https://campus.example/login"><input type="password" name="p"></form>', "https://campus.example/"),
        mail(FINE, "24小时内登录 https://campus.example/login 完成安全验证", "notice@campus.example"),
        mail(FINE, "Photos attached", "friend@other.example.org", attachments=["a.jpg", "b.tar.gz"]),
        mail(FINE, "Poster", "friend@campus.example", qr_urls=["https://campus.example/event", "tel:123"]),
    ]
    return [{"case_id": f"g{k:03}", "forbidden_rule_ids": [], "allowed_levels": None, **row} for k, row in enumerate(rows)]


@pytest.fixture(scope="module")
def judged(spark):
    kinds = {"case_id": "string", **C.TYPES, **{c: "array<string>" if c.endswith(("ids", "levels")) else "string" for c in evaluate.EXPECTED}}
    table = spark.createDataFrame([tuple(r.get(k) for k in kinds) for r in golden()], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    found = evaluate.details(table, CAMPUS)
    return {r.case_id: r for r in found.collect()}, evaluate.summary(found).first()


def test_every_case_shows_what_it_must(judged):
    rows, _ = judged
    failed = {k: (r.level, r.score, r.hits, r.failures) for k, r in rows.items() if not r.passed}
    assert failed == {}


def test_quality_gates(judged):
    rows, total = judged
    assert len(rows) == 76 and total.tp + total.fn == 30 and total.fp + total.tn == 46
    assert total.failed_gates == [] and total.passed
    assert total.precision >= 0.95 and total.recall >= 0.75 and total.contract_pass_rate == 1.0


def test_cases_that_cannot_be_judged_fail(spark):
    table = spark.createDataFrame([("a", " ", "text", "phishing"), ("b", "x", "fax", "normal"), ("c", "hello", "sms", "normal")], "case_id string, input_text string, input_type string, label string")
    got = {r.case_id: (r.level, r.failures, r.positive) for r in evaluate.details(table, CAMPUS).collect()}
    assert got == {"a": ("low", ["error:EMPTY_INPUT"], False), "b": ("low", ["error:INVALID_INPUT_TYPE"], False), "c": ("low", [], False)}
    assert evaluate.summary(evaluate.details(table.limit(0), CAMPUS)).first().contract_pass_rate == 0.0


def test_standard_words(spark):
    assert set(profile.STANDARD.wording) == {r for r in profile.WORDING} and profile.STANDARD.wording["CREDENTIAL_REQUEST_TEXT"][0] == "请回复密码"
    text = spark.createDataFrame([("请​立 即\n验 证",)], "t string")
    from larkspan.functions import text as T

    assert text.select(T.any_spread(F.col("t"), profile.WORDING["URGENT_VERIFY_WORDING"]).alias("x")).first().x
