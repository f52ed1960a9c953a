"""The shell around detectors: inputs, signals, translated answers, states, summaries and the small offline detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.functions import urls as U

# Severities of rule and language-model signals, categories of rule groups, kinds of content.
RULE_SEVERITY = {"low": 30, "medium": 60, "high": 85}
MODEL_SEVERITY = {"low": 25, "medium": 55, "high": 80}
CATEGORIES = {"credential": "credential-theft", "navigation": "navigation", "social": "social-engineering", "transport": "transport", "payload": "payload"}
CONTENT_TYPES = {"email": "email", "sms": "sms", "notice": "notification"}
ACTIVE = ("usable_first_attempt", "recovered_after_validation_retry", "recovered_after_conservative_enum_fallback")
READABLE = ("reliable", "usable_with_warnings")
MOST_CONTENT = 10_000
MOST_WARNINGS = 20
WARNING_CHARACTERS = 300


def looked_up(table: dict, key: Column, default) -> Column:
    known = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(known, key), F.lit(default) if not isinstance(default, Column) else default)


def rule_input(kind: Column, source_type: Column) -> Column:
    """The rule engine's input type of a request: texts that are neither mail nor message are plain."""
    return F.when(kind.isin("url", "html"), kind).when(source_type.isin("email", "sms"), source_type).otherwise("text")


def model_input(kind: Column, source_type: Column, content: Column) -> Column:
    """struct(content, content_type) of a request to the language model's service."""
    return F.struct(
        F.substring(content, 1, MOST_CONTENT).alias("content"),
        F.when(kind == "url", "link").when(kind == "html", "html").otherwise(looked_up(CONTENT_TYPES, source_type, "email")).alias("content_type"),
    )


def rule_signal(rule_id: Column, group: Column, severity: Column) -> Column:
    """struct(category, severity) of a rule's evidence."""
    category = (
        F.when(rule_id.isin("PASSWORD_FORM_UNTRUSTED_TARGET", "HTML_PASSWORD_INPUT"), "credential-form")
        .when(rule_id.startswith("FORM_"), "form-action")
        .when(group == "identity", "impersonation")
        .otherwise(looked_up(CATEGORIES, group, group))
    )
    return F.struct(category.alias("category"), looked_up(RULE_SEVERITY, severity, 30).alias("severity"))


def semantic_score(evidence: Column) -> Column:
    """Of a language model's evidence (array of structs with type and severity): the most severe and 5 for each further type, 95 at most; 5 without any."""
    strongest = F.array_max(F.transform(evidence, lambda e: looked_up(MODEL_SEVERITY, e["severity"], 25)))
    kinds = F.size(F.array_distinct(F.filter(F.transform(evidence, lambda e: e["type"]), lambda t: F.coalesce(t, F.lit("")) != "")))
    return F.when(F.size(evidence) == 0, 5).otherwise(F.least(F.lit(95), strongest + F.greatest(kinds - 1, F.lit(0)) * 5)).cast("int")


def calibrated(confidence: Column, quality: Column, ocr_confidence: Column) -> Column:
    """A confidence raised to three quarters of the recognition's (0.8 at most) where the text could be read."""
    floor = F.greatest(F.lit(0.0), F.least(F.lit(0.8), ocr_confidence * 0.75))
    return F.when(F.coalesce(quality.isin(*READABLE), F.lit(False)) & ocr_confidence.isNotNull(), F.greatest(confidence, floor)).otherwise(confidence)


def translated(status: Column, image: Column, model_status: Column, evidence: Column, score: Column, confidence: Column, quality: Column, ocr_confidence: Column) -> Column:
    """struct(score, confidence, n_evidence, skip_reason) of a language-model service's answer.

    Texts need an active model and count its matched evidence; images take the service's own score, and evidence
    that is matched or deterministic.
    """
    own = F.filter(evidence, lambda e: (e["source"] == "llm") & (e["verification"] == "matched"))
    seen = F.filter(evidence, lambda e: e["verification"].isin("matched", "deterministic"))
    failed = F.coalesce(status != "success", F.lit(True))
    inactive = ~F.coalesce(model_status.isin(*ACTIVE), F.lit(False))
    reason = (
        F.when(failed & image & (status == "insufficient_evidence"), "text could not be read from the image")
        .when(failed, "not enough evidence")
        .when(image & score.isNull(), "no usable score")
        .when(~image & inactive, "the model was not active")
    )
    bounded = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(most), c))
    sure = F.coalesce(confidence, F.lit(0.0))
    value = F.when(image, bounded(score.cast("double"), 100.0)).otherwise(semantic_score(own).cast("double"))
    return F.struct(
        F.when(reason.isNotNull(), 0.0).otherwise(value).alias("score"),
        F.when(reason.isNotNull(), 0.0).otherwise(bounded(F.when(image, sure).otherwise(calibrated(sure, quality, ocr_confidence)), 1.0)).alias("confidence"),
        F.when(reason.isNotNull(), 0).otherwise(F.size(F.when(image, seen).otherwise(own))).alias("n_evidence"),
        reason.alias("skip_reason"),
    )


def detector_status(failed: Column, answered: Column, skip_reason: Column) -> Column:
    """struct(status, detail) of a detector: failed, skipped or completed."""
    return F.struct(
        F.when(failed, "failed").when(~answered | (F.coalesce(skip_reason, F.lit("")) != ""), "skipped").otherwise("completed").alias("status"),
        F.when(failed, "detector unavailable").when(~answered, "input type not supported or service not configured").otherwise(F.when(skip_reason != "", skip_reason)).alias("detail"),
    )


def request_status(detectors: DataFrame, request: str = "request_id") -> DataFrame:
    """request, n_completed, available, warnings of the detectors' rows (request, ord, detector, status, detail, warnings array).

    A failed detector and a reason to skip are warnings, before those of the detector itself; the first 20 different
    ones stay.
    """
    own = F.when(F.col("status") == "failed", F.array(F.concat("detector", F.lit(": detector unavailable")))).when(
        (F.col("status") == "skipped") & F.col("answered"), F.array(F.concat("detector", F.lit(": "), "detail"))
    )
    said = F.transform(F.col("warnings"), lambda w: F.concat(F.col("detector"), F.lit(": "), F.substring(w, 1, WARNING_CHARACTERS)))
    rows = detectors.select(request, "ord", (F.col("status") == "completed").alias("done"), F.coalesce(own, F.when(F.col("status") == "completed", said), F.array().cast("array<string>")).alias("said"))
    grouped = rows.groupBy(request).agg(F.count_if("done").alias("n_completed"), F.array_sort(F.collect_list(F.struct("ord", "said"))).alias("all"))
    flat = F.flatten(F.transform("all", lambda x: x["said"]))
    return grouped.select(request, "n_completed", (F.col("n_completed") > 0).alias("available"), F.slice(F.array_distinct(flat), 1, MOST_WARNINGS).alias("warnings"))


#: What a level means and what to do, in the words of this library.
SUMMARIES = {
    "low": "No clear sign of phishing; check the sender before anything important.",
    "medium": "Suspicious signs; confirm over an official channel.",
    "high": "Strong signs of phishing; stop and follow the advice.",
    "critical": "Several independent strong signs; stop at once and report it.",
}
ADVICE = {
    "low": ("The result is an aid only; check the sender.", "Start from the official site."),
    "medium": ("Pause; check the sender's address and where links lead.", "Do not use the contact details of the message."),
    "high": ("Do not follow links, open attachments or enter passwords.", "Ask over the official site or telephone.", "Change passwords that were entered and tell the security staff."),
    "critical": ("Stop all clicks, downloads, logins and payments.", "Keep the message and tell the security staff.", "Change passwords that were entered and watch the account."),
}


def summary(level: Column) -> Column:
    return looked_up(SUMMARIES, level, SUMMARIES["low"])


def advice(level: Column) -> Column:
    chosen = None
    for name, lines in ADVICE.items():
        own = F.array(*[F.lit(x) for x in lines])
        chosen = F.when(level == name, own) if chosen is None else chosen.when(level == name, own)
    return chosen.otherwise(F.array(*[F.lit(x) for x in ADVICE["low"]]))


def recognised(corrected: Column, full: Column, status: Column, confidence: Column, milliseconds: Column) -> Column:
    """struct(text, confidence, milliseconds, error) of a recognition service's answer."""
    text = F.trim(F.when(F.coalesce(corrected, F.lit("")) != "", corrected).otherwise(F.coalesce(full, F.lit(""))))
    missing = (text == "") | (F.coalesce(status, F.lit("unknown")) == "insufficient_evidence")
    return F.struct(
        F.when(~missing, text).alias("text"),
        F.when(~missing, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))).alias("confidence"),
        F.when(~missing, F.greatest(F.lit(0), F.rint(F.coalesce(milliseconds, F.lit(0.0))).cast("int"))).alias("milliseconds"),
        F.when(missing, "INSUFFICIENT_TEXT").alias("error"),
    )


# The small offline detector ---------------------------------------------------------------------------------------------

# Short-link hosts are a parameter; patterns of pressure and of asked-for secrets; severities by sign.
URGENT = ("立即.{0,6}(验证|登录|处理|领取)", "账号.{0,8}(停用|冻结|过期)", "限时.{0,8}(领取|验证|提交)", "逾期.{0,8}(失效|停用|取消)")
SECRETS = ("(输入|提交|填写).{0,8}(密码|验证码|银行卡|身份证)", "(账号|密码).{0,4}(验证|更新|确认)")


def signal(when: Column, category: str, severity: int) -> Column:
    return F.when(when, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")))


def baseline_url(url: Column, shorteners: tuple[str, ...], institution: str, official: tuple[str, ...]) -> Column:
    """array<struct(category, severity)> of one URL."""
    p = U.parts(url)
    host = p["host"]
    items = [
        signal(p["scheme"] != "https", "transport", 20),
        signal(p["userinfo"] != "", "url-obfuscation", 55),
        signal(F.length(url) > 160, "url-obfuscation", 25),
        signal(host.startswith("xn--") | host.contains(".xn--"), "domain", 45),
        signal(host.isin(*shorteners), "short-link", 35),
        signal(host.rlike("^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.|$)){4}$"), "domain", 55),
        signal(F.length(F.regexp_replace(host, "[^.]", "")) >= 4, "domain", 25),
        signal(host.contains(institution) & ~U.belongs_to(host, official), "impersonation", 80),
    ]
    return F.array_compact(F.array(*items))


def baseline_text(text: Column) -> Column:
    """array<struct(category, severity)> of a text without its links."""
    found = lambda patterns: F.coalesce(text.rlike("(?i)" + "|".join(patterns)), F.lit(False))
    return F.array_compact(F.array(signal(found(URGENT), "social-engineering", 35), signal(found(SECRETS), "credential-request", 65)))


def baseline_links(text: Column, shorteners: tuple[str, ...], institution: str, official: tuple[str, ...], most: int = 10) -> Column:
    """The signals of the first ``most`` links of a text: a feature of this detector, whose rules the whole engine applies to all links."""
    links = F.slice(F.regexp_extract_all(text, F.lit("(?i)(https?://[^\\s<>\"']+)")), 1, most)
    return F.flatten(F.transform(links, lambda u: baseline_url(F.rtrim(u, F.lit(".,;，。；)）")), shorteners, institution, official)))


def baseline_page(page: Column) -> Column:
    """array<struct(category, severity)> of a page's own parts; its text goes through baseline_text()."""
    tag = lambda pattern: F.coalesce(page.rlike(f"(?i)<{pattern}"), F.lit(False))
    items = [
        signal(tag("input\\b[^>]*\\btype\\s*=\\s*[\"']?password\\b"), "credential-form", 55),
        signal(tag("iframe\\b"), "embedded-content", 20),
        signal(tag("meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b"), "redirect", 40),
    ]
    return F.concat(F.array_compact(F.array(*items)), baseline_text(T.visible_text(page)))


def baseline_score(signals: Column) -> Column:
    """struct(score, confidence): the most severe signal and 18 % of the others, 100 at most; 5 without any."""
    severities = F.transform(signals, lambda s: s["severity"].cast("double"))
    total = F.aggregate(severities, F.lit(0.0), lambda a, x: a + x)
    top = F.array_max(severities)
    score = F.least(F.lit(100.0), top + 0.18 * (total - top))
    return F.struct(F.when(F.size(signals) == 0, 5.0).otherwise(F.bround(score, 6)).alias("score"), F.when(F.size(signals) == 0, 0.45).otherwise(0.70).alias("confidence"))
