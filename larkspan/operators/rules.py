"""Rules: predicates over a case that give evidence, gathered in one array per case.

All rules of an input kind are one projection, so a case is read once whatever the
number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.functions import urls as U
from larkspan.operators.scoring import let
from larkspan.plans.profile import MAX_LEVELS, RULES, Profile

_DEFINED = {r[0]: (k, *r[1:]) for k, r in enumerate(RULES)}
_SCRIPT_REDIRECT = r"(?i)(?:window|document|top|self)\s*\.\s*location(?:\s*\.\s*href)?\s*=|location\s*\.\s*(?:replace|assign)\s*\("
_META_REFRESH = r"(?i)<meta[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*url\s*="


def evidence(rule_id: str, when: Column, subject: Column | str, confidence: Column | None = None, context: Column | float = 1.0, severity: Column | None = None, base: Column | None = None) -> Column:
    """The rule's evidence struct where ``when`` holds, else null."""
    ordinal, group, own_severity, own_base, own_confidence = _DEFINED[rule_id]
    row = F.struct(
        F.lit(ordinal).alias("ord"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(group).alias("grp"),
        (F.lit(own_severity) if severity is None else severity).alias("severity"),
        (F.lit(own_base) if base is None else base).cast("int").alias("base"),
        (F.lit(own_confidence) if confidence is None else confidence).cast("double").alias("confidence"),
        (context if isinstance(context, Column) else F.lit(float(context))).alias("context"),
        (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"),
    )
    return F.when(when, row)


def gathered(items: list[Column]) -> Column:
    """The evidence that is there, in rule order."""
    return F.array_compact(F.array(*items))


def similar_to(host: Column, profile: Profile) -> Column:
    """The confidence with which a foreign host resembles an official domain, else null; the first official domain wins."""

    def best(own: Column) -> Column:
        found = []
        for official in profile.official_domains:
            core = official.split(".")[0]
            close = (F.levenshtein(own["label"], F.lit(core)) == 1) & (F.length(own["label"]) <= 8)
            alike = U.similarity(own["registered"], F.lit(official)) >= 0.85
            inside = host.contains(core)
            found.append(F.when(close, 0.90).when(alike, 0.85).when(inside, 0.80))
        return F.coalesce(*found)

    if not profile.official_domains:
        return F.lit(None).cast("double")
    own = let(U.registered_domain(host), lambda r: F.struct(F.split_part(r, F.lit("."), F.lit(1)).alias("label"), r.alias("registered")))
    return F.when(~U.belongs_to(host, profile.official_domains), let(own, best))


def punycode_of(host: Column, decoded: Column, profile: Profile) -> Column:
    """The confidence with which a foreign xn-- host shows an official domain once decoded, else null; the first official domain wins."""

    def best(x: Column) -> Column:
        found = []
        for official, look in zip(profile.official_domains, _skeletons(profile)):
            far = F.levenshtein(x["own"], F.lit(official))
            found.append(F.when(x["seen"].contains(look) | F.lit(look).contains(x["seen"]), 0.95).when((far <= 2) | (U.similarity(x["own"], F.lit(official)) >= 0.80), 0.85))
        return F.coalesce(*found)

    if not profile.official_domains:
        return F.lit(None).cast("double")
    shown = F.struct(U.registered_domain(decoded).alias("own"), T.skeleton(decoded, profile.confusables).alias("seen"))
    return F.when(host.contains("xn--") & (decoded != host) & ~U.belongs_to(host, profile.official_domains), let(shown, best))


def looks_official(host: Column, profile: Profile) -> Column:
    """Whether a foreign host has the skeleton of an official domain."""
    if not profile.confusables:
        return F.lit(False)
    seen = let(T.skeleton(host, profile.confusables), lambda s: s.isin(*_skeletons(profile)))
    return ~U.belongs_to(host, profile.official_domains) & seen


def _skeletons(profile: Profile) -> list[str]:
    table = dict(profile.confusables)
    return ["".join(table.get(c, c) for c in d) for d in profile.official_domains]


def suspicious_port(p: Column, profile: Profile) -> Column:
    excepted = F.lit(False)
    for host, ports in profile.port_exceptions:
        excepted = excepted | ((p["host"] == host) & p["port"].isin(*ports))
    return p["port"].isNotNull() & ~p["port"].isin(80, 443) & ~excepted


def nested_official(p: Column, profile: Profile) -> Column:
    """An official domain inside a foreign host, or in the path of any host."""
    found = F.lit(False)
    foreign = ~U.belongs_to(p["host"], profile.official_domains)
    for d in profile.official_domains:
        found = found | (foreign & p["host"].contains(d)) | F.lower(p["path"]).contains(d)
    return found


def url_evidence(url: Column, profile: Profile, subject: str | Column = "url:0") -> list[Column]:
    """Evidence of the URL and domain rules for one URL."""
    p = U.parts(url)
    return parsed_url_evidence(p, profile, subject, U.decoded_host(p["host"]))


def parsed_url_evidence(p: Column, profile: Profile, subject: str | Column = "url:0", decoded: Column | None = None, plain_form: Column | None = None) -> list[Column]:
    """The same for the parts of a URL, its decoded host, and whether its case has a form that goes to plain http.

    Without a decoded host the punycode rule cannot judge and gives nothing.
    """
    decoded = p["host"] if decoded is None else decoded
    plain_form = F.lit(False) if plain_form is None else plain_form
    host, target = p["host"], F.concat_ws("?", p["path"], p["query"])
    official = U.belongs_to(host, profile.official_domains)
    similar, odd = similar_to(host, profile), punycode_of(host, decoded, profile)
    signs_in, brand = T.any_word(target, profile.login_words), T.any_word(host, profile.brand_words)
    bait = T.any_word(p["userinfo"], [*profile.official_domains, *profile.brand_words])
    return [
        evidence("URL_IP_DOMAIN", U.public_ip(host) & signs_in, subject),
        evidence("URL_SHORT_LINK", U.belongs_to(host, profile.short_links), subject),
        evidence("URL_NON_HTTPS", (p["scheme"] == "http") | ((p["scheme"] != "https") & (signs_in | plain_form)), subject, F.when(signs_in, 0.75).when(plain_form, 0.55).otherwise(0.30)),
        evidence("URL_SUSPICIOUS_PORT", suspicious_port(p, profile), subject),
        evidence("URL_LONG_SUBDOMAIN", U.subdomain_levels(host) > MAX_LEVELS, subject),
        evidence("URL_AT_SYMBOL", (p["userinfo"] != "") & bait & ~official, subject),
        evidence("URL_NESTED_OFFICIAL_DOMAIN", nested_official(p, profile), subject),
        let(similar, lambda sure: evidence("DOMAIN_SIMILAR_TO_OFFICIAL", sure.isNotNull(), subject, sure)),
        let(odd, lambda sure: evidence("DOMAIN_PUNYCODE_SUSPICIOUS", sure.isNotNull(), subject, sure)),
        *([evidence("DOMAIN_HOMOGRAPH_ATTACK", looks_official(host, profile), subject)] if profile.confusables else []),
        evidence("DOMAIN_KEYWORD_IMPERSONATION", ~official & brand & signs_in, subject),
    ]


def html_evidence(page: Column, host: Column, profile: Profile, forms: bool = True, scripts: bool = True) -> list[Column]:
    """Evidence of the page rules that need no document tree.

    Without ``forms`` those that dom.form_evidence() judges by the tree are left to it; without ``scripts`` the redirect by script is left to the text.
    """
    images = F.regexp_count(page, F.lit("(?i)<img\\b"))
    seen = F.length(T.visible_text(page))
    encoded = F.aggregate(
        F.regexp_extract_all(page, F.lit("data:image/[^;]*;base64,([^\"' >\\r\\n]*)"), F.lit(1)), F.lit(0), lambda a, x: a + F.least(F.length(x), F.lit(100_000))
    )
    password = page.rlike("(?i)<input[^>]*type\\s*=\\s*[\"']?password")
    iframes = F.array_join(F.regexp_extract_all(page, F.lit("(?i)<iframe[^>]*src\\s*=\\s*[\"']?([^\"' >]*)"), F.lit(1)), " ")
    links = F.regexp_extract_all(page, F.lit("(?i)<a[^>]*href\\s*=\\s*[\"']?(https?://[^\"' >]*)"), F.lit(1))
    outside = lambda urls: let(U.registered_domain(host), lambda own: F.size(F.filter(urls, lambda u: let(U.parts(u)["host"], U.registered_domain) != own)))
    counted = let(links, lambda urls: F.struct(F.size(urls).alias("all"), (outside(urls) / F.greatest(F.size(urls), F.lit(1))).alias("ratio")))
    hidden = page.rlike("(?i)<(?:form|a)\\b[^>]*(?:display\\s*:\\s*none|visibility\\s*:\\s*hidden|\\shidden\\b)")
    by_tree = [
        evidence("HTML_PASSWORD_INPUT", password, "page:0"),
        evidence("FORM_NON_HTTPS_ACTION", page.rlike("(?i)<form[^>]*action\\s*=\\s*[\"']?http://"), "form:0"),
        evidence("IFRAME_LOGIN_PAGE", T.any_word(iframes, profile.login_words), "page:0"),
    ]
    return [
        *(by_tree if forms else []),
        evidence("META_REFRESH_REDIRECT", page.rlike(_META_REFRESH), "page:0"),
        *([evidence("JS_LOCATION_REDIRECT", page.rlike(_SCRIPT_REDIRECT), "page:0")] if scripts else []),
        evidence("HIDDEN_FORM_OR_LINK", hidden, "page:0"),
        let(counted, lambda n: evidence("EXTERNAL_LINK_DOMINANCE", (n["all"] >= 3) & (n["ratio"] >= 0.70), "page:0", F.least(F.lit(0.85), n["ratio"]))),
        evidence("HTML_BASE64_IMAGE_HEAVY", (encoded > 2000) & (seen < 100), "page:0"),
        evidence("HTML_IMAGE_ONLY_CONTENT", (images >= 5) & (seen < 100), "page:0"),
    ]


def wording_evidence(text: Column, profile: Profile, official_context: Column | None = None) -> list[Column]:
    """Evidence of the wording rules on normalized text; an official context discounts all but the request for credentials."""
    out = []
    for rule_id, words in profile.wording.items():
        context = F.lit(1.0)
        if official_context is not None and rule_id != "CREDENTIAL_REQUEST_TEXT":
            context = F.when(official_context, 0.2).otherwise(1.0)
        sentence = F.concat(F.lit("sentence:"), T.first_sentence_with_spread(text, words).cast("string"))
        out.append(evidence(rule_id, T.any_spread(text, words), sentence, context=context))
    return out


def each_hit(rule_id: str, hits: Column, kind: str) -> Column:
    """Evidence array of the items for which ``hits``, an array, is true: one for each, named by its place."""
    found = F.transform(hits, lambda hit, k: evidence(rule_id, hit, F.concat(F.lit(kind), k.cast("string"))))
    return F.array_compact(found)


def attachment_evidence(names: Column, profile: Profile) -> Column:
    """Evidence array of the attachment rules for an array of file names, one for each name that hits."""
    dangerous = F.array(*[F.lit(x) for x in profile.dangerous_extensions])
    any_layer = F.transform(names, lambda n: F.arrays_overlap(T.extension_layers(n), dangerous))
    doubled = F.transform(names, lambda n: let(T.extension_layers(n), lambda own: (F.size(own) >= 2) & F.array_contains(dangerous, F.get(own, F.lit(0)))))
    return F.concat(each_hit("ATTACHMENT_EXECUTABLE", any_layer, "attachment:"), each_hit("ATTACHMENT_DOUBLE_EXTENSION", doubled, "attachment:"))


def sender_evidence(sender: Column, link_hosts: Column, text: Column, profile: Profile) -> list[Column]:
    """Evidence of the sender rules: an address or "name <address>", the hosts of the links, and the normalized text, which names brand and department."""
    address = F.coalesce(F.nullif(F.regexp_extract(sender, "<([^>]*)>", 1), F.lit("")), sender)
    domain = F.lower(F.regexp_extract(address, "@([^@>\\s]*)\\s*$", 1))
    said = F.struct(*[T.any_word(text, words).alias(k) for k, words in (("brand", profile.brand_words), ("department", profile.department_words), ("signs_in", profile.login_words))])
    elsewhere = lambda d: (F.size(link_hosts) > 0) & let(U.registered_domain(d), lambda own: F.forall(link_hosts, lambda h: U.registered_domain(h) != own))
    own = F.struct(domain.alias("domain"), said.alias("said"))
    return [
        let(own, lambda x: evidence("EMAIL_SENDER_IMPERSONATION", (x["domain"] != "") & ~U.belongs_to(x["domain"], profile.official_domains) & x["said"]["brand"] & x["said"]["department"], "sender:0")),
        let(
            own,
            lambda x: evidence(
                "EMAIL_SENDER_LINK_MISMATCH",
                (x["domain"] != "") & elsewhere(x["domain"]) & (x["said"]["brand"] | x["said"]["signs_in"]),
                "sender:0",
                F.when(x["said"]["brand"] & x["said"]["signs_in"], 0.75).otherwise(0.60),
            ),
        ),
    ]


# What the address behind a code names if it asks for credentials.
CREDENTIAL_CLUES = ("login", "auth", "verify", "password", "token", "sms", "验证码", "登录", "认证")


def qr_evidence(urls: Column, profile: Profile) -> Column:
    """Evidence array of the QR rules for an array of decoded URLs, one for each that hits; what has no host is no URL."""
    foreign = lambda p: (p["host"] != "") & ~U.belongs_to(p["host"], profile.official_domains)
    outside = F.transform(urls, lambda u: let(U.parts(u), foreign))
    asks = F.transform(urls, lambda u: let(U.parts(u), lambda p: foreign(p) & T.any_word(F.concat(p["path"], p["query"]), CREDENTIAL_CLUES)))
    return F.concat(each_hit("QR_CODE_EXTERNAL_URL", outside, "qr:"), each_hit("QR_CREDENTIAL_URL", asks, "qr:"))


def page_evidence(url: Column, page: Column, profile: Profile, normal: Column | None = None) -> Column:
    """Evidence of a page: its URL, source, forms, links and wording (of its normalized source, where that is given)."""
    from larkspan.operators import dom  # dom builds on this module

    both = F.struct(U.parts(url).alias("p"), U.decoded_host(U.parts(url)["host"]).alias("decoded"))
    plain_form = page.rlike("(?i)<form[^>]*action\\s*=\\s*[\"']?http://")
    of_source = let(both, lambda x: gathered(parsed_url_evidence(x["p"], profile, decoded=x["decoded"], plain_form=plain_form) + html_evidence(page, x["p"]["host"], profile, forms=False)))
    return F.concat(of_source, dom.page_form_evidence(page, url, profile), gathered(wording_evidence(page if normal is None else normal, profile)))


def message_evidence(
    text: Column, profile: Profile, sender: Column | None = None, links: Column | None = None, attachments: Column | None = None, qr_urls: Column | None = None
) -> Column:
    """Evidence of a message: its normalized text and, where a case has them, its sender, the URLs of its links, names of attachments and URLs of QR codes."""
    items = wording_evidence(text, profile) + [evidence("JS_LOCATION_REDIRECT", text.rlike(_SCRIPT_REDIRECT), "page:0")]
    if sender is not None:
        hosts = F.array().cast("array<string>") if links is None else F.transform(F.coalesce(links, F.array().cast("array<string>")), lambda u: U.parts(u)["host"])
        items += sender_evidence(F.coalesce(sender, F.lit("")), F.filter(hosts, lambda h: h != ""), text, profile)
    arrays = [gathered(items)]
    if attachments is not None:
        arrays.append(attachment_evidence(F.coalesce(attachments, F.array().cast("array<string>")), profile))
    if qr_urls is not None:
        arrays.append(qr_evidence(F.coalesce(qr_urls, F.array().cast("array<string>")), profile))
    return F.concat(*arrays)


def service_of(host: Column, services) -> Column:
    """The name of the first trusted service (name, domains, allowed and forbidden fields) that the host belongs to, else null."""
    found = [F.when(U.belongs_to(host, domains), F.lit(name)) for name, domains, _, _ in services]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _field_in(service: Column, field: Column, services, place: int) -> Column:
    listed = F.lit(False)
    for entry in services:
        listed = listed | ((service == entry[0]) & F.lower(field).isin(*[x.lower() for x in entry[place]]))
    return F.coalesce(listed, F.lit(False))


def field_allowed(service: Column, field: Column, services) -> Column:
    return _field_in(service, field, services, 2)


def field_forbidden(service: Column, field: Column, services) -> Column:
    return _field_in(service, field, services, 3)
