"""Detection on cases of any kind: normalized text, all URLs of a case, every rule, one risk. No shuffle; the same on streams.

``cases``: case_id, input_text, input_type (url, html, email, sms, text), base_url, sender, attachments, qr_urls, ocr_text.
Columns that are missing count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.functions import urls as U
from larkspan.operators import dom, rules
from larkspan.operators.scoring import EVIDENCE, active, let, risk
from larkspan.plans.profile import DEMO, MAX_BYTES, Profile
from larkspan.session import bounded_batches

TYPES = {"input_text": "string", "input_type": "string", "base_url": "string", "sender": "string", "attachments": "array<string>", "qr_urls": "array<string>", "ocr_text": "string"}
KINDS = ("url", "html", "email", "sms", "text")
MOST_ATTACHMENTS, MOST_QR = 50, 20


def strings() -> Column:
    return F.array().cast("array<string>")


def error_code(c) -> Column:
    """Why a case is not judged, else null."""
    size = F.coalesce(F.octet_length(c["input_text"]), F.lit(0)) + F.coalesce(F.octet_length(c["ocr_text"]), F.lit(0))
    return (
        F.when(F.trim(F.coalesce(c["input_text"], F.lit(""))) == "", "EMPTY_INPUT")
        .when(~F.coalesce(c["input_type"].isin(*KINDS), F.lit(False)), "INVALID_INPUT_TYPE")
        .when(size > MAX_BYTES, "PAYLOAD_TOO_LARGE")
        .when((F.size(c["attachments"]) > MOST_ATTACHMENTS) | (F.size(c["qr_urls"]) > MOST_QR), "INVALID_CONTEXT")
    )


def prepared(cases: DataFrame, key: str = "case_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the case's columns, normal (its normalized text), qr_normal (normalized QR URLs), page (struct of forms and links, empty unless html)."""
    bounded_batches(cases.sparkSession)
    have = set(cases.columns)
    cols = {k: (F.col(k) if k in have else F.lit(None)).cast(t) for k, t in TYPES.items()}
    rows = cases.select(key, *keep, *[(F.coalesce(c, strings()) if TYPES[k].startswith("array") else c).alias(k) for k, c in cols.items()])
    rows = rows.withColumn("error_code", error_code({k: F.col(k) for k in TYPES}))
    html = F.when(F.col("error_code").isNull() & (F.col("input_type") == "html"), F.col("input_text")).otherwise("")
    text = F.when(F.col("error_code").isNull(), F.col("input_text")).otherwise("")
    return rows.withColumns({"normal": T.with_recognised(text, F.col("ocr_text")), "html": html, "qr_normal": T.normal_urls(F.col("qr_urls"))}).withColumn("page", dom.flattened_once("html", F.coalesce("base_url", F.lit(""))))


def union_of_urls(c) -> Column:
    """array<struct(url, kind, subject)>: the URLs of a prepared case in the order of their sources, the first of each canonical key.

    Sources: links, forms, iframes and redirects of a page, the text as it came, the normalized text, the case's own URL, QR codes.
    """
    web = lambda u: F.coalesce(u.rlike("^https?://"), F.lit(False))
    item = lambda u, kind, n=None: F.struct(u.alias("url"), F.lit(kind).alias("kind"), (F.lit(-1) if n is None else n).cast("int").alias("n"))
    page = c["page"]
    sources = F.concat(
        F.transform(page["links"], lambda x: item(x["target"], "a")),
        F.transform(F.filter(page["forms"], lambda x: x["action"] != ""), lambda x: item(x["target"], "form")),
        F.transform(page["iframes"], lambda x: item(x, "iframe")),
        F.transform(page["metas"], lambda x: item(x, "meta")),
        F.transform(U.in_text(c["input_text"]), lambda x: item(x, "text")),
        F.when(c["normal"] != c["input_text"], F.transform(U.in_text(c["normal"]), lambda x: item(x, "text"))).otherwise(F.array().cast("array<struct<url:string,kind:string,n:int>>")),
        F.array(item(c["base_url"], "base")),
        F.transform(c["qr_urls"], lambda x, i: item(x, "qr", i)),
    )
    own = U.first_of_each(F.filter(sources, lambda x: web(x["url"])))
    subject = lambda x, i: F.when(x["kind"] == "qr", F.concat(F.lit("qr:"), x["n"].cast("string"))).otherwise(F.concat(F.lit("url:"), i.cast("string")))
    return F.transform(own, lambda x, i: F.struct(x["url"].alias("url"), x["kind"].alias("kind"), subject(x, i).alias("subject")))


def with_urls(rows: DataFrame) -> DataFrame:
    """Adds urls (union_of_urls), hosts and decoded (the same in Unicode)."""
    rows = rows.withColumn("urls", F.when(F.col("error_code").isNull(), union_of_urls({k: F.col(k) for k in (*TYPES, "normal", "page")})).otherwise(F.array().cast("array<struct<url:string,kind:string,subject:string>>")))
    rows = rows.withColumn("hosts", F.transform("urls", lambda u: U.parts(u["url"])["host"]))
    return rows.withColumn("decoded", U.decoded_hosts(F.col("hosts")))


def official_context(sender: Column, hosts: Column, profile: Profile) -> Column:
    """Whether the sender and every host of a case are official; cases without links need the sender alone."""
    address = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(sender, F.lit("")), "<([^>]*)>", 1), F.lit("")), sender, F.lit(""))
    domain = F.lower(F.regexp_extract(address, "@([^@>\\s]*)\\s*$", 1))
    return let(domain, lambda d: U.belongs_to(d, profile.official_domains)) & F.forall(hosts, lambda h: (h == "") | U.belongs_to(h, profile.official_domains))


def evidence_of(c, profile: Profile) -> Column:
    """The evidence of a case of with_urls(), in the order of the rules."""
    plain_form = F.exists(c["urls"], lambda u: (u["kind"] == "form") & u["url"].startswith("http://"))

    def of_url(x):
        return let(U.parts(x["u"]["url"]), lambda p: rules.gathered(rules.parsed_url_evidence(p, profile, x["u"]["subject"], x["decoded"], plain_form)))

    of_urls = F.flatten(F.transform(F.arrays_zip(c["urls"].alias("u"), c["decoded"].alias("decoded")), of_url))
    base = F.coalesce(c["base_url"], F.lit(""))
    of_page = let(U.parts(base)["host"], lambda host: F.concat(rules.gathered(rules.html_evidence(c["html"], host, profile, forms=False, scripts=False)), dom.form_evidence(c["page"], base, c["html"], profile)))
    scripts = rules.gathered([rules.evidence("JS_LOCATION_REDIRECT", c["normal"].rlike(rules._SCRIPT_REDIRECT), "page:0")])
    context = official_context(c["sender"], c["hosts"], profile)
    seen = F.filter(F.transform(c["urls"], lambda u: F.when(u["kind"] != "qr", U.parts(u["url"])["host"])), lambda h: h.isNotNull() & (h != ""))
    rest = rules.wording_evidence(c["normal"], profile, context) + rules.sender_evidence(F.coalesce(c["sender"], F.lit("")), seen, c["normal"], profile)
    payload = (rules.attachment_evidence(c["attachments"], profile), rules.qr_evidence(c["qr_normal"], profile))
    return F.concat(of_urls, F.when(c["html"] != "", of_page).otherwise(F.array().cast(EVIDENCE)), scripts, rules.gathered(rest), *payload)


def case_evidence(cases: DataFrame, profile: Profile = DEMO, key: str = "case_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns ``keep``, error_code, urls, evidence."""
    rows = with_urls(prepared(cases, key, keep))
    c = {k: F.col(k) for k in rows.columns}
    found = F.when(F.col("error_code").isNull(), evidence_of(c, profile)).otherwise(F.array().cast(EVIDENCE))
    return rows.select(key, *keep, "error_code", "urls", found.alias("evidence"))


def case_risks(cases: DataFrame, profile: Profile = DEMO, key: str = "case_id") -> DataFrame:
    """key, error_code, the risk's columns, n_urls, n_evidence, n_suppressed, n_high, n_medium, n_low, groups (sorted) of every case."""
    rows = case_evidence(cases, profile, key)
    rows = rows.withColumn("kept", active(F.col("evidence")))
    count = lambda severity: F.size(F.filter("kept", lambda e: e["severity"] == severity)).alias(f"n_{severity}")
    groups = F.array_sort(F.array_distinct(F.transform("kept", lambda e: e["grp"]))).alias("groups")
    judged = rows.select(key, "error_code", risk(F.col("evidence")).alias("risk"), F.size("urls").alias("n_urls"), F.size("kept").alias("n_evidence"), (F.size("evidence") - F.size("kept")).alias("n_suppressed"), *map(count, ("high", "medium", "low")), groups)
    return judged.select(key, "error_code", "risk.*", "n_urls", "n_evidence", "n_suppressed", "n_high", "n_medium", "n_low", "groups")
