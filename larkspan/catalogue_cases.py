"""Queries of detection on cases, of URLs in texts, addresses, redaction and recognised blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.catalogue import _URLS, evidence_rows, query, table
from larkspan.catalogue_evaluation import _one_of, _pick
from larkspan.functions import text as T
from larkspan.functions import urls as U
from larkspan.operators import ocr, rules, scoring, semantic
from larkspan.plans import cases as C
from larkspan.plans import profile as P


def all_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as html, documents as mails with a sender and an attachment, turns of conversations as messages."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("case_id"), F.col("html").alias("input_text"), F.lit("html").alias("input_type"), F.col("url").alias("base_url"))
    k = F.col("doc_id")
    sender = F.concat(F.lit("The Page <a"), (k % 7).cast("string"), F.lit("@"), F.when(k % 2 == 0, "example.org").otherwise("mail.example.com"), F.lit(">"))
    mails = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), k).alias("case_id"), F.col("text").alias("input_text"), F.lit("email").alias("input_type"), sender.alias("sender"),
        F.when(k % 5 == 0, F.array(F.lit("report.pdf.exe"), F.lit("notes.txt"), F.lit("run.js"))).when(k % 5 == 1, F.array(F.lit("a.txt"))).alias("attachments"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("case_id"), F.col("text").alias("input_text"), F.lit("sms").alias("input_type"), F.array(F.lit("tel:123"), F.concat(F.lit("http://q.example.com/login?c="), "conv_id"), F.lit("https://example.org/login"), F.lit("https://q.example.net/%6Cogin")).alias("qr_urls")
    )
    return pages.unionByName(mails, allowMissingColumns=True).unionByName(turns, allowMissingColumns=True)


@query()
def detect_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_risks(all_cases(spark, sf_dir)).withColumn("groups", F.array_join("groups", ","))


@query(
    """WITH fine AS (SELECT * FROM documents WHERE trim(text) <> '' AND octet_length(encode(text)) <= 204800)
    SELECT 'c' || conv_id || ':' || turn AS case_id, q AS subject, r AS rule_id
    FROM conversations, (VALUES ('qr:1'), ('qr:3')) AS s(q), (VALUES ('QR_CODE_EXTERNAL_URL'), ('QR_CREDENTIAL_URL')) AS v(r) WHERE trim(text) <> ''
    UNION ALL SELECT 'd' || doc_id, a, r
    FROM fine, (VALUES ('attachment:0', 'ATTACHMENT_EXECUTABLE'), ('attachment:0', 'ATTACHMENT_DOUBLE_EXTENSION'), ('attachment:2', 'ATTACHMENT_EXECUTABLE')) AS v(a, r) WHERE doc_id % 5 = 0
    UNION ALL SELECT 'd' || doc_id, 'sender:0', 'EMAIL_SENDER_IMPERSONATION'
    FROM fine WHERE doc_id % 2 = 1 AND regexp_matches(lower(text), 'the|ing') AND regexp_matches(lower(text), 'tion|heit')"""
)
def case_context_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of attachments, senders and QR codes of all cases."""
    # explode() would add a filter on the evidence's size, for which the evidence is computed once more
    found = C.case_evidence(all_cases(spark, sf_dir)).select("case_id", F.explode_outer("evidence").alias("e")).select("case_id", "e.subject", "e.rule_id")
    return found.filter(F.col("rule_id").isin("ATTACHMENT_EXECUTABLE", "ATTACHMENT_DOUBLE_EXTENSION", "EMAIL_SENDER_IMPERSONATION", "QR_CODE_EXTERNAL_URL", "QR_CREDENTIAL_URL"))


@query("SELECT page_id, url || '|HTTP://Other.example/a' AS urls FROM pages")
def text_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    text = F.concat(F.lit("see "), u, F.lit(", or ("), u, F.lit("). \"HTTP://Other.example/a)!\""))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(U.in_text(text), "|").alias("urls"))


@query(
    f"""SELECT page_id, 'url:0 a http://links.example/1|url:1 form http://post.example/|url:2 text ' || url || '|url:3 text https://seen.example/x|qr:1 qr https://qr.example/' AS urls FROM {_URLS}"""
)
def case_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of a page, its text, its own address and QR codes, each once."""
    u = F.col("url")
    html = F.concat(F.lit('<a href="http://links.example/1">x</a><form action="http://post.example/"></form> see '), u, F.lit(" and https&#58;//seen.example/x ."))
    qr = F.array(F.lit("http://links.example/1"), F.lit("https://qr.example/"))
    cases = table(spark, sf_dir, "pages").select(F.col("page_id").alias("case_id"), html.alias("input_text"), F.lit("html").alias("input_type"), u.alias("base_url"), qr.alias("qr_urls"))
    found = C.with_urls(C.prepared(cases))
    return found.select(F.col("case_id").alias("page_id"), F.array_join(F.transform("urls", lambda x: F.concat_ws(" ", x["subject"], x["kind"], x["url"])), "|").alias("urls"))


@query(f"SELECT page_id, 'https://www.Shop.xyz|https://' || host || '.click' AS domains FROM {_URLS}")
def bare_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.parts(F.col("url"))["host"]
    text = F.concat(F.lit("go to www.Shop.xyz/a now, mail a@b.top or v1.2.top, "), host, F.lit(".click, "), F.col("url"), F.lit(" and www.shop.xyz"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(U.bare_domains(text, semantic.BAD_TLDS), "|").alias("domains"))


_FIRST, _SECOND = ("8", "10", "172", "192", "169", "198", "203", "100", "127", "224", "241", "300"), ("0", "16", "31", "32", "51", "64", "168", "254", "18")
_THIRD = ("0", "2", "100", "113", "7")


@query(
    f"""SELECT event_id, a < 256 AND NOT (a IN (0, 10, 127) OR a >= 240 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 198 AND b IN (18, 19)) OR (a = 192 AND b = 0 AND c IN (0, 2))
    OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS open FROM (SELECT event_id, CAST({_pick(_FIRST, 'event_id')} AS INTEGER) AS a, CAST({_pick(_SECOND, 'event_id // 12')} AS INTEGER) AS b, CAST({_pick(_THIRD, 'event_id // 108')} AS INTEGER) AS c FROM events)"""
)
def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    host = F.concat_ws(".", _one_of(_FIRST, k), _one_of(_SECOND, F.floor(k / 12)), _one_of(_THIRD, F.floor(k / 108)), F.lit("9"))
    return table(spark, sf_dir, "events").select(k, U.public_ip(host).alias("open"))


@query(
    """SELECT c_custkey, '110***' || '**********' || (10 + c_custkey % 80) || ' 138****' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' u***' || (c_custkey % 10) || '@a.org http://me:[REDACTED]@h.org/?q=1&token=[REDACTED]' AS redacted FROM customer"""
)
def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("1101011990010112"), (10 + k % 80).cast("string"), F.lit(" 1381234"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("\nuser"), (k % 10).cast("string"), F.lit("@a.org http://me:pw@h.org/?q=1&token=abc")
    )
    return table(spark, sf_dir, "customer").select(k, T.redact_and_shorten(text).alias("redacted"))


@query("SELECT doc_id, CASE WHEN length(t) > 160 THEN substr(t, 1, 157) || '...' ELSE t END AS shortened FROM (SELECT doc_id, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS t FROM documents WHERE NOT regexp_matches(text, '[@:=]|[0-9]{11}'))")
def redact_and_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold nothing to redact."""
    rows = table(spark, sf_dir, "documents").filter(~F.col("text").rlike("[@:=]|[0-9]{11}"))
    return rows.select("doc_id", T.redact_and_shorten(F.col("text")).alias("shortened"))


_SCRIPTS = ("abc", "аbc", "абв", "αβγ", "aβ", "123", "ա1", "a ա")


@query(f"SELECT event_id, event_id % 8 IN (1, 4, 7) AS mixed FROM events")
def mixed_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.mixed_scripts(_one_of(_SCRIPTS, F.col("event_id"))).alias("mixed"))


@query("SELECT page_id, url || ':' AS rules, url AS normalizer, url AS model, url AS findings FROM pages")
def trailing_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.col("url"), F.lit(":!.)"))
    return table(spark, sf_dir, "pages").select("page_id", *[U.without_trailing(u, purpose).alias(purpose) for purpose in U.TRAILING])


@query(f"SELECT page_id, lower(raw_scheme) || '://' || authority || '/x/y?z=1' AS rooted, 'https://o.example/' AS absolute, CAST(NULL AS VARCHAR) AS mail FROM {_URLS}")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    links = {"rooted": F.lit(" /x/y?z=1"), "absolute": F.lit("https://o.example/"), "mail": F.lit("mailto:a@b.c")}
    return table(spark, sf_dir, "pages").select("page_id", *[U.resolved(link, u).alias(k) for k, link in links.items()])


@query(
    f"WITH e AS (SELECT * FROM (SELECT l_orderkey AS case_id, list(DISTINCT rule_ix) AS own FROM (SELECT l_orderkey, l_partkey % {len(P.RULES)} AS rule_ix FROM lineitem) GROUP BY 1)) SELECT case_id, list_contains(own, {[r[0] for r in P.RULES].index('DOMAIN_HOMOGRAPH_ATTACK')}) AS wide, list_contains(own, {[r[0] for r in P.RULES].index('DOMAIN_KEYWORD_IMPERSONATION')}) AND NOT list_contains(own, {[r[0] for r in P.RULES].index('DOMAIN_HOMOGRAPH_ATTACK')}) AS stays FROM e"
)
def suppression_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of global scope removes its target for every subject of a case."""
    rows = evidence_rows(spark, sf_dir)
    kept = scoring.suppressed_removed(rows, everywhere=("DOMAIN_HOMOGRAPH_ATTACK",))
    stays = kept.filter(F.col("rule_id") == "DOMAIN_KEYWORD_IMPERSONATION").select("case_id").distinct().withColumn("stays", F.lit(True))
    wide = rows.groupBy("case_id").agg(F.bool_or(F.col("rule_id") == "DOMAIN_HOMOGRAPH_ATTACK").alias("wide"))
    return wide.join(stays, "case_id", "left").select("case_id", "wide", F.coalesce("stays", F.lit(False)).alias("stays"))


_SHOWN = ("https://a.example/x", "httpsJexample.org", "http;evil.top/a", "www example.org", "www.shop.xyz/a", "shop.org", "the.com", "no", "hello there", "see http://ok.example now")
_REASONS = ("standard_url_pattern", "damaged_http_prefix", "damaged_http_prefix", "www_prefix_damaged", "standard_url_pattern", "bare_domain", "", "", "", "standard_url_pattern")
_DAMAGED = ("false", "true", "true", "true", "false", "false", "false", "false", "false", "false")


@query(f"SELECT event_id, {_pick(_REASONS, 'event_id')} AS reason, CAST({_pick(_DAMAGED, 'event_id')} AS BOOLEAN) AS malformed FROM events")
def ocr_url_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", ocr.url_candidate(_one_of(_SHOWN, F.col("event_id"))).alias("u"))
    return rows.select("event_id", "u.reason", "u.malformed")


@query(
    """SELECT event_id, CASE WHEN y < 0.33 THEN 'top' WHEN y > 0.67 THEN 'bottom' ELSE 'centre' END || ' ' || CASE WHEN x < 0.33 THEN 'left' WHEN x > 0.67 THEN 'right' ELSE 'middle' END AS position
    FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS x, (event_id * 7 % 50) / 50.0::DOUBLE AS y FROM events)"""
)
def ocr_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k, ocr.position(k % 100, k * 7 % 50, F.lit(100), F.lit(50)).alias("position"))


SERVICES = (("forms", ("forms.example", "example.com"), ("name", "Email"), ("password", "token")),)


@query("SELECT page_id, field, served, served AND field IN ('name', 'email') AS allowed, served AND field IN ('password', 'token') AS forbidden FROM (SELECT page_id, unnest(['name', 'email', 'password', 'phone']) AS field, host = 'example.com' OR ends_with(host, '.example.com') AS served FROM " + _URLS + ")")
def trusted_service_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.explode(semantic.strings(("name", "email", "password", "phone"))).alias("field")
    rows = table(spark, sf_dir, "pages").select("page_id", U.parts(F.col("url"))["host"].alias("host"), fields)
    found = rules.service_of(F.col("host"), SERVICES)
    return rows.select("page_id", "field", found.isNotNull().alias("served"), rules.field_allowed(found, F.col("field"), SERVICES).alias("allowed"), rules.field_forbidden(found, F.col("field"), SERVICES).alias("forbidden"))
