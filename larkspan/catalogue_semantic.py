"""Queries of the semantic scores over evidence derived from events, orders, pages, documents and customers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.catalogue import _FEATURES, _OFFICIAL, _URLS, _registered, features, query, table
from larkspan.operators import semantic
from larkspan.plans import profile as P

NAME = "example"
OFFICIAL = P.DEMO.official_domains
_SCORES = semantic.scores_of(NAME)
_TYPES = semantic._EVIDENCE_TYPES
_SOURCES = ("llm", *semantic.RULE_SOURCES)
_CHECKS = ("matched", "deterministic", "unmatched")
_GRADES = ("low", "medium", "high")
_IDS = (*_SCORES, "url_unknown_rule")


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_E = f"""e AS (SELECT event_id, event_id // 7 AS case_id, {_sql_list(_TYPES)}[1 + (event_id * 31 + event_id // 7) % {len(_TYPES)}] AS type,
 {_sql_list(_SOURCES)}[1 + (event_id * 17 + event_id // 11) % {len(_SOURCES)}] AS source, {_sql_list(_CHECKS)}[1 + (event_id * 5 + event_id // 3) % 3] AS verification,
 {_sql_list(_GRADES)}[1 + (event_id * 11 + event_id // 5) % 3] AS severity, 'q' || (event_id % 5) AS quote,
 {_sql_list(_IDS)}[1 + (event_id * 13 + event_id // 9) % {len(_IDS)}] AS rid FROM events)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of any size: seven rows a case, whose fields follow from the event's number."""
    k = F.col("event_id")

    def one_of(values, number):
        return F.element_at(semantic.strings(values), (number % len(values) + 1).cast("int"))

    over = lambda n: F.floor(k / n)
    return table(spark, sf_dir, "events").select(
        k,
        over(7).alias("case_id"),
        one_of(_TYPES, k * 31 + over(7)).alias("type"),
        one_of(_SOURCES, k * 17 + over(11)).alias("source"),
        one_of(_CHECKS, k * 5 + over(3)).alias("verification"),
        one_of(_GRADES, k * 11 + over(5)).alias("severity"),
        F.concat(F.lit("q"), (k % 5).cast("string")).alias("quote"),
        F.array(one_of(_IDS, k * 13 + over(9))).alias("rule_ids"),
    )


def evidence_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("type", "source", "verification", "severity", "quote", "rule_ids").cast(semantic.EVIDENCE)
    return evidence(spark, sf_dir).groupBy("case_id").agg(F.collect_list(item).alias("evidence"))


_SCORE_ROWS = ", ".join(f"('{k}', {v})" for k, v in _SCORES.items())
_TOGETHER = ", ".join("CASE WHEN " + " AND ".join(f"bool_or(source <> 'llm' AND rid = '{k.format(NAME)}')" for k in kinds) + f" THEN {score} ELSE 0 END" for kinds, score in semantic.COMBINATIONS)


@query(
    f"""WITH {_E}, b AS (SELECT case_id, count(*) FILTER (source <> 'llm') AS total, count(*) FILTER (source <> 'llm' AND severity = 'high') AS severe,
    greatest(coalesce(max(v) FILTER (source <> 'llm'), 0), coalesce(max(CASE severity WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END) FILTER (source = 'keyword'), 0), {_TOGETHER}) AS best
    FROM e LEFT JOIN (VALUES {_SCORE_ROWS}) AS s(rid, v) USING (rid) GROUP BY case_id)
    SELECT case_id, CAST(CASE WHEN total = 0 THEN 5 WHEN best = 0 THEN least(100, greatest(5, 25 * severe)) ELSE least(100, best) END AS INTEGER) AS score,
    CASE WHEN total = 0 THEN 0.3::DOUBLE ELSE round_even(least(0.6::DOUBLE, 0.2::DOUBLE + total * 0.06::DOUBLE), 6) END AS confidence FROM b"""
)
def ai_rule_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence_of_cases(spark, sf_dir).select("case_id", semantic.rule_only(F.col("evidence"), NAME).alias("r"))
    return found.select("case_id", "r.score", F.bround("r.confidence", 6).alias("confidence"))


_SURE = "verification IN ('matched', 'deterministic')"
_HAS = lambda t: f"list_contains(types, '{t}')"


@query(
    f"""WITH {_E}, c AS (SELECT case_id, list_sort(list_distinct(list(type) FILTER ({_SURE}))) AS types, count(DISTINCT trim(quote)) FILTER ({_SURE}) AS quotes,
    bool_or(verification = 'deterministic' AND source = 'deterministic_url' AND type = 'domain_anomaly' AND starts_with(rid, 'url_') AND rid IN ({", ".join(f"'{k}'" for k in _SCORES)})) AS anchored,
    bool_or(verification = 'deterministic' AND source = 'deterministic_header' AND type = 'sender_anomaly') AS odd FROM e GROUP BY case_id),
    d AS (SELECT *, len(types) >= 3 AND len(list_filter(types, lambda t: t NOT IN ('urgency', 'info_request', 'other', 'language_issue'))) > 0 AS enough,
    {_HAS('urgency')} OR {_HAS('secrecy')} AS pressed FROM c WHERE types IS NOT NULL),
    f AS (SELECT *, enough AND pressed AND anchored AND {_HAS('suspicious_link')} AND {_HAS('domain_anomaly')} AND ({_HAS('info_request')} OR {_HAS('credential_request')} OR {_HAS('payment_request')}) AS link,
    enough AND pressed AND {_HAS('impersonation')} AND ({_HAS('payment_request')} OR {_HAS('credential_request')}) AND ({_HAS('secrecy')} OR ({_HAS('urgency')} AND odd)) AND quotes >= 3 AS social FROM d)
    SELECT case_id, CASE WHEN link THEN 'link_based_phishing' WHEN social THEN 'social_engineering_phishing' ELSE '' END AS rule, CASE WHEN link THEN 75 WHEN social THEN 72 ELSE 0 END AS score,
    array_to_string(types, ',') AS types, CASE WHEN link THEN 'deterministic_url' WHEN social AND odd THEN 'deterministic_header' ELSE '' END AS anchor FROM f"""
)
def ai_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence_of_cases(spark, sf_dir).select("case_id", semantic.verified_types(F.col("evidence")).alias("types"), semantic.promotion(F.col("evidence"), NAME).alias("p"))
    return rows.filter(F.size("types") > 0).select("case_id", "p.rule", "p.score", F.array_join("types", ",").alias("types"), "p.anchor")


@query(
    f"""SELECT o_orderkey, greatest(CAST(round_even(CASE WHEN base < 70 THEN least(base, 69) ELSE base END, 0) AS INTEGER), promoted) AS score FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 75 ELSE 0 END AS promoted, CASE WHEN rs >= 70 THEN least(rs + 0.15::DOUBLE * ai, 100)
    WHEN rs >= 40 THEN least(rs + CASE WHEN o_orderkey % 3 = 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * ai, 84)
    WHEN o_orderkey % 3 = 0 AND rc >= 0.25 THEN least(rs + 0.5::DOUBLE * ai, 69) ELSE least(rs + 0.3::DOUBLE * ai, 49) END AS base FROM {_FEATURES})"""
)
def ai_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    score = semantic.hybrid(F.col("rs"), F.col("ai"), k % 3 == 0, F.col("rc"), F.when(k % 17 == 0, 75).otherwise(0))
    return features(spark, sf_dir).select("o_orderkey", score.alias("score"))


@query(
    f"""SELECT o_orderkey, CASE WHEN rs >= 70 THEN 'high' WHEN rs >= 40 THEN 'medium' ELSE 'low' END AS level,
    CASE WHEN n + o_orderkey % 3 = 0 THEN 0.3::DOUBLE ELSE round_even(least(0.95::DOUBLE, n / (n + o_orderkey % 3)::DOUBLE * 0.85::DOUBLE), 6) END AS confidence FROM {_FEATURES}"""
)
def ai_level_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = (F.col("o_orderkey") % 3).cast("int")
    return features(spark, sf_dir).select("o_orderkey", semantic.level(F.col("rs")).alias("level"), F.bround(semantic.confidence(F.col("n"), unknown), 6).alias("confidence"))


@query(f"WITH {_E} SELECT case_id, quote, event_id, severity FROM e QUALIFY row_number() OVER (PARTITION BY case_id, quote ORDER BY event_id) = 1")
def evidence_first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.first_of_key(evidence(spark, sf_dir), "case_id", "quote", "event_id").select("case_id", "quote", "event_id", "severity")


_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_PARSED = "source IN ('deterministic_url', 'deterministic_header', 'html_parser')"


@query(
    f"""WITH {_E}, f AS (SELECT case_id, quote, source, min(event_id) AS first FROM e GROUP BY ALL),
    s AS (SELECT case_id, quote, list(source ORDER BY first) AS sources, arg_min(source, first) AS src, arg_min(source, first) FILTER (source <> 'llm') AS own_src FROM f GROUP BY ALL),
    g AS (SELECT case_id, quote, max({_RANK}) FILTER ({_PARSED}) AS own, max({_RANK}) FILTER (source = 'llm') AS model, arg_min(severity, event_id) AS first FROM e GROUP BY ALL)
    SELECT case_id, quote, array_to_string(sources, ',') AS sources, coalesce(['low', 'medium', 'high'][own], ['low', 'medium', 'high'][model], first) AS severity,
    CASE WHEN own IS NOT NULL THEN own_src WHEN model IS NOT NULL THEN 'llm' ELSE src END AS source FROM s JOIN g USING (case_id, quote)"""
)
def evidence_across_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.across_sources(evidence(spark, sf_dir), "case_id", "quote", "event_id").withColumn("sources", F.array_join("sources", ","))


_FORM = lambda c: f"lower(translate(regexp_replace({c}, '[ \\t\\n\\r\\f\\v]+', '', 'g'), '：／．？＝＆（），。', ':/.?=&(),.'))"
_QUOTE = "CASE WHEN doc_id % 3 = 0 THEN substr(text, 5, 30) WHEN doc_id % 3 = 1 THEN replace(substr(text, 2, 25), ' ', '  ') ELSE substr(text, 1, 3) || '#' END"


@query(f"SELECT doc_id, coalesce(q <> '' AND text <> '' AND (contains(text, q) OR (length({_FORM('q')}) >= 8 AND contains({_FORM('text')}, {_FORM('q')}))), false) AS found FROM (SELECT *, {_QUOTE} AS q FROM documents)")
def quote_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id") % 3
    quote = F.when(k == 0, F.substring(t, 5, 30)).when(k == 1, F.replace(F.substring(t, 2, 25), F.lit(" "), F.lit("  "))).otherwise(F.concat(F.substring(t, 1, 3), F.lit("#")))
    return table(spark, sf_dir, "documents").select("doc_id", semantic.quote_found(quote, t).alias("found"))


_N = lambda *words: " + ".join(f"CASE WHEN contains(coalesce(text, ''), '{w}') THEN 1 ELSE 0 END" for w in words)


@query(
    f"""SELECT doc_id, CASE WHEN u + t > 0 THEN CAST(least(100, u * 25 + t * 30) AS INTEGER) END AS urgency, CASE WHEN r > 0 THEN CAST(least(100, r * 30) AS INTEGER) END AS information,
    CASE WHEN er + ic > 0 THEN CAST(least(100, er * 10 + ic * 15) AS INTEGER) END AS language FROM (
    SELECT doc_id, {_N('the', 'now', 'ing', 'soon')} AS u, {_N('with', 'lose')} AS t, {_N('pass', 'for', 'and', 'code')} AS r, {_N('teh', 'a')} AS er, {_N('of')} AS ic FROM documents)"""
)
def ai_candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [("the", "now", "ing", "soon"), ("with", "lose"), ("pass", "for", "and", "code"), ("teh", "a"), ("of",)]
    found = semantic.candidate_scores(F.col("text"), *[semantic.strings(x) for x in lists])
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("s")).select("doc_id", "s.*")


_KNOWN = lambda names: "(" + " OR ".join(f"host = '{n}' OR ends_with(host, '.{n}')" for n in names) + ")"
_POSING = f"contains(host, '{NAME}') AND NOT {_OFFICIAL}"
_BAD = "regexp_extract(host, '(\\.(?:" + "|".join(semantic.BAD_TLDS) + "))$', 1)"
_IPV4 = "regexp_matches(host, '^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.|$)){4}$')"
_SAFETY = f"""u AS (SELECT page_id, host, {_registered('host')} AS registered, {_IPV4} AS ip, regexp_extract(authority, '^(.*)@', 1) <> '' AS userinfo, starts_with(host, 'xn--') OR contains(host, '.xn--') AS puny,
 {_POSING} AS posing, {_BAD} AS tld, {_KNOWN(semantic.SHORTENERS)} AS shortener, {_KNOWN(semantic.DYNAMIC_HOSTS)} AS ddns, port FROM {_URLS})"""


@query(
    f"""WITH {_SAFETY} SELECT page_id, host AS hostname, registered AS registered_domain, posing AS impersonates, tld <> '' AS has_suspicious_tld, CASE WHEN host = '' THEN 'no_hostname' ELSE array_to_string(list_filter([
    CASE WHEN ip THEN 'uses_ipv4' END, CASE WHEN userinfo THEN 'url_userinfo' END, CASE WHEN puny THEN 'punycode' END, CASE WHEN posing THEN 'impersonates_{NAME}' END, CASE WHEN tld <> '' THEN 'suspicious_tld:' || tld END,
    CASE WHEN shortener THEN 'shortener' END, CASE WHEN ddns THEN 'ddns' END, CASE WHEN port NOT IN (80, 443) THEN 'non_std_port:' || port END], lambda x: x IS NOT NULL), ',') END AS issues FROM u"""
)
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", semantic.url_safety(F.col("url"), NAME, OFFICIAL).alias("f"))
    return rows.select("page_id", *[F.col(f"f.{c}") for c in ("hostname", "registered_domain", "impersonates", "has_suspicious_tld")], F.array_join("f.issues", ",").alias("issues"))


@query(
    f"""WITH {_SAFETY} SELECT page_id, CASE WHEN posing OR userinfo THEN 'high' ELSE 'low' END AS severity, array_to_string(list_filter([
    CASE WHEN posing AND tld <> '' THEN 'url_{NAME}_impersonation_and_suspicious_tld' WHEN posing THEN 'url_{NAME}_impersonation' END, CASE WHEN userinfo THEN 'url_userinfo_deception' END, CASE WHEN ip THEN 'url_valid_ip_host' END,
    CASE WHEN puny AND posing THEN 'url_punycode_impersonation' END, CASE WHEN shortener AND NOT posing THEN 'url_shortener_only' END, CASE WHEN ddns THEN 'url_ddns_service' END,
    CASE WHEN tld <> '' AND NOT posing THEN 'url_suspicious_tld_only' END], lambda x: x IS NOT NULL), ',') AS rule_ids,
    CAST((CASE WHEN tld <> '' THEN 30 ELSE 0 END) + (CASE WHEN posing THEN 50 ELSE 0 END) + (CASE WHEN ddns THEN 40 ELSE 0 END) + (CASE WHEN shortener THEN 20 ELSE 0 END) + (CASE WHEN ip THEN 30 ELSE 0 END) + (CASE WHEN userinfo THEN 60 ELSE 0 END) AS INTEGER) AS points
    FROM u WHERE host <> '' AND (ip OR userinfo OR puny OR posing OR tld <> '' OR shortener OR ddns OR port NOT IN (80, 443))"""
)
def url_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", semantic.url_safety(F.col("url"), NAME, OFFICIAL).alias("f"))
    rows = rows.select("page_id", semantic.url_finding(F.col("f"), NAME).alias("e"), semantic.link_points(F.col("f")).alias("points")).filter("e IS NOT NULL")
    return rows.select("page_id", "e.severity", F.array_join("e.rule_ids", ",").alias("rule_ids"), "points")


_MAIL = """m AS (SELECT c_custkey, 'Name <User' || (c_custkey % 5) || '@' || ['mail.example.org', 'example-help.com', 'post.net'][1 + c_custkey % 3] || '>' AS sender,
 CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'user' || (c_custkey % 5) || '@mail.example.org' ELSE 'other@post.net' END AS reply_to,
 CASE WHEN c_custkey % 6 = 0 THEN '<bounce@post.net>' END AS return_path, ['spf=pass dkim=fail dmarc=fail', 'SPF=none', 'dkim=fail', ''][1 + c_custkey % 4] AS auth FROM customer),
 a AS (SELECT *, lower(regexp_extract(sender, '<([^<>]*)>', 1)) AS own, lower(coalesce(reply_to, '')) AS rt, lower(coalesce(regexp_extract(return_path, '<([^<>]*)>', 1), '')) AS rp, lower(auth) AS h FROM m)"""


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    user = F.concat(F.lit("User"), (k % 5).cast("string"), F.lit("@"))
    pick = lambda values, n: F.element_at(semantic.strings(values), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k,
        F.concat(F.lit("Name <"), user, pick(("mail.example.org", "example-help.com", "post.net"), 3), F.lit(">")).alias("sender"),
        F.when(k % 4 == 1, F.concat(F.lower(user), F.lit("mail.example.org"))).when(k % 4 > 1, F.lit("other@post.net")).alias("reply_to"),
        F.when(k % 6 == 0, F.lit("<bounce@post.net>")).alias("return_path"),
        pick(("spf=pass dkim=fail dmarc=fail", "SPF=none", "dkim=fail", ""), 4).alias("auth"),
    )


@query(f"WITH {_MAIL} SELECT c_custkey, own AS address, array_to_string(list_filter([CASE WHEN rt <> '' AND rt <> own THEN 'from_reply_to_mismatch' END, CASE WHEN rp <> '' AND rp <> own THEN 'from_return_path_mismatch' END], lambda x: x IS NOT NULL), ',') AS issues FROM a")
def mail_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = semantic.alignment_issues(F.col("sender"), F.col("reply_to"), F.col("return_path"))
    return mails(spark, sf_dir).select("c_custkey", semantic.address(F.col("sender")).alias("address"), F.array_join(issues, ",").alias("issues"))


_FAILED = "(CASE WHEN contains(h, 'spf=fail') THEN 1 ELSE 0 END + CASE WHEN contains(h, 'dkim=fail') THEN 1 ELSE 0 END + CASE WHEN contains(h, 'dmarc=fail') THEN 1 ELSE 0 END)"


@query(
    f"""WITH {_MAIL}, x AS (SELECT *, regexp_extract(own, '@([^@]*)$', 1) AS host FROM a), i AS (
    SELECT c_custkey, 'medium' AS severity, 'From:' || own || ' Reply-To:' || rt AS quote, 'from_replyto_mismatch' AS rule FROM x WHERE rt <> '' AND rt <> own
    UNION ALL SELECT c_custkey, 'medium', 'From:' || own || ' Reply-To:' || rt, '' FROM x WHERE rp <> '' AND rp <> own
    UNION ALL SELECT c_custkey, 'high', own, '{NAME}_domain_impersonation' FROM x WHERE {_POSING}
    UNION ALL SELECT c_custkey, 'high', upper(k) || ': fail', '' FROM x, (VALUES ('spf'), ('dkim'), ('dmarc')) AS v(k) WHERE contains(h, k || '=fail')
    UNION ALL SELECT c_custkey, 'low', upper(k) || ': none', '' FROM x, (VALUES ('spf'), ('dkim'), ('dmarc')) AS v(k) WHERE contains(h, k || '=none')
    UNION ALL SELECT c_custkey, 'high', {_FAILED} || ' auth failures', 'auth_multiple_failures' FROM x WHERE {_FAILED} >= 2) SELECT * FROM i"""
)
def mail_header_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.header_evidence(F.col("sender"), F.col("reply_to"), F.col("return_path"), F.col("auth"), NAME, OFFICIAL)
    rows = mails(spark, sf_dir).select("c_custkey", F.explode(found).alias("e"))
    return rows.select("c_custkey", "e.severity", "e.quote", F.array_join("e.rule_ids", ",").alias("rule"))


_WORDS = ("urgency", " Urgency", "Info Request", "info_request", "SECRECY ", "phishy thing", "api key 1", "x" * 40, "Ärger", "1st", "reward lure", "")
_WORD_SQL = f"(SELECT event_id, {_sql_list(_WORDS)}[1 + event_id % {len(_WORDS)}] AS raw FROM events)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.element_at(semantic.strings(_WORDS), (F.col("event_id") % len(_WORDS) + 1).cast("int")).alias("raw"))


@query(f"SELECT event_id, t AS type, CASE WHEN t <> trim(raw) THEN trim(raw) END AS was FROM (SELECT *, CASE WHEN replace(lower(trim(raw)), ' ', '_') IN ({', '.join(repr(t) for t in _TYPES)}) THEN replace(lower(trim(raw)), ' ', '_') END AS t FROM {_WORD_SQL})")
def evidence_type_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("event_id", semantic.evidence_type(F.col("raw")).alias("e")).select("event_id", "e.type", "e.was")


@query(
    f"""SELECT event_id, CASE WHEN reason = '' THEN w ELSE '<redacted:' || reason || ':' || substr(sha256(w), 1, 12) || ':len' || length(w) || '>' END AS audited FROM (SELECT *, CASE
    WHEN regexp_matches(w, 'sk-|api[_-]?key|token|bearer|secret|authorization') THEN 'sensitive' WHEN length(w) > 31 OR w = '' THEN 'length' WHEN regexp_matches(w, '[^\\x00-\\x7F]') THEN 'non_ascii'
    WHEN NOT regexp_matches(w, '^[a-z][a-z0-9_ -]*$') THEN 'pattern' ELSE '' END AS reason FROM (SELECT event_id, lower(trim(raw)) AS w FROM {_WORD_SQL}))"""
)
def audited_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("event_id", semantic.audited_word(F.col("raw")).alias("audited"))


_BODY = "'{\"score\": ' || o_orderkey || ', \"note\": \"a {b}\"}'"
_ANSWER = f"CASE o_orderkey % 5 WHEN 0 THEN {_BODY} WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || {_BODY} || chr(10) || '```' WHEN 2 THEN 'So: ' || {_BODY} || ' done' WHEN 3 THEN 'none' ELSE '{{broken' END"


@query(
    f"""SELECT o_orderkey, TRY_CAST(coalesce(CASE WHEN json_valid(a) THEN a ->> '$.score' END, CASE WHEN json_valid(f) THEN f ->> '$.score' END, CASE WHEN json_valid(b) THEN b ->> '$.score' END) AS BIGINT) AS score
    FROM (SELECT o_orderkey, a, nullif(regexp_extract(a, '```(?:json)?\\s*([\\s\\S]*?)\\s*```', 1), '') AS f, nullif(regexp_extract(a, '([{{][\\s\\S]*[}}])', 1), '') AS b FROM (SELECT o_orderkey, {_ANSWER} AS a FROM orders))"""
)
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"score": '), k.cast("string"), F.lit(', "note": "a {b}"}'))
    fence = F.lit("```")
    answer = (
        F.when(k % 5 == 0, body)
        .when(k % 5 == 1, F.concat(F.lit("Here:\n"), fence, F.lit("json\n"), body, F.lit("\n"), fence))
        .when(k % 5 == 2, F.concat(F.lit("So: "), body, F.lit(" done")))
        .when(k % 5 == 3, F.lit("none"))
        .otherwise(F.lit("{{broken"))
    )
    parsed = semantic.response_json(answer)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_variant_get(parsed, "$.score", "bigint").alias("score"))


@query(
    """WITH e AS (SELECT event_id, event_id // 7 AS case_id, event_type || 'x' || (event_id % 9) AS text, 'x' || (event_id % 5) AS quote FROM events)
    SELECT a.case_id, a.event_id, min(b.event_id) AS block_id FROM e a LEFT JOIN e b ON a.case_id = b.case_id AND contains(b.text, a.quote) GROUP BY ALL"""
)
def quote_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        k, F.floor(k / 7).alias("case_id"), F.concat("event_type", F.lit("x"), (k % 9).cast("string")).alias("text"), F.concat(F.lit("x"), (k % 5).cast("string")).alias("quote")
    )
    blocks = rows.select("case_id", F.col("event_id").alias("block_id"), "text", F.lit(None).cast("string").alias("corrected_text"))
    return semantic.blocks_of_quotes(rows.select("case_id", "event_id", "quote"), blocks, "case_id", "event_id").select("case_id", "event_id", "block_id")
