"""The registered queries over the synthetic tables, each with SQL that gives the same rows."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.functions import urls as U
from larkspan.operators import dom, evaluation, fusion, ocr, rules, scoring, semantic
from larkspan.plans import detect
from larkspan.plans import profile as P
from larkspan.session import bounded_batches

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    """The modules that register more queries here."""
    from larkspan import catalogue_cases, catalogue_domains, catalogue_evaluation, catalogue_readings, catalogue_runs, catalogue_semantic  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.page_risks(table(spark, sf_dir, "pages"))


# SQL fragments for DuckDB ---------------------------------------------------------------------------------------------

_AUTH = "regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$', {k})"
_SCHEME, _AUTHORITY, _PATH, _QUERY, _FRAGMENT = (_AUTH.format(k=k) for k in range(1, 6))
_HOST = f"lower(regexp_replace(regexp_replace(regexp_replace({_AUTHORITY}, '^.*@', ''), ':[^:\\]]*$', ''), '\\.+$', ''))"
_PORT = f"try_cast(regexp_extract(regexp_replace({_AUTHORITY}, '^.*@', ''), ':([^:\\]]*)$', 1) AS INTEGER)"
_TWO = ", ".join(f"'{s}'" for s in P.TWO_PART_SUFFIXES)


def _registered(h: str) -> str:
    labels = f"string_split({h}, '.')"
    last = lambda k: f"array_to_string({labels}[-{k}:], '.')"
    return f"CASE WHEN regexp_matches({h}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') OR len({labels}) <= 2 THEN {h} WHEN {last(2)} IN ({_TWO}) THEN {last(3)} ELSE {last(2)} END"


_URLS = f"(SELECT page_id, url, html, {_SCHEME} AS raw_scheme, {_AUTHORITY} AS authority, {_PATH} AS path, {_QUERY} AS query, {_FRAGMENT} AS fragment, {_HOST} AS host, {_PORT} AS port FROM pages)"
_OFFICIAL = "(host = 'example.org' OR ends_with(host, '.example.org'))"

# URLs and domains -------------------------------------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", U.parts(F.col("url")).alias("p"))


@query(f"SELECT page_id, lower(raw_scheme) AS scheme, host, port, path, query, fragment FROM {_URLS}")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("page_id", *[F.col(f"p.{c}").alias(c) for c in ("scheme", "host", "port", "path", "query", "fragment")])


@query(
    f"""SELECT page_id, lower(raw_scheme) || '://' || host || CASE WHEN port IS NULL OR (lower(raw_scheme) = 'http' AND port = 80) OR (lower(raw_scheme) = 'https' AND port = 443)
    THEN '' ELSE ':' || port END || path || CASE WHEN query = '' THEN '' ELSE '?' || query END || CASE WHEN fragment = '' THEN '' ELSE '#' || fragment END AS url_key FROM {_URLS}"""
)
def url_canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_key(F.col("url")).alias("url_key"))


@query(f"SELECT page_id, host, {_registered('host')} AS registered FROM {_URLS}")
def registered_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("page_id", F.col("p.host").alias("host"), U.registered_domain(F.col("p.host")).alias("registered"))


@query(f"SELECT page_id, CAST(len(string_split(host, '.')) - len(string_split({_registered('host')}, '.')) AS INTEGER) AS levels FROM {_URLS}")
def subdomain_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("page_id", U.subdomain_levels(F.col("p.host")).alias("levels"))


@query(f"SELECT page_id, {_OFFICIAL} AS official, ends_with(host, '.example.org') AS below FROM {_URLS}")
def official_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, domains = F.col("p.host"), P.DEMO.official_domains
    return _parsed(spark, sf_dir).select("page_id", U.belongs_to(host, domains).alias("official"), U.belongs_to(host, domains, itself=False).alias("below"))


@query(
    f"""SELECT page_id, levenshtein({_registered('host')}, 'example.org') AS distance,
    round(1 - levenshtein({_registered('host')}, 'example.org') / CAST(greatest(length({_registered('host')}), 11) AS DOUBLE), 6) AS similarity FROM {_URLS}"""
)
def domain_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, official = U.registered_domain(F.col("p.host")), F.lit("example.org")
    return _parsed(spark, sf_dir).select("page_id", F.levenshtein(own, official).cast("long").alias("distance"), F.round(U.similarity(own, official), 6).alias("similarity"))


_CONFUSABLES = (("0", "o"), ("1", "l"), ("w", "vv"))
_SKELETON = "replace(translate(host, '01', 'ol'), 'w', 'vv')"


@query(f"SELECT page_id, {_SKELETON} AS skeleton, NOT {_OFFICIAL} AND {_SKELETON} = 'example.org' AS homograph FROM {_URLS}")
def confusable_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, profile = F.col("p.host"), dataclasses.replace(P.DEMO, confusables=_CONFUSABLES)
    return _parsed(spark, sf_dir).select("page_id", T.skeleton(host, _CONFUSABLES).alias("skeleton"), rules.looks_official(host, profile).alias("homograph"))


_SIGNS = "(contains(lower(path || '?' || query), 'login') OR contains(lower(path || '?' || query), 'page') OR contains(lower(path || '?' || query), 'ref'))"


_PLAIN_FORM = "regexp_matches(html, '(?i)<form[^>]*action\\s*=\\s*[\"'']?http://')"


@query(
    f"""SELECT page_id, CASE WHEN {_SIGNS} THEN 0.75::DOUBLE WHEN {_PLAIN_FORM} THEN 0.55::DOUBLE ELSE 0.30::DOUBLE END AS confidence
    FROM {_URLS} WHERE lower(raw_scheme) = 'http' OR (lower(raw_scheme) <> 'https' AND ({_SIGNS} OR {_PLAIN_FORM}))"""
)
def url_non_https(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.page_evidence(F.col("url"), F.col("html"), P.DEMO)
    rows = table(spark, sf_dir, "pages").select("page_id", F.get(F.filter(found, lambda e: e["rule_id"] == "URL_NON_HTTPS"), F.lit(0)).alias("e"))
    return rows.filter("e IS NOT NULL").select("page_id", F.col("e.confidence").alias("confidence"))


#: URLs of pages with a port, a foreign host or a path added, so that the rules have something to find.
_PLACED_SQL = """(SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^(https?://[^/]+)', '\\1:8080') WHEN 1 THEN regexp_replace(url, '^(https?://[^/]+)', '\\1:443')
  WHEN 2 THEN regexp_replace(url, '^(https?://[^/]+)', '\\1.evil.test') ELSE url || '/to/EXAMPLE.org' END AS url FROM pages)"""
_PLACED_URLS = _URLS.replace("FROM pages", f"FROM {_PLACED_SQL}")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, host = F.col("page_id") % 4, "^(https?://[^/]+)"
    url = F.when(k == 0, F.regexp_replace("url", host, "$1:8080")).when(k == 1, F.regexp_replace("url", host, "$1:443")).when(k == 2, F.regexp_replace("url", host, "$1.evil.test")).otherwise(F.concat("url", F.lit("/to/EXAMPLE.org")))
    return table(spark, sf_dir, "pages").select("page_id", U.parts(url).alias("p"))


@query(f"SELECT page_id, port FROM {_PLACED_URLS} WHERE port NOT IN (80, 443) AND NOT (host = 'm.example.com' AND port = 8080)")
def suspicious_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).filter(rules.suspicious_port(F.col("p"), P.DEMO)).select("page_id", F.col("p.port").alias("port"))


@query(f"SELECT page_id FROM {_PLACED_URLS} WHERE (NOT {_OFFICIAL} AND contains(host, 'example.org')) OR contains(lower(path), 'example.org')")
def nested_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).filter(rules.nested_official(F.col("p"), P.DEMO)).select("page_id")


@query("SELECT page_id, CAST(i AS INTEGER) AS link_no, links[i + 1] AS href FROM (SELECT page_id, links, unnest(range(len(links))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS links FROM pages))")
def html_links_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("link_no", "href"))


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS visible FROM pages")
def visible_text_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.visible_text(F.col("html"))).cast("long").alias("visible"))


@query("SELECT page_id, url_decode(url_decode(replace(url, '/en/', '/%2565n%2F'))) AS decoded FROM pages")
def percent_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.percent_decode(F.replace("url", F.lit("/en/"), F.lit("/%2565n%2F"))).alias("decoded"))


# Text -------------------------------------------------------------------------------------------------------------------

_EDGE, _CHAR, _END = "(^|[^A-Za-z0-9._%+*-])", "[A-Za-z0-9._%+-]", "(@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]*[A-Za-z])"


@query("SELECT doc_id, regexp_replace(replace(text, 'the', chr(8203) || 't' || chr(173) || 'he'), '[' || chr(8203) || '-' || chr(8207) || chr(173) || ']', '', 'g') AS stripped FROM documents")
def zero_width_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.replace("text", F.lit("the"), F.lit("​t­he"))
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_invisible(marked).alias("stripped"))


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_EDGE}({_CHAR}){_CHAR}+({_CHAR}){_END}', '\\1\\2***\\3\\4', 'g'),
    '{_EDGE}({_CHAR})({_CHAR}){_END}', '\\1\\2*\\3\\4', 'g'), '{_EDGE}({_CHAR}){_END}', '\\1\\2*\\3', 'g'),
    '(^|[^0-9])(1[3-9][0-9])[0-9]{{4}}([0-9]{{4}})([^0-9]|$)', '\\1\\2****\\3\\4', 'g') AS redacted FROM documents"""
)
def redact_email_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact_phones(T.redact_emails(F.col("text"))).alias("redacted"))


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("SELECT conv_id, turn, " + ", ".join(f"{_any(w)} AS {r.lower()}" for r, w in P.DEMO.wording.items()) + " FROM conversations")
def wording_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[T.any_word(F.col("text"), w).alias(r.lower()) for r, w in P.DEMO.wording.items()])


@query(
    """SELECT doc_id, CAST(coalesce(list_position(list_transform(list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?。！？\\n]+'),
    lambda s: trim(s)), lambda s: s <> ''), lambda s: contains(s, 'within') OR contains(s, 'when')), true), 0) - 1 AS INTEGER) AS sentence FROM documents"""
)
def sentence_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence_with(F.col("text"), ("within", "when")).alias("sentence"))


_NAME = "lower(p_name) || '.' || lower(p_brand) || CASE WHEN p_size % 2 = 0 THEN '.exe' ELSE '.txt' END"


@query(f"SELECT p_partkey, array_to_string(list_reverse(string_split({_NAME}, '.')[2:]), '>') AS layers FROM part")
def attachment_ext_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lower("p_name"), F.lit("."), F.lower("p_brand"), F.when(F.col("p_size") % 2 == 0, ".exe").otherwise(".txt"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.extension_layers(name), ">").alias("layers"))


@query("SELECT doc_id, sha256(concat_ws('|', lower(translate(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g'), '：／．？＝＆（），。', ':/.?=&(),.')), lang)) AS evidence_key FROM documents")
def evidence_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.evidence_key(F.col("text"), F.col("lang")).alias("evidence_key"))


@query()
def normalize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    n = T.normalized(F.col("text"), F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", F.length("n.text").alias("n_chars"), F.array_join("n.operations", ",").alias("operations"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'EMPTY_INPUT' WHEN octet_length(encode(text)) > 8000 THEN 'PAYLOAD_TOO_LARGE' END AS error_code FROM documents")
def input_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.size_error(F.col("text"), 8000).alias("error_code"))


# Scoring on evidence derived from lineitem --------------------------------------------------------------------------------


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, ord, rule_id, grp, severity, base, confidence, context, subject: synthetic evidence of any size."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("ord"),
        (F.col("l_partkey") % len(P.RULES)).cast("int").alias("rule_ix"),
        F.concat(F.lit("url:"), (F.col("l_suppkey") % 3).cast("string")).alias("subject"),
        F.col("l_quantity").cast("int").alias("base"),
        (0.5 + 5 * F.col("l_discount")).alias("confidence"),
        F.lit(1.0).alias("context"),
        F.col("l_partkey").alias("part"),
    )
    defined = F.broadcast(scoring.rule_table(spark).select("rule_ix", "rule_id", "grp", "severity"))
    return items.join(defined, "rule_ix")


_RULES_SQL = "(VALUES " + ", ".join(f"({k}, '{r}', '{g}', '{s}')" for k, (r, g, s, _, _) in enumerate(P.RULES)) + ") AS r(rule_ix, rule_id, grp, severity)"
_PAIRS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in P.SUPPRESSES) + ") AS p(source_rule, target_rule)"
_CAPS_SQL = "(VALUES " + ", ".join(f"('{g}', {c}::DOUBLE)" for g, c in P.CAPS.items()) + ") AS c(grp, cap)"
_EVIDENCE_SQL = f"""e AS (SELECT l_orderkey AS case_id, l_linenumber AS ord, rule_id, grp, severity, 'url:' || (l_suppkey % 3) AS subject,
 CAST(l_quantity AS INTEGER) AS base, 0.5 + 5 * l_discount AS confidence, l_partkey AS part FROM lineitem JOIN {_RULES_SQL} ON rule_ix = l_partkey % {len(P.RULES)})"""
_ACTIVE_SQL = f"""{_EVIDENCE_SQL}, t AS (SELECT DISTINCT case_id, target_rule AS rule_id, subject FROM e JOIN {_PAIRS_SQL} ON e.rule_id = source_rule),
 a AS (SELECT e.* FROM e ANTI JOIN t USING (case_id, rule_id, subject))"""
_RANKED_SQL = f"""{_ACTIVE_SQL}, k AS (SELECT *, CAST(round_even(base * confidence, 0) AS INTEGER) AS eff FROM a),
 w AS (SELECT *, row_number() OVER (PARTITION BY case_id, grp ORDER BY eff DESC, ord, part) AS rank FROM k),
 f AS (SELECT *, round_even(eff * CASE WHEN rank = 1 THEN 1.0::DOUBLE WHEN rank = 2 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END, 0) AS points FROM w)"""
_CAPPED_SQL = f"""{_RANKED_SQL}, s AS (SELECT f.*, cap, sum(points) OVER g AS total, count(*) OVER g AS n FROM f JOIN {_CAPS_SQL} USING (grp) WINDOW g AS (PARTITION BY case_id, grp)),
 z AS (SELECT *, CASE WHEN total > cap THEN round_even(points * (cap / total), 0) ELSE points END AS scaled FROM s),
 q AS (SELECT *, CAST(CASE WHEN rank = n AND total > cap THEN greatest(scaled - greatest(sum(scaled) OVER (PARTITION BY case_id, grp) - cap, 0), 0) ELSE scaled END AS INTEGER) AS capped FROM z)"""


@query(f"WITH {_EVIDENCE_SQL} SELECT rule_id, severity, count(*) AS n, count(DISTINCT case_id) AS cases FROM e GROUP BY ALL")
def rule_evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_rows(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("case_id").alias("cases"))


@query(f"WITH {_ACTIVE_SQL} SELECT case_id, ord, rule_id, subject FROM a")
def suppression_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.suppressed_removed(evidence_rows(spark, sf_dir)).select("case_id", "ord", "rule_id", "subject")


@query(f"WITH {_RANKED_SQL} SELECT case_id, grp, CAST(rank AS INTEGER) AS rank, eff, CAST(points AS INTEGER) AS points FROM f")
def group_attenuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.attenuated(scoring.suppressed_removed(evidence_rows(spark, sf_dir)))
    return rows.select("case_id", "grp", "rank", "eff", F.col("points").cast("int").alias("points"))


@query(f"WITH {_CAPPED_SQL} SELECT case_id, grp, CAST(rank AS INTEGER) AS rank, capped FROM q")
def group_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.capped(scoring.attenuated(scoring.suppressed_removed(evidence_rows(spark, sf_dir))))
    return rows.select("case_id", "grp", "rank", "capped")


_GATE_SQL = f"""{_CAPPED_SQL}, h AS (SELECT case_id, CAST(least(sum(capped), 100) AS INTEGER) AS raw, max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS worst,
 count(DISTINCT CASE WHEN severity = 'high' AND confidence >= 0.8 THEN grp END) AS highs, coalesce(bool_or(severity = 'medium' AND confidence >= 0.75), false) AS mediums FROM q GROUP BY case_id),
 l AS (SELECT *, CASE WHEN highs >= 2 THEN 3 WHEN highs = 1 THEN 2 WHEN mediums THEN 1 ELSE 0 END AS floor_rank,
 least(CASE WHEN raw <= 29 THEN 0 WHEN raw <= 59 THEN 1 WHEN raw <= 79 THEN 2 ELSE 3 END, CASE WHEN worst = 0 THEN 0 WHEN worst = 1 OR highs = 0 THEN 1 ELSE 3 END) AS candidate FROM h),
 m AS (SELECT *, greatest(candidate, floor_rank) AS lr FROM l),
 gate AS (SELECT case_id, raw, CAST(greatest([0, 30, 60, 80][lr + 1], least(raw, [29, 59, 79, 100][lr + 1])) AS INTEGER) AS score,
 ['low', 'medium', 'high', 'critical'][lr + 1] AS level, ['low', 'medium', 'high', 'critical'][floor_rank + 1] AS floor, highs >= 2 AS critical_lock FROM m)"""


@query(f"WITH {_GATE_SQL} SELECT * FROM gate")
def risk_level_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored_rows(evidence_rows(spark, sf_dir)).select("case_id", "raw", "score", "level", "floor", "critical_lock")


def evidence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("ord", "rule_id", "grp", "severity", "base", "confidence", "context", "subject")
    return evidence_rows(spark, sf_dir).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("evidence"))


@query(f"WITH {_GATE_SQL} SELECT * FROM gate")
def risk_array_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.scored_arrays(evidence_arrays(spark, sf_dir))
    return rows.select("case_id", *[F.col(f"risk.{c}").alias(c) for c in ("raw", "score", "level", "floor", "critical_lock")])


@query(
    f"""WITH {_ACTIVE_SQL}, b AS (SELECT case_id, grp, max(confidence) AS best FROM a WHERE severity = 'high' AND confidence >= 0.8 GROUP BY ALL),
    hi AS (SELECT case_id, count(*) AS n, min(best) AS weakest, max(best) AS strongest FROM b GROUP BY ALL),
    me AS (SELECT case_id, max(confidence) AS best FROM a WHERE severity = 'medium' AND confidence >= 0.75 GROUP BY ALL),
    al AS (SELECT case_id, max(confidence) AS best FROM a GROUP BY ALL)
    SELECT case_id, round_even(CASE WHEN n >= 2 THEN weakest WHEN n = 1 THEN strongest WHEN me.best IS NOT NULL THEN me.best ELSE al.best END, 4) AS confidence
    FROM al LEFT JOIN hi USING (case_id) LEFT JOIN me USING (case_id)"""
)
def risk_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = evidence_arrays(spark, sf_dir).withColumn("evidence", scoring.active(F.col("evidence")))
    return kept.select("case_id", scoring.confidence_of(F.col("evidence")).alias("confidence"))


@query(f"WITH {_GATE_SQL} SELECT level, critical_lock, count(*) AS n, min(score) AS least, max(score) AS most FROM gate GROUP BY ALL")
def level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_level_gate(spark, sf_dir).groupBy("level", "critical_lock").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(f"WITH {_ACTIVE_SQL} SELECT grp, rule_id, count(*) AS hits, count(DISTINCT subject) AS subjects FROM a GROUP BY ALL")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.suppressed_removed(evidence_rows(spark, sf_dir))
    return rows.groupBy("grp", "rule_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("subject").alias("subjects"))


@query()
def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.page_risks(table(spark, sf_dir, "pages"))


@query()
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.message_risks(table(spark, sf_dir, "documents"), "doc_id", "text")


# Fusion and semantic scores, on features derived from events and orders -----------------------------------------------------


@query(
    """SELECT user_id AS request_id, event_type AS key, array_to_string(list_distinct_ordered, ',') AS sources, severity, title FROM (
    SELECT user_id, event_type, list(src ORDER BY first_id) AS list_distinct_ordered, max(sev) AS severity, arg_min(ttl, first_id) AS title FROM (
    SELECT user_id, event_type, 's' || (event_id % 3) AS src, min(event_id) AS first_id, max(CAST(event_id % 97 AS INTEGER)) AS sev, 't' || min(event_id) AS ttl
    FROM events GROUP BY ALL) GROUP BY ALL)"""
)
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("request_id"),
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("key"),
        F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("source"),
        (F.col("event_id") % 97).cast("int").alias("severity"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"),
    )
    return fusion.merged_signals(rows)


_FEATURES = """(SELECT o_orderkey, CAST(o_orderkey % 101 AS DOUBLE) AS rs, CAST((o_orderkey * 7) % 101 AS DOUBLE) AS ai, (o_orderkey % 11) / 10.0::DOUBLE AS rc,
 ((o_orderkey * 3) % 11) / 10.0::DOUBLE AS ac, CAST(o_orderkey % 5 AS INTEGER) AS n, CASE WHEN o_orderkey % 4 = 0 THEN 0.8::DOUBLE END AS ocr FROM orders)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (k % 101).cast("double").alias("rs"),
        (k * 7 % 101).cast("double").alias("ai"),
        (k % 11 / 10.0).alias("rc"),
        (k * 3 % 11 / 10.0).alias("ac"),
        (k % 5).cast("int").alias("n"),
        F.when(k % 4 == 0, 0.8).alias("ocr"),
    )


@query(
    f"""WITH x AS (SELECT *, greatest(CASE WHEN rs > 79 THEN 3 WHEN rs > 59 THEN 2 WHEN rs > 29 THEN 1 ELSE 0 END,
    CASE WHEN ai >= 85 AND n >= CASE WHEN coalesce(ocr, 0) >= 0.75 THEN 2 ELSE 3 END AND ac >= 0.65 THEN 2 WHEN ai >= 65 AND n >= 2 AND ac >= 0.5 THEN 1 ELSE 0 END) AS fl FROM {_FEATURES}),
    y AS (SELECT *, CAST(round_even(least(greatest(rs + greatest(ai - 50, 0) / 50 * 15.0::DOUBLE * ac, [0, 30, 60, 80][fl + 1]), CASE WHEN fl = 3 THEN 100 ELSE 79 END), 0) AS INTEGER) AS score FROM x)
    SELECT o_orderkey, score, ['low', 'medium', 'high', 'critical'][greatest(fl, CASE WHEN score >= 80 THEN 3 WHEN score >= 70 THEN 2 WHEN score >= 30 THEN 1 ELSE 0 END) + 1] AS level FROM y"""
)
def fusion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    level = F.when(c("rs") > 79, "critical").when(c("rs") > 59, "high").when(c("rs") > 29, "medium").otherwise("low")
    rows = features(spark, sf_dir).select("o_orderkey", fusion.fused(c("rs"), level, c("rc"), c("ai"), c("ac"), c("n"), c("ocr")).alias("f"))
    return rows.select("o_orderkey", "f.score", "f.level")


@query(
    """SELECT l_orderkey AS case_id, l_linenumber AS line, round_even(greatest(0, least(100, CASE WHEN k >= 2 THEN least(v, 100) ELSE least(v, 69) END)), 0)::INTEGER AS score FROM (
    SELECT l_orderkey, l_linenumber, 1 + CASE WHEN b THEN 1 ELSE 0 END AS k, (l_quantity * 0.2::DOUBLE + CASE WHEN b THEN l_quantity * 0.25::DOUBLE ELSE 0 END) * CASE WHEN b THEN 1.5 ELSE 1 END AS v
    FROM (SELECT *, l_suppkey % 2 = 0 AS b FROM lineitem))"""
)
def ai_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, none = F.col("l_quantity"), F.lit(None).cast("double")
    dims = {"sender": q, "link": F.when(F.col("l_suppkey") % 2 == 0, q), "urgency": none, "info": none, "language": none, "attachment": none}
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), semantic.weighted(dims, F.lit(0.0), F.lit(0)).alias("score")
    )


_TYPES = ("urgency", "info_request", "suspicious_link", "sender_anomaly", "domain_anomaly", "impersonation", "credential_request", "payment_request", "secrecy", "reward_lure")
_TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in _TYPES) + "]"


@query(
    f"SELECT l_orderkey AS case_id, CAST(greatest(0, {', '.join('CASE WHEN ' + ' AND '.join(f'list_contains(types, {chr(39)}{t}{chr(39)})' for t in kinds) + f' THEN {b} ELSE 0 END' for kinds, b in semantic.PATTERNS)}) AS INTEGER) AS bonus "
    f"FROM (SELECT l_orderkey, list({_TYPES_SQL}[1 + l_partkey % 10]) AS types FROM lineitem GROUP BY l_orderkey)"
)
def composite_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in _TYPES])
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.element_at(kinds, (F.col("l_partkey") % 10 + 1).cast("int")).alias("kind"))
    return rows.groupBy("case_id").agg(F.collect_set("kind").alias("types")).select("case_id", semantic.composite(F.col("types")).alias("bonus"))


@query()
def dom_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", dom.flattened("html", "url").alias("dom"))
    return rows.select("page_id", F.col("dom.title").alias("title"), F.size("dom.forms").alias("n_forms"), F.size("dom.links").alias("n_links"))


_HEADER = "event_type || CASE event_id % 4 WHEN 0 THEN ' spf=pass dkim=fail' WHEN 1 THEN ' spf=none' WHEN 2 THEN ' dkim signed' ELSE '' END"


@query(
    "SELECT event_id, "
    + ", ".join(f"CASE WHEN contains(h, '{m}=pass') THEN 'pass' WHEN contains(h, '{m}=fail') THEN 'fail' WHEN contains(h, '{m}=none') THEN 'none' WHEN contains(h, '{m}') THEN 'present' ELSE 'unknown' END AS {m}" for m in ("spf", "dkim", "dmarc"))
    + f" FROM (SELECT event_id, lower({_HEADER}) AS h FROM events)"
)
def auth_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    header = F.concat("event_type", F.when(k == 0, " spf=pass dkim=fail").when(k == 1, " spf=none").when(k == 2, " dkim signed").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", *[semantic.auth_result(header, m).alias(m) for m in ("spf", "dkim", "dmarc")])


# Evaluation -------------------------------------------------------------------------------------------------------------

_PREDICTED = "(SELECT toxic = 1 AS actual, doc_id % 3 = 0 AS predicted, doc_id, quality FROM labels)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("actual"), (F.col("doc_id") % 3 == 0).alias("predicted"), "doc_id", "quality")


@query(
    f"""SELECT tp, fp, tn, fn, round_even((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round_even(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision",
    round_even(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1,
    round_even(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 6) AS false_positive_rate FROM (SELECT count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (NOT actual AND predicted) AS fp,
    count(*) FILTER (NOT actual AND NOT predicted) AS tn, count(*) FILTER (actual AND NOT predicted) AS fn FROM {_PREDICTED})"""
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(predictions(spark, sf_dir), "actual", "predicted")


@query(
    f"""SELECT quality, hits, n, round_even(greatest((p + z / (2 * n)) / (1 + z / n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + z / (4 * n * n)) / (1 + z / n), 0), 6) AS low,
    round_even(least((p + z / (2 * n)) / (1 + z / n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + z / (4 * n * n)) / (1 + z / n), 1), 6) AS high
    FROM (SELECT quality, count(*) FILTER (predicted) AS hits, count(*) AS n, count(*) FILTER (predicted) / count(*)::DOUBLE AS p, 1.96::DOUBLE * 1.96::DOUBLE AS z FROM {_PREDICTED} GROUP BY quality)"""
)
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).groupBy("quality").agg(F.count_if("predicted").alias("hits"), F.count(F.lit(1)).alias("n"))
    return rows.select("quality", "hits", "n", evaluation.wilson(F.col("hits"), F.col("n")).alias("w")).select("quality", "hits", "n", "w.low", "w.high")


@query("SELECT count(v) AS n, sum(v) AS total, round_even(sum(v) / count(v)::DOUBLE, 2) AS average, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, max(v) AS largest FROM (SELECT (event_id * 7919) % 1009 AS v FROM events)")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latencies(table(spark, sf_dir, "events").select((F.col("event_id") * 7919 % 1009).alias("v")), "v")


@query("SELECT quality, doc_id, CAST(pick AS INTEGER) AS pick FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS pick FROM labels) WHERE pick <= 20")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified(table(spark, sf_dir, "labels"), "quality", "doc_id", 20).select("quality", "doc_id", "pick")


@query()
def bootstrap_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap_f1(predictions(spark, sf_dir), "actual", "predicted")


@query("SELECT p_partkey, round_even(levenshtein(p_name, p_type) / length(p_type)::DOUBLE, 6) AS cer FROM part")
def character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.bround(evaluation.character_error_rate(F.col("p_name"), F.col("p_type")), 6).alias("cer"))


_BLOCKS = """(SELECT l_orderkey AS image_id, CAST(l_linenumber AS INTEGER) AS block_id, l_returnflag AS text, l_quantity / 50.0::DOUBLE AS confidence, CAST(l_partkey % 600 AS INTEGER) AS x, CAST(l_suppkey % 80 AS INTEGER) AS y FROM lineitem)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").cast("int").alias("block_id"),
        F.col("l_returnflag").alias("text"),
        (F.col("l_quantity") / 50.0).alias("confidence"),
        (F.col("l_partkey") % 600).cast("int").alias("x"),
        (F.col("l_suppkey") % 80).cast("int").alias("y"),
    )


@query(
    f"""WITH b AS (SELECT image_id, count(*) AS n_blocks, sum(round_even(confidence * 1e6::DOUBLE, 0)) / 1e6::DOUBLE / count(*) AS average, count(*) FILTER (confidence < 0.5) / count(*)::DOUBLE AS u FROM {_BLOCKS} GROUP BY image_id)
    SELECT image_id, n_blocks, CASE WHEN average < 0.15 OR u >= 0.95 THEN 'insufficient_evidence' WHEN average < 0.35 OR u >= 0.8 THEN 'low_confidence' WHEN score < 0.25 THEN 'insufficient_evidence'
    WHEN score < 0.45 THEN 'low_confidence' WHEN score < 0.65 THEN 'usable_with_warnings' ELSE 'reliable' END AS status
    FROM (SELECT *, round_even(0.25::DOUBLE * least(average / 0.7::DOUBLE, 1) + 0.25::DOUBLE * (1 - u) + 0.2::DOUBLE * least(n_blocks / 20.0::DOUBLE, 1) + 0.3::DOUBLE, 4) AS score FROM b)"""
)
def ocr_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.quality(blocks(spark, sf_dir)).select("image_id", "n_blocks", "status")


@query(
    f"""WITH g AS (SELECT *, x - lag(x) OVER (PARTITION BY image_id ORDER BY x, block_id, y) AS gap, x - lag(x) OVER (PARTITION BY image_id ORDER BY block_id, x, y) AS step FROM {_BLOCKS}),
    m AS (SELECT *, quantile_cont(gap, 0.5) OVER i AS typical, count(*) OVER i >= 3 AND stddev_pop(x) OVER i > 150 AS spread FROM g WINDOW i AS (PARTITION BY image_id)),
    c AS (SELECT *, sum(CASE WHEN spread AND step > 2 * typical THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY block_id, x, y ROWS UNBOUNDED PRECEDING) AS column_no FROM m)
    SELECT image_id, block_id, CAST(column_no AS BIGINT) AS column_no, CAST(row_number() OVER (PARTITION BY image_id ORDER BY column_no, y, block_id, x) AS INTEGER) AS reading_order FROM c"""
)
def ocr_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.reading_order(blocks(spark, sf_dir), 600).select("image_id", "block_id", "column_no", "reading_order")
