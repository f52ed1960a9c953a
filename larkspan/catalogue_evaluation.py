"""Queries of the service shell, the small offline detector and the evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.catalogue import _EVIDENCE_SQL, _FEATURES, _OFFICIAL, _PREDICTED, _URLS, evidence_rows, features, predictions, query, table
from larkspan.catalogue_semantic import _E, NAME, OFFICIAL, evidence_of_cases
from larkspan.operators import evaluation, service
from larkspan.operators.semantic import strings


def _case(table_: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table_.items()) + f" ELSE {default} END"


def _pick(values, number: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + {number} % {len(values)}]"


def _one_of(values, number):
    return F.element_at(strings(values), (number % len(values) + 1).cast("int"))


# Service ----------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_EVIDENCE_SQL} SELECT case_id, ord, rule_id, subject, CASE WHEN rule_id IN ('PASSWORD_FORM_UNTRUSTED_TARGET', 'HTML_PASSWORD_INPUT') THEN 'credential-form' WHEN starts_with(rule_id, 'FORM_') THEN 'form-action'
    WHEN grp = 'identity' THEN 'impersonation' ELSE {_case(service.CATEGORIES, 'grp', 'grp')} END AS category, CAST({_case(service.RULE_SEVERITY, 'severity', '30')} AS INTEGER) AS severity FROM e"""
)
def service_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence_rows(spark, sf_dir).select("case_id", "ord", "rule_id", "subject", service.rule_signal(F.col("rule_id"), F.col("grp"), F.col("severity")).alias("s"))
    return rows.select("case_id", "ord", "rule_id", "subject", "s.category", "s.severity")


_KINDS, _ORIGINS = ("url", "html", "text", "text"), ("email", "sms", "notice", "chat", "email")


@query(
    f"""SELECT event_id, CASE WHEN kind IN ('url', 'html') THEN kind WHEN origin IN ('email', 'sms') THEN origin ELSE 'text' END AS rule_type, CASE kind WHEN 'url' THEN 'link' WHEN 'html' THEN 'html'
    ELSE {_case(service.CONTENT_TYPES, 'origin', "'email'")} END AS content_type, length(left(content, 10000)) AS n_content FROM (SELECT event_id, {_pick(_KINDS, 'event_id')} AS kind, {_pick(_ORIGINS, 'event_id')} AS origin,
    repeat(event_type, CAST(event_id % 2500 AS INTEGER)) AS content FROM events)"""
)
def service_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    kind, origin, content = _one_of(_KINDS, k), _one_of(_ORIGINS, k), F.repeat("event_type", (k % 2500).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", service.rule_input(kind, origin).alias("rule_type"), service.model_input(kind, origin, content).alias("m"))
    return rows.select("event_id", "rule_type", "m.content_type", F.length("m.content").cast("long").alias("n_content"))


_MODEL_SCORE = f"CASE WHEN count(*) FILTER (own) = 0 THEN 5 ELSE least(95, max({_case(service.MODEL_SEVERITY, 'severity', '25')}) FILTER (own) + greatest(count(DISTINCT type) FILTER (own) - 1, 0) * 5) END"
_STATES = ("success", "success", "insufficient_evidence", "failed", "success")


@query(f"WITH {_E} SELECT case_id, CAST({_MODEL_SCORE.replace('(own)', '(true)')} AS INTEGER) AS score FROM e GROUP BY case_id")
def semantic_signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_of_cases(spark, sf_dir).select("case_id", service.semantic_score(F.col("evidence")).alias("score"))


@query(
    f"""WITH {_E}, c AS (SELECT case_id, {_MODEL_SCORE} AS score, count(*) FILTER (own) AS n_own, count(*) FILTER (verification IN ('matched', 'deterministic')) AS n_seen
    FROM (SELECT *, source = 'llm' AND verification = 'matched' AS own FROM e) GROUP BY case_id),
    d AS (SELECT *, {_pick(_STATES, 'case_id')} AS status, case_id % 3 = 0 AS image, CASE WHEN case_id % 4 = 0 THEN 'not_requested' ELSE 'usable_first_attempt' END AS model,
    CASE WHEN case_id % 7 > 0 THEN CAST(case_id % 130 AS DOUBLE) END AS own_score, (case_id % 11) / 10.0::DOUBLE AS confidence, CASE WHEN case_id % 2 = 0 THEN 'reliable' ELSE 'low_confidence' END AS quality,
    CASE WHEN case_id % 5 > 0 THEN (case_id % 13) / 10.0::DOUBLE END AS ocr FROM c),
    f AS (SELECT *, CASE WHEN status <> 'success' AND image AND status = 'insufficient_evidence' THEN 'text could not be read from the image' WHEN status <> 'success' THEN 'not enough evidence'
    WHEN image AND own_score IS NULL THEN 'no usable score' WHEN NOT image AND model = 'not_requested' THEN 'the model was not active' END AS reason FROM d)
    SELECT case_id, reason AS skip_reason, CASE WHEN reason IS NOT NULL THEN 0 WHEN image THEN least(own_score, 100) ELSE CAST(score AS DOUBLE) END AS score, CASE WHEN reason IS NOT NULL THEN 0 ELSE round_even(least(1.0::DOUBLE,
    CASE WHEN NOT image AND quality = 'reliable' AND ocr IS NOT NULL THEN greatest(confidence, least(0.8::DOUBLE, ocr * 0.75::DOUBLE)) ELSE confidence END), 6) END AS confidence,
    CAST(CASE WHEN reason IS NOT NULL THEN 0 WHEN image THEN n_seen ELSE n_own END AS INTEGER) AS n_evidence FROM f"""
)
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("case_id")
    rows = evidence_of_cases(spark, sf_dir).select(
        k,
        service.translated(
            _one_of(_STATES, k),
            k % 3 == 0,
            F.when(k % 4 == 0, "not_requested").otherwise("usable_first_attempt"),
            F.col("evidence"),
            F.when(k % 7 > 0, (k % 130).cast("double")),
            k % 11 / 10.0,
            F.when(k % 2 == 0, "reliable").otherwise("low_confidence"),
            F.when(k % 5 > 0, k % 13 / 10.0),
        ).alias("t"),
    )
    return rows.select("case_id", "t.skip_reason", "t.score", F.bround("t.confidence", 6).alias("confidence"), "t.n_evidence")


_DETECTORS = """(SELECT event_id // 4 AS request_id, event_id AS ord, 'd' || (event_id % 4) AS detector, event_id % 9 = 0 AS failed, event_id % 7 > 0 AS answered, CASE WHEN event_id % 5 = 0 THEN 'why' || (event_id % 3) ELSE '' END AS reason FROM events)"""
_STATE = "CASE WHEN failed THEN 'failed' WHEN NOT answered OR reason <> '' THEN 'skipped' ELSE 'completed' END"


def _detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.floor(k / 4).alias("request_id"), k.alias("ord"), F.concat(F.lit("d"), (k % 4).cast("string")).alias("detector"), (k % 7 > 0).alias("answered"),
        service.detector_status(k % 9 == 0, k % 7 > 0, F.when(k % 5 == 0, F.concat(F.lit("why"), (k % 3).cast("string"))).otherwise("")).alias("s"),
        F.array(F.concat(F.lit("w"), (k % 2).cast("string"))).alias("warnings"),
    )
    return rows.select("request_id", "ord", "detector", "answered", "s.status", "s.detail", "warnings")


@query(f"SELECT ord, {_STATE} AS status, CASE WHEN failed THEN 'detector unavailable' WHEN NOT answered THEN 'input type not supported or service not configured' ELSE nullif(reason, '') END AS detail FROM {_DETECTORS}")
def detector_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detectors(spark, sf_dir).select("ord", "status", "detail")


@query(
    f"""WITH s AS (SELECT *, {_STATE} AS status FROM {_DETECTORS}), w AS (SELECT request_id, ord, status, CASE WHEN status = 'failed' THEN detector || ': detector unavailable' WHEN status = 'skipped' AND answered THEN detector || ': ' || reason
    WHEN status = 'completed' THEN detector || ': w' || (ord % 2) END AS said FROM s)
    SELECT request_id, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'completed') > 0 AS available, coalesce(array_to_string(list(said ORDER BY ord) FILTER (said IS NOT NULL), '|'), '') AS warnings FROM w GROUP BY request_id"""
)
def request_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.request_status(_detectors(spark, sf_dir)).withColumn("warnings", F.array_join("warnings", "|"))


_LEVEL = "CASE WHEN rs > 79 THEN 'critical' WHEN rs > 59 THEN 'high' WHEN rs > 29 THEN 'medium' ELSE 'low' END"


@query(
    f"SELECT o_orderkey, {_case(service.SUMMARIES, 'level', 'NULL')} AS summary, {_case({k: '|'.join(v) for k, v in service.ADVICE.items()}, 'level', 'NULL')} AS advice FROM (SELECT o_orderkey, {_LEVEL} AS level FROM {_FEATURES})".replace("sender's", "sender''s")
)
def level_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rs = F.col("rs")
    level = F.when(rs > 79, "critical").when(rs > 59, "high").when(rs > 29, "medium").otherwise("low")
    return features(spark, sf_dir).select("o_orderkey", service.summary(level).alias("summary"), F.array_join(service.advice(level), "|").alias("advice"))


@query(
    """SELECT o_orderkey, CASE WHEN ok THEN t END AS text, CASE WHEN ok THEN greatest(0, least(1, coalesce(c, 0))) END AS confidence, CASE WHEN ok THEN greatest(0, CAST(round_even(ms, 0) AS INTEGER)) END AS milliseconds, CASE WHEN NOT ok THEN 'INSUFFICIENT_TEXT' END AS error
    FROM (SELECT *, t <> '' AND s <> 'insufficient_evidence' AS ok FROM (SELECT o_orderkey, trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderstatus || ' ' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '' END) AS t,
    CASE WHEN o_orderkey % 7 = 0 THEN 'insufficient_evidence' ELSE 'reliable' END AS s, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 14) / 10.0::DOUBLE END AS c, (o_orderkey % 100) / 2.0::DOUBLE AS ms FROM orders))"""
)
def recognised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    corrected, full = F.when(k % 3 == 0, F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))), F.when(k % 3 == 1, F.col("o_orderpriority"))
    found = service.recognised(corrected, full, F.when(k % 7 == 0, "insufficient_evidence").otherwise("reliable"), F.when(k % 5 > 0, k % 14 / 10.0), k % 100 / 2.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("r")).select("o_orderkey", "r.*")


# The small offline detector ---------------------------------------------------------------------------------------------

_URL_SIGNALS = f"""[CASE WHEN lower(raw_scheme) <> 'https' THEN ('transport', 20) END, CASE WHEN regexp_extract(authority, '^(.*)@', 1) <> '' THEN ('url-obfuscation', 55) END, CASE WHEN length(url) > 160 THEN ('url-obfuscation', 25) END,
 CASE WHEN starts_with(host, 'xn--') OR contains(host, '.xn--') THEN ('domain', 45) END, CASE WHEN host IN ('example.net') THEN ('short-link', 35) END, CASE WHEN regexp_matches(host, '^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.|$)){{4}}$') THEN ('domain', 55) END,
 CASE WHEN len(string_split(host, '.')) >= 5 THEN ('domain', 25) END, CASE WHEN contains(host, '{NAME}') AND NOT {_OFFICIAL} THEN ('impersonation', 80) END]"""


@query(
    f"""WITH s AS (SELECT page_id, unnest(list_filter({_URL_SIGNALS}, lambda x: x IS NOT NULL)) AS s FROM {_URLS}), t AS (SELECT page_id, sum(s[2]) AS total, max(s[2]) AS top, count(*) AS n FROM s GROUP BY page_id)
    SELECT page_id, coalesce(n, 0) AS n_signals, CASE WHEN n IS NULL THEN 5 ELSE round_even(least(100.0::DOUBLE, top + 0.18::DOUBLE * (total - top)), 6) END AS score, CASE WHEN n IS NULL THEN 0.45::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM pages LEFT JOIN t USING (page_id)"""
)
def baseline_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", service.baseline_url(F.col("url"), ("example.net",), NAME, OFFICIAL).alias("s"))
    return rows.select("page_id", F.size("s").cast("long").alias("n_signals"), service.baseline_score(F.col("s")).alias("b")).select("page_id", "n_signals", "b.score", "b.confidence")


_PHRASES = ("请立即前往登录", "账号将被停用", "请输入您的密码", "账号需要验证", "逾期自动失效", "今天天气很好", "限时三天内提交")


@query(
    f"""SELECT event_id, regexp_matches(t, '立即.{{0,6}}(验证|登录|处理|领取)|账号.{{0,8}}(停用|冻结|过期)|限时.{{0,8}}(领取|验证|提交)|逾期.{{0,8}}(失效|停用|取消)') AS pressure,
    regexp_matches(t, '(输入|提交|填写).{{0,8}}(密码|验证码|银行卡|身份证)|(账号|密码).{{0,4}}(验证|更新|确认)') AS asked FROM (SELECT event_id, {_pick(_PHRASES, 'event_id')} || event_type AS t FROM events)"""
)
def baseline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", service.baseline_text(F.concat(_one_of(_PHRASES, F.col("event_id")), "event_type")).alias("s"))
    has = lambda name: F.exists("s", lambda x: x["category"] == name).alias
    return rows.select("event_id", has("social-engineering")("pressure"), has("credential-request")("asked"))


@query(
    """SELECT page_id, regexp_matches(html, '(?i)<input\\b[^>]*\\btype\\s*=\\s*["'']?password\\b') AS password, regexp_matches(html, '(?i)<iframe\\b') AS iframe,
    regexp_matches(html, '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') AS refresh FROM pages"""
)
def baseline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", service.baseline_page(F.col("html")).alias("s"))
    has = lambda name: F.exists("s", lambda x: x["category"] == name).alias
    return rows.select("page_id", has("credential-form")("password"), has("embedded-content")("iframe"), has("redirect")("refresh"))


# Evaluation ---------------------------------------------------------------------------------------------------------------

_OUTCOMES = "(SELECT actual AS a, CASE WHEN doc_id % 7 > 0 THEN predicted ELSE NOT actual END AS p, doc_id % 7 > 0 AS ok FROM " + _PREDICTED + ")"


@query(
    f"""WITH c AS (SELECT count(*) AS total, count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND NOT p) AS tn, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT ok) AS failed FROM {_OUTCOMES})
    SELECT total, tp, tn, fp, fn, round_even((tp + tn) / total::DOUBLE, 4) AS accuracy, round_even(tp / nullif(tp + fp, 0)::DOUBLE, 4) AS "precision", round_even(tp / nullif(tp + fn, 0)::DOUBLE, 4) AS recall,
    round_even(2 * tp / (2 * tp + fp + fn)::DOUBLE, 4) AS f1, round_even(tn / nullif(tn + fp, 0)::DOUBLE, 4) AS specificity, round_even(fp / nullif(fp + tn, 0)::DOUBLE, 4) AS fpr, round_even(fn / nullif(fn + tp, 0)::DOUBLE, 4) AS fnr,
    round_even(failed / total::DOUBLE, 4) AS failure_rate FROM c"""
)
def conservative_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.conservative(predictions(spark, sf_dir).withColumn("ok", F.col("doc_id") % 7 > 0), "actual", "predicted", "ok")


_LOCAL = "(SELECT actual AS a, CASE WHEN doc_id % 29 = 0 THEN NOT actual ELSE actual END AS p, doc_id % 97 > 0 AS passed, quality FROM " + _PREDICTED + ")"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return predictions(spark, sf_dir).select(k, "quality", "actual", F.when(k % 29 == 0, ~F.col("actual")).otherwise(F.col("actual")).alias("predicted"), (k % 97 > 0).alias("passed"))


@query(
    f"""WITH c AS (SELECT count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (NOT a AND NOT p) AS tn, count(*) FILTER (a AND NOT p) AS fn, round_even(count(*) FILTER (passed) / count(*)::DOUBLE, 6) AS rate FROM {_LOCAL}),
    m AS (SELECT *, round_even(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS pr, round_even(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS re, round_even(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round_even(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr FROM c),
    g AS (SELECT list_filter([CASE WHEN coalesce(pr, 0) < 0.95 THEN 'precision' END, CASE WHEN coalesce(re, 0) < 0.75 THEN 'recall' END, CASE WHEN f1 < 0.85 THEN 'f1' END, CASE WHEN fpr > 0.05 THEN 'false_positive_rate' END,
    CASE WHEN rate < 1 THEN 'contract_pass_rate' END], lambda x: x IS NOT NULL) AS failing, rate FROM m) SELECT rate AS contract_pass_rate, array_to_string(failing, ',') AS failed_gates, len(failing) = 0 AS passed FROM g"""
)
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir)
    rate = rows.agg(F.bround(F.count_if("passed") / F.count(F.lit(1)), 6).alias("contract_pass_rate"))
    metrics = evaluation.confusion(rows, "actual", "predicted").join(F.broadcast(rate))  # one row each
    return evaluation.quality_gates(metrics).select("contract_pass_rate", F.array_join("failed_gates", ",").alias("failed_gates"), "passed")


@query(f"SELECT quality, count(*) AS n, count(*) FILTER (p) AS n_positive, count(*) FILTER (a = p) AS correct, count(*) FILTER (passed) AS passed FROM {_LOCAL} GROUP BY quality")
def results_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_kind(_outcomes(spark, sf_dir), "quality", "actual", "predicted", "passed")


@query("SELECT doc_id, CASE WHEN actual THEN 'FN' ELSE 'FP' END AS kind FROM " + _PREDICTED + " WHERE doc_id % 29 = 0")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.errors(_outcomes(spark, sf_dir), "actual", "predicted").select("doc_id", "kind")


@query(
    "WITH s AS (SELECT CAST((event_id * 7919) % 1009 AS DOUBLE) AS v FROM events), l AS (SELECT list_sort(list(v)) AS l, count(*) AS n FROM s) SELECT n, l[1 + n // 2] AS p50, l[1 + CAST(floor(n * 0.95::DOUBLE) AS BIGINT)] AS p95 FROM l"
)
def latency_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.indexed_latencies(table(spark, sf_dir, "events").select((F.col("event_id") * 7919 % 1009).alias("v")), "v")


@query(f"WITH {_EVIDENCE_SQL}, c AS (SELECT rule_id, count(*) AS hits, count(DISTINCT case_id) AS cases FROM e GROUP BY rule_id) SELECT *, CAST(row_number() OVER (ORDER BY hits DESC, rule_id) AS INTEGER) AS rank FROM c")
def rule_hit_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.hit_counts(evidence_rows(spark, sf_dir), "rule_id")


@query(f"WITH {_EVIDENCE_SQL}, c AS (SELECT grp, count(*) AS hits, count(DISTINCT case_id) AS cases FROM e GROUP BY grp) SELECT *, CAST(row_number() OVER (ORDER BY hits DESC, grp) AS INTEGER) AS rank FROM c")
def group_hit_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.hit_counts(evidence_rows(spark, sf_dir), "grp")


@query(
    f"""SELECT o_orderkey, array_to_string(list(k ORDER BY v DESC, k)[1:3], ',') AS top FROM (SELECT o_orderkey, unnest([{{'k': 'sender', 'v': rs}}, {{'k': 'link', 'v': ai}}, {{'k': 'urgency', 'v': rc * 50}}, {{'k': 'info', 'v': CASE WHEN n > 2 THEN n * 20 END}}], recursive := true) FROM {_FEATURES}) WHERE v IS NOT NULL GROUP BY o_orderkey"""
)
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    points = {"sender": F.col("rs"), "link": F.col("ai"), "urgency": F.col("rc") * 50, "info": F.when(n > 2, n * 20)}
    return features(spark, sf_dir).select("o_orderkey", F.array_join(evaluation.top_contributions(points), ",").alias("top"))


_COPY = "CASE WHEN p_partkey % 3 = 0 THEN replace(p_type, 'A', 'a') WHEN p_partkey % 3 = 1 THEN p_type || ' ' || p_brand ELSE p_name END"
_TOKENS = lambda c: f"list_filter(string_split_regex(trim({c}), '\\s+'), lambda w: w <> '')"
_CODED = lambda c: f"array_to_string(list_transform({c}, lambda w: chr(CAST(64 + list_position(known, w) AS INTEGER))), '')"


@query(
    f"""SELECT p_partkey, round_even(levenshtein({_CODED('f')}, {_CODED('t')}) / len(t)::DOUBLE, 6) AS wer FROM (SELECT *, list_distinct(list_concat(f, t)) AS known FROM (
    SELECT p_partkey, {_TOKENS(_COPY)} AS f, {_TOKENS('p_type')} AS t FROM part))"""
)
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).select("p_partkey", F.bround(evaluation.word_error_rate(F.col("found"), F.col("p_type")), 6).alias("wer"))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("p_partkey"), F.col("p_type")
    found = F.when(k % 3 == 0, F.replace(t, F.lit("A"), F.lit("a"))).when(k % 3 == 1, F.concat_ws(" ", t, "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(k, "p_type", "p_name", found.alias("found"))


_READ = "CASE page_id % 5 WHEN 0 THEN 'see ' || url || ' now' WHEN 1 THEN 'see ' || replace(url, '://', '://x') || ' now' WHEN 2 THEN 'see ' || replace(url, 'https://', 'http://') || ' now' WHEN 3 THEN 'see now' ELSE 'see ' || url || 'Z now' END"
_FOUND_HOST = "lower(regexp_extract(f, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]*)', 1))"
_TRUE_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]*)', 1))"


@query(
    f"""SELECT page_id, n = 1 AND f = url AS exact, n = 1 AND {_FOUND_HOST} = {_TRUE_HOST} AS domains, n = 0 OR split_part(f, ':', 1) = split_part(url, ':', 1) AS protocols,
    n = 0 OR regexp_extract({_FOUND_HOST}, '([^.]*)$', 1) = regexp_extract({_TRUE_HOST}, '([^.]*)$', 1) AS tlds
    FROM (SELECT page_id, url, regexp_extract({_READ}, '(https?://\\S*)', 1) AS f, CASE WHEN page_id % 5 = 3 THEN 0 ELSE 1 END AS n FROM pages)"""
)
def recognised_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir).select("page_id", evaluation.url_accuracy(F.col("found"), F.col("truth")).alias("u"))
    return rows.select("page_id", "u.exact", "u.domains", "u.protocols", "u.tlds")


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("page_id"), F.col("url")
    around = lambda c: F.concat(F.lit("see "), c, F.lit(" now"))
    swap = lambda a, b: F.replace(u, F.lit(a), F.lit(b))
    found = F.when(k % 5 == 0, around(u)).when(k % 5 == 1, around(swap("://", "://x"))).when(k % 5 == 2, around(swap("https://", "http://"))).when(k % 5 == 3, F.lit("see now")).otherwise(around(F.concat(u, F.lit("Z"))))
    return table(spark, sf_dir, "pages").select(k, around(u).alias("truth"), found.alias("found"))


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 1 AND NOT contains(url, 'x') THEN 'x' WHEN page_id % 5 = 4 AND NOT contains(url, 'Z') THEN 'Z' ELSE '' END AS fabricated FROM pages"""
)
def fabricated_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array_join(F.array_distinct(F.flatten(evaluation.fabricated(F.col("truth"), F.col("found")))), "")
    return _read(spark, sf_dir).select("page_id", made.alias("fabricated"))


@query(
    f"""WITH e AS (SELECT levenshtein(f, p_type) / length(p_type)::DOUBLE AS cer FROM (SELECT *, {_COPY} AS f FROM part))
    SELECT count(*) AS n, round_even(min(cer), 6) AS cer_least, round_even(max(cer), 6) AS cer_largest, 1.0::DOUBLE AS url_exact_rate, 1.0::DOUBLE AS url_domain_rate, 0 AS violations FROM e"""
)
def recognition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.recognition_summary(_copies(spark, sf_dir), "found", "p_type", "p_name")
    return rows.select("n", "cer_least", "cer_largest", "url_exact_rate", "url_domain_rate", F.col("violations").cast("int").alias("violations"))


_RIDS = ("A", "B", "C")


@query(
    """WITH c AS (SELECT o_orderkey AS k, ['low', 'medium', 'high', 'critical'][1 + o_orderkey % 4] AS level, o_orderkey % 4 AS r, CASE WHEN o_orderkey % 3 = 0 THEN 'normal' ELSE 'phishing' END AS label,
    CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 3 END AS e, CASE WHEN o_orderkey % 5 = 2 THEN ['low'] ELSE [] END AS allowed, ['A', 'B', 'C'][1:CAST(o_orderkey % 3 AS INTEGER)] AS hits FROM orders)
    SELECT k AS o_orderkey, array_to_string(list_filter([CASE WHEN e IS NOT NULL AND r < e THEN 'level below expected' END, CASE WHEN e IS NULL AND len(allowed) > 0 AND level <> 'low' THEN 'level not allowed' END,
    CASE WHEN k % 7 = 0 AND NOT list_contains(hits, 'A') THEN 'missing:A' END, CASE WHEN k % 7 = 0 AND NOT list_contains(hits, 'B') THEN 'missing:B' END, CASE WHEN k % 6 = 2 AND list_contains(hits, 'B') THEN 'forbidden:B' END,
    CASE WHEN label = 'normal' AND level <> 'low' THEN 'normal above low' END, CASE WHEN label = 'phishing' AND len(hits) = 0 THEN 'phishing without evidence' END], lambda x: x IS NOT NULL), ',') AS failures FROM c"""
)
def case_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    levels = ("low", "medium", "high", "critical")
    none = F.array().cast("array<string>")
    failures = evaluation.case_failures(
        F.when(k % 3 == 0, "normal").otherwise("phishing"),
        _one_of(levels, k),
        F.when(k % 5 < 2, _one_of(levels[:3], k)),
        F.when(k % 5 == 2, F.array(F.lit("low"))).otherwise(none),
        F.when(k % 7 == 0, strings(("A", "B"))).otherwise(none),
        F.when(k % 6 == 2, strings(("B",))).otherwise(none),
        F.slice(strings(_RIDS), F.lit(1), (k % 3).cast("int")),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(failures, ",").alias("failures"))
