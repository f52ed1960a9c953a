"""Queries of trusted URLs, repaired readings, their audits and the choice between passes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.catalogue import _HOST, query, table
from larkspan.catalogue_evaluation import _one_of, _pick
from larkspan.functions import urls as U
from larkspan.operators import readings, trust

# Trusted URLs -----------------------------------------------------------------------------------------------------------

_SELECTED = ("https://a.example.com/x", "http://b.example.net", "https://bad_host.example", "", "ftp://c.example.org", " https://a.example.com/x ")
_VERIFICATION = ("verified", "verified", "verified", "conflict")


def trust_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as cases: a content and metadata that repeat each other, every fourth read from an image."""
    k, u = F.col("page_id"), F.col("url")
    shop = F.concat(F.lit("shop"), k % 5, F.lit(".xyz"))
    return table(spark, sf_dir, "pages").select(
        k.alias("case_id"),
        F.concat(F.lit("see "), u, F.lit(". or ("), u, F.lit(") and "), shop, F.lit(" now")).alias("content"),
        F.array(F.concat(F.lit("at "), u, F.lit("!")), F.lit("https://other.example/a,")).alias("links"),
        F.array(F.concat(F.lit("http://n"), k % 3, F.lit(".example/"))).alias("urls"),
        F.when(k % 2 == 1, F.lit("none here")).alias("link"),
        F.when(k % 4 == 0, F.lit("image_ocr")).otherwise("email").alias("input_type"),
        F.when(k % 8 == 0, F.lit("insufficient_evidence")).alias("ocr_quality_status"),
    )


def trust_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as audits of the images."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5000 * 4).alias("case_id"),
        (F.col("l_orderkey") * 10 + n).cast("int").alias("ord"),
        F.col("l_partkey").alias("block_id"),
        _one_of(_SELECTED, F.col("l_suppkey")).alias("selected_text"),
        _one_of(_VERIFICATION, F.col("l_partkey")).alias("url_verification"),
        (n != 3).alias("deterministic_eligible"),
        (F.col("l_quantity") > 45).alias("malformed_candidate"),
    )


@query(
    f"""WITH cases AS (SELECT page_id AS case_id, url, page_id % 4 = 0 AS image, page_id % 8 = 0 AS bad FROM pages),
    plain AS (SELECT rtrim(url, '.,;:!?)】') AS u, * FROM cases WHERE NOT image),
    written AS (
      SELECT case_id, 1 AS pos, u AS url, 0 AS blk, [] AS reasons FROM plain
      UNION ALL SELECT case_id, 2, 'https://shop' || case_id % 5 || '.xyz', 0, [] FROM plain
      UNION ALL SELECT case_id, 3, 'https://other.example/a', 0, [] FROM plain
      UNION ALL SELECT case_id, 4, 'http://n' || case_id % 3 || '.example/', 0, [] FROM plain
    ),
    audits AS (
      SELECT l_orderkey % 5000 * 4 AS case_id, l_orderkey * 10 + l_linenumber AS pos, trim({_pick(_SELECTED, 'l_suppkey')}) AS url, l_partkey AS blk,
             {_pick(_VERIFICATION, 'l_partkey')} AS seen, l_linenumber, l_quantity FROM lineitem
    ),
    read AS (
      SELECT a.case_id, pos, a.url, blk, list_filter([CASE WHEN seen <> 'verified' THEN 'not_verified' END, CASE WHEN l_linenumber = 3 THEN 'not_eligible' END, CASE WHEN a.url = '' THEN 'empty' END,
             CASE WHEN a.url <> '' AND NOT regexp_matches(a.url, '^https?://[a-z]+(\\.[a-z]+)+(/[a-z]*)?$') THEN 'syntax' END, CASE WHEN l_quantity > 45 THEN 'malformed' END,
             CASE WHEN bad THEN 'quality' END], lambda x: x IS NOT NULL) AS reasons
      FROM audits a JOIN cases c ON a.case_id = c.case_id
    ),
    every AS (SELECT *, len(reasons) = 0 AS ok FROM (SELECT * FROM written UNION ALL SELECT * FROM read)),
    firsts AS (SELECT *, ok AND row_number() OVER (PARTITION BY case_id, ok, url ORDER BY pos, blk) > 1 AS again FROM every)
    SELECT c.case_id, CASE WHEN image THEN 'audited' ELSE 'written' END AS trust_policy, count(*) FILTER (ok) AS accepted_count, count(*) FILTER (NOT ok) AS rejected_count, count(ok) AS candidates_seen,
           coalesce(string_agg(p.url, '|' ORDER BY pos, blk) FILTER (ok AND NOT again), '') AS verified,
           coalesce(string_agg(p.url || ' ' || array_to_string(reasons, ','), '|' ORDER BY pos, blk) FILTER (NOT ok), '') AS unverified
    FROM cases c LEFT JOIN firsts p ON c.case_id = p.case_id GROUP BY ALL"""
)
def trusted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs of each case that count, and those that do not with the reasons."""
    found = trust.resolved(trust_cases(spark, sf_dir), trust_audits(spark, sf_dir), shown=None)
    shown = F.array_join(F.transform("unverified", lambda x: F.concat(x["url"], F.lit(" "), F.array_join(x["reasons"], ","))), "|")
    return found.withColumns({"verified": F.array_join("verified", "|"), "unverified": shown})


# Readings ---------------------------------------------------------------------------------------------------------------

_RAW = f"{_pick(('http：//', 'https://', 'HTTP://', 'http:／／', 'https;//', 'httpsJ'), 'page_id')} || upper({_HOST}) || '/Path/A'"


def read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as blocks of text: their hosts, read with mistaken, wide and upper-case characters, and a second reading."""
    k, host = F.col("page_id"), U.parts(F.col("url"))["host"]
    raw = F.concat(_one_of(("http：//", "https://", "HTTP://", "http:／／", "https;//", "httpsJ"), k), F.upper(host), F.lit("/Path/A"))
    second = F.when(k % 7 == 0, F.concat(F.lit("http://"), F.upper(host), F.lit("/Path/A"))).when(k % 7 == 1, F.concat(F.lit("http://"), host, F.lit("/q"))).when(k % 7 == 2, F.lit("not a url"))
    return table(spark, sf_dir, "pages").select(
        (k % 10).alias("image_id"), k.alias("block_id"), raw.alias("text"), (k % 4 / 10.0).alias("confidence"), second.alias("second_text"), (k % 5 / 10.0).alias("second_confidence")
    )


_REPAIRED = f"{_pick(('http://', 'https://', 'HTTP://', 'http://', 'https://', 'httpsJ'), 'page_id')} || CASE WHEN page_id % 6 = 5 THEN upper({_HOST}) ELSE {_HOST} END || '/Path/A'"


@query(
    f"""WITH b AS (SELECT page_id AS block_id, {_RAW} AS raw, {_REPAIRED} AS new FROM pages),
    c AS (SELECT block_id, raw, new, unnest(generate_series(1, length(raw))) AS k FROM b)
    SELECT block_id, new AS repaired, coalesce(string_agg((k - 1) || ':' || substr(raw, k, 1) || '>' || substr(new, k, 1), ' ' ORDER BY k) FILTER (substr(raw, k, 1) <> substr(new, k, 1)), '') AS edits
    FROM c GROUP BY block_id, new"""
)
def repaired_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with its URL repaired and the list of what was changed."""
    rows = read_blocks(spark, sf_dir).withColumn("repaired", readings.repaired(F.col("text"))).withColumn("edits", readings.edits(F.col("text"), F.col("repaired")))
    shown = F.array_join(F.transform("edits", lambda e: F.concat(e["pos"].cast("string"), F.lit(":"), e["raw"], F.lit(">"), e["new"])), " ")
    return rows.select("block_id", "repaired", shown.alias("edits"))


@query(
    f"""WITH b AS (
      SELECT page_id AS k, {_RAW} AS raw, {_REPAIRED} AS new, page_id % 6 = 5 AS malformed, (page_id % 5) / 10.0::DOUBLE > (page_id % 4) / 10.0::DOUBLE + 0.1::DOUBLE AS sure,
             CASE page_id % 7 WHEN 0 THEN 'http://' || upper({_HOST}) || '/Path/A' WHEN 1 THEN 'http://' || {_HOST} || '/q' WHEN 2 THEN 'not a url' ELSE '' END AS second
      FROM pages
    ),
    c AS (SELECT *, list_filter(list_distinct(string_split(second, '')), lambda x: x <> '' AND NOT contains(raw, x)) AS extra FROM b),
    v AS (
      SELECT *, CASE WHEN malformed OR second = '' OR k % 7 = 2 THEN 'unverified' WHEN len(list_filter(extra, lambda x: NOT contains('./:\\', x))) = 0 AND sure THEN 'verified' WHEN len(extra) > 0 THEN 'conflict' ELSE 'unverified' END AS verdict FROM c
    )
    SELECT k AS block_id, malformed, CASE WHEN verdict = 'verified' THEN second ELSE new END AS selected_text, verdict AS url_verification, verdict = 'verified' AS deterministic_eligible,
           verdict = 'verified' OR k % 6 <> 5 AS strict_syntax_valid
    FROM v"""
)
def audited_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second reading bears out the URL of each block."""
    found = readings.audited(read_blocks(spark, sf_dir))
    return found.select("block_id", F.col("malformed_candidate").alias("malformed"), "selected_text", "url_verification", "deterministic_eligible", "strict_syntax_valid")


_PASS = "CASE l_suppkey % 3 WHEN 0 THEN 'mild_enhanced' WHEN 1 THEN 'safe_base' ELSE CASE WHEN l_orderkey % 5 = 0 THEN 'legacy' ELSE 'safe_base' END END"


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as blocks of two passes over images; the pass of some is neither."""
    other = F.when(F.col("l_orderkey") % 5 == 0, "legacy").otherwise("safe_base")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.when(F.col("l_suppkey") % 3 == 0, "mild_enhanced").when(F.col("l_suppkey") % 3 == 1, "safe_base").otherwise(other).alias("pass"),
        F.col("l_linenumber").cast("int").alias("block_id"),
        F.concat(F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("text"),
        (F.col("l_partkey") * 31 % 97 / 97.0).alias("confidence"),
        F.when(F.col("l_partkey") % 4 > 0, (F.col("l_partkey") % 4).cast("int")).alias("reading_order"),
    )


@query(
    f"""WITH b AS (
      SELECT l_orderkey AS image_id, {_PASS} AS pass, CAST(l_linenumber AS INTEGER) AS block_id, l_returnflag || ' ' || l_linestatus AS text, l_partkey * 31 % 97 / 97.0::DOUBLE AS confidence,
             CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 4 END AS place FROM lineitem
    ),
    e AS (SELECT image_id, pass, count(*) AS n, sum(round_even(confidence * 1e6::DOUBLE, 0)) / 1e6::DOUBLE / count(*) AS average, count(*) FILTER (confidence < 0.5) / count(*)::DOUBLE AS u, sum(length(text)) AS chars
          FROM b WHERE pass <> 'legacy' GROUP BY image_id, pass),
    s AS (SELECT image_id, pass, round_even(0.25::DOUBLE * least(average / 0.7::DOUBLE, 1) + 0.25::DOUBLE * (1 - u) + 0.2::DOUBLE * least(chars / 20.0::DOUBLE, 1) + 0.3::DOUBLE, 4) AS score FROM e),
    t AS (SELECT image_id, max(score) FILTER (pass = 'safe_base') AS base_score, max(score) FILTER (pass = 'mild_enhanced') AS mild_score FROM s GROUP BY image_id),
    r AS (SELECT *, CASE WHEN coalesce(base_score, 0) >= 0.55::DOUBLE THEN 'base_sufficient' WHEN mild_score IS NULL THEN 'no_mild_pass' WHEN mild_score > coalesce(base_score, 0) + 0.05::DOUBLE THEN 'mild_better' ELSE 'mild_within_margin' END AS reason FROM t),
    c AS (SELECT *, CASE WHEN reason = 'mild_better' THEN 'mild_enhanced' ELSE 'safe_base' END AS pass FROM r)
    SELECT c.image_id, c.pass, reason, base_score, mild_score, count(b.block_id) AS n_blocks, coalesce(string_agg(text, '/' ORDER BY place NULLS LAST, block_id, text), '') AS full_text,
           coalesce(round_even(sum(round_even(confidence * 1e6::DOUBLE, 0)) / 1e6::DOUBLE / count(b.block_id), 4), 0::DOUBLE) AS average, coalesce(string_agg(block_id, ',' ORDER BY block_id) FILTER (confidence < 0.5), '') AS uncertain
    FROM c LEFT JOIN b ON c.image_id = b.image_id AND c.pass = b.pass GROUP BY c.image_id, c.pass, reason, base_score, mild_score"""
)
def fused_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pass of each image that counts, put together in reading order."""
    found = readings.assembled(passes(spark, sf_dir))
    return found.select(
        "image_id", "pass", "reason", "base_score", "mild_score", "n_blocks", F.replace("full_text", F.lit("\n"), F.lit("/")).alias("full_text"), "average",
        F.coalesce(F.array_join("uncertain_ids", ","), F.lit("")).alias("uncertain"),
    )
