"""Queries of list tables, public suffixes, lookalike domains and words by one automaton, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.catalogue import _HOST, query, table
from larkspan.catalogue_evaluation import _one_of, _pick
from larkspan.functions import urls as U
from larkspan.operators import domains, wording


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.parts(F.col("url"))["host"].alias("host"))


def _last(host: str, k: int) -> str:
    return f"array_to_string(string_split({host}, '.')[-{k}:], '.')"


_HOSTS = f"hosts AS (SELECT page_id, {_HOST} AS host FROM pages)"
_LISTED = f"""{_HOSTS},
list AS (
  SELECT {_last('host', 3)} AS domain, 'site' AS kind, count(*) AS n FROM hosts GROUP BY 1 HAVING count(*) >= 3
  UNION ALL SELECT {_last('host', 2)}, 'zone', count(*) FROM hosts GROUP BY 1
)"""


def _list(hosts: DataFrame) -> DataFrame:
    """A list of frequent sites and of the zones above them, from the pages themselves."""
    labels = F.split("host", "\\.")
    count = lambda k: hosts.groupBy(domains.last_labels(labels, k).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return count(3).filter("n >= 3").withColumn("kind", F.lit("site")).unionByName(count(2).withColumn("kind", F.lit("zone")))


@query(
    f"""WITH {_LISTED}
    SELECT page_id, host, domain, kind, n FROM hosts LEFT JOIN list ON host = domain OR ends_with(host, '.' || domain)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC NULLS LAST) = 1"""
)
def host_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the longest domain of a list table that its host belongs to."""
    hosts = page_hosts(spark, sf_dir)
    return domains.with_listed(hosts, _list(hosts)).select("page_id", "host", "domain", "kind", "n")


@query(
    f"""WITH {_LISTED}
    SELECT host, domain, kind, n FROM (SELECT DISTINCT host FROM hosts) JOIN list ON ends_with(host, '.' || domain)
    QUALIFY row_number() OVER (PARTITION BY host, kind ORDER BY length(domain) DESC) = 1"""
)
def host_lists_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host below a listed domain, with the longest of each kind."""
    hosts = page_hosts(spark, sf_dir)
    return domains.listed(hosts, _list(hosts), by=("kind",), itself=False).select("host", "domain", "kind", "n")


_RULES = ("com", "uk", "co.uk", "jp", "kawasaki.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "cn", "xn--55qx5d.cn", "*.deep.example.net")
_ENDINGS = ("com", "co.uk", "uk", "jp", "a.b.kawasaki.jp", "city.kawasaki.jp", "x.city.kawasaki.jp", "kawasaki.jp", "ck", "b.ck", "www.ck", "a.www.ck", "xn--55qx5d.cn", "y.xn--55qx5d.cn", "q.deep.example.net", "nowhere", "A.Co.UK.")
_RULES_SQL = ", ".join(f"('{r}')" for r in _RULES)


@query(
    f"""WITH hosts AS (SELECT DISTINCT split_part({_HOST}, '.', 1) || '.' || {_pick(_ENDINGS, 'page_id')} AS host FROM pages),
    own AS (SELECT host, rtrim(lower(host), '.') AS own FROM hosts),
    rules AS (SELECT r, ltrim(ltrim(r, '!'), '*.') AS base, r LIKE '!%' AS exception, r LIKE '*.%' AS wild FROM (VALUES {_RULES_SQL}) AS v(r)),
    met AS (
      SELECT host, own, exception, len(string_split(base, '.')) + CASE WHEN exception THEN -1 WHEN wild THEN 1 ELSE 0 END AS k
      FROM own JOIN rules ON (own = base AND NOT wild) OR ends_with(own, '.' || base)
    ),
    best AS (SELECT host, coalesce(max(k) FILTER (exception), max(k)) AS k FROM met GROUP BY host)
    SELECT own.host, CASE WHEN k IS NULL THEN '' ELSE array_to_string(string_split(own, '.')[-k:], '.') END AS suffix,
           CASE WHEN k IS NULL OR len(string_split(own, '.')) <= k THEN own ELSE array_to_string(string_split(own, '.')[-(k + 1):], '.') END AS registered
    FROM own LEFT JOIN best USING (host)"""
)
def public_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of many endings by a table of public suffix rules."""
    first = F.split_part("host", F.lit("."), F.lit(1))
    hosts = page_hosts(spark, sf_dir).select(F.concat(first, F.lit("."), _one_of(_ENDINGS, F.col("page_id"))).alias("host"))
    return domains.public_suffixes(hosts, spark.createDataFrame([(r,) for r in _RULES], "rule string"))


_ZONES = ("example.com", "example.net", "example.org")


@query(
    f"""WITH {_HOSTS},
    official AS (SELECT {_last('host', 3)} AS domain, min(page_id) AS ord FROM hosts WHERE ends_with(host, '.example.org') GROUP BY 1),
    own AS (SELECT DISTINCT host, {_last('host', 3)} AS registered FROM hosts WHERE host NOT IN (SELECT h.host FROM hosts h JOIN official o ON h.host = o.domain OR ends_with(h.host, '.' || o.domain))),
    near AS (
      SELECT host, domain, ord, CASE WHEN length(split_part(registered, '.', 1)) <= 8 AND levenshtein(split_part(registered, '.', 1), split_part(domain, '.', 1)) = 1 THEN 0.9::DOUBLE
        WHEN 1 - levenshtein(registered, domain) / greatest(length(registered), length(domain))::DOUBLE >= 0.85::DOUBLE THEN 0.85::DOUBLE
        WHEN contains(host, split_part(domain, '.', 1)) THEN 0.8::DOUBLE END AS confidence
      FROM own CROSS JOIN official
    )
    SELECT host, domain, confidence FROM near WHERE confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY host ORDER BY ord, domain) = 1"""
)
def official_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that resemble a site of example.org, by indexes instead of a comparison of all with all."""
    hosts = page_hosts(spark, sf_dir)
    site = domains.last_labels(F.split("host", "\\."), 3)
    official = hosts.filter(F.col("host").endswith(".example.org")).groupBy(site.alias("domain")).agg(F.min("page_id").alias("ord"))
    return domains.lookalikes(hosts, official, spark.createDataFrame([(z,) for z in _ZONES], "rule string"))


_WORDS = "words AS (SELECT DISTINCT 'r' || (item_id % 3) AS rule, regexp_extract(lower(text), '[a-z]{3,}') AS word FROM benchmark WHERE regexp_matches(lower(text), '[a-z]{3,}'))"


@query(
    f"""WITH {_WORDS},
    turns AS (SELECT conv_id || ':' || turn AS id, lower(text) AS t FROM conversations WHERE text IS NOT NULL),
    chars AS (SELECT id, k, substr(t, k, 1) AS c FROM (SELECT id, t, unnest(generate_series(1, length(t))) AS k FROM turns)),
    seen AS (SELECT id, k, c, row_number() OVER (PARTITION BY id ORDER BY k) AS q FROM chars WHERE NOT regexp_matches(c, '[\\s\\x{{A0}}\\x{{AD}}\\x{{2000}}-\\x{{200F}}\\x{{2028}}-\\x{{202F}}\\x{{205F}}-\\x{{206F}}\\x{{3000}}\\x{{FEFF}}]')),
    bare AS (SELECT id, string_agg(c, '' ORDER BY q) AS s FROM seen GROUP BY id),
    pieces AS (SELECT seen.id, k, substr(s, q, l) AS word FROM seen JOIN bare USING (id), (SELECT DISTINCT length(word) AS l FROM words))
    SELECT id, rule, word, count(*) AS n, CAST(min(k) - 1 AS INTEGER) AS first FROM pieces JOIN words USING (word) GROUP BY id, rule, word"""
)
def wording_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and where first, each word of a table occurs in each turn of a conversation, white space between letters or not."""
    word = F.regexp_extract(F.lower("text"), "[a-z]{3,}", 0)
    words = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("r"), F.col("item_id") % 3).alias("rule"), word.alias("word"))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    found = wording.occurrences(turns, words)
    return found.groupBy("id", "rule", "word").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))
