"""Which URLs of a case may count as facts, merged from all of its sources.

A case that was read from an image (it has audits of recognised URLs, or says so) trusts only audits: those
that are verified, eligible, of strict syntax and not malformed. Any other case has the URLs of its content
and of its metadata (links, urls, link), in this order. In a second pass a case read too badly to be
evidence loses all that it had.

Candidates are rows; a case's result is counted from them, and shows its URLs of either kind in their order:
all of them, or the first few where the caller sets a number.

Defined results: a case without candidates has counts of 0 and empty arrays; null texts have no URLs; null
verification is none, null eligibility is no, null malformation is no; a URL that an earlier candidate
of the case has is accepted, but not shown again, and not counted for a case that was not read from an
image; audits of unknown cases are ignored. Audits of a case with the same number and block go
by their URLs and reasons, so that the result never depends on how rows are dealt. Case identifiers are taken to be unique; null ones stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import urls as U
from larkspan.operators.semantic import BAD_TLDS

SHOWN = 50
SOURCES = ("content", "links", "urls", "link", "audit")
READ_FROM_IMAGE = "image_ocr"
TOO_BAD = "insufficient_evidence"
_LABEL = "[a-zA-Z0-9](?:[-a-zA-Z0-9]*[a-zA-Z0-9])?"
STRICT = f"(?i)^https?://{_LABEL}(?:\\.{_LABEL})*\\.[a-z]{{2,}}(?:/[\\w\\-._~:/?#\\[\\]@!$&()*+,;=%]*)?$"


def strict(url: Column) -> Column:
    return F.coalesce(url.rlike(STRICT), F.lit(False))


def _found(cases: DataFrame, source: str) -> DataFrame:
    """(case_id, source, item, nth, url) of one source of text; lists count their items."""
    texts = F.col(source) if cases.schema[source].dataType.typeName() == "array" else F.array(F.col(source))
    each = cases.select("case_id", F.posexplode(texts).alias("item", "text"))
    urls = each.select("case_id", "item", F.posexplode(U.written_urls(F.col("text"), BAD_TLDS)).alias("nth", "url"))
    url = F.rtrim(F.trim(F.col("url")), F.lit(U.TRAILING["findings"]))
    return urls.select("case_id", F.lit(SOURCES.index(source)).alias("source"), "item", "nth", url.alias("url"), F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("long").alias("block_id")).filter("url <> ''")


def _audited(audits: DataFrame) -> DataFrame:
    """The same of audits, with the reasons against each."""
    url = F.trim(F.coalesce("selected_text", F.lit("")))
    against = [
        (F.coalesce("url_verification", F.lit("unverified")) != "verified", "not_verified"),
        (~F.coalesce("deterministic_eligible", F.lit(False)), "not_eligible"),
        (url == "", "empty"),
        ((url != "") & ~strict(url), "syntax"),
        (F.coalesce("malformed_candidate", F.lit(False)), "malformed"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, reason) for c, reason in against]))
    return audits.select(
        "case_id", F.lit(SOURCES.index("audit")).alias("source"), F.col("ord").cast("int").alias("item"), F.lit(0).alias("nth"), url.alias("url"), reasons.alias("reasons"), F.col("block_id").cast("long").alias("block_id")
    )


def candidates(cases: DataFrame, audits: DataFrame) -> DataFrame:
    """case_id, source, item, nth, url, reasons (none: accepted), block_id, image (whether only audits count), in no order.

    ``cases``: case_id, content, links and urls (arrays), link, input_type, ocr_quality_status.
    ``audits``: case_id, ord, block_id, selected_text, url_verification, deterministic_eligible, malformed_candidate.
    """
    known = cases.filter("case_id IS NOT NULL")
    seen = audits.select("case_id").distinct().withColumn("audited", F.lit(True))
    known = known.join(seen, "case_id", "left").withColumn("image", F.coalesce("audited", F.lit(False)) | F.coalesce(F.col("input_type") == READ_FROM_IMAGE, F.lit(False)))
    plain = known.filter("NOT image")
    written = None
    for source in SOURCES[:-1]:
        part = _found(plain, source)
        written = part if written is None else written.unionByName(part)
    bad = F.coalesce(F.col("ocr_quality_status") == TOO_BAD, F.lit(False))
    read = _audited(audits).join(known.filter("image").select("case_id", bad.alias("bad")), "case_id")
    # the second pass: all of a case that was read too badly
    read = read.withColumn("reasons", F.when(F.col("bad"), F.array_append("reasons", F.lit("quality"))).otherwise(F.col("reasons"))).drop("bad")
    return written.withColumn("image", F.lit(False)).unionByName(read.withColumn("image", F.lit(True)))


def resolved(cases: DataFrame, audits: DataFrame, shown: int | None = SHOWN) -> DataFrame:
    """case_id, trust_policy, accepted_count, rejected_count, candidates_seen, verified (URLs), unverified (URLs with reasons).

    ``shown``: how many URLs of either kind a case shows, None: all of them. Counts are of all candidates either way.
    """
    at = ["source", "item", "nth", "block_id", "url", "reasons"]
    rows = candidates(cases, audits).withColumn("ok", F.size("reasons") == 0)
    same = Window.partitionBy("case_id", "ok", "url").orderBy(*at)
    rows = rows.withColumn("repeat", F.col("ok") & (F.row_number().over(same) > 1))
    # what a text repeats is one candidate, what audits repeat is not
    rows = rows.filter(F.col("image") | ~F.col("repeat"))
    listed = ~F.col("repeat")
    if shown is not None:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("case_id", "ok", "repeat").orderBy(*at)))
        listed = listed & (F.col("place") <= shown)
    counted = rows.groupBy("case_id").agg(
        F.count_if("ok").alias("accepted_count"),
        F.count_if(~F.col("ok")).alias("rejected_count"),
        F.count(F.lit(1)).alias("candidates_seen"),
        F.sort_array(F.collect_list(F.when(F.col("ok") & listed, F.struct(*at)))).alias("good"),
        F.sort_array(F.collect_list(F.when(~F.col("ok") & listed, F.struct(*at)))).alias("bad"),
    )
    seen = audits.select("case_id").distinct().withColumn("audited", F.lit(True))
    known = cases.filter("case_id IS NOT NULL").select("case_id", "input_type").join(seen, "case_id", "left")
    image = F.coalesce("audited", F.lit(False)) | F.coalesce(F.col("input_type") == READ_FROM_IMAGE, F.lit(False))
    policy = F.when(image, "audited").otherwise("written").alias("trust_policy")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    verified = F.coalesce(F.transform("good", lambda x: x["url"]), F.array().cast("array<string>")).alias("verified")
    unverified = F.coalesce(F.transform("bad", lambda x: F.struct(x["url"].alias("url"), x["reasons"].alias("reasons"))), F.array().cast("array<struct<url:string,reasons:array<string>>>")).alias("unverified")
    return known.join(counted, "case_id", "left").select("case_id", policy, n("accepted_count"), n("rejected_count"), n("candidates_seen"), verified, unverified)
