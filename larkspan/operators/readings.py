"""Readings of images: repair of URLs in recognised text, audit of second readings, choice between passes.

Repair keeps to what a reading shows: full-width forms become narrow, a host becomes lower case, a mistaken mark after
the scheme becomes a colon; each for one character. What was changed is listed as edits against the raw reading, so that a
character that nobody read is seen. Speculative repair adds marks (a slash after the scheme, the dot before a known
ending) and is only kept where it is asked for.

Defined results: null text counts as empty; ties between passes keep the base pass; blocks without a place in
the reading order come last, by identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import let
from larkspan.operators import ocr

# Full-width marks of URLs and their narrow forms, and a mark mistaken for a colon.
WIDE, NARROW = "：．／＼＠", ":./\\@"
MISTAKEN = {"http：": "http:", "https：": "https:", "http;//": "http://", "https;//": "https://"}
# Endings before which a speculative repair sets a dot.
ENDINGS = (
    "com cn xyz top cc tk cf ga ml gq work click link online site tech live cyou icu fun shop store edu org net gov io co info biz pw ws mobi name tv me app dev page run space website press host"
).split()
_TAIL = "[^\\s<>\"'{}\\[\\]()（）\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]*"
_SPAN = f"(?iU)(?:https?|ftp)\\s*:\\s*(?://|／／|\\\\\\\\|／){_TAIL}"
_WEB = f"(?iU)https?://{_TAIL}"
_STRICT = "(?i)^https?://[a-z0-9][-a-z0-9.]*\\.[a-z]{2,}(?:/[\\w\\-._~:/?#\\[\\]@!$&()*+,;=%]*)?$"
#: Marks that a second reading may show though the first did not.
READABLE = "./:\\"
BETTER = 0.10
BASE, MILD = "safe_base", "mild_enhanced"
ENOUGH, MARGIN = 0.55, 0.05


def rewritten(text: Column, pattern: str, change) -> Column:
    """``text`` cut into what matches ``pattern`` and the rest; what matches is changed, and all is joined again."""
    whole = "(" + pattern.replace("(?iU)", "") + ")"

    def rejoined(x: Column) -> Column:
        inner = F.concat(F.transform(x["spans"], change), F.array(F.lit("")))
        return F.array_join(F.flatten(F.zip_with(x["rest"], inner, lambda r, s: F.array(r, s))), "")

    cut = F.struct(F.split(text, pattern, -1).alias("rest"), F.regexp_extract_all(text, F.lit("(?iU)" + whole), F.lit(1)).alias("spans"))
    return let(cut, rejoined)


def url_spans(text: Column) -> Column:
    """array<struct(start, end, raw)>: the stretches of a text that repair looks at, by characters from 0."""
    text = F.coalesce(text, F.lit(""))
    spans = F.regexp_extract_all(text, F.lit("(?iU)(" + _SPAN.replace("(?iU)", "") + ")"), F.lit(1))
    rest = F.split(text, _SPAN, -1)

    def placed(x: Column) -> Column:
        before = lambda k: F.aggregate(F.concat(F.slice(x["rest"], 1, k + 1), F.slice(x["spans"], 1, k)), F.lit(0), lambda a, s: a + F.length(s))
        return F.transform(x["spans"], lambda s, k: let(before(k), lambda at: F.struct(at.alias("start"), (at + F.length(s)).alias("end"), s.alias("raw"))))

    return let(F.struct(rest.alias("rest"), spans.alias("spans")), placed)


def _host_lowered(url: Column) -> Column:
    """The URL with what stands between the scheme and the first slash in lower case."""

    def of(p: Column) -> Column:
        slash = F.instr(p["after"], "/")
        host = F.when(slash > 1, F.substring(p["after"], F.lit(1), slash - 1)).otherwise(p["after"])
        return F.concat(p["scheme"], F.lower(host), F.substring(p["after"], F.length(host) + 1, F.length(p["after"])))

    return let(F.struct(F.regexp_extract(url, "(?i)^(https?://)", 1).alias("scheme"), F.regexp_extract(url, "(?is)^https?://(.*)$", 1).alias("after")), of)


def _as_read(text: Column, slashes: bool = False) -> Column:
    """All repairs that put one character for another; with ``slashes`` one that a scheme lacks is added first."""
    for mistaken, right in MISTAKEN.items():
        text = F.replace(text, F.lit(mistaken), F.lit(right))
    text = F.regexp_replace(text, "(?i)(https?)：//", "$1://")
    if slashes:
        text = F.regexp_replace(text, "(?iU)(https?):(/)([^\\s/\\\\.\\x{3000}\\x{FF00}-\\x{FFEF}])", "$1://$3")
        text = F.regexp_replace(text, "(?iU)(https?):\\s*/\\s+([^\\s])", "$1://$2")
    text = rewritten(text, _SPAN, lambda s: F.translate(s, WIDE, NARROW))
    return rewritten(text, _WEB, _host_lowered)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def repaired(text: Column) -> Column:
    """The text with its URLs repaired, one character for one, without white space at its ends."""
    return stripped(_as_read(F.coalesce(text, F.lit(""))))


def speculated(text: Column) -> Column:
    """The text with marks added that a URL should have: repaired first."""
    text = _as_read(F.coalesce(text, F.lit("")), slashes=True)
    for ending in sorted(ENDINGS, key=lambda e: (-len(e), e)):
        text = F.regexp_replace(text, f"(?iU)(?<=[-a-z0-9])(?<!\\.)({ending})(?=[\\s\\)\\]\\}},;:!?.。，、：》）“”‘’/\\\\\\x{{3000}}-]|$)", ".$1")
    return stripped(text)


def edits(raw: Column, new: Column) -> Column:
    """array<struct(pos, raw, new)>: how ``new`` differs from ``raw``, at characters of the stripped ``raw`` from 0.

    A narrow, lower-case or corrected form stands for its character; any other character is one that was added (raw is
    empty), and what is left of ``raw`` one that was taken away (new is empty). White space at the ends does not count.
    """
    same = lambda c: F.lower(F.translate(c, WIDE + ";", NARROW + ":"))

    def script(x: Column) -> Column:
        none = F.array().cast("array<struct<pos:int,raw:string,new:string>>")
        begin = F.struct(F.lit(0).alias("at"), none.alias("found"))

        def step(a: Column, c: Column) -> Column:
            def with_own(own: Column) -> Column:
                kept = F.struct((a["at"] + 1).alias("at"), F.when(own == c, a["found"]).otherwise(F.array_append(a["found"], F.struct(a["at"].alias("pos"), own.alias("raw"), c.alias("new")))).alias("found"))
                added = F.struct(a["at"].alias("at"), F.array_append(a["found"], F.struct(a["at"].alias("pos"), F.lit("").alias("raw"), c.alias("new"))).alias("found"))
                return F.when((own != "") & (same(own) == same(c)), kept).otherwise(added)

            return let(F.substring(x["raw"], a["at"] + 1, F.lit(1)), with_own)

        def finished(a: Column) -> Column:
            left = F.struct(a["at"].alias("pos"), F.substring(x["raw"], a["at"] + 1, F.length(x["raw"])).alias("raw"), F.lit("").alias("new"))
            return F.when(a["at"] < F.length(x["raw"]), F.array_append(a["found"], left)).otherwise(a["found"])

        return F.aggregate(F.filter(F.split(x["new"], ""), lambda c: c != ""), begin, step, finished)

    return let(F.struct(stripped(F.coalesce(raw, F.lit(""))).alias("raw"), F.coalesce(new, F.lit("")).alias("new")), script)


def adds_characters(script: Column) -> Column:
    return F.exists(script, lambda e: e["raw"] == "")


def _characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""))


def audited(blocks: DataFrame, speculative: bool = False) -> DataFrame:
    """The blocks that are or may be URLs, each with its repair and whether a second reading bears it out.

    ``blocks``: image_id, block_id, text, confidence, second_text, second_confidence. Returned: image_id, block_id, raw_text,
    repaired, edits, malformed_candidate, selected_text, url_verification (verified, conflict, unverified),
    deterministic_eligible, strict_syntax_valid. With ``speculative`` a block's repair may add characters; such a block is never
    eligible. A damaged URL is not verified by any reading.
    """
    rows = blocks.withColumn("candidate", ocr.url_candidate(F.col("text")))
    clean = F.col("text").rlike("(?i)https?://|www\\.|[a-z0-9][-a-z0-9]*\\.[a-z]{2,}")
    malformed = F.col("candidate.malformed")
    rows = rows.filter(F.coalesce(clean | (F.col("candidate.candidate") & malformed), F.lit(False)))
    rows = rows.withColumn("repaired", speculated(F.col("text")) if speculative else repaired(F.col("text")))
    rows = rows.withColumn("edits", edits(F.col("text"), F.col("repaired")))
    second = F.coalesce("second_text", F.lit(""))
    new = F.array_except(_characters(second), _characters(F.col("text")))
    invented = F.filter(new, lambda c: ~F.lit(READABLE).contains(c))
    strict = second.rlike(_STRICT)
    sure = F.coalesce(F.col("second_confidence") > F.col("confidence") + BETTER, F.lit(False))
    verdict = (
        F.when(malformed | (second == ""), "unverified")
        .when(strict & (F.size(invented) == 0) & sure & ~adds_characters(F.col("edits")), "verified")
        .when(strict & (F.size(new) > 0), "conflict")
        .otherwise("unverified")
    )
    rows = rows.withColumn("url_verification", verdict)
    selected = F.when(F.col("url_verification") == "verified", F.col("second_text")).otherwise(F.col("repaired"))
    return rows.select(
        "image_id", "block_id", F.col("text").alias("raw_text"), "repaired", "edits", malformed.alias("malformed_candidate"), selected.alias("selected_text"), "url_verification",
        (F.col("url_verification") == "verified").alias("deterministic_eligible"), selected.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+").alias("strict_syntax_valid"),
    )


def chosen_passes(blocks: DataFrame, base: str = BASE, mild: str = MILD) -> DataFrame:
    """image_id, pass, reason, score, status, base_score, mild_score: which pass of each image counts.

    ``blocks`` have a column ``pass``. The base pass stays from a score of ``ENOUGH`` on; below, the mild one must be better by more
    than ``MARGIN``. A pass without blocks scores 0; other passes do not count.
    """
    each = ocr.quality(blocks.filter(F.col("pass").isin(base, mild)).withColumn("image_id", F.struct("image_id", "pass")))
    of = lambda name, column: F.max(F.when(F.col("image_id.pass") == name, F.col(column)))
    two = each.groupBy(F.col("image_id.image_id").alias("image_id")).agg(
        of(base, "score").alias("base_score"), of(mild, "score").alias("mild_score"), of(base, "status").alias("base_status"), of(mild, "status").alias("mild_status")
    )
    own, other = F.coalesce("base_score", F.lit(0.0)), F.coalesce("mild_score", F.lit(0.0))
    reason = (
        F.when(own >= ENOUGH, "base_sufficient").when(F.col("mild_score").isNull(), "no_mild_pass").when(other > own + MARGIN, "mild_better").otherwise("mild_within_margin")
    )
    two = two.withColumn("reason", reason)
    won = F.col("reason") == "mild_better"
    return two.select(
        "image_id", F.when(won, mild).otherwise(base).alias("pass"), "reason", F.when(won, other).otherwise(own).alias("score"),
        F.coalesce(F.when(won, F.col("mild_status")).otherwise(F.col("base_status")), F.lit("insufficient_evidence")).alias("status"), "base_score", "mild_score",
    )


def assembled(blocks: DataFrame, base: str = BASE, mild: str = MILD) -> DataFrame:
    """The chosen pass of each image put together: chosen_passes() with n_blocks, full_text, repaired_text, average, uncertain_ids."""
    choice = chosen_passes(blocks, base, mild)
    rows = blocks.join(choice.select("image_id", "pass"), ["image_id", "pass"])
    place = F.struct(F.coalesce("reading_order", F.lit(2**31 - 1)).alias("place"), "block_id", "text")
    line = F.when(F.col("confidence") < ocr.SURE, F.col("block_id"))
    read = rows.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sort_array(F.collect_list(place)).alias("lines"),
        F.bround(F.sum(F.rint(F.col("confidence") * 1e6)) / 1e6 / F.count(F.lit(1)), 4).alias("average"),
        F.sort_array(F.collect_list(line)).alias("uncertain_ids"),
    )
    text = lambda f: F.array_join(F.transform("lines", lambda x: f(F.coalesce(x["text"], F.lit("")))), "\n")
    joined = choice.join(read, "image_id", "left")
    return joined.select(
        *choice.columns, F.coalesce("n_blocks", F.lit(0).cast("long")).alias("n_blocks"), F.coalesce(text(lambda t: t), F.lit("")).alias("full_text"),
        F.coalesce(text(repaired), F.lit("")).alias("repaired_text"), F.coalesce("average", F.lit(0.0)).alias("average"), "uncertain_ids",
    )
