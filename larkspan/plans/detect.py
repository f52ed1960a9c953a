"""End-to-end plans from cases to risks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.operators import rules
from larkspan.operators.scoring import risk
from larkspan.plans.profile import DEMO, Profile


def page_risks(pages: DataFrame, profile: Profile = DEMO) -> DataFrame:
    """page_id, score, level, floor, critical_lock, raw, confidence, n_evidence of every page."""
    cases = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), T.normal_text(F.col("html")).alias("normal"))
    found = cases.select("page_id", rules.page_evidence(F.col("url"), F.col("html"), profile, F.col("normal")).alias("evidence"))
    return found.select("page_id", risk(F.col("evidence")).alias("risk"), F.size("evidence").alias("n_evidence")).select("page_id", "risk.*", "n_evidence")


def message_risks(messages: DataFrame, key: str, text: str, profile: Profile = DEMO, **more: str) -> DataFrame:
    """The same for texts: documents, mails, turns of conversations.

    ``more`` names the columns of what else a case has: sender, and arrays of links, attachments and qr_urls.
    """
    cases = messages.select(F.col(key), T.normal_text(F.col(text)).alias("__text"), *[F.col(c).alias(f"__{k}") for k, c in more.items()])
    found = cases.select(key, rules.message_evidence(F.col("__text"), profile, **{k: F.col(f"__{k}") for k in more}).alias("evidence"))
    return found.select(key, risk(F.col("evidence")).alias("risk"), F.size("evidence").alias("n_evidence")).select(key, "risk.*", "n_evidence")
