"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.staging import discard, staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): the smallest identifier reachable from each end of a link.

    Each round gives a node the smallest label of itself and its neighbours and then the
    label of that label. Every round is written to the shared folder; only the number of
    changed labels comes to the driver. Minima combine before they are shuffled.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = staged(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        new = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("m"))
        up = labels.select(F.col("u").alias("m"), F.col("label").alias("above"))
        new = staged(new.join(up, "m").select("u", F.col("label").alias("old"), F.least("m", "above").alias("label")), "labels")
        if new.filter("old <> label").isEmpty():
            return new.select(F.col("u").alias("id"), F.col("label").alias("component_id"))
        discard(labels)
        labels = new.drop("old")
