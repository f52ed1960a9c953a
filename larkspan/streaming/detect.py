"""The detection plan on a stream: per-row operators only, so no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.operators.scoring import risk
from larkspan.plans.detect import page_risks


def page_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Page risks of Parquet files as they arrive in a folder."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return page_risks(source)


def write_risks(risks: DataFrame, out: str, checkpoint: str):
    """Append risks to a Parquet folder, exactly once per input file."""
    return risks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


__all__ = ["page_stream", "risk", "write_risks"]
