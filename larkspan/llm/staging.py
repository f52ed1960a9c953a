"""Written intermediate tables in the folder that all executors share.

An operator that needs a result more than once, or that must cut its lineage,
writes it as Parquet below ``spark.checkpoint.dir`` and reads it back. A lost
executor then costs only the tasks that it was running.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.session import bounded_batches  # noqa: F401

ROOT_CONF = "spark.checkpoint.dir"
#: Whether Spark removes a query's shuffle files when the query ends, rather than when the driver collects garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and the master is local (tests)."""
    root = spark.conf.get(ROOT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{ROOT_CONF} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="larkspan-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here leave no shuffle files behind: what they wrote is read from its table from then on."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and return a reader of it.

    The table is removed when the session ends, if discard() has not done so before.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/larkspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with shuffles_removed(spark):
        df.write.parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` has it (upper and lower case are the same)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name)
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that staged() wrote, once nothing will read it again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def positive_hash(h: Column) -> Column:
    """A 64-bit hash as one of 63 bits, from 0 on."""
    return F.shiftrightunsigned(h, 1)


def cut_at(share: float) -> int:
    """The largest positive_hash() of a sample of about ``share`` of all rows. Never below 0, so that no share cuts to nothing by rounding."""
    return min((1 << 63) - 1, max(0, int(share * (1 << 63))))
