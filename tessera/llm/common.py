"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals and what they become; nothing outside A-Z changes.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Spark deletes the shuffle files of a query when it ends; only what a scratch table was written from is affected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor sees.

    Where the setting is missing a local session (tests, a laptop) gets a folder of its own;
    a cluster has no folder that all its machines share but the one it names.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tessera.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("tessera.scratch.dir", base)
    return f"{base.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and read it back.

    This cuts the lineage: what comes later survives the loss of any executor
    without running the earlier stages again. The shuffle files behind the table go when it is written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Empty scratch tables that no later step reads."""
    for t in tables:
        t.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(t.scratch_path)


#: Rows of a table that may be broadcast; the tables that ``bounded`` gets hold two numbers a row.
ROWS_SENT = 1 << 18


def bounded(small: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its counted rows are few; else the join is left to shuffle."""
    return F.broadcast(small) if small.count() <= ROWS_SENT else small


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those that an operator is about to add under these names."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(*names: str) -> list[Column]:
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def packed(df: DataFrame, *gone: str) -> Column:
    """The row's columns as one struct, so that helper columns cannot clash with them."""
    keep = without(df, *gone)
    return F.struct(*quoted(*keep)) if keep else F.struct(F.lit(None).alias("_"))


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
