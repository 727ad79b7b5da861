"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, quoted, scratch, stored, without

SHARDS = 40
SEED = 7
#: Text bytes that a bucket should hold; a task permutes one bucket in memory at a time.
BUCKET_BYTES = 32 << 20
#: Rows in an Arrow batch on the way back to Spark, so that long texts do not pile up.
ROWS_OUT = 256


def _fisher_yates(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        # Rows reach a reader in any order; a fixed order first makes a retried task repeat itself.
        order = np.argsort(rows["key"].to_numpy(), kind="stable")
        bucket = TaskContext.get().partitionId()
        dealt = order[np.random.default_rng([seed, bucket]).permutation(len(order))]
        for i in range(0, len(dealt), ROWS_OUT):
            part = rows.take(pa.array(dealt[i : i + ROWS_OUT])).combine_chunks()
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part["row"].chunk(0), pa.array(np.full(n, bucket, "int32")), pa.array(np.arange(i, i + n, dtype="int64"))],
                ["row", "bucket", "place"],
            )

    return run


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into ``shards`` shards in random order and write them; row counts differ by one at most.

    First pass: a seeded hash of id and text scatters whole rows into as many buckets as keep
    each at about ``bucket_bytes``. Second pass: each bucket is shuffled by Fisher-Yates in one
    task and written. The written buckets, laid end to end, are one random permutation; shard
    and slot follow from the position in it, for which only the buckets' counts are summed.

    Rows that share id and text would share a bucket; where such a key outgrows a bucket it is
    salted by row (there are no more such keys than buckets). A text longer
    than a bucket stays whole. Null ids and texts are values like others, empty and repeated rows
    keep their places, and no rows give no rows. Returns the columns of ``docs`` (same-named ones are
    replaced) with shard and slot, read from the files under ``path``, a folder per shard.
    """
    spark = docs.sparkSession
    kept = without(docs, "shard", "slot")
    text = quoted(text_col)[0]
    key = F.xxhash64(F.lit(seed), quoted(id_col)[0], text)
    size = F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 16
    keys = docs.groupBy(key.alias("key")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    sizes = stored(keys.select("key", "bytes", "n", (F.col("bytes") > bucket_bytes).alias("heavy")), "shard-keys")
    total, rows = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    # At most total / bucket_bytes keys are heavy.
    heavy = F.broadcast(sizes.where("heavy").select(F.col("key").alias("hot")))
    salt = F.when(F.col("hot").isNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())
    scattered = (
        docs.select(packed(docs, "shard", "slot").alias("row"), key.alias("key"))
        .join(heavy, F.col("key") == F.col("hot"), "left")
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key", salt), F.lit(buckets)).cast("int"))
        .repartitionById(buckets, F.col("bucket"))
        .select("row", "key")
    )
    schema = scattered.select("row", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("place")).schema
    permuted = stored(scattered.mapInArrow(_fisher_yates(seed), schema), "buckets")
    # One row per bucket: the window's single task reads total / bucket_bytes rows.
    before = permuted.groupBy("bucket").count().select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))
    each, more = divmod(rows, shards)
    edge = (each + 1) * more
    at = F.col("place") + F.col("before")
    dealt = permuted.join(F.broadcast(before), "bucket").select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.when(at < edge, F.expr(f"(place + before) div {each + 1}")).otherwise(F.expr(f"{more} + (place + before - {edge}) div {max(each, 1)}")).cast("int").alias("shard"),
        F.when(at < edge, at % (each + 1)).otherwise((at - edge) % max(each, 1)).alias("slot"),
    )
    path = path or scratch(spark, "shards")
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    names = [*kept, "shard", "slot"]
    return spark.read.schema(dealt.select(*quoted(*[c for c in names if c != "shard"]), "shard").schema).parquet(path).select(*quoted(*names))
