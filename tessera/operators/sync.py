"""Index maintenance: what changed, what to do about it, and upserts of index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import needs_index


def diff(current: DataFrame, indexed: DataFrame, failed: DataFrame) -> DataFrame:
    """(file_path, op): create, modify, delete, skip or failed, of tables (file_path, mtime, size).

    One full outer join. A file that failed before is left alone until its time or size changes.
    """
    now = current.select("file_path", "mtime", "size")
    old = indexed.select("file_path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    bad = failed.select("file_path", F.col("mtime").alias("bad_mtime"), F.col("size").alias("bad_size"))
    both = now.join(old, "file_path", "full").join(bad, "file_path", "left")
    known_bad = (F.col("mtime") == F.col("bad_mtime")) & (F.col("size") == F.col("bad_size"))
    op = (
        F.when(F.col("mtime").isNull(), "delete")
        .when(F.coalesce(known_bad, F.lit(False)), "failed")
        .when(F.col("old_mtime").isNull(), "create")
        .when(needs_index(F.col("mtime"), F.col("size"), F.col("old_mtime"), F.col("old_size")), "modify")
        .otherwise("skip")
    )
    return both.select("file_path", op.alias("op"))


#: What may be held of a key after some of its changes; an empty string is nothing.
HELD = ["", "create", "modify", "delete", "rename"]


def _step(held: Column, op: Column) -> Column:
    return F.when(held == "", op).when((held == "create") & (op == "delete"), "").when((held == "modify") & (op == "delete"), "delete").otherwise(held)


def coalesced(changes: DataFrame, segment: Column | None = None) -> DataFrame:
    """The operation left of each key's changes (key, ts, seq, op), folded in time order.

    A create keeps being one when modified, and vanishes when deleted; a modify becomes a delete; any other
    pair keeps the earlier one. Keys whose changes cancel out have no row.

    The changes of a key and a segment of time (an hour, or what ``segment`` makes of ``ts``) are folded to what they turn each
    of the five held states into; the few segments of a key then follow one another. So no group holds the history of a key.
    """
    cut = F.date_trunc("hour", F.col("ts").cast("timestamp")) if segment is None else segment
    ops = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "op"))), lambda x: x["op"])
    start = F.array(*map(F.lit, HELD))
    turned = F.aggregate(ops, start, lambda held, op: F.transform(held, lambda h: _step(h, op)))
    parts = changes.groupBy("key", cut.alias("segment")).agg(turned.alias("turned"))
    known = lambda held: F.array_position(start, held).cast("int") - 1
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("segment", "turned"))), F.lit(""), lambda held, p: F.get(p["turned"], known(held)))
    return parts.groupBy("key").agg(folded.alias("op")).where("op <> ''")


def renames(events: DataFrame, indexed: DataFrame) -> DataFrame:
    """What a rename (old_path, new_path) means: whether the old one is indexed and the new one can be decides."""
    from tessera.operators.filters import indexable

    known = events.join(indexed.select(F.col("file_path").alias("old_path"), F.lit(True).alias("known")), "old_path", "left")
    was, will = F.coalesce("known", F.lit(False)), indexable(F.col("new_path"))
    op = F.when(was & will, "rename").when(was, "delete").when(will, "create").otherwise("none")
    return known.select("old_path", "new_path", op.alias("op"))


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The table with rows of the same key replaced: an anti join and a union, to be written to a new location."""
    return table.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows)


def remove(table: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return table.join(keys.select(*key).distinct(), list(key), "left_anti")


def latest(requests: DataFrame) -> DataFrame:
    """The last request (component, ts, request) of each component; earlier ones are superseded."""
    return requests.groupBy("component").agg(F.max_by("request", F.struct("ts", "request")).alias("request"), F.count("*").alias("n"))


def quarantine(vectors: DataFrame) -> DataFrame:
    """(file_path, bad_chunks, failed): a file with any NaN in a vector is rejected as a whole."""
    bad = F.exists("embedding", F.isnan)
    return vectors.groupBy("file_path").agg(F.count(F.when(bad, 1)).alias("bad_chunks"), F.bool_or(bad).alias("failed"))
