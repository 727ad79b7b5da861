"""The prefix trie of conversations by ROLLUP over columns of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import scan

from .common import quoted, stored

#: Turn columns of a block; a longer conversation goes on in further blocks.
WIDTH = 8
#: Turns of another conversation that may stand before a conversation's own are fewer than this; conversations share them in runs of ``FAMILY`` ids.
HEADS, FAMILY = 4, 20
#: Ids of a part of a list of ends are those that agree but for so many low bits.
PART_BITS = 12

_WORDS = r"[^\x20\x09-\x0D]+"


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn): turns in order, counted from 1, each as its digest and words.

    A turn is the first 128 bits of the SHA-256 of role and text, so texts are not shuffled. Turns of one number, null ones too, go
    by digest; a repeated row is a further turn. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    each = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("n"),
        F.struct(F.unhex(F.substring(digest, 1, 32)).alias("id"), F.regexp_count(text, F.lit(_WORDS)).alias("words")).alias("turn"),
    )
    order = [F.col("n").asc_nulls_first(), F.col("turn.id")]
    return scan.running(stored(each, "turns"), ["conv_id"], order, {"pos": ("count", F.lit(1))}).drop("n")


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every conversation after the swap of its head, as ``turns`` gives them, and (conv_id, length) of all conversations.

    Of conversation c, the first h turns make way for those of c - c % 20, where h is crc32(c) % 4; a family that has fewer turns, or no
    such conversation, gives what it has.
    """
    heads = ordered.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv_id").alias("family"))
    heads = heads.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "turn"))), lambda x: x["turn"]).alias("head"))
    swapped = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    convs = ordered.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": swapped, "family": F.col("conv_id") - F.col("conv_id") % FAMILY})
    convs = convs.join(heads, "family", "left").withColumn("head", F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast(heads.schema["head"].dataType)))
    length = F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = stored(convs.select("conv_id", "h", "head", length.alias("length")), "convs")
    first = convs.select("conv_id", F.posexplode("head").alias("pos", "turn"), "length").withColumn("pos", F.col("pos") + 1)
    rest = ordered.join(convs.select("conv_id", "h", F.size("head").alias("m"), "length"), "conv_id").where("pos > h")
    both = first.unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "turn", "length"))
    return both, convs.select("conv_id", "length")


def _mark(salt: int, pos: Column, turn: Column) -> Column:
    """What a turn at a position adds to the key of a prefix."""
    return F.xxhash64(F.lit(salt), pos.cast("long"), turn["id"])


_KEYS = {"a": 11, "b": 83}


def blocks(each: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, length, block, a, b, next_a, next_b, t1 ... t8): ``WIDTH`` turns a row, with the key of the node before and after them.

    The key of a prefix is two XORs over its turns, of 64-bit hashes of turn and position, so a node is found without the nodes above it; what
    comes before a block is a running XOR. A conversation without turns has one row.
    """
    at = F.col("pos") - 1
    sums = {f"x{k}": F.bit_xor(_mark(salt, F.col("pos"), F.col("turn"))) for k, salt in _KEYS.items()}
    cut = each.groupBy("conv_id", "length", F.floor(at / WIDTH).cast("long").alias("block"))
    cut = cut.agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("ts"), *[x.alias(n) for n, x in sums.items()])
    none = lengths.where("length = 0").select("conv_id", "length", F.lit(0).cast("long").alias("block"), F.array().cast(cut.schema["ts"].dataType).alias("ts"), *[F.lit(0).cast("long").alias(n) for n in sums])
    cut = stored(cut.unionByName(none), "blocks")
    more = scan.running(cut.where(f"length > {WIDTH}"), ["conv_id"], ["block"], {f"next_{k}": ("bit_xor", F.col(f"x{k}")) for k in _KEYS})
    rows = cut.where(f"length <= {WIDTH}").withColumns({f"next_{k}": F.col(f"x{k}") for k in _KEYS}).unionByName(more)
    before = [F.col(f"next_{k}").bitwiseXOR(F.col(f"x{k}")).alias(k) for k in _KEYS]
    return rows.select("conv_id", "length", "block", *before, *[f"next_{k}" for k in _KEYS], *[F.get("ts", F.lit(i))["turn"].alias(f"t{i + 1}") for i in range(WIDTH)])


def prefixes(rows: DataFrame, **sums: str) -> DataFrame:
    """(depth, conv_id, turn, a, b, up_a, up_b and ``sums``): a row for each distinct prefix, by one ROLLUP of all blocks.

    ``conv_id`` is the least member, ``turn`` the last turn, a and b the node's key and up_a, up_b its parent's.
    The level above a block's first turn is the last one of the block before, and counts there.
    """
    cols = [f"t{i + 1}" for i in range(WIDTH)]
    extra = "".join(f", {x} AS {n}" for n, x in sums.items())
    rolled = rows.sparkSession.sql(
        f"SELECT block, a, b, {', '.join(cols)}, {WIDTH} - bit_count(grouping_id()) AS d, min(conv_id) AS conv_id{extra} FROM {{rows}} GROUP BY block, a, b, ROLLUP({', '.join(cols)})",
        rows=rows,
    )
    full = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) == F.col("d")
    real = rolled.where(full & ((F.col("d") > 0) | (F.col("block") == 0)))
    marks = {k: [F.when(F.col(c).isNotNull(), _mark(salt, F.col("block") * WIDTH + i + 1, F.col(c))).otherwise(0) for i, c in enumerate(cols)] for k, salt in _KEYS.items()}
    for k, parts in marks.items():
        own = F.col(k)
        for p in parts:
            own = own.bitwiseXOR(p)
        real = real.withColumn(f"own_{k}", own)
    turn = F.coalesce(*[F.col(c) for c in reversed(cols)])
    depth = F.col("block") * WIDTH + F.col("d")
    up = [F.when(depth > 0, F.col(f"own_{k}").bitwiseXOR(_mark(salt, depth, turn))).alias(f"up_{k}") for k, salt in _KEYS.items()]
    return real.select(depth.cast("long").alias("depth"), "conv_id", turn.alias("turn"), *[F.col(f"own_{k}").alias(k) for k in _KEYS], *up, *sums)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the parts of each key, which follow one another, joined by commas."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["a", "b", "ends_sha256"])

    for batch in batches:
        for a, b, part in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if key == (a, b):
                state.update(b",")
            else:
                if key is not None:
                    yield done()
                key, state = (a, b), hashlib.sha256()
            state.update(part.encode())
    if key is not None:
        yield done()


def ends(rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): of each node where conversations end, the hash of their ids in order.

    The ids of a node are put in order in parts of at most 4,096 (those that agree in their high bits); the parts pass through the hash one by one, so that
    a task holds one part of a node, however many conversations are equal.
    """
    last = rows.where(F.col("block") == F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / WIDTH))
    parts = last.groupBy(F.col("next_a").alias("a"), F.col("next_b").alias("b"), F.shiftright("conv_id", PART_BITS).alias("part"))
    joined = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    return joined.repartition("a", "b").sortWithinPartitions("a", "b", "part").select("a", "b", "ids").mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` is (conv_id, turn, role, text), other columns have no part; null role or text counts as empty. Every prefix is a node; no conversation, no node.

    Sums over subtrees need no walk down the trie: each node belongs to its least member, which then owns the rest of its way
    down. Of what the members of v own, all lies below v but the nodes above v of v's own owner. So a sum over the subtree is a second ROLLUP of the
    members' totals, less a running sum along the owner.
    """
    at = ["a", "b"]
    each, lengths = rebuilt(turns(rows.select(*quoted("conv_id", "turn", "role", "text"))))
    cut = stored(blocks(each, lengths), "turn-columns")
    nodes = stored(prefixes(cut, n_convs="count(*)"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, at, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = known.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.coalesce(F.col("turn.words"), F.lit(0))})
    known = stored(known.drop("turn"), "known-nodes")
    totals = known.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    # A node of one member shares nothing and is the way to one leaf; the others are summed.
    shared = known.where("n_convs > 1")
    below = prefixes(cut.join(totals, "conv_id", "left"), n="count(*)", leaf="sum(leaf)", saved="sum(saved)").where("n > 1").select(*at, F.col("leaf").alias("all_leaf"), F.col("saved").alias("all_saved"))
    above = scan.running(shared.select(*at, "conv_id", "depth", "saved"), ["conv_id"], ["depth"], {"up_to": ("sum", F.col("saved"))}).select(*at, (F.col("up_to") - F.col("saved")).alias("above"))
    parents = known.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    full = known.join(below, at, "left").join(above, at, "left").join(ends(cut), at, "left").join(parents, ["up_a", "up_b"], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("all_leaf", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce(F.col("all_saved") - F.col("above"), F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
