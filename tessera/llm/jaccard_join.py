"""N-gram Jaccard join with Bayesian candidate pruning."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import packed, quoted, stored
from .linking import components, link
from .words import grams, similar, texts_to_words

#: Words in a shingle, and the similarity from which two texts are linked.
WORDS, SIMILAR = 5, 0.8
HASHES, BANDS, ROWS = 64, 16, 4
#: MinHash values compared between two looks at the posterior.
LOOK = 8
#: A pair is dropped when the probability that it reaches the threshold falls below this.
TOLERANCE = 1e-4
#: Rows of a tile: the rest of a large bucket is compared in tiles of so many rows by as many.
TILE = 256
#: Rows of a lot, and cells of its sets, when the links of large buckets are counted.
LOT, LOT_CELLS = 1024, 1 << 22
#: Cells of the broadcast set of candidate rows; bounds its size.
CELLS = 1 << 18

_rng = np.random.default_rng(3)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def fewest_matches(m: int, threshold: float = SIMILAR, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among m values with which a pair goes on.

    With a uniform prior and c matches, similarity has a Beta(c + 1, m - c + 1) posterior, whose
    tail over the threshold equals that of a binomial: P(Bin(m + 1, threshold) <= c).
    """
    tail = 0.0
    for c in range(m + 1):
        tail += comb(m + 1, c) * threshold**c * (1 - threshold) ** (m + 1 - c)
        if tail >= tolerance:
            return c
    return m


def shingles(words: np.ndarray) -> np.ndarray:
    return np.unique(grams(words, WORDS))


def signature(sets: np.ndarray) -> bytes:
    low = np.full(HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(sets), 2048):
        low = np.minimum(low, (sets[i : i + 2048, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hi, lo, size, sig = [], [], [], []
        for words in texts_to_words(batch["text"]):
            s = shingles(words)
            size.append(len(s))
            hi.append(int((s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) >> np.uint64(1)) if len(s) else None)
            lo.append(int((s ^ (s >> np.uint64(32))).sum(dtype=np.uint64) >> np.uint64(1)) if len(s) else None)
            sig.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch["id"], batch["rk"], pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(size, pa.int32()), pa.array(sig, pa.binary())], ["id", "rk", "hi", "lo", "size", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), "<u4").reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        for r in range(ROWS):
            key = (key * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        for i in range(0, len(key), 4096):
            part = key[i : i + 4096]
            nid, w = (np.repeat(batch[c].to_numpy()[i : i + 4096], BANDS) for c in ("nid", "w"))
            # The band is the key's lowest four bits.
            flat = (part & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(nid), pa.array(w)], ["key", "nid", "w"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare MinHash values ``LOOK`` at a time; drop pairs that most likely stay below the threshold."""
    needs = [(m, fewest_matches(m)) for m in range(LOOK, HASHES + 1, LOOK)]
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for m, need in needs:
            matches = matches + (x[alive, m - LOOK : m] == y[alive, m - LOOK : m]).sum(axis=1)
            stay = matches >= need
            alive, matches = alive[stay], matches[stay]
        left = batch.take(pa.array(alive))
        yield pa.RecordBatch.from_arrays([left["a"], left["b"]], ["a", "b"])


def _tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two lots of a bucket's rows, as few as join what they join.

    A pair is looked at in the first band that it shares; what the MinHash values leave is verified on the whole sets.
    """
    found_a: list[int] = []
    found_b: list[int] = []
    if left.num_rows and right.num_rows:
        x, y = (np.frombuffer(b"".join(t["sig"].to_pylist()), "<u4").reshape(-1, HASHES) for t in (left, right))
        sx, sy = ([np.frombuffer(s, np.uint64) for s in t["set"].to_pylist()] for t in (left, right))
        nx, ny, head = left["nid"].to_pylist(), right["nid"].to_pylist(), {}

        def root(i: int) -> int:
            while (up := head.setdefault(i, i)) != i:
                head[i] = head[up] if up in head else up
                i = up
            return i

        for n, c in zip(nx + ny, left["comp"].to_pylist() + right["comp"].to_pylist(), strict=True):
            head[n] = head.setdefault(-1 - c, n)
        size_x, size_y = np.array([len(s) for s in sx]), np.array([len(s) for s in sy])
        band = left["band"][0].as_py()
        for i in range(len(nx)):
            good = np.minimum(size_x[i], size_y) >= SIMILAR * np.maximum(size_x[i], size_y) - 1e-9
            alive = np.flatnonzero(good)
            same = x[i] == y[alive]
            first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            matches = same.reshape(-1, HASHES // LOOK, LOOK).sum(axis=2).cumsum(axis=1)
            needs = np.array([fewest_matches(m) for m in range(LOOK, HASHES + 1, LOOK)])
            for j in alive[(first == band) & (matches >= needs).all(axis=1)].tolist():
                if root(nx[i]) != root(ny[j]) and similar(sx[i], sy[j], SIMILAR):
                    head[root(nx[i])] = root(ny[j])
                    found_a.append(min(nx[i], ny[j]))
                    found_b.append(max(nx[i], ny[j]))
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def _tally(table: pa.Table) -> pa.Table:
    """(nid, others): copies that links between two lots of a bucket's rows (or inside one) give each row.

    Counts the pairs that share no small bucket, in the first band that they share.
    """
    x = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(-1, HASHES)
    sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
    size, lot, w = np.array([len(s) for s in sets]), table["lot"].to_numpy(), table["w"].to_numpy()
    few = (table["few"].to_numpy()[:, None] >> np.arange(BANDS)) & 1 == 1
    lot_a, lot_b, band = (table[c][0].as_py() for c in ("lot_a", "lot_b", "band"))
    right, needs = np.flatnonzero(lot == lot_b), np.array([fewest_matches(m) for m in range(LOOK, HASHES + 1, LOOK)])
    others = np.zeros(len(sets), np.int64)
    for i in np.flatnonzero(lot == lot_a).tolist():
        near = right[right > i] if lot_a == lot_b else right
        near = near[np.minimum(size[i], size[near]) >= SIMILAR * np.maximum(size[i], size[near]) - 1e-9]
        same = x[i] == x[near]
        shared = same.reshape(-1, BANDS, ROWS).all(axis=2)
        matches = same.reshape(-1, HASHES // LOOK, LOOK).sum(axis=2).cumsum(axis=1)
        for j in near[(shared.argmax(axis=1) == band) & ~(shared & few[i]).any(axis=1) & (matches >= needs).all(axis=1)].tolist():
            if similar(sets[i], sets[j], SIMILAR):
                others[i] += w[j]
                others[j] += w[i]
    at = np.flatnonzero(others)
    return pa.table({"nid": table["nid"].combine_chunks().take(pa.array(at)), "others": pa.array(others[at])})


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, others) for both ends of the links between rows that share a small bucket."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(-1, BANDS, ROWS) for c in ("sig_a", "sig_b"))
        few = (batch["few"].to_numpy()[:, None] >> np.arange(BANDS)) & 1 == 1
        left = batch.take(pa.array(np.flatnonzero(((x == y).all(axis=2) & few).any(axis=1))))
        for nid, w in (("a", "w_b"), ("b", "w_a")):
            yield pa.RecordBatch.from_arrays([left[nid], left[w]], ["nid", "others"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True)
        linked = [i for i, (p, q) in enumerate(pairs) if similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), SIMILAR)]
        left = batch.take(pa.array(linked, pa.int64()))
        yield pa.RecordBatch.from_arrays([left["a"], left["b"]], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [shingles(w).tobytes() for w in texts_to_words(batch["text"])]
        for i in range(0, len(held), 256):
            yield pa.RecordBatch.from_arrays([batch["nid"][i : i + 256], pa.array(held[i : i + 256], pa.binary())], ["nid", "set"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its near-duplicate class and its number of links.

    Two texts are linked when the Jaccard similarity of their sets of five-word shingles is
    ``SIMILAR`` or more; classes are the components of the links. A text of one to four words is
    one shingle; a text without words (null and empty ones too) is a class of its own without links.

    Texts with equal shingle sets are one node with its copies. Nodes that share one of ``BANDS``
    MinHash bands are candidates (see ``linking.link`` for large buckets). Their values are
    compared ``LOOK`` at a time, and a pair whose posterior probability of reaching the threshold falls
    below ``TOLERANCE`` is dropped; the rest are verified exactly on their whole sets, which are
    read for candidates only.

    class_id is the smallest id of the class (null ids last); n_links counts the other
    documents that verified links and equal sets give a document. Links between texts that share a
    bucket of ``linking.SMALL`` texts or fewer are all rows; those of large buckets are counted
    apart, in tasks that give sums and no pairs. ``kept`` marks the document of the smallest id; of rows that repeat id and text, one of them.
    Columns: doc id (under ``id_col``), row_key (hash of id and text), class_id, n_links, kept.
    """
    row_key = F.xxhash64(quoted(id_col)[0], quoted(text_col)[0])
    rows = docs.select(quoted(id_col)[0].alias("id"), row_key.alias("rk"), quoted(text_col)[0].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    all_rows = stored(rows.mapInArrow(_sketch, f"id {id_type}, rk long, hi long, lo long, size int, sig binary").withColumn("rid", F.monotonically_increasing_id()), "sketches")
    some = all_rows.where("size > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rk", "rid")).alias("first")
    nodes = stored(some.groupBy("hi", "lo").agg(first, F.count("*").alias("w"), F.first("size").alias("size"), F.first("sig").alias("sig")).withColumn("nid", F.monotonically_increasing_id()), "nodes")

    buckets = sets = None

    def prepare(multi: DataFrame):
        nonlocal buckets, sets
        buckets = multi
        wanted = stored(nodes.join(multi.select("nid").distinct(), "nid", "left_semi").select("nid", F.col("first.rk").alias("rk")), "wanted")
        cell = F.pmod(F.col("rk"), F.lit(CELLS)).cast("int").alias("cell")
        # At most CELLS numbers are broadcast; they keep texts of rows that nobody asks for out of the shuffle.
        near = rows.select("rk", "text", cell).join(F.broadcast(wanted.select(cell).distinct()), "cell", "left_semi")
        texts = near.join(wanted, "rk").select("nid", "text")
        sets = stored(texts.mapInArrow(_sets, "nid long, set binary").dropDuplicates(["nid"]), "sets")
        short = nodes.select("nid", "size", "sig")

        def check(pairs: DataFrame) -> DataFrame:
            a, b = (short.select(F.col("nid").alias(s), F.col("size").alias(f"size_{s}"), F.col("sig").alias(f"sig_{s}")) for s in "ab")
            sized = pairs.join(a, "a").join(b, "b").where(F.least("size_a", "size_b") >= SIMILAR * F.greatest("size_a", "size_b") - 1e-9)
            likely = stored(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune, "a long, b long"), "likely")
            sa, sb = (sets.select(F.col("nid").alias(s), F.col("set").alias(f"s{s}")) for s in "ab")
            return likely.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long")

        def rest(away: DataFrame, tagged: DataFrame) -> DataFrame:
            lots = away.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("lots_a"))
            lots = stored(tagged.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("lots_b")).join(lots, "key"), "lots")
            lot = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            held = nodes.select("nid", "sig").join(sets, "nid")
            band = F.col("key").bitwiseAND(F.lit(BANDS - 1)).cast("int").alias("band")
            a = away.join(lots, "key").select("key", "nid", "comp", band, lot("lots_a").alias("lot_a"), every("lots_b").alias("lot_b")).join(held, "nid")
            b = tagged.join(lots, "key").select("key", "nid", "comp", lot("lots_b").alias("lot_b"), every("lots_a").alias("lot_a")).join(held, "nid")
            # Both sides come from the same tables; new names for the columns of one keep them apart.
            a, b = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (a, b))
            tile = ["key", "lot_a", "lot_b"]
            return a.groupBy(*tile).cogroup(b.groupBy(*tile)).applyInArrow(_tile, "a long, b long")

        return check, rest

    links = stored(link(nodes.select("nid", "w", "sig").mapInArrow(_bands, "key long, nid long, w long"), prepare), "all-links")
    band = F.col("key").bitwiseAND(F.lit(BANDS - 1)).cast("int")
    small = F.when(F.col("size") <= linking.SMALL, F.pow(F.lit(2), band).cast("int")).otherwise(0)
    info = stored(nodes.select("nid", "w", "sig", F.col("size").alias("cells")).join(buckets.groupBy("nid").agg(F.bit_or(small).alias("few")), "nid"), "counted")
    a, b = (info.select(F.col("nid").alias(s), F.col("w").alias(f"w_{s}"), F.col("sig").alias(f"sig_{s}"), F.col("few").alias(f"few_{s}")) for s in "ab")
    degree = links.join(a, "a").join(b, "b").select("a", "b", "w_a", "w_b", "sig_a", "sig_b", F.col("few_a").alias("few")).mapInArrow(_few, "nid long, others long")
    large = buckets.where(F.col("size") > linking.SMALL).select("key", "nid").join(info, "nid")
    lots = stored(large.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / LOT, F.sum("cells") / LOT_CELLS)).cast("int").alias("lots")), "count-lots")
    dealt = large.join(lots, "key").select("key", "nid", "w", "sig", "few", band.alias("band"), F.pmod(F.xxhash64("nid"), F.col("lots")).cast("int").alias("lot"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("with"))
    tiles = dealt.select("key", F.least("lot", "with").alias("lot_a"), F.greatest("lot", "with").alias("lot_b"), "lot", "nid", "w", "sig", "few", "band").join(sets, "nid")
    degree = degree.unionByName(tiles.groupBy("key", "lot_a", "lot_b").applyInArrow(_tally, "nid long, others long"))
    degree = degree.groupBy("nid").agg(F.sum("others").alias("others"))
    comp = components(links)
    grouped = nodes.select("nid", "hi", "lo", "first", "w").join(comp, "nid", "left").join(degree, "nid", "left")
    grouped = stored(grouped.select("hi", "lo", "first", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("comp", "nid").alias("comp")), "grouped")
    heads = stored(grouped.groupBy("comp").agg(F.min("first").alias("head")), "heads")
    classes = stored(grouped.join(heads, "comp").select("hi", "lo", "n_links", "head"), "classes")
    alone = all_rows.where("size = 0").select("id", "rk", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    told = some.join(classes, ["hi", "lo"]).select("id", "rk", F.col("head.id").alias("class_id"), "n_links", (F.col("rid") == F.col("head.rid")).alias("kept"))
    return told.unionByName(alone).select(F.col("id").alias(id_col), F.col("rk").alias("row_key"), "class_id", "n_links", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose class keeps another one; of rows that repeat id and text one stays at most.

    A text without words is alone in its class and always stays, repeated or not.
    """
    marks = near_duplicates(docs, id_col, text_col).groupBy("row_key").agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count("*").alias("n"))
    gone = stored(marks.where("stay < n").select(F.col("row_key").alias("gone"), "stay"), "near-copies")
    keyed = docs.select(packed(docs).alias("row"), F.xxhash64(quoted(id_col)[0], quoted(text_col)[0]).alias("key"))
    stays = keyed.join(gone, F.col("key") == F.col("gone"), "left_anti")
    one = keyed.join(gone.where("stay > 0"), F.col("key") == F.col("gone"), "left_semi").dropDuplicates(["key"])
    return stays.unionByName(one).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
