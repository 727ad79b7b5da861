"""Token ids in files of Simple-8b words."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, scratch, stored
from .pieces import UnitIds, is_plain, per_worker, spans

# Ids in a word and bits for each, by selector; selector 0 says that the next word is one id as it is.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Ids of a block; each block starts a word, and the files keep the word where it starts.
BLOCK = 4096
#: Ids after which a segment (a row of the files) ends with the document that it is in.
SEGMENT = 1 << 20
#: Text bytes that a task encodes at once.
STEP_BYTES = 8 << 20


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, first word of each block) of unsigned ids.

    Each word takes as many ids as fit, from 60 of one bit to one of 60. Where the next word
    starts depends on this one, so all blocks are walked in step.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    choice = np.zeros((blocks, BLOCK), np.int8)
    widest: dict[int, np.ndarray] = {1: _bits(ids, blocks)}

    def most(count: int) -> np.ndarray:
        """Most bits that any of the next ``count`` ids of the block needs."""
        if count not in widest:
            half = 1 << (count - 1).bit_length() - 1
            x, y = most(half), count - half
            out = x.copy()
            np.maximum(out[:, : BLOCK - y], x[:, y:], out=out[:, : BLOCK - y])
            widest[count] = out
        return widest[count]

    for s in range(len(COUNTS) - 1, 0, -1):
        choice[most(int(COUNTS[s])) <= BITS[s]] = s
    flat = choice.reshape(-1)
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    walked = []
    while True:
        live = at < end
        if not live.any():
            break
        walked.append(at[live])
        at = np.where(live, at + COUNTS[flat[np.minimum(at, len(flat) - 1)]], at)
    first = np.sort(np.concatenate(walked))
    chosen = flat[first]
    size = np.where(chosen == 0, 2, 1)
    place = spans(size)
    words = np.zeros(place[-1], np.uint64)
    padded = np.zeros(blocks * BLOCK + 64, np.uint64)
    padded[:n] = ids
    for s in np.unique(chosen).tolist():
        here = chosen == s
        if s == 0:
            words[place[:-1][here] + 1] = padded[first[here]]
            continue
        start, taken = first[here], np.arange(COUNTS[s])
        stop = np.minimum((start // BLOCK + 1) * BLOCK, n)
        held = padded[start[:, None] + taken]
        over = np.flatnonzero(start + COUNTS[s] > stop)
        held[over] = np.where(start[over, None] + taken < stop[over, None], held[over], np.uint64(0))
        parts = np.bitwise_or.reduce(held << (taken * BITS[s]).astype(np.uint64), axis=1)
        words[place[:-1][here]] = parts | np.uint64(s) << np.uint64(60)
    return words, place[np.searchsorted(first, np.arange(blocks) * BLOCK)]


def _bits(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Bits that each id needs; 0 after the last."""
    out = np.zeros(blocks * BLOCK, np.int8)
    top = int(ids.max())
    if top < 1 << 20:  # as vocabularies are
        out[: len(ids)] = np.frexp(np.arange(top + 1))[1].astype(np.int8)[ids]
    else:
        out[: len(ids)] = np.frexp(ids.astype(np.float64))[1]  # rounding can add a bit over 2**53, which costs an escape at most
    return out.reshape(blocks, BLOCK)


def unpack(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ids; words of one selector are decoded together, whatever block they are in."""
    if not n:
        return np.zeros(0, np.uint64)
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():  # escapes are rare; an id itself may look like one
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    selector[raw] = 0
    counts = np.where(raw, 0, COUNTS[selector])
    before = spans(counts)[:-1]
    block = np.searchsorted(starts, np.arange(len(words)), "right") - 1
    place = before - before[starts][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector[~raw]).tolist():
        here = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[place[here]] = words[here + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            i = place[here] + k
            good = i < stop[here]
            out[i[good]] = (words[here[good]] >> np.uint64(k * BITS[s])) & mask
    return out


def _alphabet() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use: printable bytes stay, the others follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _tokenizer(path: str, pattern: str, end_id: int):
    """A function from texts to (ids end to end, ids per text), each text closed by ``end_id``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    letters, tokenize = {b: c for b, c in _alphabet().items() if b}, tokenizer.model.tokenize

    def pieces(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A plain text holds no null character: it parts the pieces while all are translated at once.
        written = "\0".join(new).encode().decode("latin-1").translate(letters).split("\0")
        found = [[t.id for t in tokenize(p)] for p in written]
        return np.array([i for ids in found for i in ids], np.int32), np.fromiter(map(len, found), np.int64, len(found))

    cache = UnitIds(regex.compile(pattern).findall, pieces)

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cache.start()
        plain = [is_plain(t) and not any(x in t for x in special) for t in texts]
        whole = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for i, (t, p) in enumerate(zip(texts, plain, strict=True)) if not p}
        numbers, units = cache.add([t for t, p in zip(texts, plain, strict=True) if p])
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain] = units
        flat, lens = cache.ids(numbers)
        ends = spans(lens)[spans(sizes)]
        parts, close = [], np.array([end_id], np.int32)
        for i in range(len(texts)):
            parts += [whole[i] if i in whole else flat[ends[i] : ends[i + 1]], close]
        return np.concatenate(parts), np.fromiter((len(x) + 1 for x in parts[::2]), np.int64, len(texts))

    return run


def _writer(path: str, pattern: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("token files", path, pattern, end_id), lambda: _tokenizer(path, pattern, end_id))
        shard, segment = TaskContext.get().partitionId(), 0
        ids, lens, docs = [], [], []

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            words, starts = pack(flat)
            own = np.concatenate(lens)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([starts], pa.list_(pa.int64())), pa.array([sum(docs, [])], pa.list_(pa.int64())), pa.array([own], pa.list_(pa.int64()))],
                ["shard", "segment", "n_ids", "words", "block_starts", "doc_ids", "doc_tokens"],
            )

        for batch in batches:
            i = 0
            sizes = np.asarray(batch["size"].to_numpy(), np.int64)
            while i < batch.num_rows:
                j = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), STEP_BYTES, "right")))
                flat, own = encode([t or "" for t in batch["text"].slice(i, j - i).to_pylist()])
                ids.append(flat)
                lens.append(own)
                docs.append(batch["doc"].slice(i, j - i).to_pylist())
                if sum(map(len, ids)) >= SEGMENT:
                    yield close()
                    segment += 1
                    ids, lens, docs = [], [], []
                i = j
        if ids:
            yield close()

    return run


FORMAT = "shard int, segment int, n_ids long, words binary, block_starts array<long>, doc_ids array<long>, doc_tokens array<long>"


def write_tokens(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text and write the ids, in ascending id order, as Simple-8b words; returns the folder.

    Documents are dealt by ranges of ids, sorted, encoded and packed where they land; a
    shard is a range. A row of the files is a segment: whole documents of about
    ``SEGMENT`` ids, the words, the first word of each block of ``BLOCK`` ids (so any block
    can be decoded alone), and the documents' ids and lengths. A null text is empty and has the end id alone.
    Null ids come first; rows that share an id are ordered by a hash of their text. No rows give no segments.
    """
    path = path or scratch(docs.sparkSession, "tokens")
    text = F.coalesce(quoted(text_col)[0], F.lit(""))
    rows = docs.select(quoted(id_col)[0].cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"), F.octet_length(text).alias("size"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, F.asc_nulls_first("doc"), "h").sortWithinPartitions(F.asc_nulls_first("doc"), "h")
    dealt.select("doc", "text", "size").mapInArrow(_writer(tokenizer, pattern, end_id), FORMAT).write.option("compression", "none").parquet(path)
    return path


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["block_starts"], np.int64), row["n_ids"]).astype("<u4")
            ends = spans(np.array(row["doc_tokens"], np.int64))
            n = len(row["doc_ids"])
            sums = [crc32(ids[ends[i] : ends[i + 1]]) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["segment"], np.int32)), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                ["doc_id", "shard", "segment", "within", "n_tokens", "ids_crc32"],
            )


def read_digest(spark, path: str) -> DataFrame:
    """Decode the files: per document its first id's place among all, its number of ids and their crc32."""
    files = spark.read.schema(FORMAT).parquet(path)
    sizes = files.groupBy("shard", "segment").agg(F.sum("n_ids").alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    # One row per shard, then one per segment of a shard: what the window tasks read is the files' index.
    shard_start = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    segment_start = sizes.select("shard", "segment", (F.sum("n").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n")).alias("segment_start"))
    starts = stored(segment_start.join(shard_start, "shard").select("shard", "segment", (F.col("segment_start") + F.col("shard_start")).alias("first")), "starts")
    docs = files.mapInArrow(_reader, "doc_id long, shard int, segment int, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "segment"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(words: bytes, block_starts: list[int], n_ids: int, block: int) -> np.ndarray:
    """The ids of one block of a segment, from its own words only."""
    first = block_starts[block]
    last = block_starts[block + 1] if block + 1 < len(block_starts) else len(words) // 8
    return unpack(np.frombuffer(words, "<u8")[first:last], np.zeros(1, np.int64), min(BLOCK, n_ids - block * BLOCK))
