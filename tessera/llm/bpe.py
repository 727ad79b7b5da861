"""Byte-level BPE by corpus-level merge replay, and its decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, quoted, without
from .pieces import UnitIds, gather, per_worker, spans

#: Text bytes of a block of documents whose pieces are merged together.
BLOCK_BYTES = 4 << 20
#: Units, and pieces, whose ids a Python worker carries on to its next block, their characters, and known merges of pairs:
#: memory of a worker is that of these and one block.
HELD, HELD_CHARS, PAIRS = 250_000, 1 << 23, 1 << 19
#: Documents in an Arrow batch on the way back.
ROWS_OUT = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Replay:
    """Applies every merge in rank order to all words of a block at once.

    An inverted index leads from a merge to the positions where its pair stands. A merge
    visits only these; it joins two neighbours in linked lists and enters the new pairs that the
    joined token makes with its own neighbours.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.merged: dict[int, int] = {}

    @staticmethod
    def _code(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first.astype(np.int64) << 32 | second

    def _rank(self, codes: np.ndarray) -> np.ndarray:
        """The token that each pair of tokens merges to, or -1."""
        each, back = np.unique(codes, return_inverse=True)
        known, tokens = self.merged, self.tokens
        out = np.empty(len(each), np.int64)
        for k, code in enumerate(each.tolist()):
            if (r := known.get(code)) is None:
                r = known[code] = self.ranks.get(tokens[code >> 32] + tokens[code & 0xFFFFFFFF], -1)
            out[k] = r
        return out[back]

    def _enter(self, index: dict, heap: list, at: np.ndarray, codes: np.ndarray) -> None:
        ranks = self._rank(codes)
        found = np.flatnonzero(ranks >= 0)
        if not len(found):
            return
        order = found[np.argsort(ranks[found], kind="stable")]
        r = ranks[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for own, a, c in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(at[order], cuts), np.split(codes[order], cuts), strict=True):
            if own not in index:
                index[own] = []
                heappush(heap, own)
            index[own].append((a, c))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, ids per word)."""
        if len(self.merged) > PAIRS:
            self.merged.clear()
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = spans(np.fromiter(map(len, words), np.int64, len(words)))
        n = len(raw)
        tok = self.byte[raw]
        right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        right[ends[1:] - 1], left[ends[:-1]] = -1, -1
        index: dict[int, list] = {}
        heap: list[int] = []
        at = np.flatnonzero(right >= 0).astype(np.int32)
        self._enter(index, heap, at, self._code(tok[at], tok[at + 1]))
        while heap:
            rank = heappop(heap)
            held = index.pop(rank)
            at, codes = (np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else held[0]
            next_ = right[at]
            good = (tok[at] == codes >> 32) & (next_ >= 0)
            good &= tok[next_] == codes & 0xFFFFFFFF
            at = np.unique(at[good])
            if not len(at):
                continue
            # Of overlapping pairs (as in "aaa") the leftmost goes first, then every second one.
            touch = right[at[:-1]] == at[1:]
            if touch.any():
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(np.concatenate([[True], ~touch]), place, 0))
                at = at[(place - start) % 2 == 0]
            gone = right[at]
            after = right[gone]
            tok[at], tok[gone], right[at] = rank, -1, after
            linked = after >= 0
            left[after[linked]] = at[linked]
            before = left[at]
            near = np.unique(np.concatenate([before[before >= 0], at[linked]]))
            if len(near):
                self._enter(index, heap, near, self._code(tok[near], tok[right[near]]))
        stays = tok >= 0
        return tok[stays].astype(np.int32), np.diff(spans(stays)[ends])

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As above, with a word that is itself a token taken whole, as the tokenizer does."""
        raw = [w.encode() for w in words]
        whole = np.fromiter((self.ranks.get(w, -1) for w in raw), np.int64, len(raw))
        open_ = np.flatnonzero(whole < 0)
        flat, lens = self([raw[i] for i in open_.tolist()]) if len(open_) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        all_lens = np.ones(len(raw), np.int64)
        all_lens[open_] = lens
        out = np.repeat(whole, all_lens).astype(np.int32)
        out[np.repeat(whole < 0, all_lens)] = flat
        return out, all_lens


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Runs of rows with about ``most`` bytes of text, whatever the batches hold."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
        i = 0
        while i < batch.num_rows:
            before = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + most - size, "right")))
            held.append(batch.slice(i, j - i))
            size += int(ends[j - 1]) - before
            if j < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            i = j
    if held:
        yield pa.Table.from_batches(held)


def _encoder(path: str, pattern: str, block_bytes: int, back: bool = False):
    """``back``: ids are decoded again in the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = per_worker(("bpe", path, pattern), lambda: UnitIds(regex.compile(pattern).findall, Replay(read_ranks(path)).pieces, HELD, HELD_CHARS))
        tokens = Tokens(read_ranks(path)) if back else None
        for block in _blocks(batches, block_bytes):
            cache.start()
            numbers, units = cache.add([text or "" for text in block["text"].to_pylist()])
            at = spans(units)
            lots = [(i, min(i + ROWS_OUT, len(units))) for i in range(0, len(units), ROWS_OUT)]
            rows = block["row"].combine_chunks()
            rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
            for i, j in lots:
                flat, lens = cache.ids(numbers[at[i] : at[j]])
                ends = spans(lens)[at[i : j + 1] - at[i]]
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                decoded = {"decoded": tokens.decode(ids)} if tokens else {}
                yield pa.RecordBatch.from_arrays([rows.slice(i, j - i), ids, *decoded.values()], ["row", "ids", *decoded])

    return run


def encode(docs: DataFrame, path: str, pattern: str, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """Add ids: each match of ``pattern`` encoded separately by the ranks in ``path``, without special tokens.

    The distinct pieces of a block of documents go through one merge replay; there is no
    shuffle, and a task holds one block (``block_bytes`` of text, or one longer text) at a time. A null text counts
    as empty and has no ids. Returns the ``carry`` columns (default: all; same-named ones are replaced) with ids.
    """
    kept = docs.select(*quoted(*(carry if carry is not None else docs.columns)))
    rows = docs.select(packed(kept, "ids").alias("row"), quoted(text_col)[0].alias("text"))
    schema = rows.select("row", F.array(F.lit(0)).alias("ids")).schema
    return rows.mapInArrow(_encoder(path, pattern, block_bytes), schema).select(*[F.col("row").getField(c).alias(c) for c in without(kept, "ids")], "ids")


class Tokens:
    """The bytes of all tokens end to end."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = sorted((i, t) for t, i in ranks.items())
        self.lens = np.zeros(tokens[-1][0] + 1, np.int64)
        self.lens[[i for i, _ in tokens]] = [len(t) for _, t in tokens]
        self.flat, self.starts = np.frombuffer(b"".join(t for _, t in tokens), np.uint8), spans(self.lens)[:-1]

    def decode(self, part: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        values = part.flatten().to_numpy()
        own = self.lens[values]
        ends = spans(own)[spans(np.asarray(part.value_lengths().to_numpy(zero_copy_only=False), np.int64))]
        buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(gather(self.flat, self.starts[values], own))]
        return pa.Array.from_buffers(pa.binary(), len(part), buffers)


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(read_ranks(path))
        for batch in batches:
            ids = batch["ids"].fill_null([]) if batch["ids"].null_count else batch["ids"]
            for i in range(0, batch.num_rows, ROWS_OUT):
                yield pa.RecordBatch.from_arrays([batch["row"].slice(i, ROWS_OUT), tokens.decode(ids.slice(i, ROWS_OUT))], ["row", "decoded"])

    return run


def decode(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Add decoded: the bytes of each row's ids. Null or no ids give no bytes; an id without a token has none."""
    rows = docs.select(packed(docs, "decoded").alias("row"), quoted(ids_col)[0].alias("ids"))
    schema = rows.select("row", F.lit(b"").alias("decoded")).schema
    return rows.mapInArrow(_decoder(path), schema).select(*[F.col("row").getField(c).alias(c) for c in without(docs, "decoded")], "decoded")


def round_trip(docs: DataFrame, path: str, pattern: str, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """Add ids and decoded: what ``encode`` and then ``decode`` add, in one step, so that a task has one Python worker and ids are sent once."""
    kept = docs.select(*quoted(*(carry if carry is not None else docs.columns)))
    rows = docs.select(packed(kept, "ids", "decoded").alias("row"), quoted(text_col)[0].alias("text"))
    schema = rows.select("row", F.array(F.lit(0)).alias("ids"), F.lit(b"").alias("decoded")).schema
    return rows.mapInArrow(_encoder(path, pattern, block_bytes, back=True), schema).select(*[F.col("row").getField(c).alias(c) for c in without(kept, "ids", "decoded")], "ids", "decoded")
