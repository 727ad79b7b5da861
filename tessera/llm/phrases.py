"""Phrase collocations by Toivonen's mining: a sample proposes, a full pass counts proposals and their border, failures at the border are counted in a further pass."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .pieces import gather, spans
from .words import mix

#: A phrase that occurs so often is a candidate.
SUPPORT = 30
#: Longest phrase, in words.
LONGEST = 4
#: One document of so many is in the sample, where a phrase is proposed that occurs ``PROPOSED`` times (SUPPORT / RATE is the mean at the edge).
RATE, PROPOSED = 8, 2
#: A longer candidate with so many per cent of the occurrences swallows those inside it.
SWALLOWED = 80
SCALE, BEST = 2_000_000, 2000
#: Bits of a filter, whatever it holds: 8 MB go to each executor. A full filter lets more through to be counted, it loses nothing.
BITS = 1 << 26
PROBES = 3
#: Text bytes whose phrases are counted together, and rows of a batch that goes back.
BLOCK_BYTES, ROWS_OUT = 1 << 20, 1 << 14
#: Partitions of packed counts, or as many as the session uses if these are more.
BUCKETS = 256
#: Rows that a task gathers before it adds them up.
MERGED = 1 << 17

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PACKED = "bucket long, lang string, phrases string, counts binary"
_ROWS = "lang string, phrase string, n int, count long"


def _byte_classes() -> bytes:
    """Bytes of a text, as they count: A-Z lower-cased, ends of pieces as line feeds, tabs as spaces."""
    return bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 7)


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of phrases from those of all but the last word, and of the last."""
    return mix(prefix * _STEP + word)


class Filter:
    """Phrases that may be in a set: all that are, and few others. No filter holds all."""

    def __init__(self, bits: np.ndarray | None) -> None:
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(keys), bool)
        out = np.ones(len(keys), bool)
        for at in _places(keys):
            out &= (self.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def _places(keys: np.ndarray) -> list[np.ndarray]:
    return [(mix(keys + np.uint64(i * int(_STEP) % (1 << 64))) & np.uint64(BITS - 1)).astype(np.int64) for i in range(PROBES)]


def _grouped(code: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes below ``top``, where each stands first, its number at each place, its occurrences."""
    if top > 8 * len(code) + 1024:
        return np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    count = np.bincount(code, minlength=top)
    distinct = np.flatnonzero(count)
    first, number = np.zeros(top, np.int64), np.zeros(top, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    number[distinct] = np.arange(len(distinct))
    return distinct, first[distinct], number[code], count[distinct]


class Block:
    """The words of some texts: where they stand, which are equal, where a piece ends."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        wide = pa.large_string()
        closed = pc.binary_join_element_wise(pc.fill_null(texts.cast(wide), ""), pa.scalar("", wide), pa.scalar("\n", wide))
        _, offsets, data = closed.buffers()
        ends = np.frombuffer(offsets, np.int64)[closed.offset : closed.offset + len(closed) + 1]
        raw = np.frombuffer(bytearray(memoryview(data)[ends[0] : ends[-1]]).translate(_byte_classes()) if len(closed) else b"", np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = (raw != 10) & (raw != 32)
        edge = np.diff(inside)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # Words end to end, each with one space behind it; so a phrase is one slice, and equal words are equal slices.
        piece = np.searchsorted(np.flatnonzero(raw == 10), starts)
        self.at = spans(stops - starts + 1)
        kept = inside[1:-1].astype(bool)
        kept[stops], raw[stops] = True, 32
        self.bytes = raw[kept]
        self.follows = np.append(piece[1:] == piece[:-1], False) if len(starts) else np.zeros(0, bool)
        own = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.langs = own.dictionary.to_pylist()
        lang = own.indices.to_numpy().astype(np.int64)[np.searchsorted(ends[1:] - ends[0], starts, "right")]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(self.at), pa.py_buffer(self.bytes)]).dictionary_encode()
        known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        code = coded.indices.to_numpy().astype(np.int64) + lang * max(len(known), 1)
        distinct, self.first, self.word, self.count = _grouped(code, len(self.langs) * len(known))
        self.lang = distinct // max(len(known), 1)
        self.hash = known[distinct % max(len(known), 1)] if len(known) else np.zeros(0, np.uint64)
        self.seeds = np.array([_seed(x) for x in self.langs], np.uint64)

    def count_all(self, proposed: Filter, frequent: Filter | None, longest: int, proposing: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, language, first place, occurrences, key) of the phrases that this pass counts.

        A phrase is proposed or at its border if both phrases of one word less are proposed; single words always are. The full pass (``frequent`` is
        None) counts these. A further pass counts the rest of what may be frequent: phrases with no part that is known to be rare. In the sample
        (``proposing``) only phrases that these texts hold so often grow; what is overlooked there is left to the passes over all texts.
        """
        keys = _longer(self.seeds[self.lang], self.hash)
        counted = proposed.has(keys) if proposing is None else self.count >= proposing  # counted by the full pass, and proposed
        on = counted if frequent is None else frequent.has(keys)  # may grow in this pass
        if frequent is None:
            yield 1, self.lang, self.first, self.count, keys
        unit, lang = self.word, self.lang  # number of the phrase that starts at each word; none is the last, which never goes on
        for n in range(2, longest + 1):
            on, counted = np.append(on, False), np.append(counted, False)
            after = np.append(unit[1:], len(on) - 1)
            held = np.flatnonzero(on[unit] & on[after] & self.follows) if n == 2 else np.flatnonzero(on[unit] & on[after])
            if not len(held):
                return
            pairs, first, back, count = np.unique(unit[held] << 32 | after[held], return_index=True, return_inverse=True, return_counts=True)
            left, right, first = pairs >> 32, pairs & 0xFFFFFFFF, held[first]
            keys, lang = _longer(keys[left], self.hash[self.word[first + n - 1]]), lang[left]
            was = counted[left] & counted[right]
            own = proposed.has(keys) if proposing is None else count >= proposing
            if frequent is None:
                yield n, lang, first, count, keys
                on = own
            else:
                if not was.all():
                    yield n, lang[~was], first[~was], count[~was], keys[~was]
                on = np.where(was, frequent.has(keys), True)
            counted = was & own
            fresh = np.full(len(unit), len(pairs))
            fresh[held] = back
            unit = fresh

    def rows(self, proposed: Filter, frequent: Filter | None, longest: int, proposing: int | None, buckets: int) -> Iterator[pa.RecordBatch]:
        """The counted phrases, packed by bucket and language (``_PACKED``); the words of a language count as those of an empty phrase."""
        if frequent is None and len(self.langs):
            total = np.bincount(self.lang, self.count, len(self.langs)).astype(np.int64)
            yield _packed(np.zeros(len(total), np.int64), np.arange(len(total)), np.full(len(total), 10, np.uint8), np.arange(len(total) + 1), total, self.langs)
        found = [(key, lang, self.at[first], self.at[first + n], count) for n, lang, first, count, key in self.count_all(proposed, frequent, longest, proposing)]
        if not found:
            return
        key, lang, starts, stops, count = (np.concatenate(x) for x in zip(*found, strict=True))
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((lang, bucket))
        for i in range(0, len(order), MERGED):
            own = order[i : i + MERGED]
            lens = stops[own] - starts[own]
            ends = spans(lens)
            flat = gather(self.bytes, starts[own], lens)
            flat[ends[1:] - 1] = 10  # for the space behind the last word
            yield _packed(bucket[own], lang[own], flat, ends, count[own].astype(np.int64), self.langs)


def _packed(bucket: np.ndarray, lang: np.ndarray, flat: np.ndarray, ends: np.ndarray, count: np.ndarray, langs: list[str]) -> pa.RecordBatch:
    """A row for each run of one bucket and language: its phrases, each closed by a line feed, and their counts."""
    cuts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1])]))
    at = np.append(cuts, len(bucket))
    text = pa.Array.from_buffers(pa.string(), len(cuts), [None, pa.py_buffer(ends[at].astype(np.int32)), pa.py_buffer(flat)])
    held = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(count)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(langs, pa.string()).take(pa.array(lang[cuts])), text, held], ["bucket", "lang", "phrases", "counts"])


def _merger(least: int):
    """Sums of packed counts, of which those of ``least`` and more are given out; what a task holds are the distinct phrases of its buckets."""

    def merged(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        coded = pa.concat_arrays([phrases for phrases, _ in held]).dictionary_encode()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, coded.indices.to_numpy(), np.concatenate([count for _, count in held]))
        return coded.dictionary, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size, room = 0, MERGED
        for batch in batches:
            each = pc.binary_length(batch["counts"]).to_numpy().astype(np.int64) // 8
            _, offsets, data = batch["counts"].buffers()
            first = int(np.frombuffer(offsets, np.int32)[batch["counts"].offset]) if batch.num_rows else 0
            count = np.frombuffer(data, np.int64, int(each.sum()), first) if each.any() else np.zeros(0, np.int64)
            # What follows the last line feed of a row is no phrase.
            split = pc.split_pattern(batch["phrases"].cast(pa.large_string()), "\n").flatten()
            real = np.ones(len(split), bool)
            real[np.cumsum(each + 1) - 1] = False
            own = batch["lang"].dictionary_encode()
            lang = np.repeat(own.indices.to_numpy(), each + 1)
            for k, name in enumerate(own.dictionary.to_pylist()):
                mine = (lang == k) & real
                held.setdefault(name, []).append((split.filter(pa.array(mine)), count[mine[real]]))
            size += len(count)
            if size > room:
                held = {name: [merged(parts)] for name, parts in held.items()}
                size = sum(len(parts[0][1]) for parts in held.values())
                room = MERGED + 2 * size
                pa.default_memory_pool().release_unused()
        for name in list(held):
            phrases, total = merged(held.pop(name))
            phrases = phrases.cast(pa.string())
            none = pc.equal(phrases, "").to_numpy(zero_copy_only=False)
            kept = np.flatnonzero((total >= least) | none)
            n = np.where(none, 0, pc.count_substring(phrases, " ").to_numpy() + 1).astype(np.int32)
            for i in range(0, len(kept), ROWS_OUT):
                at = kept[i : i + ROWS_OUT]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), phrases.take(pa.array(at)), pa.array(n[at]), pa.array(total[at])], ["lang", "phrase", "n", "count"])
            del phrases
        pa.default_memory_pool().release_unused()

    return run


def _counter(proposed, frequent, longest: int, block_bytes: int, proposing: int | None, buckets: int):
    """``proposed`` and ``frequent``: broadcast bits, or None; ``frequent`` marks a further pass, ``proposing`` that over the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, more = Filter(proposed and proposed.value), None if frequent is None else Filter(frequent.value)
        held, size = [], 0
        for batch in batches:
            lens = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64)
            lot = (np.cumsum(lens) + size) // block_bytes
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.unique(np.concatenate([[0], np.flatnonzero(np.diff(lot)) + 1, [batch.num_rows]]))), strict=True):
                held.append(batch.slice(a, b - a))
                size += int(lens[a:b].sum())
                if size >= block_bytes or b < batch.num_rows:
                    yield from _block(held).rows(first, more, longest, proposing, buckets)
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from _block(held).rows(first, more, longest, proposing, buckets)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run


def _block(held: list[pa.RecordBatch]) -> Block:
    table = pa.Table.from_batches(held)
    return Block(table["lang"].combine_chunks(), table["text"].combine_chunks())


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in a filter of each phrase."""
    for batch in batches:
        keys = np.zeros(batch.num_rows, np.uint64)
        for i, (lang, phrase) in enumerate(zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True)):
            key = np.array([_seed(lang)], np.uint64)
            for w in phrase.split(" "):
                key = _longer(key, np.array([xxhash.xxh64_intdigest(f"{w} ".encode())], np.uint64))
            keys[i] = key[0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(p) for p in _places(keys)]], ["key", *[f"p{i}" for i in range(PROBES)]])


def _placed(phrases: DataFrame) -> DataFrame:
    return phrases.select("lang", "phrase").mapInArrow(_keys, "key long, " + ", ".join(f"p{i} long" for i in range(PROBES)))


def _bits(phrases: DataFrame) -> np.ndarray:
    """The filter of these phrases: set bits are gathered by Spark as 64-bit words, at most ``BITS`` / 64 of them."""
    each = _placed(phrases).select(F.explode(F.array(*[f"p{i}" for i in range(PROBES)])).alias("p"))
    words = each.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS INT))")).alias("word")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return out


def _missed(phrases: DataFrame, bits) -> DataFrame:
    """Phrases that a filter does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(bits.value)
        for batch in _keys(batches):
            yield pa.RecordBatch.from_arrays([batch["key"].filter(pa.array(~held.has(batch["key"].to_numpy().view(np.uint64))))], ["key"])

    return phrases.select("lang", "phrase").mapInArrow(run, "key long")


def count_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, sample: Column | None = None, block_bytes: int = BLOCK_BYTES, proposed_at: int = PROPOSED) -> DataFrame:
    """(lang, phrase, n, count) of all phrases of up to ``longest`` words that occur ``support`` times, and the words of each language where phrase is null.

    ``docs`` is (lang, text); null langs are ``und``, null texts empty. ``sample`` says which documents propose (default: one of ``RATE`` by a hash);
    it decides how much is counted when, not what is found: the full pass counts each phrase whose parts are proposed, so also the border of the
    proposals, and if one of these turns out frequent that was not proposed, a further pass counts what may be frequent because of it. That pass goes on
    along phrases that nothing is known of, so nothing is left open after it.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("lang", "text") if sample is None else docs.select("lang", "text", sample.alias("in_sample__"))
    picked = docs.where(F.pmod(F.xxhash64("lang", "text"), F.lit(RATE)) == 0 if sample is None else F.col("in_sample__")).select("lang", "text")
    docs = docs.select("lang", "text")

    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def counts(of: DataFrame, proposed, frequent, proposing=None) -> DataFrame:
        """What a pass counts ``support`` times, or as often as is proposed; phrases travel packed, as there are about as many as words."""
        packed = of.mapInArrow(_counter(proposed, frequent, longest, block_bytes, proposing, buckets), _PACKED)
        return packed.repartition(buckets, "bucket").drop("bucket").mapInArrow(_merger(proposing or support), _ROWS).withColumn("phrase", F.nullif("phrase", F.lit("")))

    real = F.col("phrase").isNotNull()
    proposed = sc.broadcast(_bits(counts(picked, None, None, proposed_at).where(real)))
    found = stored(counts(docs, proposed, None), "phrases")
    open_ = found.where(real & (F.col("n") < longest))
    if _missed(open_, proposed).isEmpty():
        return found
    more = counts(docs, proposed, sc.broadcast(_bits(found.where(real))))
    return stored(found.unionByName(more), "phrases")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, best: int = BEST, sample: Column | None = None, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of two words and more that hold together best, ``best`` of each language.

    A phrase of a occurrences, cut into parts of l and r, scores floor(2000000 a / (l + r)) at its worst cut. Phrases inside a longer candidate that
    has 80 % of their occurrences are left out. All parts of a candidate are frequent, so their counts are at hand. Products are decimals.
    Empty texts have no words, a language without candidates no rows; texts are counted whole, in blocks of some MB or one longer text.
    """
    counted = count_phrases(docs, support, longest, sample, **how)
    totals = counted.where("phrase IS NULL").select("lang", F.col("count").alias("n"))
    known = counted.where("phrase IS NOT NULL").select("lang", "phrase", F.split("phrase", " ").alias("ws"), F.col("count").alias("a"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    candidates = known.where(F.size("ws") > 1)
    cuts = candidates.select("lang", "phrase", "ws", "a", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws")), " ").alias("rest"))
    part = lambda name, as_: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(as_))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr(f"({SCALE}BD * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + r)"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    inner = candidates.where(F.size("ws") > 2).select("lang", "a", "ws", F.explode(F.sequence(F.lit(2), F.size("ws") - 1)).alias("m"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("m") + 1), lambda i: F.array_join(F.slice("ws", i, F.col("m")), " "))).alias("phrase"))
    over = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(over, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < SWALLOWED * wide("a")))
    rows = kept.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("w.score").alias("score"))
    # Two steps, so that no task sees all candidates of a language: lots grow as the root of their number.
    lots = math.isqrt(counted.count() // best) + 1
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    of_lot = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(lots))).orderBy(*order)
    first = rows.withColumn("rank", F.row_number().over(of_lot)).where(F.col("rank") <= best)
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best).join(totals, "lang")
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
