"""Lexical search: posting lists as tables, and BM25 over batches of queries with what cannot matter left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

K1, B = 1.2, 0.75
#: Scores are compared after rounding, so that the order of a sum cannot move a rank.
DIGITS = 6
#: Rows of a query side that may be broadcast, after they are counted; more are joined by a shuffle.
ROWS_SENT = 1 << 18
#: Entries of a share: a task scores one share, with one number for each of its entries.
SHARE, LEAST_SHARE = 1 << 16, 1 << 11
#: Queries that a task answers at once.
QUERY_BLOCK = 4096
#: Entries of a block, for which each list has its greatest impact.
IMPACT_BLOCK = 16
#: A floor is sought once the best entries so far have a share of what is left, and again when that has shrunk so far.
WORTH, AGAIN = 2.0, 0.6
#: From so many queries of a task on, all their pairs are scored, many queries at a time: that takes less than finding out what to leave out.
MANY = 256
#: Numbers (queries times entries) that are scored at a time; lists longer than a part of a share's entries are laid out in full, so many of them at most.
SCORED_CELLS, FULL_PART, FULL_LISTS = 1 << 22, 16, 128
#: Queries whose best entries of all shares are brought together at once.
MERGED = 64
#: Distinct tokens whose names go to the scan as a filter.
PUSHED = 512

LISTS = "seq long, is_title boolean, share int, token string, idx array<int>, tf array<int>, dl array<int>"


@dataclass(frozen=True)
class Index:
    """What a search reads.

    ``chunks``: live entries (seq, is_title, share, idx, chunk_id, file_path, title, chunk_index, tokens, dl), titles too. ``lists`` gives posting lists
    (``LISTS``): a row for a token and share, entries by their number; called with tokens it may leave out files without them. ``terms``:
    (token, df, cf). ``holed`` are the segments (seq) whose lists name entries that are gone.
    """

    spark: SparkSession
    chunks: DataFrame
    lists: Callable[[list[str] | None], DataFrame]
    terms: DataFrame
    n: int
    total: int
    holed: tuple[int, ...] = ()

    @property
    def avgdl(self) -> float:
        return self.total / self.n if self.n else 0.0

    @property
    def stats(self) -> DataFrame:
        """One row: entries (titles too) and their mean length."""
        return self.spark.createDataFrame([(self.n, self.avgdl)], "n long, avgdl double")

    @property
    def postings(self) -> DataFrame:
        """(token, chunk_id, file_path, is_title, dl, tf): a row for each token of a live entry."""
        each = self.lists(None).select("seq", "is_title", "share", "token", F.explode(F.arrays_zip("idx", "tf", "dl")).alias("p"))
        at = ["seq", "is_title", "share", "idx"]
        flat = each.select("seq", "is_title", "share", F.col("p.idx").alias("idx"), "token", F.col("p.tf").cast("long").alias("tf"), F.col("p.dl").alias("dl"))
        return flat.join(self.chunks.select(*at, "chunk_id", "file_path"), at).select("token", "chunk_id", "file_path", "is_title", "dl", "tf")


def postings(entries: DataFrame) -> DataFrame:
    """(token, chunk_id, tf)."""
    return entries.select("chunk_id", F.explode("tokens").alias("token")).groupBy("token", "chunk_id").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def statistics(entries: DataFrame) -> DataFrame:
    """One row: entries (titles too) and their mean length, 0 if there are none."""
    return entries.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def shares_of(n: int, tasks: int) -> int:
    """Shares for so many entries: none larger than ``SHARE`` on average, and one for each task while they are not tiny."""
    return max(1, -(-n // SHARE), min(tasks, n // LEAST_SHARE))


def numbered(entries: DataFrame, shares: int, seq: int = 0) -> DataFrame:
    """Entries with seq, share (by a hash of the id) and idx: their place by chunk_id among those of their share."""
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(shares)).cast("int")
    place = F.row_number().over(Window.partitionBy("is_title", "share").orderBy("chunk_id")) - 1
    return entries.withColumns({"seq": F.lit(seq).cast("long"), "share": share}).withColumn("idx", place)


def _invert(table: pa.Table) -> pa.Table:
    """Posting lists of one share's entries."""
    tokens = table["tokens"].combine_chunks()
    tokens = pa.concat_arrays(tokens.chunks) if isinstance(tokens, pa.ChunkedArray) else tokens
    lens = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    idx, dl = table["idx"].to_numpy(), table["dl"].to_numpy()
    owner = np.repeat(np.arange(table.num_rows), lens)
    order = np.lexsort((idx[owner], coded.indices.to_numpy()))
    code, own = coded.indices.to_numpy()[order], owner[order]
    fresh = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (own[1:] != own[:-1])])) if len(code) else np.zeros(0, np.int64)
    tf = np.diff(np.append(fresh, len(code)))
    code, own = code[fresh], own[fresh]
    cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    ends = pa.array(np.append(cuts, len(code)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (idx[own], tf, dl[own])]
    same = [pa.array([table[c][0].as_py()] * len(cuts), t) for c, t in (("seq", pa.int64()), ("is_title", pa.bool_()), ("share", pa.int32()))]
    names = [f.split()[0] for f in LISTS.split(", ")]
    return pa.Table.from_arrays([*same, coded.dictionary.take(pa.array(code[cuts])).cast(pa.string()), *lists], names)


def posting_lists(held: DataFrame) -> DataFrame:
    """``LISTS`` of numbered entries: one shuffle by share, inverted inside tasks."""
    return held.select("seq", "is_title", "share", "idx", "dl", "tokens").groupBy("seq", "is_title", "share").applyInArrow(_invert, LISTS)


def term_counts(lists: DataFrame) -> DataFrame:
    """(token, df, cf): entries that hold a token and its occurrences."""
    total = F.aggregate("tf", F.lit(0).cast("long"), lambda s, x: s + x)
    return lists.groupBy("token").agg(F.sum(F.size("idx").cast("long")).alias("df"), F.sum(total).alias("cf"))


def from_entries(entries: DataFrame) -> Index:
    """An index that is not stored: each search computes what it reads."""
    n, total = entries.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    held = numbered(entries, shares_of(n, 1))
    lists = posting_lists(held)
    return Index(entries.sparkSession, held, lambda tokens: lists, term_counts(lists), n, total)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf): a repeated term counts as often as it is said."""
    return queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def few(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, to be broadcast if the counted ``n`` is small."""
    return F.broadcast(rows) if n <= ROWS_SENT else rows


def one_of(column: str, values: list[str]) -> Column:
    """Any of the values, as a chain that reaches the scan whatever its length."""
    parts = [F.col(column) == v for v in values]
    while len(parts) > 1:
        parts = [reduce(lambda x, y: x | y, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(False)


class _Share:
    """The posting lists of one share that a block of queries meets, and their best entries."""

    def __init__(self, table: pa.Table, holed: set | None, avgdl: float) -> None:
        self.seq = table["seq"][0].as_py()
        named = table.filter(pc.is_valid(table["token"]))
        flat = lambda c: (lambda a: pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a)(named[c].combine_chunks())
        idx, tf, dl = flat("idx"), flat("tf"), flat("dl")
        at = np.append(0, np.cumsum(idx.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
        i, t, d = idx.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.float64), dl.flatten().to_numpy()
        part = t * (K1 + 1) / (t + K1 * (1 - B + B * d / avgdl)) if len(t) else t
        self.size = int(i.max()) + 1 if len(i) else 0
        if holed is None or self.seq in holed:  # only what is named may be found
            may = table.filter(pc.is_null(table["token"]))["idx"].combine_chunks()
            may = may.flatten().to_numpy() if may.null_count == 0 and len(may) else np.zeros(0, np.int32)
            live = np.zeros(self.size, bool)
            live[may[may < self.size]] = True
            keep = live[i]
            i, part, at = i[keep], part[keep], np.append(0, np.cumsum(keep))[at]
        self.idx, self.part, self.at = i, part, at
        asked = flat("qs")
        self.row = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy(zero_copy_only=False))
        coded = asked.flatten().field("query_id").dictionary_encode()
        self.queries, self.query, self.weight = coded.dictionary, coded.indices.to_numpy(), asked.flatten().field("w").to_numpy()
        self.blocks: list[np.ndarray | None] = [None] * (len(at) - 1)
        self.block = np.arange(self.size) // IMPACT_BLOCK
        self.scored = self.met = 0

    @cached_property
    def lists(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.idx[a:b], self.part[a:b]) for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]

    @cached_property
    def most(self) -> np.ndarray:
        return np.array([p.max() if len(p) else 0.0 for _, p in self.lists])

    def answers(self, limit: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, entry, score), the rows of a query together."""
        if limit is not None and self.size > limit and len(self.queries) >= MANY:
            yield from self._many(limit)
            return
        order = np.argsort(self.query, kind="stable")
        acc = np.zeros(self.size)
        for own in np.split(order, np.flatnonzero(np.diff(self.query[order])) + 1) if len(order) else []:
            self.met += sum(len(self.lists[r][0]) for r in self.row[own].tolist())
            hit, score = self._best(self.row[own], self.weight[own], limit, acc)
            if len(hit):
                yield np.full(len(hit), self.query[own[0]]), hit, score

    def _many(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The ``limit`` best entries of each query, for many queries at a time.

        Long lists are laid out in full, and what they add is a matrix product; those of the others are added up by place. Of every few entries the best one
        is known; the least of the ``limit`` best of these is a floor, so that few entries are sorted.
        """
        order = np.argsort(self.query, kind="stable")
        query, row, weight = self.query[order], self.row[order], self.weight[order]
        start, lens, idx, part = self.at[:-1], np.diff(self.at), self.idx.astype(np.int64), self.part
        fold = next(f for f in (16, 8, 4, 2, 1) if f == 1 or self.size >= 2 * f * limit)
        width = -(-self.size // fold) * fold
        full = np.argsort(-lens, kind="stable")[:FULL_LISTS]
        full = full[lens[full] * FULL_PART > self.size]
        laid = np.zeros((len(full), width))
        for k, r in enumerate(full.tolist()):
            own = slice(start[r], start[r] + lens[r])
            laid[k, idx[own]] = part[own]
        place = np.full(len(lens), -1)
        place[full] = np.arange(len(full))
        step = max(1, SCORED_CELLS // width)
        for first in range(0, len(self.queries), step):
            n = min(step, len(self.queries) - first)
            a, b = np.searchsorted(query, [first, first + n])
            q, r, w = query[a:b] - first, row[a:b], weight[a:b]
            long = place[r] >= 0
            weights = np.zeros((n, len(full)))
            weights[q[long], place[r[long]]] = w[long]
            acc = weights @ laid
            q, r, w = q[~long], r[~long], w[~long]
            size = lens[r]
            at = np.arange(size.sum()) + np.repeat(start[r] - (np.cumsum(size) - size), size)
            acc += np.bincount(idx[at] + np.repeat(q * width, size), part[at] * np.repeat(w, size), n * width).reshape(n, width)
            self.met += int(lens[row[a:b]].sum())
            best = acc.reshape(n, fold, -1).max(axis=1)
            floor = np.partition(best, best.shape[1] - limit, axis=1)[:, best.shape[1] - limit]
            floor = np.maximum(floor - 10.0**-DIGITS * 2, 0.0)  # scores that round alike are ties
            found = np.flatnonzero((acc >= floor[:, None]) & (acc > 0))
            who, hit = np.divmod(found, width)
            score = np.round(acc.reshape(-1)[found], DIGITS)
            order = np.lexsort((hit, -score, who))
            who, hit, score = who[order], hit[order], score[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            kept = rank < limit
            yield who[kept] + first, hit[kept], score[kept]
        self.scored = self.met

    def _bounds(self, r: int) -> np.ndarray:
        """The most that a list adds in each block of ``IMPACT_BLOCK`` entries."""
        if self.blocks[r] is None:
            idx, part = self.lists[r]
            out = np.zeros(-(-self.size // IMPACT_BLOCK))
            if len(idx):
                block = idx // IMPACT_BLOCK
                first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                out[block[first]] = np.maximum.reduceat(part, first)
            self.blocks[r] = out
        return self.blocks[r]

    def _best(self, rows: np.ndarray, weights: np.ndarray, limit: int | None, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms go by the most that each can add.

        From time to time the ``limit`` best entries so far are scored in full; the least of these scores is a proven floor. An entry that cannot reach it with all that
        the terms to come add at most in its block is passed over from then on, met before or not.
        """
        most = weights * self.most[rows]
        order = np.argsort(-most, kind="stable")
        left = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)
        acc[:] = 0.0
        if limit is None or self.size <= limit:
            for r, w in zip(rows.tolist(), weights.tolist(), strict=True):
                idx, part = self.lists[r]
                acc[idx] += w * part
                self.scored += len(idx)
            hit = np.flatnonzero(acc > 0)
            return hit, np.round(acc[hit], DIGITS)
        slack = 10.0**-DIGITS * 2  # scores that round alike are ties
        rest = sum(w * self._bounds(r) for r, w in zip(rows.tolist(), weights.tolist(), strict=True))
        live, done, block = None, np.zeros(self.size, bool), self.block
        tried = np.inf
        for k, j in enumerate(order.tolist()):
            idx, part = self.lists[rows[j]]
            if live is not None:
                here = live[idx]
                idx, part = idx[here], part[here]
            acc[idx] += weights[j] * part
            self.scored += len(idx)
            rest = rest - weights[j] * self._bounds(rows[j])
            if left[k + 1] <= 0 or left[k + 1] > tried:
                continue
            least = np.partition(acc, self.size - limit)[self.size - limit]
            if least < left[k + 1] / WORTH:
                continue
            tried = left[k + 1] * AGAIN
            best = np.argpartition(-acc, limit - 1)[:limit]
            fresh = np.sort(best[~done[best]])
            for i in order[k + 1 :].tolist():
                idx, part = self.lists[rows[i]]
                at = np.minimum(np.searchsorted(idx, fresh), max(len(idx) - 1, 0))
                here = idx[at] == fresh if len(idx) else np.zeros(len(fresh), bool)
                acc[fresh[here]] += weights[i] * part[at[here]]
                self.scored += int(here.sum())
            done[fresh] = True
            floor = np.partition(acc[done], int(done.sum()) - limit)[int(done.sum()) - limit]
            live = acc + rest[block] >= floor - slack
            live &= ~done
            if not live.any():
                break
        may = acc > 0 if live is None else (live | done) & (acc > 0)
        hit = np.flatnonzero(may)
        score = np.round(acc[hit], DIGITS)
        if len(hit) > limit:
            best = np.lexsort((hit, -score))[:limit]
            hit, score = hit[best], score[best]
        return hit, score


def _answer(limit: int | None, holed: set | None, avgdl: float, q_type: pa.DataType, work):
    """A row for each query that finds something in a share: places and scores of its entries."""

    def run(table: pa.Table) -> pa.Table:
        share = _Share(table, holed, avgdl)
        found = list(share.answers(limit))
        if work is not None:
            work[0].add(share.scored)
            work[1].add(share.met)
        query, idx, value = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        first = np.flatnonzero(np.diff(query, prepend=-1))
        ends, n = pa.array(np.append(first, len(query)).astype(np.int32)), len(first)
        return pa.table({
            "query_id": share.queries.take(pa.array(query[first])).cast(q_type),
            "seq": pa.array(np.full(n, share.seq)), "is_title": pa.array(np.full(n, table["is_title"][0].as_py())), "share": pa.array(np.full(n, table["share"][0].as_py(), np.int32)),
            "idx": pa.ListArray.from_arrays(ends, pa.array(idx.astype(np.int32))), "score": pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float64))),
        })

    return run


def _merge(limit: int):
    """Of what a query finds in all shares, all that no ``limit`` entries are better than, a row for each."""

    def run(table: pa.Table) -> pa.Table:
        idx, value = (pa.concat_arrays(table[c].chunks) for c in ("idx", "score"))
        row = np.repeat(np.arange(table.num_rows), idx.value_lengths().to_numpy(zero_copy_only=False))
        query = table["query_id"].combine_chunks()
        query = (pa.concat_arrays(query.chunks) if isinstance(query, pa.ChunkedArray) else query).dictionary_encode().indices.to_numpy()[row]
        score = value.flatten().to_numpy()
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        first = np.searchsorted(query, query)
        last = np.minimum(first + limit, np.searchsorted(query, query, "right")) - 1
        kept = score >= score[last]
        out = table.select(["query_id", "seq", "is_title", "share"]).take(pa.array(row[order][kept]))
        return out.append_column("idx", idx.flatten().take(pa.array(order[kept]))).append_column("score", pa.array(score[kept]))

    return run


def score(index: Index | DataFrame, queries: DataFrame, keep: Column | None = None, limit: int | None = None, titles: bool | None = None, work=None) -> DataFrame:
    """(query_id, chunk_id, file_path, is_title, score): BM25 of entries that hold a query term: all, or the ``limit`` best of each query, ties to the smaller chunk_id.

    ``index`` may also be the entries themselves. Posting lists of the queries' tokens meet in a task per share and block of queries, where
    entries that cannot be among a query's best are passed over (``_Share``); what leaves a task is at most ``limit`` rows a query. ``keep``, over the columns
    of ``chunks``, filters the scored entries only; counts and lengths are those of the whole index. ``titles`` picks one kind of entries (default: both, of which
    each has a limit of its own). ``work``: two accumulators, for (query, posting) pairs that were scored and that a full search would score.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    index = index if isinstance(index, Index) else from_entries(index)
    of_kind = (lambda df: df) if titles is None else (lambda df: df.where(F.col("is_title") == titles))
    terms = query_terms(queries)
    asked = terms.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries"), F.count_distinct("token").alias("tokens")).first()
    tokens = [r["token"] for r in terms.select("token").distinct().collect()] if asked["tokens"] <= PUSHED else None
    idf = F.log((F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    known = index.terms if tokens is None else index.terms.where(one_of("token", tokens))
    weighted = known.join(few(terms, asked["n"]), "token").select("query_id", "token", (F.col("qtf") * idf).alias("w"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(-(-max(1, asked["queries"]) // QUERY_BLOCK))).cast("int")
    sides = weighted.groupBy("token", block.alias("qb")).agg(F.collect_list(F.struct("query_id", "w")).alias("qs"))
    rows = of_kind(index.lists(tokens)).join(few(sides, asked["n"]), "token")
    holed = set(index.holed) if keep is None else None
    if holed is None or holed:
        may = index.chunks.where(keep) if keep is not None else index.chunks.where(F.col("seq").isin(list(index.holed)))
        may = of_kind(may).groupBy("seq", "is_title", "share").agg(F.collect_list("idx").alias("idx"))
        rows = rows.unionByName(may.join(F.broadcast(sides.select("qb").distinct())), allowMissingColumns=True)
    q_type = queries.schema["query_id"].dataType
    at = f"query_id {q_type.simpleString()}, seq long, is_title boolean, share int"
    found = rows.groupBy("seq", "is_title", "share", "qb").applyInArrow(_answer(limit, holed, index.avgdl, to_arrow_type(q_type), work), f"{at}, idx array<int>, score array<double>")
    most = None
    if limit is None:
        found = found.select("query_id", "seq", "is_title", "share", F.inline(F.arrays_zip("idx", "score")))
    else:
        some = F.pmod(F.xxhash64("query_id"), F.lit(-(-max(1, asked["queries"]) // MERGED))).cast("int")
        found = found.groupBy("is_title", some.alias("block")).applyInArrow(_merge(limit), f"{at}, idx int, score double")
        most = asked["queries"] * limit * (2 if titles is None else 1) * 2
    ids = of_kind(index.chunks).select("seq", "is_title", "share", "idx", "chunk_id", "file_path")
    named = ids.join(found if most is None else few(found, most), ["seq", "is_title", "share", "idx"])
    if limit is not None:
        named = named.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "is_title").orderBy(F.desc("score"), "chunk_id"))).where(F.col("place") <= limit)
    return named.select("query_id", "chunk_id", "file_path", "is_title", "score")
