"""Fuzzy line deduplication by MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, packed, quoted, stored, without
from .linking import components, link
from .words import _BASE, _BYTE, _INVERSE, _power, mix, similar

#: Characters in a shingle; shorter lines are one shingle.
CHARS = 10
BANDS, ROWS = 7, 3
SIMILAR = 0.8
#: Characters hashed at once: a longer line goes in pieces that overlap by a shingle.
STEP = 1 << 16
#: Bytes of lines hashed at once, so that the arrays stay in a core's cache.
RUN = 1 << 15
#: Rows of a tile, and its characters: the rest of a large bucket meets so many of its lines at once.
TILE, TILE_CHARS = 256, 1 << 22
#: Columns of an incidence matrix that are held at once; steps of a matrix product that take as long as one pair.
COLUMNS, PAIR = 1 << 12, 1 << 17
#: Text characters whose lines are sketched or compared together.
LOT = 1 << 22

_KEYS = [f"k{b}" for b in range(BANDS)]
_MULTIPLY = (np.random.default_rng(11).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def _lower(lines: list[str]) -> list[bytes]:
    return [line.lower().encode() for line in lines]


def _pieces(lines: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The lower-cased lines, long ones cut into overlapping pieces, and where each line's pieces start."""
    if max(map(len, lines), default=0) <= STEP:
        return lines, np.arange(len(lines))
    out, starts = [], []
    for line in lines:
        starts.append(len(out))
        if len(line) <= STEP:
            out.append(line)
        else:
            low = line.decode()
            out += [low[i : i + STEP + CHARS - 1].encode() for i in range(0, max(1, len(low) - CHARS + 1), STEP)]
    return out, np.array(starts)


def _shingles(pieces: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first piece, hashes, start and end of each piece's shingles among them) for runs of pieces; a short piece is one shingle.

    A hash is taken at every character; those behind a piece's end are nobody's. The last one is a filler, so that an end is a place.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    i = 0
    while i < len(pieces):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + RUN, "right")))
        data = np.frombuffer(b"".join(pieces[i:j]), np.uint8)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=total[1:])
        chars = np.append(np.flatnonzero(data.view(np.int8) >= -64), len(data))
        edge = np.searchsorted(chars, np.concatenate([[0], ends[i:j] - before]))
        units = np.diff(edge)
        # Shingles end CHARS characters on, but for pieces that are shorter.
        until = np.append(chars[CHARS:], np.full(min(CHARS, len(chars)), len(data)))
        short = np.flatnonzero(units < CHARS)
        until[edge[short]] = chars[edge[short + 1]]
        sums = (total[until] - total[chars]) * _power("down", _INVERSE, len(data) + 1)[chars] + (until - chars).view(np.uint64)
        yield i, mix(sums), np.stack([edge[:-1], edge[:-1] + np.maximum(1, units - CHARS + 1)], axis=1)
        i = j


def band_keys(lines: list[str]) -> np.ndarray:
    """A key per band for each line: a hash of the band and the least of its shingles' hashes under each of the band's permutations."""
    return _band_keys(_lower(lines))


def _band_keys(lines: list[bytes]) -> np.ndarray:
    pieces, starts = _pieces(lines)
    least = np.empty((len(pieces), BANDS * ROWS), np.uint32)
    for i, h, at in _shingles(pieces):
        halves = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
        for v, m in enumerate(_MULTIPLY):
            least[i : i + len(at), v] = np.minimum.reduceat(halves[v % 2] * m, at.reshape(-1))[::2]
    values = np.minimum.reduceat(least, starts).reshape(-1, BANDS, ROWS) if len(lines) else least.reshape(0, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2])
    for r in range(ROWS):
        keys = mix(keys * _BASE + values[:, :, r])
    return keys.view(np.int64)


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted set of whole-line shingle hashes of each line."""
    pieces, starts = _pieces(_lower(lines))
    found: list[np.ndarray] = []
    for _, h, at in _shingles(pieces):
        found += (h[a:b].copy() for a, b in at.tolist())
    edges, out = [*starts.tolist(), len(pieces)], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        one = found[a] if b == a + 1 else np.concatenate(found[a:b])
        one.sort()
        out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
    return out


def _lots(*texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts reach ``LOT`` characters with their last row; only so many are Python strings at once."""
    ends = np.cumsum(sum(pc.fill_null(pc.utf8_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
    i = 0
    while i < len(ends):
        j = min(int(np.searchsorted(ends, (int(ends[i - 1]) if i else 0) + LOT)) + 1, len(ends))
        yield i, j
        i = j


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each text that are not blank: their number, digest and band keys."""
    for batch in batches:
        for first, end in _lots(batch["text"]):
            part = batch.slice(first, end - first)
            row, no, digests, lines = [], [], [], []
            size = 0
            for i, text in enumerate(part["text"].to_pylist()):
                # A line feed ends the context of every letter, so the whole text is lower-cased and encoded at once.
                whole = zip((text or "").split("\n"), (text or "").encode().split(b"\n"), (text or "").lower().encode().split(b"\n"), strict=True)
                for j, (line, data, low) in enumerate(whole):
                    if line and not line.isspace():
                        row.append(i)
                        no.append(j)
                        digests.append(md5(data).digest())
                        lines.append(low)
                        size += len(line)
                        if size >= LOT:
                            yield _occurrence(part, row, no, digests, lines)
                            row, no, digests, lines, size = [], [], [], [], 0
            if lines:
                yield _occurrence(part, row, no, digests, lines)


def _occurrence(batch: pa.RecordBatch, row: list[int], no: list[int], same: list[bytes], lines: list[bytes]) -> pa.RecordBatch:
    at = pa.array(row, pa.int32())
    keys = [pa.array(k) for k in np.ascontiguousarray(_band_keys(lines).T)]
    return pa.RecordBatch.from_arrays([batch["dk"].take(at), batch["th"].take(at), pa.array(no, pa.int32()), pa.array(same, pa.binary()), *keys], ["dk", "th", "no", "same", *_KEYS])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole shingle sets are similar; each line of a lot is cut into shingles once."""
    for batch in batches:
        for first, end in _lots(batch["la"], batch["lb"]):
            a, b, la, lb = (batch[c].slice(first, end - first).to_pylist() for c in ("a", "b", "la", "lb"))
            held = dict(zip(a, la, strict=True)) | dict(zip(b, lb, strict=True))
            sets = dict(zip(held, shingle_sets(list(held.values())), strict=True))
            near = [i for i in range(len(a)) if similar(sets[a[i]], sets[b[i]], SIMILAR)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in near], pa.int64()) for x in (a, b)], ["a", "b"])


def _alike(sx: list[np.ndarray], sy: list[np.ndarray], asked: np.ndarray) -> np.ndarray:
    """Which asked pairs of sets are similar: one by one if they are few, else by the product of the sets' incidence matrices, some columns at a time."""
    nx, ny = (np.fromiter(map(len, s), np.int64, len(s)) for s in (sx, sy))
    least, most = np.minimum.outer(nx, ny), np.maximum.outer(nx, ny)
    asked = asked & (least >= SIMILAR * most - 1e-9)
    x, y = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(asked.any(axis=0))
    out = np.zeros(asked.shape, bool)
    if not len(x):
        return out
    hx, hy = (np.concatenate([s[i] for i in at]) for s, at in ((sx, x), (sy, y)))
    common = np.intersect1d(hx, hy)
    if np.count_nonzero(asked) * PAIR < len(x) * len(y) * len(common):
        for i, j in np.argwhere(asked).tolist():
            out[i, j] = similar(sx[i], sy[j], SIMILAR)
        return out
    both = np.zeros((len(x), len(y)), np.int64)
    if len(common):
        sides = []
        for h, n in ((hx, nx[x]), (hy, ny[y])):
            column = np.minimum(np.searchsorted(common, h), len(common) - 1)
            kept = np.flatnonzero(common[column] == h)
            kept = kept[np.argsort(column[kept], kind="stable")]
            sides.append((np.repeat(np.arange(len(n)), n)[kept], column[kept], len(n)))
        for c in range(0, len(common), COLUMNS):
            parts = []
            for row, column, n in sides:
                a, b = np.searchsorted(column, [c, c + COLUMNS])
                part = np.zeros((n, min(COLUMNS, len(common) - c)), np.float32)
                part[row[a:b], column[a:b] - c] = 1
                parts.append(part)
            both += (parts[0] @ parts[1].T).astype(np.int64)
    at = np.ix_(x, y)
    out[at] = asked[at] & (both >= SIMILAR * (np.add.outer(nx[x], ny[y]) - both) - 1e-9)
    return out


def _tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two lots of a bucket's lines, as few as join what they join; a pair is looked at in the first band that it shares."""
    found: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        sx, sy = (shingle_sets(t["line"].to_pylist()) for t in (left, right))
        kx, ky = (np.array(t["keys"].to_pylist(), np.int64) for t in (left, right))
        cx, cy = (t["comp"].to_numpy() for t in (left, right))
        nx, ny, head = left["nid"].to_pylist(), right["nid"].to_pylist(), {}
        band = int(np.flatnonzero(kx[0] == key[0].as_py())[0])

        def root(i: int) -> int:
            while (up := head.setdefault(i, i)) != i:
                head[i] = head.get(up, up)
                i = up
            return i

        for n, c in zip(nx + ny, cx.tolist() + cy.tolist(), strict=True):
            head[n] = head.setdefault(-1 - c, n)
        earlier = np.zeros((len(nx), len(ny)), bool)
        for k in range(band):
            earlier |= np.equal.outer(kx[:, k], ky[:, k])
        for i, j in np.argwhere(_alike(sx, sy, ~earlier & np.not_equal.outer(cx, cy))).tolist():
            if root(nx[i]) != root(ny[j]):
                head[root(nx[i])] = root(ny[j])
                found.append((min(nx[i], ny[j]), max(nx[i], ny[j])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _hashed(small: DataFrame) -> DataFrame:
    """The side of a join that tasks hold in a hash table, so that the other is not sorted; its partitions are a fraction of the other's."""
    return small.hint("shuffle_hash")


def _checker(rows: DataFrame, nodes: DataFrame):
    def prepare(multi: DataFrame):
        met = stored(nodes.join(_hashed(multi.select("nid").distinct()), "nid", "left_semi").select("nid", "keys", "dk", "th", "no"), "asked-nodes")
        asked = stored(met.groupBy("dk", "th").agg(F.collect_list(F.struct("nid", "no")).alias("wanted")), "asked-lines")
        wanted = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("wanted", lambda w: F.struct(w["nid"].alias("nid"), F.get(lines, w["no"]).alias("line"))))[0]
        # Rows that repeat id and text give a line once each.
        texts = stored(rows.select("dk", "th", "text").join(_hashed(asked), ["dk", "th"]).select(F.inline(wanted)).dropDuplicates(["nid"]), "line-texts")

        def check(pairs: DataFrame) -> DataFrame:
            la, lb = (texts.select(F.col("nid").alias(s), F.col("line").alias(f"l{s}")) for s in "ab")
            return pairs.join(la, "a").join(lb, "b").select("a", "b", "la", "lb").mapInArrow(_verify, "a long, b long")

        def rest(away: DataFrame, tagged: DataFrame) -> DataFrame:
            held = stored(met.select("nid", "keys").join(texts, "nid"), "rest-lines")
            sized = lambda t, name: t.join(held.select("nid", F.length("line").alias("chars")), "nid").groupBy("key").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("chars") / TILE_CHARS)).cast("int").alias(name))
            lots = stored(sized(tagged, "lots_b").join(sized(away, "lots_a"), "key"), "lots")
            lot = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            a = away.join(lots, "key").select("key", "nid", "comp", lot("lots_a").alias("lot_a"), every("lots_b").alias("lot_b")).join(held, "nid")
            b = tagged.join(lots, "key").select("key", "nid", "comp", lot("lots_b").alias("lot_b"), every("lots_a").alias("lot_a")).join(held, "nid")
            # Both sides come from the same tables; new names for the columns of one keep them apart.
            a, b = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (a, b))
            tile = ["key", "lot_a", "lot_b"]
            return a.groupBy(*tile).cogroup(b.groupBy(*tile)).applyInArrow(_tile, "a long, b long")

        return check, rest

    return prepare


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one line of each group of near-equal lines over the whole corpus.

    Lines are what stands between line feeds; those of white space alone stay. Equal lines are
    one node. Nodes get MinHash values over their lower-cased ``CHARS``-character shingles;
    lines that share one of ``BANDS`` bands are candidates, and a Jaccard
    similarity of ``SIMILAR`` or more, computed on the whole shingle sets, links them.
    In each component the occurrence with the smallest id (null last), then the earliest place,
    stays. Of rows that repeat id and text the first one met keeps such lines and the others lose them. A null text stays null,
    a text without lines left becomes empty, a line of any length is hashed whole in pieces; no rows give no rows.

    The texts themselves are shuffled twice, by their rows' keys: once to fetch candidate lines, once
    for the result; lines travel as digests and keys.

    Returns the columns of ``docs`` with the text cleaned (same-named ones are replaced), n_lines and n_dropped.
    """
    kept = without(docs, "n_lines", "n_dropped")
    doc_id, doc_text = quoted(id_col)[0], quoted(text_col)[0]
    rows = docs.select(
        packed(docs, "n_lines", "n_dropped", text_col).alias("row"), doc_id.alias("id"), doc_text.alias("text"),
        F.xxhash64(doc_id, doc_text).alias("dk"), F.xxhash64(F.lit("again"), doc_id, doc_text).alias("th"),
    )
    seen = rows.select("dk", "th", "text").mapInArrow(_occurrences, f"dk long, th long, no int, same binary, {', '.join(f'{k} long' for k in _KEYS)}")
    # Equal lines have equal keys. Numbers only, so that tasks add up in a hash table; the three firsts are one occurrence's.
    met = seen.groupBy("same").agg(*[F.min(k).alias(k) for k in _KEYS], *[F.first(c).alias(c) for c in ("dk", "th", "no")], F.count("*").alias("n"))
    nodes = stored(met.select("same", F.array(*_KEYS).alias("keys"), "dk", "th", "no", "n", F.monotonically_increasing_id().alias("nid")), "line-nodes")
    bands = nodes.select(F.explode("keys").alias("key"), "nid", F.col("n").alias("w"))
    comp = components(link(bands, _checker(rows, nodes)))
    # A line that occurs once and has no link is nobody's copy.
    linked = nodes.select("same", "nid", "n").join(_hashed(comp), "nid", "left").where("n > 1 or comp is not null")
    shared = stored(linked.select("same", F.coalesce("comp", "nid").alias("comp")), "shared-lines")
    forget(nodes, comp)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "dk", "th", "no")
    placed = rows.select("id", "dk", "th", F.posexplode(F.split("text", "\n")).alias("no", "line")).select(place.alias("place"), F.unhex(F.md5("line")).alias("same"))
    copies = stored(placed.join(_hashed(shared), "same").select("comp", "place"), "line-copies")
    stays = stored(copies.groupBy("comp").agg(F.min("place").alias("stays")), "line-heads")
    no = F.col("place.no")
    found = copies.join(stays, "comp").groupBy("place.dk", "place.th").agg(F.collect_set(no).alias("every"), F.collect_set(F.when(F.col("place") == F.col("stays"), no)).alias("stay"))
    gone = stored(found, "gone-lines")
    forget(shared, copies, stays)
    copy = F.row_number().over(Window.partitionBy("dk", "th").orderBy("dk"))
    dropped = F.when(F.col("copy") > 1, F.col("every")).otherwise(F.array_except("every", "stay"))
    told = rows.withColumn("copy", copy).join(gone, ["dk", "th"], "left").withColumn("gone", F.when(F.col("every").isNull(), F.array().cast("array<int>")).otherwise(dropped))
    numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    # Lambdas bind their arguments once: a column would be put in place of its name, for every line anew.
    clean = F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(numbers(lines), lambda i: F.get(lines, i)), "\n"))[0]
    return told.select(
        *[F.when(F.size("gone") == 0, F.col("text")).otherwise(clean).alias(c) if c.lower() == text_col.lower() else F.col("row").getField(c).alias(c) for c in kept],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )
