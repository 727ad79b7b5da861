"""A lexical and dense index of segments that never change: syncs add one, merges replace some, readers keep the version that they opened.

Below the root lie ``versions`` (a manifest each, published by a rename that fails if another writer was first) and ``segments``. A manifest names its
segments, so the newest one is the index; what no manifest names is the rest of a run that was cut off. A segment holds chunks, posting lists (sorted by
token, with the least and greatest token of each file), vectors, the change of each token's counts, and the files that went or changed with it: those are
gone from all older segments. Reading joins segments with what is gone; merging segments of a like size writes down what is left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bm25
from tessera.sources.files import Folder

#: So many segments of one tier are merged; a tier's segments are up to so many times as large as those of the tier below.
FAN = 4
#: Postings of a file of lists, roughly; files are read or passed over by their tokens.
FILE_POSTINGS = 1 << 18
CHUNKS = "seq long, is_title boolean, share int, idx int, chunk_id string, file_path string, title string, chunk_index int, tokens array<string>, dl int"
VECTORS = "chunk_id string, file_path string, is_title boolean, embedding array<double>"
TERMS = "token string, df long, cf long"
GONE = "file_path string, at long"
FAILED = "file_path string, mtime long, size long"
FENCES = "file string, low string, high string"


class Conflict(Exception):
    """Another writer published the version that this one was to be."""


@dataclass(frozen=True)
class Segment:
    path: str  # below the root, or absolute where another index's segment is named
    seq: int
    rows: int  # entries
    postings: int
    gone: int  # files that it takes from older segments


@dataclass(frozen=True)
class Manifest:
    version: int
    segments: list[Segment] = field(default_factory=list)
    n: int = 0
    total: int = 0
    failed: str | None = None

    def text(self) -> str:
        return json.dumps({"version": self.version, "n": self.n, "total": self.total, "failed": self.failed, "segments": [s.__dict__ for s in self.segments]}, indent=1)

    @staticmethod
    def parse(text: str) -> Manifest:
        held = json.loads(text)
        return Manifest(held["version"], [Segment(**s) for s in held["segments"]], held["n"], held["total"], held["failed"])


class Store:
    """The index below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)

    # ---- versions

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.folder.names("versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's, the newest by default; before the first one there is an empty one."""
        known = self.versions()
        if not known and version is None:
            return Manifest(0)
        return Manifest.parse(self.folder.read(f"versions/{version if version is not None else known[-1]:012d}.json"))

    def publish(self, manifest: Manifest) -> None:
        name = f"versions/{manifest.version:012d}.json"
        if not self.folder.publish(name, manifest.text(), f"versions/draft-{uuid.uuid4().hex}"):
            raise Conflict(f"version {manifest.version} of {self.root} is there already")

    def branch(self, root: str, version: int | None = None) -> Store:
        """An index at another root that starts from the segments of this one, without copying them."""
        held, other = self.manifest(version), Store(self.spark, root)
        shared = [Segment(**{**s.__dict__, "path": self._path(s)}) for s in held.segments]
        other.publish(Manifest(held.version, shared, held.n, held.total, self._absolute(held.failed)))
        return other

    def _absolute(self, path: str | None) -> str | None:
        return path if path is None or "/" in path and (path.startswith("/") or ":" in path) else f"{self.root}/segments/{path}"

    def _path(self, segment: Segment) -> str:
        return self._absolute(segment.path)

    # ---- reading

    def _read(self, segments: list[Segment], name: str, schema: str) -> DataFrame:
        """One table of some segments, with the seq of each row's segment."""
        out = None
        for s in segments:
            part = self.spark.read.schema(schema).parquet(f"{self._path(s)}/{name}")
            part = part if "seq" in part.columns else part.withColumn("seq", F.lit(s.seq).cast("long"))
            part = part.withColumn("seq", F.lit(s.seq).cast("long"))
            out = part if out is None else out.unionByName(part)
        if out is not None:
            return out
        empty = self.spark.createDataFrame([], schema)
        return empty if "seq" in empty.columns else empty.withColumn("seq", F.lit(0).cast("long"))

    def _holed(self, manifest: Manifest) -> list[int]:
        """Segments that a newer one takes files from."""
        return [s.seq for s in manifest.segments if any(o.gone and o.seq > s.seq for o in manifest.segments)]

    def _live(self, manifest: Manifest, segments: list[Segment], name: str, schema: str) -> DataFrame:
        holed = set(self._holed(manifest))
        whole, cut = [s for s in segments if s.seq not in holed], [s for s in segments if s.seq in holed]
        if not cut:
            return self._read(whole, name, schema)
        newer = [s for s in manifest.segments if s.gone]
        gone = self._read(newer, "gone", GONE).groupBy("file_path").agg(F.max("at").alias("at"))
        rows = self._read(cut, name, schema)
        left = rows.join(bm25.few(gone.select(F.col("file_path").alias("gone_path__"), "at"), sum(s.gone for s in newer)), (F.col("file_path") == F.col("gone_path__")) & (F.col("at") > F.col("seq")), "left_anti")
        return left.unionByName(self._read(whole, name, schema)) if whole else left

    def _lists(self, segments: list[Segment]) -> Callable[[list[str] | None], DataFrame]:
        def read(tokens: list[str] | None) -> DataFrame:
            if tokens is None or not segments:
                return self._read(segments, "lists", bm25.LISTS)
            out = None
            for s in segments:
                files = self.files_of(s, tokens)
                if files:
                    part = self.spark.read.schema(bm25.LISTS).parquet(*files).where(bm25.one_of("token", tokens)).withColumn("seq", F.lit(s.seq).cast("long"))
                    out = part if out is None else out.unionByName(part)
            return out if out is not None else self.spark.createDataFrame([], bm25.LISTS)

        return read

    def files_of(self, segment: Segment, tokens: list[str]) -> list[str]:
        """Files of posting lists that may hold one of the tokens, by the fences of the files."""
        fences = self.spark.read.schema(FENCES).parquet(f"{self._path(segment)}/fences")
        asked = self.spark.createDataFrame([(t,) for t in tokens], "token string")
        met = fences.join(F.broadcast(asked), (F.col("token") >= F.col("low")) & (F.col("token") <= F.col("high")), "left_semi")
        return [f"{self._path(segment)}/lists/{r['file']}" for r in met.collect()]

    def snapshot(self, version: int | None = None) -> bm25.Index:
        """The index as a version has it; later syncs and merges do not change what is read."""
        m = self.manifest(version)
        terms = self._read(m.segments, "terms", TERMS).groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
        return bm25.Index(self.spark, self._live(m, m.segments, "chunks", CHUNKS), self._lists(m.segments), terms, m.n, m.total, tuple(self._holed(m)))

    def vectors(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._live(m, m.segments, "vectors", VECTORS).drop("seq")

    def failed(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self.spark.read.schema(FAILED).parquet(self._absolute(m.failed)) if m.failed else self.spark.createDataFrame([], FAILED)

    # ---- writing

    def _new(self, seq: int) -> tuple[str, str]:
        name = f"{seq:012d}-{uuid.uuid4().hex[:12]}"
        return name, f"{self.root}/segments/{name}"

    def _write(self, entries: DataFrame, changes: DataFrame | None, terms: DataFrame | None, path: str, seq: int) -> tuple[int, int, int]:
        """Chunks, lists, fences and terms of a segment; (entries, their tokens, postings). ``changes`` is added to its term counts; ``terms`` replaces them."""
        entries.write.parquet(f"{path}/draft-entries")
        held = self.spark.read.schema(entries.schema).parquet(f"{path}/draft-entries")
        n, total = held.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        shares = bm25.shares_of(n, self.spark.sparkContext.defaultParallelism)
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        bm25.numbered(held, shares, seq).select(*columns).write.parquet(f"{path}/chunks")
        chunks = self.spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
        bm25.posting_lists(chunks).write.parquet(f"{path}/draft-lists")
        lists = self.spark.read.schema(bm25.LISTS).parquet(f"{path}/draft-lists")
        counts = bm25.term_counts(lists)
        own = terms if terms is not None else counts if changes is None else counts.unionByName(changes).groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        own.where("df <> 0").sortWithinPartitions("token").write.parquet(f"{path}/terms")
        postings = lists.agg(F.coalesce(F.sum(F.size("idx").cast("long")), F.lit(0))).first()[0]
        cut = lists.repartitionByRange(-(-max(1, postings) // FILE_POSTINGS), "token", "share").sortWithinPartitions("token", "share")
        cut.write.parquet(f"{path}/lists")
        stored = self.spark.read.schema(bm25.LISTS).parquet(f"{path}/lists")
        stored.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(F.min("token").alias("low"), F.max("token").alias("high")).coalesce(1).write.parquet(f"{path}/fences")
        folder = Folder(self.spark, path)
        for draft in ("draft-entries", "draft-lists"):
            folder.remove(draft)
        return n, total, postings

    def build(self, entries: DataFrame) -> None:
        """A first segment of entries without vectors."""
        base = self.manifest()
        if base.segments:
            raise ValueError(f"{self.root} holds an index")
        name, path = self._new(base.version + 1)
        n, total, postings = self._write(entries, None, None, path, base.version + 1)
        self.spark.createDataFrame([], VECTORS).coalesce(1).write.parquet(f"{path}/vectors")
        self.spark.createDataFrame([], GONE).coalesce(1).write.parquet(f"{path}/gone")
        self.publish(Manifest(base.version + 1, [Segment(name, base.version + 1, n, postings, 0)], n, total))

    def sync(self, ops: DataFrame, notes: DataFrame, failed: DataFrame | None, entries: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame] | None = None) -> Manifest:
        """Carry out what ``sync.diff`` found, in one new segment; what is written grows with the change, not with the index.

        ``ops`` is (file_path, op), ``notes`` the files now with file_path, mtime and size, ``failed`` those that failed before (default: as on record). ``entries``
        cuts notes into chunk and title rows; ``embed`` adds embedding and broken to rows (chunk_id, file_path, is_title, text), once for each new text. A file
        with a broken vector gets no rows and is put on record as failed, where only those that ``diff`` left alone stay of the ones before.
        """
        base = self.manifest()
        seq = base.version + 1
        name, path = self._new(seq)
        ops.select("file_path", "op").write.parquet(f"{path}/draft-ops")
        ops = self.spark.read.schema("file_path string, op string").parquet(f"{path}/draft-ops")
        fresh = notes.join(ops.where("op in ('create', 'modify')").select("file_path"), "file_path", "left_semi")
        entries(fresh).write.parquet(f"{path}/draft-fresh")
        rows = self.spark.read.parquet(f"{path}/draft-fresh")
        before = self.failed() if failed is None else failed
        stay = before.join(ops.where("op = 'failed'").select("file_path"), "file_path", "left_semi")
        if embed is None:
            self.spark.createDataFrame([], VECTORS).coalesce(1).write.parquet(f"{path}/vectors")
        else:
            texts = rows.select("chunk_id", "file_path", "is_title", F.array_join("tokens", " ").alias("text"))
            embed(texts).select("chunk_id", "file_path", "is_title", "embedding", "broken").write.parquet(f"{path}/draft-embedded")
            embedded = self.spark.read.parquet(f"{path}/draft-embedded")
            bad = embedded.where("broken").select("file_path").distinct()
            rows = rows.join(bad, "file_path", "left_anti")
            embedded.join(bad, "file_path", "left_anti").drop("broken").write.parquet(f"{path}/vectors")
            stay = stay.unionByName(notes.join(bad, "file_path", "left_semi"), allowMissingColumns=True)
        stay.select("file_path", F.col("mtime").cast("long").alias("mtime"), F.col("size").cast("long").alias("size")).write.parquet(f"{path}/failed")
        ops.where("op in ('delete', 'modify')").select("file_path", F.lit(seq).cast("long").alias("at")).write.parquet(f"{path}/gone")
        gone = self.spark.read.schema(GONE).parquet(f"{path}/gone")
        n_gone = gone.count()
        lost = self.snapshot(base.version).chunks.join(bm25.few(gone.select("file_path"), n_gone), "file_path", "left_semi") if base.segments else None
        changes, n_lost, total_lost = None, 0, 0
        if lost is not None:
            lost.select("chunk_id", "tokens", "dl").write.parquet(f"{path}/draft-lost")
            lost = self.spark.read.schema("chunk_id string, tokens array<string>, dl int").parquet(f"{path}/draft-lost")
            n_lost, total_lost = lost.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            each = lost.select("chunk_id", F.explode("tokens").alias("token")).groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))
            changes = each.groupBy("token").agg((-F.count("*")).alias("df"), (-F.sum("tf")).alias("cf"))
        n, total, postings = self._write(rows, changes, None, path, seq)
        folder = Folder(self.spark, path)
        for draft in [x for x in folder.names() if x.startswith("draft-")]:
            folder.remove(draft)
        made = Manifest(seq, [*base.segments, Segment(name, seq, n, postings, n_gone)], base.n + n - n_lost, base.total + total - total_lost, f"{name}/failed")
        self.publish(made)
        return made

    def due(self, manifest: Manifest | None = None) -> list[Segment]:
        """Segments to merge: those of the lowest tier that has ``FAN`` of them."""
        tiers: dict[int, list[Segment]] = {}
        for s in (manifest or self.manifest()).segments:
            tier, rows = 0, s.rows
            while rows >= FAN:
                tier, rows = tier + 1, rows // FAN
            tiers.setdefault(tier, []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN), [])

    def merge(self, segments: list[Segment] | None = None) -> Manifest:
        """Replace segments (by default those that are ``due``) by one of their live rows; no search changes its answer.

        The new segment takes the place of the newest: what went since then is gone from it too, what went before has been left out. It keeps what its
        segments take from others that stay.
        """
        base = self.manifest()
        chosen = self.due(base) if segments is None else segments
        if not chosen:
            return base
        rest = [s for s in base.segments if s not in chosen]
        top = max(s.seq for s in chosen)
        name, path = self._new(top)
        oldest = min((s.seq for s in rest), default=top)
        self._read(chosen, "gone", GONE).where(F.col("at") > oldest).groupBy("file_path").agg(F.max("at").alias("at")).write.parquet(f"{path}/gone")
        n_gone = self.spark.read.schema(GONE).parquet(f"{path}/gone").count()
        terms = self._read(chosen, "terms", TERMS).groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        live = self._live(base, chosen, "chunks", CHUNKS).drop("seq", "share", "idx")
        n, _, postings = self._write(live, None, terms, path, top)
        self._live(base, chosen, "vectors", VECTORS).drop("seq").write.parquet(f"{path}/vectors")
        merged = Segment(name, top, n, postings, n_gone)
        made = Manifest(base.version + 1, sorted([*rest, merged], key=lambda s: s.seq), base.n, base.total, base.failed)
        self.publish(made)
        return made

    def recover(self, keep: int = 1) -> list[str]:
        """Forget all but the newest ``keep`` versions, drop drafts and every segment that no version left names; the names of what went.

        For the only writer, when no reader holds an older version.
        """
        known = self.versions()
        old, left = known[:-keep] if keep else known, known[-keep:]
        went = [n for n in self.folder.names("versions") if n.startswith("draft-")] + [f"{v:012d}.json" for v in old]
        held = [self.manifest(v) for v in left]
        named = {s.path for m in held for s in m.segments} | {m.failed.split("/")[0] for m in held if m.failed and not m.failed.startswith("/")}
        for n in went:
            self.folder.remove(f"versions/{n}")
        lost = [n for n in self.folder.names("segments") if n not in named]
        for n in lost:
            self.folder.remove(f"segments/{n}")
        return went + lost
