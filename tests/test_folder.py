"""A folder of notes, at rest and as a stream, and an index that follows it."""

import os

from pyspark.sql import functions as F

from tessera.operators import bm25, sequences, sync
from tessera.operators.segments import Store
from tessera.sources import corpus, folder

NOTES = {"a.md": "red blue", "sub/b c+ä.md": "green\ngrass", "sub/deep/d.md": "", "skip/e.md": "red", "sub/f.txt": "red", "sub/g.MD": "red red", "h.pdf": "%PDF", "drafts/x/i.md": "blue"}


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_listing_and_notes(spark, tmp_path):
    root = tmp_path / "vault"
    for name, text in NOTES.items():
        put(root, name, text)
    put(root, "bad.md", b"ok \xff end")
    listed = {r["file_path"]: r["size"] for r in folder.listing(spark, str(root), excluded=["skip", "drafts/*"]).collect()}
    assert listed == {"a.md": 8, "sub/b c+ä.md": 11, "sub/g.MD": 7, "h.pdf": 4, "bad.md": 8}
    assert {r["file_path"] for r in folder.listing(spark, str(root), root_path="sub/").collect()} == {"sub/b c+ä.md", "sub/g.MD"}
    read = {r["file_path"]: (r["title"], r["content"]) for r in folder.notes(spark, str(root), excluded=["skip", "drafts/*"]).collect()}
    assert read == {"a.md": ("a", "red blue"), "sub/b c+ä.md": ("b c+ä", "green\ngrass"), "sub/g.MD": ("g", "red red"), "bad.md": ("bad", "ok � end")}
    only = spark.createDataFrame([("a.md",), ("sub/b c+ä.md",)], "file_path string")
    assert {r["file_path"] for r in folder.notes(spark, str(root), only=only).collect()} == {"a.md", "sub/b c+ä.md"}
    assert folder.notes(spark, str(root), only=only.limit(0)).count() == 0


def test_stream_and_batch_see_the_same(spark, tmp_path):
    root, out, state = tmp_path / "vault", str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        folder.notes(spark, str(root), stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).select("file_path", "content").collect()))

    for name in ("a.md", "sub/b c+ä.md"):
        put(root, name, NOTES[name])
    assert drain() == sorted(map(tuple, folder.notes(spark, str(root)).select("file_path", "content").collect()))
    put(root, "later.md", "new")
    assert drain() == sorted(map(tuple, folder.notes(spark, str(root)).select("file_path", "content").collect())) and len(drain()) == 3


def test_an_index_follows_a_folder(spark, tmp_path):
    root, store = tmp_path / "vault", Store(spark, str(tmp_path / "index"))
    for name, text in NOTES.items():
        put(root, name, text)
    asked = spark.createDataFrame([(1, "red"), (2, "blue")], "query_id long, text string")

    def follow(old):
        now = folder.listing(spark, str(root)).where(F.lower("file_path").endswith(".md"))
        ops = sync.diff(now, old, store.failed())
        changed = folder.notes(spark, str(root), only=ops.where("op in ('create', 'modify')"))
        store.sync(ops, changed, None, corpus.index_entries)
        kept = spark.createDataFrame(now.collect(), now.schema)
        found = bm25.score(store.snapshot(), asked, titles=False).select("query_id", "file_path").collect()
        return kept, sorted(map(tuple, found))

    none = spark.createDataFrame([], "file_path string, mtime long, size long")
    held, found = follow(none)
    assert found == [(1, "a.md"), (1, "skip/e.md"), (1, "sub/g.MD"), (2, "a.md"), (2, "drafts/x/i.md")]
    put(root, "a.md", "only blue now")
    os.remove(root / "skip/e.md")
    put(root, "z.md", "red again")
    _, found = follow(held)
    assert found == [(1, "sub/g.MD"), (1, "z.md"), (2, "a.md"), (2, "drafts/x/i.md")]


def test_extracted_pages(spark, tmp_path):
    for number, text in enumerate(["first  page ", "second\r\n\r\n\r\n\r\npage", "", "last"], 1):
        put(tmp_path / "pages", f"book.pdf/{number}.txt", text)
    put(tmp_path / "pages", "other.pdf/10.txt", "ten")
    put(tmp_path / "pages", "other.pdf/2.txt", "two")
    each = folder.pages(spark, str(tmp_path / "pages"))
    whole = {r["file_path"]: r["content"] for r in folder.documents_of(each).collect()}
    assert whole["other.pdf"] == "two\nten" and whole["book.pdf"].startswith("first page\nsecond")
    rows = {(r["file_path"], r["page"]): (r["text"], r["start"]) for r in each.collect()}
    assert all(whole[f].startswith(t, at) for (f, _), (t, at) in rows.items()) and len(rows) == 5  # the page without bytes is not seen
    points = spark.createDataFrame([("book.pdf", at) for at in range(len(whole["book.pdf"]))], "file_path string, at int")
    pages = {r["at"]: r["page"] for r in sequences.as_of(points, each, "file_path", "at", "start", "page").collect()}
    assert pages[0] == 1 and pages[whole["book.pdf"].index("second")] == 2 and pages[whole["book.pdf"].index("last")] == 4
