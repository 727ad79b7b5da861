"""Small fixtures against brute force, round trips and library results; nulls, empty and repeated rows in each."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, exact_dedup, jaccard_join, line_dedup, linking, mixing, sharding, token_files, topk_search, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " \n ", "Aa", "aA", "é" * 30, "x" * 3000, "<|endoftext|> y", "don't  stop\n\nnow 12 3", "中文 字", "a\x1cb\x85c"]


def words(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


def documents(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    base = [words(s, 40 + 7 * s) for s in range(20)]
    texts = [*base, None, *ODD, base[0], base[0], base[1].upper(), None]
    for s in range(40):  # near copies of one text
        w = base[5].split()
        w[s % len(w)] = f"new{s}"
        texts.append(" ".join(w))
    return documents(spark, texts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_deals_every_row_once(spark, docs):
    twice = docs.unionByName(docs).withColumn("shard", F.lit("clash")).withColumn("Slot", F.lit(1))
    out = sharding.shard(twice, shards=7, bucket_bytes=4096).collect()
    assert len(out) == twice.count()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(str((r["doc_id"], r["text"])) for r in out) == sorted(str((r["doc_id"], r["text"])) for r in twice.collect())
    again = sharding.shard(twice, shards=7, bucket_bytes=4096).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sharding.shard(empty(spark)).count() == 0


def test_sharding_splits_a_repeated_row(spark):
    one = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text " * 20).alias("text"))
    out = sharding.shard(one, shards=4, bucket_bytes=100_000)
    assert [r["count"] for r in out.groupBy("shard").count().collect()] == [750] * 4


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_exact_dedup_against_brute_force(spark, docs, monkeypatch, sent):
    """Surviving groups are broadcast or, beyond the bound, joined by a shuffle."""
    monkeypatch.setattr(common, "ROWS_SENT", sent)
    out = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs.withColumn("KEPT", F.lit(0))).collect()}
    groups = {}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in docs.collect():
        groups.setdefault((r["text"] or "").translate(fold), []).append(r["doc_id"])
    for ids in groups.values():
        for i in ids:
            assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (max(ids), len(ids), i == max(ids))
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "B")], "doc_id long, text string")
    out = exact_dedup.exact_dedup(rows).collect()
    assert sum(r["kept"] for r in out) == 2 and {r["keep_id"] for r in out if r["text"].lower() == "a"} == {1}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.2, (400, 12)).astype("float32")
    v[50:250] = v[50]  # one very common vector
    rows = [(i, [float(x) for x in row], "l") for i, row in enumerate(v)]
    rows += [(1000, None, "n"), (1001, [1.0, None] + [0.0] * 10, "n"), (1002, [float("nan")] * 12, "n"), (1003, [float("inf")] * 12, "n"), (1100, [0.5, 0.5], "n"), (1101, [0.25, 0.5], "n"), (None, [0.1] * 12, "n"), (1104, [], "n")]
    out = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), k=10, every=50)
    q = np.floor(v.astype(float) * 1024).astype(int)
    expect = []
    for i in range(0, 400, 50):
        scores = [(-int(q[i] @ q[j]), j) for j in range(400) if j != i]
        expect += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:10])]
    expect.append((1100, 1, 1101, 512 * 256 + 512 * 512))
    assert sorted(tuple(r) for r in out.collect()) == sorted(expect)
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_top_k(rows, k, every):
    """rows: (id, vector of floats); every row but the query's own is a candidate."""
    q = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    out = []
    for a, (i, x) in enumerate(q):
        if i % every == 0:
            scores = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), j, b) for b, (j, y) in enumerate(q) if b != a and len(y) == len(x))
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale, dim", [(1e3, 768), (2.0**19, 8), (1e12, 3)])
def test_top_k_of_large_components(spark, monkeypatch, scale, dim):
    """Sums of products beyond the exact range of a double, repeated ids, several blocks."""
    monkeypatch.setattr(topk_search, "BLOCK", 40)
    monkeypatch.setattr(topk_search, "TILE", 16)
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (120, dim)) * scale
    if scale == 1e12:
        v = v / 1e9 + np.array([2e4, 0, 0])
    v[60:] = v[:60] * (1 + 1e-9 * rng.integers(0, 3, (60, dim)))  # scores that nearly tie
    rows = [(i % 90, [float(x) for x in r]) for i, r in enumerate(v)]
    out = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7, every=30)
    assert sorted(tuple(r) for r in out.collect()) == brute_top_k(rows, 7, 30)


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 1.0]), (1, [20000.0, 1.0]), (2, [0.5, 0.5]), (2, [0.9, 0.9]), (100, [1.0, 0.0]), (100, [1.0, 0.0])]
    out = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in out.collect()) == brute_top_k(rows, 10, 100)
    with pytest.raises(Exception, match="exceeds a long"):
        topk_search.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_mixing_reaches_its_weights(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t" * 9).alias("text"), F.when(F.col("id") % 3 == 0, "src1").when(F.col("id") % 3 == 1, "a").alias("source"), F.lit(1).alias("position"))
    out = mixing.mix(rows, {"src1": 0.5, "a": 0.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"src1", None} and abs(n["src1"] - 3000) < 250 and abs(n[None] - 3000) < 250
    assert out.select("doc_id", "copy_no").distinct().count() == out.count()
    many = mixing.mix(rows.limit(50), {"src1": 0.9}, total=F.lit(200_000))  # a rate over LOT_RATE
    assert abs(many.where("source = 'src1'").count() - 18_000) < 800
    assert mixing.mix(empty(spark), {"src1": 1.0}).count() == 0


def test_lines_against_brute_force(spark):
    line = words(3, 60)
    changed = line.split()
    changed[30] = "changed"
    text = [f"{line}\nshort\n\n{words(1, 30)}", f"{' '.join(changed)}\nshort", None, "", f"{words(2, 30)}\nshort\n  ", "other", "other"]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, text)).collect()}
    assert out[0]["text"] == text[0] and out[1]["text"] == "" and out[2]["text"] is None and out[3]["text"] == ""
    assert out[4]["text"] == f"{words(2, 30)}\n  " and out[5]["text"] == "other" and out[6]["text"] == ""
    assert [out[i]["n_dropped"] for i in range(7)] == [0, 2, 0, 0, 1, 0, 1]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_bands_find_pairs_at_the_similarity():
    """Pairs of lines of similarity 0.8: a tenth of the shingles in each line alone, eight tenths shared."""
    rng, lines, n = np.random.default_rng(4), [], 5000
    text = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    for _ in range(n):
        k = int(rng.integers(4, 11))
        shared = text(8 * k + 9)
        lines += [shared + text(k), shared + text(k)]
    keys = line_dedup.band_keys(lines)
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.99


def test_long_lines_are_hashed_whole(monkeypatch):
    lines = ["Äb" * 40 + words(1, 300), "x", words(2, 5), "é" * 9, words(3, 200)]
    whole, sets = line_dedup.band_keys(lines), line_dedup.shingle_sets(lines)
    monkeypatch.setattr(line_dedup, "STEP", 64)
    assert (line_dedup.band_keys(lines) == whole).all()
    assert all((x == y).all() for x, y in zip(line_dedup.shingle_sets(lines), sets, strict=True))
    assert [len(x) for x in sets] == [len({t.lower()[k : k + 10] for k in range(max(1, len(t) - 9))}) for t in lines]


def near_lines(n, seed):
    """Lines that keep nine tenths of one line: many pairs of them are just over the similarity, others just under."""
    rng = np.random.default_rng(seed)
    base, out = words(seed, 30)[:120], []
    for i in range(n):
        k = int(rng.integers(0, 16))
        out.append(base[: 120 - k] + "".join(rng.choice(list("klmnop"), k)) + f"{i:02d}")
    return out


def brute_lines(lines, keys):
    """Components of the lines that share a band and are similar."""
    sets = [{t.lower()[k : k + 10] for k in range(max(1, len(t) - 9))} for t in lines]
    comp = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if keys[a] & keys[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    return comp


def brute_dedup(rows):
    """The text of each row (id, text) after line deduplication; ids are distinct."""
    seen = sorted((i, no, line) for i, text in rows for no, line in enumerate((text or "").split("\n")) if line.strip())
    lines = list(dict.fromkeys(line for _, _, line in seen))
    comp = dict(zip(lines, brute_lines(lines, [set(k) for k in line_dedup.band_keys(lines).tolist()]), strict=True))
    first = {}
    for i, no, line in seen:
        first.setdefault(comp[line], (i, no))
    stays = set(first.values())
    return {i: None if text is None else "\n".join(line for no, line in enumerate(text.split("\n")) if not line.strip() or (i, no) in stays) for i, text in rows}


@pytest.mark.parametrize("small, hubs, tile", [(32, 3, 256), (2, 1, 7), (2, 1, 64)])
def test_line_dedup_against_brute_force(spark, monkeypatch, small, hubs, tile):
    """Buckets of any size: one shared band makes a candidate. Extra columns clash with every helper."""
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(linking, "HUBS", hubs)
    monkeypatch.setattr(line_dedup, "TILE", tile)
    lines = [t for seed in range(4) for t in near_lines(60, seed)]
    texts = ["\n".join([*lines[i::23], "same", " ", words(i, 12), "same"]) for i in range(23)] + [None, "", "\n\n", words(77, 20_000)]
    table = documents(spark, texts)
    clash = table.select("*", *[F.lit(1).alias(c) for c in ("row", "id", "dk", "th", "gone", "every", "stay", "copy", "n_lines", "N_dropped")])
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(clash).collect()}
    assert {i: r["text"] for i, r in out.items()} == brute_dedup(list(enumerate(texts)))
    assert {(r["row"], r["dk"], r["copy"]) for r in out.values()} == {(1, 1, 1)} and len(out) == len(texts)


def test_lots_of_lines_bound_what_a_batch_takes(monkeypatch):
    """A batch of long lines is compared and sketched lot by lot; what one lot gives, many give."""
    import tracemalloc

    import pyarrow as pa

    pool = [words(i, 300) for i in range(20)]
    text = lambda i: pool[i % 20]
    pairs = pa.RecordBatch.from_pydict({"a": list(range(1500)), "b": list(range(5000, 6500)), "la": [text(i) for i in range(1500)], "lb": [text(i + i % 2) for i in range(1500)]})
    docs = pa.RecordBatch.from_pydict({"id": list(range(1500)), "dk": list(range(1500)), "th": [0] * 1500, "text": [text(i) + "\n" + text(i + 1) if i % 7 else None for i in range(1500)]})
    monkeypatch.setattr(line_dedup, "LOT", 1 << 16)
    monkeypatch.setattr(line_dedup, "STEP", 1 << 12)
    for run, batch in ((line_dedup._verify, pairs), (line_dedup._occurrences, docs)):
        list(run(iter([batch.slice(1, 1)])))  # makes the tables of powers, which stay
        total = 0
        tracemalloc.start()
        for out in run(iter([batch])):
            total += out.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        size = batch.nbytes
        assert size > 4e6 and peak < size, (run.__name__, peak, size)
        with monkeypatch.context() as m:
            m.setattr(line_dedup, "LOT", 1 << 30)
            assert total == sum(out.num_rows for out in run(iter([batch]))) > 700


def test_line_tiles_compare_no_pair_by_itself(monkeypatch):
    """A full tile of a bucket is compared by matrix products; its links join what brute force joins, whatever the columns held at once."""
    import pyarrow as pa

    lines = [t for seed in range(4) for t in near_lines(60, seed)] + ["x", "y"]
    keys, calls, one = line_dedup.band_keys(lines), [], line_dedup.similar
    keys[:, 0] = 7
    monkeypatch.setattr(line_dedup, "similar", lambda x, y, least: calls.append(1) or one(x, y, least))
    side = lambda at: pa.table({"nid": pa.array(at, pa.int64()), "comp": pa.array(at, pa.int64()), "line": [lines[i] for i in at], "keys": keys[at].tolist()})
    left, right = (list(range(k, len(lines), 2)) for k in (0, 1))
    sets = [{t.lower()[k : k + 10] for k in range(max(1, len(t) - 9))} for t in lines]
    comp = list(range(len(lines)))
    for a in left:
        for b in right:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    for columns in (1 << 12, 50):
        monkeypatch.setattr(line_dedup, "COLUMNS", columns, raising=False)
        links = line_dedup._tile((pa.scalar(7),), side(left), side(right)).to_pylist()
        found = list(range(len(lines)))
        for e in links:
            found = [min(found[e["a"]], found[e["b"]]) if c in (found[e["a"]], found[e["b"]]) else c for c in found]
        assert found == comp and len(links) == len(lines) - len(set(comp))
    assert len(calls) < len(lines)


def test_line_dedup_of_repeated_rows(spark):
    text = f"{words(1, 20)}\n{words(2, 20)}"
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, "other"), (None, "alone")], "doc_id long, text string")
    out = sorted(str((r["doc_id"], r["text"], r["n_dropped"])) for r in line_dedup.dedup_lines(rows).collect())
    assert out == sorted(map(str, [(1, text, 0), (1, "", 2), (None, "", 2), (None, None, 0), (2, "other", 0), (None, "alone", 0)]))


def test_toxicity_learns_marked_words(spark):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = words(i, 30).split()
        if bad:
            for _ in range(3):
                w[rng.integers(30)] = ("vile", "nasty", "awful")[rng.integers(3)]
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    docs, taught = documents(spark, [*texts, None, ""]), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), toxicity.fit(docs, taught)).collect()
    held = [(r["score"] >= 0.5, r["doc_id"] % 4 == 0) for r in out if r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in out if r["doc_id"] >= 400} == {min(r["score"] for r in out if r["doc_id"] >= 400)}
    assert toxicity.score(empty(spark), toxicity.fit(docs, taught.limit(0))).count() == 0


def brute_classes(rows):
    import re

    sets = {}
    for i, text in rows:
        w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    head, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                head[y] = x
                links[a] += 1
                links[b] += 1
    return {i: root(i) for i in sets}, links


def test_near_duplicates_against_brute_force(spark, docs):
    out = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs).collect()}
    classes, links = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {i: r["class_id"] for i, r in out.items()} == classes
    small = [i for i, c in classes.items() if list(classes.values()).count(c) <= linking.SMALL]
    assert [out[i]["n_links"] for i in small] == [links[i] for i in small]
    assert all(r["kept"] == (i == classes[i]) for i, r in out.items())
    assert jaccard_join.keep_one(docs).count() == len(set(classes.values()))
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_repeated_rows(spark):
    a, b = words(1, 60), words(2, 60)
    rows = spark.createDataFrame([(1, a), (1, a), (2, f"{a} more"), (3, b), (3, b), (None, b), (4, ""), (4, ""), (5, None)], "doc_id long, text string")
    marks = jaccard_join.near_duplicates(rows).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in marks) == [(0, 3, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 2), (3, 3, 2), (4, 4, 0), (4, 4, 0), (5, 5, 0)]
    assert sum(r["kept"] for r in marks) == 5
    clash = rows.select("*", *[F.lit(7).alias(c) for c in ("row_key", "key", "row", "gone", "kept", "class_id", "stay")])
    kept = jaccard_join.keep_one(clash)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 4, 5]


@pytest.mark.parametrize("small, lot", [(32, 1024), (32, 16), (4, 16)])
def test_links_of_large_classes_are_counted_whole(spark, monkeypatch, small, lot):
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "LOT", lot, raising=False)
    base, texts = words(7, 200).split(), []
    for s in range(70):  # close to one text, and so to one another
        w = list(base)
        for k in range(s % 4):
            w[(37 * s + 50 * k) % 200] = f"new{s}x{k}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[1], texts[1], words(8, 50), None]
    out = {r["doc_id"]: r["n_links"] for r in jaccard_join.near_duplicates(documents(spark, texts)).collect()}
    assert out == brute_classes(list(enumerate(texts)))[1]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    out = {r["nid"]: r["comp"] for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 100 for i in range(100, 161)} | {i: 0 for i in range(50)} | {200: 200, 201: 200}


def test_posterior_bound():
    assert jaccard_join.fewest_matches(64) < 0.8 * 64 and jaccard_join.fewest_matches(8) >= 1


def test_warc_derivatives(spark, tmp_path):
    html = "<html><!-- c --><script>x<y</script><p>One &amp; two<p>three&lt;</html>"
    pages = spark.createDataFrame([(1, "http://a/\r\nb", html), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string")
    out = warc.derive(warc.responses(pages.withColumn("row", F.lit("clash")))).collect()
    assert len(out) == 8
    text = next(r for r in out if r["row"]["page_id"] == 1 and r["record_type"] == "conversion")
    assert text["block"] == "One & two\nthree<" and f"WARC-Refers-To: {text['refers_to']}\r\n" in text["headers"]
    assert text["block_digest"] == "sha256:" + hashlib.sha256(text["block"].encode()).hexdigest()
    about = next(r for r in out if r["row"]["page_id"] == 1 and r["record_type"] == "metadata")
    assert about["refers_to"] == text["refers_to"] and f"conversion-record-id: {text['record_id']}" in about["block"]
    assert "WARC-Target-URI" not in next(r for r in out if r["row"]["page_id"] == 2)["headers"]
    warc.write_warc(warc.derive(warc.responses(pages.limit(1))), str(tmp_path / "w"))
    import gzip

    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert raw.count(b"WARC/1.1\r\n") == 2 and raw.endswith(b"\r\n\r\n")
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_keeps_source_headers_and_decodes_references(spark):
    import html

    page = "<p>caf&eacute; &#8217;&#x27;&mdash;&hellip; &amp;lt; &unknown; &nbsp;x</p>" + "<div>long</div>" * 50_000
    head = "HTTP/1.1 203 Other\r\nX-A: b\r\nContent-Type: text/html\r\n\r\n"
    source = spark.createDataFrame([("<urn:uuid:1>", "http://a", "2020-01-02T03:04:05Z", head, page, "sha256:x", ("r",))], "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, row struct<a string>")
    out = {r["record_type"]: r for r in warc.derive(source).collect()}
    assert out["conversion"]["block"] == "\n".join([html.unescape("caf&eacute; &#8217;&#x27;&mdash;&hellip; &amp;lt; &unknown; &nbsp;x"), *["long"] * 50_000])
    assert "source-http-headers: HTTP/1.1 203 Other | X-A: b | Content-Type: text/html\r\n" in out["metadata"]["block"]
    assert all("WARC-Refers-To: <urn:uuid:1>\r\n" in r["headers"] and "WARC-Date: 2020-01-02T03:04:05Z\r\n" in r["headers"] for r in out.values())


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_000, 10_000), np.zeros(9000), rng.integers(0, 2, 5000), [2**63, 5, 2**64 - 1, 0, 7], 2 ** rng.integers(0, 63, 20_000), [3], []):
        ids = np.asarray(ids, np.uint64)
        packed, starts = token_files.pack(ids)
        assert (token_files.unpack(packed, starts, len(ids)) == ids).all()
        for b in range(len(starts)):
            one = token_files.read_ids(packed.tobytes(), starts.tolist(), len(ids), b)
            assert (one == ids[b * token_files.BLOCK : (b + 1) * token_files.BLOCK]).all()


def test_token_files_hold_what_the_library_encodes(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    out = {r["doc_id"]: r for r in token_files.read_digest(spark, token_files.write_tokens(docs, path, public_tokenizers.PATTERN, 2)).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(out[r["doc_id"]]) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_digest(spark, token_files.write_tokens(empty(spark), path, public_tokenizers.PATTERN, 2)).count() == 0


def test_bpe_equals_the_library_and_decodes(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("clash")), path, public_tokenizers.PATTERN), path).collect()
    for r in out:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert len(out) == docs.count() and bpe.encode(empty(spark), path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("block", [4 << 20, 200])
def test_bpe_round_trip_takes_one_python_step(spark, docs, block):
    """Two steps in one task are two workers, each with its tables and memory of its own."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.round_trip(docs.withColumn("IDS", F.lit("clash")).withColumn("decoded", F.lit(1)), path, public_tokenizers.PATTERN, block_bytes=block)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = out.collect()
    assert all(r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)
    assert len(rows) == docs.count() and bpe.round_trip(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    for name, table in (("documents", docs), ("labels", spark.createDataFrame([(i, 1, int(i == 1)) for i in range(20)], "doc_id long, quality int, toxic int"))):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "bpe"]
    kept = docs
    for _, stage in p.STAGES[:3]:
        after = stage(spark, kept, str(tmp_path))
        assert after.columns == docs.columns
        kept = after
    assert 0 < kept.count() < docs.count()
    assert p.run(spark, str(tmp_path)).count() > 0
    for _, stage in p.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0


def test_rest_of_large_buckets_against_brute_force(spark, monkeypatch):
    """Two families share a bucket by their first band; the hub is in one of them."""
    monkeypatch.setattr(linking, "SMALL", 2)
    monkeypatch.setattr(linking, "HUBS", 1)
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    shared = words(99, 220).split()
    texts = []
    for family in range(3):
        own = shared[:110] + words(family, 110).split()
        for s in range(20):
            w = list(own)
            w[111 + 4 * s % 100] = f"f{family}x{s}"
            texts.append(" ".join(w))
    out = {r["doc_id"]: r["class_id"] for r in jaccard_join.near_duplicates(documents(spark, texts)).collect()}
    assert out == brute_classes(list(enumerate(texts)))[0] and len(set(out.values())) == 3


def test_tile_links_join_what_is_similar():
    import pyarrow as pa

    base = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(np.concatenate([base[k:], base[:k] + np.uint64(1)])) for k in (0, 2, 4, 100)]
    sig = [jaccard_join.signature(s) for s in sets]
    same = [np.frombuffer(s, "<u4").reshape(jaccard_join.BANDS, -1) for s in sig]
    band = next(b for b in range(jaccard_join.BANDS) if (same[0][b] == same[1][b]).all())
    rows = lambda ids: pa.table({"nid": pa.array(ids), "comp": pa.array(ids), "band": pa.array([band] * len(ids), pa.int32()), "sig": pa.array([sig[i] for i in ids]), "set": pa.array([sets[i].tobytes() for i in ids])})
    out = jaccard_join._tile((), rows([0]), rows([1, 3]))
    assert out.to_pylist() == [{"a": 0, "b": 1}]
    assert jaccard_join._tile((), rows([]), rows([1])).num_rows == 0


def test_registry_names_each_operator():
    from tessera.llm import registry

    assert [n for k in range(1, 11) for n in registry.QUERIES if n.startswith(f"op{k}_")] == sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("most", [3, 1000])
def test_units_give_the_pieces_of_whole_texts(most):
    import random

    import regex

    from tessera.llm import pieces

    split = regex.compile(public_tokenizers.PATTERN).findall
    seen: dict = {}

    def encode(new):
        ids = [[seen.setdefault(c, len(seen)) for c in p] for p in new]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

    units, r = pieces.UnitIds(split, encode, most), random.Random(5)
    for _ in range(60):
        texts = ["".join(r.choice(["a", "b", "é", "1", ".", " ", " ", "  ", "\n", "\t", "don't"]) for _ in range(r.randrange(14))) for _ in range(r.randrange(6))]
        units.start()
        numbers, counts = units.add(texts)
        flat, lens = units.ids(numbers)
        ends = pieces.spans(lens)[pieces.spans(counts)]
        for i, text in enumerate(texts):
            own, _ = encode(split(text))
            assert flat[ends[i] : ends[i + 1]].tolist() == own.tolist(), repr(text)
    short = pieces.UnitIds(regex.compile(r"[a-z]+").findall, encode)
    numbers, counts = short.add(["ab 1 cd", "", "x  y"])
    assert len(short.ids(numbers)[0]) == 6 and counts.sum() == len(numbers)


def test_a_script_ends_at_its_own_tag(spark):
    page = '<p>a</p><script>var s="</style>"; alert(1)</script><p>b</p><style>x</script></style>c<noscript>d</noscript><template>e</template>'
    assert spark.createDataFrame([(page,)], "t string").select(warc.plain_text(F.col("t"))).first()[0] == "a\nb\nc"


def test_toxicity_learns_the_same_of_repeated_ids(spark):
    rows = [(i, f"bad words {i}" if i % 2 else f"good words {i}") for i in range(40)] + [(i, f"other text {i} {k}") for i in range(40) for k in range(5)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic long")
    weights = [sorted(map(tuple, toxicity.fit(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n), labels).collect())) for step, n in ((1, 1), (-1, 4))]
    assert weights[0] == weights[1] != []
