"""Kernels on small hand-made inputs with known answers."""

import html
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.config import SearchOptions
from tessera.functions import chunker
from tessera.functions import text as T
from tessera.operators import bm25, evaluate, filters, models, prepare, ranking, search, sequences, sync, vector
from tessera.sources import corpus
from tessera.streaming.changes import fold


def hits(spark, *rows):
    return spark.createDataFrame([(1, f, f"{f}#{i}", float(s)) for i, (f, s) in enumerate(rows)], "query_id int, file_path string, chunk_id string, score double")


def scores(df, key="file_path"):
    return {r[key]: r["score"] for r in df.collect()}


@pytest.mark.parametrize(
    ("method", "rows", "expected", "options"),
    [
        ("max_p", [0.9, 0.7], 0.9, {}),
        ("top_m_sum", [0.5, 0.3, 0.1], 0.8, {"m": 2}),
        ("top_m_avg", [0.8, 0.4, 0.2], 0.6, {"m": 2}),
        ("top_m_avg", [0.8], 0.8, {"m": 3}),
        ("weighted_top_l_sum", [1, 1, 1, 1], 2.8525, {}),
        ("rrf_per_doc", [0.1, 0.9], 1 / 61 + 1 / 62, {}),
    ],
)
def test_file_scores(spark, method, rows, expected, options):
    out = ranking.aggregate_files(hits(spark, *[("a", s) for s in rows]), method, **options).first()
    assert out["score"] == pytest.approx(expected, abs=1e-6) and out["chunk_count"] == len(rows)


def test_best_chunk_and_unknown_method(spark):
    assert ranking.aggregate_files(hits(spark, ("a", 0.7), ("a", 0.9))).first()["top_chunk"] == "a#1"
    with pytest.raises(ValueError):
        ranking.aggregate_files(hits(spark, ("a", 1)), "median")


def test_merge_keeps_the_first_list(spark):
    one, two = hits(spark, ("a", 0.9)), hits(spark, ("a", 0.1), ("b", 0.5))
    assert scores(ranking.merge_first(one, two), "chunk_id") == {"a#0": 0.9, "b#1": 0.5}


def test_rank_fusion(spark):
    e, b = hits(spark, ("a", 0.9), ("b", 0.5)), hits(spark, ("b", 0.9), ("a", 0.5))
    first, second = scores(ranking.reciprocal_ranks([(e, 0.8), (b, 0.2)], "file_path")), scores(ranking.reciprocal_ranks([(e, 0.2), (b, 0.8)], "file_path"))
    assert first["a"] > first["b"] and second["b"] > second["a"]
    assert scores(ranking.reciprocal_ranks([(hits(spark, ("a", 1)), 0.6), (hits(spark, ("a", 3)), 0.4)], "file_path")) == {"a": 1.0}
    apart = scores(ranking.reciprocal_ranks([(e, 0.6), (hits(spark, ("c", 1), ("d", 0)), 0.4)], "file_path"))
    assert apart["a"] == pytest.approx(0.6) and all(0 <= s <= 1 for s in apart.values())
    with pytest.raises(ValueError):
        ranking.reciprocal_ranks([(e, 0.0)], "file_path")


def test_combine_sides(spark):
    title, content, none = hits(spark, ("a", 0.8)), hits(spark, ("a", 0.6)), hits(spark, ("z", 0)).limit(0)
    assert scores(ranking.combine(title, content, 0.3, 0.7, 5))["a"] == pytest.approx(0.66)
    assert scores(ranking.combine(title, none, 0.3, 0.7, 5))["a"] == pytest.approx(0.24)
    assert scores(ranking.combine(none, content, 0.3, 0.7, 5))["a"] == pytest.approx(0.42)
    assert list(scores(ranking.combine(hits(spark, ("a", 3), ("b", 2), ("c", 1)), none, 1.0, 0.0, 2))) == ["a", "b"]


def test_combined_scores_round_as_sql(spark):
    """Sums of quarters that are a half of the last digit, whose doubles may stand just below it."""
    duckdb = pytest.importorskip("duckdb")
    pairs = [(t / 1e6, c / 1e6) for t in range(400001, 400200) for c in (500003, 611117, 733331) if (t + 3 * c) % 4 == 2]
    side = lambda at: spark.createDataFrame([(1, f"{i:04}", p[at]) for i, p in enumerate(pairs)], "query_id int, file_path string, score double")
    sql = duckdb.connect().execute(f"SELECT round(t * 0.25::DOUBLE + c * 0.75::DOUBLE, 6) FROM (VALUES {', '.join(f'({i}, {t!r}::DOUBLE, {c!r}::DOUBLE)' for i, (t, c) in enumerate(pairs))}) v(i, t, c) ORDER BY i").fetchall()
    got = scores(ranking.combine(side(0), side(1), 1.0, 3.0, len(pairs)))
    assert [got[k] for k in sorted(got)] == [r[0] for r in sql]
    odd = spark.createDataFrame([(x,) for x in (0.25, -0.25, 0.35, 1e300, float("inf"), 0.0, None)], "x double")
    assert [r[0] for r in odd.select(ranking.rounded(F.col("x"), 1)).collect()] == [0.3, -0.3, 0.4, 1e300, float("inf"), 0.0, None]


def test_min_max_and_limits(spark):
    assert set(scores(ranking.min_max(hits(spark, ("a", 2), ("b", 2), ("c", 2)))).values()) == {1.0}
    assert scores(ranking.min_max(hits(spark, ("a", 1), ("b", 3)))) == {"a": 0.0, "b": 1.0}
    assert ranking.split_limit(100, 0.6, 0.4) == (60, 40) and ranking.split_limit(5, 0.5, 0.5) == (3, 3)
    with pytest.raises(ValueError):
        SearchOptions(embedding_weight=0.0, bm25_weight=0.0)


def test_bm25_counts_repeated_terms(spark):
    notes = spark.createDataFrame([("a", "t", "x y"), ("b", "t", "y z")], "file_path string, title string, content string")
    q = spark.createDataFrame([(1, "x"), (2, "x x"), (3, "")], "query_id int, text string")
    out = {r["query_id"]: r["score"] for r in bm25.score(corpus.index_entries(notes), q).collect()}
    assert set(out) == {1, 2} and out[2] == pytest.approx(2 * out[1], abs=2e-6)
    assert bm25.statistics(corpus.index_entries(notes.limit(0))).first()["avgdl"] == 0.0


def test_cosine_and_flat_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<double>")
    out = [(r["id"], r["score"]) for r in vector.search(v, q, 3).orderBy("rank").collect()]
    assert out == [("a", 1.0), ("c", round(math.sqrt(0.5), 6)), ("b", 0.0)]
    assert v.select(vector.cosine(F.col("embedding"), F.array(F.lit(0.0), F.lit(0.0))).alias("c")).distinct().collect() == [(0.0,)]
    with pytest.raises(Exception, match="NaN"):
        vector.search(v.unionByName(spark.createDataFrame([("n", [float("nan"), 1.0])], v.schema)), q, 3).collect()


def test_metrics(spark):
    run = spark.createDataFrame([("1", "n", 1), ("1", "r", 2), ("2", "r", 1), ("2", "n", 2), ("2", "s", 3)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("1", "r", 1), ("2", "r", 1), ("2", "s", 1), ("3", "r", 2), ("4", "r", 0)], "query_id string, doc_id string, relevance int")
    out = {r["query_id"]: r for r in evaluate.per_query(run, qrels).collect()}
    assert out["1"]["ndcg10"] == pytest.approx(0.63093, abs=1e-5) and out["1"]["rr10"] == 0.5
    assert out["2"]["ap"] == pytest.approx(0.83333, abs=1e-5) and out["2"]["recall10"] == 1.0
    assert set(out) == {"1", "2", "3"} and out["3"]["ndcg10"] == out["3"]["ap"] == 0.0


def test_sync_and_coalescing(spark):
    ops = {1: ["create", "delete"], 2: ["create", "modify"], 3: ["modify", "delete"], 4: ["delete", "create"], 5: ["create", "delete", "modify"]}
    rows = [(k, i, i, op) for k, v in ops.items() for i, op in enumerate(v)]
    out = {r["key"]: r["op"] for r in sync.coalesced(spark.createDataFrame(rows, "key int, ts int, seq int, op string")).collect()}
    assert out == {2: "create", 3: "delete", 4: "delete", 5: "modify"}
    f = lambda *r: spark.createDataFrame(list(r), "file_path string, mtime long, size long")
    diff = sync.diff(f(("a", 1, 1), ("b", 2, 1), ("c", 1, 1), ("d", 1, 1)), f(("b", 1, 1), ("c", 1, 1), ("e", 1, 1)), f(("d", 1, 1)))
    assert {r["file_path"]: r["op"] for r in diff.collect()} == {"a": "create", "b": "modify", "c": "skip", "d": "failed", "e": "delete"}


def test_paths(spark):
    def on(pattern, *paths):
        d = spark.createDataFrame([(p,) for p in paths], "p string")
        return [r[0] for r in d.select(pattern(F.col("p"))).collect()]

    assert on(lambda p: filters.in_folder(p, "a"), "a/x.md", "ab/x.md") == [True, False]
    assert on(lambda p: filters.excluded(p, "daily"), "daily/x.md", "daily.md", "a/daily/b.md") == [True, False, True]
    assert on(lambda p: filters.excluded(p, "foo/ba"), "foo/bar.md") == [True]
    assert on(lambda p: filters.excluded(p, "*.t?t"), "a/b.txt", "a/b.md") == [True, False]
    assert on(filters.indexable, "a/b.MD", "c.wav", "d.exe", "noext") == [True, True, False, False]


def test_as_of_and_offsets(spark):
    starts = spark.createDataFrame([("f", 0, 1), ("f", 100, 2), ("f", 250, 3)], "k string, start int, page int")
    points = spark.createDataFrame([("f", x) for x in (-1, 0, 99, 100, 300)] + [("g", 5)], "k string, at int")
    out = {(r["k"], r["at"]): r["page"] for r in sequences.as_of(points, starts, "k", "at", "start", "page").collect()}
    assert out == {("f", -1): None, ("f", 0): 1, ("f", 99): 1, ("f", 100): 2, ("f", 300): 3, ("g", 5): None}
    clash = points.withColumnRenamed("at", "_at").withColumn("row", F.lit(1)).withColumn("kind", F.lit(2)).withColumn("page", F.lit(9))
    out = sequences.as_of(clash, starts, "k", "_at", "start", "page", else_first=True)
    assert out.columns == ["k", "_at", "row", "kind", "page"] and {(r["k"], r["_at"]): r["page"] for r in out.collect()} == {("f", -1): 1, ("f", 0): 1, ("f", 99): 1, ("f", 100): 2, ("f", 300): 3, ("g", 5): None}


def test_coalesced_changes_of_a_hot_key(spark):
    """Folding segments gives what folding all changes in order gives."""
    draw = random.Random(3)
    rows = [(0 if i % 3 else i % 20, draw.randrange(10**6), i, draw.choice(["create", "modify", "delete", "rename"])) for i in range(3000)]
    held = {}
    for key, _, _, op in sorted(rows, key=lambda r: r[1:3]):
        held[key] = fold(held.get(key, ""), op)
    changes = spark.createDataFrame(rows, "key long, ts long, seq long, op string")
    for size in (1000, 100_000):
        got = {r["key"]: r["op"] for r in sync.coalesced(changes, F.floor(F.col("ts") / size)).collect()}
        assert got == {k: op for k, op in held.items() if op}


def test_normalised_text_and_pages(spark):
    texts = ["ＡＢＣ \t x\r\n\n\n\n  ﬁn  \n \x0bend ", "", "  ", "a\u00a0b\n\n\nc"]

    def plain(t):
        t = re.sub(r"\n{3,}", "\n\n", re.sub(" {2,}", " ", re.sub(r"[\t\r\f\v]+", " ", unicodedata.normalize("NFKC", t))))
        return "\n".join(x.strip(" ") for x in t.split("\n")).strip(" \n")

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalised(F.col("t")).alias("x"))
    assert {r["i"]: r["x"] for r in rows.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    page = "<p>caf&eacute; &#8217; &amp;lt;</p><!-- &amp; --><br>x"
    got = spark.createDataFrame([(page,)], "t string").select(T.html_to_text(F.col("t")).alias("x")).first()["x"]
    assert got == html.unescape("caf&eacute; &#8217; &amp;lt;\nx")
    one = lambda col, *row: spark.createDataFrame([row], "t string").select(col(F.col("t")).alias("x")).first()["x"]
    assert one(T.html_to_text, "<div>a</div><p>b</p> \n \n<td>c</td><SCRIPT>x</SCRIPT>") == "a\nb \n\nc" and one(T.html_to_text, None) == ""
    nested = "<html><head><title>T</title></head><body>a<b>b</b> &amp;lt; <nav>x<nav>y</nav>z</nav><aside><header>q</header>r</aside>\n c<!-- d --><script>'</nav>'</script></body></html>"
    assert one(T.main_text, nested) == "ab &lt; c" and one(T.main_text, None) == "" and one(T.main_text, "plain &eacute;") == "plain é"
    assert one(lambda t: T.truncate_chars(t, 0), "ab") == T.NO_ROOM and one(lambda t: T.truncate_chars(t, 10), "x" * 41) == T.NO_ROOM and one(lambda t: T.truncate_chars(t, 10), "x" * 40) == "x" * 40
    room = 400 - len(T.CUT_NOTICE)
    assert one(lambda t: T.truncate_chars(t, 100), "x" * (room - 5) + "\n" + "y" * 500) == "x" * (room - 5) + T.CUT_NOTICE
    assert one(lambda t: T.truncate_chars(t, 100), "x\n" + "y" * 900) == "x\n" + "y" * (room - 2) + T.CUT_NOTICE
    assert [one(lambda t: T.duration(t.cast("long")), str(ms)) for ms in (0, 59_990, 120_000, 123_000, 3_600_000, 3_720_000)] == ["0.00s", "59.99s", "2m", "2m 3s", "1h", "1h 2m"]
    assert [one(lambda t: T.byte_size(t.cast("long")), str(b)) for b in (0, 100, 1024, 1536, 1234567, 20 << 20, 5 << 40)] == ["0 Bytes", "100 Bytes", "1 KB", "1.5 KB", "1.18 MB", "20 MB", "5120 GB"]
    assert one(T.query_label, "  a \n\t b  ") == '"a b"' and one(T.query_label, "y" * 31) == '"' + "y" * 30 + '..."'
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        shown = lambda c: F.date_format(T.ical_time(c), "yyyy-MM-dd HH:mm")
        assert [one(shown, t) for t in ("20240131T090000Z", "20240131T090000", "20240131")] == ["2024-01-31 18:00", "2024-01-31 09:00", "2024-01-31 00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_text_functions(spark):
    one = lambda col, text: spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]
    assert one(T.nfkc, "ＡＢＣ") == "ABC" and one(T.tidy, "a\n\n\n\n\nb") == "a\n\nb" and one(T.tidy, "  x  \n  y  ") == "x\ny"
    assert one(lambda t: T.grade(t, F.lit("Paris"), F.array(F.lit("Lutetia"))), "I don't know") == "missing"
    assert one(lambda t: T.grade(t, F.lit("Paris"), F.array(F.lit("Lutetia"))), "  PARIS ") == "correct"
    assert one(lambda t: T.grade(t, F.lit("Paris"), F.array().cast("array<string>")), "Rome") is None
    assert one(T.duration, None) is None and one(T.unescape, "a &eacute;&#39;") == "a é'"
    windows = one(lambda t: T.token_windows(T.tokens(t), 4, 1), "a b c d e f g h i j")
    assert [w["idx"] for w in windows] == [0, 1, 2] and windows[2]["tokens"] == ["g", "h", "i", "j"]


def test_words_of_scripts_without_spaces(spark):
    rows = [(1, "a/1.md", "t", "東京都に行きました"), (2, "a/2.md", "t", "我喜欢吃苹果。Das ist gut"), (3, "a/3.md", "t", "ภาษาไทยง่าย"), (4, "a/4.md", "t", "plain words"), (5, "a/5.md", "t", None)]
    notes = spark.createDataFrame(rows, "doc_id long, file_path string, title string, content string")
    words = {r["doc_id"]: r["w"] for r in notes.select("doc_id", T.tokens(F.col("content")).alias("w")).collect()}
    assert words[1] == ["東京", "京都", "に", "行", "きました"] and words[2] == ["我喜", "喜欢", "欢吃", "吃苹", "苹果", "das", "ist", "gut"]
    assert "".join(words[3]) == "ภาษาไทยง่าย" and len(words[3]) > 1 and words[4] == ["plain", "words"] and words[5] == []
    asked = spark.createDataFrame([(1, "東京"), (2, "苹果"), (3, "行")], "query_id long, text string")
    found = bm25.score(corpus.index_entries(notes), asked, titles=False).select("query_id", "file_path").collect()
    assert sorted(map(tuple, found)) == [(1, "a/1.md"), (2, "a/2.md"), (3, "a/1.md")]


def test_a_query_is_cut_to_what_the_reranker_can_hold(spark):
    asked = spark.createDataFrame([(1, list("abcdef")), (2, list("abc")), (3, list("ab"))], "query_id long, tokens array<string>")
    texts = spark.createDataFrame([(1, list("x" * 5)), (1, list("y" * 8)), (2, list("z" * 60))], "query_id long, tokens array<string>")
    assert {r["query_id"]: "".join(r["tokens"]) for r in search.fitted(asked, texts, 44).collect()} == {1: "abcd", 2: "abc", 3: "ab"}


def test_chunker_invariants():
    assert chunker.chunk("", 5, 0) == chunker.chunk(" \n\t\n", 5, 0) == []
    assert chunker.chunk("   text", 5, 0) == [("text", [], 3)]
    text = "# A\n## B\nsome words here\n### C\nmore words\n## D\nthe last words of it"
    out = chunker.chunk(text, 6, 0)
    assert all(text.startswith(c, at) for c, _, at in out)
    assert next(h for c, h, _ in out if "last" in c) == ["A", "D"]
    long = chunker.chunk("a" * 300, 5, 0, count=len)
    assert "".join(c for c, _, _ in long).replace("\n", "") == "a" * 300 and all(len(c) <= 5 for c, _, _ in long)
    lines = "\n".join(f"line {i} has words" for i in range(40))
    plain = chunker.chunk(lines, 20, 0)
    assert sorted(x for c, _, _ in plain for x in c.split("\n")) == sorted(lines.split("\n"))
    shared = chunker.chunk(lines, 20, 6)
    assert all(set(a[0].split("\n")) & set(b[0].split("\n")) for a, b in zip(shared, shared[1:], strict=False))
    assert all(chunker.count_words(c) <= 20 for c, _, _ in shared)
    with pytest.raises(ValueError):
        chunker.chunk("a", 0, 0)


def test_chunks_carry_whole_lines_within_the_overlap():
    words = lambda t: len(t.split())
    out = chunker.chunk("a b\nc d\ne f\ng h i j k l m n", 10, 4, words)
    assert [c for c, _, _ in out] == ["a b\nc d\ne f", "e f\ng h i j k l m n"]
    assert [c for c, _, _ in chunker.chunk("a b\nc d\ne f\ng h", 6, 2, words)] == ["a b\nc d", "c d\ne f", "e f\ng h"]
    assert [c for c, _, _ in chunker.chunk("a b\n" + "x " * 19 + "x\nc d\ne f g h i j k", 25, 5, words)][1].startswith("c d\n")  # the long line is not skipped over
    # Ten lines are counted as one text: line ends cost nothing there.
    assert len(chunker.chunk("\n".join("a b" for _ in range(10)), 20, 0, words)) == 1
    assert len(chunker.chunk("\n".join("a b" for _ in range(11)), 20, 0, words)) == 2


def test_headings_are_those_at_the_end_of_a_chunk():
    words = lambda t: len(t.split())
    assert chunker.chunk("# H1\n## H2\n### H3\n#### H4\ncontent under H4", 50, 10, words)[0][1] == ["H1", "H2", "H3"]
    text = "# H1\n## H2\n### H3\ncontent under H3\n## Another H2\ncontent under Another H2"
    assert next(h for c, h, _ in chunker.chunk(text, 14, 5, words) if "under Another H2" in c) == ["H1", "Another H2"]
    out = chunker.chunk("# Title\n## Subtitle\nparagraph one with some text here\n## Another Subtitle\nparagraph two with more text", 12, 0, words)
    assert len(out) > 1 and all(h == ["Title", "Another Subtitle"] if "Another" in c else "Title" in h for c, h, _ in out)
    assert out[0][1] == ["Title", "Subtitle"]


@pytest.mark.parametrize("text, most, overlap", [("   Hello world", 50, 10), ("line one\nline two\nline three\nline four\nline five\nline six", 10, 0), ("alpha beta gamma\ndelta epsilon zeta\neta theta iota\nkappa lambda mu", 12, 5), ("First sentence here. Second sentence follows. Third sentence continues. Fourth sentence ends.", 5, 0), (f"before {'x' * 200} after", 10, 0), ("a \n  b. c d e f g.  h i j k l \n\n" * 5, 4, 0)])
def test_chunks_tell_where_they_start(text, most, overlap):
    out = chunker.chunk(text, most, overlap, lambda t: max(len(t.split()), len(t) // 20))
    assert out and all(text.startswith(c.split("\n")[0], at) for c, _, at in out)


def test_long_lines_are_cut_at_sentences_then_at_spaces():
    words = lambda t: len(t.split())
    assert chunker.split_line("one two. three four! five", 7, 2, words) == [("one two.", 7), ("three four!", 16), ("five", 28)]
    assert chunker.split_line("a b c d e", 0, 2, words) == [("a b", 0), ("c d", 4), ("e", 8)]
    assert "".join(t for t, _ in chunker.split_line("x" * 90, 0, 7, len)) == "x" * 90


def test_character_windows():
    text = "x" * 14_300
    assert [len(w) for w in chunker.char_windows(text, "T")] == [7500, 7303, 303]
    assert chunker.char_windows("short", "T") == ["T\n\nshort"]
    broken = chunker.char_windows("s" * 7400 + ". " + "t" * 3000, "T")
    assert broken[0].endswith(".") and len(broken[0]) == 7404 and broken[1].startswith("s" * 498 + ". ")


def test_query_builders():
    text = "\n".join(f"l{i} w w" for i in range(9))
    assert chunker.centre_window(text, 4, 9) == "l3 w w\nl4 w w\nl5 w w"
    assert chunker.centre_window(text, 99, 3) == "l8 w w"
    assert chunker.selection(text, 1, 3, 6) == "l1 w w\nl2 w w"
    assert chunker.note_query("body", "Title", 0, 64) == "Title\n\nbody"
    assert chunker.centre_window("one  two three\n\n\nlast", 0, 2) == "one two" and chunker.centre_window("a\n\nb c\n\nd", 2, 2) == "b c"
    assert chunker.centre_window("a\n\nb c\nd", 2, 3) == "\nb c\nd" and chunker.leading_words(" a  b c", 2, chunker.count_words) == " a b"
    assert chunker.selection("a b\n" + "w  " * 20, 0, 1, 14) == "a b\n" + " ".join("w" * 12) and chunker.selection(text, 3, 3, 2) == "l3 w"
    assert chunker.rerank_query("a b c d", 10, 44) == "a b " and chunker.rerank_query("a b", 10, 20) == "a b"
    assert len(chunker.fit("word " * 100, 10)) <= 100


def test_preparation(spark):
    pages = spark.createDataFrame([(5, "u?a"), (3, "u"), (4, " "), (9, "v#x"), (7, None)], "page_id long, url string")
    assert sorted(tuple(r) for r in prepare.first_by_url(pages).collect()) == [("u", 3, 0), ("u?a", 5, 1), ("v#x", 9, 2)]
    bare = F.regexp_replace("url", r"[?#].*$", "")
    assert sorted(tuple(r) for r in prepare.first_by_url(pages, bare).collect()) == [("u", 3, 0), ("v", 9, 1)]
    lines = spark.createDataFrame([('{"id": 1}',), ("",), ('{"id": \x01 2}',), ('{"id"',)], "value string")
    assert sorted(r["id"] for r in corpus.tolerant_json(lines, "id int").collect()) == [1, 2]
    run = spark.createDataFrame([("q Q0 d 1 0.5 r",), ("short line",)], "value string")
    assert [tuple(r) for r in corpus.parse_run(run).collect()] == [("q", "d", 1, 0.5, "r")]


def test_query_builders_for_selections():
    from tessera.functions import chunker

    assert chunker.selected_query("a b c", "", 10, None) == "a b c"
    assert chunker.selected_query("one two three " * 10, "t", 5, None) == "t\n\n" + " ".join(["one two three"] * 3 + ["one"])
    assert chunker.selected_query("x " * 30, "t", 12, 40) == "t\n\n" + " ".join("x" * 23)
    assert chunker.selected_query("a.b.c.d.e.f.g.h.i.j.k.l", "", 10, None) == "a.b.c.d.e.f.g.h.i.j."
    assert chunker.selection("a b\nc d\ne f", 1, 2, 2) == "c d"
    assert len(chunker.fit("w " * 400, 100)) <= 200 and chunker.fit("short text", 1) == "short text"


def test_combined_rows_prefer_dense_then_content(spark):
    rows = lambda *r: spark.createDataFrame([(1, *x) for x in r], "query_id long, file_path string, score double, top_chunk string, chunk_count long")
    dense, lexical = rows(("a", 2.0, "a#1", 4)), rows(("a", 9.0, "a#7", 1), ("b", 5.0, "b#2", 2))
    base = ("top_chunk", "chunk_count")
    fused = {r.file_path: (r.top_chunk, r.chunk_count) for r in ranking.reciprocal_ranks([(dense, 0.6), (lexical, 0.4)], "file_path", base=base).collect()}
    assert fused == {"a": ("a#1", 4), "b": ("b#2", 2)}
    both = ranking.combine(dense, lexical, 1.0, 3.0, 5, base).collect()
    assert {r.file_path: (r.score, r.top_chunk) for r in both} == {"a": (7.25, "a#7"), "b": (3.75, "b#2")}
    assert ranking.split_limit(51, 0.6, 0.4, up=True) == (31, 21) and ranking.split_limit(50, 0.6, 0.4, up=True) == (30, 20)


def test_model_hooks(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", None, "", "123", "aab"])], "id long, text string")
    got = {r.id: (r.embedding and r.embedding[:2], r.broken) for r in models.embed(rows, "text", batch=2).collect()}
    assert got == {0: ([0.5, 0.5], False), 1: (None, True), 2: (None, True), 3: (None, True), 4: ([2 / 3, 1 / 3], False)}
    assert models.embed(rows.limit(0), "text").columns == ["id", "text", "embedding", "broken"]
    found = spark.createDataFrame([(1, "x y", "c", "x"), (1, "x y", "b", "y x"), (1, "x y", "a", "z x"), (2, None, "a", None)], "query_id long, query string, chunk_id string, content string")
    assert [tuple(r) for r in models.rerank(found, 2).orderBy("query_id", "rank").collect()] == [(1, "b", 1.0, 1), (1, "a", 0.5, 2), (2, "a", 0.0, 1)]


def test_context_links(spark):
    df = spark.createDataFrame([("f/a.md", ["# Top", "## Sub #1"]), ("b.md", [])], "p string, h array<string>")
    assert [r[0] for r in df.select(T.context_block(F.col("p"), F.col("h"), F.lit("c"))).collect()] == ["[[f/a#Sub #1]]\nc", "[[b]]\nc"]
