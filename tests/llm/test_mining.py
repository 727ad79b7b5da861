"""Phrases, the streaming transducer and the prefix trie against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases, prefix_trie, registry, transducer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


# --- phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(docs, support, longest=4, best=2000):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    good = {k: a for k, a in f.items() if a >= support and len(k[1]) > 1}
    longer = defaultdict(int)
    for (lang, p), a in good.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], a)
    rows = defaultdict(list)
    for (lang, p), a in good.items():
        if 100 * longer[lang, p] < 80 * a:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, total[lang], -s) for lang, own in rows.items() for r, (s, a, p, left, right) in enumerate(sorted(own)[:best]))


def texts_of(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Le", "the", "of", "né", "中", "x1", "a\x00b", "tail", "wide", "open"]
    for _ in range(n):
        yield "".join(rng.choice(vocabulary[: rng.choice([3, 10])]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(rng.randrange(0, 60)))


PHRASE_ROWS = [(rng_lang, t) for rng_lang, t in zip(["en", "de", None, "en", "en"] * 60, texts_of(4, 300), strict=True)]
PHRASE_ROWS += [("en", None), (None, ""), ("zz", " .\n"), ("en", "one long piece " * 3000), ("en", "Copy of a text")] + [("en", "Copy of a text")] * 40


@pytest.mark.parametrize("sample", ["none", "some", "all"])
@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_phrases_equal_brute_force_whatever_the_sample(spark, sample, block):
    df = spark.createDataFrame(PHRASE_ROWS, "lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    column = {"none": F.lit(False), "some": F.pmod(F.xxhash64("text"), F.lit(3)) == 0, "all": F.lit(True)}[sample]
    got = phrases.collocations(df, support=12, best=25, sample=column, block_bytes=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(PHRASE_ROWS, 12, best=25)


def test_phrases_of_long_texts_and_exact_products(spark):
    rows = [("en", "new york city " * 90_000), ("en", "york new. " * 5)]
    got = [tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), support=30).collect()]
    assert sorted(got) == brute_phrases(rows, 30)
    wide = spark.sql(f"SELECT ({phrases.SCALE}BD * cast(9000000000000000000 AS decimal(20,0))) div (cast(9000000000000000001 AS decimal(20,0)) + 9000000000000000000) AS s").first()["s"]
    assert wide == 2_000_000 * 9_000_000_000_000_000_000 // 18_000_000_000_000_000_001


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 64)
    df = spark.createDataFrame(PHRASE_ROWS, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(df, support=12, best=25).collect())) == brute_phrases(PHRASE_ROWS, 12, best=25)


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "a b c")], "lang string, text string")).count() == 0


# --- transducer

ODD = [
    None, "", " \n\t ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|EndOfText|> <|endoftext|", "Don't we'll 'S it's", "ΑΣ ΣΣ İstanbul É é ́x", "a\x1cb\x1d \x85 c d　e",
    "中文 字 12³½ Ⅷ", "😀👍🏽 ‍", "x" * 5000, "th" * 3000 + " exhilarating" * 40, "atingexhilaratingtsegregreeninghehefty" * 150, "\x00 \x7f", "ß ẞ ǅ ﬁ", "﻿ a", "same", "same",
]


def random_texts(n):
    rng = random.Random(11)
    for _ in range(n):
        yield "".join(rng.choice([chr(rng.randrange(1, 0x250)), chr(rng.randrange(0x300, 0x3000)), chr(rng.randrange(0x3000, 0xD7FF)), chr(rng.randrange(0xE000, 0x1FFFF)), rng.choice("abc'st 12.,- \n\t")]) for _ in range(rng.randrange(1, 40)))


def encoded(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("step, held", [(4 << 20, 250_000), (300, 5)])
def test_transducer_equals_the_library_and_decodes(spark, library, step, held):
    texts = [*ODD, *random_texts(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("IDS", F.lit("clash")).withColumn("decoded", F.lit(1)).repartition(3)
    out = transducer.encode(df, PATH, step_bytes=step, held=held)
    assert out.columns == ["doc_id", "text", "decoded", "ids"]
    rows = sorted(transducer.decode(out, PATH).collect(), key=lambda r: r["doc_id"])
    expected = encoded(library, texts)
    assert [r["ids"] for r in rows] == expected
    assert [r["decoded"] for r in rows] == [library.decode(e, skip_special_tokens=False) for e in expected]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert transducer.decode(transducer.encode(empty, PATH), PATH).count() == 0


@pytest.mark.parametrize("step, held", [(4 << 20, 250_000), (300, 5)])
def test_a_round_trip_takes_one_python_step(spark, library, step, held):
    """Two steps in one task are two workers, each with its tables and memory of its own."""
    texts = [*ODD, *random_texts(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("IDS", F.lit("clash")).withColumn("Decoded", F.lit(1)).repartition(3)
    out = transducer.round_trip(df, PATH, step_bytes=step, held=held)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    expected = encoded(library, texts)
    assert [(r["ids"], r["decoded"]) for r in sorted(out.collect(), key=lambda r: r["doc_id"])] == [(e, library.decode(e, skip_special_tokens=False)) for e in expected]
    assert transducer.round_trip(df.limit(0), PATH).count() == 0


def test_a_window_gives_what_the_whole_piece_gives(library):
    merges = transducer.Merges(PATH)
    rng = random.Random(2)
    parts = [t for t in library.get_vocab() if t.isascii() and t.isalpha() and len(t) > 2]
    whole = ["".join(rng.choice(parts) for _ in range(900)), "ab" * 2500, "".join(rng.choice("aeth") for _ in range(6000))]
    flat, count = merges.pieces([w.lower().encode() for w in whole])
    assert [t.tolist() for t in np.split(flat, np.cumsum(count)[:-1])] == encoded(library, whole)
    assert min(map(len, whole)) > merges.window > merges.lookahead > 0


def test_the_lookahead_is_sufficient(library):
    """Tokens that end ``lookahead`` symbols before what is read stay, whatever follows; a small vocabulary makes chains likely."""
    merges = transducer.Merges(PATH)
    rng = random.Random(8)
    for _ in range(40):
        head = "".join(rng.choice(["exhilar", "at", "t", "se", "gre", "he", "f", "b", "d", "a"]) for _ in range(500))
        seen = []
        for tail in ("", "ating", "greening", "hefty", "x"):
            tok, _ = merges.pieces([(head + tail + "q").encode()])
            ends = np.cumsum(merges.sizes[tok])
            seen.append(tok[ends <= len(head) - merges.lookahead].tolist())
        assert seen.count(seen[0]) == len(seen) and seen[0]


def test_a_text_over_the_step_and_a_long_piece(spark, library):
    texts = ["word <|endoftext|> and more. " * 40_000, "q" * 1_200_000]
    out = transducer.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, step_bytes=1 << 18).collect()
    assert [r["ids"] for r in sorted(out, key=lambda r: r["doc_id"])] == encoded(library, texts)


def test_decoder_is_incremental(library):
    merges = transducer.Merges(PATH)
    text = "naïve 😀 中文 <|endoftext|> don't"
    ids = np.array(library.encode(text, add_special_tokens=False).ids)
    for form in ("tokens", "text"):
        whole, machine = transducer.Decoder(merges, form), transducer.Decoder(merges, form)
        got = "".join(machine.feed(ids[i : i + 1]) for i in range(len(ids))) + machine.feed(ids[:0], True)
        assert got == whole.feed(ids, True)
    assert got == "naïve 😀 中 文 <|endoftext|>don 't " or got.replace(" ", "") == text.replace(" ", "")


# --- prefix trie


def brute_trie(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]
    convs = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            convs[c].append((n is not None, n or 0, digest(r or "", t or ""), (r or "", t or "")))
    own = {c: [x[-1] for x in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def conversations():
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 90), *range(5000, 5020), -3, -20, -41, 2**40]:
        for n in range(rng.choice([1, 2, 3, 5, 9, 17])):
            rows.append((c, n, rng.choice(["user", "assistant"]), rng.choice(["a b", "hello  there\tyou", "", "x"])))
    for c in range(200, 260):  # equal conversations, longer than two blocks
        rows += [(c, n, "user", f"turn {n}") for n in range(20)]
    rows += [(300, n, "user", "long") for n in range(400)] + [(301, n, "user", "long") for n in range(390)]
    rows += [(310, None, None, None), (310, None, "user", "z"), (310, 1, None, "tie"), (310, 1, "user", "tie"), (310, 1, "user", "tie"), (None, 1, "user", "nobody's"), (320, 0, "user", "w " * 400_000)]
    return rows


@pytest.mark.parametrize("ranges", ["true", "false"])
def test_trie_equals_brute_force(spark, ranges):
    rows = conversations()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", ranges)
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("clash"), "pos": F.lit(0), "block": F.lit(1)}).repartition(3)
        out = prefix_trie.trie(df)
        assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        got = sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    for rows in ([], [(None, 1, "a", "b")]):
        assert prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 0


# --- registered queries

SF = "/root/testdata/sf0.001"


def test_registered_queries(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.op12_transducer(spark, SF).collect()}
    assert set(got) == set(docs)
    for (i, _), ids in zip(docs.items(), encoded(library, docs.values()), strict=True):
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert sorted(tuple(-1 if v is None else v for v in r) for r in registry.op13_prefix_trie(spark, SF).collect()) == brute_trie(rows)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()
    assert sorted(map(tuple, registry.op11_phrases(spark, SF).collect())) == brute_phrases([tuple(r) for r in table], 30)


def test_arrow_slices(library):
    encoder = transducer.Encoder(PATH)
    flat, lens = encoder.texts(pa.array(["zero", "one two", None, "three"]).slice(1))
    assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == encoded(library, ["one two", "", "three"])
