"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, quoted, stored, without
from .words import _BASE, mix, word_hashes

#: Feature hashes keep so many bits.
BITS = 20
#: Labelled documents that the model is fitted on, at most, chosen by a hash of their ids.
SAMPLE = 30_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
#: Log-odds before any evidence: without weights a document is not toxic.
PRIOR = -2.0
#: From this score on a document counts as toxic.
TOXIC = 0.5
#: One label in so many folds is held out.
FOLDS = 5


def features(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, index) of the words, word pairs and pairs that skip a word; none crosses documents."""
    docs, found = [doc], [words]
    for gap in (1, 2):
        if len(words) > gap:
            whole = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][whole])
            found.append(mix(words[:-gap] * _BASE + words[gap:] + np.uint64(gap))[whole])
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, words, ends in word_hashes(texts):
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        yield first, len(ends), *features(words, doc)


class Ftrl:
    """Per-coordinate learning rates; a coordinate whose gradients stay within L1 has weight 0."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, label: int) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + PRIOR, -35, 35))) - label
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task reads the bounded sample and yields the weights that are not 0; the last index is the bias."""
    rows: list[tuple[int, np.ndarray, int]] = []
    for batch in batches:
        labels, order = batch["label"].to_pylist(), batch["h"].to_pylist()
        for first, n, doc, index in _runs(batch["text"]):
            each = np.unique(doc * (1 << BITS) + index)
            cuts = np.searchsorted(each, np.arange(n + 1) << BITS)
            for k in range(n):
                own = each[cuts[k] : cuts[k + 1]] - (k << BITS)
                rows.append((order[first + k], np.append(own, 1 << BITS).astype(np.int32), labels[first + k]))
    rows.sort(key=lambda r: r[0])
    model = Ftrl((1 << BITS) + 1)
    for _ in range(EPOCHS):
        for _, i, label in rows:
            model.learn(i, label)
    w = model.weights()
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["index", "weight"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(index, weight) of the model that ``labels`` teach; rows of the held-out fold are not used.

    At most ``sample`` labelled ids are drawn by hash (a broadcast of that bounded size); an id with
    several labels counts as its highest, and of several documents with one id the one whose text has the least hash is read.
    Labels other than 0 and 1, and null ids, are left out. Without labels there are no weights.
    """
    usable = labels.select(quoted(id_col)[0].alias("id"), quoted(label_col)[0].cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    taught = usable.where(F.crc32(F.col("id").cast("string")) % FOLDS != 0).groupBy("id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("id"))
    drawn = stored(taught.orderBy("h", "id").limit(sample), "label-sample")
    rows = docs.select(quoted(id_col)[0].alias("id"), quoted(text_col)[0].alias("text")).join(F.broadcast(drawn), "id")
    rows = rows.groupBy("id", "label", "h").agg(F.min(F.struct(F.xxhash64("text").alias("order"), "text")).alias("one"))
    return stored(rows.select("one.text", "label", "h").coalesce(1).mapInArrow(_fit, "index long, weight double"), "weights")


def _scorer(index: list[int], weight: list[float]):
    table = np.zeros((1 << BITS) + 1)
    table[np.asarray(index, np.int64)] = weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.full(batch.num_rows, table[1 << BITS] + PRIOR)
            for first, n, doc, i in _runs(batch["text"]):
                known = table[i] != 0
                each = np.unique(doc[known] * (1 << BITS) + i[known])
                total[first : first + n] += np.bincount(each >> BITS, table[each & ((1 << BITS) - 1)], n)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["row", "score"])

    return run


def score(docs: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """Add score, between 0 and 1, the higher the likelier toxic; only the text is read for it.

    A null or empty text gets the score of the bias alone. The weights have at most ``2**BITS + 1``
    rows, fewer by L1, and travel with the tasks. Same-named columns are replaced.
    """
    weights = model.collect()
    rows = docs.select(packed(docs, "score").alias("row"), quoted(text_col)[0].alias("text"))
    schema = rows.select("row", F.lit(0.0).alias("score")).schema
    out = rows.mapInArrow(_scorer([r["index"] for r in weights], [r["weight"] for r in weights]), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in without(docs, "score")], "score")
