"""Hooks for models: texts to vectors in batches, and a query's candidates to scores. A model is any function; stand-ins need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructType

#: Texts that a model gets in one call.
BATCH = 32
#: The letters that the stand-in counts.
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[str, list[str]], Sequence[float]]


def letters(texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for an embedder: the shares of a to z among a text's lower-case ones; NaN where there are none."""
    counts = np.array([[t.count(c) for c in ALPHABET] for t in texts], np.float64).reshape(-1, len(ALPHABET))
    with np.errstate(invalid="ignore"):
        return counts / counts.sum(axis=1, keepdims=True)


def embed(rows: DataFrame, text_col: str, embedder: Embedder = letters, batch: int = BATCH) -> DataFrame:
    """Add embedding (doubles) and broken: whether the vector holds NaN or infinity, in which case it is null.

    ``embedder`` gets up to ``batch`` texts at a time inside tasks; a null text counts as empty. It must
    return a vector for each text, all of one length.
    """
    own = rows.drop("embedding", "broken")
    schema = StructType([*own.schema.fields]).add("embedding", ArrayType(DoubleType())).add("broken", BooleanType())
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for i in range(0, held.num_rows, batch):
                part = held.slice(i, batch)
                texts = [t or "" for t in part[text_col].to_pylist()]
                vectors = np.asarray(embedder(texts), np.float64)
                if vectors.ndim != 2 or len(vectors) != len(texts):
                    raise ValueError(f"{len(texts)} texts gave vectors of shape {vectors.shape}")
                bad = ~np.isfinite(vectors).all(axis=1)
                values = pa.array([None if b else v.tolist() for v, b in zip(vectors, bad.tolist(), strict=True)], pa.list_(pa.float64()))
                arrays = [*part.columns, values, pa.array(bad)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, shape, strict=True)], schema=shape)

    return own.mapInArrow(run, schema)


def overlap(query: str, texts: list[str]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: the share of a query's distinct words that each text holds."""
    asked = set(query.lower().split())
    return [len(asked & set(t.lower().split())) / max(1, len(asked)) for t in texts]


def rerank(candidates: DataFrame, top_n: int, scorer: Scorer = overlap) -> DataFrame:
    """(query_id, chunk_id, score, rank): each query's candidates (query_id, query, chunk_id, content) scored in one call, the best ``top_n``.

    A query's candidates make one group, so the retrieval before must have a limit. Ties go to the smaller chunk_id; no candidates give no rows.
    """
    q_type = candidates.schema["query_id"].dataType.simpleString()

    def run(held: pa.Table) -> pa.Table:
        scores = scorer(held["query"][0].as_py() or "", [t or "" for t in held["content"].to_pylist()])
        if len(scores) != held.num_rows:
            raise ValueError(f"{held.num_rows} candidates gave {len(scores)} scores")
        ids, score = held["chunk_id"].to_pylist(), [round(float(s), 6) for s in scores]
        best = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:top_n]
        return held.select(["query_id", "chunk_id"]).take(pa.array(best, pa.int64())).append_column("score", pa.array([score[i] for i in best], pa.float64())).append_column("rank", pa.array(range(1, len(best) + 1), pa.int32()))

    return candidates.select("query_id", "query", "chunk_id", F.col("content")).groupBy("query_id").applyInArrow(run, f"query_id {q_type}, chunk_id string, score double, rank int")
