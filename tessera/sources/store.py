"""Where the lexical index of the notes of a folder of tables lies."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import bm25
from tessera.operators.segments import Conflict, Store
from tessera.sources import corpus
from tessera.sources.scratch import scratch

#: Names the folder of indexes that outlive their session.
INDEX_DIR = "tessera.index.dir"
_OWN: dict[str, str] = {}


def index_root(spark: SparkSession) -> str:
    """The folder that ``tessera.index.dir`` names; where it is unset, one of this application."""
    named = spark.conf.get(INDEX_DIR, None)
    app = spark.sparkContext.applicationId
    if not named and app not in _OWN:
        _OWN[app] = scratch(spark, "indexes")
    return (named or _OWN[app]).rstrip("/")


def lexical_store(spark: SparkSession, sf_dir: str) -> Store:
    """The index of the notes in ``sf_dir``, opened if one of their state (number, size and last change of the files) is there, else built."""
    file = corpus.table(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = file.agg(F.count("*"), F.sum("file_size"), F.max("file_modification_time")).first()
    store = Store(spark, f"{index_root(spark)}/{hashlib.sha256(repr((sf_dir, *state)).encode()).hexdigest()[:24]}")
    if not store.versions():
        try:
            store.build(corpus.index_entries(corpus.files(spark, sf_dir)))
        except Conflict:  # another session built it meanwhile
            store.recover()
    return store


def lexical_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return lexical_store(spark, sf_dir).snapshot()
