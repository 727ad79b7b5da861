"""Results of long runs, appended part by part so that each id stands there once, however often a run stops and starts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import Folder


class RunLog:
    """A table below ``root`` of parts that a log names; a part that was cut off is in no log and is never read.

    ``schema`` is that of the results, ``key`` the column that names a result. The log's entries are numbered and published whole, so of two
    writers of one number the second tries again behind the first, with what that one has not written.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str) -> None:
        self.spark, self.root, self.schema, self.key, self.folder = spark, root.rstrip("/"), schema, key, Folder(spark, root)

    def _entries(self) -> list[str]:
        return [n for n in self.folder.names("log") if n.endswith(".json")]

    def read(self) -> DataFrame:
        parts = [json.loads(self.folder.read(f"log/{n}"))["part"] for n in self._entries()]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/parts/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)

    def pending(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose key has no result yet."""
        return wanted.join(self.read().select(self.key), self.key, "left_anti")

    def append(self, results: DataFrame) -> int:
        """Add the results whose keys are not there, one of each key (the least row); how many those were."""
        columns = results.columns
        first = F.min(F.struct(*[c for c in columns if c != self.key])).alias("row")
        while True:
            entries = self._entries()
            part = uuid.uuid4().hex
            one = self.pending(results).groupBy(self.key).agg(first).select(*[self.key if c == self.key else f"row.{c}" for c in columns])
            one.write.parquet(f"{self.root}/parts/{part}")
            n = self.spark.read.schema(self.schema).parquet(f"{self.root}/parts/{part}").count()
            if not n:
                self.folder.remove(f"parts/{part}")
                return 0
            if self.folder.publish(f"log/{len(entries):012d}.json", json.dumps({"part": part, "rows": n}), f"log/draft-{part}"):
                return n
            self.folder.remove(f"parts/{part}")  # another writer was first: its keys are known now

    def recover(self) -> list[str]:
        """Drop parts that no entry names, for the only writer; their names."""
        named = {json.loads(self.folder.read(f"log/{n}"))["part"] for n in self._entries()}
        lost = [p for p in self.folder.names("parts") if p not in named]
        for p in lost:
            self.folder.remove(f"parts/{p}")
        return lost
