"""Small files of any Hadoop file system, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder of whatever file system Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark._jvm
        self._jvm, self._conf = jvm, spark._jsc.hadoopConfiguration()
        self.root = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self.root.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.root, name) if name else self.root

    def names(self, below: str = "") -> list[str]:
        at = self._at(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        return self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(self._fs.open(self._at(name))).decode()

    def publish(self, name: str, text: str, draft: str) -> bool:
        """Write a file whole or not at all: under the name ``draft``, then renamed. False, if there is one of that name."""
        from py4j.protocol import Py4JJavaError

        stream = self._fs.create(self._at(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(draft).toUri() if self._at(draft).toUri().getScheme() else self._fs.getUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._at(draft)), self._fs.makeQualified(self._at(name)), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self.remove(draft)
            return False
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def size(self, name: str = "") -> tuple[int, int]:
        """(files, bytes) below."""
        at = self._at(name)
        if not self._fs.exists(at):
            return 0, 0
        found = self._fs.getContentSummary(at)
        return found.getFileCount(), found.getLength()
