"""Small files of the driver in any folder that Spark reaches: on its disk, in HDFS, in an object store."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

#: Characters that go to the file system at once.
CHUNK = 1 << 20


class Folder:
    """Whole files of one folder, read, and replaced as a whole: written beside and renamed, never half written.

    The session's own settings reach the file system, so a folder that Spark reads is one that this writes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/") or "/", spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._path("")
        # An instance of its own: files that are also edited by hand get no checksums beside them.
        self._fs = self._jvm.org.apache.hadoop.fs.FileSystem.newInstance(root.toUri(), self._conf)
        self._fs.setWriteChecksum(False)
        self._fs.setVerifyChecksum(False)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.of(name))

    def of(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def any(self, pattern: str) -> bool:
        """Whether a file's path in the folder fits the pattern."""
        found = self._fs.globStatus(self._path(pattern))
        return found is not None and len(found) > 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def replace(self, name: str, parts: Iterable[str]) -> None:
        """The file made of ``parts``, a chunk of them in memory at a time."""
        beside = self._path(name + ".tmp")
        stream = self._fs.create(beside, True)
        held, size = [], 0
        try:
            for part in parts:
                held.append(part)
                size += len(part)
                if size >= CHUNK:
                    stream.write(bytearray("".join(held), "utf-8"))
                    held, size = [], 0
            stream.write(bytearray("".join(held), "utf-8"))
            stream.hsync()
        finally:
            stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        kinds = self._jvm.java.lang.reflect.Array.newInstance(fs.Options.Rename.OVERWRITE.getDeclaringClass(), 1)
        kinds[0] = fs.Options.Rename.OVERWRITE
        whole = self._fs.makeQualified(beside)
        fs.FileContext.getFileContext(whole.toUri(), self._conf).rename(whole, self._fs.makeQualified(self._path(name)), kinds)
