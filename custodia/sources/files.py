"""Folders on the storage that the session's Hadoop settings reach.

A few metadata operations (exists, rename, delete, one small file); data is
read and written by Spark alone.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folders:
    """Folder operations of one session."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        p, fs = self._at(old)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it does not exist."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def files(self, path: str) -> list[str]:
        """Paths of all files below a folder, relative to it."""
        p, fs = self._at(path)
        found, below = [], []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            (below if s.isDirectory() else found).append(name)
        return found + [f"{d}/{x}" for d in below for x in self.files(f"{path}/{d}")]

    def write_text(self, path: str, text: str) -> None:
        """One small file, complete or not there: written aside, then renamed."""
        aside = f"{path}.part"
        p, fs = self._at(aside)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.rename(aside, path)

    def read_text(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
