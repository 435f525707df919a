"""Files in whatever store Spark reads: by Arrow on executors, by Hadoop on the driver."""

from __future__ import annotations

import io
import re

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

#: Schemes of Spark's paths under which Arrow knows the same stores.
_SCHEMES = [(r"^s3[an]://", "s3://"), (r"^wasbs?://([^@/]+)@([^./]+)\.blob\.", r"abfss://\1@\2.dfs."), (r"^hdfs:///", "hdfs://default/"), (r"^file:/(?!/)", "file:///")]


def arrow_uri(path: str) -> str:
    """A path that Spark knows, as Arrow names it."""
    for pattern, scheme in _SCHEMES:
        path = re.sub(pattern, scheme, path)
    return path


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path that Spark knows, and the path in it."""
    return pafs.FileSystem.from_uri(arrow_uri(path))


class StoredFile(io.RawIOBase):
    """A file to read from any place, by the driver, in steps; nothing holds it whole."""

    def __init__(self, spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.size, self._in, self._at = fs.getFileStatus(p).getLen(), fs.open(p), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self.size}[whence]
        return self._at

    def tell(self) -> int:
        return self._at

    def readinto(self, target) -> int:
        n = max(0, min(len(target), self.size - self._at, 1 << 20))
        if n:
            self._in.seek(self._at)
            data = self._in.readNBytes(n)
            n = len(data)
            target[:n] = data
            self._at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._in.close()
        super().close()
