"""Plumbing that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step holds at once; one longer text is a step of its own.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests, a laptop) a temporary folder takes its place.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="permitloom-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/permitloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def valid_text(text: Column) -> Column:
    """The text with U+FFFD for bytes that are no UTF-8, which Arrow and Python would refuse."""
    return F.make_valid_utf8(text.cast("string"))


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            give_back()
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Characters of a part of a longer text.
PART_CHARS = 2 << 20


def in_parts(text: str, boundary: re.Pattern, limit: int) -> Iterator[str]:
    """Cut a long text at boundaries (whose own characters go) into parts of little over ``limit`` characters."""
    start = 0
    while len(text) - start > limit and (m := boundary.search(text, start + limit)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def apart(texts: pa.Array, boundary: re.Pattern, limit: int) -> tuple[pa.Array, np.ndarray]:
    """The texts with long ones in parts, and the number of parts of each."""
    sizes = np.asarray(pc.fill_null(pc.utf8_length(texts), 0))
    if not (sizes > limit).any():
        return texts, np.ones(len(texts), np.int64)
    cut = [list(in_parts(t, boundary, limit)) if n > limit else [t] for t, n in zip(texts.to_pylist(), sizes.tolist(), strict=True)]
    return pa.array([p for parts in cut for p in parts], pa.string()), np.array([len(parts) for parts in cut], dtype=np.int64)


def part_sums(values: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Sums over the parts of each text."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(parts)
    return sums[ends] - sums[ends - parts]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i]+counts[i]-1`` of all i, one after another."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - counts), counts)


def list_parts(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0, and the values, of a list array that may be a slice."""
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return offsets - offsets[0], lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words between runs of ASCII white space: offsets per text, and the words."""
    offsets, words = list_parts(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
    full = np.asarray(pc.greater(pc.binary_length(words), 0), dtype=bool)
    if full.all():
        return offsets, words
    kept = np.concatenate([[0], np.cumsum(full)])
    return kept[offsets], words.filter(pa.array(full))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the words, and the distinct words."""
    if not len(words):
        return np.zeros(0, np.int32), words
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return np.asarray(d.indices, dtype=np.int32), d.dictionary


def _trimmer():
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other libraries don't need it
    return trim or (lambda _: 0)


_TRIM = _trimmer()


def give_back() -> None:
    """Return memory that a worker has freed to the machine, for the others on it."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def out_batch(arrays: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def string(column: pa.Array) -> pa.Array:
    """Plain utf8, whatever string layout Spark's Arrow conversion uses; bytes that are no UTF-8, which a file may hold, become U+FFFD."""
    column = column if pa.types.is_string(column.type) else column.cast(pa.string())
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([x if x is None else x.decode(errors="replace") for x in column.cast(pa.binary()).to_pylist()], pa.string())
    return column
