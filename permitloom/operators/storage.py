"""Versioned, partitioned storage: replace, read, count, last change."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Rename; some file systems answer a failure instead of raising it."""
    fs, p = _fs(spark, path)
    if not fs.rename(p, _fs(spark, target)[1]):
        raise OSError(f"{path} could not be renamed to {target}")


def write_text(spark: SparkSession, path: str, parts: Iterator[bytes]) -> bool:
    """Write the parts to a file of any file system Spark knows; whether there were any."""
    fs, target = _fs(spark, path)
    out = None
    for part in parts:
        out = out or fs.create(target)
        out.write(bytearray(part))
    if out:
        out.close()
    return out is not None


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


#: The folder of a table's manifests, in the table's; Spark's own readers pass over names with an underscore.
MANIFESTS = "_manifests"
#: The column that orders a stored source's rows as they were in the source.
SOURCE_ROW = "source_row"


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """The generations of a table that have been committed and not removed, in ascending order."""
    fs, p = _fs(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The latest commit: generation, columns, rows, files; None if there is none."""
    for _ in range(9):
        done = _manifests(spark, path)
        if not done:
            return None
        try:
            return json.loads(read_text(spark, f"{path}/{MANIFESTS}/{done[-1]}.json"))
        except Exception:
            if _manifests(spark, path)[-1:] == done[-1:]:
                raise
            # It went since it was listed, as a newer one has come.
    raise OSError(f"{path} is replaced faster than it can be read")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the latest commit; a folder without one is read as it is."""
    found = manifest(spark, path)
    if found is None:
        return spark.read.parquet(path)
    kind = T.StructType.fromJson(found["columns"])
    if not found["files"]:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("basePath", path).parquet(*[f"{path}/{f}" for f in found["files"]])


def replace(df: DataFrame, path: str, partition_by: str | None = None) -> int:
    """Replace a table's rows by those of ``df``; the number of rows, as the write observed them.

    Files are written aside and then moved into the table, under names of their own; nothing reads them until the
    next generation's manifest, which lists them, is renamed into place.  So readers by ``read_table`` see the old rows
    or the new ones whenever they look and wherever a writer stops.  Two writers can't commit one
    generation.  In the end all files go that the manifest does not list: those of the last generation, and
    any that a writer left that stopped half-way.  A task that is still to read one of them fails and does
    not miss rows; and plain readers of the folder may see both generations between the commit and the end.
    """
    spark = df.sparkSession
    done = _manifests(spark, path)
    generation = done[-1] + 1 if done else 1
    aside = f"{path}/_writing-{uuid.uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(aside)
    rows = seen.get["rows"]
    files = _files(spark, aside)
    for f in files:
        _make_folder(spark, f"{path}/{f}".rpartition("/")[0])
        move(spark, f"{aside}/{f}", f"{path}/{f}")
    columns = [f for f in df.schema.fields if f.name != partition_by] + [f for f in df.schema.fields if f.name == partition_by]
    _commit(spark, path, generation, {"generation": generation, "columns": T.StructType(columns).jsonValue(), "rows": rows, "files": files})
    _clean(spark, path, generation, set(files))
    return rows


def _make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def files_below(spark: SparkSession, path: str) -> list[str]:
    """The files below a folder, by their paths in it, in order of name."""
    fs, p = _fs(spark, path)
    base, found, files = fs.makeQualified(p).toString().rstrip("/") + "/", [], fs.listFiles(p, True)
    while files.hasNext():
        found.append(files.next().getPath().toString().removeprefix(base))
    return sorted(found)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files below a folder, but for those that are being written aside."""
    return [f for f in files_below(spark, path) if f.endswith(".parquet") and not f.startswith("_")]


def _commit(spark: SparkSession, path: str, generation: int, about: dict) -> None:
    target = f"{path}/{MANIFESTS}/{generation}.json"
    part = f"{target}.{uuid.uuid4().hex}"
    write_text(spark, part, iter([json.dumps(about).encode()]))
    if exists(spark, target):
        raise FileExistsError(f"another writer has committed generation {generation} of {path}")
    move(spark, part, target)


def _clean(spark: SparkSession, path: str, generation: int, files: set[str]) -> None:
    """Remove what the generation does not list."""
    fs, p = _fs(spark, path)
    for old in _manifests(spark, path):
        if old < generation:
            delete(spark, f"{path}/{MANIFESTS}/{old}.json")
    for f in set(_files(spark, path)) - files:
        delete(spark, f"{path}/{f}")
    kept = {f.partition("/")[0] for f in files} | {MANIFESTS}
    for entry in fs.listStatus(p):
        name = entry.getPath().getName()
        if entry.isDirectory() and name not in kept:
            fs.delete(entry.getPath(), True)


def positions() -> Column:
    """A row's place in a table that Spark has written: by file, and by row in it.  Files are numbered as their tasks were."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)-", 1).cast("long")
    return part * (1 << 33) + F.col("_metadata.row_index")


def write_source(df: DataFrame, name: str, data_dir: str) -> int:
    """Replace ``data_dir/name`` by the rows, in a folder per year; the number of rows.

    Without rows the dataset is removed.  A year's rows are dealt out by a hash of the row
    as well, so that a large year is not one task's.
    """
    spark, path = df.sparkSession, f"{data_dir}/{name}"
    n = replace(df.hint("rebalance", F.col("year")), path, "year") if df.columns else 0
    if not n:
        delete(spark, path)
    return n


def row_count(spark: SparkSession, name: str, data_dir: str) -> int | None:
    """Rows of a stored dataset, as its write observed them, or from file footers; None if there is none."""
    path = f"{data_dir}/{name}"
    if found := manifest(spark, path):
        return found["rows"]
    return spark.read.parquet(path).count() if exists(spark, path) else None


def last_modified(spark: SparkSession, name: str, data_dir: str) -> datetime | None:
    """The latest change of a dataset's files; None if there are none."""
    path = f"{data_dir}/{name}"
    if not exists(spark, path):
        return None
    found = manifest(spark, path)
    fs, _ = _fs(spark, path)
    latest = None
    for name in found["files"] if found else _files(spark, path):
        latest = max(latest or 0, fs.getFileStatus(_fs(spark, f"{path}/{name}")[1]).getModificationTime())
    return datetime.fromtimestamp(latest / 1000, UTC) if latest is not None else None
