"""Vector code compression: a byte for each part of a vector, by codebooks of exact integers.

A component x is the integer floor(256 x).  Vectors are cut into equal consecutive parts, each with
a codebook of its own, which starts as that part of the smallest keys' vectors.  A round
assigns every part to its nearest entry and replaces each entry by the floored mean of its parts.

The nearest entry is found by exponion search.  A part starts at the entry it had before, at the
squared distance u.  Any entry that is no farther from the part lies within twice that distance of the
start, by the triangle inequality, so within 4u of it in squares; entries are scanned in
order of their distance from the start until that radius ends.  All distances are integers, and of entries
at equal distances the lowest index wins, so the result is that of a whole search.

Each pass runs the rounds so far again from the vectors (a codebook is as large as 64 vectors, and
goes to every task), so no table of codes is written and joined in between.  Tasks return sums for each entry only.

Rows are dropped whose vector is null or holds a null or non-finite component, or one of magnitude 2**17 or more,
whose error need not fit a long.  Vectors of other lengths than the longest, and lengths that don't
divide by the number of parts, are filled up with zeros.  Repeated keys are rows of their own; the first
codebook takes rows in order of key (null keys last) and then vector.  With fewer rows than
entries a codebook is smaller.  Null labels are one label.  An empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitloom.llm.common import forget, list_parts, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of at least this magnitude are out of range: errors of up to 2048 components below it fit a long.
MOST = float(1 << 17)
#: Components that a task works on at once.
STEP = 1 << 18


def search(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance; ``start`` holds the entries to begin at."""
    apart = ((book[:, None] - book[None]) ** 2).sum(-1)
    order = np.argsort(apart, axis=1, kind="stable")
    sorted_apart = np.take_along_axis(apart, order, 1)
    best, code = ((x - book[start]) ** 2).sum(1), start.copy()
    within = np.zeros(len(x), np.int64)
    for a in np.unique(start).tolist():
        rows = np.nonzero(start == a)[0]
        within[rows] = np.searchsorted(sorted_apart[a], 4 * best[rows], side="right")
    todo = np.argsort(-within, kind="stable")
    left = np.searchsorted(-within[todo], -np.arange(1, len(book) + 1), side="right")
    for k in range(len(book)):
        rows = todo[: left[k]]
        if not len(rows):
            break
        entry = order[start[rows], k]
        d = ((x[rows] - book[entry]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (entry < code[rows]))
        rows = rows[better]
        best[rows], code[rows] = d[better], entry[better]
    return code, best


def _integers() -> Callable:
    """key, label, x (the integers' bytes) of the rows that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            begin, at = list_parts(whole.column("vec"))[0], 0
            while at < whole.num_rows:
                stop = max(at + 1, int(np.searchsorted(begin, begin[at] + STEP, side="right")) - 1)
                batch = whole.slice(at, stop - at)
                at = stop
                offsets, values = list_parts(batch.column("vec"))
                data = np.asarray(values.fill_null(np.nan) if values.null_count else values, dtype=np.float64)
                with np.errstate(invalid="ignore"):
                    odd = np.concatenate([[0], np.cumsum(~(np.abs(data) < MOST))])
                good = np.asarray(batch.column("vec").is_valid()) & (odd[offsets[1:]] == odd[offsets[:-1]])
                ints = np.floor(SCALE * np.where(np.abs(data) < MOST, data, 0.0)).astype("<i4")
                x = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(ints)])
                out = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), x], names=["key", "label", "x"])
                yield out.filter(pa.array(good))

    return run


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    """A row for each vector, filled with zeros."""
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64) // 4
    flat = np.frombuffer(x.buffers()[2], "<i4") if x.buffers()[2] else np.zeros(0, "<i4")
    out = np.zeros((len(x), width), np.int64)
    out[np.arange(width) < np.diff(offsets)[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def _assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vectors x parts) and squared distances under the last of the codebooks (parts x entries x components)."""
    parts, _, width = books[0].shape
    codes, errors = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    for p in range(parts):
        mine = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        for book in books:
            codes[:, p], errors[:, p] = search(mine, book[p], codes[:, p])
    return codes, errors


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, STEP // max(1, width))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            yield whole.slice(at, step)


def _sums(books: list[np.ndarray]) -> Callable:
    """slot, n, sums of the parts of each entry, over a task."""
    parts, entries, width = books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in _blocks(batches, parts * width):
            x = _matrix(batch.column("x"), parts * width)
            slots = _assigned(x, books)[0] + np.arange(parts) * entries
            n += np.bincount(slots.ravel(), minlength=len(n))
            np.add.at(sums, slots.ravel(), x.reshape(-1, width) if width else x.reshape(slots.size, 0))
        on = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(n[on]), pa.array(sums[on].tolist(), pa.list_(pa.int64()))], names=["slot", "n", "sums"])

    return run


def _coded(books: list[np.ndarray]) -> Callable:
    parts, _, width = books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, parts * width):
            codes, errors = _assigned(_matrix(batch.column("x"), parts * width), books)
            data = pa.py_buffer(codes.astype(np.uint8).tobytes())
            code = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(0, parts * len(codes) + 1, parts, dtype=np.int32)), data])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), code, pa.array(errors.sum(1))], names=["key", "label", "code", "error"])

    return run


class Compressed:
    """``codes``: key, label, code (a byte for each part), error of each kept row; ``books``: the codebooks (parts x entries x components)."""

    def __init__(self, codes: DataFrame, books: np.ndarray):
        self.codes, self.books = codes, books

    def digest(self) -> str:
        """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decoded(self) -> DataFrame:
        """key, vector: the entries' components, in the scale of the vectors."""
        books, parts = self.books, np.arange(self.books.shape[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _blocks(batches, books.shape[0] * books.shape[2]):
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, len(parts))
                x = books[parts, codes].reshape(batch.num_rows, -1) / SCALE
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(x), pa.list_(pa.float64()))], names=["key", "vector"])

        return self.codes.select("key", "code").mapInArrow(run, f"key {self.codes.schema['key'].dataType.simpleString()}, vector array<double>")


def compress(df: DataFrame, vector: str = "embedding", label: str = "label", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Codebooks of ``entries`` (at most 256) for each of ``parts``, and all vectors' codes under them."""
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(df[key].alias("key"), df[label].alias("label"), df[vector].cast(f"array<{kind}>").alias("vec"))
    of = f"key {rows.schema['key'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}"
    kept = written(rows.mapInArrow(_integers(), f"{of}, x binary"), "integers")
    longest = kept.agg(F.max(F.octet_length("x"))).first()[0] or 0
    width = -(-longest // 4 // parts)
    # As many rows as there are entries, whatever the table's size.
    first = [r.x for r in kept.orderBy(F.asc_nulls_last("key"), "x").select("x").limit(entries).collect()]
    x = _matrix(pa.array(first, pa.binary()), parts * width) if first else np.zeros((0, parts * width), np.int64)
    books = [np.ascontiguousarray(x.reshape(len(first), parts, width).transpose(1, 0, 2))]
    for _ in range(rounds if first else 0):
        sums = kept.select("x").mapInArrow(_sums(books), "slot long, n long, sums array<long>")
        flat = sums.select("slot", "n", F.posexplode("sums").alias("at", "s")).groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        new = books[-1].copy()
        for r in flat.collect():  # a number for each component of the codebooks
            new[r.slot // len(first), r.slot % len(first), r["at"]] = r.s // r.n
        books.append(new)
    codes = written(kept.mapInArrow(_coded(books), f"{of}, code binary, error long"), "codes")
    forget(kept)
    return Compressed(codes, books[-1])


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``label_error``: the errors of a label's rows, summed; null labels are one."""
    sums = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"]), "left").drop("of")
