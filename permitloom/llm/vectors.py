"""Embedding near-dedup: cross-polytope hashing with multiprobe buckets and verified pairs.

A hash is the signed axis nearest to the vector after a fast pseudo-random rotation (three
rounds of random signs and a Hadamard transform); a table's bucket is made of ``width``
such hashes.  A vector has in each table its own bucket and the ``probes`` - 1 next best
ones, in order of the distance lost.  Two vectors meet in a bucket if it is one's own and
among the other's probes.

Vectors with equal components and label form a class and are compared once.  The rows of a
bucket of over ``BLOCK`` are compared in blocks, so a large bucket is many tasks and never all in
one; such buckets are found by counting a sixteenth of the vectors, which decides how rows are dealt
and not what is compared (one of twice that size is overlooked, and done by one task, with a chance
of 1e-9).  Rows are compared first
by ``BITS`` signs of another rotation, which rule out a pair at the threshold with a
probability under 1e-7, then those that are left by products in double precision.  Each pair is
counted in the first bucket in which it meets, and a block gives a link count and a
representative for each row rather than its pairs.

A pair at cosine 0.93 meets in a table with a rate that ``plan`` makes up for by the number of
tables, for each dimension and size of a label, so that it misses under 1e-5 of such pairs if
tables are independent (measured in the tests).  Vectors are compared only if labels are equal
and not null and lengths are equal.  Null or empty vectors, zero vectors, and those with a null
or non-finite component link with nothing; they keep themselves.  A row with a null key links
with nothing.  Rows of one key are vectors of their own: each has its own links, component
(the smallest key in it) and mark, and is a link of the others if near.  Long vectors are held
some at a time.  An empty table gives an empty result.  Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitloom.llm.common import forget, list_parts, ragged, written
from permitloom.llm.components import components_table
from permitloom.llm.minhash import mix

TABLES, WIDTH, PROBES = 12, 2, 3
#: For more and more vectors of a label: width, tables in 64 dimensions, probes, and the share of tables that each doubling of the dimensions adds.
SIZES = [(2, 12, 3, 0.15), (3, 16, 6, 0.235), (4, 29, 6, 0.31)]
#: Best axes of each rotation that probes are made of.
AXES = 3
#: Rows of a bucket that one task compares with as many others.
BLOCK = 1024
#: A share of rows (one in so many) whose buckets are counted to find those to be cut into blocks, and the most such buckets that are broadcast.
COUNTED, BROADCAST = 16, 100_000
#: Signs that are compared before vectors are.
BITS = 128
#: Cells of at most so many rows are compared many at once, so many pairs at a time.
SMALL, PAIRS = 64, 100_000
#: Bytes of vectors that a vectorised step holds.
STEP_BYTES = 8 << 20


#: Radix of the Hadamard transform: a product with so small a matrix is faster than its butterflies.
RADIX = 64


@lru_cache
def _butterfly(n: int, dtype: np.dtype) -> np.ndarray:
    h = np.ones((1, 1), dtype)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def _transform(x: np.ndarray) -> np.ndarray:
    rows, n = x.shape
    if n <= RADIX:
        return x @ _butterfly(n, x.dtype)
    x = (x.reshape(-1, RADIX) @ _butterfly(RADIX, x.dtype)).reshape(rows, n // RADIX, RADIX).transpose(0, 2, 1)
    x = _transform(np.ascontiguousarray(x).reshape(rows * RADIX, n // RADIX))
    return x.reshape(rows, RADIX, n // RADIX).transpose(0, 2, 1).reshape(rows, n)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, in radix ``RADIX``; the length is a power of two."""
    return _transform(x) / math.sqrt(x.shape[1])


def _padded(x: np.ndarray) -> np.ndarray:
    """Rows of a power of two of components, in single precision: hashes need no more."""
    out = np.zeros((len(x), 1 << max(1, (x.shape[1] - 1).bit_length())), np.float32)
    out[:, : x.shape[1]] = x
    return out


def _rotated(padded: np.ndarray, *seed: int) -> np.ndarray:
    rng, y = np.random.Generator(np.random.PCG64([*seed, padded.shape[1]])), padded
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], padded.shape[1]).astype(padded.dtype))
    return y


def codes(x: np.ndarray, tables: int, width: int, probes: int) -> np.ndarray:
    """Of unit rows, 31-bit names of the buckets of each table, best first: rows x tables x probes.

    Should two probes of a table have one name, the later is negative and no bucket.
    """
    padded, row = _padded(x), np.arange(len(x))
    size = padded.shape[1]
    axes = min(AXES, size)
    out = np.empty((len(x), tables, probes), np.int32)
    combos = np.stack(np.meshgrid(*[np.arange(axes)] * width, indexing="ij"), -1).reshape(-1, width)
    for t in range(tables):
        lost, axis = [], []
        for k in range(width):
            y = _rotated(padded, 7, t, k)
            rest, top = np.abs(y), np.empty((len(x), axes), np.int64)
            far = np.empty((len(x), axes))
            for j in range(axes):
                top[:, j] = rest.argmax(1)
                far[:, j] = rest[row, top[:, j]]
                rest[row, top[:, j]] = -1
            axis.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            lost.append((far[:, :1] - far) ** 2)
        cost = sum(lost[k][:, combos[:, k]] for k in range(width))
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        key = np.zeros((len(x), best.shape[1]), np.uint64)
        for k in range(width):
            key = key * np.uint64(2 * size) + np.take_along_axis(axis[k], combos[best, k], 1).astype(np.uint64)
        name = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int32)
        for j in range(probes):
            if j >= name.shape[1]:  # fewer axes than probes
                out[:, t, j] = -1 - j
            else:
                out[:, t, j] = np.where((name[:, :j] == name[:, j : j + 1]).any(1), -1 - j, name[:, j])
    return out


def signs(x: np.ndarray) -> np.ndarray:
    """``BITS`` signs of rotations of each row, as 64-bit words."""
    padded, parts, got = _padded(x), [], 0
    while got < BITS:
        parts.append(_rotated(padded, 13, len(parts)) > 0)
        got += padded.shape[1]
    return np.packbits(np.concatenate(parts, axis=1)[:, :BITS], axis=1).view(np.int64)


def most_differing(threshold: float, miss: float = 1e-7) -> int:
    """The most signs that may differ, so that a pair at the threshold goes with a probability under ``miss``."""
    p, tail, m = math.acos(max(-1.0, min(1.0, threshold))) / math.pi, 0.0, BITS
    while m > 0 and tail + (chance := math.comb(BITS, m) * p**m * (1 - p) ** (BITS - m)) < miss:
        tail, m = tail + chance, m - 1
    return m


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``STEP_BYTES`` of components, one row at least."""
    for whole in batches:
        begin, at = 8 * list_parts(whole.column("vec"))[0], 0
        while at < whole.num_rows:
            stop = max(at + 1, int(np.searchsorted(begin, begin[at] + STEP_BYTES, side="right")) - 1)
            yield whole.slice(at, stop - at)
            at = stop


def _valid(dtype: np.dtype) -> Callable:
    """row, id, label, vec (the components' bytes, or null where it links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 30
        for batch in _parts(batches):
            lists = batch.column("vec")
            offsets, values = list_parts(lists)
            data = np.ascontiguousarray(np.asarray(values.fill_null(np.nan) if values.null_count else values, dtype=dtype))
            upto = lambda on: np.concatenate([[0], np.cumsum(on)])
            odd, full = upto(~np.isfinite(data)), upto(data != 0)
            begin, end = offsets[:-1], offsets[1:]
            good = np.asarray(lists.is_valid()) & (odd[end] == odd[begin]) & (full[end] > full[begin])
            vecs = pa.Array.from_buffers(pa.binary(), len(lists), [pa.array(good).buffers()[1], pa.py_buffer((offsets * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
            rows = pa.array(np.arange(row, row + len(lists)))
            row += len(lists)
            yield pa.RecordBatch.from_arrays([rows, batch.column("id"), batch.column("label"), vecs], names=["row", "id", "label", "vec"])

    return run


def _units(vecs: pa.Array, dtype: np.dtype) -> np.ndarray:
    """Unit rows, filled with zeros where vectors are of different lengths."""
    sizes = np.asarray(pc.binary_length(vecs)) // dtype.itemsize
    first = np.frombuffer(vecs.buffers()[1], np.int32)[vecs.offset]
    flat = np.frombuffer(vecs.buffers()[2], dtype, sizes.sum(), first)
    x = np.zeros((len(sizes), sizes.max()))
    x[np.arange(x.shape[1]) < sizes[:, None]] = flat
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _meets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of code rows (pairs x tables x probes): whether a's own bucket is among b's, and b's among a's."""
    ab, ba = a[:, :, 0] == b[:, :, 0], a[:, :, 0] == b[:, :, 0]
    for k in range(1, a.shape[2]):
        ab, ba = ab | (a[:, :, 0] == b[:, :, k]), ba | (b[:, :, 0] == a[:, :, k])
    return ab, ba


def _whole_cells(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Some whole cells at a time, of rows sorted by ``at``, and where each begins; the last entry is the end."""
    held = None
    parts = chain.from_iterable((b.slice(s, rows) for s in range(0, b.num_rows, rows)) for b in batches)
    for part in chain(parts, [None]):
        if part is None:
            if held is not None:
                yield held, _cuts(held)
            return
        t = pa.Table.from_batches([part])
        t = t if held is None else pa.concat_tables([held, t])
        cuts = _cuts(t)
        if len(cuts) > 2:
            yield t.slice(0, cuts[-2]), cuts[:-1]
        held = t.slice(cuts[-2])


def _cuts(t: pa.Table) -> np.ndarray:
    at = np.asarray(t.column("at"))
    return np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1, [t.num_rows]])


def _pairs(cuts: np.ndarray, side: np.ndarray, own: np.ndarray, some: Callable, cross: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell (of sides 1 and 2 if they are two blocks, all of side 0 if one), one at least in its own bucket, for which ``some(a, b)`` holds, or ``cross`` as a matrix."""
    sizes = np.diff(cuts)
    two = np.add.reduceat(side, cuts[:-1]) > 0
    few = (sizes <= SMALL) & ~two
    at = ragged(cuts[:-1][few], sizes[few])
    later = np.repeat(cuts[1:][few], sizes[few]) - at - 1
    ends, start = np.cumsum(later), 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        a, b = np.repeat(at[start:stop], later[start:stop]), ragged(at[start:stop] + 1, later[start:stop])
        on = own[a] | own[b]
        a, b = a[on], b[on]
        if len(a):
            on = some(a, b)
            yield a[on], b[on]
        start = stop
    for s, e, both in zip(cuts[:-1][~few].tolist(), cuts[1:][~few].tolist(), two[~few].tolist(), strict=True):
        here = np.arange(s, e)
        first, other = (here[side[s:e] == 1], here[side[s:e] == 2]) if both else (here, here)
        for k in range(0, len(first), 256):
            f = first[k : k + 256]
            on = cross(f, other) & (own[f][:, None] | own[other][None, :])
            if not both:
                on &= f[:, None] < other[None, :]
            a, b = np.nonzero(on)
            for c in range(0, len(a), PAIRS):
                yield f[a[c : c + PAIRS]], other[b[c : c + PAIRS]]


def _promising(limit: int, codes: int, probes: int) -> Callable:
    """The rows of cells that have a partner whose signs differ in at most ``limit`` places.

    A row's ``who`` is the vector, times ``codes``, plus the place of the cell in its codes, times 4, plus its side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _whole_cells(batches, 8192):
            who = np.asarray(t.column("who"))
            side, pos, ids = who & 3, (who >> 2) % codes, (who >> 2) // codes
            own = pos % probes == 0
            s1, s2 = (np.asarray(t.column(c)).view(np.uint64) for c in ("s1", "s2"))
            differ = lambda a, b: np.bitwise_count(s1[a] ^ s1[b]).astype(np.int16) + np.bitwise_count(s2[a] ^ s2[b])
            found = np.zeros(t.num_rows, bool)
            for a, b in _pairs(cuts, side, own, lambda a, b: differ(a, b) <= limit, lambda f, o: differ(f[:, None], o[None, :]) <= limit):
                found[a] = found[b] = True
            if found.any():
                columns = [np.asarray(t.column("at")), ids, pos, side]
                yield pa.RecordBatch.from_arrays([pa.array(c[found]) for c in columns], names=["at", "rep", "pos", "side"])

    return run


def _compare(threshold: float, dtype: np.dtype, tables: int, probes: int, rows: int) -> Callable:
    """Of the rows of cells with links that the cell owns: the row, the smallest row linked with it there, and its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _whole_cells(batches, rows):
            pos, side, ids, size, lab = (np.asarray(t.column(c)) for c in ("pos", "side", "rep", "size", "lab"))
            own = pos % probes == 0
            x = _units(t.column("vec").combine_chunks(), dtype)
            code = np.asarray(t.column("codes").combine_chunks().flatten(), dtype=np.int64).reshape(len(ids), tables, probes)
            cell = code.reshape(len(ids), -1)[np.arange(len(ids)), pos]
            got = [np.zeros((2, 0), np.int64)]
            near = _pairs(cuts, side, own, lambda a, b: np.einsum("ij,ij->i", x[a], x[b]) >= threshold, lambda f, o: x[f] @ x[o].T >= threshold)
            for a, b in near:
                # A pair is the cell's where it meets first; in one table it may meet in two.
                ab, ba = _meets(code[a], code[b])
                pick, first = np.arange(len(a)), (ab | ba).argmax(1)
                none = np.iinfo(np.int64).max
                here = np.minimum(np.where(ab[pick, first], code[a, first, 0], none), np.where(ba[pick, first], code[b, first, 0], none))
                mine = (here == cell[a]) & (here == cell[b]) & (lab[a] == lab[b])
                got.append(np.stack([a[mine], b[mine]]))
            i, j = np.concatenate(got, axis=1)
            if not len(i):
                continue
            links = np.bincount(i, size[j], len(ids)) + np.bincount(j, size[i], len(ids))
            root = ids.copy()
            while True:
                before, least = root.copy(), np.minimum(root[i], root[j])
                np.minimum.at(root, i, least)
                np.minimum.at(root, j, least)
                if (root == before).all():
                    break
            on = np.nonzero(links)[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(root[on]), pa.array(links[on].astype(np.int64))], names=["a", "b", "n"])

    return run


def plan(rows: int, dimensions: int) -> dict[str, int]:
    """Width, tables and probes with which unlike vectors of a label of so many rows fill no more than about a block of a bucket.

    All of them find a pair at cosine 0.93 alike; the choice is one of speed.
    """
    doublings = max(1, (dimensions - 1).bit_length())
    for width, tables, probes, more in SIZES:
        if rows * probes <= BLOCK * (2 << doublings) ** width:
            break
    return {"width": width, "tables": math.ceil(tables * (1 + more * max(0, doublings - 6))), "probes": probes}


def plan_for(df: DataFrame, vector: str = "embedding", label: str = "label") -> dict[str, int]:
    """``plan`` for the largest label and the longest vectors of ``df``."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d"))
    row = sizes.agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    return plan(row.n or 0, max(2, row.d or 2))


def near_vectors(df: DataFrame, threshold: float = 0.93, vector: str = "embedding", label: str = "label", key: str = "vec_id", tables: int = TABLES, width: int = WIDTH, probes: int = PROBES) -> DataFrame:
    """``key``, n_links, component_id, kept of each row."""
    short = isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    dtype = np.dtype(np.float32 if short else np.float64)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast(f"array<{'float' if short else 'double'}>").alias("vec"))
    kind = rows.schema["label"].dataType.simpleString()
    rows = written(rows.mapInArrow(_valid(dtype), f"row long, id long, label {kind}, vec binary"), "vectors")
    valid = rows.where("vec is not null and label is not null and id is not null").withColumn("dim", F.octet_length("vec"))
    # A number for each label and length.
    labels = written(valid.groupBy("label", "dim").agg(F.min("row").alias("lab")), "labels")
    valid = valid.join(labels, ["label", "dim"]).select("row", "id", "lab", "vec")
    first = F.min(F.struct("id", "row")).alias("first")
    classes = written(valid.groupBy("lab", "vec").agg(first, F.count("*").alias("size")).select("lab", "vec", F.col("first.row").alias("rep"), F.col("first.id").alias("rep_id"), "size"), "classes")
    copies = written(classes.where("size > 1").select("lab", "vec", "rep"), "copies")
    members = written(valid.join(copies, ["lab", "vec"]).where("row != rep").select("row", "rep"), "members")
    keys = written(rows.select("row", "id"), "keys")
    forget(copies, rows)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                lengths = np.asarray(pc.binary_length(batch.column("vec")))
                out, bits = np.empty((len(lengths), tables, probes), np.int32), np.empty((len(lengths), BITS // 64), np.int64)
                for n in np.unique(lengths).tolist():
                    at = np.nonzero(lengths == n)[0]
                    x = _units(batch.column("vec").take(pa.array(at)), dtype)
                    out[at], bits[at] = codes(x, tables, width, probes), signs(x)
                # One number for label, table and name; negative where there is no bucket.
                lab = mix(np.asarray(batch.column("lab")).view(np.uint64))[:, None, None]
                cell = mix(lab ^ ((np.arange(tables, dtype=np.uint64) << np.uint64(31))[:, None] | np.maximum(out, 0).astype(np.uint64))) >> np.uint64(1)
                cell = np.where(out < 0, out.astype(np.int64), cell.view(np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * tables * probes), pa.array(cell.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat, *(pa.array(np.ascontiguousarray(b)) for b in bits.T)], names=[*batch.schema.names, "codes", "s1", "s2"])

    coded = written(classes.select("lab", "rep", "rep_id", "size", "vec").mapInArrow(code, "lab long, rep long, rep_id long, size long, vec binary, codes array<long>, s1 long, s2 long"), "codes")
    forget(classes)
    light = coded.select("rep", "s1", "s2", F.posexplode("codes").alias("pos", "cell")).where("cell >= 0")
    who = (F.col("rep") * (tables * probes) + F.col("pos")) * 4
    counted = coded.where(F.pmod(F.xxhash64("rep"), F.lit(COUNTED)) == 0).select(F.explode("codes").alias("cell")).where("cell >= 0")
    crowded = counted.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // COUNTED)
    crowded = written(crowded.select("cell", F.ceil(F.col("n") * COUNTED / F.lit(BLOCK)).cast("int").alias("parts")), "crowded")
    crowds = crowded.count()
    if crowds:
        light = light.join(F.broadcast(crowded) if crowds <= BROADCAST else crowded.hint("merge"), "cell", "left")
        light = light.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")))
        light = light.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - F.lit(1).cast("long"))))
        pair = F.least("block", "to") * F.col("parts") + F.greatest("block", "to")
        side = F.when(F.col("block") == F.col("to"), 0).when(F.col("block") < F.col("to"), 1).otherwise(2)
        at = F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", pair))
        cells = light.select(at.alias("at"), (who + side).alias("who"), "s1", "s2")
    else:
        cells = light.select(F.col("cell").alias("at"), who.alias("who"), "s1", "s2")
    # One number as the key of a pair of blocks, so that rows are sorted by radix.
    dealt = lambda x: x.repartition("at").sortWithinPartitions("at")
    promising = dealt(cells).mapInArrow(_promising(most_differing(threshold), tables * probes, probes), "at long, rep long, pos long, side long")
    promising = written(promising, "promising")
    step = max(64, STEP_BYTES // (8 * max(1, labels.agg(F.max("dim")).first()[0] or 1) // dtype.itemsize))
    verified = dealt(promising.join(coded.select("rep", "lab", "size", "vec", "codes"), "rep"))
    links = written(verified.mapInArrow(_compare(threshold, dtype, tables, probes, step), "a long, b long, n long"), "links")
    forget(promising, labels, crowded)

    counts = links.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    comps = components_table(links)
    # A component's name is the smallest key in it; as a table, so that a large component's rows are split.
    names = written(comps.join(coded.select(F.col("rep").alias("id"), "rep_id"), "id").groupBy("component_id").agg(F.min("rep_id").alias("name")), "names")
    named = comps.join(names, "component_id").select(F.col("id").alias("rep"), "name")
    results = coded.select("rep", "rep_id", "size").join(counts, "rep", "left").join(named, "rep", "left")
    results = written(results.select("rep", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("name", "rep_id").alias("component_id")), "results")
    forget(links, comps, names, coded)
    out = keys.join(members, "row", "left").withColumn("rep", F.coalesce("rep", "row")).join(results, "rep", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
