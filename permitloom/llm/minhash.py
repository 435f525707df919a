"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts gives each row a number, its number of distinct word shingles, a
   128-bit fingerprint of that set, and a signature of 128 minima (16 bits kept of each).
   Rows with equal sets form a class, and only one row of it goes on.
2. Signatures are cut into 32 bands of 4.  In each band's bucket every member is a
   candidate with the smallest one; of these pairs, signature batches are compared one
   after another, and a pair goes as soon as the posterior probability that its similarity
   reaches the threshold is under ``miss`` (uniform prior).  Survivors are verified on
   the documents' full shingle sets: first one pair for each document, then those whose
   ends these links haven't joined.
3. In buckets that still hold several components, pairs between these are compared block by
   block, again by batches on signatures alone; texts go only where a pair is left, and full
   sets decide.  A block emits a forest of its links, never its pairs, and each pair belongs to
   its first common bucket.  So every pair that shares a bucket is compared, or known to be
   in one component already.

At similarity 0.75 two documents share no bucket with probability (1 - 0.75^4)^32 = 5e-6,
and ``miss`` is 1e-6 for each of eight batches.  Links between different sets are only made by
comparing these; equal sets are known by their sizes and fingerprints, which differ for
different sets but for a chance of 1e-18 in 10^10 documents.  Shingles are 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A text of fewer than
``words`` words has its whole sequence as its one shingle; null, empty and blank texts have
none and link with nothing.  Long texts are read whole, one at a time if they are beyond 3 MB.
Rows with a null key keep themselves (component null).  Rows of one key are one
document that has the links of each of them; each row has its own number of shingles.  Of
equal candidates for a row the smallest row number is taken, which changes no component.
An empty table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitloom.llm.common import byte_slices, coded, forget, out_batch, split_words, string, written
from permitloom.llm.components import Forest, components_table

HASHES, ROWS, BATCH = 128, 4, 16
BANDS = HASHES // ROWS
#: Members of a bucket, and characters of their texts, that one task compares with as many others.
BLOCK = 1024
BLOCK_CHARS = 8 << 20
#: Tasks that a bucket's rows are dealt to while its number of blocks is looked up.
SALTS = 16
#: Tasks, at most, that the pairs with one row in common are dealt to.
HUBS = 1024
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_WORD = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text, and a hash of each of its words."""
    offsets, words = split_words(pc.ascii_lower(texts))
    codes, distinct = coded(words)
    if not len(codes):
        return offsets, np.zeros(0, np.uint64)
    return offsets, pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[codes]


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and their numbers."""
    offsets, w = word_hashes(texts)
    n = np.diff(offsets)
    long = n >= words
    h = np.zeros(len(w), np.uint64)
    for k in range(min(words, len(w))):
        h[: len(w) - k] += w[k:] * _WORD[k]
    h = mix(h)
    parts, counts = [], np.zeros(len(n), np.int64)
    for i in range(len(n)):
        a = int(offsets[i])
        if long[i]:
            x = h[a : a + int(n[i]) - words + 1].copy()
            x.sort()
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif n[i]:
            x = mix((w[a : a + int(n[i])] * _WORD[: n[i]]).sum(keepdims=True) + _WORD[63:] * np.uint64(n[i]))
        else:
            continue
        parts.append(x)
        counts[i] = len(x)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts


def signatures(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 16-bit minima of each non-empty set."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), HASHES), np.uint16)
    v = np.empty_like(x)
    for k in range(HASHES if len(starts) else 0):
        np.multiply(x, _A[k], out=v)
        v += _B[k]
        out[:, k] = (np.minimum.reduceat(v, starts) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of batches seen, the fewest matches with which a pair stays.

    With m of h matching and a uniform prior, P(similarity >= t) = P(Binomial(h + 1, t) <= m).
    """
    out = []
    for h in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while True:
            below += math.comb(h + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (h - m)
            if below >= miss:
                break
            m += 1
        out.append(m + 1)
    return out


def _sketch(df: DataFrame, words: int) -> DataFrame:
    """row (a number of its own for each row), and what later steps need of it beside the text."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("chars", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in byte_slices(batches, "text", 3 << 20):
            sets, counts = shingle_sets(string(batch.column("text")), words)
            full = counts > 0
            starts = (np.cumsum(counts) - counts)[full]
            marks = np.zeros((2, len(counts)), np.int64)
            if len(starts):
                marks[0, full] = np.add.reduceat(mix(sets ^ _WORD[60]), starts).view(np.int64)
                marks[1, full] = np.add.reduceat(mix(sets ^ _WORD[61]), starts).view(np.int64)
            sigs = iter(signatures(sets, counts))
            rows = np.arange(row, row + len(counts))
            row += len(counts)
            yield out_batch([rows, *(batch.column(c) for c in ("id", "mark", "chars")), counts, marks[0], marks[1], pa.array([next(sigs).tobytes() if f else None for f in full], pa.binary())], schema)

    lean = df.select("id", "mark", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), "text")
    return lean.mapInArrow(run, "row long, id long, mark long, chars long, n long, f1 long, f2 long, sig binary")


def _bands(df: DataFrame) -> DataFrame:
    """bucket, row of every band of each signature."""
    mark = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _WORD[62]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(part.num_rows, HASHES)
                key = mix(np.ascontiguousarray(sig).view(np.uint64) ^ mark)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part.column("row")), BANDS))], names=["bucket", "row"])

    return df.select("row", "sig").mapInArrow(run, "bucket long, row long")


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _prune(pairs: DataFrame, least: list[int]) -> DataFrame:
    """a, b, matches of the pairs (with sig_a, sig_b) that no batch rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _sigs(batch.column("sig_a")), _sigs(batch.column("sig_b"))
            on, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, m in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                seen[on] += (x[on, cut] == y[on, cut]).sum(1)
                on = on[seen[on] >= m]
            at = pa.array(on)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(seen[on])], names=["a", "b", "matches"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, matches long")


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sorted sets number a[i] and b[i], two different numbers."""
    if len(a) < 4 * len(sets):
        out = np.zeros(len(a), np.int64)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            both = np.concatenate([sets[i], sets[j]])
            both.sort(kind="stable")
            out[k] = (both[1:] == both[:-1]).sum()
        return out
    # Many pairs of few sets: products of incidence matrices, some shingles at a time.
    sizes = np.array([len(x) for x in sets])
    distinct, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = times > 1
    number = np.cumsum(common) - 1
    keep = common[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(common.sum()), 2048):
        lo, hi = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        total += part @ part.T
    return total[a, b].astype(np.int64)


def _candidates(least: list[int], bucket: int, side: np.ndarray, rows: np.ndarray, comp: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a cell, of different components, that no batch rules out and whose first equal band is this bucket."""
    mark = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _WORD[62]
    first, other = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    same = not len(other)
    other = first if same else other
    got = [np.zeros((2, 0), np.int64)]
    for start in range(0, len(first), 128):
        f = first[start : start + 128]
        apart = comp[f][:, None] != comp[other][None, :]
        if same:
            apart &= rows[f][:, None] < rows[other][None, :]
        a, b = np.nonzero(apart)
        a, b = f[a], other[b]
        seen = np.zeros(len(a), np.int16)
        for k, m in enumerate(least):
            cut = slice(k * BATCH, (k + 1) * BATCH)
            seen += (sig[a, cut] == sig[b, cut]).sum(1).astype(np.int16)
            on = seen >= m
            a, b, seen = a[on], b[on], seen[on]
        if len(a):
            x, y = np.ascontiguousarray(sig[a]).view(np.uint64), np.ascontiguousarray(sig[b]).view(np.uint64)
            band = (x == y).argmax(1)
            own = mix(x[np.arange(len(a)), band] ^ mark[band]).view(np.int64) == bucket
            got.append(np.stack([a[own], b[own]]))
    return tuple(np.concatenate(got, axis=1))


def _cells(batches: Iterator[pa.RecordBatch], text: bool) -> Iterator[tuple]:
    """(key, side, row, comp, sig, texts) of each cell of rows sorted by bucket, i, j."""
    key, parts = None, []

    def whole():
        numbers = [np.concatenate([p[k] for p in parts]) for k in range(4)]
        return key, *numbers, pa.concat_arrays([p[4] for p in parts]) if text else None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("bucket", "i", "j")])
        cuts = np.concatenate([[0], np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0] + 1, [batch.num_rows]])
        data = [np.asarray(batch.column(c), dtype=np.int64) for c in ("side", "row", "comp")] + [_sigs(batch.column("sig"))]
        texts = string(batch.column("text")) if text else None
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if (now := tuple(keys[:, s].tolist())) != key:
                if parts:
                    yield whole()
                key, parts = now, []
            parts.append((*(x[s:e] for x in data), texts.slice(s, e - s) if text else None))
    if parts:
        yield whole()


def _promising(cells: DataFrame, least: list[int]) -> DataFrame:
    """The rows of each cell, without texts, that are in a pair which no batch rules out: at most as many as it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, rows, comp, sig, _ in _cells(batches, text=False):
            if comp.min() == comp.max():
                continue
            a, b = _candidates(least, key[0], side, rows, comp, sig)
            on = np.unique(np.concatenate([a, b]))
            if len(on):
                fixed = [pa.array(np.full(len(on), k, np.int64)) for k in key]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(side[on]), pa.array(rows[on]), pa.array(comp[on])], names=["bucket", "i", "j", "side", "row", "comp"])

    return cells.mapInArrow(run, "bucket long, i long, j long, side long, row long, comp long")


def _compare_cells(cells: DataFrame, least: list[int], words: int, over: int, under: int) -> DataFrame:
    """Links between components, as a forest of each cell's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, rows, comp, sig, texts in _cells(batches, text=True):
            a, b = _candidates(least, key[0], side, rows, comp, sig)
            if not len(a):
                continue
            used, places = np.unique(np.concatenate([a, b]), return_inverse=True)
            sets, counts = shingle_sets(texts.take(pa.array(used)), words)
            sets = np.split(sets, np.cumsum(counts)[:-1])
            i, j = places[: len(a)], places[len(a) :]
            shared = shared_counts(sets, i, j)
            near = under * shared >= over * (counts[i] + counts[j] - shared)
            forest = Forest()
            kept = [k for k in np.nonzero(near)[0].tolist() if forest.join(int(comp[a[k]]), int(comp[b[k]]))]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(rows[a[kept]]), pa.array(rows[b[kept]])], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough: under * intersection >= over * union.

    A row that many pairs begin with goes to up to ``HUBS`` tasks, once to each; its
    partners' texts stream past it.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(HUBS)).alias("salt"))
    heads = salted.select("a", "salt").distinct().join(texts.select(F.col("row").alias("a"), "text"), "a").select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("b"), "text")
    tails = salted.join(texts.select(F.col("row").alias("b"), "text"), "b").select("a", "salt", F.lit(1).alias("side"), "b", "text")
    rows = heads.unionByName(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in byte_slices(batches, "text", 1 << 20):
            sets, counts = shingle_sets(string(batch.column("text")), words)
            sets = [held, *np.split(sets, np.cumsum(counts)[:-1])]
            head = np.asarray(batch.column("side"), dtype=np.int64) == 0
            at = np.maximum.accumulate(np.where(head, np.arange(1, len(head) + 1), 0))
            j = np.nonzero(~head)[0] + 1
            i = at[j - 1]
            held = sets[at[-1]].copy()
            if len(j):
                size = np.array([len(x) for x in sets])
                shared = shared_counts(sets, i, j)
                near = j[under * shared >= over * (size[i] + size[j] - shared)] - 1
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).take(pa.array(near))

    return rows.select("a", "b", "side", "text").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for c in ("a", "b"):
        pairs = pairs.join(comps.select(F.col("id").alias(c), F.col("component_id").alias(f"comp_{c}")), c, "left")
    return pairs.where("coalesce(comp_a, a) != coalesce(comp_b, b)")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, over: int = 75, under: int = 100, miss: float = 1e-6, by_key: bool = True) -> DataFrame:
    """``key``, n_shingles, component_id, kept of each row: linked if under * intersection >= over * union.

    Without ``by_key``, texts of one key are documents of their own: one of each component is
    kept, that of the smallest key and then of the smallest text_mark (a hash of the text,
    another column then); rows that repeat one text under one key are kept together.
    """
    least = least_matches(over / under, miss)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    sets = written(_sketch(docs, words), "sketch")
    full = sets.where("n > 0 and id is not null")
    # As a table, so that the join is a stage of its own, in which a large class can be split.
    classes = full.groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "mark", "row")).alias("first"), F.count("*").alias("size")).where("size > 1")
    classes = written(classes.select("f1", "f2", "n", F.col("first.row").alias("rep"), F.struct("first.id", "first.mark").alias("first")), "classes")
    members = written(full.join(classes, ["f1", "f2", "n"]).where("row != rep").select("row", "id", "rep", "first"), "members")
    forget(classes)
    repeated = not members.where("id = first.id").isEmpty()  # rows that say the same under the same key

    def texts_of(rows: DataFrame) -> DataFrame:
        """row, text; a row is found again by its key and a hash of its text."""
        wanted = written(rows.distinct().join(full.select("row", "id", "mark"), "row"), "wanted")
        found = docs.join(wanted.hint("merge"), ["id", "mark"]).select("row", "text")
        found = written(found.dropDuplicates(["row"]) if repeated else found, "texts")
        forget(wanted)
        return found

    # Rows of one key are one document, so their classes belong together.
    nodes = sets.where("id is not null").select("row", "id").join(members.select("row", "rep"), "row", "left").select("id", F.coalesce("rep", "row").alias("node"))
    # Here and below, what is grouped by a key is a table before it is joined on it, so that a hot key's rows are split.
    several = written(nodes.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z" if by_key else "false").select("id", "a"), "several")
    links = written(nodes.join(several, "id").where("node != a").select("a", F.col("node").alias("b")).distinct(), "links")

    reps = full.select("row", "sig").join(members.select("row"), "row", "left_anti")
    bands = _bands(reps)
    buckets = written(bands.groupBy("bucket").agg(F.min("row").alias("a"), F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = written(bands.join(buckets, "bucket").select("bucket", "a", "row", "size"), "shared")
    forget(several, buckets)
    sigs = full.select("row", "sig")

    stars = shared.where("a != row").select("a", F.col("row").alias("b")).distinct()
    stars = stars.join(sigs.select(F.col("row").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("row").alias("b"), F.col("sig").alias("sig_b")), "b")
    stars = written(_prune(stars, least), "stars")
    texts = texts_of(stars.select(F.col("a").alias("row")).unionByName(stars.select(F.col("b").alias("row"))))

    best = stars.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")).select("a", "b")
    found = written(_verify(best, texts, words, over, under), "links")
    tables, links = [links, found], links.unionByName(found)
    comps = components_table(links)
    rest = _apart(stars.join(best, ["a", "b"], "left_anti"), comps)
    found = written(_verify(rest, texts, words, over, under), "links")
    forget(comps, stars, texts)
    tables, links = [*tables, found], links.unionByName(found)
    comps = components_table(links)

    # Buckets that still hold several components, besides pairs with the smallest member alone.
    here = shared.where("size > 2").select("bucket", "row").join(comps.withColumnRenamed("id", "row"), "row", "left").join(full.select("row", "chars"), "row")
    here = here.select("bucket", "row", F.coalesce("component_id", "row").alias("comp"), "chars")
    mixed = here.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("chars").alias("chars")).where("lo != hi")
    mixed = mixed.select("bucket", F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("chars") / F.lit(BLOCK_CHARS)), F.lit(1)).cast("int").alias("blocks"))
    # A large bucket's rows meet its one row in several tasks.
    here = here.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cells = here.join(mixed, ["bucket", "salt"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("bucket", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), (F.col("block") > F.col("to")).cast("int").alias("side"), "row", "comp")
    dealt = lambda x: x.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    # Signatures go to every cell of a row, its text only to those where they leave a pair to compare.
    promising = written(_promising(dealt(cells.join(sigs, "row")), least), "promising")
    if not promising.isEmpty():
        texts = texts_of(promising.select("row"))
        found = written(_compare_cells(dealt(promising.join(sigs, "row").join(texts, "row")), least, words, over, under), "links")
        forget(comps, texts)
        tables, links = [*tables, found], links.unionByName(found)
        comps = components_table(links)
    forget(shared, promising, *tables)

    # A component's name is the smallest key in it.
    own = F.struct("id", "mark")
    names = written(comps.join(sets.select(F.col("row").alias("id"), own.alias("own")), "id").groupBy("component_id").agg(F.min("own").alias("name")), "names")
    out = sets.select("row", "id", "mark", "n").join(members.select("row", "rep", "first"), "row", "left")
    out = out.select("id", "mark", "n", F.coalesce("rep", "row").alias("node"), F.coalesce("first", own).alias("alone"))
    out = out.join(comps.withColumnRenamed("id", "node"), "node", "left").join(names, "component_id", "left")
    first = F.coalesce("name", "alone")
    kept = first["id"] == F.col("id") if by_key else first == own
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), first["id"].alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"), F.col("mark").alias("text_mark"))
    return out.drop("text_mark") if by_key else out
