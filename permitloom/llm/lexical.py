r"""Ranked lexical search by a two-level quantised index.

Terms are the maximal runs of bytes that are digits, letters or no ASCII, of which A to Z are made lower case.  The
index has shards of some megabytes of text: for each of a shard's terms the documents that hold it, a
byte for each (level one) and the number of occurrences (level two), and for the shard the documents'
keys and length terms.  Occurrences tf in a document with the length term m weigh

    (10**9 tf) div (10**3 tf + 20 m)     with     m = 100 - 50 + (50 n N) div L,

for n terms in the document and L in all N documents that have any.  The byte is this weight over
``UNIT``, rounded up, so it times the unit is an upper bound, and one less a lower bound.  A term found in df documents
counts floor(1000 ln((2 N + 2) / (2 df + 1))) times.

A search reads the postings of the queries' terms, dealt out by shard and block of queries.  In each shard the bytes
give every document's bounds for every query of the block; documents whose upper bound reaches the
k-th lower bound (of the shard, or the k-th score of the shards that the task had before) are
scored exactly in integers.  A task keeps k documents for each query, and the tasks' are merged.

Rules: null and empty texts have no terms and are found by none; bytes that are no UTF-8 become U+FFFD, which is part of a
term; a long text is cut into parts between terms; equal scores are ranked by key, null keys last; repeated
rows are documents of their own; rows of one query key are one query, also those without a key; an empty
table on either side gives an empty result; extra columns are ignored, whatever their names.  Weights are exact to a document of
more terms than the corpus has documents, whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from permitloom.llm.common import PART_CHARS, apart, byte_slices, coded, forget, list_parts, split_words, string, valid_text, written

#: What a byte of level one stands for: 255 of it are no less than the largest weight.
UNIT = -(-(10**9 // 10**3) // 255)
#: Bytes of text, and documents, of a shard.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 14
#: Queries that a shard is searched for at once.
BLOCK = 512
#: Groups of tasks whose results are merged first.
MERGE = 64
SEPARATORS = re.compile("[\x00-/:-@\\[-`{-\x7f]+")
_TERM = np.array([bool(re.match("[^\x00-/:-@\\[-`{-\x7f]", chr(b))) for b in range(256)])
_PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if _TERM[b] else 32 for b in range(256))
_POSTINGS = "term string, shard long, n long, docs binary, impact binary, tf binary, keys array<{kind}>, m array<long>"


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each text begins, and the last ends, in the bytes of all."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return offsets - offsets[0], memoryview(data)[offsets[0] : offsets[-1]] if data else memoryview(b"")


def count_terms(texts: pa.Array) -> np.ndarray:
    """The number of terms of each text, with repeats."""
    offsets, data = _bytes_of(pc.fill_null(texts, ""))
    on = _TERM[np.frombuffer(data, np.uint8)]
    starts = on.copy()
    starts[1:] &= ~on[:-1]
    begin = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[begin] = on[begin]
    upto = np.concatenate([[0], np.cumsum(starts)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets per text, and the terms."""
    offsets, data = _bytes_of(pc.fill_null(texts, ""))
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(bytes(data).translate(_PLAIN)))
    return split_words(plain)


def postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms, and by term and text: the term's number, the text's number, the occurrences."""
    n = len(texts)
    texts, parts = apart(texts, SEPARATORS, PART_CHARS)
    owner = np.repeat(np.arange(n), parts)
    step = max(1, len(texts)) if (parts == 1).all() else 1
    names, keys, counts = [], [], []
    for at in range(0, len(texts), step):
        offsets, words = terms_of(texts.slice(at, step))
        codes, distinct = coded(words)
        pairs, tf = np.unique(codes.astype(np.int64) * n + np.repeat(owner[at : at + step], np.diff(offsets)), return_counts=True)
        names.append(distinct)
        keys.append(pairs)
        counts.append(tf)
    if len(names) == 1:
        return names[0], keys[0] // n, keys[0] % n, counts[0]
    # Terms of different parts have one number each.
    codes, distinct = coded(pa.concat_arrays(names) if names else pa.array([], pa.string()))
    base = np.cumsum([0, *map(len, names)])
    merged = np.concatenate([np.zeros(0, np.int64), *(codes[b + k // n].astype(np.int64) * n + k % n for b, k in zip(base, keys, strict=False))])
    pairs, at = np.unique(merged, return_inverse=True)
    tf = np.bincount(at, np.concatenate([np.zeros(0, np.int64), *counts]), len(pairs)).astype(np.int64)
    return distinct, pairs // max(1, n), pairs % max(1, n), tf


def weights(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (10**3 * tf + 20 * m)


def length_terms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of so many terms; in Python's integers where 64 bits don't hold the product."""
    if not len(n) or int(n.max()) * 50 * documents < 1 << 63:
        return 50 + (50 * n * documents) // max(1, terms)
    return np.array([50 + (50 * x * documents) // terms for x in n.tolist()], np.int64)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values, ending before ``ends``, as bytes."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for batch in byte_slices(batches, "text"):
        n = count_terms(string(batch.column("text")))
        documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [terms]})


def _shards(documents: int, terms: int) -> Callable:
    """A row for each term of a shard, and before them one of the empty term for the shard's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        for whole in byte_slices(batches, "text", SHARD_BYTES):
            for at in range(0, whole.num_rows, SHARD_DOCS):
                batch = whole.slice(at, SHARD_DOCS)
                names, term, doc, tf = postings(string(batch.column("text")))
                m = length_terms(np.bincount(doc, tf, batch.num_rows).astype(np.int64), documents, terms)
                ends = np.cumsum(np.bincount(term, minlength=len(names)))
                impact = -(-weights(tf, m[doc]) // UNIT)
                widest = np.maximum.reduceat(tf, np.concatenate([[0], ends[:-1]])) if len(names) else ends
                # Occurrences take one byte or four, the same for all of a term's.
                wide = np.repeat(widest > 255, np.diff(np.concatenate([[0], ends])))
                size = np.where(wide, 4, 1)
                raw = np.zeros(int(size.sum()), np.uint8)
                begin = np.cumsum(size) - size
                for b in range(4):
                    on = size > b
                    raw[begin[on] + b] = tf[on] >> (8 * b) & 255
                tf_ends = np.cumsum(size)[ends - 1] if len(names) else ends
                k, keys = len(names), batch.column("key")
                none = pa.array([b""], pa.binary())
                lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)] + [len(x)] * k, pa.int32()), x)
                columns = [pa.concat_arrays([pa.array([""]), names]), pa.array(np.full(k + 1, shard)), pa.array(np.concatenate([[0], np.diff(np.concatenate([[0], ends]))]).astype(np.int64))]
                columns += [pa.concat_arrays([none, x]) for x in (_binary(doc.astype("<u2"), ends), _binary(impact.astype(np.uint8), ends), _binary(raw, tf_ends))]
                columns += [lists(keys), lists(pa.array(m))]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "shard", "n", "docs", "impact", "tf", "keys", "m"])
                shard += 1

    return run


@dataclass
class Index:
    """The table of shards, and the numbers of documents that have terms, and of their terms."""

    shards: DataFrame
    documents: int
    terms: int

    def forget(self) -> None:
        forget(self.shards)


def build(df: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    rows = df.select(df[key].alias("key"), valid_text(df[text]).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    of = rows.select("text").mapInArrow(_counted, "documents long, terms long").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).first()
    documents, terms = of.documents or 0, of.terms or 0
    return Index(written(rows.mapInArrow(_shards(documents, terms), _POSTINGS.format(kind=kind)), "shards"), documents, terms)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text"):
        names, term, doc, _ = postings(string(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("num").take(pa.array(doc)), names.take(pa.array(term))], names=["num", "term"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Of rows sorted by block and shard: each shard's rows, and their block."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        block, shard = (np.asarray(t.column(c)) for c in ("block", "shard"))
        cuts = np.concatenate([[0], np.nonzero((block[1:] != block[:-1]) | (shard[1:] != shard[:-1]))[0] + 1])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(block[a]), t.slice(a, b - a)
        held = t.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield int(held.column("block")[0].as_py()), held


class _Best:
    """The best ``k`` documents of each query so far."""

    def __init__(self, k: int, kind: pa.DataType):
        self.k, self.num, self.score, self.key = k, np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], kind)

    def least(self, nums: np.ndarray) -> np.ndarray:
        """The k-th score of each query, 0 if it has fewer; rows are sorted by query and score."""
        first, last = np.searchsorted(self.num, nums), np.searchsorted(self.num, nums, side="right")
        full = last - first >= self.k
        return np.where(full, self.score[np.where(full, first + self.k - 1, 0)] if len(self.score) else 0, 0)

    def add(self, num: np.ndarray, score: np.ndarray, key: pa.Array) -> None:
        num, score, key = np.concatenate([self.num, num]), np.concatenate([self.score, score]), pa.concat_arrays([self.key, key])
        by = pa.table({"num": num, "score": score, "key": key})
        order = np.asarray(pc.sort_indices(by, sort_keys=[("num", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_end"))
        place = np.arange(len(order)) - np.searchsorted(num[order], num[order])
        order = order[place < self.k]
        self.num, self.score, self.key = num[order], score[order], key.take(pa.array(order))


def candidates(upper: np.ndarray, lower: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Of documents x queries: whose upper bound reaches the k-th lower bound, the ``least`` score asked for, and 1."""
    reach = np.maximum(least, 1)
    if len(lower) >= k:
        reach = np.maximum(reach, np.partition(lower, len(lower) - k, axis=0)[len(lower) - k])
    return upper >= reach


def _searched(k: int, kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, present = _Best(k, kind), None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(best.num), pa.array(best.score), best.key], names=["num", "score", "key"])

        for block, rows in _groups(batches):
            if present is not None and block != present:
                yield out()
                best = _Best(k, kind)
            present = block
            keys, m = (list_parts(rows.column(c).slice(0, 1).combine_chunks())[1] for c in ("keys", "m"))
            m = np.asarray(m)
            rows = rows.slice(1).combine_chunks()
            if not rows.num_rows:
                continue
            w, lists = np.asarray(rows.column("w")), rows.column("nums").to_pylist()
            nums, flat = np.unique(np.concatenate([np.asarray(x) for x in lists]), return_inverse=True)
            of = np.split(flat, np.cumsum([len(x) for x in lists])[:-1])
            docs = [np.frombuffer(x, "<u2").astype(np.int64) for x in rows.column("docs").to_pylist()]
            impact = [np.frombuffer(x, np.uint8).astype(np.int64) for x in rows.column("impact").to_pylist()]
            upper, slack = np.zeros((len(m), len(nums)), np.int64), np.zeros((len(m), len(nums)), np.int64)
            for d, q, a, i in zip(docs, of, impact, w.tolist(), strict=True):
                at = np.ix_(d, q)
                upper[at] += (i * UNIT * a)[:, None]
                slack[at] += (i * UNIT * (a > 0))[:, None]
            chosen = candidates(upper, upper - slack, best.least(nums), k)
            del upper, slack
            exact = np.zeros(chosen.shape, np.int64)
            for d, q, raw, i in zip(docs, of, rows.column("tf").to_pylist(), w.tolist(), strict=True):
                r, c = np.nonzero(chosen[np.ix_(d, q)])
                if len(r):
                    tf = np.frombuffer(raw, f"<u{len(raw) // len(d)}")[r].astype(np.int64)
                    exact[d[r], q[c]] += i * weights(tf, m[d[r]])
            d, q = np.nonzero(exact)
            best.add(nums[q], exact[d, q], keys.take(pa.array(d)))
        if present is not None:
            yield out()

    return run


def search(index: Index, queries: DataFrame, k: int, text: str = "text", key: str = "item_id", out: str = "doc_id") -> DataFrame:
    """``key``, rank (from 1), ``out``, score of the ``k`` best documents of each query; fewer where fewer score above 0."""
    given = queries.select(queries[key].alias("item"), valid_text(queries[text]).alias("text"))
    items = written(given.select("item").distinct().withColumn("num", F.monotonically_increasing_id()), "queries")
    texts = given.join(items.withColumnRenamed("item", "of"), F.col("item").eqNullSafe(F.col("of"))).select("num", "text")
    asked = written(texts.mapInArrow(_query_terms, "num long, term string").distinct(), "query-terms")
    found = index.shards.where("term != ''").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df").cast("double") + 1)))
    blocks = max(1, -(-items.count() // BLOCK))
    block = F.pmod(F.xxhash64("num"), F.lit(blocks)).cast("int")
    wanted = asked.join(found.select("term", weight.alias("w")).where("w > 0"), "term").groupBy("term", "w", block.alias("block")).agg(F.collect_list("num").alias("nums"))
    wanted = written(wanted, "wanted")
    of = index.shards.schema["keys"].dataType.elementType
    rows = index.shards.where("term != ''").join(wanted, "term").select("block", "shard", "term", "docs", "impact", "tf", "w", "nums", F.lit(None).cast(f"array<{of.simpleString()}>").alias("keys"), F.lit(None).cast("array<long>").alias("m"))
    heads = index.shards.where("term = ''").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "term", "docs", "impact", "tf", F.lit(0).cast("long").alias("w"), F.array().cast("array<long>").alias("nums"), "keys", "m")
    dealt = heads.unionByName(rows).repartition("block", "shard").sortWithinPartitions("block", "shard", "term")
    best = dealt.mapInArrow(_searched(k, to_arrow_type(of)), f"num long, score long, key {of.simpleString()}").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
    order = [F.desc("score"), F.asc_nulls_last("key")]
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("num", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "part")
    best = written(best.withColumn("rank", F.row_number().over(Window.partitionBy("num").orderBy(*order))).where(F.col("rank") <= k), "best")
    forget(asked, wanted)
    return best.join(items, "num").select(F.col("item").alias(key), "rank", F.col("key").alias(out), "score")
