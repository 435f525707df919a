"""Packing along a space-filling curve: documents in sequences of a fixed number of tokens, next to similar ones.

A document's ids (and an end id) are counted into a hashed vector of ``HASHED`` signed buckets, damped by
square roots and brought to length 1.  A fixed random matrix projects it to ``DIMS``
numbers, which the mean and spread over all documents and the normal distribution make even in 0 to 1;
their Hilbert key is the document's place.  Documents are sorted by key, by range partitions, and
each partition's ids are one stream, cut every ``length`` tokens.  What is left at a
partition's end becomes sequences of powers of two, so nothing is padded.

Documents of one key (copies, or empty texts) are put in the order they were read in, and that order is part of the
ranges, so that any number of copies is dealt to several tasks.  A partition's ids number its
sequences, and no task or driver sees the order of all.

Rules: null texts are empty and give the end id alone; bytes that are no UTF-8 become U+FFFD; a long text
is encoded whole, in parts cut at white space, and cut into pieces like any other; repeated rows
are documents of their own, also under one key or none; an empty table gives no pieces; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitloom.llm.common import PART_CHARS, apart, byte_slices, coded, forget, part_sums, ragged, split_words, string, valid_text, written

LENGTH = 2048
#: Buckets of a document's hashed vector, dimensions of its projection, and bits of each in the key.
HASHED, DIMS, BITS = 256, 4, 15
#: Bytes of text that are encoded at once.
SLICE = 8 << 20
#: Words, and their ids, that a worker keeps; beyond either it starts anew.  Longer words are not kept for later slices.
MEMO, MEMO_IDS, MEMO_CHARS = 1_000_000, 8_000_000, 64
#: Words that are encoded as one text, and texts that the library encodes at once.
JOINED, TEXTS = 512, 16
#: Bytes of ids of a range of the curve.
RANGE_BYTES = 16 << 20
WHITE = re.compile("[ \\t-\\r]+")


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file that drops white space, each distinct word encoded once.

    No token, special string or normalisation reaches across ASCII white space, so a text's ids are those of its
    words.  Words are encoded many at a time, as one text in which a digit that is always a
    token by itself stands between them; words that hold this digit are encoded alone.
    """

    MARK = "0"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = self.tokenizer.get_vocab_size()
        mark = self._ids([self.MARK])[0]
        self.mark = mark[0] if len(mark) == 1 and self._ids([f"a {self.MARK} b"]) == [[*self._ids(["a"])[0], *mark, *self._ids(["b"])[0]]] else None
        self._anew()

    def _anew(self) -> None:
        self.place: dict[str, int] = {}
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str]) -> None:
        """Encode words that are not there; they take the next places."""
        sizes, flat = [self.sizes], [self.flat]
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        for k in range(0, len(groups), TEXTS):
            some = groups[k : k + TEXTS]
            for group, ids in zip(some, self._ids([f" {self.MARK} ".join(g) for g in some]), strict=True):
                ids = np.array(ids, np.uint32)
                marks = np.nonzero(ids == self.mark)[0] if self.mark is not None else ids[:0]
                if len(marks) == len(group) - 1:
                    sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
                    flat.append(np.delete(ids, marks))
                else:
                    each = self._ids(group)
                    sizes.append(np.array([len(x) for x in each], np.int64))
                    flat.append(np.array([i for x in each for i in x], np.uint32))
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)

    def _places(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = np.nonzero(at < 0)[0].tolist()
        # Words with the mark are together at the end, so that few texts hold any.
        new = [k for k in new if self.MARK not in words[k]] + [k for k in new if self.MARK in words[k]]
        base = len(self.sizes)
        self._add([words[k] for k in new])
        at[new] = np.arange(base, base + len(new))
        for p, k in enumerate(new, base):
            if len(words[k]) <= MEMO_CHARS:
                self.place[words[k]] = p
        return at

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; long ones are encoded in parts."""
        texts, parts = apart(pc.fill_null(texts, ""), WHITE, PART_CHARS)
        if (parts > 1).any():
            each = [self._encode(texts.slice(k, 1)) for k in range(len(texts))]
            return np.concatenate([ids for ids, _ in each]), part_sums(np.concatenate([n for _, n in each]), parts)
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.sizes) > MEMO or len(self.flat) > MEMO_IDS:
            self._anew()
        offsets, words = split_words(texts)
        codes, distinct = coded(words)
        places = self._places(words_of(distinct)).take(codes)
        begins, sizes = np.cumsum(self.sizes) - self.sizes, self.sizes.take(places)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat.take(ragged(begins.take(places), sizes)), upto[offsets[1:]] - upto[offsets[:-1]]


def words_of(words: pa.Array) -> list[str]:
    """Words without white space as Python's, by one text: several times faster than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ") if len(words) else []


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path)


def projections(ids: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Each document's hashed vector in few dimensions; of a document without ids, zeros."""
    dealt = np.random.RandomState(12)
    bucket, sign = dealt.randint(HASHED, size=most), dealt.choice([-1.0, 1.0], size=most)
    matrix = dealt.normal(size=(HASHED, DIMS))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    v = np.bincount(owner * HASHED + bucket[ids], sign[ids], len(lengths) * HASHED).reshape(-1, HASHED)
    v = np.sign(v) * np.sqrt(np.abs(v))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) @ matrix


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates of so many bits (points x dimensions)."""
    x = [np.array(c, np.int64) for c in x.T]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for c in range(len(x)):
            flip = (x[c] >> b & 1).astype(bool)
            swapped = np.where(flip, 0, (x[0] ^ x[c]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swapped)
            if c:
                x[c] = x[c] ^ swapped
    for c in range(1, len(x)):
        x[c] = x[c] ^ x[c - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where(x[-1] >> b & 1, turn ^ ((1 << b) - 1), turn)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (c ^ turn) >> b & 1
    return key


def _encoded(tokenizer_path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in byte_slices(batches, "text", SLICE):
            encode = word_encoder(tokenizer_path)
            ids, lengths = encode(string(batch.column("text")))
            at = projections(ids, lengths, encode.most)
            ids = np.insert(ids, np.cumsum(lengths), end_id).astype("<u2" if max(encode.most, end_id + 1) <= 1 << 16 else "<u4")
            lengths = lengths + 1
            ends = np.concatenate([[0], np.cumsum(lengths)]) * ids.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())
            rows = pa.array(np.arange(row, row + len(lengths)))
            row += len(lengths)
            yield pa.RecordBatch.from_arrays([rows, batch.column("key"), pa.array(lengths), data, *map(pa.array, at.T.copy())], names=["row", "key", "n", "ids", *_axes()])

    return run


def _axes() -> list[str]:
    return [f"x{k}" for k in range(DIMS)]


def _curve(mean: list[float], spread: list[float]) -> Callable:
    @F.pandas_udf("long")
    def place(*x: pd.Series) -> pd.Series:
        z = (np.stack(x, 1) - mean) / spread
        even = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))
        return pd.Series(hilbert(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS))

    return place


def cut(lengths: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of these lengths, cut at the bounds (which end with their sum): each piece's run, and where it begins and ends in all."""
    ends = np.union1d(np.cumsum(lengths), bounds)
    begins = np.concatenate([[0], ends[:-1]])
    return np.searchsorted(np.cumsum(lengths), begins, side="right"), begins, ends


def _packed(length: int, digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        # Of the sequence that is not full yet: its documents' keys, sizes and where the rest of each begins, and the ids.
        keys, total, done, flat = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

        def pieces(upto: int, bounds: np.ndarray) -> pa.RecordBatch:
            run, begin, end = cut(total - done, np.append(bounds, len(flat)))
            on = end <= upto
            run, begin, end = run[on], begin[on], end[on]
            before = np.cumsum(total - done) - (total - done)
            at = np.searchsorted(bounds, begin, side="right")
            offset = begin - np.concatenate([[0], bounds])[at]
            some = [flat[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
            value = pa.array([zlib.crc32(x) for x in some], pa.int64()) if digest else pa.array(some, pa.list_(pa.int32()))
            columns = [keys.take(pa.array(run)), pa.array(done[run] + begin - before[run]), pa.array(end - begin), value, pa.array(total[run]), pa.array(first + at), pa.array(offset)]
            return pa.RecordBatch.from_arrays(columns, names=["key", "start", "length", "value", "doc_tokens", "sequence_id", "offset"])

        for whole in batches:
            for batch in byte_slices([whole], "ids"):
                n = np.asarray(batch.column("n"), dtype=np.int64)
                raw = b"".join(batch.column("ids").to_pylist())
                width = len(raw) // int(n.sum())
                keys = batch.column("key") if keys is None else pa.concat_arrays([keys, batch.column("key")])
                total, done = np.concatenate([total, n]), np.concatenate([done, np.zeros(len(n), np.int64)])
                flat = np.concatenate([flat, np.frombuffer(raw, f"<u{width}").astype("<u4")])
                if upto := len(flat) // length * length:
                    bounds = np.arange(length, upto + 1, length)
                    yield pieces(upto, bounds)
                    first += len(bounds)
                    ends = np.cumsum(total - done)
                    left = ends > upto
                    done = (done + np.maximum(0, upto - (ends - (total - done))))[left]
                    keys, total, flat = keys.filter(pa.array(left)), total[left], flat[upto:]
        if len(flat):
            powers = [1 << b for b in range(len(flat).bit_length() - 1, -1, -1) if len(flat) >> b & 1]
            yield pieces(len(flat), np.cumsum(powers))

    return run


def pack(df: DataFrame, tokenizer_path: str, end_id: int, length: int = LENGTH, text: str = "text", key: str = "doc_id", digest: bool = False) -> DataFrame:
    """Per piece of a document: ``key``, start (ids of the document before it), length, ids, doc_tokens, sequence_id, offset (there).

    With ``digest`` the crc32 of the ids (as little-endian 32-bit integers) stands instead of them.  ``length`` is a power of two.
    """
    rows = df.select(df[key].alias("key"), valid_text(df[text]).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    axes = _axes()
    encoded = written(rows.mapInArrow(_encoded(tokenizer_path, end_id), f"row long, key {kind}, n long, ids binary, {', '.join(f'{c} double' for c in axes)}"), "encoded")
    of = encoded.agg(F.sum(F.octet_length("ids").cast("long")).alias("bytes"), *[F.avg(c).alias(c) for c in axes], *[F.stddev_pop(c).alias(f"s{c}") for c in axes]).first()
    curve = _curve([of[c] or 0.0 for c in axes], [of[f"s{c}"] or 1.0 for c in axes])
    ranges = max(1, -(-(of["bytes"] or 0) // RANGE_BYTES))
    placed = encoded.select("key", "n", "ids", "row", curve(*axes).alias("curve"))
    ordered = placed.repartitionByRange(ranges, "curve", "row").sortWithinPartitions("curve", "row")
    value = "long" if digest else "array<int>"
    out = written(ordered.mapInArrow(_packed(length, digest), f"key {kind}, start long, length long, value {value}, doc_tokens long, sequence_id long, offset long"), "pieces")
    forget(encoded)
    return out.withColumnsRenamed({"key": key, "value": "ids_crc32" if digest else "ids"})


def sequences(pieces: DataFrame, pad_id: int, length: int = LENGTH) -> DataFrame:
    """sequence_id, ids (padded to ``length``, unless a power of two), n_tokens; at most ``length`` ids come together."""
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    rows = pieces.groupBy("sequence_id").agg(whole.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))
    power = F.bit_count("n_tokens") == 1
    return rows.withColumn("ids", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - F.size("ids")))))
