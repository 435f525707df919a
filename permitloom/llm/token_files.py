"""Token-id output: tokenised documents in Simple-8b shard files, and their reader.

A shard holds documents of one range of ascending keys: a stream of ids (each
document's ids and then an end id) in Simple-8b blocks, then a footer with per-block
offsets and counts, and the key and length of each document.  Blocks are independent of
one another, so a reader can fetch any of them by its offset and decode many at once.

Layout, little endian: 8 bytes magic; for each block its words and its raw values (u64);
footer: per block byte offset (u64), words, raw values, values (u32 each), per document
key (i64), null mark (u8), ids (u32); then the numbers of blocks and of documents and the
footer's offset (u64 each), and the magic again.

An attempt of a task writes a file of its own, and the manifest names those of the attempts that
Spark accepts.

Rows with null keys come first and keep a null key; null texts are empty and give the
end id alone; long texts are encoded whole, in parts cut where the tokenizer cuts too; repeated
keys keep their own rows (ties are ordered by text); an empty table gives no shards; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitloom.llm import simple8b
from permitloom.llm.common import PART_CHARS, apart, byte_slices, coded, list_parts, out_batch, part_sums, ragged, scratch, string
from permitloom.operators.files import file_system

MAGIC = b"PLS8B\x00\x01\n"
#: Distinct words, and their ids, that a worker keeps; beyond either it forgets those that came up once.
MEMO = 2_000_000
MEMO_IDS = 12_000_000
#: Bytes of text that are encoded at once.
SLICE = 12 << 20
#: Words that the library encodes at once.
STEP = 8192
#: Ids that a reader decodes at once.
READ_IDS = 1 << 20
#: White space next to white space, or at an end (or the mark used for cutting): such texts are encoded whole.
UNEVEN_SPACE = r"\x{1f}|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]{2}|^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]$"


#: Where a long text may be cut: before a space that stands between two characters that are none.
BETWEEN = re.compile(r"(?<=\S)(?= \S)")


class ByteEncoder:
    """Ids of whole texts by a byte-level ``tokenizers`` file, each distinct word encoded once.

    Its pre-tokenizer ends a token before a space that stands between two characters
    that are no white space, so such a text's ids are those of its first word followed by
    those of " word" for each later one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Words, their ids one after another, and whether a later batch has had the word too.
        self.known = pa.array([], pa.string())
        self.sizes, self.flat, self.again = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool)

    def _forget(self) -> None:
        """Keep the words that later batches have had too, if they are the smaller part; else none."""
        keep = self.again if self.again.mean() < 0.5 else np.zeros(len(self.again), bool)
        begins = np.cumsum(self.sizes) - self.sizes
        self.known = pa.concat_arrays([self.known.filter(pa.array(keep))])
        self.flat, self.sizes = self.flat[ragged(begins[keep], self.sizes[keep])], self.sizes[keep]
        self.again = np.zeros(len(self.sizes), bool)

    def _pieces(self, names: pa.Array) -> np.ndarray:
        """Where the store has each name; what it lacks is encoded."""
        at = pc.index_in(names, value_set=self.known)
        self.again[np.asarray(at.drop_null())] = True
        if at.null_count:
            lacking = names.filter(pc.is_null(at))
            lists, ids = lacking.to_pylist(), []
            for i in range(0, len(lists), STEP):
                ids += [e.ids for e in self.tokenizer.encode_batch_fast(lists[i : i + STEP], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
            self.sizes, self.again = np.concatenate([self.sizes, sizes]), np.concatenate([self.again, np.zeros(len(sizes), bool)])
            new = len(self.known) + np.cumsum(np.asarray(pc.is_null(at))) - 1
            self.known = pa.concat_arrays([self.known, lacking])
            at = pc.if_else(pc.is_null(at), pa.array(new), at.cast(pa.int64()))
        return np.asarray(at, dtype=np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; long ones are encoded in parts."""
        texts, parts = apart(pc.fill_null(texts, ""), BETWEEN, PART_CHARS)
        if (parts > 1).any():
            each = [self._encode(texts.slice(k, 1)) for k in range(len(texts))]
            return np.concatenate([ids for ids, _ in each]), part_sums(np.concatenate([n for _, n in each]), parts)
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MEMO or len(self.flat) > MEMO_IDS:
            self._forget()
        whole = np.asarray(pc.match_substring_regex(texts, UNEVEN_SPACE), dtype=bool)
        # A text that is encoded whole is one unit, like a first word.
        even = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~whole)), " ", "\x1f "), "\x1f")
        offsets, words = list_parts(even)
        units, distinct = coded(words)
        pieces = self._pieces(pa.concat_arrays([distinct, texts.filter(pa.array(whole))]))
        begins = np.cumsum(self.sizes) - self.sizes
        # The units of each text in row order.
        per_text = np.ones(len(texts), np.int64)
        per_text[~whole] = np.diff(offsets)
        rows = np.cumsum(per_text) - per_text
        order = np.empty(int(per_text.sum()), np.int64)
        order[ragged(rows[~whole], per_text[~whole])] = units
        order[rows[whole]] = len(distinct) + np.arange(int(whole.sum()))
        order = pieces[order]
        sizes = self.sizes[order]
        ids = self.flat[ragged(begins[order], sizes)]
        lengths = np.add.reduceat(sizes, rows) if len(rows) else np.zeros(0, np.int64)
        return ids, lengths


@lru_cache(maxsize=1)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for all tasks of a worker."""
    return ByteEncoder(path)


class ShardWriter:
    """Writes one shard, a file of this attempt alone."""

    def __init__(self, folder: str, name: str):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/{name}-{uuid.uuid4().hex}.s8b"
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.rest = np.zeros(0, np.uint32)
        self.blocks: list[np.ndarray] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((keys, nulls, lengths))
        ids = np.concatenate([self.rest, ids])
        stop = len(ids) - len(ids) % simple8b.BLOCK
        self._put(ids[:stop])
        self.rest = ids[stop:]

    def _put(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        words, raw, n_words, n_raw = simple8b.pack(ids)
        w, r = np.cumsum(n_words) - n_words, np.cumsum(n_raw) - n_raw
        if len(raw):
            self.out.write(b"".join(words[a : a + n].astype("<u8").tobytes() + raw[b : b + m].astype("<u8").tobytes() for a, n, b, m in zip(w, n_words, r, n_raw, strict=True)))
        else:
            self.out.write(words.astype("<u8").tobytes())
        sizes = 8 * (n_words + n_raw)
        counts = np.full(len(n_words), simple8b.BLOCK, np.int64)
        counts[-1] = len(ids) - (len(n_words) - 1) * simple8b.BLOCK
        self.blocks.append(np.stack([self.at + np.cumsum(sizes) - sizes, n_words, n_raw, counts]))
        self.at += int(sizes.sum())

    def close(self) -> tuple[str, int, int]:
        """The path, and the numbers of documents and ids."""
        self._put(self.rest)
        blocks = np.concatenate(self.blocks, axis=1) if self.blocks else np.zeros((4, 0), np.int64)
        keys, nulls, lengths = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        self.out.write(blocks[0].astype("<u8").tobytes() + b"".join(x.astype("<u4").tobytes() for x in blocks[1:]))
        self.out.write(keys.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + lengths.astype("<u4").tobytes())
        self.out.write(np.array([blocks.shape[1], len(keys), self.at], "<u8").tobytes() + MAGIC)
        self.out.close()
        return self.path, len(keys), int(lengths.sum())


class ShardReader:
    """Documents of one shard; blocks are fetched by offset and decoded many at a time."""

    def __init__(self, folder: str, path: str):
        fs, _ = file_system(folder)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(24 + len(MAGIC), size - 24 - len(MAGIC))
        if tail[24:] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        n, docs, at = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
        footer = self.file.read_at(size - at, at)
        self.offsets = np.frombuffer(footer, "<u8", n).astype(np.int64)
        self.words, self.raw, self.counts = (np.frombuffer(footer, "<u4", n, 8 * n + 4 * n * k).astype(np.int64) for k in range(3))
        base = 20 * n
        self.keys = np.frombuffer(footer, "<i8", docs, base)
        self.nulls = np.frombuffer(footer, "u1", docs, base + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(footer, "<u4", docs, base + 9 * docs).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` to ``last`` - 1."""
        n, m = self.words[first:last], self.raw[first:last]
        sizes = 8 * (n + m)
        data = np.frombuffer(self.file.read_at(int(sizes.sum()), int(self.offsets[first])), "<u8")
        starts = np.cumsum(n + m) - (n + m)
        words = data if not m.any() else data[ragged(starts, n)]
        return simple8b.unpack(words, data[ragged(starts + n, m)] if m.any() else data[:0], n, m, self.counts[first:last])

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Of runs of documents: the index of the first, and each one's ids."""
        doc, n, rest = 0, len(self.offsets), np.zeros(0, np.uint32)
        ends = np.cumsum(self.lengths)
        done = 0
        for b in range(0, n, step := max(1, READ_IDS // simple8b.BLOCK)):
            rest = np.concatenate([rest, self.ids(b, min(n, b + step)).astype(np.uint32)])
            stop = int(np.searchsorted(ends, done + len(rest), side="right"))
            if stop > doc:
                cuts = ends[doc:stop] - done
                yield doc, np.split(rest[: cuts[-1]], cuts[:-1])
                rest, done, doc = rest[cuts[-1] :], int(ends[stop - 1]), stop


def write_tokens(df: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Write ``df``'s texts as shards in ascending order of ``key``.

    Returns the manifest, a row per shard: path, n_docs, n_ids, start (ids of all shards
    before).  It has as many rows as the write has partitions.
    """
    spark = df.sparkSession
    folder = folder or scratch(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = None, None
        for batch in byte_slices(batches, "text", SLICE):
            encode = encode or byte_encoder(tokenizer_path)
            writer = writer or ShardWriter(folder, f"shard-{TaskContext.get().partitionId():06d}")
            keys = batch.column("key")
            ids, lengths = encode(string(batch.column("text")))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id)
            writer.add(np.asarray(pc.fill_null(keys, 0), dtype=np.int64), np.asarray(pc.is_null(keys), dtype=bool), lengths + 1, ids)
        if writer:
            path, docs, n = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [path], "n_docs": [docs], "n_ids": [n]})

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    shards = sorted(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long").collect())
    start, out = 0, []
    for s in shards:
        out.append((s.path, s.n_docs, s.n_ids, start, folder))
        start += s.n_ids
    return spark.createDataFrame(out, "path string, n_docs long, n_ids long, start long, folder string")


def read_tokens(spark: SparkSession, manifest: DataFrame, digest: bool = False, key: str = "doc_id") -> DataFrame:
    """Documents of the shards: ``key``, start, n_tokens and ids; with ``digest`` their crc32 instead of the ids."""
    last = pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.list_(pa.int64()))
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                reader = ShardReader(shard["folder"], shard["path"])
                starts = shard["start"] + np.cumsum(reader.lengths) - reader.lengths
                for doc, ids in reader.documents():
                    at = slice(doc, doc + len(ids))
                    keys = pa.array(reader.keys[at], mask=reader.nulls[at])
                    value = [zlib.crc32(np.ascontiguousarray(x, dtype="<u4")) for x in ids] if digest else [x.astype(np.int64) for x in ids]
                    yield out_batch([keys, starts[at], reader.lengths[at], pa.array(value, type=last.type)], schema)

    shards = max(1, manifest.count())
    kind = "ids_crc32 long" if digest else "ids array<long>"
    return manifest.repartition(shards, "path").mapInArrow(run, f"key long, start long, n_tokens long, {kind}").withColumnRenamed("key", key)
