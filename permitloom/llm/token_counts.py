"""Token counts: the lengths of a tokenizer's encodings, without the ids.

Texts go through Arrow batches that are cut to an equal number of bytes.  Inside a
batch every text is split at safe boundaries, and each distinct segment is encoded once:

* ``tokenizers`` files whose pre-tokenizer drops white space: any run of ASCII white
  space is safe.  No token, special string or normalisation reaches across it, and it
  yields no token itself, so a text's count is the sum over its segments.
* ``sentencepiece`` models: white space is part of the pieces, so each text is
  encoded whole.

Nulls count as empty texts (0 bytes, 0 tokens); a text without white space is one
segment, however long, and a long text is counted in parts cut at white space; an empty table
gives an empty result; extra columns are ignored, whatever their names; repeated rows are counted
each.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from permitloom.llm.common import PART_CHARS, apart, byte_slices, coded, out_batch, part_sums, split_words, string

#: Segments whose counts a worker remembers; the memory starts anew when it is full.
MEMO = 1_000_000
#: Bytes of text whose segments are looked up at once.
SLICE = 6 << 20
#: Segments that the library encodes at once.
STEP = 8192
#: Longer segments are not remembered.
MEMO_CHARS = 64
WHITE = re.compile("[ \\t-\\r]+")


class SegmentCounter:
    """Counts of segments by a ``tokenizers`` file, each distinct one encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The count of each text; a long one is the sum of its parts, counted one after another."""
        texts, parts = apart(texts, WHITE, PART_CHARS)
        step = len(texts) if (parts == 1).all() else 1
        counts = [self._count(texts.slice(k, step)) for k in range(0, len(texts), max(1, step))]
        return part_sums(np.concatenate([np.zeros(0, np.int64), *counts]), parts)

    def _count(self, texts: pa.Array) -> np.ndarray:
        offsets, words = split_words(texts)
        codes, distinct = coded(words)
        names = distinct.to_pylist()
        counts = [self.memo.get(x, -1) for x in names]
        new = [i for i, n in enumerate(counts) if n < 0]
        if new:
            for k in range(0, len(new), STEP):
                part = new[k : k + STEP]
                for i, e in zip(part, self.tokenizer.encode_batch_fast([names[i] for i in part], add_special_tokens=False), strict=True):
                    counts[i] = len(e)
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
            self.memo.update((names[i], counts[i]) for i in new if len(names[i]) <= MEMO_CHARS)
        sums = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64)[codes])]) if len(codes) else np.zeros(1, np.int64)
        return sums[offsets[1:]] - sums[offsets[:-1]]


class PieceCounter:
    """Counts of whole texts by a ``sentencepiece`` model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(x) for x in self.model.encode(pc.fill_null(texts, "").to_pylist(), num_threads=1)], dtype=np.int64)


@lru_cache(maxsize=2)
def counter_of(path: str) -> SegmentCounter | PieceCounter:
    """One counter for all tasks of a worker."""
    return (PieceCounter if path.endswith(".model") else SegmentCounter)(path)


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) of each row."""
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer_path)
        for batch in byte_slices(batches, "text", SLICE):
            texts = string(batch.column("text"))
            n = counter(texts)
            keyed = schema.insert(0, pa.field("key", batch.schema.field("key").type))
            yield out_batch([batch.column("key"), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), n, n > limit], keyed)

    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
