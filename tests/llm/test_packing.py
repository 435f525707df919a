"""Packed pieces against the library's ids and plain arithmetic."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from permitloom.llm import packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  b", "\n x", None, "it's  <|endoftext|> b 0", "0", "a0 0 10", "<|startoftext|>X don't", "é́ ́x", "Σς ΑΣ ab12 3", "x\x1cy z\x85 q\xa0 r", "日本語" * 50, "a" * 5000, "😀 ok\n\n", "word " * 3000]


TOKENIZER = Tokenizer.from_file(PATH)


def library(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(rows, docs, length=2048):
    """Pieces of (key, ids) documents: each id in one piece, sequences gapless, none but the last ones of a range short."""
    ids, of = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id, r.doc_tokens].append(r)
    for k, x in docs:
        ids[k, len(x)].append(x)
    assert set(ids) == set(of)
    for k, several in ids.items():
        here = defaultdict(list)
        for r in of[k]:
            here[r.start].append(r)
        assert sum(r.length for r in of[k]) == sum(map(len, several))
        at = [0] * len(several)
        if len(several) == 1:
            for r in sorted(of[k], key=lambda r: r.start):
                assert r.start == at[0] and r.ids_crc32 == crc(several[0][r.start : r.start + r.length])
                at[0] += r.length
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= length and at.bit_count() == 1  # nothing to pad
    return sequences


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_words_are_encoded_as_the_library_does():
    import pyarrow as pa

    encode = packing.WordEncoder(PATH)
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["0", "a0", "", "don't", "x　y", "Ünï", "!!", "12"]) + str(rng.randrange(50)) for _ in range(700)) for _ in range(8)]
    for _ in range(2):  # once more with words known
        ids, n = encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library(t) for t in texts]


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_CHARS", 100)
    import pyarrow as pa

    texts = ["some words, 10 of them 0 0 " * 40, "short", "x" * 500]
    ids, n = packing.WordEncoder(PATH)(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library(t) for t in texts]


def test_odd_rows(spark):
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(3, "again and again", 1), (None, "no key", 1), (None, "no key", 1), (70, "same " * 50, 1), (70, "same " * 50, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    got = packing.pack(df, PATH, end_id=1, digest=True)
    check(got.collect(), [(k, [*library(t), 1]) for k, t, _ in rows])
    small = packing.pack(df, PATH, end_id=1, length=64)
    for r in packing.sequences(small, pad_id=9, length=64).collect():
        assert len(r.ids) == r.n_tokens
    assert small.agg(F.sum("length")).first()[0] == sum(len(library(t)) + 1 for _, t, _ in rows)
    assert packing.pack(df.limit(0), PATH, end_id=1).count() == 0
    broken = df.limit(1).select("doc_id", F.expr("cast(X'61FF62' as string)").alias("text"))
    check(packing.pack(broken, PATH, 1, digest=True).collect(), [(broken.first().doc_id, [*library("a�b"), 1])])


def test_sequences_are_padded(spark):
    pieces = spark.createDataFrame([(1, 0, [1, 2]), (1, 2, [3]), (2, 0, [4, 5])], "sequence_id long, offset long, ids array<int>")
    assert sorted((r.sequence_id, r.ids, r.n_tokens) for r in packing.sequences(pieces, 0, 8).collect()) == [(1, [1, 2, 3, 0, 0, 0, 0, 0], 3), (2, [4, 5], 2)]


def test_query(spark):
    """Ids are the library's; documents that follow one another are alike more often than by chance."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.op12_packing(spark, SF).collect()
    sequences = check(rows, [(d.doc_id, [*library(d.text), 1]) for d in docs])
    assert len(sequences) <= sum(len(library(d.text)) + 1 for d in docs) // 2048 + 12
    lang = {d.doc_id: d.lang for d in docs}
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    near = np.mean([lang[a] == lang[b] for a, b in zip(order, order[1:], strict=False)])
    by_chance = sum((list(lang.values()).count(x) / len(lang)) ** 2 for x in set(lang.values()))
    assert near - by_chance > 0.5 * (1 - by_chance)
    place, texts = {k: i for i, k in enumerate(order)}, defaultdict(list)
    for d in docs:
        texts[d.text].append(place[d.doc_id])
    copies = [sorted(p) for p in texts.values() if len(p) > 1]
    assert copies and all(p[-1] - p[0] == len(p) - 1 for p in copies)


def test_words_leave_arrow_as_one_text(monkeypatch):
    """A slice's words are taken from Arrow at once, and are the same as one by one; none, odd letters and a part of an array alike."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pa.array(["a", "x\x1cy", "é́", "日本語", "0", "z\x85", "\xa0", "😀"])
    for some in (words, words.slice(2, 3), words.slice(0, 0)):
        assert packing.words_of(some) == some.to_pylist()
    joined, seen = pc.binary_join, []
    monkeypatch.setattr(packing.pc, "binary_join", lambda *a: seen.append(len(a[0].values)) or joined(*a))
    ids, n = packing.WordEncoder(PATH)(pa.array(["b a b", None, "a c"]))
    assert seen == [3] and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library("b a b"), [], library("a c")]
