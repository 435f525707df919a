"""Token counts, token files, Simple-8b and pieces against their libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from permitloom.llm import pieces, queries, simple8b, token_counts, token_files

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b", "\n x", "x \n y", "　 b", "it's  <|endoftext|> b", "<|endoftext|>", " a", "a ", "<|startoftext|>X don't", "é́ ́x", "Σς ΑΣ ab12 3", "x\x1cy z\x85 q\xa0 r", "a\tb c\x0bd e", None, "x\x1fy z", "▁x  y", "\0 a", "日本語" * 50, "a" * 5000, "<s> </s> <0x0A>", "😀 ok\n\n", "word " * 3000]


def library(path):
    return Tokenizer.from_file(public_tokenizers.path(path))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=9000))
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    words, raw, n, m = simple8b.pack(v)
    counts = np.full(len(n), simple8b.BLOCK, np.int64)
    if len(n):
        counts[-1] = len(v) - (len(n) - 1) * simple8b.BLOCK
    assert (simple8b.unpack(words, raw, n, m, counts) == v).all()
    for k in range(len(n)):  # each block by itself
        w, r = words[n[:k].sum() : n[: k + 1].sum()], raw[m[:k].sum() : m[: k + 1].sum()]
        assert (simple8b.unpack(w, r, n[k : k + 1], m[k : k + 1], counts[k : k + 1]) == v[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


def test_simple8b_packs():
    words, raw, _, _ = simple8b.pack(np.arange(4096, dtype=np.uint32))
    assert len(words) < 4096 / 4 and not len(raw)


def test_token_counts_equal_the_library(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ODD)] + [(0, "again", 1)], "doc_id long, text string, n_tokens int")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(map(tuple, token_counts.count_tokens(df, path, 2048).collect()))
    n = lambda t: len(library("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids)
    want = sorted((k, len((t or "").encode()), n(t), n(t) > 2048) for k, t in [*enumerate(ODD), (0, "again")])
    assert got == want and any(w[3] for w in want)


def test_piece_counts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df, model, 5).collect()) == [(1, len(sentencepiece.SentencePieceProcessor(model_file=model).encode("a b"))), (2, 0)]


def test_count_query(spark):
    """The query's rows on the documents, counted by the library one by one."""
    tokenizer = library("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    n = {d.doc_id: len(tokenizer.encode(d.text or "", add_special_tokens=False).ids) for d in docs}
    want = sorted((d.doc_id, len((d.text or "").encode()), n[d.doc_id], n[d.doc_id] > 2048) for d in docs)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op7_token_counts(spark, SF).collect()) == want


def test_piece_query(spark):
    """The query's rows on the documents: the library's ids, their number and hash, and the way back."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = spark.createDataFrame([(d.doc_id, model.encode(d.text or "")) for d in docs], "doc_id long, ids array<int>")
    want = {r.doc_id: (r.n, r.h) for r in ids.select("doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("h")).collect()}
    back = {d.doc_id: model.decode(model.encode(d.text or "")) == (d.text or "").replace("\u2581", " ") for d in docs}
    got = queries.op3_pieces(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_hash) for r in got} == want and {r.doc_id: r.round_trip for r in got} == back


@pytest.mark.parametrize("name", ["op7_token_counts", "op2_token_files", "op3_pieces", "op1_decontaminate", "op6_langid"])
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_token_files(spark):
    rows = [(k * 3, t, "x") for k, t in enumerate(ODD)] + [(None, "null key", "x"), (3, "tie", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    manifest = token_files.write_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), 2)
    got = token_files.read_tokens(spark, manifest).orderBy("start").collect()
    tk, start = library("byte_bpe_50k.json"), 0
    for (key, text, _), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])), got, strict=True):
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (key, start, len(ids), ids)
        start += len(ids)


def test_token_file_query(spark):
    tk = library("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op2_token_files(spark, SF).collect()}
    start = 0
    for d in docs:
        ids = np.array([*tk.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pieces_equal_the_library(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("abeinst hro \nüxq▁.,0") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect()]
    texts = [t for t in ODD + noise + docs]
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, decoded string")
    both = pieces.decode(pieces.encode(df, path), path, text="back")
    assert both.columns == ["doc_id", "text", "decoded", "ids", "back"]
    want = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in both.collect():
        assert r.ids == want.encode(texts[r.doc_id] or "") and r.back == (texts[r.doc_id] or "").replace("▁", " ") and r.decoded == "kept"


def test_suffix_ranges_are_occurrences():
    e = pieces.Encoder(pieces.Model(public_tokenizers.path("piece_bpe_32k.model")))
    raw = "▁the▁thethe\0in▁then\0"
    points = np.array([ord(c) for c in raw], np.uint32)
    at = np.minimum(np.searchsorted(e.alphabet, points), len(e.alphabet) - 1)
    text = np.where(points == 0, 0, np.where(e.alphabet[at] == points, at + 2, 1))
    order = e.suffixes(text)
    lo, hi = e.ranges(text, order)
    names = [e.model.names[i] for i in e.piece_ids]
    for p, a, b in zip(names, lo, hi, strict=True):
        assert sorted(order[a:b].tolist()) == [i for i in range(len(raw)) if raw.startswith(p, i)]


@pytest.mark.parametrize("limit", [1, 7, 40])
def test_long_texts_in_parts(monkeypatch, limit):
    """Cutting texts into parts changes nothing."""
    for m in (pieces, token_counts, token_files):
        monkeypatch.setattr(m, "PART_CHARS", limit)
    rng = random.Random(limit)
    texts = ODD + ["".join(rng.choice("abe 's.\n  ▁é1") for _ in range(rng.randint(1, 120))) for _ in range(300)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    want = {
        pieces.Encoder(pieces.Model(path)): sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts]),
        token_files.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json")): [e.ids for e in library("byte_bpe_50k.json").encode_batch([t or "" for t in texts], add_special_tokens=False)],
    }
    for encode, right in want.items():
        ids, n = encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == right
    counts = token_counts.SegmentCounter(public_tokenizers.path("word_bpe_49k.json"))(pa.array(texts, pa.string()))
    assert counts.tolist() == [len(e) for e in library("word_bpe_49k.json").encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 1)
    monkeypatch.setattr(pieces, "INDEX_CHARS", 4)
    path = public_tokenizers.path("piece_bpe_32k.model")
    e = pieces.Encoder(pieces.Model(path))
    for t in ("one two three", "two three four", "日本 語"):
        ids, n = e(pa.array([t]))
        assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(t) and n.tolist() == [len(ids)]
