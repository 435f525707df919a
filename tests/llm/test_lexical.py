"""Ranked search against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from permitloom.llm import lexical, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def plainly(docs, items, k):
    """Rows (item, rank, key, score) of (key, text) documents and (item, text) queries."""
    held = [(key, Counter(w), len(w)) for key, text in docs if (w := terms(text))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, some in asked.items():
        scored = []
        for key, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in some if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=5):
    d = docs if hasattr(docs, "columns") else spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = items if hasattr(items, "columns") else spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.search(lexical.build(d), q, k).collect()), key=str)


def test_terms_and_counts():
    texts = pa.array(["A b-C 1 É日 x_y", None, "", "...", "ab", "ZZ", "a" * 10 + "\x7f" + "b"])
    assert lexical.count_terms(texts).tolist() == [len(terms(t)) for t in texts.to_pylist()]
    assert lexical.count_terms(texts.slice(3)).tolist() == [0, 1, 1, 2]
    offsets, words = lexical.terms_of(texts.slice(0, 2))
    assert words.to_pylist() == ["a", "b", "c", "1", "É日", "x", "y"] and offsets.tolist() == [0, 7, 7]


def test_bytes_bound_the_weights():
    tf, m = np.meshgrid([1, 2, 3, 300, 10**6], [50, 51, 100, 5000, 10**9])
    w = lexical.weights(tf.ravel().astype(np.int64), m.ravel().astype(np.int64))
    b = -(-w // lexical.UNIT)
    assert (b <= 255).all() and (b * lexical.UNIT >= w).all() and ((b - 1) * lexical.UNIT < np.maximum(w, 1)).all()


def test_bounds_leave_most_documents_out(spark):
    r = random.Random(2)
    docs = [(k, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(5, 60)))) for k in range(3000)]
    seen, whole = [], lexical.candidates

    def watched(*x):
        seen.append(whole(*x))
        return seen[-1]

    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    rows = [r.asDict() | {"block": 0, "w": 1000, "nums": [7]} for r in index.shards.collect() if r.term in ("", "aa", "b")]
    rows.sort(key=lambda r: (r["shard"], r["term"]))
    batch = pa.RecordBatch.from_pylist(rows)
    try:
        lexical.candidates = watched
        out = pa.Table.from_batches(lexical._searched(5, pa.int64())(iter([batch])))
    finally:
        lexical.candidates = whole
    assert out.num_rows == 5 and 5 <= sum(c.sum() for c in seen) < 600


@pytest.mark.parametrize("block", [512, 2])
def test_random_texts(spark, monkeypatch, block):
    """Many equal scores, few and many documents a term, several shards and blocks of queries."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    r = random.Random(block)
    text = lambda n: " ".join(r.choice("abcdefghij") * r.choice([1, 1, 2]) for _ in range(r.randint(0, n)))
    docs = [(r.choice([k, k, k % 7, None]), text(40)) for k in range(120)]
    items = [(k, text(8)) for k in range(7)] + [(3, text(4)), (None, text(5)), (None, text(5))]
    assert found(spark, docs, items) == plainly(docs, items, 5)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "Ab aB"), (5, "é É x"), (6, "b " * 400 + "x"), (7, "ab x"), (7, "ab x"), (8, "long " * 900 + "x")]
    items = [(1, "AB x"), (2, None), (3, ""), (4, "nowhere"), (5, "É b long")]
    assert found(spark, docs, items) == plainly(docs, items, 5)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
    wide = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id string, text string, term string, m int").withColumn("doc_id", F.lit("k"))
    assert found(spark, wide, spark.createDataFrame([("i", "b", 3)], "item_id string, text string, num int")) == [("i", 1, "k", 287 * (10**9 // 3000))]
    broken = spark.createDataFrame([(9, "")], "doc_id long, text string").withColumn("text", F.expr("cast(X'61FF62' as string)"))
    assert found(spark, broken, [(1, "a�b"), (2, "a")]) == [(1, 1, 9, 287 * (10**9 // 3000))]


def test_long_texts_in_parts(monkeypatch):
    texts = pa.array(["one two, one " * 50, "b", "one " * 3])
    want = lexical.postings(texts)
    monkeypatch.setattr(lexical, "PART_CHARS", 40)
    got = lexical.postings(texts)
    rows = lambda x: sorted(zip([x[0][i].as_py() for i in x[1].tolist()], x[2].tolist(), x[3].tolist(), strict=True))
    assert rows(got) == rows(want) == [("b", 1, 1), ("one", 0, 100), ("one", 2, 3), ("two", 0, 50)]
    assert lexical.length_terms(np.array([3, 1 << 55], np.int64), 10**6, 10**15)[1] == 50 + (50 * (1 << 55) * 10**6) // 10**15


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op11_search(spark, SF).collect()), key=str) == plainly(docs, items, 50)
