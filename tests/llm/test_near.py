"""Near copies of texts and vectors, and components, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from permitloom.llm import components, minhash, queries, vectors
from permitloom.llm.common import written

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows):
    s = {k: shingles(t) for k, t in rows}
    groups, ids = Sets(s), sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                groups.join(a, b)
    return {k: (len(s[k]), groups.find(k), groups.find(k) == k) for k in s}


def variant(rng, words, share):
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in words)


def test_edges_of_the_definition(spark):
    rows = [(7, "a b c"), (3, "A B\tC"), (9, "a b c d"), (1, None), (2, ""), (4, " \n "), (5, "É a b c d"), (6, "é a b c d"), (8, "a b c d e f g h"), (10, "a b c d e f g h i"), (11, "a b c d e f g x y z"), (12, "a b c d e f g h\x85 i")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows) and got[7][1] == 3 and got[8][1] == 8 and got[10][1] == 8


def test_random_groups(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.randint(30, 400))]
        rows += [variant(rng, words, rng.choice([0, 0.01, 0.03, 0.05, 0.06])) for _ in range(20)]
    rng.shuffle(rows)
    rows = [(k * 2, t) for k, t in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """A bucket in many blocks gives what one block gives."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(150)]
    rows = [(k, variant(rng, words, 0.02)) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_on_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op9_minhash(spark, SF).collect()} == brute(rows)


@pytest.mark.parametrize("words", [5, 3])
def test_slices_of_few_words(words):
    """A slice that holds one text of 0 to 6 words in all, alone or beside empty ones."""
    for n in range(7):
        text = " ".join("abcdef"[:n])
        for texts in ([text], ["", text, None]):
            sets, counts = minhash.shingle_sets(pa.array(texts, pa.string()), words)
            want = max(1, n - words + 1) if n else 0
            assert len(sets) == counts.sum() == want and len(set(sets.tolist())) == want
        # The same sets as in a slice with other words.
        assert minhash.shingle_sets(pa.array([text, "p q r s t u v"], pa.string()), words)[0][:want].tolist() == sets.tolist()


def test_one_short_text(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in minhash.near_duplicates(df).collect()] == [(1, 1, 1, True)]


def test_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str) == [(1, 2, 1, True), (None, 2, None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def brute_rows(rows):
    """Rows of one key are one document with the links of each."""
    s = [shingles(t) for _, t in rows]
    groups = Sets(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            near = None not in (rows[i][0], rows[j][0]) and both and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both)
            if same or near:
                groups.join(i, j)
    names = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            names[groups.find(i)] = min(k, names.get(groups.find(i), k))
    return sorted(((k, len(s[i]), None if k is None else names[groups.find(i)], k is None or names[groups.find(i)] == k) for i, (k, _) in enumerate(rows)), key=str)


X, Y = "a b c d e f g h", "p q r s t u v w x y z"
REPEATED = [
    [(5, X), (5, X), (3, X), (9, Y), (9, Y), (9, "other words")],
    [(3, X), (5, X), (5, Y), (7, Y + " end")],
    [(3, X), (5, X), (5, Y), (4, Y)],
    [(5, X), (5, ""), (5, None), (2, Y), (2, X), (1, ""), (8, "")],
    [(None, X), (None, X), (4, X), (None, None)],
    [(6, Y), (6, X), (6, X), (2, X + " i"), (2, "alone in it"), (1, "alone in it")],
]


@pytest.mark.parametrize("rows", REPEATED)
def test_repeated_keys(spark, rows):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, row int, mark string").repartition(3)
    got = minhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute_rows(rows)


def test_texts_of_one_key_apart(spark):
    rows = [(5, X), (5, Y), (3, X), (5, Y), (7, "unlike these"), (8, Y + " end"), (None, X), (8, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), by_key=False).collect()
    kept = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got]
    assert sorted(kept, key=str) == sorted([(5, 4, 3, False), (5, 7, 5, True), (3, 4, 3, True), (5, 7, 5, True), (7, 1, 7, True), (8, 8, 5, False), (None, 4, None, True), (8, 0, 8, True)], key=str)


def test_random_repeated_keys(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(8):
        words = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randint(5, 60))]
        rows += [(rng.randrange(40), variant(rng, words, rng.choice([0, 0, 0.02, 0.05]))) for _ in range(9)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute_rows(rows)


def test_long_text(spark):
    """Texts beyond the bytes of a slice, and a near copy of one."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(500_000)]
    rows = [(4, " ".join(words)), (2, " ".join(words[:-20_000])), (3, "w1 " * 1_200_000), (1, "w1 " * 7)]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {4: (2, False), 2: (2, True), 3: (1, False), 1: (1, True)}


def test_hub_in_several_tasks(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate([variant(random.Random(k), [f"w{i}" for i in range(90)], 0.01 * (k > 0)) for k in range(60)])]
    monkeypatch.setattr(minhash, "HUBS", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_pruning_keeps_similar_pairs():
    least = minhash.least_matches(0.75, 1e-6)
    rng = np.random.default_rng(1)
    seen = np.cumsum(rng.random((200_000, minhash.HASHES)) < 0.75, axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert (seen >= np.array(least)).all(1).mean() > 1 - 1e-4
    far = np.cumsum(rng.random((1000, minhash.HASHES)) < 0.3, axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert (far >= np.array(least)).all(1).mean() < 0.01


def test_shared_counts_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 900))).astype(np.uint64) for _ in range(30)]
    a, b = np.nonzero(~np.eye(30, dtype=bool))
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    assert minhash.shared_counts(sets, a, b).tolist() == want and minhash.shared_counts(sets, a[:50], b[:50]).tolist() == want[:50]


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {"path": [(k, k + 1) for k in range(200)], "star": [(500, k) for k in range(200)], "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]}[kind]
    rng.shuffle(edges)
    groups = Sets({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (9000, 9000)], "a long, b long").repartition(7)
    got = {r.id: r.component_id for r in components.connected_components(df).collect()}
    assert got == {x: groups.find(x) for e in edges if e[0] != e[1] for x in e}


def test_hubs_are_split(spark):
    """The final plans of both steps deal a hub's rows to several tasks."""
    edges = spark.range(20_000).select((F.col("id") + 1).alias("u"), F.lit(0).cast("long").alias("v")).unionByName(spark.range(3000).select((F.col("id") * 2 + 50_001).alias("u"), (F.col("id") * 2 + 50_000).alias("v")))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.shuffle.partitions": "8", "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        turned = written(edges.select(F.col("v").alias("u"), F.col("u").alias("v")).repartition(8), "edges")
        for step, e in ((components._large_star, turned), (components._small_star, turned)):
            out, _ = step(e)
            out.collect()
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_contraction_in_chunks(monkeypatch):
    """Forests of few nodes at a time join what one forest joins."""
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["u", "v"])
    monkeypatch.setattr(components, "CHUNK", 9)
    parts = list(components._contract(iter([batch])))
    whole, again = Sets(range(200)), Sets(range(200))
    for a, b in edges:
        whole.join(a, b)
    for a, b in (e for p in parts for e in zip(*(c.to_pylist() for c in p.columns), strict=True)):
        again.join(a, b)
    assert len(parts) > 5 and [whole.find(x) for x in range(200)] == [again.find(x) for x in range(200)]


def test_small_and_large_cells_agree(monkeypatch):
    """Pairs of cells compared many at once are those of cells compared one by one, some at a time."""
    rng = np.random.default_rng(4)
    cuts = np.concatenate([[0], np.cumsum(rng.integers(1, 30, 40))])
    own, x = rng.random(cuts[-1]) < 0.5, rng.integers(0, 6, cuts[-1])
    found = []
    for small, pairs in ((64, 100_000), (64, 7), (1, 100_000), (10, 50)):
        monkeypatch.setattr(vectors, "SMALL", small)
        monkeypatch.setattr(vectors, "PAIRS", pairs)
        got = vectors._pairs(cuts, np.zeros(cuts[-1], int), own, lambda a, b: x[a] == x[b], lambda f, o: x[f][:, None] == x[o][None, :])
        found.append(sorted((i, j) for a, b in got for i, j in zip(a.tolist(), b.tolist(), strict=True)))
    cell = np.searchsorted(cuts, np.arange(cuts[-1]), side="right")
    want = [(i, j) for i in range(cuts[-1]) for j in range(i + 1, cuts[-1]) if cell[i] == cell[j] and x[i] == x[j] and (own[i] or own[j])]
    assert all(f == want for f in found)


def brute_vectors(rows, threshold=0.93):
    """Each row is a vector of its own."""
    links, groups = [0] * len(rows), Sets(range(len(rows)))
    good = [(n, np.array(v, float), c) for n, (k, v, c) in enumerate(rows) if v and k is not None and c is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    for i, (a, x, c) in enumerate(good):
        for b, y, d in good[i + 1 :]:
            if c == d and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a], links[b] = links[a] + 1, links[b] + 1
                groups.join(a, b)
    names = {}
    for n, (k, _, _) in enumerate(rows):
        if k is not None:
            names[groups.find(n)] = min(k, names.get(groups.find(n), k))
    return sorted(((k, links[n], names.get(groups.find(n)), k is None or names[groups.find(n)] == k) for n, (k, _, _) in enumerate(rows)), key=str)


def found_vectors(df, **how):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, **how).collect()), key=str)


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for c in range(3):
        for _ in range(12):
            base = rng.normal(size=64)
            for _ in range(rng.integers(1, 14)):
                v = base + rng.normal(size=64) * rng.choice([0, 0.2, 0.28, 0.4])
                rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1, 3])], c))
                k += 1
    one = rows[0][1]
    rows += [(k, None, 0), (k + 1, [], 0), (k + 2, [0.0] * 64, 0), (k + 3, [float("nan")] + one[1:], 0), (k + 4, [None] + one[1:], 0), (k + 5, one, None), (k + 6, one[:63], 0), (k + 7, one, 0), (k + 8, [float("inf")] + one[1:], 0)]
    rows += [(None, one, 0), (3, one, 1), (3, one, 1), (3, one, 2), (3, one[:40], 2), (5, one[:40], 2)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n_links int, row int")
    want = brute_vectors(rows)
    for block in (vectors.BLOCK, 5):
        monkeypatch.setattr(vectors, "BLOCK", block)
        assert found_vectors(df) == want
    assert vectors.near_vectors(df.limit(0)).count() == 0
    for width, tables, probes, _ in vectors.SIZES[1:]:
        assert found_vectors(df, width=width, tables=tables, probes=probes) == want
    doubles = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert found_vectors(doubles) == want


@pytest.mark.parametrize("rows", [
    [(5, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0], 2), (4, [1.0, 2.0], 2)],
    [(5, [1.0, 2.0, 3.0], 1), (5, [3.0, -2.0, 1.0], 2), (4, [3.0, -2.0, 1.0], 2), (3, [1.0, 2.0, 3.0], 1)],
    [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (5, None, 1), (5, [0.0, 0.0], 1)],
    [(4, [1.0, 2.0, 3.0], 1), (4, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 1), (7, [0.0] * 3, 1), (8, [-0.0, 1.0], 1), (9, [0.0, 1.0], 1), (6, [5.0], 1), (1, [7.0], 1)],
])
def test_repeated_vector_keys(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    assert found_vectors(df) == brute_vectors(rows)


def test_long_vectors(spark):
    """Beyond the bytes of a step, and of lengths that are no power of two."""
    rng = np.random.default_rng(3)
    rows = []
    for n in (3000, 100):
        base = rng.normal(size=n)
        rows += [(len(rows) + k, (base + rng.normal(size=n) * 0.1).tolist(), 1) for k in range(70)]
    assert found_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == brute_vectors(rows)


def test_plans(spark):
    widths = [vectors.plan(n, 64)["width"] for n in (0, 50_000, 5_000_000, 10_000_000, 10**9)]
    assert widths == [2, 2, 2, 3, 4]
    df = spark.createDataFrame([(1, [1.0] * 64, 1), (2, None, None)], "vec_id long, embedding array<float>, label int")
    assert vectors.plan_for(df) == {"width": 2, "tables": 12, "probes": 3} == vectors.plan_for(df.limit(0))


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = vectors.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T) and np.allclose(vectors.hadamard(y), x)


@pytest.mark.parametrize("dimensions", [64, 128, 300, 768])
def test_recall_at_the_threshold(dimensions):
    """Of every width, from the rate at which pairs at the threshold meet in a table; and signs rule none out."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 1500, dimensions))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    axes = 2 << (dimensions - 1).bit_length()
    for width, _, probes, _ in vectors.SIZES:
        how = vectors.plan(vectors.BLOCK * axes**width // probes, dimensions)
        assert (how["width"], how["probes"]) == (width, probes)
        x, y = vectors._meets(*(vectors.codes(v, 3, width, probes) for v in (a, b)))
        assert (1 - (x | y).mean()) ** how["tables"] < 2e-5
    s, t = (vectors.signs(v).view(np.uint64) for v in (a, b))
    assert np.bitwise_count(s ^ t).sum(1).max() <= vectors.most_differing(0.93) < 64
