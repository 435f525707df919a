"""Vector codes against plain integers."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from permitloom.llm import codes, queries

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 70), st.integers(1, 200), st.integers(0, 5), st.sampled_from([2, 5, 40, 1 << 25]), st.integers(0, 9999))
def test_search_is_a_whole_search(k, n, d, spread, seed):
    """With repeated entries and equal distances, from any start."""
    r = np.random.default_rng(seed)
    book, x = r.integers(-spread, spread, (k, d)), r.integers(-spread, spread, (n, d))
    code, best = codes.search(x, book, r.integers(0, k, n))
    far = ((x[:, None] - book[None]) ** 2).sum(-1)
    assert (code == far.argmin(1)).all() and (best == far.min(1)).all()


def test_search_leaves_far_entries_out():
    r = np.random.default_rng(1)
    book = np.stack([np.arange(64) * 1000, np.zeros(64)], 1).astype(np.int64)
    x = book[r.integers(0, 64, 500)] + r.integers(-3, 4, (500, 2))
    near = ((x[:, None] - book[None]) ** 2).sum(-1).argmin(1)
    apart = ((book[:, None] - book[None]) ** 2).sum(-1)
    within = (apart[near] <= 4 * ((x - book[near]) ** 2).sum(1)[:, None]).sum(1)
    assert (within == 1).all() and (codes.search(x, book, near)[0] == near).all()


def plainly(rows, parts=16, entries=64, rounds=2):
    """key, code, error, sum of the label's errors, by Python's own integers; and the codebooks' digest."""
    fine = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    ints = [[math.floor(256 * float(np.float32(v))) for v in r[1]] for r in fine]
    width = -(-max(map(len, ints), default=0) // parts)
    cut = [[(x + [0] * (width * parts))[p * width : (p + 1) * width] for p in range(parts)] for x in ints]
    first = sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0, np.array(ints[i], "<i4").tobytes()))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        found = [[min((dist(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        if k == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                if mine := [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == j]:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for r, e in zip(fine, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{j:02x}" for _, j in f), e, total[r[2]]) for r, f, e in zip(fine, found, errors, strict=True)), digest


def test_odd_rows(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=20).astype(np.float32).tolist(), str(k % 3), "x") for k in range(150)]
    rows += [(5, rows[5][1], "0", "x"), (5, rows[6][1], None, "x"), (None, rows[7][1], None, "x"), (900, [], "1", "x"), (901, [1.0] * 7, "1", "x"), (902, None, "1", "x"), (903, [None] * 20, "1", "x")]
    rows += [(904, [float("nan")] * 20, "1", "x"), (905, [float("inf")] + [0.0] * 19, "1", "x"), (906, [0.0] * 20, "2", "x"), (-4, rows[0][1], "2", "x"), (-4, rows[0][1], "2", "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, code string").repartition(5)
    found = codes.compress(df)
    got = sorted((str(x.key), x.code.hex(), x.error, x.label_error) for x in codes.with_label_errors(found.codes).collect())
    want, digest = plainly(rows)
    assert got == want and found.digest() == digest
    back = {x.key: x.vector for x in found.decoded().collect()}
    assert len(back[10]) == 32 and sum((a - b) ** 2 for a, b in zip(back[10], rows[10][1], strict=False)) < 20


def test_few_or_no_rows(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert codes.with_label_errors(codes.compress(spark.createDataFrame([], kind)).codes).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], kind)).codes.count() == 0
    one = codes.compress(spark.createDataFrame([(1, [0.5] * 32, 1), (2, [], 1)], kind))
    assert sorted((r.key, r.code, r.error) for r in one.codes.collect()) == [(1, b"\0" * 16, 0), (2, b"\1" * 16, 0)]
    assert [r.code for r in codes.compress(spark.createDataFrame([(1, [], 1)], kind)).codes.collect()] == [b"\0" * 16]


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op13_codes(spark, SF).collect()
    want, digest = plainly(rows)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want and {r.codebooks_sha256 for r in got} == {digest}
