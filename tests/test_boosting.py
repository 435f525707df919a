"""Boosted trees against an exhaustive search, and metrics against plain counts."""

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from permitloom.config import ModelSpec
from permitloom.operators import boosting, ml


def frame(spark, x, y, parts=3):
    rows = [(float(b), [None if math.isnan(v) else float(v) for v in a]) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "label double, x array<double>").repartition(parts)


def exhaustive(x, g, h, leaves=31):
    """Splits (gain, feature, threshold, missing left, sides) of one tree, by trying all of every leaf, in order of gain."""

    def score(rows):
        return g[rows].sum() ** 2 / h[rows].sum()

    def best(rows):
        found = None
        for f in range(x.shape[1]):
            v = x[rows, f]
            there = np.unique(x[~np.isnan(x[:, f]), f])
            limits = [*((there[:-1] + there[1:]) / 2), math.inf]
            nan = np.isnan(v)
            for t in limits:
                for missing in (False, True) if nan.any() else (False,):
                    left = np.where(nan, missing, v <= t)
                    a, b = rows[left], rows[~left]
                    if len(a) < 20 or len(b) < 20 or h[a].sum() < 1e-3 or h[b].sum() < 1e-3:
                        continue
                    gain = score(a) + score(b) - score(rows)
                    if gain > 1e-12 and (found is None or gain > found[0] * (1 + 1e-9)):
                        found = (gain, f, t, missing if nan.any() else len(a) > len(b), a, b)
        return found

    out, heap = [], []

    def push(rows):
        if len(rows) >= 40 and (s := best(rows)):
            heapq.heappush(heap, (-s[0], len(out), id(rows), s))

    push(np.arange(len(x)))
    while heap and len(out) < leaves - 1:
        s = heapq.heappop(heap)[3]
        out.append(s)
        push(s[4])
        push(s[5])
    return out


@pytest.mark.parametrize("regression", [True, False])
def test_first_tree_is_that_of_an_exhaustive_search(spark, regression):
    r = np.random.default_rng(4)
    x = np.stack([r.integers(0, 40, 500).astype(float), r.normal(size=500).round(1), r.integers(-1, 3, 500).astype(float)], 1)
    x[r.random((500, 3)) < 0.15] = np.nan
    signal = np.nan_to_num(x[:, 0], nan=25) + 8 * np.isnan(x[:, 2]) + 3 * np.nan_to_num(x[:, 1])
    y = signal + r.normal(size=500) if regression else (signal + 6 * r.normal(size=500) > 22).astype(float)
    model, n = boosting.fit(frame(spark, x, y), 3, regression, trees=1)
    raw = np.full(500, y.mean() if regression else math.log(y.mean() / (1 - y.mean())))
    g, h, _ = boosting.slopes(y, raw, regression)
    want = exhaustive(x, g, h)
    tree = model.trees[0]
    splits = [k for k, f in enumerate(tree.feature) if f >= 0]
    got = sorted((tree.feature[k], round(tree.threshold[k], 6), tree.missing_left[k], round(tree.gain[k], 4)) for k in splits)
    assert n == 500 and got == sorted((f, round(t, 6), bool(m), round(gain, 4)) for gain, f, t, m, _, _ in want) and len(got) > 5
    # Leaves' values, by where the rows end.
    at = tree.of_numbers(x)
    for leaf in np.unique(at):
        rows = at == leaf
        assert tree.feature[leaf] < 0 and rows.sum() >= 20 and tree.value[leaf] == pytest.approx(-0.1 * g[rows].sum() / h[rows].sum(), abs=1e-6)


def test_best_first_stops_at_the_leaves(spark):
    r = np.random.default_rng(1)
    x = r.integers(-40, 40, (3000, 2)) / 20
    y = np.sin(3 * x[:, 0]) * x[:, 1]
    tree = boosting.fit(frame(spark, x, y), 2, True, trees=1)[0].trees[0]
    gains = [tree.gain[k] for k, f in enumerate(tree.feature) if f >= 0]
    assert len(gains) == 30 and sum(f < 0 for f in tree.feature) == 31
    g, h, _ = boosting.slopes(y, np.full(3000, y.mean()), True)
    assert sorted(gains) == pytest.approx(sorted(s[0] for s in exhaustive(x, g, h)), rel=1e-4)


def test_a_model_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(800, 3))
    x[r.random((800, 3)) < 0.2] = np.nan
    y = (np.nan_to_num(x[:, 0]) > 0.2).astype(float)
    models = [boosting.fit(frame(spark, x, y, p), 3, False, trees=9)[0] for p in (1, 6)]
    assert models[0].to_json() == models[1].to_json() and len(models[0].trees) == 9
    again = boosting.Boosted.from_json(models[0].to_json())
    assert (again.raw(x) == models[0].raw(x)).all()
    p = 1 / (1 + np.exp(-again.raw(x)))
    assert ((p > 0.5) == y).mean() > 0.97


def test_many_tasks_are_added_by_spark(spark, monkeypatch):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(400, 2)), r.normal(size=400)
    one = boosting.fit(frame(spark, x, y), 2, True, trees=2)[0].to_json()
    monkeypatch.setattr(boosting, "FEW_TASKS", 0)
    assert boosting.fit(frame(spark, x, y), 2, True, trees=2)[0].to_json() == one


def test_growth_ends_when_the_held_out_loss_does(spark):
    """A table of over 10,000 rows whose gain ends early; a smaller one has all trees."""
    rows = spark.range(12_000).select((F.rand(3) < F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.1)).cast("double").alias("label"), F.array((F.col("id") % 2).cast("double"), F.rand(4)).alias("x"))
    model, n = boosting.fit(rows, 2, False)
    k = len(model.trees)
    assert n == 12_000 and 10 < k < 100 and len(model.losses) == k + 1
    last = model.losses[-11:]
    assert min(last[1:]) >= last[0] - 1e-7 and model.losses[k // 2] < model.losses[0] - 0.1
    small, _ = boosting.fit(rows.limit(900), 2, False, trees=12)
    assert len(small.trees) == 12 and not small.losses


def test_bins(spark):
    few = frame(spark, np.array([[1.0, 5.0], [3.0, 5.0], [np.nan, 5.0], [4.0, np.nan]]), np.zeros(4))
    assert [e.tolist() for e in boosting.bin_edges(few, 2)] == [[2.0, 3.5], []]
    many = spark.range(5000).select(F.lit(0.0).alias("label"), F.array(F.col("id").cast("double"), (F.col("id") % 300).cast("double")).alias("x"))
    a, b = boosting.bin_edges(many, 2)
    assert len(a) == 254 and np.abs(a - np.arange(1, 255) * 5000 / 255).max() < 5 and len(b) <= 254


def test_nothing_to_learn(spark):
    assert boosting.fit(frame(spark, np.zeros((0, 1)), []), 1, False)[1] == 0
    one, n = boosting.fit(frame(spark, np.arange(60.0)[:, None], np.ones(60)), 1, False)
    assert n == 60 and not one.trees and (one.raw(np.zeros((2, 1))) > 10).all()
    same, _ = boosting.fit(frame(spark, np.full((90, 1), np.nan), np.arange(90)), 1, True, trees=3)
    assert not same.trees and same.raw(np.zeros((1, 1)))[0] == 44.5


def test_missing_values_have_their_own_way(spark):
    """A null and a real -1 are told apart without a flag, and go to either side as the gain has it."""
    spec = ModelSpec("m", "t", "y", ("c",), ("v",))
    df = spark.createDataFrame([(-1.0 if k % 2 else None if k % 4 else float("nan"), k % 2, "a") for k in range(200)], "v double, y int, c string")
    model, _ = ml.fit(df, spec, 5)
    assert ml.inputs(spec) == ["f_c", "f_v"] and all(r.pred_y == r.y for r in ml.predict(model, df, spec).collect())
    middle = spark.createDataFrame([(None if k % 3 == 0 else float(k % 3), int(k % 3 != 1), "a") for k in range(300)], "v double, y int, c string")
    model, _ = ml.fit(middle, spec, 5)
    tree = model.trees.trees[0]
    assert tree.feature[0] == 1 and not tree.missing_left[0] and all(r.pred_y == r.y for r in ml.predict(model, middle, spec).collect())


def auc(label, raw):
    pos, neg = [r for y, r in zip(label, raw, strict=True) if y], [r for y, r in zip(label, raw, strict=True) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_metrics_of_several_features(spark):
    r = np.random.default_rng(6)
    rows = [(int(f), float(r.integers(0, 2)), float(r.integers(0, 30)) + f) for f in range(3) for _ in range(150)] + [(7, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "feature long, label double, raw double").repartition(5)
    got = ml.grouped_metric(df, False)
    assert math.isnan(got.pop(7)) and set(got) == {0, 1, 2}
    assert all(v == pytest.approx(auc(*zip(*[(y, s) for g, y, s in rows if g == f], strict=True))) for f, v in got.items())
    r2 = ml.grouped_metric(df.where("feature = 1"), True)[1]
    y, p = (np.array(v) for v in zip(*[(y, s) for g, y, s in rows if g == 1], strict=True))
    assert r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert ml.grouped_metric(df.limit(0), False) == {}


def test_permutation_is_that_of_one_feature_at_a_time(spark):
    """The drops equal those of scoring each feature by itself."""
    spec = ModelSpec("m", "t", "y", ("c",), ("v",))
    r = np.random.default_rng(8)
    data = [(k, float(r.normal()) if k % 5 else None, "ab"[k % 2], 0) for k in range(240)]
    data = [(k, v, c, int((v or 1.5) + (c == "a") > 0.6)) for k, v, c, _ in data]
    df = spark.createDataFrame(data, "k int, v double, c string, y int")
    model, _ = ml.fit(df, spec, 4)
    got = {r.feature: r.importance_mean for r in ml.permutation_importance(model, df, spec, 1, first=F.col("k"), dealt=lambda _: (F.col("k") * 77) % 240).collect()}
    x = np.array([[0.0 if c == "a" else 1.0, np.nan if v is None else v] for _, v, c, _ in data])
    order = sorted(range(240), key=lambda k: k * 77 % 240)
    y = [r[3] for r in data]
    for f, name in enumerate(spec.features):
        mixed = x.copy()
        mixed[:, f] = x[order, f]
        assert got[name] == pytest.approx(auc(y, model.trees.raw(x)) - auc(y, model.trees.raw(mixed)))


def test_repeats_pair_blocks_and_rank_ranges(spark, monkeypatch):
    """A repeat sorts and numbers nothing; over many blocks and ranges each row has one partner, each number is dealt once, and the AUC is that of all pairs."""
    for name, v in (("PAIRS", 16), ("RANGE", 32), ("LIMITS", 150)):
        monkeypatch.setattr(ml, name, v)
    for n in (1, 2, 5, 64, 1001):
        assert sorted(ml.mixed(np.arange(n), n, 3).tolist()) == list(range(n))
    calls, made, ranked = [], ml.numbered, ml._dealt_metric
    monkeypatch.setattr(ml, "numbered", lambda df: calls.append("numbered") or made(df))

    def watched(blocks, scores, limits, regression):
        plain = blocks.applyInArrow(ml._plain_scores(scores), "feature long, label double, raw double").collect()
        got = ranked(blocks, scores, limits, regression)
        kinds = {r.feature for r in plain}
        assert len(limits) == 3 and all(len(limit) > 1 for limit in limits[:2]) and set(got) == kinds
        for f in kinds:
            here = [(r.label, r.raw) for r in plain if r.feature == f]
            assert len(here) == 240 and got[f] == pytest.approx(auc(*zip(*here, strict=True)))
        calls.append("repeat")
        return got

    monkeypatch.setattr(ml, "_dealt_metric", watched)
    spec = ModelSpec("m", "t", "y", ("c",), ("v",))
    r = np.random.default_rng(12)
    data = [(float(r.normal()) if k % 5 else None, "ab"[k % 2]) for k in range(240)]
    df = spark.createDataFrame([(v, c, int((v or 1.5) + (c == "a") > 0.6)) for v, c in data], "v double, c string, y int")
    model, _ = ml.fit(df, spec, 6)
    found = {r.feature: r for r in ml.permutation_importance(model, df, spec, 3).collect()}
    assert calls == ["numbered", "repeat", "repeat", "repeat"] and found["v"].importance_mean > 0.2 and found["v"].importance_std > 0


def test_a_pass_sums_the_smaller_sides(spark, monkeypatch):
    """After the root, a pass looks at no more than half the rows of the leaves it splits, and the rest follows by subtraction."""
    seen, summed = [], boosting._summed

    def watched(tree, leaves, *rest):
        seen.append((tree.feature[:], [{tree.left[p]: tree.right[p], tree.right[p]: tree.left[p]}.get(k) for k in leaves for p in range(len(tree.feature)) if k and k in (tree.left[p], tree.right[p])]))
        return summed(tree, leaves, *rest)

    monkeypatch.setattr(boosting, "_summed", watched)
    r = np.random.default_rng(7)
    x, y = r.normal(size=(2000, 2)), r.normal(size=2000)
    x[r.random((2000, 2)) < 0.1] = np.nan
    model, _ = boosting.fit(frame(spark, x, y), 2, True, trees=3)
    asked = sum(len(others) for _, others in seen)
    assert sum(len(f) == 1 for f, _ in seen) == 3 and 0 < asked <= 3 * 40  # 30 splits a tree, and some that were opened on the way
    raw = np.full(2000, model.base)
    for t in model.trees:
        g = raw - y
        at = t.of_numbers(x)
        for leaf in np.unique(at):
            assert t.value[leaf] == pytest.approx(-0.1 * g[at == leaf].mean(), abs=1e-6)
        raw += np.array(t.value)[at]
    assert raw == pytest.approx(model.raw(x))


def test_blocks_are_full_and_keep_every_row(spark, monkeypatch):
    """Scores kept in blocks are those of the whole model, made anew from the table or not."""
    r = np.random.default_rng(9)
    x, y = r.normal(size=(900, 2)), r.normal(size=900)
    one = boosting.fit(frame(spark, x, y), 2, True, trees=5)[0].to_json()
    monkeypatch.setattr(boosting, "REFRESH", 2)
    assert boosting.fit(frame(spark, x, y), 2, True, trees=5)[0].to_json() == one
    batch = lambda n: pa.RecordBatch.from_arrays([pa.array(np.zeros(n)), pa.array([b"\x01\x02"] * n, pa.binary()), pa.array([k % 3 == 0 for k in range(n)])], names=["label", "bins", "held"])
    monkeypatch.setattr(boosting, "ROWS", 100)
    made = [pickle.loads(b.column("block")[0].as_py()) for b in boosting._blocks(2, 0.5, [])(iter([batch(30), batch(60), batch(250)]))]
    assert sum(side[0].shape[1] for sides in made for side in sides) == 340 and max(s[0][0].shape[1] + s[1][0].shape[1] for s in made) <= 100
    assert all((side[0] == [[1], [2]]).all() and (side[2] == 0.5).all() for sides in made for side in sides)


def test_equal_rows_are_learned_from_once(spark, monkeypatch):
    """Copies change a model as their number says, and nothing else: blocks hold each row once, whatever its copies, and sums are exact."""
    made = boosting._blocks

    def watched(*of):
        def run(batches):
            for b in made(*of)(batches):
                seen.add(sum(len(side[1]) for side in pickle.loads(b.column("block")[0].as_py())))
                yield b

        return run

    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(boosting, "_blocks", watched)
    r = np.random.default_rng(10)
    x, y = r.integers(0, 3, (70, 2)).astype(float), r.integers(0, 2, 70).astype(float)
    x[:9, 0] = np.nan
    model, n = boosting.fit(frame(spark, np.repeat(x, 100, 0), np.repeat(y, 100)), 2, False, trees=2)
    kinds = len({(str(a), b, c) for (a, b), c in zip(x.tolist(), y, strict=True)})
    assert n == 7000 and kinds <= seen.value <= 2 * kinds < 60  # held out or not
    raw = np.full(70, model.base)
    for t in model.trees:
        at = t.of_numbers(x)
        g, h, _ = boosting.slopes(y, raw, False)
        for leaf in np.unique(at):
            assert t.value[leaf] == pytest.approx(-0.1 * g[at == leaf].sum() / h[at == leaf].sum(), abs=1e-9)
        raw += np.array(t.value)[at]
    assert raw == pytest.approx(model.raw(x))


def test_sums_beyond_a_double():
    to, values = np.array([0, 1, 0, 1]), np.array([(1 << 58) + 1, -(1 << 57) - 3, 1 << 40, 5])
    assert boosting.whole_sums(to, values, 2, False).tolist() == [(1 << 58) + (1 << 40) + 1, -(1 << 57) + 2]
    assert boosting.whole_sums(to, values >> 20, 2, True).tolist() == np.bincount(to, values >> 20).astype(int).tolist()
    for a in ([0, 255], [0, 256], [1.0, 1 << 17], [0.5, 1], [-1, 3], [2.0**40, 1]):
        assert (boosting.narrow(np.array(a)) == a).all()


def test_scores_by_looks_are_those_of_a_walk():
    """Trees of few leaves and of many, missing values, places beside thresholds, and each feature dealt from other rows."""
    r = np.random.default_rng(11)

    def grown(leaves):
        t = boosting.Tree()
        t.add(0.0)
        while sum(f < 0 for f in t.feature) < leaves:
            node = int(r.choice([k for k, f in enumerate(t.feature) if f < 0]))
            t.feature[node], t.threshold[node], t.missing_left[node] = int(r.integers(0, 3)), float(r.choice([*range(9), math.inf])), bool(r.integers(0, 2))
            t.left[node], t.right[node] = t.add(float(r.normal())), t.add(float(r.normal()))
        return t

    def walk(row):
        score = model.base
        for t in model.trees:
            node = 0
            while t.feature[node] >= 0:
                v = row[t.feature[node]]
                node = t.left[node] if (t.missing_left[node] if math.isnan(v) else v <= t.threshold[node]) else t.right[node]
            score += t.value[node]
        return score

    model = boosting.Boosted(True, 0.25, [grown(k) for k in (1, 2, 31, 32, 33, 90)])
    x = r.integers(-1, 10, (200, 3)).astype(float)
    x[r.random(x.shape) < 0.2] = np.nan
    d = x[r.permutation(200)]
    assert model.raw(x).tolist() == [walk(row) for row in x]
    for f, got in enumerate(boosting.Scorer(model, 3).dealt(x, d)):
        mixed = x.copy()
        mixed[:, f] = d[:, f]
        assert got.tolist() == [walk(row) for row in mixed]
