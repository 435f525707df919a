"""Boosted trees over binned columns, grown best-first, with a learned direction for missing values.

A feature's values are dealt to up to 255 bins, and missing ones to a bin of their own.  A pass over the table sums
gradients, second derivatives and rows by (leaf, feature, bin) for all leaves that may be split next; Spark
adds the tasks' sums, and the driver, which holds no more than these, takes the best split of each leaf:
at which bin, and to which side missing values go.  Leaves are split in the order of their gain until
there are ``LEAVES``.  Passes are shared: whichever leaves the order may need are summed
together, so a tree takes about as many passes as it is deep.  Of a split's sides a pass sums the one of fewer
rows, and the other's sums are what is left of the whole's; rows elsewhere are not looked at.

Sums are of integers (gradients times a power of two that depends on the rows alone), so a model does not depend on
how the table is partitioned or in what order tasks end.

Rows that agree in bins, label and whether they are held out can't be told apart by any tree, so the table that is learned from,
in the shared folder, has each such row once with its number: its size is bounded by the bins and labels that
occur, whatever the rows.  Passes read blocks of it, columns of up to ``ROWS`` rows with
the scores by the trees so far, that executors keep: a tree's blocks are made of the last one's by the pass that sums its root, and every
``REFRESH`` trees from the table again, so what is lost with an executor is made again in few steps.
"""

from __future__ import annotations

import heapq
import json
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitloom.operators.scratch import forget, stored

LEAVES, STEP, LEAF, LEAST_CURVE, BINS = 31, 0.1, 20, 1e-3, 255
MISSING = BINS
#: After so many trees the blocks are made from the table and not from the last tree's.
REFRESH = 25
#: Early stopping: tables of more rows hold this share out, and growth ends when no loss of so many rounds is better than the one before them.
STOP_ROWS, HELD, PATIENCE, LEAST_GAIN = 10_000, 10, 10, 1e-7
#: Tasks beyond which Spark adds the sums up, and not the driver; rows of a block.
FEW_TASKS, ROWS = 16, 1 << 16


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has no feature (-1), and missing values of a split go left where ``missing_left`` is set."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, x in (("feature", -1), ("bin", 0), ("threshold", 0.0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def reach(self, leaves: list[int], limits: list[int], sizes: list[int]) -> dict[int, np.ndarray]:
        """Of each feature that is asked, the leaves (up to 32, as bits) that a row may end in, by the place of its value.

        A place up to ``limits[node]`` goes left at the node; of a feature's ``sizes`` places the last is that of missing values.  A row ends
        in the leaf that all its places allow, if that is one of ``leaves``.
        """
        bits, below = {node: 1 << k for k, node in enumerate(leaves)}, [0] * len(self.feature)
        out: dict[int, np.ndarray] = {}
        for node in reversed(range(len(below))):  # sides come after their split
            f = self.feature[node]
            if f < 0:
                below[node] = bits.get(node, 0)
                continue
            left, right = below[self.left[node]], below[self.right[node]]
            below[node] = left | right
            if below[node]:
                to = out.setdefault(f, np.full(sizes[f], _ALL, np.uint32))
                here = np.arange(sizes[f]) <= limits[node]
                here[-1] = self.missing_left[node]
                to[here] &= np.uint32(_ALL ^ right)
                to[~here] &= np.uint32(_ALL ^ left)
        if not out:
            return {}
        some = next(iter(out.values()))
        some &= np.uint32(below[0])
        return out

    def ends(self, places: np.ndarray, leaves: list[int], limits: list[int] | None = None, sizes: list[int] | None = None) -> np.ndarray:
        """Of each row the place of its leaf among ``leaves``, or their number; by the places of its values (features x rows), which are bins by default."""
        limits, sizes = limits or self.bin, sizes or [BINS + 1] * len(places)
        if self.feature[0] < 0:
            return np.full(places.shape[1], leaves.index(0) if 0 in leaves else len(leaves))
        out = np.full(places.shape[1], len(leaves))
        for start in range(0, len(leaves), 32):
            some = leaves[start : start + 32]
            met = reduce(np.bitwise_and, [_look(to, places[f]) for f, to in self.reach(some, limits, sizes).items()])
            slot = np.full(37, len(leaves))
            slot[[(1 << k) % 37 for k in range(len(some))]] = np.arange(start, start + len(some))
            out = np.minimum(out, _look(slot, met % 37))
        return out

    def leaves(self) -> list[int]:
        """All leaves that can be reached."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if self.feature[node] < 0:
                out.append(node)
            else:
                todo += [self.right[node], self.left[node]]
        return out

    def of_numbers(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row (rows x features)."""
        leaves, grid = self.leaves(), Grid([self], x.shape[1])
        return np.array(leaves)[self.ends(grid.places(x), leaves, grid.limits[0], grid.sizes)]


#: All leaves of up to 32; the powers of two below 2^36 have different remainders by 37, and none has that of 0.
_ALL = (1 << 32) - 1
#: Rows that are scored at a time; where ``_bit`` has a one as its number's lowest bit.
PART, _FIRST = 1 << 14, 127


def _look(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``table[places]`` of places that are within it (without a check, which takes longer than the look)."""
    return table.take(places, mode="clip")


def _bit(bits: np.ndarray) -> np.ndarray:
    """``_FIRST`` and the place of the only bit that is set: the exponent of the same number as a float."""
    return bits.astype(np.float32).view(np.uint32) >> 23


class Grid:
    """Numbers as places among the thresholds of trees, so that a tree is a few looks into tables for each feature."""

    def __init__(self, trees: list[Tree], features: int):
        asked: list[set[float]] = [set() for _ in range(features)]
        for t in trees:
            for f, limit in zip(t.feature, t.threshold, strict=True):
                if f >= 0:
                    asked[f].add(limit)
        self.thresholds = [np.array(sorted(a), np.float64) for a in asked]
        self.sizes = [len(a) + 2 for a in asked]
        self.limits = [[int(np.searchsorted(self.thresholds[f], limit)) if f >= 0 else -1 for f, limit in zip(t.feature, t.threshold, strict=True)] for t in trees]

    def places(self, x: np.ndarray) -> np.ndarray:
        """Features x rows, of rows x features."""
        return np.stack([np.where(np.isnan(v), len(limits) + 1, np.searchsorted(limits, v)) for v, limits in zip(x.T, self.thresholds, strict=True)])


class Scorer:
    """The sums of a model's trees, for many rows."""

    def __init__(self, model: Boosted, features: int):
        self.base, self.grid, self.trees = model.base, Grid(model.trees, features), []
        for t, limits in zip(model.trees, self.grid.limits, strict=True):
            leaves = t.leaves()
            if len(leaves) > 32 or len(leaves) < 2:
                self.trees.append((t, leaves, limits))
                continue
            values = np.zeros(_FIRST + 32)
            values[_FIRST : _FIRST + len(leaves)] = [t.value[node] for node in leaves]
            self.trees.append((t.reach(leaves, limits, self.grid.sizes), values, None))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The score of each row (rows x features)."""
        return self.sums(self.grid.places(x))

    def sums(self, places: np.ndarray) -> np.ndarray:
        """The same of places (features x rows)."""
        out = np.full(places.shape[1], self.base)
        for reach, values, limits in self.trees:
            if limits is None:
                out += _look(values, _bit(reduce(np.bitwise_and, [_look(to, places[f]) for f, to in reach.items()])))
            else:
                out += np.array([reach.value[node] for node in values])[reach.ends(places, values, limits, self.grid.sizes)]
        return out

    def dealt(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Features x rows: the scores of ``x`` with one feature's values from ``d``."""
        return self.dealt_places(self.grid.places(x), self.grid.places(d))

    def dealt_places(self, of: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The same of places (features x rows), ``PART`` rows at a time, which stay in a core's cache."""
        if of.shape[1] > PART:
            return np.concatenate([self.dealt_places(of[:, k : k + PART], other[:, k : k + PART]) for k in range(0, of.shape[1], PART)], 1)
        out = np.full(of.shape, self.base)
        for reach, values, limits in self.trees:
            if limits is not None:
                for f in range(len(of)):
                    out[f] += np.array([reach.value[node] for node in values])[reach.ends(np.stack([other[k] if k == f else of[k] for k in range(len(of))]), values, limits, self.grid.sizes)]
                continue
            met, asked = {f: _look(to, of[f]) for f, to in reach.items()}, list(reach)
            # What the features before, and those after, leave of the leaves.
            before = list(accumulate([met[f] for f in asked], np.bitwise_and))
            after = list(accumulate([met[f] for f in reversed(asked)], np.bitwise_and))[::-1]
            same = _look(values, _bit(before[-1]))
            for f in range(len(of)):
                if f not in reach:
                    out[f] += same
                    continue
                k, here = asked.index(f), _look(reach[f], other[f])
                if k:
                    here = here & before[k - 1]
                if k + 1 < len(asked):
                    here = here & after[k + 1]
                out[f] += _look(values, _bit(here))
        return out


@dataclass
class Boosted:
    """Trees whose values add to ``base``: log odds of class 1, or a number."""

    regression: bool
    base: float
    trees: list[Tree] = field(default_factory=list)
    #: Mean loss of the rows held out, before the first tree and after each.
    losses: list[float] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return Scorer(self, x.shape[1]).raw(x)

    def gains(self, features: int) -> np.ndarray:
        """Summed split gains of each feature."""
        out = np.zeros(features)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    out[f] += max(0.0, g)
        return out

    def to_json(self) -> str:
        return json.dumps({"regression": self.regression, "base": self.base, "losses": self.losses, "trees": [vars(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Boosted:
        x = json.loads(text)
        return Boosted(x["regression"], x["base"], [Tree(**t) for t in x["trees"]], x["losses"])

    def column(self, x: Column) -> Column:
        """The raw score of an array of numbers, missing ones null or not a number."""
        model = self

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scorer = None
            for rows in batches:
                x = matrix(rows)
                scorer = scorer or Scorer(model, x.shape[1])
                yield pa.array(scorer.raw(x))

        return score(x)


def matrix(rows: pa.Array) -> np.ndarray:
    """Rows of an array column, all of one length, with nulls as not a number."""
    if not len(rows):
        return np.zeros((0, 0))
    return np.asarray(rows.flatten().fill_null(np.nan) if rows.flatten().null_count else rows.flatten(), dtype=np.float64).reshape(len(rows), -1)


def bin_edges(df: DataFrame, features: int) -> list[np.ndarray]:
    """Of each feature of ``x`` the upper limits of all bins but the last: halfway between values if there are few, else quantiles."""
    at = [F.nanvl(F.col("x")[k], F.lit(None).cast("double")) for k in range(features)]
    distinct = df.agg(*[F.approx_count_distinct(a).alias(f"n{k}") for k, a in enumerate(at)]).first()
    few = [distinct[f"n{k}"] <= 2 * BINS for k in range(features)]  # within the estimate's error, so a set is small
    shares = [k / BINS for k in range(1, BINS)]
    row = df.agg(*[(F.collect_set(a) if few[k] else F.percentile_approx(a, shares, 20_000)).alias(f"v{k}") for k, a in enumerate(at)]).first()
    out = []
    for k in range(features):
        values = np.unique(np.array(row[f"v{k}"] or [], dtype=np.float64))
        if few[k] and len(values) > BINS:
            values = np.unique(values[(np.arange(1, BINS) * len(values)) // BINS - 1])
            out.append(values)
        else:
            out.append((values[:-1] + values[1:]) / 2 if few[k] else values)
    return out


def _binned(edges: list[np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            x = matrix(batch.column("x"))
            bins = np.empty(x.shape, np.uint8)
            for k, e in enumerate(edges):
                bins[:, k] = np.where(np.isnan(x[:, k]), MISSING, np.searchsorted(e, x[:, k]))
            rows = np.arange(row, row + len(x))
            row += len(x)
            offsets = np.arange(0, bins.size + 1, max(1, len(edges)), dtype=np.int32) if len(edges) else np.zeros(len(x) + 1, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("label"), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(bins)])], names=["row", "label", "bins"])

    return run


def _bins_of(batch: pa.RecordBatch, features: int) -> np.ndarray:
    column = batch.column("bins")
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[column.offset * features : (column.offset + len(column)) * features].reshape(len(column), features)


#: Bins (features x rows), labels and scores of rows, and how many there are of each.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _blocks(features: int, base: float, trees: list[Tree]) -> Callable:
    """Pickled blocks, the rows to learn from and those held out, of label, bins, held and n (1 where there is none)."""

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        bins = np.concatenate([_bins_of(b, features) for b in batches])
        label = np.concatenate([np.asarray(b.column("label"), dtype=np.float64) for b in batches])
        held = np.concatenate([np.asarray(b.column("held"), dtype=bool) for b in batches])
        times = np.concatenate([np.asarray(b.column("n"), dtype=np.int64) if "n" in b.schema.names else np.ones(len(b), np.int64) for b in batches])
        sides = [scored((np.ascontiguousarray(bins[on].T), narrow(label[on]), np.full(int(on.sum()), base), narrow(times[on])), trees) for on in (~held, held)]
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sides, protocol=5)], pa.binary())], names=["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                if rows + batch.num_rows > ROWS:
                    yield block(waiting)
                    waiting, rows = [], 0
                waiting.append(batch)
                rows += batch.num_rows
        if waiting:
            yield block(waiting)

    return run


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in fewer bytes if they are small whole ones: what a pass takes is mostly reading its blocks."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if len(values) and values.min() >= 0 and values.max() <= np.iinfo(kind).max and (values == values.astype(kind)).all():
            return values.astype(kind)
    return values


def scored(rows: Rows, trees: list[Tree]) -> Rows:
    """The rows with the trees' values added to their scores."""
    bins, label, raw, times = rows
    raw = raw.copy()
    for t in trees:
        leaves = t.leaves()
        raw += np.array([t.value[node] for node in leaves])[t.ends(bins, leaves)]
    return bins, label, raw, times


def slopes(label: np.ndarray, raw: np.ndarray, regression: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, and the loss: squared error by half, or log loss."""
    if regression:
        return raw - label, np.ones(len(raw)), (raw - label) ** 2 / 2
    p = 1 / (1 + np.exp(-raw))
    return p - label, p * (1 - p), np.logaddexp(0, raw) - label * raw


def _summed(tree: Tree, leaves: list[int], features: int, regression: bool, scale: float, loss_scale: float | None) -> Callable:
    """A task's sums (n, g, h) by (leaf, feature, bin), as the places that are not 0 and what stands there; and, with ``loss_scale``, number and loss of the rows held out."""
    size = len(leaves) * (BINS + 1)

    def run(blocks: Iterator[list[Rows]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sums, held = np.zeros((3, features, size), np.int64), np.zeros(2, np.int64)
        for (bins, label, raw, times), (_, out_label, out_raw, out_times) in blocks:
            if loss_scale is not None:
                loss = slopes(out_label, out_raw, regression)[2]
                held += [int(out_times.sum()), int((np.rint(loss * loss_scale).astype(np.int64) * out_times).sum())]
            end = tree.ends(bins, leaves)
            at = np.nonzero(end < len(leaves))[0]
            slot, n = end[at] * (BINS + 1), times[at]
            g, h, _ = slopes(label[at], raw[at], regression)
            g, h = np.rint(g * scale).astype(np.int64) * n, None if regression else np.rint(h * scale).astype(np.int64) * n
            few = int(n.sum()) <= 2 * ROWS
            for f in range(features):
                to = slot + _look(bins[f], at)
                count = np.bincount(to, n, size).astype(np.int64)
                sums[0, f] += count
                sums[1, f] += whole_sums(to, g, size, few)
                sums[2, f] += count * int(np.rint(scale)) if regression else whole_sums(to, h, size, few)
        sums = sums.reshape(3, features, len(leaves), BINS + 1).swapaxes(1, 2).reshape(3, -1)
        on = np.nonzero(sums[0])[0]
        yield on, sums[:, on], held

    return run


def whole_sums(to: np.ndarray, values: np.ndarray, size: int, few: bool) -> np.ndarray:
    """Sums of whole numbers by place; unless a double holds them (``few``), of their upper and lower bits apart."""
    if few:
        return np.bincount(to, values, size).astype(np.int64)
    return (np.bincount(to, values >> 26, size).astype(np.int64) << 26) + np.bincount(to, values & ((1 << 26) - 1), size).astype(np.int64)


def _added(a: tuple, b: tuple) -> tuple:
    """Two tasks' sums as one."""
    on = np.union1d(a[0], b[0])
    sums = np.zeros((3, len(on)), np.int64)
    for places, values, _ in (a, b):
        sums[:, np.searchsorted(on, places)] += values
    return on, sums, a[2] + b[2]


def best_split(sums: np.ndarray, bins: list[int]) -> tuple[float, int, int, bool, np.ndarray, np.ndarray] | None:
    """Of a leaf's sums (features x bins x (n, g, h)): gain, feature, bin, whether missing values go left, and both sides' sums.

    Of equal gains the first feature, then the lower bin, then missing values on the right.
    """
    best = None
    for f, count in enumerate(bins):
        here, missing = sums[f, :count], sums[f, MISSING]
        whole = here.sum(0) + missing
        for to_left in (False, True) if missing[0] else (False,):
            left = np.cumsum(here, 0) + (missing if to_left else 0)
            right = whole - left
            on = (left[:, 0] >= LEAF) & (right[:, 0] >= LEAF) & (left[:, 2] >= LEAST_CURVE) & (right[:, 2] >= LEAST_CURVE)
            if not on.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(on, left[:, 1] ** 2 / left[:, 2] + right[:, 1] ** 2 / right[:, 2] - whole[1] ** 2 / whole[2], -np.inf)
            b = int(gain.argmax())
            if gain[b] > 1e-12 and (best is None or (-gain[b], f, b) < (-best[0], best[1], best[2])):
                # Without missing values here, later ones go to the larger side.
                side = to_left if missing[0] else bool(left[b, 0] > right[b, 0])
                best = (float(gain[b]), f, b, side, left[b], right[b])
    return best


def numbers(sums: np.ndarray, scale: float) -> np.ndarray:
    """Features x bins x (n, g, h) as they are, of whole numbers."""
    out = sums.astype(np.float64)
    out[..., 1:] /= scale
    return out


def _grow(whole: np.ndarray, scale: float, sums_of: Callable, edges: list[np.ndarray]) -> Tree:
    """The tree of the best splits in order of gain; ``sums_of(tree, leaves)`` gives leaves' sums, of whole numbers, by one pass."""
    tree, stats, splits, known = Tree(), {}, {}, {}
    bins = [len(e) + 1 for e in edges]

    def leaf(stat: np.ndarray) -> int:
        node = tree.add(-STEP * stat[1] / stat[2] if stat[2] else 0.0)
        stats[node] = stat
        return node

    def open_node(node: int) -> None:
        """Make the split a part of the tree, so that passes tell its sides apart."""
        gain, f, b, missing, left, right = splits[node]
        if tree.left[node] < 0:
            tree.left[node], tree.right[node] = leaf(left), leaf(right)
        tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = f, b, missing, gain
        # Beyond the last bin there are missing values only.
        tree.threshold[node] = float(edges[f][b]) if b < len(edges[f]) else math.inf

    def learn(node: int, sums: np.ndarray) -> None:
        known[node] = sums
        if found := best_split(numbers(sums, scale), bins):
            splits[node] = found

    root = leaf(numbers(whole, scale)[0].sum(0))
    learn(root, whole)
    while True:
        # Take the best splits in order, as far as leaves are known; those that are not may be needed.
        heap, chosen, wanted = [(-splits[root][0], root)] if root in splits else [], [], []
        while heap and len(chosen) < LEAVES - 1:
            _, node = heapq.heappop(heap)
            chosen.append(node)
            open_node(node)
            for side in (tree.left[node], tree.right[node]):
                if side in known:
                    if side in splits:
                        heapq.heappush(heap, (-splits[side][0], side))
                elif stats[side][0] >= 2 * LEAF and node not in wanted:
                    wanted.append(node)
        if not wanted:
            # What was opened on the way and is not among the best is closed again.
            for node in set(splits) - set(chosen):
                tree.feature[node], tree.gain[node] = -1, 0.0
            return tree
        fewer = {node: min((tree.left[node], tree.right[node]), key=lambda side: stats[side][0]) for node in wanted}
        found = sums_of(tree, list(fewer.values()))
        for node, side in fewer.items():
            learn(side, found[side])
            learn(tree.left[node] + tree.right[node] - side, known[node] - found[side])


def _pruned(tree: Tree) -> Tree:
    """The tree without nodes that can't be reached."""
    out = Tree()

    def copy(node: int) -> int:
        new = out.add(tree.value[node])
        if tree.feature[node] >= 0:
            out.feature[new], out.bin[new], out.threshold[new], out.missing_left[new], out.gain[new] = (x[node] for x in (tree.feature, tree.bin, tree.threshold, tree.missing_left, tree.gain))
            out.left[new], out.right[new] = copy(tree.left[node]), copy(tree.right[node])
        return new

    copy(0)
    return out


def fit(df: DataFrame, features: int, regression: bool, trees: int = 100) -> tuple[Boosted, int]:
    """The model of label and x (an array of ``features`` numbers), and the number of rows.

    A table without rows gives 0 everywhere; one class alone, or equal labels, give that class or label.
    """
    edges = bin_edges(df, features)
    binned = df.select("label", "x").mapInArrow(_binned(edges), "row long, label double, bins binary")
    kinds = binned.groupBy("label", "bins", (F.pmod(F.xxhash64("row"), F.lit(HELD)) == 0).alias("held")).agg(F.count("*").alias("n"))
    table = stored(kinds, "bins")
    rows, different, low, high, tasks = table.withColumn("part", F.spark_partition_id()).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.min("label"), F.max("label"), F.max("part")).first()
    table_of = table if rows > STOP_ROWS else table.withColumn("held", F.lit(False))
    parts = min(tasks + 1, -(-different // ROWS)) if rows else 1  # a task has a block at least
    # Powers of two by which whole numbers come out whose sums over a step fit a double, and over the table a long.
    unit = lambda most: 2.0 ** min(36 - math.ceil(math.log2(most)), 61 - math.ceil(math.log2(rows * most)))
    scale = unit(max(1.0, high - low)) if rows else 1.0
    n, total = table_of.where("not held").agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.rint((F.col("label") - low) * scale).cast("long") * F.col("n"))).first() if rows else (0, 0)
    mean = (low * n + total / scale) / n if n else 0.0
    base = mean if regression else math.log(min(max(mean, 1e-9), 1 - 1e-9) / (1 - min(max(mean, 1e-9), 1 - 1e-9)))
    model = Boosted(regression, base)
    if not n or low == high:
        forget(table)
        return model, rows
    loss_scale = unit(max(64.0, (high - low) ** 2))
    kept = None

    def blocks(last: RDD | None) -> RDD:
        """Blocks with the scores by the trees so far, kept in the executors."""
        if last is not None:
            new = model.trees[-1:]
            return last.map(lambda sides: [scored(rows, new) for rows in sides]).persist(StorageLevel.MEMORY_AND_DISK)
        made = table_of.select("label", "bins", "held", "n").coalesce(parts).mapInArrow(_blocks(features, base, list(model.trees)), "block binary")
        return made.rdd.map(lambda r: pickle.loads(r.block)).persist(StorageLevel.MEMORY_AND_DISK)

    def sums_of(tree: Tree, leaves: list[int], loss_scale: float | None = None) -> dict[int, np.ndarray]:
        nonlocal loss
        out = kept.mapPartitions(_summed(tree, leaves, features, regression, scale, loss_scale))
        sums, held = np.zeros((3, len(leaves) * features * (BINS + 1)), np.int64), np.zeros(2, np.int64)
        for on, values, own in [out.treeReduce(_added)] if parts > FEW_TASKS else out.collect():
            sums[:, on] += values
            held += own
        if loss_scale is not None:
            loss = held[1] / loss_scale / held[0] if held[0] else None
        return dict(zip(leaves, np.moveaxis(sums.reshape(3, len(leaves), features, BINS + 1), 0, -1), strict=True))

    loss = None
    try:
        while len(model.trees) < trees and features:
            last, kept = kept, blocks(kept if len(model.trees) % REFRESH else None)
            root = sums_of(Tree([-1], [0], [0.0], [False], [-1], [-1], [0.0], [0.0]), [0], loss_scale)[0]
            if last is not None:
                last.unpersist()
            if loss is not None:
                model.losses.append(loss)
                if len(model.losses) > PATIENCE and min(model.losses[-PATIENCE:]) >= model.losses[-PATIENCE - 1] - LEAST_GAIN:
                    break
            tree = _grow(root, scale, sums_of, edges)
            if tree.feature[0] < 0:
                break
            model.trees.append(_pruned(tree))
    finally:
        if kept is not None:
            kept.unpersist()
        forget(table)
    return model, rows
