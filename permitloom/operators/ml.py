"""Encoding, boosted trees, cross-validation, scoring and importances over DataFrames."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permitloom.config import ModelSpec
from permitloom.operators import boosting
from permitloom.operators.boosting import Boosted
from permitloom.operators.scratch import forget, stored
from permitloom.operators.storage import read_text, write_text

MISSING = "__missing__"
TREES, SEED = 100, 42
#: Folds that are fitted at the same time.
SIDE_BY_SIDE = 3


def with_missing_columns(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Features that the table lacks, as nulls of their kind."""
    for names, kind in ((spec.cat_cols, "string"), (spec.num_cols, "double")):
        for c in names:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast(kind))
    return df


def fill_features(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Categories as text with a word for null, as f_ columns; numbers as double, in which NaN is null: trees have a way for it."""
    filled = {f"f_{c}": F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in spec.cat_cols}
    return df.withColumns(filled | {f"f_{c}": F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in spec.num_cols})


def inputs(spec: ModelSpec) -> list[str]:
    """The columns that ``fill_features`` adds."""
    return [f"f_{c}" for c in spec.features]


class Fitted:
    """The encoder of the categories, and boosted trees over their codes and the numbers."""

    def __init__(self, encoder: PipelineModel, trees: Boosted, cat_cols: list[str], num_cols: list[str]):
        self.encoder, self.trees, self.cat_cols, self.num_cols = encoder, trees, list(cat_cols), list(num_cols)

    def encoded(self, filled: DataFrame) -> DataFrame:
        """x: the codes and the numbers, in the order of the features."""
        return with_x(self.encoder.transform(filled), self.cat_cols, self.num_cols)

    def transform(self, filled: DataFrame) -> DataFrame:
        """raw, prediction, and of a classifier probability (of class 1)."""
        out = self.encoded(filled)
        out = out.withColumn("raw", self.trees.column(F.col("x")))
        if self.trees.regression:
            return out.withColumn("prediction", F.col("raw"))
        return out.withColumn("prediction", (F.col("raw") > 0).cast("double")).withColumn("probability", 1 / (1 + F.exp(-F.col("raw"))))

    def save(self, path: str) -> None:
        """Replaces what was there."""
        self.encoder.write().overwrite().save(f"{path}/encoder")
        about = {"cat_cols": self.cat_cols, "num_cols": self.num_cols, "model": json.loads(self.trees.to_json())}
        write_text(SparkSession.active(), f"{path}/trees.json", iter([json.dumps(about).encode()]))

    @staticmethod
    def load(path: str) -> Fitted:
        about = json.loads(read_text(SparkSession.active(), f"{path}/trees.json"))
        return Fitted(PipelineModel.load(f"{path}/encoder"), Boosted.from_json(json.dumps(about["model"])), about["cat_cols"], about["num_cols"])


def with_x(df: DataFrame, cat_cols: list[str], num_cols: list[str]) -> DataFrame:
    return df.withColumn("x", F.array(*[F.col(f"o_{c}") for c in cat_cols], *[F.col(f"f_{c}") for c in num_cols]).cast("array<double>"))


def fit_frame(frame: DataFrame, spec: ModelSpec, trees: int = TREES) -> tuple[Fitted, int]:
    """The model fitted on label and filled features: sorted ordinal codes (-1: unseen), then numbers, then trees; and the number of rows."""
    codes = Pipeline(stages=encoder(list(spec.cat_cols))).fit(frame)
    boosted, n = boosting.fit(with_x(codes.transform(frame), spec.cat_cols, spec.num_cols), len(spec.features), spec.regression, trees)
    return Fitted(codes, boosted, spec.cat_cols, spec.num_cols), n


def encoder(cats: list[str]) -> list:
    """Stages that give each f_ column's place among the sorted values that were fitted as o_, -1 for others."""
    if not cats:
        return []
    index = StringIndexer(inputCols=[f"f_{c}" for c in cats], outputCols=[f"i_{c}" for c in cats], stringOrderType="alphabetAsc", handleInvalid="keep")
    return [index, _Codes(cats)]


class _Codes(Pipeline):
    """Fitting looks the number of categories up in the indexer's metadata."""

    def __init__(self, cats: list[str] | None = None):
        super().__init__(stages=[])
        self._cats = cats or []

    def _fit(self, dataset: DataFrame) -> Transformer:
        columns = []
        for c in self._cats:
            labels = len(dataset.schema[f"i_{c}"].metadata["ml_attr"]["vals"]) - 1  # the last is for unseen values
            columns.append(f"CASE WHEN i_{c} >= {labels} THEN -1.0D ELSE i_{c} END AS o_{c}")
        return SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")

    def copy(self, extra=None):
        return _Codes(self._cats)


def training_frame(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Rows with a label, features filled, label as double."""
    df = with_missing_columns(df.where(F.col(spec.label).isNotNull()), spec)
    return fill_features(df, spec).withColumn("label", F.col(spec.label).cast("double"))


def fit(df: DataFrame, spec: ModelSpec, trees: int = TREES) -> tuple[Fitted, int]:
    """The fitted model, and the number of rows it saw.

    Labels and features are a table in the shared folder, so that ``df`` is computed once and not by each pass over them.
    """
    frame = stored(training_frame(df, spec).select("label", *inputs(spec)), "frame")
    try:
        return fit_frame(frame, spec, trees)
    finally:
        forget(frame)


def predict(model: Fitted, df: DataFrame, spec: ModelSpec) -> DataFrame:
    """``df`` with pred_<label>, and for a classifier prob_<label> (of class 1); all rows, labelled or not."""
    kept = df.columns
    out = model.transform(fill_features(with_missing_columns(df, spec), spec))
    pred = F.col("prediction") if spec.regression else F.col("prediction").cast("bigint")
    columns = [pred.alias(f"pred_{spec.label}")]
    if not spec.regression:
        columns.append(F.col("probability").alias(f"prob_{spec.label}"))
    return out.select(*kept, *columns)


def folds(df: DataFrame, k: int, order: Column, label: str | None = None) -> DataFrame:
    """``fold`` from 0 to k - 1: contiguous blocks in ``order``, within each class if a label is given.

    Rows are numbered by a range-partitioned sort and partition offsets, never in one task; the
    first blocks of a class get one row more where k does not divide it.
    """
    kept = df.columns
    if label is None:
        df, label = df.withColumn("__all", F.lit(0)), "__all"
    rows = numbered(df.orderBy(F.col(label), order))
    sizes = sorted(((r[0], r[1]) for r in df.groupBy(label).agg(F.count("*")).collect()), key=lambda x: (x[0] is not None, x[0]))
    index, short = F.lit(None).cast("long"), F.lit(None).cast("long")
    extra, start = F.lit(None).cast("long"), 0
    for value, n in sizes:
        here = F.col(label).eqNullSafe(F.lit(value))
        index = F.when(here, F.col("row_number") - start).otherwise(index)
        short, extra = F.when(here, F.lit(n // k)).otherwise(short), F.when(here, F.lit(n % k)).otherwise(extra)
        start += n
    dealt = rows.withColumns({"__i": index, "__q": short, "__r": extra})
    large = F.col("__r") * (F.col("__q") + 1)
    fold = F.when(F.col("__i") < large, F.expr("__i div (__q + 1)")).otherwise(F.col("__r") + F.expr("(__i - __r * (__q + 1)) div greatest(__q, 1)"))
    out = dealt.select(*kept, fold.cast("int").alias("fold"))
    out.scratch_path = rows.scratch_path
    return out


def evaluate(df: DataFrame, spec: ModelSpec, order: Column, k: int = 3, trees: int = TREES) -> dict:
    """Mean and population spread of the metric over k folds, and the number of rows.

    A fold that can't be judged (one class, or no rows to fit or test) counts as not a number,
    and so do the mean and the spread of no other folds.  ``df`` is computed once, and of it only order, label and features are kept.
    Most of a fit is short passes over few blocks, so folds are fitted side by side.
    """
    whole = stored(training_frame(df, spec).select(order.alias("order"), "label", *inputs(spec)), "frame")
    ranked = folds(whole, k, F.col("order"), None if spec.regression else "label")
    frame = ranked.drop("order")
    seen = {r.fold: (r.n, r.kinds) for r in frame.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("label").alias("kinds")).collect()}
    total = sum(n for n, _ in seen.values())

    def judged(fold: int) -> float:
        model, _ = fit_frame(frame.where(F.col("fold") != fold), spec, trees)
        return metric(model.transform(frame.where(F.col("fold") == fold)), spec)

    fit = [fold for fold, (n, kinds) in sorted(seen.items()) if total != n and (kinds > 1 or spec.regression)]
    try:
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            scores = [s for s in pool.map(inheritable_thread_target(df.sparkSession)(judged), fit) if not math.isnan(s)]
        mean = sum(scores) / len(scores) if scores else math.nan
        std = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)) if scores else math.nan
        return {"mean": mean, "std": std, "n": total}
    finally:
        forget(whole, ranked)


def metric(predicted: DataFrame, spec: ModelSpec) -> float:
    """Exact ROC AUC of a classifier, R squared of a regressor."""
    if spec.regression:
        return RegressionEvaluator(metricName="r2").evaluate(predicted)
    return BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0, rawPredictionCol="raw").evaluate(predicted)


def gain_importance(model: Fitted, spec: ModelSpec) -> DataFrame:
    """Summed split gains over all trees, at least 0, as shares of their sum; spread 0."""
    gains = model.trees.gains(len(spec.features)).tolist()
    total = sum(gains)
    data = [(f, g / total if total else 0.0, 0.0) for f, g in zip(spec.features, gains, strict=True)]
    return ranked(SparkSession.active().createDataFrame(data, "feature string, importance_mean double, importance_std double"))


def _placed(trees: Boosted, features: int) -> Column:
    """x as places among the trees' thresholds, two bytes each (four where there are more): all that a score depends on."""

    @F.arrow_udf("binary")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grid = boosting.Grid(trees.trees, features)
        kind = _place_kind(grid)
        for rows in batches:
            x = boosting.matrix(rows)
            flat = np.ascontiguousarray(grid.places(x).T.astype(kind)) if len(rows) else np.zeros((0, features), kind)
            yield _pieces(flat, np.arange(len(rows) + 1))

    return places(F.col("x"))


def _place_kind(grid: boosting.Grid) -> type:
    return np.uint16 if max(grid.sizes, default=0) < 1 << 16 else np.uint32


def _pieces(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Rows of ``values`` from cut to cut, as bytes."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes_of(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The rows' bytes one after another."""
    parts = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int32)
        parts.append(memoryview(chunk.buffers()[2] or b"")[ends[0] : ends[-1]])
    return np.frombuffer(b"".join(parts), kind)


def mixed(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a random permutation of 0..n-1 takes these: a keyed Feistel network, run again on what it takes beyond n."""
    half = np.uint64(max(1, (n.bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, 6, np.uint64)
    out, todo = rows.astype(np.uint64), np.arange(len(rows))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in keys:
            h = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


#: Rows of a block of pairs, at least, and the most blocks; scores of a range, about; rows whose scores give the ranges' limits.
PAIRS, BLOCKS, RANGE, LIMITS = 1 << 16, 1 << 10, 1 << 20, 200_000


def _in_blocks(size: int, number: np.ndarray, places: np.ndarray, label: np.ndarray | None) -> pa.RecordBatch:
    """For each block of ``size`` numbers a row: where in it these rows are, their places and, of the first side, labels, as bytes."""
    block = number // size
    order = np.argsort(block.astype(np.uint16), kind="stable")
    block = block[order]
    cuts = np.append(np.nonzero(np.diff(block, prepend=-1))[0], len(block))
    columns = [pa.array(block[cuts[:-1]]), _pieces((number % size).astype(np.uint32)[order], cuts), _pieces(places[order], cuts), pa.nulls(len(cuts) - 1, pa.binary()) if label is None else _pieces(label[order], cuts)]
    return pa.RecordBatch.from_arrays(columns, names=["block", "at", "p", "label"])


def _to_blocks(size: int, kind: type) -> Callable:
    """Rows (row_number, p, and of the first side label) as those of blocks."""

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        number, places = (np.concatenate(c) for c in zip(*[(np.asarray(b.column("row_number")), _bytes_of(pa.chunked_array([b.column("p")]), kind).reshape(b.num_rows, -1)) for b in batches], strict=True))
        return _in_blocks(size, number, places, np.concatenate([np.asarray(b.column("label"), dtype=np.float64) for b in batches]) if "label" in batches[0].schema.names else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
            if rows >= PAIRS:
                yield packed(waiting)
                waiting, rows = [], 0
        if waiting:
            yield packed(waiting)

    return run


def _permuted(size: int, kind: type, n: int, seed: int) -> Callable:
    """Rows of blocks as partners: their numbers dealt out by a random permutation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.table(batch.slice(k, 1))
                at = _bytes_of(row.column("at"), np.uint32)
                number = mixed(row.column("block")[0].as_py() * size + at.astype(np.int64), n, seed)
                yield _in_blocks(size, number, _bytes_of(row.column("p"), kind).reshape(len(at), -1), None)

    return run


def _scores(scorer: boosting.Scorer, of: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each feature the rows' scores with its value from the partner, and last the scores with none."""
    return np.concatenate([scorer.dealt_places(of, other), scorer.sums(of)[None]])


def _block_scores(trees: Boosted, features: int, kind: type, whole: bool) -> Callable:
    """Of a block's rows the labels and, for each feature, the scores with that feature's value from the partner; with ``whole``, also those with none."""
    scorer = boosting.Scorer(trees, features)

    def run(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        first = block.column("label").is_valid()
        sides, label = [], None
        for side in (block.filter(first), block.filter(pa.compute.invert(first))):
            at = _bytes_of(side.column("at"), np.uint32)
            places = np.empty((features, len(at)), np.intp)
            places[:, at] = _bytes_of(side.column("p"), kind).reshape(len(at), features).T
            sides.append(places)
            if label is None:
                label = np.empty(len(at))
                label[at] = _bytes_of(side.column("label"), np.float64)
        return label, _scores(scorer, *sides) if whole else scorer.dealt_places(*sides)

    return run


def _plain_scores(scores: Callable) -> Callable:
    def run(block: pa.Table) -> pa.Table:
        label, raw = scores(block)
        return pa.table({"feature": np.repeat(np.arange(len(raw)), len(label)), "label": np.tile(label, len(raw)), "raw": raw.ravel()})

    return run


def _ranged_scores(scores: Callable, limits: list[np.ndarray]) -> Callable:
    """Different scores of a block by (feature, range of scores), those of class 1 and the others, and how many there are of each."""

    def run(block: pa.Table) -> pa.Table:
        label, raw = scores(block)
        out = []
        for f, (limit, dealt) in enumerate(zip(limits, raw, strict=False)):  # without those of the whole, mostly
            for one in (True, False):
                values, times = np.unique(dealt[(label == 1) == one], return_counts=True)
                cuts = np.concatenate([[0], np.searchsorted(values, limit), [len(values)]])
                on = np.nonzero(np.diff(cuts))[0]
                if len(on):
                    cuts = np.append(cuts[on], len(values))
                    out.append(pa.table([pa.array(np.full(len(on), f)), pa.array(on), pa.array(np.full(len(on), one)), _pieces(values, cuts), _pieces(times.astype(np.uint32), cuts)], names=["feature", "range", "one", "raw", "n"]))
        return pa.concat_tables(out)

    return run


def _pairs_won(scores: pa.Table) -> pa.Table:
    """Of a range of one feature's scores: rows of class 1, others, and twice the pairs that class 1 wins, ties by half."""
    raw, times = _bytes_of(scores.column("raw"), np.float64), _bytes_of(scores.column("n"), np.uint32).astype(np.int64)
    one = np.repeat(np.asarray(scores.column("one")), np.asarray(pa.compute.binary_length(scores.column("raw"))) // raw.itemsize)
    order = np.argsort(raw)
    first = np.nonzero(np.diff(raw[order], prepend=np.nan))[0]
    p, n = (np.add.reduceat(np.where(of, times, 0)[order], first) for of in (one, ~one))
    won = int((p * (2 * np.cumsum(n) - n)).sum())
    return pa.table({"feature": scores.column("feature")[:1], "range": scores.column("range")[:1], "p": [int(p.sum())], "n": [int(n.sum())], "won": [won]})


def _some_scores(trees: Boosted, features: int, kind: type, share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, r = boosting.Scorer(trees, features), np.random.default_rng(SEED + TaskContext.get().partitionId())
        for batch in batches:
            places = _bytes_of(pa.chunked_array([batch.column("p")]), kind).reshape(-1, features)
            places = places[r.random(len(places)) < share].T.astype(np.intp)
            raw = _scores(scorer, places, places[:, r.permutation(places.shape[1])])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(raw)), raw.shape[1])), pa.array(raw.ravel())], names=["feature", "raw"])

    return run


def _limits(fixed: DataFrame, trees: Boosted, features: int, kind: type, n: int) -> list[np.ndarray]:
    """Of each feature, and of the whole, scores that cut the dealt scores into ranges of about ``RANGE``; by some rows, as only the ranges' sizes depend on them."""
    ranges = -(-n // RANGE)
    if ranges < 2:
        return [np.zeros(0)] * (features + 1)
    some = fixed.select("p").mapInArrow(_some_scores(trees, features, kind, LIMITS / n), "feature long, raw double")
    found = {r.feature: r.limits for r in some.groupBy("feature").agg(F.percentile_approx("raw", [k / ranges for k in range(1, ranges)], 1000 + 10 * ranges).alias("limits")).collect()}
    return [np.unique(np.array(found.get(f, []), np.float64)) for f in range(features + 1)]


def _dealt_metric(blocks: DataFrame, scores: Callable, limits: list[np.ndarray], regression: bool) -> dict[int, float]:
    """The metric of each feature's scores; of the AUC, each range of scores adds its pairs, and the driver those between ranges."""
    if regression:
        return grouped_metric(blocks.applyInArrow(_plain_scores(scores), "feature long, label double, raw double"), True)
    ranges = blocks.applyInArrow(_ranged_scores(scores, limits), "feature long, range long, one boolean, raw binary, n binary")
    sums: dict[int, tuple[int, int, int]] = {}
    for r in sorted(ranges.groupBy("feature", "range").applyInArrow(_pairs_won, "feature long, range long, p long, n long, won long").collect()):
        p, n, won = sums.get(r.feature, (0, 0, 0))
        sums[r.feature] = (p + r.p, n + r.n, won + r.won + 2 * r.p * n)
    return {f: won / (2 * p * n) if p and n else math.nan for f, (p, n, won) in sums.items()}


def grouped_metric(scores: DataFrame, regression: bool) -> dict[int, float]:
    """Exact ROC AUC or R squared of each feature's rows (feature, label, raw); not a number where there is none.

    For the AUC, rows are counted by score, and the counts sorted by range partitions; each partition adds the
    negatives below it.  No partition, and no feature's rows, need to be in one task.
    """
    if regression:
        y, p = F.col("label"), F.col("raw")
        sums = scores.groupBy("feature").agg(F.sum((y - p) ** 2).alias("rest"), (F.var_pop("label") * F.count("*")).alias("all"))
        return {r.feature: 1 - r.rest / r["all"] if r["all"] else math.nan for r in sums.collect()}
    counts = scores.groupBy("feature", "raw").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    table = stored(counts.repartitionByRange("feature", "raw").withColumn("part", F.spark_partition_id()), "ranked")
    below, out, offsets = {}, {}, []
    totals = table.groupBy("part", "feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
    for r in sorted(totals, key=lambda r: (r.feature, r.part)):
        offsets.append((r.part, r.feature, below.get(r.feature, (0, 0))[1]))
        p, n = below.get(r.feature, (0, 0))
        below[r.feature] = (p + r.p, n + r.n)
    shift = table.sparkSession.createDataFrame(offsets or [(0, 0, 0)], "part int, feature long, shift long")  # a row for each partition and feature
    here = Window.partitionBy("part", "feature").orderBy("raw").rowsBetween(Window.unboundedPreceding, -1)
    rows = table.withColumn("under", F.coalesce(F.sum("n").over(here), F.lit(0))).join(F.broadcast(shift), ["part", "feature"])
    for r in rows.groupBy("feature").agg(F.sum(F.col("p") * (F.col("shift") + F.col("under") + F.col("n") / 2)).alias("s")).collect():
        p, n = below[r.feature]
        out[r.feature] = r.s / (p * n) if p and n else math.nan
    forget(table)
    return out


def permutation_importance(model: Fitted, df: DataFrame, spec: ModelSpec, repeats: int = 10, first: Column | None = None, dealt: Callable[[int], Column] | None = None) -> DataFrame:
    """Mean and population spread of the metric's drop when one feature's values are dealt out anew.

    A repeat deals the rows' numbers out by a random permutation (or numbers the rows by ``dealt``), and blocks of numbers
    bring rows and partners together as bytes, by one shuffle; each block scores its rows once for each feature, with that
    feature's value from the partner, and ranges of scores rank all features'.
    """
    frame, features = training_frame(df, spec), len(spec.features)
    deals = [f"deal{k}" for k in range(repeats)] if dealt else []
    rows = model.encoded(frame.withColumns({d: dealt(k) for k, d in enumerate(deals)}) if dealt else frame)
    rows = rows.orderBy(first) if first is not None else rows
    fixed = numbered(rows.select("label", _placed(model.trees, features).alias("p"), *deals))
    kind, n = _place_kind(boosting.Grid(model.trees.trees, features)), fixed.count()
    size = max(PAIRS, -(-n // BLOCKS))
    limits = [] if spec.regression else _limits(fixed, model.trees, features, kind, n)
    base, packed = math.nan, "block long, at binary, p binary, label binary"
    drops: dict[str, list[float]] = {f: [] for f in spec.features}
    one = stored(fixed.select("row_number", "p", "label").mapInArrow(_to_blocks(size, kind), packed), "blocks")
    for k in range(repeats):
        if dealt:
            other = numbered(fixed.select("p", f"deal{k}").orderBy(f"deal{k}"))
            sides = one.unionByName(other.select("row_number", "p").mapInArrow(_to_blocks(size, kind), packed))
        else:
            sides = one.unionByName(one.mapInArrow(_permuted(size, kind, n, SEED + k), packed))
        scores = _block_scores(model.trees, features, kind, whole=k == 0)
        found = _dealt_metric(sides.repartition(max(1, -(-n // size)), "block").groupBy("block"), scores, limits, spec.regression)
        base = found.get(features, base)
        for k_of, f in enumerate(spec.features):
            drops[f].append(base - found.get(k_of, math.nan))
        if dealt:
            forget(other)
    forget(fixed, one)
    data = []
    for f, d in drops.items():
        mean = sum(d) / len(d)
        data.append((f, mean, math.sqrt(sum((x - mean) ** 2 for x in d) / len(d))))
    return ranked(df.sparkSession.createDataFrame(data, "feature string, importance_mean double, importance_std double"))


def numbered(df: DataFrame) -> DataFrame:
    """``row_number`` 0..n-1 in the present order, from partition sizes.

    The rows are a table in the shared folder (``forget`` deletes it), so a row has its number
    for good, whatever executors are lost.
    """
    marked = stored(df.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "numbered")
    sizes = {r.part: r.n for r in marked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, seen = [], 0
    for part in sorted(sizes):
        offsets.append((part, seen - (part << 33)))
        seen += sizes[part]
    shift = df.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, shift long")  # a row for each partition
    out = marked.join(F.broadcast(shift), "part").withColumn("row_number", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    out.scratch_path = marked.scratch_path
    return out


def label_summary(df: DataFrame, label: str) -> DataFrame:
    """positives, negatives: rows with label 1, and with label 0."""
    return df.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> dict[str, float | None]:
    """Exact quantiles with linear interpolation, by a distributed sort: two rows of each reach the driver."""
    rows = numbered(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")).orderBy("x"))
    n = rows.count()
    places = {name: share * (n - 1) for name, share in shares.items()}
    wanted = sorted({min(n - 1, int(p) + k) for p in places.values() for k in (0, 1)}) if n else []
    found = {r.row_number: r.x for r in rows.where(F.col("row_number").isin(wanted)).collect()}
    forget(rows)
    at = lambda p: found[int(p)] + (p - int(p)) * (found[min(n - 1, int(p) + 1)] - found[int(p)])
    return {name: at(p) if n else None for name, p in places.items()}


def ranked(importances: DataFrame) -> DataFrame:
    """Most important first; ties by name."""
    return importances.orderBy(F.desc("importance_mean"), "feature")
