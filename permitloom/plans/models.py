"""Training, scoring and importances of the outcome models on enriched tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitloom.config import MODELS, ModelSpec
from permitloom.operators import ml
from permitloom.operators.storage import SOURCE_ROW, read_table, replace, write_text

SCORED = ("dev_applications", "coa")


def enriched_path(data_dir: str, source: str) -> str:
    return f"{data_dir}/enriched/{source}.parquet"


def load_model(model_dir: str, name: str) -> ml.Fitted:
    return ml.Fitted.load(f"{model_dir}/{name}")


def train_model(df: DataFrame, spec: ModelSpec, model_dir: str, trees: int = ml.TREES) -> int:
    """Fit, save over what was there, and return the number of labelled rows."""
    model, n = ml.fit(df, spec, trees)
    model.save(f"{model_dir}/{spec.name}")
    return n


def train_all(spark: SparkSession, data_dir: str, model_dir: str, trees: int = ml.TREES) -> tuple[dict[str, int], dict[str, dict]]:
    """Fit and cross-validate all models; writes metrics.json.  Folds are blocks of the rows as they are stored."""
    counts, metrics = {}, {}
    for name, spec in MODELS.items():
        df = read_table(spark, enriched_path(data_dir, spec.source))
        counts[name] = train_model(df, spec, model_dir, trees)
        metrics[name] = ml.evaluate(df, spec, stored_order(df), trees=trees)
    write_text(spark, f"{model_dir}/metrics.json", iter([json.dumps(metrics, indent=2).encode()]))
    return counts, metrics


def stored_order(df: DataFrame) -> Column:
    """The folders of the years one after another, and each one's rows as they were in the source; a hash of the row where that is not known."""
    year = next((F.col(c).cast("int") for c in ("year", "year_submitted") if c in df.columns), F.lit(0))
    return F.struct(year, F.col(SOURCE_ROW) if SOURCE_ROW in df.columns else F.xxhash64(*sorted(df.columns)))


def score_table(df: DataFrame, source: str, model_dir: str) -> DataFrame:
    for spec in (m for m in MODELS.values() if m.source == source):
        df = ml.predict(load_model(model_dir, spec.name), df, spec)
    return df


def score_all(spark: SparkSession, data_dir: str, model_dir: str) -> None:
    """Write data/scores/<source>.parquet of both enriched tables, all rows."""
    for source in SCORED:
        replace(score_table(read_table(spark, enriched_path(data_dir, source)), source, model_dir), f"{data_dir}/scores/{source}.parquet")


def score_one(spark: SparkSession, source: str, features: dict[str, Any], model_dir: str) -> dict[str, Any]:
    """Predictions for one application; absent features are null, others are ignored."""
    if source not in SCORED:
        raise ValueError(f"Unknown source: {source!r} (known: {', '.join(SCORED)})")
    specs = [m for m in MODELS.values() if m.source == source]
    text = [c for c in specs[0].cat_cols]
    fields = [T.StructField(c, T.StringType() if c in text else T.DoubleType()) for c in specs[0].features]
    values = [None if (v := features.get(f.name)) is None else str(v) if f.name in text else float(v) for f in fields]
    row = score_table(spark.createDataFrame([values], T.StructType(fields)), source, model_dir).first()
    out: dict[str, Any] = {}
    for spec in specs:
        pred = row[f"pred_{spec.label}"]
        out[f"pred_{spec.label}"] = float(pred) if spec.regression else int(pred)
        if not spec.regression:
            out[f"prob_{spec.label}"] = float(row[f"prob_{spec.label}"])
    return out


def feature_importance(spark: SparkSession, model: str, data_dir: str, model_dir: str, builtin: bool = False, repeats: int = 10) -> DataFrame:
    """feature, importance_mean, importance_std, most important first."""
    if model not in MODELS:
        raise ValueError(f"Unknown model: {model!r} (known: {', '.join(MODELS)})")
    spec, fitted = MODELS[model], load_model(model_dir, model)
    if builtin:
        return ml.gain_importance(fitted, spec)
    return ml.permutation_importance(fitted, read_table(spark, enriched_path(data_dir, spec.source)), spec, repeats)
