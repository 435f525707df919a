"""Command line: sync, status, enrich, train, importance, score."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from permitloom.config import MODELS
from permitloom.operators.storage import last_modified, row_count, write_source
from permitloom.plans import enrich, models
from permitloom.sources.layers import fetch_layers
from permitloom.sources.portal import SOURCES


def _table(title: str, heads: Sequence[str], rows: Sequence[Sequence[str]]) -> None:
    widths = [max(len(str(x)) for x in column) for column in zip(heads, *rows, strict=True)]
    print(title)
    for row in (heads, *rows):
        print("  ".join(str(x).ljust(w) for x, w in zip(row, widths, strict=True)).rstrip())


def sync(spark: SparkSession, data_dir: str, source: str | None) -> int:
    wanted = SOURCES if source is None else {k: v for k, v in SOURCES.items() if k == source}
    if not wanted:
        print(f"There is no source {source!r}; there are: {', '.join(SOURCES)}")
        return 1
    for name, portal in wanted.items():
        try:
            outcome = f"{write_source(portal.fetch(spark), name, data_dir):,} rows written"
        except Exception as why:  # one source's failure doesn't stop the others
            outcome = f"failed: {why}"
        print(f"{name}: {outcome}")
    return 0


def status(spark: SparkSession, data_dir: str) -> int:
    rows = []
    for name in SOURCES:
        n, at = row_count(spark, name, data_dir), last_modified(spark, name, data_dir)
        rows.append((name, "no data" if n is None else f"{n:,}", "no data" if at is None else f"{at:%Y-%m-%d %H:%M}"))
    _table("Source status", ("Source", "Rows", "Last modified"), rows)
    return 0


def run_enrich(spark: SparkSession, data_dir: str, fetch: bool) -> int:
    if fetch:
        fetch_layers(spark, f"{data_dir}/reference")
    for title, step in (("committee applications", enrich.enrich_coa), ("development applications", enrich.enrich_dev)):
        print(f"Enriching {title}...")
        try:
            print(f"  {step(spark, data_dir):,} rows written")
        except Exception as why:
            print(f"  failed: {why}")
    return 0


def train(spark: SparkSession, data_dir: str, model_dir: str) -> int:
    try:
        counts, metrics = models.train_all(spark, data_dir, model_dir)
    except Exception as why:
        print(f"  failed: {why}")
        return 1
    _table("Model training results", ("Model", "N rows", "CV score"), [(m, f"{n:,}", f"{metrics[m]['mean']:.4f} ± {metrics[m]['std']:.4f}") for m, n in counts.items()])
    return 0


def importance(spark: SparkSession, data_dir: str, model_dir: str, model: str, builtin: bool) -> int:
    try:
        rows = models.feature_importance(spark, model, data_dir, model_dir, builtin).collect()
    except ValueError as why:
        print(why)
        return 1
    ranked = [(k, r.feature, f"{r.importance_mean:.4f}", f"{r.importance_std:.4f}") for k, r in enumerate(rows, 1)]
    _table(f"Feature importance of {model}", ("Rank", "Feature", "Importance", "± Std"), ranked)
    return 0


def score(spark: SparkSession, data_dir: str, model_dir: str) -> int:
    try:
        models.score_all(spark, data_dir, model_dir)
    except Exception as why:
        print(f"  failed: {why}")
        return 1
    print(f"Scores written to {data_dir}/scores")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="permitloom", description=__doc__)
    p.add_argument("--data-dir", default="data")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("sync").add_argument("--source", help=f"one of {', '.join(SOURCES)} (default: all)")
    sub.add_parser("status")
    sub.add_parser("enrich").add_argument("--fetch-ref", action=argparse.BooleanOptionalAction, default=True)
    for name in ("train", "score", "importance"):
        s = sub.add_parser(name)
        s.add_argument("--model-dir", default="models")
        if name == "importance":
            s.add_argument("model", help=f"one of {', '.join(MODELS)}")
            kind = s.add_mutually_exclusive_group()
            kind.add_argument("--builtin", action="store_true")
            kind.add_argument("--permutation", dest="builtin", action="store_false")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("permitloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "sync":
        return sync(spark, a.data_dir, a.source)
    if a.command == "status":
        return status(spark, a.data_dir)
    if a.command == "enrich":
        return run_enrich(spark, a.data_dir, a.fetch_ref)
    if a.command == "train":
        return train(spark, a.data_dir, a.model_dir)
    if a.command == "importance":
        return importance(spark, a.data_dir, a.model_dir, a.model, a.builtin)
    return score(spark, a.data_dir, a.model_dir)


if __name__ == "__main__":
    sys.exit(main())
