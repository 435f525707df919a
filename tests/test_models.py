"""Training, evaluation, scoring, importances and the command line on small tables."""

import json
import math
import threading

import pytest
from pyspark.sql import functions as F

from permitloom import cli
from permitloom.config import MODELS
from permitloom.operators import ml
from permitloom.plans import models


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    dev = [("OZ" if k % 2 else "SA", str(k % 5), None if k % 7 == 0 else "RD", None, 2015 + k % 5, k % 2, 0, 0, k % 3 == 0 and 1 or 0, int(k % 2 == 0), None if k % 4 == 0 else int(k % 3 == 0)) for k in range(120)]
    spark.createDataFrame(dev, "application_type string, ward_number string, zoning_class string, secondary_plan_name string, year_submitted bigint, in_heritage_register bigint, in_heritage_district bigint, in_secondary_plan bigint, has_community_meeting bigint, dev_approved bigint, dev_no_appeal bigint").coalesce(1).write.parquet(f"{base}/enriched/dev_applications.parquet")
    coa = [("MV", "a" if k % 3 else "b", str(k % 4), None, 2020 + k % 3, int(k % 3 > 0), 30 * (k % 4) if k % 3 else None) for k in range(90)]
    spark.createDataFrame(coa, "application_type string, sub_type string, ward_number string, zoning_designation string, year_submitted bigint, coa_approved bigint, coa_days_to_approval bigint").coalesce(1).write.parquet(f"{base}/enriched/coa.parquet")
    counts, metrics = models.train_all(spark, str(base), f"{base}/models", trees=3)
    return str(base), counts, metrics


def test_training(data):
    base, counts, metrics = data
    assert counts == {"dev_applications_approved": 120, "dev_applications_no_appeal": 90, "coa_approved": 90, "coa_days_to_approval": 60}
    with open(f"{base}/models/metrics.json") as f:
        saved = json.load(f)
    assert set(saved) == set(MODELS) and all(set(m) == {"mean", "std", "n"} for m in saved.values())
    assert metrics["dev_applications_approved"]["mean"] > 0.95


def test_scores(spark, data):
    base = data[0]
    models.score_all(spark, base, f"{base}/models")
    dev, coa = (spark.read.parquet(f"{base}/scores/{s}.parquet") for s in ("dev_applications", "coa"))
    assert dev.columns[-4:] == ["pred_dev_approved", "prob_dev_approved", "pred_dev_no_appeal", "prob_dev_no_appeal"]
    assert coa.columns[-3:] == ["pred_coa_approved", "prob_coa_approved", "pred_coa_days_to_approval"]
    assert dev.count() == 120 and coa.count() == 90
    assert dev.where("prob_dev_approved not between 0 and 1 or prob_dev_approved is null").isEmpty() and dict(dev.dtypes)["pred_dev_approved"] == "bigint"


def test_score_one(spark, data):
    base = data[0]
    out = models.score_one(spark, "dev_applications", {"application_type": "new", "ward_number": 3, "other": 1}, f"{base}/models")
    assert set(out) == {"pred_dev_approved", "prob_dev_approved", "pred_dev_no_appeal", "prob_dev_no_appeal"} and isinstance(out["pred_dev_approved"], int)
    assert isinstance(models.score_one(spark, "coa", {}, f"{base}/models")["pred_coa_days_to_approval"], float)
    with pytest.raises(ValueError, match="Unknown source"):
        models.score_one(spark, "other", {}, f"{base}/models")


@pytest.mark.parametrize("builtin", [True, False])
def test_importance(spark, data, builtin):
    base = data[0]
    rows = models.feature_importance(spark, "coa_approved", base, f"{base}/models", builtin, repeats=2).collect()
    assert {r.feature for r in rows} == set(MODELS["coa_approved"].features)
    means = [r.importance_mean for r in rows]
    assert means == sorted(means, reverse=True) and rows[0].feature == "sub_type"
    assert not builtin or all(r.importance_std == 0 for r in rows)


def test_unknown_model(spark, data):
    with pytest.raises(ValueError, match="Unknown model"):
        models.feature_importance(spark, "x", data[0], "models")


def test_degenerate_cross_validation(spark):
    df = spark.createDataFrame([(k, int(k == 0), "a") for k in range(5)], "year_submitted int, coa_approved int, application_type string")
    r = ml.evaluate(df, MODELS["coa_approved"], df.year_submitted, trees=1)
    assert r["n"] == 5 and (math.isnan(r["mean"]) or 0 <= r["mean"] <= 1)


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """All three fits have begun before one ends, the table is computed once, and scores are those of the folds one after another."""
    spec, met, seen = MODELS["coa_approved"], threading.Barrier(3), spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(v):
        seen.add(1)
        return v

    fit_frame = ml.fit_frame

    def fit(frame, spec, n):
        met.wait(60)
        return fit_frame(frame, spec, n)

    monkeypatch.setattr(ml, "fit_frame", fit)
    label = lambda k: int(k * 7 % 11 < 6)
    rows = [(k, label(k), "ab"[label(k) if k % 5 else k % 2]) for k in range(150)]
    df = spark.createDataFrame(rows, "year_submitted int, coa_approved int, application_type string")
    got = ml.evaluate(df.withColumn("application_type", F.when(counted("year_submitted") >= 0, F.col("application_type"))), spec, df.year_submitted, trees=2)
    assert got["n"] == seen.value == 150
    monkeypatch.setattr(ml, "fit_frame", fit_frame)
    cut = ml.folds(ml.training_frame(df, spec), 3, F.col("year_submitted"), "label").cache()
    alone = [ml.metric(ml.fit_frame(cut.where(F.col("fold") != f), spec, 2)[0].transform(cut.where(F.col("fold") == f)), spec) for f in range(3)]
    assert got["mean"] == pytest.approx(sum(alone) / 3) and 0.6 < got["mean"] < 1
    assert got["std"] == pytest.approx(math.sqrt(sum((a - sum(alone) / 3) ** 2 for a in alone) / 3))


def test_small_tables_give_constant_models(spark, tmp_path):
    df = spark.createDataFrame([(2020, 1), (2021, 0), (2022, None)], "year_submitted int, coa_approved int")
    assert models.train_model(df, MODELS["coa_approved"], str(tmp_path), 1) == 2
    rows = ml.gain_importance(models.load_model(str(tmp_path), "coa_approved"), MODELS["coa_approved"]).collect()
    assert [r.importance_mean for r in rows] == [0.0] * 5


def test_command_line(spark, data, tmp_path, capsys, monkeypatch):
    base = data[0]
    assert cli.main(["--data-dir", str(tmp_path), "sync", "--source", "nope"], spark) == 1
    assert "no source 'nope'" in capsys.readouterr().out

    class Good:
        def fetch(self, spark):
            return spark.createDataFrame([(2024, "a")], "year int, k string")

    class Bad:
        def fetch(self, spark):
            raise RuntimeError("no network")

    monkeypatch.setattr(cli, "SOURCES", {"coa": Bad(), "permits_active": Good()})
    assert cli.main(["--data-dir", str(tmp_path), "sync"], spark) == 0
    out = capsys.readouterr().out
    assert "no network" in out and "1 rows written" in out
    assert cli.main(["--data-dir", str(tmp_path), "status"], spark) == 0
    assert "no data" in capsys.readouterr().out
    assert cli.main(["--data-dir", base, "score", "--model-dir", f"{base}/models"], spark) == 0
    assert cli.main(["--data-dir", base, "importance", "coa_approved", "--model-dir", f"{base}/models", "--builtin"], spark) == 0
    assert cli.main(["--data-dir", base, "importance", "nope", "--model-dir", f"{base}/models"], spark) == 1
    assert cli.main(["--data-dir", str(tmp_path), "train"], spark) == 1
    assert cli.main(["--data-dir", str(tmp_path), "enrich", "--no-fetch-ref"], spark) == 0


def test_missing_numbers_are_told_from_real_ones(spark):
    """A null and a real -1 are two values to the trees."""
    df = spark.createDataFrame([(-1 if k % 2 else None, k % 2, "a") for k in range(200)], "year_submitted int, coa_approved int, application_type string")
    spec = MODELS["coa_approved"]
    model, n = ml.fit(df, spec, 5)
    rows = ml.predict(model, df, spec).collect()
    assert n == 200 and all(r.pred_coa_approved == r.coa_approved for r in rows)
    shares = {r.feature: r.importance_mean for r in ml.gain_importance(model, spec).collect()}
    drops = {r.feature: r.importance_mean for r in ml.permutation_importance(model, df, spec, 2).collect()}
    assert shares["year_submitted"] == 1 and drops["year_submitted"] > 0.2 and not any(drops[f] for f in spec.features if f != "year_submitted")


def test_numbers_and_quantiles(spark):
    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    df = spark.createDataFrame([(float(k),) for k in range(101)] + [(None,)], "x double").repartition(5)
    rows = ml.numbered(df.orderBy("x"))
    assert [r.x for r in rows.orderBy("row_number").collect()] == [None, *map(float, range(101))]
    assert ml.quantiles(df, "x", {"a": 0.5, "b": 0.905, "c": 1.0, "d": 0.0}) == pytest.approx({"a": 50.0, "b": 90.5, "c": 100.0, "d": 0.0})
    assert ml.quantiles(df.limit(0), "x", {"a": 0.5}) == {"a": None} and ml.numbered(df.limit(0)).count() == 0
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == kept
