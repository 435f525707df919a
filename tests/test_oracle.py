"""Every query that has SQL gives DuckDB's rows and types."""

import datetime
import inspect
import math

import duckdb
import pytest

import __spark_entry__ as entry
from permitloom.operators import ml
from permitloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_rows_and_types(spark, duck, name):
    df, sql = entry.queries()[name](spark, SF), duck.sql(plans.ORACLE_SQL[name])
    assert sorted((c, KINDS[t]) for c, t in df.dtypes) == sorted((c, str(t)) for c, t in zip(sql.columns, sql.types, strict=True))
    names = sorted(df.columns)
    key = lambda row: [(v is None, str(v)) for v in row]
    mine = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=key)
    at = [sql.columns.index(c) for c in names]
    theirs = sorted(([plain(r[i]) for i in at] for r in sql.fetchall()), key=key)
    assert mine and mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["train_classifier", "train_regressor", "score_batch", "score_one", "importance_gain", "importance_permutation", "cross_validate"])
def test_model_queries(spark, monkeypatch, name):
    """With few trees; the next test holds what the queries ask for."""
    fit_frame, permute = ml.fit_frame, ml.permutation_importance
    monkeypatch.setattr(ml, "fit_frame", lambda frame, spec, n=ml.TREES: fit_frame(frame, spec, 6))
    monkeypatch.setattr(ml, "permutation_importance", lambda model, df, spec, n=10: permute(model, df, spec, 2))
    rows = [r.asDict() for r in entry.queries()[name](spark, SF).collect()]
    assert rows
    for r in rows:
        for k, v in r.items():
            if k.startswith("prob_"):
                assert 0 <= v <= 1
    if name.startswith("importance"):
        assert [r["importance_mean"] for r in rows] == sorted((r["importance_mean"] for r in rows), reverse=True)
        assert len(rows) == 5
    if name == "importance_gain":
        assert abs(sum(r["importance_mean"] for r in rows) - 1) < 1e-9 and all(r["importance_std"] == 0 for r in rows)


@pytest.mark.parametrize("name", ["train_classifier", "train_regressor", "score_batch", "score_one", "importance_gain", "importance_permutation", "cross_validate"])
def test_model_queries_have_production_size(spark, monkeypatch, name):
    trees, repeats, fit_frame, permute = [], [], ml.fit_frame, ml.permutation_importance

    def small(frame, spec, n=ml.TREES):
        trees.append(n)
        return fit_frame(frame, spec, 1)

    def once(model, df, spec, n=inspect.signature(permute).parameters["repeats"].default):
        repeats.append(n)
        return permute(model, df, spec, 1)

    monkeypatch.setattr(ml, "fit_frame", small)
    monkeypatch.setattr(ml, "permutation_importance", once)
    assert entry.queries()[name](spark, SF).count() > 0
    assert set(trees) == {100} and repeats == [10] * (name == "importance_permutation")
