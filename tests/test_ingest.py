"""Sources, normalization and storage, with an offline client."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitloom.config import SourceConfig
from permitloom.operators import normalize as N
from permitloom.operators import storage
from permitloom.sources.base import Source
from permitloom.sources.portal import SOURCES, PortalSource
from permitloom.sources.served import LocalPortal


def served(resources, pages=(), files=None):
    texts = [[json.dumps(r) for r in p] for p in pages]
    at = lambda k: texts[k] if k < len(texts) else []
    return LocalPortal(resources, lambda offset, limit: at(offset // limit), files=lambda path: iter([files[path]]))


def datastore(spark, tmp_path, pages, **config):
    with served([{"id": "x"}, {"id": 7, "datastore_active": True}], pages) as portal:
        return PortalSource(SourceConfig("set", "datastore", **config), portal.client).fetch(spark), portal


def test_config_and_registry():
    assert SourceConfig("a", "datastore").year_start == 2015 and SourceConfig("a", "datastore").year_column == "application_date"
    with pytest.raises(ValueError):
        SourceConfig("a", "ftp")
    assert list(SOURCES) == ["permits_active", "permits_cleared", "coa", "dev_applications"]
    assert all(isinstance(s, Source) for s in SOURCES.values())
    assert SOURCES["coa"].name == "committee-of-adjustment-applications"


def test_pages_until_an_empty_one(spark, tmp_path):
    df, client = datastore(spark, tmp_path, [[{"Application Date": "2021-03-04", "Permit No": "a"}], [{"Application Date": "2022-01-02", "Permit No": "b"}], []])
    assert sorted((r.permit_no, r.year, r.source_name) for r in df.collect()) == [("a", 2021, "set"), ("b", 2022, "set")]
    assert isinstance(df.schema["application_date"].dataType, T.DateType) and isinstance(df.schema["year"].dataType, T.IntegerType)
    assert {int(p["offset"]) for k, p in client.asked if "search" in k} >= {0, 32000, 64000}


def test_no_records_and_no_resource(spark, tmp_path):
    assert datastore(spark, tmp_path, [[]])[0].isEmpty()
    with pytest.raises(ValueError):
        with served([{"id": "x", "datastore_active": False}]) as portal:
            PortalSource(SourceConfig("set", "datastore"), portal.client).resource_id()


def test_year_window_keeps_rows_without_a_date(spark, tmp_path):
    df, _ = datastore(spark, tmp_path, [[{"Application Date": d, "k": d} for d in ("2019-01-01", "2021-01-01", None)]], year_start=2020)
    assert sorted(r.year for r in df.collect()) == [0, 2021]


def test_late_typed_and_custom_year_column(spark, tmp_path):
    rows = [{"Work Type": None, "Date Submitted": "2021-05-06", "APPLICATION#": str(k)} for k in range(100)] + [{"Work Type": "Sfd", "Date Submitted": "2022-05-06", "APPLICATION#": "z"}]
    df, _ = datastore(spark, tmp_path, [rows], year_column="date_submitted")
    assert df.where("work_type = 'Sfd' and year = 2022 and application = 'z'").count() == 1


def bulk(spark, tmp_path, files, **config):
    resources = [{"format": f.get("format", "CSV"), "name": f["name"], "url": f"/{k}"} for k, f in enumerate(files)]
    with served(resources, files={f"/{k}": f["data"].encode() for k, f in enumerate(files) if "data" in f}) as portal:
        return PortalSource(SourceConfig("set", "bulk_csv", **config), portal.client).fetch(spark)


def test_csv_selection_union_and_raggedness(spark, tmp_path):
    head = "Application Date,Permit No\n"
    df = bulk(spark, tmp_path, [
        {"name": "Permits 2019", "data": head + "2019-01-01,a\n"},
        {"name": "Permits 2020", "data": head + "2020-01-01,b\n"},
        {"name": "Permits 2021", "data": "Application Date,Permit No,Units\n2021-01-01,c,5\n2021-01-02,d,0.,extra\n"},
        {"name": "Permits 2021 xml", "format": "XML"}, {"name": "Metadata"},
    ], year_start=2020)
    assert sorted((r.permit_no, r.units) for r in df.collect()) == [("b", None), ("c", 5.0), ("d", 0.0)]


def test_csv_bad_date_and_colliding_names(spark, tmp_path):
    df = bulk(spark, tmp_path, [{"name": "p 2021", "data": "Application Date,Street Direction,STREET_DIRECTION\n01/15/2021,N,S\n"}])
    row = df.first()
    assert (row.year, row.street_direction, row.street_direction_2) == (0, "N", "S")


def test_snake_names():
    assert N.snake_names(["a", "A", "a_2", "_id", "APPLICATION#", "###"]) == ["a", "a_3", "a_2", "id", "application", ""]


@pytest.mark.parametrize(("values", "kind"), [(["2021-12-31", None], "date"), (["2021/12/31", "x"], "date"), (["31/12/2021", "2021-01-01"], "date"), (["2022-08-09T00:00:00"], "string"), ([None, None], "string")])
def test_date_families(spark, values, kind):
    df = N.parse_dates(spark.createDataFrame([Row(the_date=v) for v in values], "the_date string").coalesce(1))
    assert dict(df.dtypes)["the_date"] == kind and df.count() == len(values)


def test_types_that_conflict_become_text(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([("q",)], "x string")
    assert sorted(map(tuple, N.diagonal_union([a, b]).select("x", "y").collect()), key=str) == [("1", 2), ("q", None)]


def test_storage(spark, tmp_path):
    df = spark.createDataFrame([(2023, "a", "s"), (2023, "b", "s"), (2024, "c", "s")], "year int, permit_no string, source_name string")
    assert storage.row_count(spark, "p", str(tmp_path)) is None and storage.last_modified(spark, "p", str(tmp_path)) is None
    assert storage.write_source(df, "p", str(tmp_path)) == 3
    assert sorted(d.name for d in (tmp_path / "p").glob("year=*")) == ["year=2023", "year=2024"]
    assert storage.row_count(spark, "p", str(tmp_path)) == 3 and storage.last_modified(spark, "p", str(tmp_path)) is not None
    assert storage.write_source(df.where("year = 2024"), "p", str(tmp_path)) == 1
    assert [d.name for d in (tmp_path / "p").glob("year=*")] == ["year=2024"]
    assert storage.write_source(spark.createDataFrame([], T.StructType()), "p", str(tmp_path)) == 0
    assert not (tmp_path / "p").exists()


def test_stream_ingest(spark, tmp_path):
    from permitloom.streaming.ingest import stream_ingest

    raw = tmp_path / "raw"
    raw.mkdir()
    schema = T.StructType([T.StructField("Application Date", T.StringType()), T.StructField("Permit No", T.StringType())])

    def run():
        stream_ingest(spark, str(raw), schema, SourceConfig("set", "datastore", 2020), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return sorted((r.permit_no, r.year) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (raw / "1.json").write_text("\n".join(json.dumps({"Application Date": d, "Permit No": k}) for d, k in (("2021-01-01", "a"), ("2019-01-01", "b"), (None, "c"))))
    assert run() == [("a", 2021), ("c", 0)]
    (raw / "2.json").write_text(json.dumps({"Application Date": "2022-01-01", "Permit No": "d"}))
    assert run() == [("a", 2021), ("c", 0), ("d", 2022)]


def test_infer_types(spark):
    rows = [("1", "1.5", "x", None, "12D", "NaN", "true", "1e3", "007"), ("-2", "2.", "", None, "3F", "1", "False", ".5", "+8"), (None,) * 9]
    df = N.infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string, i string"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "string", "string", "string", "boolean", "double", "bigint"]
    assert [tuple(r) for r in df.select("b", "g", "h", "i").collect()] == [(1.5, True, 1000.0, 7), (2.0, False, 0.5, 8), (None, None, None, None)]


@pytest.mark.parametrize("odd", ["3F", "12D", "12f", "1d", "NaN", "Infinity", "-inf", "0x1p3", "1_000", " 5", "5 ", "", "1e", "."])
def test_no_numbers(spark, odd):
    from permitloom.functions.scalars import number

    df = spark.createDataFrame([(odd,), ("7",)], "v string")
    assert N.infer_types(df).dtypes == [("v", "string")] and [r[0] for r in df.select(number(F.col("v"))).collect()] == [None, 7.0]


def test_date_format_of_most_values(spark):
    """One odd cell, wherever it stands, doesn't decide for the column."""
    for values in (["2021-01-02", "31/12/2021", "30/11/2021"], ["31/12/2021", "2021-01-02", "30/11/2021"]):
        df = N.parse_dates(spark.createDataFrame([(v,) for v in values], "the_date string"))
        assert sorted(str(r[0]) for r in df.collect()) == ["2021-11-30", "2021-12-31", "None"]


def test_rows_keep_their_place(spark, tmp_path):
    """``source_row`` ascends with pages and rows, and with files and their rows, through the folders of the years."""
    pages = [[{"Application Date": f"{2020 + k % 2}-01-01", "source row": k, "k": p * 50 + k} for k in range(50)] for p in range(3)]
    df, _ = datastore(spark, tmp_path, pages)
    assert storage.write_source(df, "a", f"file://{tmp_path}") == 150
    back = storage.read_table(spark, f"file://{tmp_path}/a")
    assert "source_row" in back.columns and "source_row_" in back.columns  # a column of the source had the name
    assert [r.k for r in back.orderBy("source_row_").collect()] == list(range(150))
    head = "Application Date,k\n"
    df = bulk(spark, tmp_path, [{"name": f"p {2020 + y}", "data": head + "".join(f'{2022 - y}-02-03,"{y * 40 + k}"\n' for k in range(40))} for y in range(3)])
    assert storage.write_source(df, "b", f"file://{tmp_path}") == 120
    assert [r.k for r in storage.read_table(spark, f"file://{tmp_path}/b").orderBy("source_row").collect()] == list(range(120))
