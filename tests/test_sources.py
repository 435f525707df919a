"""Sources over HTTP and by byte ranges."""

import random
import urllib.error

import pytest
from pyspark.errors import PySparkException

from permitloom.sources import csv_ranges
from permitloom.sources.base import HttpClient
from permitloom.sources.paged import PagedRecords
from permitloom.sources.served import LocalPortal


def present_reader(spark, path):
    """Spark's own reader, which makes one task of any file."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", True).csv(path)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def field(r):
    plain = "".join(r.choice("ab é") for _ in range(r.randint(0, 6)))
    inner = "".join(r.choice(['""', "\n", "\r\n", ",", "x", "y z"]) for _ in range(r.randint(0, 9)))
    return r.choice([plain, f'"{inner}"', f'"{inner}"', f'{plain}5"', '""'])


def same(spark, path):
    mine, theirs = csv_ranges.read_csv(spark, path), present_reader(spark, path)
    assert mine.columns == theirs.columns
    return sorted(map(tuple, mine.collect()), key=str), sorted(map(tuple, theirs.collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_anywhere(spark, tmp_path, small_ranges, seed):
    """Embedded newlines, escaped quotes and stray ones across the cuts of ranges."""
    r = random.Random(seed)
    rows = [",".join([str(k), field(r), field(r), *(["more"] if r.random() < 0.1 else [])][: r.choice([2, 3, 3, 3, 4])]) for k in range(120)]
    text = '\n'.join(['id,"a ""name""\nof two lines",b', *rows, ""])
    (tmp_path / "a.csv").write_bytes(text.encode())
    path = str(tmp_path / "a.csv")
    assert csv_ranges.lines_of(spark, path).select("start").distinct().count() >= 4
    mine, theirs = same(spark, path)
    assert mine == theirs and len(mine) == 120


def test_a_field_over_whole_ranges(spark, tmp_path, small_ranges):
    long = "line \"\"x\"\",\n" * 200
    (tmp_path / "a.csv").write_text(f'a,b\n1,"{long}"\r\n2,z\n\n3,"{long}\n"')
    mine, theirs = same(spark, str(tmp_path / "a.csv"))
    assert mine == theirs and [len(r[1]) for r in mine] == [2000, 1, 2001]


def test_odd_files(spark, tmp_path):
    for name, text in {"empty": "", "head": "a,b\n", "crlf": "a,b\r\n1,\"x\r\ny\"\r\n,\"\"\r\n", "open": 'a,b\n1,"never ended\n2,3', "names": "a,,a,A\n1,2,3,4\n", "one": "a"}.items():
        (tmp_path / name).write_bytes(text.encode())
        spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            mine, theirs = same(spark, str(tmp_path / name))
        finally:
            spark.conf.unset("spark.sql.caseSensitive")
        assert mine == theirs, name
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"{k}.csv").write_text(f'a,b\n{k},"x\n{k}"\n')
    mine, theirs = same(spark, str(tmp_path / "many"))
    assert mine == theirs == [(str(k), f"x\n{k}") for k in range(3)]
    (tmp_path / "bytes").write_bytes(b'a\n"\xff\nx"\n')
    assert [r.a for r in csv_ranges.read_csv(spark, str(tmp_path / "bytes")).collect()] == ["�\nx"]


def portal(n, total, page=10, **more):
    return LocalPortal([], lambda offset, limit: [f'{{"k": {k}}}' for k in range(offset, min(n, offset + limit))], total, **more)


def read(spark, server, page=10, **options):
    spark.dataSource.register(PagedRecords)
    return spark.read.format("portal_records").options(**server.client.options(), resource="r", page=page, readers=3).options(**options).load()


@pytest.mark.parametrize("total", [True, False])
@pytest.mark.parametrize("n", [0, 7, 10, 35, 60])
def test_pages_are_read_by_executors(spark, total, n):
    with portal(n, n if total else None) as server:
        rows = read(spark, server).collect()
        assert sorted((r.page * 10 + r["at"], r.record) for r in rows) == [(k, f'{{"k": {k}}}') for k in range(n)]
        asked = [int(a["offset"]) for _, a in server.asked if int(a["limit"])]
        # Each page once, and an empty one at the end, or one for each reader.
        assert sorted(asked) == [k * 10 for k in range(-(-n // 10) + (1 if total else 3) - (0 if n % 10 == 0 or not total else 1) + (1 if total and n % 10 else 0))]
        assert read(spark, server).rdd.getNumPartitions() == (n // 10 + 1 if total else 3)


def test_records_that_came_meanwhile(spark):
    with portal(47, 30) as server:
        assert read(spark, server).count() == 47


def test_failures_are_tried_again_and_then_raised(spark):
    failed = []

    def once(path, ask):
        if ask["offset"] == "20" and len(failed) < 2:
            failed.append(1)
            return 503

    with portal(35, 35, before=once) as server:
        assert read(spark, server).count() == 35 and len(failed) == 2
    with portal(35, 35, before=lambda path, ask: 500 if ask["offset"] == "20" else None) as server:
        with pytest.raises(PySparkException, match="500"):
            read(spark, server).count()
        assert sum(a["offset"] == "20" for _, a in server.asked) == 3  # the first time, and two more
    with portal(35, 35, before=lambda path, ask: 404) as server:
        with pytest.raises(PySparkException, match="404"):
            read(spark, server).count()
        assert len(server.asked) == 1


def test_files_come_in_parts(monkeypatch):
    from permitloom.sources import base

    monkeypatch.setattr(base, "CHUNK", 4)
    with LocalPortal([], files=lambda path: iter([b"0123", b"456789"])) as server:
        assert [*server.client.stream("/f")] == [b"0123", b"4567", b"89"]
    with LocalPortal([], before=lambda path, ask: 403) as server, pytest.raises(urllib.error.HTTPError):
        [*server.client.stream("/f")]
    with pytest.raises(urllib.error.URLError):
        HttpClient("http://127.0.0.1:9", retries=1, wait=0.01).get_json("/x", {})
