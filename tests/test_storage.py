"""The versioned table swap, with faults between its steps, and shapefiles by ranges."""

import struct
import threading

import pytest
from pyspark.sql import functions as F

from permitloom.operators import storage
from permitloom.sources import layers, shapes


def rows(spark, path):
    return sorted(map(tuple, storage.read_table(spark, path).select("k", "year").collect()))


def df(spark, years):
    return spark.createDataFrame([(f"{y}{k}", y) for y in years for k in range(3)], "k string, year int")


def want(years):
    return sorted((f"{y}{k}", y) for y in years for k in range(3))


@pytest.mark.parametrize("partition", ["year", None])
def test_a_fault_between_any_two_steps_leaves_a_readable_table(spark, tmp_path, monkeypatch, partition):
    """The old rows until the commit, the new ones after it, and the next writer clears what was left."""
    steps = ["observe", "_make_folder", "move", "_commit", "_clean"]
    whole = {s: getattr(storage, s, None) for s in steps}
    for at, fault in enumerate(steps):
        for late in (False, True):
            path = f"file://{tmp_path}/{fault}{late}"
            assert storage.replace(df(spark, [2020, 2021]), path, partition) == 6
            calls = []

            def broken(*a, fault=fault, late=late, calls=calls):
                calls.append(a)
                if len(calls) > late:
                    raise OSError("stopped here")
                return whole[fault](*a)

            with monkeypatch.context() as m:
                if fault == "observe":
                    m.setattr(type(spark.range(1)), "observe", lambda *a: (_ for _ in ()).throw(OSError("stopped here")))
                else:
                    m.setattr(storage, fault, broken)
                try:
                    storage.replace(df(spark, [2021, 2022]), path, partition)
                    stopped = False
                except OSError:
                    stopped = True
            assert stopped or late
            committed = not stopped or at > steps.index("_commit")
            assert rows(spark, path) == want([2021, 2022] if committed else [2020, 2021]), (fault, late)
            assert storage.row_count(spark, path.rpartition("/")[2], path.rpartition("/")[0]) == 6
            assert storage.replace(df(spark, [2023]), path, partition) == 3 and rows(spark, path) == want([2023])
            assert sorted(map(tuple, spark.read.parquet(path).select("k", "year").collect())) == want([2023])  # nothing else is left
            assert not list((tmp_path / f"{fault}{late}").glob("_writing*"))


def test_rename_that_answers_false(spark, monkeypatch):
    class Silent:
        def rename(self, a, b):
            return False

    monkeypatch.setattr(storage, "_fs", lambda spark, path: (Silent(), path))
    with pytest.raises(OSError, match="could not be renamed"):
        storage.move(spark, "a", "b")


def test_one_of_two_writers_commits(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    storage.replace(df(spark, [2020]), path, "year")
    commit = storage._commit

    def meanwhile(*a):
        monkeypatch.setattr(storage, "_commit", commit)
        storage.replace(df(spark, [2021]), path, "year")
        commit(*a)

    monkeypatch.setattr(storage, "_commit", meanwhile)
    with pytest.raises(FileExistsError):
        storage.replace(df(spark, [2022]), path, "year")
    assert rows(spark, path) == want([2021])


def test_readers_see_one_generation(spark, tmp_path):
    """While a table is replaced again and again, a reader sees whole generations only."""
    path, seen, stop = f"file://{tmp_path}/t", [], threading.Event()
    storage.replace(df(spark, [2000]), path, "year")

    def look():
        while not stop.is_set():
            try:
                seen.append(tuple(rows(spark, path)))
            except Exception as why:  # files that went before they were read fail the read
                assert "FILE_NOT_EXIST" in str(why) or "does not exist" in str(why) or "PATH_NOT_FOUND" in str(why)

    reader = threading.Thread(target=look)
    reader.start()
    for y in range(2001, 2006):
        storage.replace(df(spark, [y, y + 50]), path, "year")
    stop.set()
    reader.join()
    assert seen and set(seen) <= {tuple(want([2000])), *(tuple(want([y, y + 50])) for y in range(2001, 2006))}


def test_one_job_counts_and_writes(spark, tmp_path):
    """The rows are not read a second time."""
    reads = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    noted = df(spark, [2020, 2021]).coalesce(1).mapInArrow(note, "k string, year int")
    assert storage.replace(noted, f"file://{tmp_path}/t") == 6 and reads.value == 6
    assert storage.replace(noted.limit(0), f"file://{tmp_path}/t", "year") == 0 and rows(spark, f"file://{tmp_path}/t") == []
    assert storage.last_modified(spark, "t", f"file://{tmp_path}") is None


def written_shapes(folder, records, index=True, order=None):
    body, at, places = b"", 50, []
    for k, (kind, data) in enumerate(records, 1):
        words = (len(data) + 4) // 2
        body += struct.pack(">2i", k, words) + struct.pack("<i", kind) + data
        places.append((at, words))
        at += words + 4
    folder.mkdir()
    (folder / "l.shp").write_bytes(bytes(100) + body)
    if index:
        (folder / "l.shx").write_bytes(bytes(100) + b"".join(struct.pack(">2i", *places[k]) for k in order or range(len(places))))
    return f"file://{folder}"


def read(spark, folder, **options):
    spark.dataSource.register(shapes.Shapefile)
    return spark.read.format("shapes").options(**options).load(f"{folder}/l.shp")


def polygon(*rings):
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    flat = [v for r in rings for p in r for v in p]
    return (5, struct.pack("<4d2i", 0, 0, 1, 1, len(rings), len(flat) // 2) + struct.pack(f"<{len(rings)}i", *starts) + struct.pack(f"<{len(flat)}d", *flat))


def test_shapes_of_all_kinds(spark, tmp_path):
    square, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (1.0, 1.0)]
    records = [(1, struct.pack("<2d", 1.5, 2.5)), polygon(square, hole), (0, b""), (11, struct.pack("<4d", 7, 8, 9, 9)), polygon(square), (8, bytes(40))]
    for name, options in (("a", {}), ("b", {"index": False}), ("c", {"order": [4, 0, 2, 1, 5, 3]})):
        folder = written_shapes(tmp_path / name, records, **options)
        for per in (1, 2, 100):
            got = [(r.lon, r.lat, r.polygons) for r in read(spark, folder, records=per).collect()]
            lists = lambda r: [[list(p) for p in x] for x in r]
            want = [(1.5, 2.5, None), (None, None, [lists([square, hole])]), (None, None, None), (7.0, 8.0, None), (None, None, [lists([square])]), (None, None, None)]
            assert sorted(got, key=str) == sorted(want, key=str)
    assert layers.shapefile(spark, f"file://{tmp_path}/a").where("size(edges) > 0").count() == 2
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        layers.shapefile(spark, f"file://{tmp_path}/none")


def test_many_records_are_several_tasks(spark, tmp_path, monkeypatch):
    """A hundred thousand points in at least four tasks, each of which reads its part; the same rows as one after another."""
    n = 100_000
    folder = written_shapes(tmp_path / "a", [(1, struct.pack("<2d", k / 7, k % 100)) for k in range(n)])
    df = read(spark, folder)
    tasks = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 4 and sum(t["count"] for t in tasks) == n
    points = sorted(map(tuple, df.select("lon", "lat").collect()))
    assert points == sorted((k / 7, float(k % 100)) for k in range(n))
    (tmp_path / "a" / "l.shx").unlink()
    monkeypatch.setattr(shapes, "STEP", 1000)  # for the reader in this process
    reader = shapes.ShapeReader(f"{folder}/l.shp", 10)
    assert [(p.first, p.last) for p in reader.partitions()] == [(0, -1)]
    batches = [b.to_pydict() for b in reader.read(reader.partitions()[0])]
    assert len(batches) > 1000 and sorted((x, y) for b in batches for x, y in zip(b["lon"], b["lat"], strict=True)) == points
