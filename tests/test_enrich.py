"""Labels, geometry and assembly."""

import datetime
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from permitloom import config
from permitloom.functions import scalars as S
from permitloom.operators import spatial
from permitloom.plans import enrich
from permitloom.sources import layers

D = datetime.date


def test_feature_order():
    assert config.DEV_CAT_COLS == ["application_type", "ward_number", "zoning_class", "secondary_plan_name"]
    assert config.DEV_NUM_COLS == ["year_submitted", "in_heritage_register", "in_heritage_district", "in_secondary_plan", "has_community_meeting"]
    assert config.COA_CAT_COLS == ["application_type", "sub_type", "ward_number", "zoning_designation"] and config.COA_NUM_COLS == ["year_submitted"]


def test_coa_labels(spark):
    rows = [
        (4, D(2023, 5, 2), D(2023, 5, 30), "Conditional Approval"), (6, D(2020, 2, 28), D(2020, 3, 1), "withdrawn"), (7, D(2024, 12, 31), None, "Adjourned"),
        (8, D(2021, 7, 7), None, "approved on condition"), (1, D(2022, 1, 1), D(2021, 12, 30), " Approved\t "), (2, None, None, None),
    ]
    df = enrich.label_coa(spark.createDataFrame(rows, "ward bigint, in_date date, finaldate date, c_of_a_descision string"))
    got = {r.ward_number: (r.coa_approved, r.coa_days_to_approval, r.year_submitted) for r in df.collect()}
    assert got == {"4": (1, 28, 2023), "6": (0, None, 2020), "7": (None, None, 2024), "8": (1, None, 2021), "1": (1, -2, 2022), "2": (None, None, None)}
    assert dict(df.dtypes)["coa_approved"] == "tinyint"


@pytest.mark.parametrize(("status", "approved", "appeal"), [("Closed", 1, 0), ("Refused", 0, None), ("Under Review", None, None), ("OMB Approved", 1, 1), (" omb refused\n", 0, 1), ("OMB Appeal", None, 1), ("", None, None), (None, None, None)])
def test_dev_labels(spark, status, approved, appeal):
    r = enrich.label_dev(spark.createDataFrame([(status,)], "status string")).first()
    assert (r.dev_approved, r.dev_no_appeal) == (approved, appeal)


def test_year_of_text(spark):
    df = spark.createDataFrame([("2021-03-04",), ("n/a",), (None,)], "d string")
    assert [r.year_submitted for r in enrich.year_submitted(df, "d").collect()] == [2021, None, None]


def test_grid_coordinates(spark):
    rows = [("630000", "4840000"), (None, "4840000"), ("630000", None), ("abc", "4840000"), ("630000", "3999999.9"), ("630000", "4000000")]
    lon, lat = S.grid_to_lonlat(S.number(F.col("x")), S.number(F.col("y")))
    got = spark.createDataFrame(rows, "x string, y string").select(lon, lat).collect()
    assert got[0][0] == pytest.approx(-79.3866021, abs=1e-7) and got[0][1] == pytest.approx(43.7016375, abs=1e-7)
    assert [r[0] is None for r in got] == [False, True, True, True, True, False]


HOLED = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}
PARTS = {"type": "MultiPolygon", "coordinates": [[[[3, 3], [6, 3], [6, 6], [3, 6], [3, 3]]], [[[8, 8], [9, 8], [9, 9], [8, 9], [8, 8]]]]}


def test_polygons(spark):
    polygons, _ = spatial.parse_geojson(F.col("g"))
    layer = spark.createDataFrame([("z", json.dumps(HOLED)), ("p", json.dumps(PARTS)), ("none", None), ("bad", "{}")], "name string, g string").select("name", spatial.edges_of(polygons).alias("edges"))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 1.0), (4, 3.5, 3.5), (5, 8.5, 8.5), (6, None, 1.0), (7, 0.0, 2.0), (8, 1.0, 1.5), (9, 4.0, 4.0), (10, 2.0, 0.0), (11, 8.0, 8.0)], "rid int, lon double, lat double")
    for cell in (0.3, 1.0, 50.0):
        assert sorted(map(tuple, spatial.within(points, layer, "name", cell=cell).collect())) == [(1, "z"), (4, "p"), (5, "p"), (9, "p")]  # a point on an edge is not inside


def by_ray(x, y, edges):
    """Even-odd by the definition; a point on an edge is not inside."""
    crossed = 0
    for x1, y1, x2, y2 in edges:
        if min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) and (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1):
            return False
        crossed += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return crossed % 2 == 1


def layer_of(spark, polygons):
    rows = [(name, [tuple(map(float, e)) for e in edges]) for name, edges in polygons]
    return spark.createDataFrame(rows, "name string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def ring(points):
    return [(*a, *b) for a, b in zip(points, [*points[1:], points[0]], strict=True)]


def test_covers_of_random_polygons(spark):
    """Stars with holes, points on cells' borders, corners and edges."""
    rng = random.Random(4)
    star = lambda x, y, r, n: ring([(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)])
    polygons = [(f"p{k}", star(rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.05, 0.9), n) + star(0, 0, 0.1, 5)) for k, n in enumerate([3, 7, 40, 300])]
    polygons.append(("square", ring([(-0.64, -0.64), (0.64, -0.64), (0.64, 0.64), (-0.64, 0.64)])))
    points = [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(300)] + [(a * 0.08, b * 0.04) for a in range(-9, 10) for b in range(-17, 18)] + [p[:2] for _, e in polygons for p in e[:20]]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "rid int, lon double, lat double")
    want = {}
    for k, (x, y) in enumerate(points):
        if names := [name for name, edges in polygons if by_ray(x, y, edges)]:
            want[k] = min(names)
    for cell in (0.32, 0.05, 7.0):
        assert {r.rid: r.name for r in spatial.within(df, layer_of(spark, polygons), "name", cell=cell).collect()} == want and len(want) > 200


def test_few_edges_are_tested(spark):
    """On a polygon of 10,000 edges, at least five times fewer than by a fixed grid of 0.01 degrees."""
    n = 10_000
    edges = ring([((0.1 + 0.003 * math.sin(k / 9)) * math.cos(2 * math.pi * k / n), (0.1 + 0.003 * math.sin(k / 9)) * math.sin(2 * math.pi * k / n)) for k in range(n)])
    rng = random.Random(3)
    points = [(rng.uniform(-0.12, 0.12), rng.uniform(-0.12, 0.12)) for _ in range(2000)]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "rid int, lon double, lat double")
    layer = layer_of(spark, [("p", edges)])
    tested = spatial.candidates(df, spatial.cover(layer, "name"), "rid", spatial.CELL).agg(F.sum(F.coalesce(F.size("edges"), F.lit(0)))).first()[0]
    rows = {}
    for _, y1, _, y2 in edges:
        for cy in range(math.floor(min(y1, y2) / 0.01), math.floor(max(y1, y2) / 0.01) + 1):
            rows[cy] = rows.get(cy, 0) + 1
    low, high = min(e[0] for e in edges), max(e[0] for e in edges)
    before = sum(rows.get(math.floor(y / 0.01), 0) for x, y in points if low <= x <= high)
    assert 0 < tested * 5 <= before
    assert {r.rid for r in spatial.within(df, layer, "name").collect()} == {k for k, (x, y) in enumerate(points) if by_ray(x, y, edges)}


def test_near_across_cells(spark):
    r = 0.0002
    layer = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "lon double, lat double")
    points = spark.createDataFrame([(k, d * math.cos(k), d * math.sin(k)) for k, d in enumerate([0.00019, 0.00019999, 0.00021, 0.0] * 6)] + [(99, None, 0.0)], "rid int, lon double, lat double")
    got = {x.rid for x in spatial.near(points, layer, r).collect()}
    assert got == {k for k in range(24) if k % 4 != 2}


def shp(records) -> bytes:
    body = b""
    for k, (kind, data) in enumerate(records, 1):
        content = struct.pack("<i", kind) + data
        body += struct.pack(">2i", k, len(content) // 2) + content
    return bytes(100) + body


def test_assembly_from_layers(spark, tmp_path):
    ref = tmp_path / "reference"
    for d in ("heritage_register", "heritage_districts"):
        (ref / d).mkdir(parents=True)
    lon, lat = -79.3866021, 43.7016375
    square = lambda d: [[lon - d, lat - d], [lon + d, lat - d], [lon + d, lat + d], [lon - d, lat + d], [lon - d, lat - d]]
    geometry = json.dumps({"type": "Polygon", "coordinates": [square(0.01)]}).replace('"', '""')
    (ref / "zoning.csv").write_text(f'_id,ZN_ZONE,geometry\n1,RD,"{geometry}"\n')
    (ref / "heritage_register" / "a.shp").write_bytes(shp([(1, struct.pack("<2d", lon + 0.0001, lat))]))
    flat = [v for p in square(0.005) for v in p]
    (ref / "heritage_districts" / "b.shp").write_bytes(shp([(5, struct.pack("<4d2i1i", 0, 0, 0, 0, 1, 5, 0) + struct.pack("<10d", *flat))]))
    (ref / "secondary_plans.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"SECONDARY_PLAN_NAME": "Plan", "N": 3}, "geometry": {"type": "Polygon", "coordinates": [square(0.02)]}}]}))
    rows = [(D(2021, 5, 6), "Closed", "x", "1", "2021-07-01", "630000.0", "4840000.0"), (D(2021, 6, 7), "Refused", "x", "2", None, "650000.0", "4841000.0"), (D(2022, 1, 1), "Under Review", "x", "3", "", None, None)]
    spark.createDataFrame(rows, "date_submitted date, status string, application_type string, ward_number string, community_meeting_date string, x string, y string").withColumn("year", F.year("date_submitted")).write.partitionBy("year").parquet(f"{tmp_path}/dev_applications")
    assert enrich.enrich_dev(spark, str(tmp_path)) == 3
    got = {r.ward_number: r for r in spark.read.parquet(f"{tmp_path}/enriched/dev_applications.parquet").collect()}
    pick = lambda r: (r.zoning_class, r.in_heritage_register, r.in_heritage_district, r.secondary_plan_name, r.in_secondary_plan, r.has_community_meeting, r.dev_approved, r.year_submitted)
    assert pick(got["1"]) == ("RD", 1, 1, "Plan", 1, 1, 1, 2021)
    assert pick(got["2"]) == (None, 0, 0, None, 0, 0, 0, 2021)
    assert pick(got["3"]) == (None, 0, 0, None, 0, 1, None, 2022)


def test_layers_are_fetched_once(spark, tmp_path):
    import io
    import zipfile

    asked = []

    class Client:
        def stream(self, url):
            asked.append(url)
            if url.endswith(".zip"):
                with zipfile.ZipFile(buf := io.BytesIO(), "w") as z:
                    z.writestr("a.shp", bytes(100))
                return iter([buf.getvalue()])
            return iter([b"id,geom", b"etry\n1,{}"])

    for _ in range(2):
        layers.fetch_layers(spark, f"file://{tmp_path}/new", Client())
    assert len(asked) == 4 and (tmp_path / "new" / "heritage_register" / "a.shp").exists() and not list((tmp_path / "new").glob("*.part"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [0, spatial.SMALL])
def test_points_are_never_broadcast(spark, tmp_path, monkeypatch, small):
    """Levels multiply the points after the optimizer has judged their size by the file's."""
    monkeypatch.setattr(spatial, "SMALL", small)
    path = str(tmp_path / "points")
    spark.range(3000).select(F.col("id").alias("rid"), (F.col("id") % 61 / 10).alias("lon"), (F.col("id") % 59 / 10).alias("lat")).write.parquet(path)
    points, square = spark.read.parquet(path), [[0.5, 0.5], [4.5, 0.5], [4.5, 4.5], [0.5, 4.5], [0.5, 0.5]]
    edges = [(*a, *b) for a, b in zip(square[:-1], square[1:], strict=True)]
    layer = spark.createDataFrame([("a", edges)], "name string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    found = spatial.within(points, layer, "name", cell=1.0)
    assert "BuildLeft" not in plan_of(found) and ("BroadcastHashJoin" in plan_of(found)) == (small > 0)
    assert {r.rid for r in found.collect()} == {k for k in range(3000) if 0.5 < k % 61 / 10 < 4.5 and 0.5 < k % 59 / 10 < 4.5}
    near = spatial.near(points, points, 0.05)
    assert "Broadcast" not in plan_of(near) and near.count() == 3000
    out = enrich.spatial_attributes(points.withColumnRenamed("rid", "_rid"), layer.withColumnRenamed("name", "zoning_class"), points, layer, layer.withColumnRenamed("name", "secondary_plan_name"))
    joins = plan_of(out).split("SortMergeJoin [_rid")
    assert len(joins) == 5 and out.count() == 3000
