"""The operators on the driver's tables, and the same in SQL.

The driver's tables hold no permits, so each operator meets an analogue of its input.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permitloom.config import ModelSpec, SourceConfig
from permitloom.functions import scalars as S
from permitloom.operators import ml, normalize, spatial
from permitloom.operators.boosting import Boosted, Tree
from permitloom.operators.files import StoredFile
from permitloom.operators.scratch import forget, scratch
from permitloom.operators.storage import SOURCE_ROW, exists, files_below, last_modified, read_table, replace, row_count, write_source
from permitloom.plans import enrich, models
from permitloom.sources import layers
from permitloom.sources.csv_ranges import read_csv
from permitloom.sources.portal import PortalSource
from permitloom.sources.served import LocalPortal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT l_linestatus, count(*) AS n_items,
    sum(CASE WHEN o_orderstatus IN ('F') THEN 1 ELSE 0 END)::BIGINT AS n_approved,
    avg(CASE WHEN o_orderstatus IN ('F') THEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) END) AS avg_days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_linestatus""")
def approval_report(spark, sf_dir):
    """Outcome label, conditional days and a report over them: the flagship."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    flag = S.label(F.col("o_orderstatus"), (["f"], 1), (["o"], 0))
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).withColumn("approved", flag)
    joined = joined.withColumn("days", S.days_if(F.col("approved"), F.col("o_orderdate"), F.col("l_shipdate")))
    return joined.groupBy("l_linestatus").agg(F.count("*").alias("n_items"), F.sum(F.when(F.col("approved") == 1, 1).otherwise(0)).alias("n_approved"), F.avg("days").alias("avg_days"))


@query("""SELECT o_orderkey, (CASE lower(trim(o_orderstatus)) WHEN 'f' THEN 1 WHEN 'o' THEN 0 END)::TINYINT AS approved FROM orders""")
def label_map(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.label(F.col("o_orderstatus"), (["f"], 1), (["o"], 0)).alias("approved"))


@query("""SELECT o_orderkey,
    (CASE WHEN lower(trim(o_orderpriority)) IN ('1-urgent', '2-high') THEN 1 WHEN lower(trim(o_orderpriority)) IN ('5-low') THEN 0 END)::TINYINT AS approved,
    (CASE WHEN lower(trim(o_orderpriority)) IN ('2-high', '3-medium') THEN 1 WHEN lower(trim(o_orderpriority)) IN ('1-urgent') THEN 0 END)::TINYINT AS appealed FROM orders""")
def label_map_multi_set(spark, sf_dir):
    c = F.col("o_orderpriority")
    both = S.appeal_label(c, ["2-high", "3-medium"], ["1-urgent", "2-high"])
    return table(spark, sf_dir, "orders").select("o_orderkey", S.label(c, (["1-urgent", "2-high"], 1), (["5-low"], 0)).alias("approved"), both.alias("appealed"))


@query("""SELECT p_partkey, lower(trim(p_type)) AS folded FROM part""")
def strip_and_fold(spark, sf_dir):
    padded = F.concat(F.lit("\t  "), F.col("p_type"), F.lit(" \n"))
    return table(spark, sf_dir, "part").select("p_partkey", S.folded(padded).alias("folded"))


@query("""SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def days_between(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", S.days_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("days"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT END AS days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def conditional_days(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = S.label(F.col("l_linestatus"), (["f"], 1))
    return j.select("l_orderkey", "l_linenumber", S.days_if(flag, F.col("o_orderdate"), F.col("l_shipdate")).alias("days"))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) >= 1998""")
def year_window_filter(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", S.year_or_zero(F.col("o_orderdate")).alias("year"))
    return normalize.year_window(df, 1998)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS order_date,
    CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE year(o_orderdate) END::INT AS year FROM orders""")
def year_zero_fill(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("no date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.try_to_date(text, "yyyy-MM-dd").alias("order_date"))
    return normalize.add_year(df, "order_date")


@query("""SELECT o_orderkey, o_orderdate::DATE AS order_date, strftime(o_orderdate, '%m|%Y') AS other_date, year(o_orderdate)::INT AS year FROM orders""")
def date_sniffing(spark, sf_dir):
    """Each date column in its own format; the one in no known format stays text."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"), F.date_format("o_orderdate", "MM|yyyy").alias("other_date"))
    return normalize.add_year(normalize.parse_dates(df), "order_date")


@query("""SELECT event_id, TRY_CAST(substr(CAST(ts AS VARCHAR), 1, 4) AS INT) AS year_submitted, TRY_CAST(substr(event_type, 1, 4) AS INT) AS no_year FROM events""")
def year_from_string(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.leading_year(F.col("ts").cast("string")).alias("year_submitted"), S.leading_year(F.col("event_type")).alias("no_year"))


@query("""SELECT c_custkey AS customer_key, c_name AS name, c_acctbal AS name_2, c_mktsegment AS market_segment, 0::INT AS year, 'customers' AS source_name FROM customer""")
def normalize_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").toDF("Customer Key#", "NAME", "_Name", "Market--Segment ")
    return normalize.normalize(raw, SourceConfig("customers", "datastore"))


@query("""SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance, c_nationkey::VARCHAR AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal, 'n' || s_nationkey FROM supplier""")
def diagonal_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("nation"))
    return normalize.diagonal_union([a, b])


@query("""SELECT p_partkey, p_size::BIGINT AS size, p_retailprice AS price, p_brand AS brand, p_size || CASE WHEN p_partkey % 2 = 0 THEN 'D' ELSE 'F' END AS unit,
    CASE WHEN p_partkey % 3 = 0 THEN 'NaN' ELSE '1' END AS odd, p_size > 20 AS large FROM part""")
def infer_types(spark, sf_dir):
    """All-text columns, as a CSV gives them, become numbers or booleans where every value is one; 12D, 3F and NaN are none."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    unit, odd = F.concat(size, F.when(key % 2 == 0, "D").otherwise("F")).alias("unit"), F.when(key % 3 == 0, "NaN").otherwise("1").alias("odd")
    large = F.when(F.col("p_size") > 20, "True").otherwise("false").alias("large")
    raw = table(spark, sf_dir, "part").select("p_partkey", size.alias("size"), F.col("p_retailprice").cast("string").alias("price"), F.col("p_brand").alias("brand"), unit, odd, large)
    return normalize.infer_types(raw)


@query("""SELECT year(o_orderdate)::INT AS year, count(*) AS n_rows, sum(o_orderkey)::BIGINT AS sum_keys FROM orders GROUP BY 1""")
def partitioned_roundtrip(spark, sf_dir):
    """Write by year, read back with the partition column, count per year."""
    path = scratch(spark, "roundtrip")
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    replace(df.hint("rebalance", F.col("year")), path, "year")
    return read_table(spark, path).groupBy("year").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("sum_keys"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1998""")
def partition_pruning(spark, sf_dir):
    """A year's rows from year folders: only that folder is listed and read."""
    path = scratch(spark, "pruning")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    replace(df.hint("rebalance", F.col("year")), path, "year")
    return read_table(spark, path).where("year = 1998").drop("year")


@query("""SELECT c_custkey, (CASE WHEN n IS NULL THEN 0 ELSE 1 END)::TINYINT AS has_orders FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def notnull_flag(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", S.present_flag(F.col("n")).alias("has_orders"))


@query("""SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders, CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END AS in_orders FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def coalesce_flag(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.when(F.col("n").isNotNull(), 1).otherwise(0).alias("in_orders"))


@query("""SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts, event_id""")
def distinct_on(spark, sf_dir):
    """The first event of each user, by a minimum that combines before the shuffle."""
    first = F.min(F.struct("ts", "event_id", "event_type")).alias("f")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(first).select("user_id", "f.event_id", "f.event_type")


@query("""SELECT c_custkey, n_name, coalesce(n_orders, 0)::BIGINT AS n_orders, coalesce(n_open, 0)::BIGINT AS n_open, last_date FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey AS k1, count(*) AS n_orders FROM orders GROUP BY 1) ON c_custkey = k1
    LEFT JOIN (SELECT o_custkey AS k2, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = k2
    LEFT JOIN (SELECT o_custkey AS k3, max(o_orderdate)::DATE AS last_date FROM orders GROUP BY 1) ON c_custkey = k3""")
def left_join_assemble(spark, sf_dir):
    """Each customer once with lookups from four sides; those that share a key share one aggregation."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.max("o_orderdate").cast("date").alias("last_date"))
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_open", F.lit(0)).alias("n_open"), "last_date")


def _lonlat_ctes(of: str, key: str, name: str) -> str:
    """CTEs that end with ``name``: k, lon, lat of each row of a table with a key."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    b = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    d = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    north = " - ".join(["xi", *(f"{b[k]:.17e} * sin({2 * k + 2}e0 * xi) * cosh({2 * k + 2}e0 * eta)" for k in range(3))])
    east = " - ".join(["eta", *(f"{b[k]:.17e} * cos({2 * k + 2}e0 * xi) * sinh({2 * k + 2}e0 * eta)" for k in range(3))])
    lat = " + ".join(["chi", *(f"{d[k]:.17e} * sin({2 * k + 2}e0 * chi)" for k in range(3))])
    return f"""{name}_g AS (SELECT k, TRY_CAST(x AS DOUBLE) AS x, TRY_CAST(y AS DOUBLE) AS y FROM (
      SELECT {key} AS k, CASE WHEN {key} % 11 = 0 THEN 'abc' WHEN {key} % 13 = 0 THEN NULL ELSE (600000 + {key} % 60000)::VARCHAR END AS x,
        CASE WHEN {key} % 17 = 0 THEN '3999999' ELSE (4830000 + ({key} * 7) % 30000)::VARCHAR END AS y FROM {of})),
    {name}_s AS (SELECT k, y / {a:.17e} AS xi, (x - 5e5) / {a:.17e} AS eta FROM {name}_g WHERE x IS NOT NULL AND y >= 4e6),
    {name}_t AS (SELECT k, {north} AS n, {east} AS e FROM {name}_s),
    {name}_u AS (SELECT k, asin(sin(n) / cosh(e)) AS chi, -81e0 + degrees(atan2(sinh(e), cos(n))) AS lon FROM {name}_t),
    {name} AS (SELECT {name}_g.k, lon, degrees({lat}) AS lat FROM {name}_g LEFT JOIN {name}_u USING (k))"""


def _grid_text(k):
    """x and y of a key as a dataset may have them: text, some of it odd or missing."""
    x = F.when(k % 11 == 0, F.lit("abc")).when(k % 13 == 0, F.lit(None)).when(k % 19 == 0, F.concat((600000 + k % 60000).cast("string"), F.lit(".0"))).otherwise((600000 + k % 60000).cast("string"))
    return x, F.when(k % 17 == 0, F.lit("3999999")).otherwise((4830000 + (k * 7) % 30000).cast("string"))


@query(f"WITH {_lonlat_ctes('customer', 'c_custkey', 'p')} SELECT k AS c_custkey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p")
def utm_to_lonlat(spark, sf_dir):
    lon, lat = S.grid_to_lonlat(*map(S.number, _grid_text(F.col("c_custkey"))))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_ZONES = {
    "b": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]},
    "a": {"type": "Polygon", "coordinates": [[[3, 3], [7, 2.5], [6.5, 7], [3, 3]]]},
    "m": {"type": "MultiPolygon", "coordinates": [[[[8, 0], [9, 0], [9, 1], [8, 1], [8, 0]]], [[[8, 8], [9.5, 8], [9.5, 9.5], [8, 9.5], [8, 8]]]]},
}


def _edges(zones: dict) -> str:
    rows = []
    for name, g in zones.items():
        for polygon in [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]:
            for ring in polygon:
                rows += [f"('{name}', {x1}e0, {y1}e0, {x2}e0, {y2}e0)" for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True)]
    return ", ".join(rows)


#: A point is in a zone if a ray to the right crosses an odd number of its edges, and none of them holds it.
_INSIDE = """HAVING count_if((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / CASE WHEN y2 = y1 THEN 1e0 ELSE y2 - y1 END + x1) % 2 = 1
      AND NOT bool_or(lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) AND (x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1))"""


@query(f"""WITH p AS (SELECT p_partkey, ((p_partkey * 37) % 1009) / 1009e0 * 10e0 AS lon, ((p_partkey * 101) % 997) / 997e0 * 10e0 AS lat FROM part),
    e(zone, x1, y1, x2, y2) AS (VALUES {_edges(_ZONES)}),
    h AS (SELECT p_partkey, zone FROM p, e GROUP BY ALL {_INSIDE})
    SELECT p.p_partkey, min(zone) AS zone FROM p LEFT JOIN h ON p.p_partkey = h.p_partkey GROUP BY p.p_partkey""")
def point_in_polygon(spark, sf_dir):
    """GeoJSON polygons with a hole and parts; points in several get the smallest name."""
    k = F.col("p_partkey")
    points = table(spark, sf_dir, "part").select(k.alias("rid"), ((k * 37) % 1009 / F.lit(1009.0) * 10).alias("lon"), ((k * 101) % 997 / F.lit(997.0) * 10).alias("lat"))
    polygons, _ = spatial.parse_geojson(F.col("geometry"))
    zones = spark.createDataFrame([(n, json.dumps(g)) for n, g in _ZONES.items()], "zone string, geometry string").select("zone", spatial.edges_of(polygons).alias("edges"))
    found = spatial.within(points, zones, "zone", cell=1.0)
    return points.join(found.hint("merge"), "rid", "left").select(F.col("rid").alias("p_partkey"), "zone")


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 100003) / 1e5 AS lon, (c_custkey * 104729 % 99991) / 1e5 AS lat FROM customer),
    h AS (SELECT (s_suppkey * 6007 % 100003) / 1e5 AS x, (s_suppkey * 5003 % 99991) / 1e5 AS y FROM supplier)
    SELECT c_custkey, (CASE WHEN EXISTS (SELECT 1 FROM h WHERE pow(lon - x, 2) + pow(lat - y, 2) <= 2e-2 * 2e-2) THEN 1 ELSE 0 END) AS in_register FROM p""")
def within_distance(spark, sf_dir):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "customer").select(c.alias("rid"), (c * 7919 % 100003 / F.lit(1e5)).alias("lon"), (c * 104729 % 99991 / F.lit(1e5)).alias("lat"))
    layer = table(spark, sf_dir, "supplier").select((s * 6007 % 100003 / F.lit(1e5)).alias("lon"), (s * 5003 % 99991 / F.lit(1e5)).alias("lat"))
    near = spatial.near(points, layer, 2e-2).withColumn("hit", F.lit(1))
    return points.join(near.hint("merge"), "rid", "left").select(F.col("rid").alias("c_custkey"), F.coalesce("hit", F.lit(0)).alias("in_register"))


_PLACES = """p AS (SELECT c_custkey, (c_custkey * 37 % 1009) / 1009e0 * 10e0 AS lon, (c_custkey * 101 % 997) / 997e0 * 10e0 AS lat FROM customer)"""


@query(f"""WITH {_PLACES}, e(zone, x1, y1, x2, y2) AS (VALUES {_edges(_ZONES)}),
    h AS (SELECT c_custkey, zone FROM p, e GROUP BY ALL {_INSIDE}),
    z AS (SELECT c_custkey, min(zone) AS zone FROM h GROUP BY 1), d AS (SELECT DISTINCT c_custkey FROM h WHERE zone = 'm'), q AS (SELECT c_custkey, zone FROM h WHERE zone = 'a'),
    r AS (SELECT (s_suppkey * 37 % 1009) / 1009e0 * 10e0 + 1e-3 AS x, (s_suppkey * 101 % 997) / 997e0 * 10e0 AS y FROM supplier)
    SELECT p.c_custkey, z.zone AS zoning_class, CASE WHEN EXISTS (SELECT 1 FROM r WHERE pow(lon - x, 2) + pow(lat - y, 2) <= 5e-2 * 5e-2) THEN 1 ELSE 0 END AS in_heritage_register,
      CASE WHEN d.c_custkey IS NOT NULL THEN 1 ELSE 0 END AS in_heritage_district, q.zone AS secondary_plan_name, CASE WHEN q.zone IS NOT NULL THEN 1 ELSE 0 END AS in_secondary_plan
    FROM p LEFT JOIN z USING (c_custkey) LEFT JOIN d USING (c_custkey) LEFT JOIN q USING (c_custkey)""")
def spatial_assemble(spark, sf_dir):
    """All four spatial lookups on one spine: each row once."""

    def place(df, key, shift=0.0):
        k = F.col(key)
        return df.select(k, (k * 37 % 1009 / F.lit(1009.0) * 10 + shift).alias("lon"), (k * 101 % 997 / F.lit(997.0) * 10).alias("lat"))

    polygons, _ = spatial.parse_geojson(F.col("geometry"))
    zones = spark.createDataFrame([(n, json.dumps(g)) for n, g in _ZONES.items()], "zone string, geometry string").select("zone", spatial.edges_of(polygons).alias("edges"))
    apps = place(table(spark, sf_dir, "customer"), "c_custkey").withColumn("_rid", F.col("c_custkey"))
    register = place(table(spark, sf_dir, "supplier"), "s_suppkey", 1e-3)
    named = lambda name, keep: zones.where(F.col("zone").isin(keep)).withColumnRenamed("zone", name)
    out = enrich.spatial_attributes(apps, named("zoning_class", list(_ZONES)), register, named("district", ["m"]), named("secondary_plan_name", ["a"]), radius=5e-2)
    return out.drop("_rid", "lon", "lat")


@query("""SELECT s_suppkey AS suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, s_acctbal AS acctbal, 0::INT AS year, 'csv' AS source_name FROM supplier""")
def csv_scan(spark, sf_dir):
    """Text files with a header: rows too long are cut, too short ones filled, numbers inferred, names normalized."""
    path = scratch(spark, "csv")
    key, name, balance = F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_acctbal").cast("string")
    short = F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws(",", balance, key)).otherwise(F.concat_ws(",", balance, key, F.concat(F.lit('"'), name, F.lit('"')), F.lit("extra")))
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # of each file: it begins with the names
    head = F.when(first, F.lit("Acctbal,SuppKey#,Name\n")).otherwise("")
    table(spark, sf_dir, "supplier").select(F.concat(head, short).alias("value")).write.text(path)
    return normalize.normalize(normalize.infer_types(read_csv(spark, path)), SourceConfig("csv", "bulk_csv"))


@query("""SELECT o_orderkey AS order_key, o_orderdate::DATE AS application_date, CASE WHEN o_orderkey > 100 THEN o_orderpriority END AS priority, year(o_orderdate)::INT AS year, 'pages' AS source_name FROM orders WHERE year(o_orderdate) >= 1997""")
def json_pages_scan(spark, sf_dir):
    """Staged pages of records: types from all of them, the year window over parsed dates."""
    path = scratch(spark, "pages")
    priority = F.when(F.col("o_orderkey") > 100, F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Order Key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Application Date"), priority.alias("PRIORITY"))
    rows.write.json(path)
    return normalize.year_window(normalize.normalize(spark.read.json(path), SourceConfig("pages", "datastore", 1997)), 1997)


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT o_orderkey, (ntile(3) OVER (ORDER BY o_orderkey) - 1)::INT AS fold FROM orders""")
def kfold_assign(spark, sf_dir):
    return ml.folds(table(spark, sf_dir, "orders").select("o_orderkey"), 3, F.col("o_orderkey"))


@query("""SELECT o_orderkey, (ntile(3) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::INT AS fold FROM orders""")
def stratified_kfold_assign(spark, sf_dir):
    return ml.folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 3, F.col("o_orderkey"), "o_orderstatus").drop("o_orderstatus")


@query("""SELECT o_orderkey, (ntile(3) OVER (PARTITION BY o_orderstatus = 'F' ORDER BY year(o_orderdate), o_orderkey) - 1)::INT AS fold FROM orders""")
def folds_in_stored_order(spark, sf_dir):
    """Rows served page by page, fetched, stored by year, and cut into the folds of training: blocks of the stored order within each class."""
    folder, page = scratch(spark, "portal"), 4096
    record = F.to_json(F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("application_date"), "o_orderstatus"))
    rows = ml.numbered(table(spark, sf_dir, "orders").orderBy("o_orderkey").select(record.alias("value")))
    rows.select("value", "row_number", (F.col("row_number") / page).cast("long").alias("page")).repartition("page").sortWithinPartitions("page", "row_number").drop("row_number").write.partitionBy("page").text(folder)
    forget(rows)
    page_of = lambda offset, limit: b"".join(_text_of(spark, f"{folder}/page={offset // limit}")).decode().splitlines() if exists(spark, f"{folder}/page={offset // limit}") else []
    data = scratch(spark, "data")
    with LocalPortal([{"id": "rows", "datastore_active": True}], page_of, total=table(spark, sf_dir, "orders").count()) as portal:
        write_source(PortalSource(SourceConfig("orders", "datastore", 1900), portal.client, page).fetch(spark), "orders", data)
    stored_rows = read_table(spark, f"{data}/orders").withColumn("done", (F.col("o_orderstatus") == "F").cast("int"))
    return ml.folds(stored_rows, 3, models.stored_order(stored_rows), "done").select("o_orderkey", "fold")


@query("""SELECT p_partkey, CASE WHEN p_size > 45 THEN -1e0 ELSE (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE END AS code FROM part""")
def ordinal_encode(spark, sf_dir):
    """The encoder of the models: fitted on all brands, some of which are replaced by one that it has not seen."""
    df = table(spark, sf_dir, "part")
    model = Pipeline(stages=ml.encoder(["p_brand"])).fit(df.select(F.col("p_brand").alias("f_p_brand")))
    seen = df.select("p_partkey", F.when(F.col("p_size") > 45, F.lit("unseen")).otherwise(F.col("p_brand")).alias("f_p_brand"))
    return model.transform(seen).select("p_partkey", F.col("o_p_brand").alias("code"))


@query("""SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std, count(*) AS n FROM orders""")
def mean_and_spread(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std"), F.count("*").alias("n"))


@query("""SELECT o_orderpriority AS feature, sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS share,
    row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_orderpriority)::INT AS rank FROM orders GROUP BY 1""")
def ranked_shares(spark, sf_dir):
    """Sums as shares of the whole, and their ranks: as importances are ranked."""
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("feature")).agg(F.sum("o_totalprice").alias("s"))
    w = Window.partitionBy()  # a handful of groups
    return s.select("feature", (F.col("s") / F.sum("s").over(w)).alias("share"), F.row_number().over(Window.orderBy(F.desc("s"), "feature")).alias("rank"))


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n_rows FROM {t}" for t in _TABLES))
def row_count_status(spark, sf_dir):
    out = None
    for t in _TABLES:
        n = table(spark, sf_dir, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("source"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


@query("""SELECT count_if(o_orderstatus = 'F')::BIGINT AS positives, count_if(o_orderstatus <> 'F')::BIGINT AS negatives,
    round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders""")
def class_balance(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("done", S.label(F.col("o_orderstatus"), (["f"], 1), (["o", "p"], 0)))
    found = ml.quantiles(df, "o_totalprice", {"median": 0.5, "p90": 0.9})
    return ml.label_summary(df, "done").select("positives", "negatives", *[F.round(F.lit(x), 4).alias(c) for c, x in found.items()])


_CLASSIFIER = ModelSpec("orders_done", "orders", "done", ("o_orderpriority", "c_mktsegment"), ("o_totalprice", "c_acctbal", "year"))
_REGRESSOR = ModelSpec("orders_days", "orders", "days", ("o_orderpriority", "c_mktsegment"), ("o_totalprice", "c_acctbal", "year"), regression=True)


def _applications(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = orders.withColumn("year", F.year("o_orderdate")).withColumn("done", S.label(F.col("o_orderstatus"), (["f"], 1), (["o"], 0)))
    return df.withColumn("days", F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date"))).select("o_orderkey", *_CLASSIFIER.features, "done", "days")


@query()
def train_classifier(spark, sf_dir):
    df = _applications(spark, sf_dir)
    model, n = ml.fit(df, _CLASSIFIER)
    auc = ml.metric(model.transform(ml.training_frame(df, _CLASSIFIER)), _CLASSIFIER)
    return spark.createDataFrame([(_CLASSIFIER.name, n, auc)], "model string, n long, roc_auc double")


@query()
def train_regressor(spark, sf_dir):
    df = _applications(spark, sf_dir)
    model, n = ml.fit(df, _REGRESSOR)
    r2 = ml.metric(model.transform(ml.training_frame(df, _REGRESSOR)), _REGRESSOR)
    return spark.createDataFrame([(_REGRESSOR.name, n, r2)], "model string, n long, r2 double")


@query()
def cross_validate(spark, sf_dir):
    r = ml.evaluate(_applications(spark, sf_dir), _CLASSIFIER, F.col("o_orderkey"), 3)
    return spark.createDataFrame([(r["mean"], r["std"], r["n"])], "mean double, std double, n long")


@query()
def score_batch(spark, sf_dir):
    df = _applications(spark, sf_dir)
    for spec in (_CLASSIFIER, _REGRESSOR):
        df = ml.predict(ml.fit(df, spec)[0], df, spec)
    return df.select("o_orderkey", "pred_done", "prob_done", "pred_days")


@query()
def score_one(spark, sf_dir):
    df = _applications(spark, sf_dir)
    one = spark.createDataFrame([("1-URGENT", None, 1000.0, None, 1998.0)], "o_orderpriority string, c_mktsegment string, o_totalprice double, c_acctbal double, year double")
    return ml.predict(ml.fit(df, _CLASSIFIER)[0], one, _CLASSIFIER).select("pred_done", "prob_done")


@query()
def importance_gain(spark, sf_dir):
    return ml.gain_importance(ml.fit(_applications(spark, sf_dir), _CLASSIFIER)[0], _CLASSIFIER)


@query()
def importance_permutation(spark, sf_dir):
    df = _applications(spark, sf_dir)
    return ml.permutation_importance(ml.fit(df, _CLASSIFIER)[0], df, _CLASSIFIER)


def _auc_drops() -> str:
    """SQL: each feature's drops of the AUC of the two stumps below, its values dealt out in two fixed orders."""
    raw = "CASE WHEN {}.p <= 150000 THEN -1e0 ELSE 1e0 END + CASE WHEN coalesce({}.t, 0) <= 1995 THEN 5e-1 ELSE -5e-1 END"
    sides = [f"SELECT '{f}' AS f, {k} AS k, a.y, {raw.format(*of)} AS raw FROM n a JOIN n b ON a.i = b.d{k}" for k in (0, 1) for f, of in (("o_totalprice", "ba"), ("year", "ab"), ("", "aa"))]
    return f"""WITH r AS (SELECT o_orderkey AS key, (o_orderstatus = 'F')::INT AS y, o_totalprice AS p, CASE WHEN o_orderkey % 10 <> 0 THEN year(o_orderdate) END AS t FROM orders WHERE o_orderstatus IN ('F', 'O')),
    n AS (SELECT *, row_number() OVER (ORDER BY key) AS i, {", ".join(f"row_number() OVER (ORDER BY key * {7919 + k} % 10007, key) AS d{k}" for k in (0, 1))} FROM r),
    s AS ({" UNION ALL ".join(sides)}), c AS (SELECT f, k, raw, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM s GROUP BY ALL),
    u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY f, k ORDER BY raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM c),
    a AS (SELECT f, k, sum(pos * (under + neg / 2e0)) / (sum(pos) * sum(neg)) AS auc FROM u GROUP BY f, k)
    SELECT a.f AS feature, round(avg(b.auc - a.auc), 9) AS importance_mean, round(stddev_pop(b.auc - a.auc), 9) AS importance_std FROM a JOIN a b ON b.f = '' AND a.k = b.k WHERE a.f <> '' GROUP BY a.f"""


@query(_auc_drops())
def importance_fixed_model(spark, sf_dir):
    """Permutation importance of a model that is given, two stumps of which one sends missing years left, in given orders."""
    spec = ModelSpec("orders_done", "orders", "done", (), ("o_totalprice", "year"))
    stump = lambda feature, limit, low, high: Tree([feature, -1, -1], [0, 0, 0], [limit, 0.0, 0.0], [True, False, False], [1, -1, -1], [2, -1, -1], [0.0, low, high], [1.0, 0.0, 0.0])
    model = ml.Fitted(Pipeline(stages=[]).fit(spark.range(1)), Boosted(False, 0.0, [stump(0, 150_000.0, -1.0, 1.0), stump(1, 1995.0, 0.5, -0.5)]), [], list(spec.num_cols))
    key = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(key, "o_totalprice", F.when(key % 10 != 0, F.year("o_orderdate")).alias("year"), S.label(F.col("o_orderstatus"), (["f"], 1), (["o"], 0)).alias("done"))
    found = ml.permutation_importance(model, df, spec, 2, first=key, dealt=lambda k: F.struct(key * (7919 + k) % 10007, key))
    return found.select("feature", *[F.round(c, 9).alias(c) for c in ("importance_mean", "importance_std")])


_SAVED = """SELECT count(*) AS n_rows, count_if(o_orderstatus IN ('F', 'O'))::BIGINT AS n_labelled, count(*) AS n_by_threshold, count(*) AS n_probabilities, 5::BIGINT AS n_features, 1e0 AS shares
    FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(_SAVED)
def saved_model(spark, sf_dir):
    """A model trained, saved, loaded and applied: what can be said of its scores and shares without the model."""
    df, folder, spec = _applications(spark, sf_dir), scratch(spark, "models"), _CLASSIFIER
    n = models.train_model(df, spec, folder)
    model = models.load_model(folder, spec.name)
    scored = ml.predict(model, df, spec)
    shares = ml.gain_importance(model, spec).agg(F.count("*").alias("n"), F.sum("importance_mean").alias("s")).first()
    by_threshold = F.count_if(F.col("pred_done") == (F.col("prob_done") > 0.5).cast("bigint"))
    counts = scored.agg(F.count("*").alias("n_rows"), by_threshold.alias("n_by_threshold"), F.count_if(F.col("prob_done").between(0, 1)).alias("n_probabilities"))
    return counts.select("n_rows", F.lit(n).cast("long").alias("n_labelled"), "n_by_threshold", "n_probabilities", F.lit(shares.n).cast("long").alias("n_features"), F.lit(round(shares.s, 9)).alias("shares"))


def _text_of(spark, folder: str) -> Iterator[bytes]:
    """The files that Spark wrote to a folder, one after another, in parts."""
    for name in files_below(spark, folder):
        if name.rpartition("/")[2].startswith("part-"):
            with io.BufferedReader(StoredFile(spark, f"{folder}/{name}")) as file:
                yield from iter(lambda: file.read(1 << 20), b"")  # noqa: B023


@query("""SELECT k AS supp_key, s_name AS name, s_nationkey::BIGINT AS name_2, d AS application_date, s_acctbal AS balance, coalesce(year(d), 0)::INT AS year, 'suppliers' AS source_name
    FROM (SELECT *, s_suppkey::BIGINT AS k, CASE WHEN s_suppkey % 9 <> 0 THEN make_date((1990 + s_suppkey % 10)::INT, 3, 4) END AS d FROM supplier) WHERE d IS NULL OR year(d) >= 1995""")
def portal_records(spark, sf_dir):
    """A dataset whose pages executors fetch over HTTP: names, dates, year window and source name as ``sync`` stores them."""
    # The portal's side: pages that Spark writes, and a server that hands them out.
    folder, page, k = scratch(spark, "portal"), 97, F.col("s_suppkey")
    when = F.when(k % 9 != 0, F.concat((1990 + k % 10).cast("string"), F.lit("-03-04")))
    record = F.to_json(F.struct(k.alias("Supp Key#"), F.col("s_name").alias("NAME"), F.col("s_nationkey").alias("name"), when.alias("Application Date"), F.col("s_acctbal").alias("Balance")), {"ignoreNullFields": "false"})
    rows = ml.numbered(table(spark, sf_dir, "supplier").select(record.alias("value")))
    rows.select("value", (F.col("row_number") / page).cast("long").alias("page")).repartition("page").write.partitionBy("page").text(folder)
    forget(rows)
    page_of = lambda offset, limit: b"".join(_text_of(spark, f"{folder}/page={offset // limit}")).decode().splitlines() if exists(spark, f"{folder}/page={offset // limit}") else []
    with LocalPortal([{"id": "files"}, {"id": "rows", "datastore_active": True}], page_of, total=table(spark, sf_dir, "supplier").count()) as portal:
        return PortalSource(SourceConfig("suppliers", "datastore", 1995), portal.client, page).fetch(spark).drop(SOURCE_ROW)


@query("""SELECT CASE WHEN s_suppkey % 4 = 3 THEN 'S' ELSE '' END || s_suppkey AS supp_key, s_acctbal AS balance, s_suppkey % 3 = 0 AS flag, s_suppkey || 'D' AS unit,
    CASE WHEN s_suppkey % 4 = 2 THEN s_name END AS name, 0::INT AS year, 'by_year' AS source_name FROM supplier WHERE s_suppkey % 4 > 0""")
def portal_csv_years(spark, sf_dir):
    """A dataset of a CSV a year, copied in parts and read by ranges: those from the start year on, whose columns and types differ."""
    # The portal's side: files that Spark writes.
    folder, k = scratch(spark, "portal"), F.col("s_suppkey")
    for y in range(4):
        fields = [F.concat(F.lit("S" * (y == 3)), k), F.col("s_acctbal").cast("string"), (k % 3 == 0).cast("string"), F.concat(k, F.lit("D"))]
        fields += [F.concat(F.lit('"'), "s_name", F.lit('"'))] if y == 2 else []
        head = F.when(F.monotonically_increasing_id() == 0, F.lit("Supp Key,Balance,FLAG,Unit" + ",Name" * (y == 2) + "\n")).otherwise("")
        table(spark, sf_dir, "supplier").where(k % 4 == y).coalesce(1).select(F.concat(head, F.concat_ws(",", *fields)).alias("value")).write.text(f"{folder}/{2018 + y}.csv")
    resources = [{"name": f"Suppliers {2018 + y}", "format": "csv", "url": f"/{2018 + y}.csv"} for y in range(4)]
    resources += [{"name": "Suppliers 2020", "format": "XML", "url": "/none"}, {"name": "Read me", "format": "CSV", "url": "/none"}]
    with LocalPortal(resources, files=lambda path: _text_of(spark, folder + path)) as portal:
        return PortalSource(SourceConfig("by_year", "bulk_csv", 2019), portal.client).fetch(spark).drop(SOURCE_ROW)


@query("""SELECT count(*) AS written, count(*) AS counted, true AS changed, true AS gone FROM orders""")
def stored_source(spark, sf_dir):
    """A dataset written, counted and dated, and replaced by one without rows."""
    folder = scratch(spark, "data")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    n, counted, at = write_source(df, "orders", folder), row_count(spark, "orders", folder), last_modified(spark, "orders", folder)
    gone = write_source(df.limit(0), "orders", folder) == 0 and row_count(spark, "orders", folder) is None and last_modified(spark, "orders", folder) is None
    return spark.createDataFrame([(n, counted, at is not None, gone)], "written long, counted long, changed boolean, gone boolean")


@query("""SELECT o_orderkey, (o_custkey % 25)::VARCHAR AS ward_number, year(o_orderdate)::INT AS year_submitted, approved AS coa_approved,
    CASE WHEN approved = 1 THEN CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 200 END END::INT AS coa_days_to_approval
    FROM (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 END::TINYINT AS approved FROM orders)""")
def enrich_committee(spark, sf_dir):
    """Committee applications through the enrichment of the command line."""
    folder, k = scratch(spark, "data"), F.col("o_orderkey")
    words = F.array(*[F.lit(w) for w in (" Approved\t", "conditional approval", "Refused", "WITHDRAWN", "Deferred", None)])
    final = F.when(k % 11 != 0, F.date_add(F.col("o_orderdate").cast("date"), (k % 200).cast("int")))
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("ward"), F.col("o_orderdate").cast("date").alias("in_date"), final.alias("finaldate"), words[(k % 6).cast("int")].alias("c_of_a_descision"), F.year("o_orderdate").alias("year"))
    write_source(df, "coa", folder)
    enrich.enrich_coa(spark, folder)
    return read_table(spark, f"{folder}/enriched/coa.parquet").select("o_orderkey", "ward_number", "year_submitted", "coa_approved", "coa_days_to_approval")


_CITY = {
    "RD": {"type": "Polygon", "coordinates": [[[-79.7, 43.62], [-79.3, 43.62], [-79.3, 43.8], [-79.7, 43.8], [-79.7, 43.62]], [[-79.6, 43.65], [-79.5, 43.65], [-79.5, 43.7], [-79.6, 43.7], [-79.6, 43.65]]]},
    "CR": {"type": "MultiPolygon", "coordinates": [[[[-79.55, 43.6], [-79.1, 43.7], [-79.35, 43.88], [-79.55, 43.6]]], [[[-79.8, 43.81], [-79.72, 43.81], [-79.76, 43.87], [-79.8, 43.81]]]]},
}
_DISTRICT = {"1": {"type": "Polygon", "coordinates": [[[-79.5, 43.7], [-79.4, 43.7], [-79.4, 43.8], [-79.5, 43.8], [-79.5, 43.7]]]}}
_PLAN = {"Midtown": {"type": "Polygon", "coordinates": [[[-79.45, 43.66], [-79.2, 43.68], [-79.25, 43.84], [-79.45, 43.66]]]}}


class _Files:
    """A client that has the files of some URLs."""

    def __init__(self, files: dict[str, bytes]):
        self.files = files

    def stream(self, url):
        return iter([self.files[url]])


def _shp(records: list[tuple[int, bytes]]) -> bytes:
    body = b""
    for k, (kind, data) in enumerate(records, 1):
        body += struct.pack(">2i", k, (len(data) + 4) // 2) + struct.pack("<i", kind) + data
    return bytes(100) + body


def _shx(records: list[tuple[int, bytes]]) -> bytes:
    at, index = 50, b""
    for _, data in records:
        index += struct.pack(">2i", at, (len(data) + 4) // 2)
        at += (len(data) + 12) // 2
    return bytes(100) + index


def _zip(name: str, records: list[tuple[int, bytes]]) -> bytes:
    with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
        z.writestr(f"{name}.shp", _shp(records))
        z.writestr(f"{name}.shx", _shx(records))
    return out.getvalue()


def _in(zones: dict, name: str) -> str:
    return f"{name}_e(zone, x1, y1, x2, y2) AS (VALUES {_edges(zones)}), {name} AS (SELECT k, min(zone) AS zone FROM (SELECT k, zone FROM p, {name}_e WHERE lon IS NOT NULL GROUP BY k, lon, lat, zone {_INSIDE}) GROUP BY k)"


@query(f"""WITH {_lonlat_ctes("customer", "c_custkey", "p")}, {_lonlat_ctes("supplier", "s_suppkey", "r")}, {_in(_CITY, "z")}, {_in(_DISTRICT, "d")}, {_in(_PLAN, "q")},
    n AS (SELECT DISTINCT p.k FROM p, r WHERE r.lon IS NOT NULL AND pow(p.lon - (r.lon + 1e-4), 2) + pow(p.lat - r.lat, 2) <= 2e-4 * 2e-4)
    SELECT p.k AS c_custkey, z.zone AS zoning_class, (n.k IS NOT NULL)::INT AS in_heritage_register, (d.k IS NOT NULL)::INT AS in_heritage_district, q.zone AS secondary_plan_name,
      (q.k IS NOT NULL)::INT AS in_secondary_plan, (p.k % 3 <> 0)::TINYINT AS has_community_meeting, CASE p.k % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 END::TINYINT AS dev_approved,
      CASE p.k % 5 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 END::TINYINT AS dev_no_appeal, (2015 + p.k % 8)::INT AS year_submitted
    FROM p LEFT JOIN z USING (k) LEFT JOIN d USING (k) LEFT JOIN q USING (k) LEFT JOIN n USING (k)""")
def enrich_development(spark, sf_dir):
    """Development applications through the enrichment of the command line: layers fetched from a portal, unpacked, read and joined."""
    folder = scratch(spark, "data")
    lon, lat = S.grid_to_lonlat(*map(S.number, _grid_text(F.col("s_suppkey"))))
    register = table(spark, sf_dir, "supplier").select(lon.alias("lon"), lat.alias("lat")).where("lon is not null").collect()  # the portal's side
    points = [(1, struct.pack("<2d", r.lon + 1e-4, r.lat)) for r in register]
    ring = [v for p in _DISTRICT["1"]["coordinates"][0] for v in p]
    district = [(5, struct.pack("<4d2i1i", 0, 0, 0, 0, 1, len(ring) // 2, 0) + struct.pack(f"<{len(ring)}d", *ring))]
    quoted = lambda g: json.dumps(g).replace('"', '""')
    zoning = "\n".join(["_id,ZN_ZONE,geometry", *(f'{k},{name},"{quoted(g)}"' for k, (name, g) in enumerate(_CITY.items())), ""])
    plans = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"SECONDARY_PLAN_NAME": name}, "geometry": g} for name, g in _PLAN.items()]}
    urls = layers.LAYER_URLS
    files = {urls["zoning"]: zoning.encode(), urls["secondary_plans"]: json.dumps(plans).encode(), urls["heritage_register"]: _zip("a/points", points), urls["heritage_districts"]: _zip("districts", district)}
    layers.fetch_layers(spark, f"{folder}/reference", _Files(files))
    k = F.col("c_custkey")
    x, y = _grid_text(k)
    words = F.array(*[F.lit(w) for w in ("Closed", " refused", "OMB Approved", "Appeal Received", None)])
    submitted = F.make_date((2015 + k % 8).cast("int"), F.lit(5), F.lit(6))
    df = table(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), y.alias("y"), words[(k % 5).cast("int")].alias("status"), submitted.alias("date_submitted"), F.when(k % 3 != 0, "").alias("community_meeting_date"), F.year(submitted).alias("year"))
    write_source(df, "dev_applications", folder)
    enrich.enrich_dev(spark, folder)
    out = read_table(spark, f"{folder}/enriched/dev_applications.parquet")
    return out.select("c_custkey", "zoning_class", "in_heritage_register", "in_heritage_district", "secondary_plan_name", "in_secondary_plan", "has_community_meeting", "dev_approved", "dev_no_appeal", "year_submitted")
