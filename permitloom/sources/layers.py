"""Reference layers: zoning CSV, shapefiles, GeoJSON, and their cache beside the data."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitloom.config import LAYER_URLS, PORTAL
from permitloom.operators.files import StoredFile
from permitloom.operators.spatial import edges_of, parse_geojson
from permitloom.operators.storage import delete, exists, files_below, move, write_text
from permitloom.sources.base import CHUNK, Client, HttpClient
from permitloom.sources.csv_ranges import read_csv
from permitloom.sources.shapes import Shapefile


def fetch_layers(spark: SparkSession, folder: str, client: Client | None = None) -> None:
    """Download what is not there yet, to any file system Spark knows, in parts; each layer appears under its name when it is whole."""
    client = client or HttpClient(PORTAL)
    for name, target in (("zoning", "zoning.csv"), ("secondary_plans", "secondary_plans.geojson")):
        if not exists(spark, path := f"{folder}/{target}"):
            write_text(spark, f"{path}.part", client.stream(LAYER_URLS[name]))
            move(spark, f"{path}.part", path)
    for name in ("heritage_register", "heritage_districts"):
        if not exists(spark, path := f"{folder}/{name}"):
            delete(spark, f"{path}.part")
            write_text(spark, f"{path}.zip", client.stream(LAYER_URLS[name]))
            with io.BufferedReader(StoredFile(spark, f"{path}.zip"), CHUNK) as packed, zipfile.ZipFile(packed) as z:
                for member in z.infolist():
                    if not member.is_dir() and ".." not in member.filename.split("/"):
                        with z.open(member) as content:
                            write_text(spark, f"{path}.part/{member.filename.lstrip('/')}", iter(lambda: content.read(CHUNK), b""))
            move(spark, f"{path}.part", path)
            delete(spark, f"{path}.zip")


def zoning(spark: SparkSession, path: str) -> DataFrame:
    """zoning_class, edges of the zoning CSV (its geometry column holds GeoJSON)."""
    polygons, _ = parse_geojson(F.col("geometry"))
    return read_csv(spark, path).select(F.col("ZN_ZONE").alias("zoning_class"), edges_of(polygons).alias("edges")).where("edges is not null")


def geojson(spark: SparkSession, path: str, name: str, out: str) -> DataFrame:
    """``out`` (a property) and edges of a feature collection."""
    features = spark.read.schema("features array<struct<properties:map<string,string>,geometry:string>>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    polygons, _ = parse_geojson(F.col("f.geometry"))
    return features.select(F.col("f.properties")[name].alias(out), edges_of(polygons).alias("edges")).where("edges is not null")


def shapefile(spark: SparkSession, folder: str) -> DataFrame:
    """lon, lat (points), edges (polygons) of the first .shp file, by name, in the folder, by ranges of its records."""
    files = [f for f in files_below(spark, folder) if f.lower().endswith(".shp")]
    if not files:
        raise FileNotFoundError(f"{folder} has no .shp file")
    spark.dataSource.register(Shapefile)
    rows = spark.read.format(Shapefile.name()).load(f"{folder}/{files[0]}")
    return rows.select("lon", "lat", edges_of(F.col("polygons")).alias("edges"))
