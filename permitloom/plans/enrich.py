"""Enrichment: outcome labels, durations and spatial attributes of applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitloom import config
from permitloom.functions import scalars as S
from permitloom.operators import spatial
from permitloom.operators.scratch import stored
from permitloom.operators.storage import read_table, replace
from permitloom.sources import layers

#: Degrees within which a registered point counts as an application's.
HERITAGE_RADIUS = 0.0002


def label_coa(df: DataFrame) -> DataFrame:
    """Committee applications with ward as text, year, outcome, and days to approval of the approved."""
    if "ward" in df.columns:
        df = df.withColumnRenamed("ward", "ward_number").withColumn("ward_number", F.col("ward_number").cast("string"))
    df = df.withColumn("year_submitted", F.year("in_date"))
    df = df.withColumn("coa_approved", S.label(F.col("c_of_a_descision"), (config.COA_APPROVED, 1), (config.COA_REFUSED, 0)))
    return df.withColumn("coa_days_to_approval", S.days_if(F.col("coa_approved"), F.col("in_date"), F.col("finaldate")))


def year_submitted(df: DataFrame, column: str) -> DataFrame:
    """Year of a date or time column, or of the first characters of a text one."""
    temporal = isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return df.withColumn("year_submitted", F.year(column) if temporal else S.leading_year(F.col(column)))


def label_dev(df: DataFrame) -> DataFrame:
    """Development applications with both outcomes; the second is 1 where an appeal was filed."""
    df = df.withColumn("dev_approved", S.label(F.col("status"), (config.DEV_APPROVED, 1), (config.DEV_REFUSED, 0)))
    return df.withColumn("dev_no_appeal", S.appeal_label(F.col("status"), config.DEV_APPEALED, config.DEV_APPROVED))


def locate(df: DataFrame) -> DataFrame:
    """lon, lat from the text columns x and y, and a row id ``_rid``."""
    lon, lat = S.grid_to_lonlat(S.number(F.col("x").cast("string")), S.number(F.col("y").cast("string")))
    return df.withColumn("lon", lon).withColumn("lat", lat).withColumn("_rid", F.monotonically_increasing_id())


def spatial_attributes(df: DataFrame, zoning: DataFrame, register: DataFrame, districts: DataFrame, plans: DataFrame, radius: float = HERITAGE_RADIUS) -> DataFrame:
    """Each row once, with zoning_class, heritage flags and the secondary plan; of several matches the smallest name."""
    points = df.select("_rid", "lon", "lat")
    zone = spatial.within(points, zoning, "zoning_class", "_rid")
    plan = spatial.within(points, plans, "secondary_plan_name", "_rid")
    listed = spatial.near(points, register, radius, "_rid").withColumn("in_heritage_register", F.lit(1))
    district = spatial.within(points, districts.select(F.lit("1").alias("district"), "edges"), "district", "_rid").select("_rid", F.lit(1).alias("in_heritage_district"))
    out = df
    for found in (zone, listed, district, plan):
        # As many rows as there are points at most: sorted on both sides, and never gathered by the driver.
        out = out.join(found.hint("merge"), "_rid", "left")
    return out.select(
        *[F.col(c) for c in df.columns],
        "zoning_class",
        F.coalesce("in_heritage_register", F.lit(0)).alias("in_heritage_register"),
        F.coalesce("in_heritage_district", F.lit(0)).alias("in_heritage_district"),
        "secondary_plan_name",
        F.when(F.col("secondary_plan_name").isNotNull(), 1).otherwise(0).alias("in_secondary_plan"),
    )


def spatial_join_dev(df: DataFrame, data_dir: str) -> DataFrame:
    """Spatial attributes from the cached reference layers.

    Located rows are a table in the shared folder, so that a row has one id in all the joins.
    """
    spark, base = df.sparkSession, f"{data_dir}/reference"
    return spatial_attributes(
        stored(locate(df), "located"),
        layers.zoning(spark, f"{base}/zoning.csv"),
        layers.shapefile(spark, f"{base}/heritage_register").select("lon", "lat"),
        layers.shapefile(spark, f"{base}/heritage_districts"),
        layers.geojson(spark, f"{base}/secondary_plans.geojson", "SECONDARY_PLAN_NAME", "secondary_plan_name"),
    )


def enrich_coa(spark: SparkSession, data_dir: str) -> int:
    """Write data/enriched/coa.parquet; the number of rows."""
    return replace(label_coa(read_table(spark, f"{data_dir}/coa")), f"{data_dir}/enriched/coa.parquet")


def enrich_dev(spark: SparkSession, data_dir: str, join=spatial_join_dev) -> int:
    """Write data/enriched/dev_applications.parquet; the number of rows.  ``join`` adds the spatial columns."""
    df = year_submitted(read_table(spark, f"{data_dir}/dev_applications"), "date_submitted")
    df = df.withColumn("has_community_meeting", S.present_flag(F.col("community_meeting_date")))
    return replace(label_dev(join(df, data_dir)), f"{data_dir}/enriched/dev_applications.parquet")
