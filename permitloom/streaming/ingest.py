"""The same ingest as a stream: new raw files are normalized and added to the year partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from permitloom.config import SourceConfig
from permitloom.functions.scalars import year_or_zero
from permitloom.operators.normalize import rename_columns, year_window


def normalized_stream(raw: DataFrame, config: SourceConfig, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Snake-case names, dates of one declared format, year, source and the year window."""
    df = rename_columns(raw)
    df = df.withColumns({c: F.try_to_date(F.col(c).cast("string"), date_format) for c in df.columns if "date" in c})
    year = year_or_zero(F.col(config.year_column)) if config.year_column in df.columns else F.lit(0)
    return year_window(df.withColumn("year", year).withColumn("source_name", F.lit(config.dataset_id)), config.year_start)


def stream_ingest(spark: SparkSession, raw_dir: str, schema: StructType, config: SourceConfig, target: str, checkpoint: str) -> StreamingQuery:
    """Take in all new JSON files of ``raw_dir`` once; files are counted once however often this runs."""
    stream = normalized_stream(spark.readStream.schema(schema).json(raw_dir), config)
    return stream.writeStream.format("parquet").partitionBy("year").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
