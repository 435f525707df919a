"""From raw extracts to tables with stable names, dates, year and source."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitloom.config import SourceConfig
from permitloom.functions.scalars import WHOLE, number, year_or_zero

# The date formats that columns may have; of equally good ones the first counts.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy"]


def snake_names(names: Sequence[str]) -> list[str]:
    """Lower case with single underscores; the nth name with the same result gets ``_n``, from 2.

    A suffixed name that another column already has is passed over, so all results differ.
    """
    # Fixed value: what becomes an underscore.
    bases = [re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") for c in names]
    taken, count, out = set(bases), {}, []
    for base in bases:
        count[base] = count.get(base, 0) + 1
        name = base
        if count[base] > 1:
            name = f"{base}_{count[base]}"
            while name in taken:
                count[base] += 1
                name = f"{base}_{count[base]}"
            taken.add(name)
        out.append(name)
    return out


def rename_columns(df: DataFrame) -> DataFrame:
    """Rename by position, so names that differ in case only do no harm."""
    return df.toDF(*snake_names(df.columns))


def parse_dates(df: DataFrame) -> DataFrame:
    """Columns with "date" in their name become dates if their values have a known format.

    One pass counts for all of them how many values each format parses, and the one that
    parses most is taken.  Cells that don't parse become null; a column in no known format stays
    text.
    """
    names = [c for c in df.columns if "date" in c and not isinstance(df.schema[c].dataType, T.DateType)]
    sniffed = [c for c in names if not isinstance(df.schema[c].dataType, T.TimestampType)]
    text = {c: F.col(f"`{c}`").cast("string") for c in names}
    fits = {}
    if sniffed:
        counts = df.agg(*[F.count(F.try_to_date(text[c], f)).alias(f"{i}_{k}") for i, c in enumerate(sniffed) for k, f in enumerate(DATE_FORMATS)]).first()
        for i, c in enumerate(sniffed):
            n, k = max((counts[f"{i}_{k}"], -k) for k in range(len(DATE_FORMATS)))
            if n:
                fits[c] = DATE_FORMATS[-k]
    for c in names:
        if c in fits:
            df = df.withColumn(c, F.try_to_date(text[c], fits[c]))
        elif c not in sniffed:
            df = df.withColumn(c, F.to_date(c))
    return df


def add_year(df: DataFrame, column: str) -> DataFrame:
    """``year`` of a date column, 0 where it is null, absent or no date."""
    known = column in df.columns and isinstance(df.schema[column].dataType, T.DateType)
    return df.withColumn("year", year_or_zero(F.col(column)) if known else F.lit(0))


def normalize(df: DataFrame, config: SourceConfig) -> DataFrame:
    if not df.columns:
        return df
    df = add_year(parse_dates(rename_columns(df)), config.year_column)
    return df.withColumn("source_name", F.lit(config.dataset_id))


def year_window(df: DataFrame, start: int) -> DataFrame:
    """Rows from the start year on, and those without a year."""
    return df.where((F.col("year") == 0) | (F.col("year") >= start)) if "year" in df.columns else df


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a whole number become bigint, a number double, true or false boolean; one pass over the table.

    A number is written in decimal digits, with a point or an exponent if it is no whole one:
    ``12D``, ``3F``, ``NaN`` and ``Infinity`` are text.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    at = {c: F.col(f"`{c}`") for c in names}
    as_kind = {
        "bigint": lambda c: F.when(c.rlike(WHOLE), c.try_cast("bigint")),
        "double": number,
        "boolean": lambda c: F.when(F.lower(c).isin("true", "false"), F.lower(c) == "true"),
    }
    checks = []
    for i, c in enumerate(names):
        checks += [F.count(at[c]).alias(f"n{i}"), *[F.count(make(at[c])).alias(f"{kind}{i}") for kind, make in as_kind.items()]]
    row = df.agg(*checks).first()
    kinds = {c: next((k for k in as_kind if row[f"{k}{i}"] == row[f"n{i}"]), None) for i, c in enumerate(names) if row[f"n{i}"]}
    return df.select(*[as_kind[kinds[c]](at[c]).alias(c) if kinds.get(c) else F.col(f"`{c}`") for c in df.columns])


def diagonal_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null, and columns of different types become text."""
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    aligned = [df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
