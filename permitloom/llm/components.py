"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges are first contracted inside each partition, ``CHUNK`` at a time, so what is shuffled is no
more than a forest per chunk and what a task holds has that bound.  Each round then needs joins and minima only; no node's neighbours
are ever held together.  The minima are tables of their own: their join with the edges has a plain
exchange on both sides, so that a hub's rows are split as a skewed join's.  A round's
edges are written to the shared folder too, which cuts the lineage and outlives executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitloom.llm.common import forget, remove, scratch, written

CHUNK = 1 << 20


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        nodes = list(forest.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["u", "v"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
            if len(forest.up) >= CHUNK:
                yield out()
                forest = Forest()
    if forest.up:
        yield out()


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step's edges, and the table of minima that they are made from."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = written(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    rest = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def _is_stars(e: DataFrame) -> bool:
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return bad.isEmpty()


def components_table(edges: DataFrame) -> DataFrame:
    """``connected_components`` as a table by itself, made by ``written``."""
    found = connected_components(edges)
    out = written(found, "components")
    forget(found)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id``, ``component_id`` (the smallest reachable id) of every node that has an edge to another.

    Edges with a null end and loops say nothing; repeated edges count once; without edges
    the result is empty.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y")).where("x and y and u != v").select("u", "v")
    path = scratch(spark, "edges")
    e.mapInArrow(_contract, "u long, v long").distinct().write.parquet(path)
    e = spark.read.schema("u long, v long").parquet(path)
    while True:  # each round brings every node nearer to its smallest
        if _is_stars(e):
            out = e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
            out.scratch_path = path
            return out
        for step in (_large_star, _small_star):
            new = scratch(spark, "edges")
            edges, least = step(e)
            edges.write.parquet(new)
            forget(least)
            remove(spark, path)
            path, e = new, spark.read.schema("u long, v long").parquet(new)
