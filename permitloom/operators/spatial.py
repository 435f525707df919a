"""Spatial joins as equi-joins on cells.

Polygons are covered by quadtree cells: a cell that no edge reaches is inside as a whole or left out, one with few
edges keeps those that a ray in it may meet, and one with many is split into four.  Points
fall into one cell of each level, and the two meet on the cell; only in cells that edges reach is there an exact test, an
expression over the few edges kept, so no edge is ever a row.

The optimizer doesn't see that exploding makes rows more, and would take a large table of points for a small one.  So
the sides of these joins are named: a cover is broadcast if its own size, which is counted, is small, and else both sides are shuffled; points never are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitloom.operators.scratch import stored

#: Degrees of the largest cells, how often a cell may be split, and edges of a cell that is not split.
CELL, DEPTH, FEW = 0.32, 9, 12
#: Share of a cell's width by which it reaches beyond its borders, for points that rounding puts on the other side.
SLACK = 1e-6
#: Bytes of a cover up to which it is broadcast.
SMALL = 8 << 20
_POINT = "array<double>"
_RINGS = f"array<array<{_POINT}>>"


def parse_geojson(text: Column) -> tuple[Column, Column]:
    """Polygons (array of polygons of rings of points), and a point, of a GeoJSON geometry text."""
    kind = F.get_json_object(text, "$.type")
    one = F.from_json(text, f"coordinates {_RINGS}").getField("coordinates")
    many = F.from_json(text, f"coordinates array<{_RINGS}>").getField("coordinates")
    point = F.from_json(text, f"coordinates {_POINT}").getField("coordinates")
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many), F.when(kind == "Point", point)


def edges_of(polygons: Column) -> Column:
    """All edges (x1, y1, x2, y2) of all rings: even-odd counting takes care of holes and parts."""

    def ring_edges(ring: Column) -> Column:
        pairs = F.when(F.size(ring) > 1, F.sequence(F.lit(1), F.size(ring) - 1)).otherwise(F.array().cast("array<int>"))
        at = lambda i: F.element_at(ring, i)
        return F.transform(pairs, lambda i: F.struct(at(i)[0].alias("x1"), at(i)[1].alias("y1"), at(i + 1)[0].alias("x2"), at(i + 1)[1].alias("y2")))

    return F.flatten(F.transform(F.flatten(polygons), ring_edges))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Whether a ray from the point to the right crosses an odd number of edges; a point on an edge is not inside."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    between = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    holds = lambda e: between(x, e["x1"], e["x2"]) & between(y, e["y1"], e["y2"]) & ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, holds)


_EDGES = pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))


def covering(edges: np.ndarray, cell: float, few: int = FEW, depth: int = DEPTH) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """Cells (level, column, row, edges) that cover a polygon of edges (x1, y1, x2, y2); no edges where the whole cell is inside.

    A cell's edges are those that a ray to the right from a point of it may meet: they reach
    into its row, and not only to its left.
    """
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    first, last = np.floor(low.min(0) / cell).astype(np.int64), np.floor(high.max(0) / cell).astype(np.int64)
    # Rows of the largest cells share what reaches into them.
    for cy in range(first[1], last[1] + 1):
        here = np.nonzero((high[:, 1] >= (cy - SLACK) * cell) & (low[:, 1] <= (cy + 1 + SLACK) * cell))[0]
        todo = [(0, cx, cy, here) for cx in range(first[0], last[0] + 1)]
        while todo:
            level, x, y, some = todo.pop()
            size = cell / (1 << level)
            (x0, x1), (y0, y1) = (((k - SLACK) * size, (k + 1 + SLACK) * size) for k in (x, y))
            some = some[(high[some, 1] >= y0) & (low[some, 1] <= y1) & (high[some, 0] >= x0)]
            own = int((low[some, 0] <= x1).sum())
            if not own:
                at = (y + 0.5) * size
                if ((edges[some, 1] > at) != (edges[some, 3] > at)).sum() % 2:
                    yield level, x, y, None
            elif own <= few or level == depth:
                yield level, x, y, edges[some]
            else:
                todo += [(level + 1, 2 * x + i, 2 * y + j, some) for i in (0, 1) for j in (0, 1)]


def cover(layer: DataFrame, name: str, cell: float = CELL) -> DataFrame:
    """__name, level, cx, cy, edges (null where the cell is inside as a whole) of a layer's polygons (``name``, edges)."""
    rows = layer.where(F.size("edges") > 0).select(F.col(name).alias("__name"), "edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                each = batch.column("edges").slice(k, 1).flatten()
                edges = np.stack([np.asarray(each.field(c), dtype=np.float64) for c in ("x1", "y1", "x2", "y2")], 1)
                edges = edges[np.isfinite(edges).all(1)]
                found = list(covering(edges, cell)) if len(edges) else []
                for at in range(0, len(found), 4096):
                    level, x, y, some = zip(*found[at : at + 4096], strict=True)
                    sizes = [0 if e is None else len(e) for e in some]
                    flat = np.concatenate([np.zeros((0, 4)), *(e for e in some if e is not None)])
                    values = pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], names=["x1", "y1", "x2", "y2"])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values, mask=pa.array([e is None for e in some]))
                    names = batch.column("__name").take(pa.array([k] * len(some)))
                    yield pa.RecordBatch.from_arrays([names, pa.array(level, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), lists], names=["__name", "level", "cx", "cy", "edges"])

    kind = rows.schema["__name"].dataType.simpleString()
    return rows.mapInArrow(run, f"__name {kind}, level int, cx long, cy long, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def candidates(points: DataFrame, cells: DataFrame, rid: str, cell: float) -> DataFrame:
    """__rid, lon, lat, __name, edges of the points and the cells of a cover that they fall into.

    The cover is a table in the shared folder: a point is a row for each level that it has.
    """
    cells = stored(cells, "cover")
    levels = cells.groupBy("level").agg(F.sum(F.lit(64) + 32 * F.coalesce(F.size("edges"), F.lit(0))).alias("bytes")).collect()  # a row for each level
    cells = F.broadcast(cells) if sum(r.bytes for r in levels) <= SMALL else cells.hint("merge")
    at = lambda c: F.floor(F.col(c) / (F.lit(cell) / F.pow(F.lit(2.0), F.col("level"))))
    used = F.array(*[F.lit(k) for k in sorted(r.level for r in levels)]).cast("array<int>")
    placed = points.where("lon is not null and lat is not null").select(F.col(rid).alias("__rid"), "lon", "lat", F.explode(used).alias("level"))
    placed = placed.withColumn("cx", at("lon")).withColumn("cy", at("lat"))
    return placed.join(cells, ["level", "cx", "cy"]).select("__rid", "lon", "lat", "__name", "edges")


def within(points: DataFrame, layer: DataFrame, name: str, rid: str = "rid", cell: float = CELL) -> DataFrame:
    """rid, ``name`` of the points in the layer's polygons; of several the smallest name (nulls last).

    points: rid, lon, lat.  layer: ``name``, edges.  Rows without coordinates or edges match nothing.
    """
    found = candidates(points, cover(layer, name, cell), rid, cell)
    held = F.col("edges").isNull() | inside(F.col("lon"), F.col("lat"), F.col("edges"))
    return found.where(held).groupBy(F.col("__rid").alias(rid)).agg(F.min("__name").alias(name))


def near(points: DataFrame, layer: DataFrame, radius: float, rid: str = "rid") -> DataFrame:
    """rid of the points with a layer point (lon, lat) at most ``radius`` degrees away.

    Cells are as wide as the radius; a layer point is put into its own and the eight around it.  A point is done
    with the first layer point that is close, so no pairs come out.
    """
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    at = lambda c: F.floor(F.col(c) / radius)
    known = "lon is not null and lat is not null"
    around = layer.where(known).select(F.col("lon").alias("x"), F.col("lat").alias("y"), at("lon").alias("cx0"), at("lat").alias("cy0")).distinct()
    around = around.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    around = around.select("x", "y", (F.col("cx0") + F.col("dx")).alias("near_x"), (F.col("cy0") + F.col("dy")).alias("near_y"))
    placed = points.where(known).select(F.col(rid).alias("__rid"), "lon", "lat", at("lon").alias("cx"), at("lat").alias("cy"))
    close = F.pow(F.col("lon") - F.col("x"), 2) + F.pow(F.col("lat") - F.col("y"), 2) <= radius * radius
    same = (F.col("cx") == F.col("near_x")) & (F.col("cy") == F.col("near_y"))
    return placed.join(around.hint("merge"), same & close, "left_semi").select(F.col("__rid").alias(rid)).distinct()
