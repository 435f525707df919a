"""Shapefiles as a data source, read by ranges of records (public ESRI layout).

    spark.dataSource.register(Shapefile)
    spark.read.format("shapes").load("s3a://.../layer.shp")

The .shx file beside the .shp has the offset and length of each record, eight bytes each, so ``records`` of them are a
partition: an executor reads that part of the .shx and the part of the .shp that it names.  Without a
.shx the records can only be found one after another, by one task, which reads them in steps.

A row is a record: lon and lat of a point, or polygons (all rings of a polygon or line as one); all null for
other kinds and empty shapes.  Points with heights or measures lose them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from permitloom.operators.files import file_system

# Fixed values of the format: bytes of a file's header and of a record's, kinds of points, and of shapes that have parts.
HEADER, HEAD = 100, 8
POINTS, PARTED = (1, 11, 21), (3, 5, 13, 15, 23, 25)
SCHEMA = "lon double, lat double, polygons array<array<array<array<double>>>>"
RECORDS, STEP = 20_000, 8 << 20
_POLYGONS = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))


def shape(body: memoryview) -> tuple[float | None, float | None, list | None]:
    """lon, lat, and rings of points, of a record's content."""
    kind = struct.unpack("<i", body[:4])[0] if len(body) >= 4 else 0
    if kind in POINTS:
        return (*struct.unpack("<2d", body[4:20]), None)
    if kind in PARTED:
        parts, points = struct.unpack("<2i", body[36:44])
        starts = [*np.frombuffer(body, "<i4", parts, 44).tolist(), points]
        xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()
        return None, None, [xy[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return None, None, None


def _batch(shapes: list[tuple]) -> pa.RecordBatch:
    lon, lat, rings = zip(*shapes, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(lon, pa.float64()), pa.array(lat, pa.float64()), pa.array([r if r is None else [r] for r in rings], _POLYGONS)], names=["lon", "lat", "polygons"])


class Range(InputPartition):
    """Records ``first`` to ``last`` - 1; all of a file without an index if ``last`` is below 0."""

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class ShapeReader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def _index(self) -> str:
        return self.path[:-1] + ("X" if self.path.endswith("P") else "x")

    def partitions(self) -> list[Range]:
        fs, path = file_system(self._index())
        about = fs.get_file_info(path)
        if not about.is_file:
            return [Range(0, -1)]
        n = max(0, about.size - HEADER) // 8
        return [Range(k, min(n, k + self.records)) for k in range(0, n, self.records)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(self.path)
        with fs.open_input_file(path) as file:
            if part.last < 0:
                yield from self._one_by_one(file)
                return
            with fs.open_input_file(file_system(self._index())[1]) as index:
                words = np.frombuffer(index.read_at(8 * (part.last - part.first), HEADER + 8 * part.first), ">i4").reshape(-1, 2).astype(np.int64)
            begin, size = 2 * words[:, 0] + HEAD, 2 * words[:, 1]
            k = 0
            while k < len(begin):
                # Records that lie close to one another are one read; the index may have them in any order.
                stop, end = k + 1, begin[k] + size[k]
                while stop < len(begin) and 0 <= begin[stop] - end <= 1024 and begin[stop] + size[stop] - begin[k] <= STEP:
                    end = begin[stop] + size[stop]
                    stop += 1
                data = memoryview(file.read_at(int(end - begin[k]), int(begin[k])))
                yield _batch([shape(data[b : b + s]) for b, s in zip((begin[k:stop] - begin[k]).tolist(), size[k:stop].tolist(), strict=True)])
                k = stop

    def _one_by_one(self, file) -> Iterator[pa.RecordBatch]:
        at, end, shapes = HEADER, file.size(), []
        while at + HEAD <= end:
            data = memoryview(file.read_at(min(STEP, end - at), at))
            here = 0
            while here + HEAD <= len(data):
                size = 2 * struct.unpack(">i", data[here + 4 : here + 8])[0]
                if here + HEAD + size > len(data):
                    break
                shapes.append(shape(data[here + HEAD : here + HEAD + size]))
                here += HEAD + size
            if not here:  # one record is longer than a step, or cut off
                size = 2 * struct.unpack(">i", data[4:8])[0]
                if at + HEAD + size > end:
                    break
                shapes.append(shape(memoryview(file.read_at(size, at + HEAD))))
                here = HEAD + size
            at += here
            if shapes:
                yield _batch(shapes)
                shapes = []


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(self.options["path"], int(self.options.get("records", RECORDS)))
