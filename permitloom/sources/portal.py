"""Datasets of an open-data portal: paginated records, or CSV files by year."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitloom.config import PORTAL, SOURCE_CONFIGS, SourceConfig
from permitloom.operators.normalize import diagonal_union, infer_types, normalize, year_window
from permitloom.operators.scratch import forget, scratch, stored
from permitloom.operators.storage import SOURCE_ROW, delete, positions, write_text
from permitloom.sources.base import Client, HttpClient
from permitloom.sources.csv_ranges import read_csv
from permitloom.sources.paged import PAGE, PagedRecords

# Fixed values of the portal: its request path, and how a file's name gives its year.
PACKAGE = "/api/3/action/package_show"
_YEAR = re.compile(r"\b(20\d{2})\b")


class PortalSource:
    """One dataset.  Executors fetch its pages; files are copied to the shared folder in parts and read by ranges."""

    def __init__(self, config: SourceConfig, client: Client | None = None, page: int = PAGE):
        self.config, self.name, self.page = config, config.dataset_id, page
        self.client = client or HttpClient(PORTAL)

    def fetch(self, spark: SparkSession) -> DataFrame:
        """Normalized rows from the start year on, and those without a year; ``source_row`` ascends as they do in the source.

        They are read from a table in the shared folder, which goes with the session, or by ``forget``.
        """
        # Raw names may differ in case only, until they are renamed.  That is for a session of its own to know.
        side = spark.newSession()
        side.conf.set("spark.sql.caseSensitive", "true")
        raw = self._datastore(side) if self.config.access_mode == "datastore" else self._bulk_csv(side)
        # Types have been found from all rows; later passes read this table, by position.
        names = raw.columns
        kept = stored(raw.toDF(*[f"c{k}" for k in range(len(names))]), "fetched", spark) if names else spark.createDataFrame([], "")
        forget(*getattr(raw, "reads", []))
        if not names:
            return kept
        out = normalize(kept.withColumn("position", positions()).toDF(*names, "position"), self.config)
        # Where a row stands in the source, in the column after the source's own.
        taken, place = set(out.columns), SOURCE_ROW
        while place in taken:
            place += "_"
        out = year_window(out.toDF(*[place if k == len(names) else c for k, c in enumerate(out.columns)]), self.config.year_start)
        out.scratch_path = getattr(kept, "scratch_path", None)
        return out

    def _resources(self) -> list[dict]:
        return self.client.get_json(PACKAGE, {"id": self.config.dataset_id})["result"]["resources"]

    def resource_id(self) -> str:
        """The dataset's first resource that can be asked for records."""
        ids = (str(r["id"]) for r in self._resources() if r.get("datastore_active"))
        if (found := next(ids, None)) is None:
            raise ValueError(f"{self.config.dataset_id} has no resource with an active datastore")
        return found

    def _datastore(self, spark: SparkSession) -> DataFrame:
        """The records, whose types come from all of them, in the order of their pages."""
        spark.dataSource.register(PagedRecords)
        asked = spark.read.format(PagedRecords.name()).options(**self.client.options(), resource=self.resource_id(), page=self.page).load()
        # A page is fetched once: what comes is kept as text, with its place.
        path = scratch(spark, "pages")
        asked.select(F.concat(F.lit('{"page":'), "page", F.lit(',"at":'), "at", F.lit(',"record":'), "record", F.lit("}"))).write.text(path)
        lines = spark.read.json(path)
        if not lines.columns:
            delete(spark, path)
            return spark.createDataFrame([], "")
        out = lines.orderBy("page", "at").select("record.*")
        out.reads = [_Scratch(spark, path)]
        return out

    def csv_urls(self) -> list[str]:
        """CSV resources with a year from the start year on in their names."""
        named = ((r, _YEAR.search(r.get("name") or "")) for r in self._resources() if (r.get("format") or "").upper() == "CSV")
        return [r["url"] for r, year in named if year and int(year[1]) >= self.config.year_start]

    def _bulk_csv(self, spark: SparkSession) -> DataFrame:
        frames, folder = [], scratch(spark, "files")
        reads = [_Scratch(spark, folder)]
        for k, url in enumerate(self.csv_urls()):
            path = f"{folder}/{k}.csv"
            if not write_text(spark, path, self.client.stream(url)):
                continue
            rows = read_csv(spark, path)
            reads.append(_Scratch(spark, rows.scratch_path))
            if rows.columns:
                frames.append(infer_types(rows))
        out = diagonal_union(frames) if frames else spark.createDataFrame([], "")
        out.reads = reads
        return out


class _Scratch:
    """What ``forget`` takes."""

    def __init__(self, spark: SparkSession, path: str):
        self.sparkSession, self.scratch_path = spark, path


SOURCES: dict[str, PortalSource] = {key: PortalSource(config) for key, config in SOURCE_CONFIGS.items()}
