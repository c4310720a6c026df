"""A store of JSON logs: files pruned by the time in their names, and compacted into Parquet that a manifest names.

A file is named by the time it is written, and holds events up to that time, so
files named before a time hold none after it and are not opened. Compaction
writes the events of many files as one table and then puts a manifest, numbered
and never changed, that lists all tables and the files they stand for: readers
follow the last manifest, so they see every event once before and after.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources import sinks, tables

NAME = re.compile(r"log_(\d{8}_\d{6}(?:_\d{3})?)\D.*json$")


class LogStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _list(self, pattern: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        return sorted(str(s.getPath()) for s in place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place) or [])

    def append(self, events: list[dict]) -> str:
        return sinks.append_logs(self.spark, events, self.folder)

    def manifest(self) -> dict:
        """The last manifest: number, tables (path, until: the name's time of their newest file) and files."""
        found = self._list("_manifest_*.json")
        if not found:
            return {"number": 0, "tables": [], "files": []}
        return json.loads(sinks.get(self.spark, found[-1]))

    @staticmethod
    def written(path: str) -> str | None:
        """The time in a file's name, to the millisecond, as text that sorts by time; None for other files."""
        named = NAME.search(path.rsplit("/", 1)[-1])
        return f"{named[1]}_000"[:19] if named else None

    def files(self, since: str | None = None, manifest: dict | None = None) -> list[str]:
        """Files that no table stands for yet, named at or after a time (or without one): those that can hold events since then."""
        gone = set((manifest or self.manifest())["files"])
        least = f"{datetime.fromisoformat(since):%Y%m%d_%H%M%S}" if since else ""
        return [f for f in self._list("*.json") if f.rsplit("/", 1)[-1] not in gone and not f.rsplit("/", 1)[-1].startswith("_") and (self.written(f) or "9") >= least]

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """Events, as tables.load_logs() gives them, in a range of time, ends included."""
        manifest = self.manifest()
        least = f"{datetime.fromisoformat(since):%Y%m%d_%H%M%S}" if since else ""
        parts = [self.spark.read.parquet(f"{self.folder}/{t['path']}") for t in manifest["tables"] if t["until"] >= least]
        if files := self.files(since, manifest):
            parts.append(tables.load_logs(self.spark, files))
        if not parts:
            return self.spark.createDataFrame([], tables.LOG_SCHEMA + ", file string, ts timestamp_ntz").drop("_corrupt")
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        if since:
            found = found.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        return found.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz")) if until else found

    def compact(self, before: str) -> int:
        """Puts the events of files named before a time into a table; how many files. Files can be deleted once no reader has an older manifest."""
        manifest = self.manifest()
        most = f"{datetime.fromisoformat(before):%Y%m%d_%H%M%S}"
        files = [f for f in self.files(manifest=manifest) if (w := self.written(f)) and w < most]
        if not files:
            return 0
        path = f"_tables/{uuid.uuid4().hex}"
        tables.load_logs(self.spark, files).repartitionByRange(F.col("ts")).write.parquet(f"{self.folder}/{path}")
        number = manifest["number"] + 1
        fresh = {"number": number, "tables": [*manifest["tables"], {"path": path, "until": max(map(self.written, files))}], "files": [*manifest["files"], *[f.rsplit("/", 1)[-1] for f in files]]}
        sinks.put(self.spark, f"{self.folder}/_manifest_{number:09d}.json", json.dumps(fresh))  # fails if another compaction was first
        return len(files)
