"""A versioned score store: parts in buckets of voxels, and a manifest, written last, that says which parts a version has."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["band", "recording_id"]
MANIFEST = "version long, part string, band string, recording_id string"


class ScoreStore:
    """Scores (band, recording_id, `key`, ...) under a path that driver and executors share.

    A write makes a new part, whose files are buckets of `key`, and then a new version of the manifest: what the part holds
    of a band and recording replaces what older parts do. Nothing that a version names is ever changed, so a reader
    never meets half a write, a write that fails leaves the store as it was, and old versions stay readable. Two stores
    with as many buckets are joined on `key` without a shuffle. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, key: str = "voxel_id"):
        self.spark, self.path, self.buckets, self.key = spark, path.rstrip("/"), buckets, key

    def manifest(self, version: int | None = None) -> DataFrame:
        """part, band and recording_id of a version, the last one if none is named; empty before the first write."""
        found = self._manifests()
        last = version if version is not None else (found.agg(F.max("version")).first()[0] or 0)
        return found.where(F.col("version") == last).select("part", *KEYS)

    def version(self) -> int:
        """The last version, 0 before the first write."""
        return self._manifests().agg(F.max("version")).first()[0] or 0

    def _manifests(self) -> DataFrame:
        try:
            # a manifest's rows become visible when their write is committed, all at once
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").where("part is not null")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def write(self, scores: DataFrame) -> int:
        """Add a part and return the new version; bands and recordings that it holds replace their old selves whole."""
        part, now = f"part-{uuid.uuid4().hex}", self.version()
        name = self._table(part)
        rows = scores.repartition(self.buckets, self.key)  # a file a bucket
        rows.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/{part}").saveAsTable(name)
        held = self.spark.table(name).select(*KEYS).distinct()
        kept = self.manifest(now).join(held, KEYS, "left_anti")
        rows = kept.unionByName(held.select(F.lit(part).alias("part"), *KEYS)).select(F.lit(now + 1).cast("long").alias("version"), "part", *[F.col(k).cast("string") for k in KEYS])
        rows.coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return now + 1

    def read(self, version: int | None = None) -> DataFrame:
        """The scores of a version; a part all of whose bands and recordings still count is read as it lies."""
        rows = self.manifest(version).collect()  # a row a band and recording
        parts = sorted({r.part for r in rows})
        if not parts:
            raise ValueError("the store is empty")
        found = None
        for part in parts:
            table = self._registered(part)
            live = {(r.band, r.recording_id) for r in rows if r.part == part}
            every = {(str(r.band), str(r.recording_id)) for r in table.select(*KEYS).distinct().collect()}
            if every - live:
                gone = self.spark.createDataFrame(sorted(every - live), "band string, recording_id string")
                on = [table[k].cast("string") == gone[k] for k in KEYS]
                table = table.join(F.broadcast(gone), on, "left_anti")  # as many rows as the manifest has
            found = table if found is None else found.unionByName(table)
        return found

    def pending(self, todo: DataFrame) -> DataFrame:
        """Rows of todo whose band and recording the last version doesn't have: the manifest is read, not the scores."""
        done = self.manifest().select(*KEYS)
        return todo.join(done, [todo[k].cast("string") == done[k] for k in KEYS], "left_anti")

    def _table(self, part: str) -> str:
        return f"gridscore_{part.replace('-', '_')}"

    def _registered(self, part: str) -> DataFrame:
        """The part as a bucketed table: the catalogue of a new session doesn't know it yet, but its files are in buckets."""
        name, folder = self._table(part), f"{self.path}/{part}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(folder).schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(name)
