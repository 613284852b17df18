"""A table with one row per key that batches are merged into, last write wins.

The rows lie in Parquet folders by a hash of their key.  A batch reads and rewrites only the buckets that it
has keys of, beside the old ones; a manifest, put in place by one rename, then names the
folders that hold from now on.  A batch that fails anywhere before leaves the table as it was,
a batch that comes again is known by its number, and readers always see a whole version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import place_of


class KeyedTable:
    """``key`` names the columns that identify a row, ``order`` those by which the last one is known.

    Of rows with equal order the later batch wins, within a batch the greatest by all columns.  ``removed`` is a
    condition on a row that takes its key out of the table; a later row may bring it back.
    Null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], *, buckets: int = 64, removed: str | None = None):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self.buckets, self.removed = buckets, removed

    def manifest(self) -> dict:
        """The latest manifest: version, buckets and their folders, schema, and the last batch of each stream."""
        system, place = place_of(self.spark, f"{self.path}/manifests")
        if not system.exists(place):
            return {"version": 0, "folders": {}, "schema": None, "batches": {}}
        last = max(f.getPath().getName() for f in system.listStatus(place) if f.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{last}", wholetext=True).first()[0])

    def read(self) -> DataFrame | None:
        """The table as of now; None before the first batch."""
        now = self.manifest()
        if not now["schema"]:
            return None
        rows = self._rows(now, now["folders"].values())
        return rows.filter(f"not coalesce({self.removed}, false)") if self.removed else rows

    def _rows(self, manifest: dict, folders) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, number: int, stream: str = "") -> None:
        """Merges a batch; any error, in reading the old rows too, is the caller's and changes nothing."""
        now = self.manifest()
        if number <= now["batches"].get(stream, -1):
            return
        version = now["version"] + 1
        folder = f"rows/{version:012d}-{uuid.uuid4().hex[:8]}"
        columns = batch.columns
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in self.key]), F.lit(self.buckets)).cast("int")
        new = batch.withColumn("_bucket", bucket)
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # buckets at most
        both = new.withColumn("_new", F.lit(1))
        held = [now["folders"][str(b)] for b in touched if str(b) in now["folders"]]
        if held:
            old = self._rows(now, held).select(*[F.col(f"`{c}`") for c in columns])
            both = both.unionByName(old.withColumn("_bucket", bucket).withColumn("_new", F.lit(0)))
        values = F.struct(*[F.col(f"`{c}`") for c in columns if c not in self.key])
        latest = F.struct(*[F.col(f"`{c}`") for c in self.order], F.col("_new"), values)
        last = both.groupBy("_bucket", *[f"`{c}`" for c in self.key]).agg(F.max_by(values, latest).alias("_v"))
        last.select("_bucket", *[f"`{c}`" for c in self.key], "_v.*").select("_bucket", *[f"`{c}`" for c in columns]).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        folders = now["folders"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
        self._put({"version": version, "folders": folders, "schema": batch.schema.jsonValue(), "batches": now["batches"] | {stream: number}})

    def _put(self, manifest: dict) -> None:
        name = f"{self.path}/manifests/{manifest['version']:012d}"
        system, draft = place_of(self.spark, f"{name}.{uuid.uuid4().hex}.draft")
        out = system.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode("utf-8")))
        finally:
            out.close()
        if not system.rename(draft, place_of(self.spark, f"{name}.json")[1]):
            raise RuntimeError(f"Version {manifest['version']} of {self.path} was written by someone else.")

    def vacuum(self) -> int:
        """Deletes the folders and manifests that the latest manifest does not need; returns how many folders went."""
        now = self.manifest()
        system, place = place_of(self.spark, f"{self.path}/rows")
        used = {f.split("/_bucket=")[0].rpartition("/")[2] for f in now["folders"].values()}
        gone = [f.getPath() for f in system.listStatus(place) if f.getPath().getName() not in used] if system.exists(place) else []
        for p in gone:
            system.delete(p, True)
        system, place = place_of(self.spark, f"{self.path}/manifests")
        for f in system.listStatus(place) if system.exists(place) else []:
            if f.getPath().getName() < f"{now['version']:012d}":
                system.delete(f.getPath(), False)
        return len(gone)
