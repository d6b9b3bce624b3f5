"""A table that is upserted by key: rows lie in buckets of the key's hash, a batch rewrites only the buckets it touches.

A version is a small manifest that says in which folder each bucket's rows are. A reader reads one manifest and the folders
it names, so it sees all of a version or nothing of it, and older versions stay readable. A writer puts its buckets in a
folder of its own and then creates the next version's manifest; if another writer was first, it merges again on top of that.
A batch that was applied before is known by its name and is not applied again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Times that a writer merges again because others were first.
TRIES = 20


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _fs(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        """schema, buckets {number: folder} and the names of the batches in the version."""
        if version < 0:
            return {"schema": None, "buckets": {}, "batches": []}
        rows = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _publish(self, version: int, manifest: dict) -> bool:
        """Create a version's manifest; false if it exists. It is written aside and renamed, so no reader sees a part of it."""
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        fs, temporary = self._fs(aside)
        out = fs.create(temporary, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        _, lock = self._fs(f"{self.path}/claims/{version}")
        fs.mkdirs(lock.getParent())
        if not fs.createNewFile(lock):
            return False
        _, target = self._fs(f"{self.path}/versions/{version}.json")
        fs.mkdirs(target.getParent())
        return fs.rename(temporary, target)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        from pyspark.sql.types import StructType

        folders = sorted({f for b, f in manifest["buckets"].items() if buckets is None or int(b) in buckets})
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        current = [f"{f}/_bucket={b}" for b, f in manifest["buckets"].items() if f in folders and (buckets is None or int(b) in buckets)]
        return self.spark.read.schema(schema).parquet(*current) if current else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest one by default; null before the first."""
        known = self.versions()
        return self._rows(self._manifest(version if version is not None else known[-1])) if known else None

    def upsert(self, batch: DataFrame, order: Column, name: str | None = None, deleted: str | None = None) -> int:
        """Put the last row of each key by ``order`` in place of what the table has; rows with the flag ``deleted`` remove
        their key. Returns the version. A batch ``name`` that the table has seen changes nothing."""
        last = Window.partitionBy(self.key).orderBy(order.desc())
        own = batch.filter(F.col(self.key).isNotNull()).withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
        own = own.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        kept = own.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else own
        touched = sorted(r["_bucket"] for r in own.select("_bucket").distinct().collect())  # BUCKETS at most
        for _ in range(TRIES):
            known = self.versions()
            before = known[-1] if known else -1
            manifest = self._manifest(before)
            if name is not None and name in manifest["batches"]:
                return before
            schema = kept.drop("_bucket").schema
            old = self._rows(manifest, touched)
            rows = kept
            if old is not None:
                stay = old.join(own.select(self.key), self.key, "left_anti").withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
                rows = kept.unionByName(stay, allowMissingColumns=True)
                schema = rows.drop("_bucket").schema
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
            full = {r["_bucket"] for r in rows.select("_bucket").distinct().collect()}
            buckets = {b: f for b, f in manifest["buckets"].items() if int(b) not in touched} | {str(b): folder for b in touched if b in full}
            if self._publish(before + 1, {"schema": schema.json(), "buckets": buckets, "batches": [*manifest["batches"], *([name] if name else [])]}):
                return before + 1
        raise RuntimeError(f"{TRIES} other writers were first")
