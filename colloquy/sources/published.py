"""A table that is published whole: readers see the run before or the run after, never a mix.

Rows lie in buckets by a hash of the key, each bucket in a folder of its own. A run writes new folders for the buckets it changes,
then commits a manifest that names one folder for each bucket. The manifest's name is its number, and it appears by a rename that fails if the
name is taken, so of two runs from the same manifest one fails and nothing is lost. The highest manifest is the
table. What a run leaves behind that failed before its manifest is named by nobody; clean() removes it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import upserted


class Conflict(RuntimeError):
    """Another run has published since this one read the table."""


@dataclass
class Manifest:
    number: int = 0
    buckets: dict[int, str] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)  # the last batch of each stream


class Published:
    def __init__(self, spark: SparkSession, base: str, schema: str, keys: list[str], buckets: int = 256):
        self.spark, self.base, self.schema, self.keys, self.buckets = spark, base.rstrip("/"), schema, keys, buckets
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # ---- manifests ----

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _files(self):
        path = self._path("manifests")
        return path.getFileSystem(self.conf)

    def _numbers(self) -> list[int]:
        fs, path = self._files(), self._path("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, number: int | None = None) -> Manifest:
        """The newest one, or the one of a number; an empty one before the first run."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return Manifest()
            number = numbers[-1]
        [line] = self.spark.read.text(f"{self.base}/manifests/{number:012d}").collect()
        got = json.loads(line.value)
        return Manifest(got["number"], {int(k): v for k, v in got["buckets"].items()}, {int(k): v for k, v in got["rows"].items()}, got["writers"])

    def _commit(self, new: Manifest) -> None:
        fs = self._files()
        part, to = self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/{new.number:012d}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(part), context.makeQualified(to), options)
        except Exception as error:
            fs.delete(part, False)
            if fs.exists(to):
                raise Conflict(f"manifest {new.number} is taken") from error
            raise

    # ---- rows ----

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        m = manifest or self.manifest()
        folders = [f"{self.base}/{m.buckets[b]}" for b in sorted(m.buckets)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _publish(self, before: Manifest, rows: DataFrame, touched: list[int], writer: str | None, batch: int) -> Manifest:
        """rows: all rows of the touched buckets. Buckets that get no rows leave the manifest."""
        folder = f"data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.base}/{folder}")
        written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.base}/{folder}")
        counts = {r.bucket: r["count"] for r in written.groupBy("bucket").count().collect()}  # one row per bucket
        kept = {b: f for b, f in before.buckets.items() if b not in touched}
        sizes = {b: n for b, n in before.rows.items() if b in kept}
        new = Manifest(before.number + 1, kept | {b: f"{folder}/bucket={b}" for b in counts}, sizes | counts, before.writers | ({writer: batch} if writer else {}))
        self._commit(new)
        return new

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.b for r in rows.select(self._bucket().alias("b")).distinct().collect())  # at most one row per bucket

    def _of(self, before: Manifest, touched: list[int]) -> DataFrame:
        return self.read(Manifest(before.number, {b: f for b, f in before.buckets.items() if b in touched}))

    def seen(self, writer: str, batch: int) -> bool:
        """Whether a stream's batch has been published."""
        return self.manifest().writers.get(writer, -1) >= batch

    def upsert(self, rows: DataFrame, order: str, writer: str | None = None, batch: int = 0) -> Manifest:
        """Of rows with equal keys, those of the run replace older ones; among its own the one with the latest `order` stays. A batch that its writer has published
        already changes nothing. Only buckets with new rows are written."""
        before = self.manifest()
        if writer and before.writers.get(writer, -1) >= batch:
            return before
        touched = self._touched(rows)
        return self._publish(before, upserted(self._of(before, touched), rows, self.keys, order), touched, writer, batch)

    def replace(self, rows: DataFrame, whole: list[str], writer: str | None = None, batch: int = 0) -> Manifest:
        """A rerun: all rows of the values of `whole` (some of the keys) that occur in rows go, and rows come instead, so rows that the rerun no longer makes
        leave no orphans. The table's keys must be `whole`, so that these rows share a bucket."""
        if whole != self.keys:
            raise ValueError("the table has to be dealt by the columns that are replaced as a whole")
        before = self.manifest()
        if writer and before.writers.get(writer, -1) >= batch:
            return before
        touched = self._touched(rows)
        stay = self._of(before, touched).join(rows.select(*whole).distinct(), whole, "left_anti")
        return self._publish(before, stay.unionByName(rows.select(*stay.columns)), touched, writer, batch)

    def clean(self, keep: int = 2) -> int:
        """Removes manifests but the last `keep`, and folders that none of these names. To be run while nobody publishes. Returns how many folders went."""
        numbers = self._numbers()
        named = {folder for n in numbers[-keep:] for folder in self.manifest(n).buckets.values()}
        fs, gone = self._files(), 0
        for n in numbers[:-keep]:
            fs.delete(self._path(f"manifests/{n:012d}"), False)
        data = self._path("data")
        for run in fs.listStatus(data) if fs.exists(data) else []:
            name = f"data/{run.getPath().getName()}"
            own = [f for f in named if f.startswith(name + "/")]
            if not own:
                gone += fs.delete(run.getPath(), True)
                continue
            for part in fs.listStatus(run.getPath()):
                if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in own:
                    gone += fs.delete(part.getPath(), True)
        return gone
