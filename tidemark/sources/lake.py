"""Tables in a lake: namespaces, checked schemas, partitioned Parquet files, and snapshots that list the live ones.

A table is a folder: table.json (schema, keys, version column, partitioning), data/write=<id>/<partitions>/
files, lists/<id> (Parquet: path and length of the live files) and snapshots, each a numbered file that names
its list and is created only if its number is free. So a writer that was overtaken gets Conflict and changes
nothing, and readers see whole snapshots. Lists are Parquet, as a table may have millions of files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tables import compaction_plan, orphans
from .commit import Conflict, ManifestStore, StoreError

LISTED = "path string, length long"


def _store(spark: SparkSession, folder: str, name: str) -> ManifestStore:
    return ManifestStore(folder, name, spark)


def _plain(path):
    """One form of a local path, as the sources of Spark write it with one slash or with three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create_namespace(self, name: str) -> None:
        """Conflict if it is there."""
        _store(self.spark, f"{self.root}/{name}", "namespace").create(1, json.dumps({"name": name}).encode())

    def create_table(self, namespace: str, name: str, schema: StructType, keys: Sequence[str] = (), version: str | None = None, partition_by: Sequence[str] = ()) -> Table:
        """An entity table has keys and a version column, an append table neither. Unknown or nullable keys are errors."""
        if not _store(self.spark, f"{self.root}/{namespace}", "namespace").numbers():
            raise StoreError(f"no namespace {namespace}")
        fields = {f.name: f for f in schema.fields}
        if len(fields) < len(schema.fields):
            raise ValueError("a column is there twice")
        for c in (*keys, *partition_by, *([version] if version else [])):
            if c not in fields:
                raise ValueError(f"no column {c}")
        if bool(keys) != bool(version):
            raise ValueError("keys and a version column belong together")
        if version and fields[version].dataType.simpleString() not in ("int", "bigint", "timestamp", "timestamp_ntz"):
            raise ValueError("a version is a number or a time")
        spec = {"schema": schema.jsonValue(), "keys": list(keys), "version": version, "partition_by": list(partition_by)}
        _store(self.spark, f"{self.root}/{namespace}/{name}", "table").create(1, json.dumps(spec).encode())
        return self.table(namespace, name)

    def table(self, namespace: str, name: str) -> Table:
        return Table(self.spark, f"{self.root}/{namespace}/{name}")


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spec = json.loads(_store(spark, path, "table").read(1))
        self.schema, self.keys, self.version, self.partition_by = StructType.fromJson(spec["schema"]), spec["keys"], spec["version"], spec["partition_by"]
        self.snapshots = _store(spark, f"{path}/snapshots", "snapshot")
        self.number = max(self.snapshots.numbers(), default=0)

    def files(self) -> DataFrame:
        """The live files of the snapshot that this object knows."""
        if not self.number:
            return self.spark.createDataFrame([], LISTED)
        return self.spark.read.schema(LISTED).parquet(json.loads(self.snapshots.read(self.number))["list"])

    def _commit(self, files: DataFrame) -> None:
        """files become the next snapshot; Conflict if another writer was first."""
        path = f"{self.path}/lists/{uuid.uuid4().hex}"
        files.write.parquet(path)
        self.snapshots.create(self.number + 1, json.dumps({"list": path}).encode())
        self.number += 1

    def _found(self, folder: str) -> DataFrame:
        """Files of a folder by listing; their contents are not read."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        return listed.select(_plain(F.col("path")).alias("path"), "length")

    def _write(self, rows: DataFrame) -> DataFrame:
        folder = f"{self.path}/data/write={uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.partitionBy(*self.partition_by).parquet(folder)
        return self._found(folder)

    def append(self, rows: DataFrame) -> None:
        if {f.name: f.dataType for f in rows.schema.fields} != {f.name: f.dataType for f in self.schema.fields}:
            raise ValueError("the rows don't have the table's schema")
        self._commit(self.files().unionByName(self._write(rows)))

    def _read(self, files: DataFrame) -> DataFrame:
        """Spark's readers take a list of paths, which the driver holds as it does for any table."""
        paths = [r.path for r in files.select("path").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def read(self) -> DataFrame:
        """The live rows. Filters on partition columns leave out files."""
        return self._read(self.files()).select(*self.schema.names)

    def file_stats(self, columns: Sequence[str]) -> DataFrame:
        """Rows, and least and largest values of columns, for each live file."""
        rows = self._read(self.files()).select(*self.schema.names, F.col("_metadata.file_path").alias("path"))
        stats = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
        return rows.groupBy("path", *self.partition_by).agg(F.count("*").alias("n_rows"), *stats)

    def compact(self, target: int = 128 << 20) -> int:
        """Rewrites small files as one for each bin of about target bytes in their partition; gives the number of files rewritten."""
        live = self.files().withColumn("part", F.regexp_extract("path", r"/data/write=[^/]*/(.*/)?[^/]*$", 1)).filter(F.col("length") < target)
        plan = compaction_plan(live, "path", "length", target, ["part"])
        several = plan.join(plan.groupBy("part", "bin").count().filter("count > 1").drop("count"), ["part", "bin"]).select("path", "length", F.concat_ws(":", "part", "bin").alias("bin"))
        n = several.count()
        if n:
            rows = self._read(several).select("*", _plain(F.col("_metadata.file_path")).alias("_path"))
            dealt = rows.join(several.select(F.col("path").alias("_path"), "bin"), "_path").repartition(F.col("bin"))
            new = self._write(dealt)
            self._commit(self.files().join(several.select("path"), "path", "left_anti").unionByName(new))
        return n

    def prune(self) -> int:
        """Deletes files of data that the newest snapshot doesn't list; gives their number. No writer may be at work meanwhile."""
        if max(self.snapshots.numbers(), default=0) != self.number:
            raise Conflict(self.path)
        gone, n = orphans(self._found(f"{self.path}/data"), self.files(), "path"), 0
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for r in gone.toLocalIterator():
            path = hadoop.Path(r.path)
            n += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)
        return n
