"""Versioned tables in the shared folder: layers of the engine, copy-on-write merges and exactly-once appends.

Rows lie in Parquet folders that are never changed. What a table holds is said by a small manifest; a version is published by moving a
finished manifest to the next free number, which the file system refuses if another job was first. So

* a reader sees one whole version, also while a newer one is written;
* a job that is lost before it publishes leaves the version before it, and unread folders;
* of two jobs that change a table at once one publishes, and the other looks again at what is stored and merges anew.

A manifest names one list of folders for each value of the partition column. Merges read and rewrite only the partitions that new rows
touch; appends add a folder to them. The number of partitions (buckets, months) is the caller's choice and bounds the manifest.
"""

from __future__ import annotations

import gc
import hashlib
import json
import pkgutil
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.storage import file_system, work_root

TRIES = 20


def publish(spark: SparkSession, target: str, text: str) -> bool:
    """Write ``text`` as a new file; False if the file is there already. The move is one step of the file system."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    path, files = file_system(spark, target)
    files.mkdirs(path.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}.draft")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    try:
        context.rename(draft, path, gateway.new_array(rename, 0))
        return True
    except Exception as error:  # a Java error of another kind is not hidden
        files.delete(draft, False)
        if "AlreadyExists" in str(error):
            return False
        raise


def read_text(spark: SparkSession, target: str) -> str | None:
    """The text of a small file, None where there is none."""
    path, files = file_system(spark, target)
    if not files.exists(path):
        return None
    return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(files.open(path), "UTF-8")


@lru_cache(maxsize=1)
def code_version() -> str:
    """A digest of the modules whose results are stored."""
    digest = hashlib.sha256()
    for package in ("tidewatch", "tidewatch.sources", "tidewatch.functions", "tidewatch.operators", "tidewatch.plans"):
        module = __import__(package, fromlist=["__path__"])
        for info in sorted(pkgutil.iter_modules(module.__path__), key=lambda i: i.name):
            if not info.ispkg:
                digest.update(pkgutil.get_data(package, f"{info.name}.py") or b"")
    return digest.hexdigest()[:16]


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the files under ``paths``: names, lengths and times of change, as the driver lists them to plan a scan."""
    found = []
    for where in paths:
        path, files = file_system(spark, where)
        listing = files.listFiles(path, True)
        while listing.hasNext():
            status = listing.next()
            if not status.getPath().getName().startswith(("_", ".")):
                found.append(f"{status.getPath().toUri().getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def forget(spark: SparkSession) -> None:
    """Collect the driver's garbage. Spark removes the shuffle files and broadcasts of a finished job when its driver has collected what refers to them,
    and a heap that is never collected grows with the plans; a query that makes many layers would keep those of all of them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def layer(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame], *cluster: str, params: str = "") -> DataFrame:
    """The named layer over the files of ``inputs`` as they are now: a changed file gives another version.

    A version is written once and shared by all applications of this code that share the folder. Rows are sorted within
    files by the columns ``cluster``, so that row groups can be skipped.
    """
    key = hashlib.sha256("|".join([name, params, *inputs]).encode()).hexdigest()[:16]
    where = f"{work_root(spark)}/layers/{name}-{key}"
    target = f"{where}/{fingerprint(spark, *inputs)}-{code_version()}.json"
    said = read_text(spark, target)
    if said is None:
        df, folder = make(), f"{where}/{uuid.uuid4().hex}"
        (df.sortWithinPartitions(*cluster) if cluster else df).write.parquet(folder)
        publish(spark, target, json.dumps({"folder": folder, "schema": df.schema.json()}))
        said = read_text(spark, target)  # of two writers, the first one's
        del df
        forget(spark)
    entry = json.loads(said)
    return spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["folder"])


def retire(spark: SparkSession, name: str, inputs: list[str], params: str = "") -> int:
    """Remove all versions of a layer but the one over the files as they are now; no job may still read the others. Returns how many went."""
    key = hashlib.sha256("|".join([name, params, *inputs]).encode()).hexdigest()[:16]
    where, files = file_system(spark, f"{work_root(spark)}/layers/{name}-{key}")
    keep = f"{fingerprint(spark, *inputs)}-{code_version()}.json"
    current = read_text(spark, f"{where.toString()}/{keep}")
    folder = json.loads(current)["folder"].rsplit("/", 1)[-1] if current else None
    gone = 0
    for status in files.listStatus(where) if files.exists(where) else []:
        if status.getPath().getName() not in (keep, folder):
            gone += status.isDirectory()
            files.delete(status.getPath(), True)
    return gone


class Table:
    """Rows at ``path`` under numbered versions, partitioned by the column ``partition``."""

    def __init__(self, spark: SparkSession, path: str, partition: str):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    # ---- reading

    def version(self) -> int:
        """The newest version, -1 before the first."""
        path, files = file_system(self.spark, f"{self.path}/versions")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return {"parts": {}, "batches": {}, "schema": None}
        return json.loads(read_text(self.spark, f"{self.path}/versions/{version:012d}.json"))

    def read(self, parts: list | None = None, version: int | None = None) -> DataFrame | None:
        """The rows of a version, of the partitions ``parts`` only if given; None before the first version."""
        return self._rows(self.manifest(version), parts)

    def _rows(self, manifest: dict, parts: list | None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        wanted = manifest["parts"] if parts is None else {k: v for k, v in manifest["parts"].items() if k in {str(p) for p in parts}}
        folders = [f for held in wanted.values() for f in held]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # ---- changing

    def _write(self, rows: DataFrame, keys: list[str]) -> dict[str, list[str]]:
        """Folders of ``rows`` by partition (none where one of ``keys`` has no rows), one Parquet write; the partition column stays in the files."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn("__part", F.col(self.partition).cast("string")).repartition("__part").write.partitionBy("__part").parquet(folder)
        path, files = file_system(self.spark, folder)
        there = {s.getPath().getName().removeprefix("__part=") for s in files.listStatus(path) if s.isDirectory()}
        return {k: [f"{folder}/__part={k}"] if k in there else [] for k in {*keys, *there}}

    def _keys(self, new: DataFrame) -> list[str]:
        return [r[0] for r in new.select(F.col(self.partition).cast("string")).distinct().collect()]  # partitions, not rows

    def has(self, batch: tuple[str, int]) -> bool:
        """Whether the batch is in the newest version."""
        return self.manifest()["batches"].get(batch[0], -1) >= batch[1]

    def _change(self, touched: Callable[[], list[str]], schema: T.StructType, merge: Callable, batch: tuple[str, int] | None) -> int:
        """Merge into the partitions ``touched`` of the newest version until a version is published; returns its number, or the newest one's
        if the batch is in it already. A table without rows takes them all, whichever partitions they have."""
        keys: list[str] | None = None
        for _ in range(TRIES):
            at = self.version()
            manifest = self.manifest(at)
            if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
                return at
            parts = {k: list(v) for k, v in manifest["parts"].items()}
            if parts and keys is None:
                keys = touched()
            if keys or not parts:
                for k, folders in merge(self._rows(manifest, keys or []), parts, keys or []).items():
                    parts[k] = folders
            entry = {
                "parts": {k: v for k, v in parts.items() if v}, "batches": manifest["batches"] | ({batch[0]: batch[1]} if batch else {}),
                "schema": manifest["schema"] or schema.json(),
            }
            if publish(self.spark, f"{self.path}/versions/{at + 1:012d}.json", json.dumps(entry)):
                return at + 1
        raise RuntimeError(f"{self.path} changes faster than it can be merged")

    def upsert(self, new: DataFrame, on: list[str], batch: tuple[str, int] | None = None) -> int:
        """Rows of ``new`` take the place of stored ones with their key; only their partitions are read and rewritten. ``new`` has a key once."""

        def merge(old: DataFrame | None, parts: dict, keys: list[str]) -> dict:
            return self._write(old.join(new.select(*on), on, "left_anti").unionByName(new) if parts else new, keys)

        return self._change(lambda: self._keys(new), new.schema, merge, batch)

    def insert_absent(self, new: DataFrame, on: list[str], batch: tuple[str, int] | None = None) -> int:
        """Add the rows of ``new`` whose key is not stored, one for each key; stored files stay as they are. A key lies in one partition.

        ``batch`` (name of a stream, number) is kept in the manifest of the version that holds its rows, so a batch that comes again adds nothing.
        """

        def merge(old: DataFrame | None, parts: dict, keys: list[str]) -> dict:
            rows = new.dropDuplicates(on)
            written = self._write(rows.join(old.select(*on), on, "left_anti") if parts else rows, keys)
            return {k: [*parts.get(k, []), *folders] for k, folders in written.items()}

        return self._change(lambda: self._keys(new), new.schema, merge, batch)

    def replace(self, new: DataFrame, keys: list[str], stays: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """In the partitions ``keys``: of the stored rows those that ``stays`` leaves, and the rows of ``new``, which lie in them."""
        keys = [str(k) for k in keys]

        def merge(old: DataFrame | None, parts: dict, keys: list[str]) -> dict:
            return self._write(stays(old).unionByName(new) if parts else new, keys)

        return self._change(lambda: keys, new.schema, merge, batch)
