"""Stored intermediates with a manifest: reused while their inputs stay the same, replaced and deleted when not.

A cut is a table in the folder of ``spark.checkpoint.dir``. Its manifest row names the cut, the table and
a fingerprint of the files it was made from (paths, sizes, modification times, summed by Spark over the
listing) and of the version the caller gives (parameters). The manifest is a folder of one small file a
cut, so another session finds the cuts of an earlier one. Nothing is kept in memory but the manifest rows.
"""

from __future__ import annotations

import dataclasses
import hashlib
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.plans.session import ensure_checkpoint_dir

MANIFEST = "cuts-manifest"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def fingerprint(spark: SparkSession, inputs: Iterable[str], version: str = "") -> str:
    """Of the files under ``inputs`` and of ``version``. One job over the listing; contents are not read."""
    paths = sorted(set(inputs))
    if not paths:
        return version
    listed = spark.read.format("binaryFile").load(paths).select("path", "modificationTime", "length")
    seen = listed.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()
    return ":".join([*map(str, seen), version])


def table_name(path: str) -> str:
    """The name a bucketed table at ``path`` has in the session's catalog."""
    return "cut_" + hashlib.md5(path.encode()).hexdigest()


def write(df: DataFrame, path: str, key: str | None = None, buckets: int = 0, dealt: bool = False) -> None:
    """``df`` as Parquet at ``path``; with a ``key``, one file a bucket.

    ``dealt``: ``df`` lies by ``key`` in as many partitions as there are buckets, so it is written where it is.
    """
    if key is None:
        df.write.parquet(path)
        return
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table_name(path))


def read(spark: SparkSession, path: str, key: str | None = None, buckets: int = 0) -> DataFrame:
    """What :func:`write` stored. The catalog of another session learns the buckets anew."""
    if key is None:
        return spark.read.parquet(path)
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def source_files(*frames: DataFrame) -> list[str]:
    """The folders of the files behind some frames."""
    return sorted({f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()})


@dataclasses.dataclass(frozen=True)
class Cut:
    name: str
    path: str
    fingerprint: str


class Cuts:
    """The cuts of one checkpoint folder (or of a folder of their own)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or ensure_checkpoint_dir(spark)).rstrip("/")
        self.made: dict[str, Cut] = {}
        if exists(spark, f"{self.root}/{MANIFEST}"):
            noted = spark.read.schema("name string, path string, fingerprint string").option("recursiveFileLookup", "true")
            rows = noted.json(f"{self.root}/{MANIFEST}").collect()
            self.made = {r["name"]: Cut(*r) for r in rows}

    def _note(self, name: str) -> str:
        return f"{self.root}/{MANIFEST}/{name}"

    def table(self, name: str, build: Callable[[], DataFrame], inputs: Iterable[str] = (), version: str = "",
              key: str | None = None, buckets: int = 0, dealt: bool = False) -> DataFrame:
        """The stored result of ``build``; built anew, and the old table deleted, if inputs or version changed.

        The manifest names a table only after it is complete, so a run that dies half-way leaves a folder
        that no manifest names, and the next run builds the cut again. With a ``key`` the table is bucketed
        by it: joins and aggregations by the key, with tables of as many ``buckets``, need no exchange.
        ``dealt``: see :func:`write`.
        """
        now = fingerprint(self.spark, inputs, f"{version}:{key}:{buckets}" if key else version)
        old = self.made.get(name)
        if old is not None and old.fingerprint == now and exists(self.spark, f"{old.path}/_SUCCESS"):
            return read(self.spark, old.path, key, buckets)
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        write(build(), path, key, buckets, dealt)
        cut = Cut(name, path, now)
        note = self.spark.createDataFrame([dataclasses.astuple(cut)], "name string, path string, fingerprint string")
        note.coalesce(1).write.mode("overwrite").json(self._note(name))
        self.made[name] = cut
        if old is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {table_name(old.path)}")
            delete(self.spark, old.path)
        return read(self.spark, path, key, buckets)

    def once(self, df: DataFrame, name: str = "cut") -> DataFrame:
        """Stores ``df`` under a name of its own (for ``materialise`` arguments); kept until :meth:`drop`."""
        return self.table(f"{name}-{uuid.uuid4().hex}", lambda: df)

    def drop(self, *names: str) -> None:
        """Deletes cuts (all of them without names): table and manifest row."""
        for name in names or list(self.made):
            cut = self.made.pop(name, None)
            if cut is not None:
                self.spark.sql(f"DROP TABLE IF EXISTS {table_name(cut.path)}")
                delete(self.spark, self._note(name))
                delete(self.spark, cut.path)
