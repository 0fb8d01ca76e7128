"""Layer tables: versioned folders behind a manifest.

A layer lies in ``<base>/<name>/``. Each version is a folder of its own, and
``_manifest.json`` names the current one with the key it was built for (source
files, schema, code; see ``inputs.state_key``), its schema and the version
before. A version is written whole before the manifest is replaced by one
rename, so readers see the old or the new version and never a part; a failed
build leaves the current version as it is. Versions before the last one go when
a new one is switched to.

A layer whose key has not changed is read as it is, also by a later session
with the same shared folder.

A layer may be bucketed: its rows are hash-partitioned and sorted by some
columns when written, so joins and aggregations on them need no exchange. Only
columns with few rows each (a workout's sets) are meant for this, as a bucket
holds all rows of a value.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from liftlake.session import ensure_checkpoint_dir
from liftlake.sources.inputs import session_key

MANIFEST = "_manifest.json"
KEEP_BEFORE = 1
COMPRESSION = "zstd"


class Files:
    """The few file operations a manifest needs, by Hadoop's file system, which
    knows every store that Spark reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def read(self, path: str) -> str | None:
        fs, at = self._fs(path), self._path(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write beside the file, then rename over it in one step."""
        beside = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs(path).create(self._path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        target = self._fs(path).makeQualified(self._path(path))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        context.rename(context.makeQualified(self._path(beside)), target, how)

    def folders(self, path: str) -> list[str]:
        fs, at = self._fs(path), self._path(path)
        if not fs.exists(at):
            return []
        return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]

    def remove(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)


class Catalog:
    """Layers below ``base`` (default: ``liftlake-tables`` in the folder that
    the driver and all executors share)."""

    _kept: dict[tuple[str, str], tuple[str, DataFrame]] = {}

    def __init__(self, spark: SparkSession, base: str | None = None) -> None:
        self.spark, self.files = spark, Files(spark)
        self.base = (base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/liftlake-tables").rstrip("/")

    def manifest(self, name: str) -> dict | None:
        text = self.files.read(f"{self.base}/{name}/{MANIFEST}")
        return json.loads(text) if text else None

    def folder(self, name: str, key: str, write: Callable[[str], None], about: dict | None = None) -> dict:
        """Manifest of the version for ``key``; ``write(path)`` makes it, unless
        it is there. What ``write`` made is looked at by nobody before the
        switch."""
        current = self.manifest(name)
        if current is not None and current["key"] == key:
            return current
        path = f"{self.base}/{name}/{key[:12]}-{uuid.uuid4().hex[:12]}"
        write(path)
        before = [] if current is None else [current["path"], *current["before"]][:KEEP_BEFORE]
        entry = {"key": key, "path": path, "before": before, "written_at": time.time(), **(about or {})}
        self.files.replace(f"{self.base}/{name}/{MANIFEST}", json.dumps(entry))
        stay = {p.rsplit("/", 1)[1] for p in (path, *before)}
        for old in self.files.folders(f"{self.base}/{name}"):
            if old not in stay:
                self._drop(f"{self.base}/{name}/{old}")
        return entry

    def table(self, name: str, key: str, build: Callable[[], DataFrame], bucket_by: tuple[str, ...] = ()) -> DataFrame:
        """The layer as a Parquet table, built when its key is new."""
        kept = self._kept.get((session_key(self.spark), f"{self.base}/{name}"))
        if kept is not None and kept[0] == key:
            return kept[1]
        about: dict = {}

        def write(path: str) -> None:
            df = build()
            about["schema"] = json.loads(df.schema.json())
            if not bucket_by:
                df.write.parquet(path, compression=COMPRESSION)
                return
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            about["buckets"], about["bucket_by"] = n, list(bucket_by)
            spread = df.repartition(n, *bucket_by).write.bucketBy(n, *bucket_by).sortBy(*bucket_by)
            spread.option("path", path).option("compression", COMPRESSION).format("parquet").saveAsTable(_table_name(path))

        entry = self.folder(name, key, write, about)
        df = self._read(entry)
        self._kept[session_key(self.spark), f"{self.base}/{name}"] = (key, df)
        return df

    def _read(self, entry: dict) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        if "bucket_by" not in entry:
            return self.spark.read.schema(schema).parquet(entry["path"])
        name = _table_name(entry["path"])
        if not self.spark.catalog.tableExists(name):  # written by another session
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            keys = ", ".join(f"`{c}`" for c in entry["bucket_by"])
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {entry['buckets']} BUCKETS"
                f" LOCATION '{entry['path']}'"
            )
        return self.spark.table(name)

    def _drop(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
        self.files.remove(path)


def _table_name(path: str) -> str:
    """Name of a bucketed version in the session's catalog."""
    return "liftlake_" + re.sub(r"\W", "_", "_".join(path.rsplit("/", 2)[-2:]))
