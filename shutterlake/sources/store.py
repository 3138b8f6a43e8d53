"""A versioned store of tables: each commit writes whole new versions and then moves one pointer.

Readers see the version the pointer named when they opened it; a commit that dies before the pointer
moves leaves no trace. The pointer of a version is one small file that names each table's folder, a
line each. It is written under another name and renamed through Hadoop without overwriting, which
file systems with a rename of their own (HDFS, POSIX) do at once: of two writers of a version one fails.
On an object store, whose rename is a copy, commits need one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, p: str):
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path  # noqa: SLF001

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        fs, top = self._path("pointer")
        if not fs.exists(top):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(top) if s.getPath().getName().isdigit()), default=0)

    def _lines(self, version: int) -> list[str]:
        fs, at = self._path(f"pointer/{version}")
        f = fs.open(at)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode().split("\n")  # noqa: SLF001
        finally:
            f.close()

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Table name -> folder, as of a version."""
        v = self.version() if version is None else version
        if not v:
            return {}
        return dict(x.split("\t") for x in self._lines(v) if x)  # type: ignore[misc]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.tables(version)[name]}")

    def commit(self, changed: Mapping[str, DataFrame]) -> int:
        """Write the changed tables and make them current, all at once; the new version."""
        v = self.version() + 1
        now = self.tables()
        for name, df in changed.items():
            path = f"data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{path}")
            now[name] = path
        fs, to = self._path(f"pointer/{v}")
        fs.mkdirs(to.getParent())
        written = self._path(f"pointer/.{uuid.uuid4().hex}")[1]
        sc = self.spark.sparkContext
        jvm = sc._jvm  # noqa: SLF001
        f = fs.create(written, False)
        try:
            jvm.org.apache.commons.io.IOUtils.write("\n".join(f"{n}\t{p}" for n, p in sorted(now.items())), f, "UTF-8")
        finally:
            f.close()
        try:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())  # noqa: SLF001
            files.rename(fs.makeQualified(written), fs.makeQualified(to), sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # noqa: SLF001
        except Exception as e:
            fs.delete(written, False)
            if not fs.exists(to):
                raise
            raise RuntimeError(f"version {v} was committed meanwhile") from e
        return v

    def fingerprint(self, name: str) -> tuple[int, int, int]:
        """(version, rows, greatest id): a cache key that also changes when rows change in place."""
        r = self.read(name).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()
        return self.version(), r["n"], r["m"]
