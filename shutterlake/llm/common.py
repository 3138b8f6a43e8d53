"""What the operators of this subpackage share: reading tables, scratch tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch between Spark and Python. A task holds some batches on either side, joined
#: rows of two texts among them, so this bounds its memory whatever the texts' lengths are.
BATCH_BYTES = 4 << 20
#: Rows of an Arrow batch that a step hands back: one of few texts can be many rows.
BATCH_ROWS = 1 << 15
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession) -> None:
    """Have the session cut Arrow batches at BATCH_BYTES, unless it cuts them smaller."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, str(64 << 20))
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:  # noqa: SLF001
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader opens the path."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt by key at every size: it grows with the corpus, so it isn't to be broadcast where it happens to be small."""
    return df.hint("merge")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, in one process as in tests) a temporary one."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)  # noqa: SLF001
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="shutterlake-")
        sc.setCheckpointDir(d)
    return str(d)


class Scratch:
    """Written tables in the shared folder; they cut lineage, and any executor can read them again.

    A table goes when drop() names it, the rest when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.top = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._fs(self.top, "deleteOnExit")

    def _fs(self, path: str, what: str) -> None:
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
        fs.delete(p, True) if what == "delete" else fs.deleteOnExit(p)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table. Its tasks are joined up to the advisory size, not to one a core: small tables are few files."""
        path, key = f"{self.top}/{name}", "spark.sql.adaptive.coalescePartitions.parallelismFirst"
        before = self.spark.conf.get(key, "true")
        self.spark.conf.set(key, "false")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for n in names:
            self._fs(f"{self.top}/{n}", "delete")

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """df saved, and every other table dropped: a small result that stands alone."""
        out = self.save(df, name)
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        top = jvm.org.apache.hadoop.fs.Path(self.top)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
        for s in fs.listStatus(top):
            if s.getPath().getName() != name:
                fs.delete(s.getPath(), True)
        self.settle()
        return out

    def settle(self) -> None:
        """Let Spark drop the shuffle files of plans that are done."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # noqa: SLF001


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def by_batch(schema: str | T.StructType, f: Callable[[pa.RecordBatch], Iterable[dict]]) -> Callable[[DataFrame], DataFrame]:
    """A DataFrame step: each Arrow batch through f, which yields dicts of whole columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for out in f(b):
                    rows = pa.RecordBatch.from_pydict(out)
                    for i in range(0, rows.num_rows, BATCH_ROWS):
                        yield rows.slice(i, BATCH_ROWS)

    return lambda df: df.mapInArrow(run, schema)
