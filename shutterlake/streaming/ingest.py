"""Incremental ingest and sessions as streams.

A stream of listed files is merged batch by batch into the store: each batch drops what is known by
path or content and upserts the rest, in one commit, so a batch that is replayed after a failure
finds its files known and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutate import new_content, upsert_photos
from ..sources.store import Store


def merge_batch(store: Store, batch: DataFrame) -> int:
    """New files of a batch (path, sha1, and other indexed columns) into the store's photos; how many."""
    photos = store.read("photos")
    fresh = new_content(batch.dropDuplicates(["path"]), photos)
    n = fresh.count()
    if n:
        store.commit({"photos": upsert_photos(photos, fresh)})
    return n


def ingest(spark: SparkSession, folder: str, schema: str, store: Store, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Merge parquet listings that arrive in a folder, until all that is there is merged."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(lambda df, _: merge_batch(store, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of runs of events no further apart than the gap; works on streams and tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
