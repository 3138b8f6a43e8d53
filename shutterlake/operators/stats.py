"""A library at a glance, and the keys that caches are held by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where dates come from, in display order.
SOURCES = ("exif", "filename", "folder", "video", "mtime")


def top(counts: DataFrame, n: int, by: str = "n", name: str = "value") -> DataFrame:
    """The n largest counts, by value among equals: a facet's first rows."""
    return counts.orderBy(F.desc(by), name).limit(n)


def library_stats(photos: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """topic, value, n: the commonest scenes (6), countries (6) and persons (10), date sources, years and totals."""
    count = F.count(F.lit(1)).alias("n")
    said = lambda df, topic: df.select(F.lit(topic).alias("topic"), F.col("value").cast("string").alias("value"), F.col("n").cast("long").alias("n"))
    values = lambda c: photos.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(count)
    named = faces.filter("person_id is not null").join(persons.select(F.col("id").alias("pid"), F.col("name").alias("value")), F.col("person_id") == F.col("pid"))
    out = said(top(values("scene_type"), 6), "scene").unionByName(said(top(values("place_country"), 6), "country"))
    out = out.unionByName(said(top(named.groupBy("value").agg(F.count_distinct("photo_id").alias("n")), 10), "person"))
    out = out.unionByName(said(photos.groupBy(F.coalesce("taken_source", F.lit("mtime")).alias("value")).agg(count), "dated by"))
    year = F.substring("taken_at", 1, 4)
    ends = photos.agg(F.min(year).alias("lo"), F.max(year).alias("hi"), count, F.count_if(F.col("is_video")).alias("v"))
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), v.cast("string").alias("value"), n.cast("long").alias("n")) for t, v, n in (("first year", F.col("lo"), F.lit(None)), ("last year", F.col("hi"), F.lit(None)), ("photos", F.lit(None), F.col("n")), ("videos", F.lit(None), F.col("v")))])
    return out.unionByName(ends.select(F.inline(rows)))


def signature(df: DataFrame) -> DataFrame:
    """n, top: rows and greatest id, which together with the store's version tell whether a cache is stale."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("top"))
