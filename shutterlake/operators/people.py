"""Persons, clusters of unnamed faces, review queues and names for sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .mutate import numbered
from .predicates import fold


def list_persons(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """id, name, faces, photos, cover: a pinned cover that is still theirs, else their least face with a crop."""
    per = faces.filter("person_id is not null").groupBy("person_id").agg(
        F.count(F.lit(1)).alias("faces"), F.count_distinct("photo_id").alias("photos"), F.min(F.when(F.col("crop_path").isNotNull(), F.col("id"))).alias("least")
    )
    pins = persons.filter("cover_face_id is not null").select("id", "cover_face_id").join(faces.select(F.col("id").alias("f"), "person_id"), (F.col("cover_face_id") == F.col("f")) & (F.col("id") == F.col("person_id")), "left_semi").select(F.col("id").alias("pid"), F.col("cover_face_id").alias("pinned"))
    out = persons.select("id", "name").join(per, F.col("id") == F.col("person_id"), "left").join(pins, F.col("id") == F.col("pid"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("id", "name", zero("faces"), zero("photos"), F.coalesce("pinned", "least").alias("cover"))


def by_name(df: DataFrame, name: str = "name") -> DataFrame:
    return df.orderBy(fold(F.col(name)))


def list_clusters(faces: DataFrame, limit: int = 50, samples: int = 6) -> DataFrame:
    """The largest clusters of unnamed faces with their first faces; equal sizes in the order of cluster."""
    open_ = faces.filter("person_id is null and cluster_id is not null")
    top = open_.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "cluster_id").limit(limit)
    first = open_.join(F.broadcast(top.select("cluster_id")), "cluster_id", "left_semi")  # limit rows
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))).filter(F.col("k") <= samples)
    first = first.groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return top.join(first, "cluster_id")


def review_queue(faces: DataFrame, persons: DataFrame, max_confidence: float = 0.6, limit: int = 60) -> DataFrame:
    """Named faces with a crop whose confidence is over 0 and under the limit, weakest first."""
    weak = faces.filter("crop_path is not null").filter((F.col("confidence") > 0) & (F.col("confidence") < max_confidence))
    named = weak.join(persons.select(F.col("id").alias("pid"), "name"), F.col("person_id") == F.col("pid"))
    return named.select("id", "photo_id", "person_id", "name", "confidence").orderBy("confidence", "id").limit(limit)


def person_faces(faces: DataFrame, person_id: int, limit: int = 200) -> DataFrame:
    return faces.filter((F.col("person_id") == person_id) & F.col("crop_path").isNotNull()).select("id", "photo_id", "confidence").orderBy("id").limit(limit)


def named_face_count(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """The derived column, recounted: photo id and how many of its faces are named."""
    n = faces.filter("person_id is not null").groupBy("photo_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return photos.select("id").join(n, F.col("id") == F.col("photo_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("named_face_count"))


def names_by_path(photos: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """path and the sorted distinct names of the persons in the photo, for photos with any."""
    named = faces.filter("person_id is not null").join(persons.select(F.col("id").alias("pid"), "name"), F.col("person_id") == F.col("pid"))
    names = named.groupBy("photo_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return photos.select("id", "path").join(names, F.col("id") == F.col("photo_id")).select("path", "names")


def enrolled(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """id, person_id, name, embedding of the named faces that have a vector."""
    named = faces.filter("person_id is not null and embedding is not null")
    return named.join(persons.select(F.col("id").alias("pid"), "name"), F.col("person_id") == F.col("pid")).select("id", "person_id", "name", "embedding")


def relabel_clusters(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """faces with cluster_id from a new clustering (id, cluster) of the unnamed ones, numbered from 0 by least face.

    Labels that the unnamed faces had are gone; named faces have none. Clusters are numbered within
    ranges, so no task holds all of them.
    """
    firsts = clusters.filter("cluster is not null").select("cluster").distinct()
    number = numbered(firsts, -1, "cluster").select("cluster", F.col("id").cast("int").alias("k"))
    new = clusters.join(number, "cluster").select(F.col("id").alias("_id"), "k")
    out = faces.join(new, F.col("id") == F.col("_id"), "left")
    return out.withColumn("cluster_id", F.when(F.col("person_id").isNull(), F.col("k"))).drop("_id", "k")


def vetoes(negatives: DataFrame, faces: DataFrame) -> DataFrame:
    """id, person_id, embedding: what the faces look like that were said not to be a person."""
    f = faces.filter("embedding is not null").select("id", "embedding")
    return negatives.join(f, F.col("face_id") == F.col("id")).select("id", negatives["person_id"], "embedding")
