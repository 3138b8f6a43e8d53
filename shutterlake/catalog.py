"""The catalog: photos, faces, persons and their vectors, read from parquet.

Two origins: a folder that holds catalog tables (photos.parquet, faces.parquet and so on), or views
of the same shape over a star schema of orders, which stand in for a library in tests and benchmarks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import schema
from .operators import mutate


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass
class Catalog:
    """A library stored as catalog tables in a folder."""

    spark: SparkSession
    folder: str

    @cached_property
    def photos(self) -> DataFrame:
        return self.evolved(read(self.spark, self.folder, "photos"))

    def evolved(self, photos: DataFrame) -> DataFrame:
        """photos as written under an older schema; the count of named faces, where it isn't kept yet, from the faces."""
        old = "named_face_count" not in photos.columns
        photos = schema.reconcile(photos, schema.PHOTO_DDL, {"favorite": False, "hidden": False, "is_video": False, "named_face_count": 0})
        return mutate.recount(photos, self.faces, ("named_face_count",)) if old else photos

    @cached_property
    def faces(self) -> DataFrame:
        """The faces; none if the folder has no such table."""
        try:
            found = read(self.spark, self.folder, "faces")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = self.spark.createDataFrame([], schema.FACE_DDL)
        return schema.reconcile(found, schema.FACE_DDL)

    @cached_property
    def persons(self) -> DataFrame:
        return schema.reconcile(read(self.spark, self.folder, "persons"), schema.PERSON_DDL)

    @cached_property
    def negatives(self) -> DataFrame:
        return schema.reconcile(read(self.spark, self.folder, "face_negatives"), schema.NEGATIVE_DDL)


class StarCatalog(Catalog):
    """Catalog views over orders, lineitem, supplier and events.

    An order is a photo, its lines are faces, suppliers are persons, a returned line is a named face.
    Keys are made within an order, so no view needs a global sort.
    """

    def _t(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    @cached_property
    def faces(self) -> DataFrame:
        li = self._t("lineitem")
        order = [c for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")]
        n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
        named = F.col("l_returnflag") != "N"
        face = F.col("l_orderkey") * 64 + n
        return li.select(
            face.alias("id"),
            F.col("l_orderkey").alias("photo_id"),
            F.when(named, F.col("l_suppkey")).alias("person_id"),
            F.when(~named, (F.col("l_partkey") % 50).cast("int")).alias("cluster_id"),
            F.struct((F.col("l_linenumber") * 10).alias("x"), F.col("l_quantity").cast("int").alias("y"), (F.col("l_linenumber") + 20).alias("w"), (F.col("l_linenumber") * 2 + 24).alias("h")).alias("bbox"),
            F.round(F.col("l_discount") * 10, 2).alias("confidence"),
            F.when(F.col("l_partkey") % 11 != 0, F.concat_ws("/", F.lit("crops"), F.col("l_orderkey").cast("string"), n.cast("string"))).alias("crop_path"),
        )

    @cached_property
    def persons(self) -> DataFrame:
        return self._t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") * 64 + 1).alias("cover_face_id"))

    def photo_attributes(self) -> DataFrame:
        """photos without what is counted over faces; a plan of small joins only."""
        o = self._t("orders").join(F.broadcast(self._t("nation").join(F.broadcast(self._t("region")), F.col("n_regionkey") == F.col("r_regionkey"))).join(self._t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("n_nationkey") == F.col("c_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
        i = F.col("o_orderkey")
        taken = F.when(i % 97 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        name = F.concat(F.when(i % 2 == 0, "IMG_").otherwise("img_"), i.cast("string"), F.lit(".jpg"))
        scene = F.element_at(F.create_map(*[F.lit(x) for kv in SCENE_OF.items() for x in kv]), F.col("o_orderpriority"))
        return o.select(
            i.alias("id"),
            F.concat(F.lit("/library/"), F.date_format("o_orderdate", "yyyy"), F.lit("/"), name).alias("path"),
            name.alias("filename"),
            F.md5((i % 5000).cast("string").cast("binary")).alias("sha1"),
            (1000 + i % 3000).cast("int").alias("width"),
            (800 + i % 2000).cast("int").alias("height"),
            F.floor("o_totalprice").alias("bytes"),
            taken.alias("taken_at"),
            F.when(i % 5 == 0, "exif").when(i % 5 == 1, "filename").when(i % 5 == 2, "folder").when(i % 5 == 3, "mtime").alias("taken_source"),
            F.concat(F.lit("Maker "), F.substring("c_mktsegment", 1, 1)).alias("camera_make"),
            F.col("c_mktsegment").alias("camera_model"),
            F.when(i % 3 != 0, (i * 37) % 18000 / 100.0 - 90).alias("lat"),
            F.when(i % 3 != 0, (i * 73) % 36000 / 100.0 - 180).alias("lon"),
            F.col("n_name").alias("place_city"),
            F.col("r_name").alias("place_country"),
            F.concat_ws(", ", "n_name", "r_name").alias("place_label"),
            F.when(i % 7 == 0, F.concat(F.lit("Trip "), (i % 3).cast("string"))).alias("folder_place"),
            F.coalesce(scene, F.lit("other")).alias("scene_type"),
            (i % 10 == 0).alias("favorite"),
            (i % 23 == 0).alias("is_video"),
            (i % 17 == 0).alias("hidden"),
            F.lit("2026-01-01T00:00:00").alias("indexed_at"),
        )

    @cached_property
    def photos(self) -> DataFrame:
        counts = self._t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("c"), F.count_if(F.col("l_returnflag") != "N").cast("int").alias("k"))
        p = self.photo_attributes().join(counts, F.col("id") == F.col("l_orderkey"), "left")
        return p.withColumns({"face_count": F.when(F.col("id") % 89 != 0, F.coalesce("c", F.lit(0))), "named_face_count": F.coalesce("k", F.lit(0))}).drop("l_orderkey", "c", "k")

    @cached_property
    def negatives(self) -> DataFrame:
        return self.faces.filter("person_id is not null and id % 13 = 0").select(F.col("id").alias("face_id"), ((F.col("person_id") + 1) % 100).alias("person_id"))

    @cached_property
    def vectors(self) -> DataFrame:
        """id, photo_id, label, embedding: whole-image vectors, or regions of faces of person label."""
        return self._t("embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 200).alias("photo_id"), F.col("label").cast("long").alias("label"), "embedding")

    @cached_property
    def timeline(self) -> DataFrame:
        """events as photos with a position: id, user_id, taken_at, lat, lon, place_label, phash and more."""
        e, i = self._t("events"), F.col("event_id")
        return e.select(
            i.alias("id"),
            "user_id",
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("taken_at"),
            F.when(i % 4 != 0, 40 + (F.col("user_id") * 13 + F.floor(i / 500)) % 20).cast("double").alias("lat"),
            F.when(i % 4 != 0, (F.col("user_id") * 7 + F.floor(i / 500)) % 30).cast("double").alias("lon"),
            F.when(i % 5 != 0, F.concat(F.lit("Place "), (F.col("user_id") % 9).cast("string"))).alias("place_label"),
            F.when(i % 6 == 0, F.concat(F.lit("Folder "), (i % 4).cast("string"))).alias("folder_place"),
            F.lit(None).cast("string").alias("place_city"),
            F.lit(None).cast("string").alias("place_country"),
            F.substring(F.md5((F.floor(i / 3)).cast("string").cast("binary")), 1, 16).alias("phash"),
            (i % 10 == 0).alias("favorite"),
            (i % 19 == 0).alias("hidden"),
            (1000 + i % 7).cast("int").alias("width"),
            (1000 + i % 5).cast("int").alias("height"),
        )


#: The scene a photo of the star views shows, by the order's priority.
SCENE_OF = {"1-URGENT": "people", "2-HIGH": "food", "3-MEDIUM": "landscape", "4-NOT SPECIFIED": "document", "5-LOW": "animals"}

#: The same views in SQL, for the oracle; a WITH list without its first word.
VIEWS_SQL = """
faces AS (SELECT l_orderkey * 64 + n id, l_orderkey photo_id, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END person_id, CASE WHEN l_returnflag = 'N' THEN CAST(l_partkey % 50 AS INT) END cluster_id,
  l_linenumber * 10 bx, CAST(floor(l_quantity) AS INT) byy, l_linenumber + 20 bw, l_linenumber * 2 + 24 bh, round(l_discount * 10, 2) confidence,
  CASE WHEN l_partkey % 11 <> 0 THEN 'crops/' || l_orderkey || '/' || n END crop_path
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) n FROM lineitem)),
persons AS (SELECT s_suppkey id, s_name name, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 64 + 1 END cover_face_id FROM supplier),
photos AS (SELECT o_orderkey id, '/library/' || strftime(o_orderdate, '%Y') || '/' || f filename_path, f filename, '/library/' || strftime(o_orderdate, '%Y') || '/' || f path, md5(CAST(o_orderkey % 5000 AS VARCHAR)) sha1,
  CAST(1000 + o_orderkey % 3000 AS INT) width, CAST(800 + o_orderkey % 2000 AS INT) height, CAST(floor(o_totalprice) AS BIGINT) bytes,
  CASE WHEN o_orderkey % 97 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END taken_at,
  CASE o_orderkey % 5 WHEN 0 THEN 'exif' WHEN 1 THEN 'filename' WHEN 2 THEN 'folder' WHEN 3 THEN 'mtime' END taken_source,
  'Maker ' || substr(c_mktsegment, 1, 1) camera_make, c_mktsegment camera_model,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey * 37) % 18000 / 100.0::DOUBLE - 90 END lat, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey * 73) % 36000 / 100.0::DOUBLE - 180 END lon,
  n_name place_city, r_name place_country, n_name || ', ' || r_name place_label, CASE WHEN o_orderkey % 7 = 0 THEN 'Trip ' || (o_orderkey % 3) END folder_place,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'people' WHEN '2-HIGH' THEN 'food' WHEN '3-MEDIUM' THEN 'landscape' WHEN '4-NOT SPECIFIED' THEN 'document' WHEN '5-LOW' THEN 'animals' ELSE 'other' END scene_type,
  o_orderkey % 10 = 0 favorite, o_orderkey % 23 = 0 is_video, o_orderkey % 17 = 0 hidden, '2026-01-01T00:00:00' indexed_at,
  CASE WHEN o_orderkey % 89 <> 0 THEN CAST(coalesce(c, 0) AS INT) END face_count, CAST(coalesce(k, 0) AS INT) named_face_count
  FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'IMG_' ELSE 'img_' END || o_orderkey || '.jpg' f FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, count(*) c, count(*) FILTER (WHERE l_returnflag <> 'N') k FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
negatives AS (SELECT id face_id, (person_id + 1) % 100 person_id FROM faces WHERE person_id IS NOT NULL AND id % 13 = 0),
vectors AS (SELECT vec_id id, vec_id % 200 photo_id, CAST(label AS BIGINT) label, embedding FROM embeddings),
timeline AS (SELECT event_id id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') taken_at,
  CASE WHEN event_id % 4 <> 0 THEN CAST(40 + (user_id * 13 + event_id // 500) % 20 AS DOUBLE) END lat, CASE WHEN event_id % 4 <> 0 THEN CAST((user_id * 7 + event_id // 500) % 30 AS DOUBLE) END lon,
  CASE WHEN event_id % 5 <> 0 THEN 'Place ' || (user_id % 9) END place_label, CASE WHEN event_id % 6 = 0 THEN 'Folder ' || (event_id % 4) END folder_place,
  substr(md5(CAST(event_id // 3 AS VARCHAR)), 1, 16) phash, event_id % 10 = 0 favorite, event_id % 19 = 0 hidden, CAST(1000 + event_id % 7 AS INT) width, CAST(1000 + event_id % 5 AS INT) height FROM events)
"""
