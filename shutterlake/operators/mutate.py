"""Changes to the catalog as DataFrame -> DataFrame steps.

Parquet has no row update: each change yields the whole new table, lazily, and a store writes it as
a new version (sources/store.py). Checks that a change needs (a person exists, a name is free) are
small actions before the plan is built, and raise ValueError.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.graph import checkpointed
from ..schema import INDEXED
from .entity import carry_labels
from .predicates import fold

FLAGS = ("favorite", "hidden")


def numbered(df: DataFrame, after: int, by: str) -> DataFrame:
    """df with ids from after + 1, in the order of a column, without a global window.

    Rows are numbered within range partitions, whose sizes are summed first. The partitions are
    checkpointed, as both steps must see the same ones.
    """
    parts = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_p", F.spark_partition_id())
    n = F.row_number().over(Window.partitionBy("_p").orderBy(by))
    numbered = checkpointed(parts.withColumn("_n", n))
    sizes = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    base = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a partition
    out = numbered.join(F.broadcast(base), F.col("_p") == F.col("_q"))
    return out.withColumn("id", F.col("_n") + F.col("_b") + after).drop("_p", "_q", "_n", "_b")


def upsert_photos(photos: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows, by path: indexed columns are theirs (null where they lack one), the user's stay.

    A path that is new gets the next ids, in the order of path. The last of repeated incoming paths
    isn't defined; callers pass one row a path.
    """
    cols = photos.columns
    news = incoming.select(F.col("path").alias("_path"), *[(F.col(c) if c in incoming.columns else F.lit(None).cast(photos.schema[c].dataType)).alias(f"_{c}") for c in INDEXED if c in cols and c != "path"])
    joined = photos.join(news, F.col("path") == F.col("_path"), "left")
    hit = F.col("_path").isNotNull()
    kept = joined.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in INDEXED and c != "path" else F.col(c) for c in cols])
    fresh = news.join(photos.select("path"), F.col("_path") == F.col("path"), "left_anti")
    top = photos.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(fresh, top, "_path")
    defaults = {"favorite": F.lit(False), "hidden": F.lit(False), "is_video": F.lit(False), "named_face_count": F.lit(0)}
    fresh = fresh.select(*[(F.col("id") if c == "id" else F.col("_path") if c == "path" else F.col(f"_{c}") if c in INDEXED else (F.coalesce(F.col(f"_{c}"), defaults[c]) if f"_{c}" in fresh.columns else defaults.get(c, F.lit(None)))).cast(photos.schema[c].dataType).alias(c) for c in cols])
    return kept.unionByName(fresh)


def replace_faces(faces: DataFrame, incoming: DataFrame) -> DataFrame:
    """All faces of the incoming photos replaced by the incoming ones (with ids of their own)."""
    return faces.join(incoming.select("photo_id").distinct(), "photo_id", "left_anti").select(*faces.columns).unionByName(incoming, allowMissingColumns=True)


def recount(photos: DataFrame, faces: DataFrame, which: Sequence[str] = ("face_count", "named_face_count")) -> DataFrame:
    """photos with face_count and named_face_count counted anew, or those of them that are named."""
    n = faces.groupBy(F.col("photo_id").alias("_id")).agg(F.count(F.lit(1)).cast("int").alias("_face_count"), F.count("person_id").cast("int").alias("_named_face_count"))
    out = photos.join(n, F.col("id") == F.col("_id"), "left")
    return out.withColumns({c: F.coalesce(f"_{c}", F.lit(0)) for c in which}).drop("_id", "_face_count", "_named_face_count")


def set_column(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """column from values (id, value) where they have a row: vectors, hashes, scene tags."""
    v = values.select(F.col("id").alias("_id"), F.col("value").alias("_v"))
    return df.join(v, F.col("id") == F.col("_id"), "left").withColumn(column, F.when(F.col("_id").isNotNull(), F.col("_v")).otherwise(F.col(column))).drop("_id", "_v")


def missing(df: DataFrame, column: str, recompute: bool = False, videos: bool = True) -> DataFrame:
    """The rows a backfill has to look at."""
    df = df if recompute else df.filter(F.col(column).isNull())
    return df if videos else df.filter(~F.col("is_video"))


def with_faces(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """The photos that any of the faces is in, each once."""
    return photos.join(faces.select("photo_id"), F.col("id") == F.col("photo_id"), "left_semi")


def set_flag(photos: DataFrame, flag: str, value: bool, ids: Sequence[int]) -> DataFrame:
    if flag not in FLAGS:
        raise ValueError(f"{flag} is not one of {FLAGS}")
    return photos.withColumn(flag, F.when(F.col("id").isin(list(ids)), F.lit(value)).otherwise(F.col(flag)))


def delete_photos(photos: DataFrame, faces: DataFrame, negatives: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the photos (id), their faces, and what was said about those."""
    gone = ids.select(F.col("id").alias("_gone"))
    faces_left = faces.join(gone, F.col("photo_id") == F.col("_gone"), "left_anti")
    faces_gone = faces.join(gone, F.col("photo_id") == F.col("_gone"), "left_semi").select(F.col("id").alias("_f"))
    return photos.join(gone, F.col("id") == F.col("_gone"), "left_anti"), faces_left, negatives.join(faces_gone, F.col("face_id") == F.col("_f"), "left_anti")


def add_negatives(negatives: DataFrame, more: DataFrame) -> DataFrame:
    return negatives.unionByName(more.select("face_id", "person_id")).distinct()


def remove_negatives(negatives: DataFrame, less: DataFrame) -> DataFrame:
    return negatives.join(less.select("face_id", "person_id"), ["face_id", "person_id"], "left_anti")


def _person(persons: DataFrame, person_id: int) -> None:
    if persons.filter(F.col("id") == person_id).isEmpty():
        raise ValueError(f"no person {person_id}")


def create_person(persons: DataFrame, name: str) -> DataFrame:
    """persons with one of the (trimmed) name; as they are if there is one."""
    name = name.strip()
    if not name:
        raise ValueError("a person needs a name")
    if not persons.filter(F.col("name") == name).isEmpty():
        return persons
    top = persons.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    row = persons.sparkSession.range(1).select(*[(F.lit(top + 1) if c == "id" else F.lit(name) if c == "name" else F.lit(None)).cast(persons.schema[c].dataType).alias(c) for c in persons.columns])
    return persons.unionByName(row)


def rename_person(persons: DataFrame, person_id: int, name: str) -> DataFrame:
    _person(persons, person_id)
    if not persons.filter((F.col("name") == name.strip()) & (F.col("id") != person_id)).isEmpty():
        raise ValueError(f"there is a person {name.strip()}")
    return persons.withColumn("name", F.when(F.col("id") == person_id, F.lit(name.strip())).otherwise(F.col("name")))


def delete_person(persons: DataFrame, faces: DataFrame, person_id: int) -> tuple[DataFrame, DataFrame]:
    return persons.filter(F.col("id") != person_id), faces.withColumn("person_id", F.when(F.col("person_id") != person_id, F.col("person_id")))


def merge_persons(persons: DataFrame, faces: DataFrame, into: Mapping[int, int]) -> tuple[DataFrame, DataFrame]:
    """Each source person's faces to its target; sources go."""
    for s, t in into.items():
        if s == t:
            raise ValueError("a person can't be merged into itself")
        _person(persons, s)
        _person(persons, t)
    to = F.create_map(*[F.lit(x).cast("long") for kv in into.items() for x in kv])
    return persons.filter(~F.col("id").isin(list(into))), faces.withColumn("person_id", F.coalesce(F.try_element_at(to, F.col("person_id")), "person_id"))


def set_cover(persons: DataFrame, faces: DataFrame, person_id: int, face_id: int) -> DataFrame:
    _person(persons, person_id)
    if faces.filter((F.col("id") == face_id) & (F.col("person_id") == person_id)).isEmpty():
        raise ValueError("the face isn't theirs")
    return persons.withColumn("cover_face_id", F.when(F.col("id") == person_id, F.lit(face_id)).otherwise(F.col("cover_face_id")))


def assign_cluster(faces: DataFrame, cluster_id: int, person_id: int) -> DataFrame:
    """The cluster's unnamed faces named, out of the cluster; their confidence stays."""
    hit = (F.col("cluster_id") == cluster_id) & F.col("person_id").isNull()
    hit = F.coalesce(hit, F.lit(False))
    return faces.withColumns({"person_id": F.when(hit, F.lit(person_id)).otherwise(F.col("person_id")), "cluster_id": F.when(~hit, F.col("cluster_id"))})


def assign_face(faces: DataFrame, negatives: DataFrame, face_id: int, person_id: int) -> tuple[DataFrame, DataFrame]:
    """A face named for certain; that it isn't whom it was taken for is remembered."""
    hit: Column = F.col("id") == face_id
    was = faces.filter(hit & F.col("person_id").isNotNull() & (F.col("person_id") != person_id)).select(F.col("id").alias("face_id"), "person_id")
    new = faces.withColumns({"person_id": F.when(hit, F.lit(person_id)).otherwise(F.col("person_id")), "cluster_id": F.when(~hit, F.col("cluster_id")), "confidence": F.when(hit, F.lit(1.0)).otherwise(F.col("confidence"))})
    return new, add_negatives(negatives, was).filter(~((F.col("face_id") == face_id) & (F.col("person_id") == person_id)))


def unassign_face(faces: DataFrame, negatives: DataFrame, face_id: int) -> tuple[DataFrame, DataFrame]:
    hit = F.col("id") == face_id
    was = faces.filter(hit & F.col("person_id").isNotNull()).select(F.col("id").alias("face_id"), "person_id")
    return faces.withColumn("person_id", F.when(~hit, F.col("person_id"))), add_negatives(negatives, was)


def save_search(searches: DataFrame, name: str, query: str) -> DataFrame:
    """Upsert by trimmed name."""
    name = name.strip()
    if not name:
        raise ValueError("a saved search needs a name")
    if not searches.filter(F.col("name") == name).isEmpty():
        return searches.withColumn("query", F.when(F.col("name") == name, F.lit(query)).otherwise(F.col("query")))
    top = searches.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return searches.unionByName(searches.sparkSession.sql("SELECT CAST(:i AS BIGINT) id, :n name, :q query", args={"i": top + 1, "n": name, "q": query}))


def list_searches(searches: DataFrame) -> DataFrame:
    """By name, A-Z like a-z."""
    return searches.select("id", "name", "query").orderBy(fold(F.col("name")), "id")


def delete_search(searches: DataFrame, search_id: int) -> DataFrame:
    return searches.filter(F.col("id") != search_id)


def get_meta(meta: DataFrame, key: str) -> DataFrame:
    """value of a counter (key, value); 0 if it was never set."""
    return meta.filter(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(0)).alias("value"))


def bump_meta(meta: DataFrame, key: str) -> DataFrame:
    """The counters with one of them up by one, or set to 1."""
    one = meta.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(1).cast("long").alias("value"))
    return meta.select("key", "value").unionByName(one).groupBy("key").agg(F.sum("value").alias("value"))


def new_content(listing: DataFrame, photos: DataFrame) -> DataFrame:
    """Of listed files (path, sha1) those neither known by path nor by content; one of each content, the first path."""
    rest = listing.join(photos.select("path"), "path", "left_anti").join(photos.filter("sha1 is not null").select("sha1"), "sha1", "left_anti")
    first = rest.groupBy("sha1").agg(F.min("path").alias("path"))
    return rest.join(first, ["sha1", "path"], "left_semi")


def orphans(derivatives: DataFrame, photos: DataFrame, crops: str | None = None) -> DataFrame:
    """Derived files (path) whose content no photo has, crops (below the folder crops, by photo id) of no photo, and unfinished ones."""
    name = F.element_at(F.split("path", "/"), -1)
    below = F.lit(False) if crops is None else F.startswith("path", F.lit(crops.rstrip("/") + "/"))
    d = derivatives.withColumns({"_sha": F.element_at(F.split(name, "[._]"), 1), "_crop": F.when(below, F.element_at(F.split("path", "/"), -2).try_cast("long")), "_below": below})
    part = F.coalesce(F.endswith(name, F.lit(".part")), F.lit(False))
    whole = d.filter(~part & ~F.col("_below")).join(photos.select(F.col("sha1").alias("_s")), F.col("_sha") == F.col("_s"), "left_anti")
    cut = d.filter(~part & F.col("_below")).join(photos.select(F.col("id").alias("_i")), F.col("_crop") == F.col("_i"), "left_anti") if crops is not None else d.limit(0)
    return whole.unionByName(cut).unionByName(d.filter(part)).drop("_sha", "_crop", "_below")


def gone(photos: DataFrame, listing: DataFrame, root: str | None = None) -> DataFrame:
    """id of the photos whose file isn't listed any more (path); with a root only of those below it, as the listing says nothing of others."""
    known = photos if root is None else photos.filter(F.startswith("path", F.lit(root.rstrip("/") + "/")))
    return known.join(listing.select("path"), "path", "left_anti").select("id")


def pruned(photos: DataFrame, listing: DataFrame, root: str | None = None) -> DataFrame:
    """photos whose file is still listed, or isn't below the root."""
    return photos.join(gone(photos, listing, root).select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti").select(*photos.columns)


def export_plan(photos: DataFrame, ids: DataFrame, dest: str) -> DataFrame:
    """id, path, target for each asked id; equal file names after the first get their id; unknown ids have no path."""
    p = ids.select(F.col("id").alias("_id")).join(photos.select("id", "path", "filename"), F.col("_id") == F.col("id"), "left")
    k = F.row_number().over(Window.partitionBy("filename").orderBy("_id"))
    stem, ext = F.regexp_extract("filename", r"\A(.*?)(\.[^.]*)?\z", 1), F.regexp_extract("filename", r"\A(.*?)(\.[^.]*)?\z", 2)
    name = F.when(k == 1, F.col("filename")).otherwise(F.concat(stem, F.lit("_"), F.col("_id").cast("string"), ext))
    return p.select(F.col("_id").alias("id"), "path", F.when(F.col("id").isNotNull(), F.concat(F.lit(f"{dest}/"), name)).alias("target"))


def integrity(photos: DataFrame, faces: DataFrame, persons: DataFrame, negatives: DataFrame) -> DataFrame:
    """check, n: rows that refer to what isn't there."""
    c = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    out = c(faces.join(photos.select(F.col("id").alias("_i")), F.col("photo_id") == F.col("_i"), "left_anti"), "face without photo")
    out = out.unionByName(c(faces.filter("person_id is not null").join(persons.select(F.col("id").alias("_i")), F.col("person_id") == F.col("_i"), "left_anti"), "face of no person"))
    return out.unionByName(c(negatives.join(faces.select(F.col("id").alias("_i")), F.col("face_id") == F.col("_i"), "left_anti"), "negative of no face"))


def commit_prepared(photos: DataFrame, faces: DataFrame, prepared: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos, faces) after a batch of decoded files.

    prepared: a row a file with path, other indexed columns, and embedding and phash, which replace
    the old ones only where they are given. found: the faces in them (path, and the columns of
    faces but id and photo_id). Labels that persons gave carry over to the new faces that overlap the
    old ones most; the files' other faces are replaced, and the counts are those of the new faces.
    """
    out = upsert_photos(photos, prepared.drop("embedding", "phash"))
    extra = [c for c in ("embedding", "phash") if c in prepared.columns and c in photos.columns]
    new = prepared.select(F.col("path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in extra])
    out = checkpointed(out.join(new, F.col("path") == F.col("_path"), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in extra}).drop("_path", *[f"_{c}" for c in extra]))
    batch = out.join(prepared.select("path"), "path", "left_semi").select(F.col("id").alias("photo_id"), "path")
    top = faces.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = found.join(batch, "path").withColumn("_order", F.struct("photo_id", "bbox"))
    fresh = numbered(fresh, top, "_order").drop("_order", "path")
    fresh = checkpointed(fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None).cast(faces.schema[c].dataType)).alias(c) for c in faces.columns]))
    old = faces.join(batch.select("photo_id"), "photo_id", "left_semi")
    kept = carry_labels(old, fresh).select(F.col("new_id").alias("_id"), F.col("person_id").alias("_who"))
    fresh = fresh.join(kept, F.col("id") == F.col("_id"), "left")
    fresh = fresh.withColumns({"person_id": F.coalesce("_who", "person_id"), "confidence": F.when(F.col("_who").isNotNull(), 1.0).otherwise(F.col("confidence"))}).drop("_id", "_who")
    rest = faces.join(batch.select("photo_id"), "photo_id", "left_anti").select(*faces.columns)
    faces = rest.unionByName(fresh.select(*faces.columns))
    return recount(out, faces), faces
