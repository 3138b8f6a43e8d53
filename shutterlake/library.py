"""A stored library and the changes made to it: each is one commit of all the tables it touches."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .catalog import Catalog
from .functions.media import content_path, poster_path
from .operators import entity, mutate, people
from .sources import export, files
from .sources.store import Store

_TABLES = (("faces", "faces", schema.FACE_DDL), ("persons", "persons", schema.PERSON_DDL), ("face_negatives", "negatives", schema.NEGATIVE_DDL), ("saved_searches", "searches", schema.SAVED_SEARCH_DDL))


class StoredCatalog(Catalog):
    """A catalog read from the store's current version; tables not committed yet are empty."""

    def __init__(self, spark: SparkSession, store: Store):
        super().__init__(spark, store.root)
        self.store = store
        known = store.tables()
        for name, attribute, ddl in _TABLES:
            setattr(self, attribute, schema.reconcile(store.read(name), ddl) if name in known else spark.createDataFrame([], ddl))
        self.photos = self.evolved(store.read("photos")) if "photos" in known else spark.createDataFrame([], schema.PHOTO_DDL)


class Library:
    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store

    @property
    def catalog(self) -> StoredCatalog:
        return StoredCatalog(self.spark, self.store)

    def index(self, root: str, decode: Callable[[DataFrame], DataFrame] | None = None, cities: DataFrame | None = None) -> int:
        """New files below root into the photos, photos first, then videos; how many.

        Files known by path or content are passed over. decode: a step that adds what a decoder reads
        from files (path): exif (map of tags as text), probe (a video probe's JSON), width, height.
        """
        c = self.catalog
        listing = files.routed(files.scan(self.spark, root), [self.store.root]).filter("kind <> 'other'")
        fresh = mutate.new_content(listing, c.photos)
        fresh = decode(fresh) if decode else fresh
        tag = lambda name: F.col(name) if name in fresh.columns else None
        fresh = files.described(fresh, tag("exif"), datetime.date.today().year + 1, tag("probe"))
        fresh = files.geocoded(fresh, cities) if cities is not None else fresh
        fresh = fresh.withColumns({"bytes": F.col("length"), "indexed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")})
        n = fresh.count()
        if n:
            merged = mutate.upsert_photos(c.photos, fresh)
            videos = fresh.filter("kind = 'video'").select(F.col("path").alias("_v"))
            merged = merged.join(videos, F.col("path") == F.col("_v"), "left").withColumn("is_video", F.col("is_video") | F.col("_v").isNotNull()).drop("_v")
            self.store.commit({"photos": merged})
        return n

    def cluster(self, eps: float, least: int) -> DataFrame:
        """Unnamed faces clustered anew and written back; how many faces and clusters."""
        c = self.catalog
        open_ = c.faces.filter("person_id is null and embedding is not null")
        self.store.commit({"faces": people.relabel_clusters(c.faces, entity.dbscan(open_.select("id", "embedding"), eps, least))})
        return self.store.read("faces").filter("cluster_id is not null").agg(F.count(F.lit(1)).alias("faces"), F.count_distinct("cluster_id").alias("clusters"))

    def _without(self, ids: DataFrame) -> None:
        c = self.catalog
        photos, faces, negatives = mutate.delete_photos(c.photos, c.faces, c.negatives, ids)
        self.store.commit({"photos": photos, "faces": faces, "face_negatives": negatives})

    def prune(self, root: str) -> dict[str, int]:
        """Photos below root whose file is gone leave, with their faces and what was said of those; others aren't asked about."""
        c = self.catalog
        local = files.local(root)
        ids = mutate.gone(c.photos, files.scan(self.spark, root, content=False), local)
        before = c.photos.count()
        self._without(ids)
        kept = self.store.read("photos").count()
        return {"removed": before - kept, "kept": kept}

    def delete(self, ids: Sequence[int], thumbs: str | None = None, crops: str | None = None) -> dict[str, int]:
        """Photos out of the catalog, then their files, stills and crops; how many rows and files.

        The rows go first: a file without a row is an orphan that a sweep finds, a row without a file isn't.
        """
        c = self.catalog
        doomed = c.photos.filter(F.col("id").isin(list(ids))).select("id", "path", "sha1")
        paths = [doomed.select("path")]
        if thumbs:
            of: Callable[[Column], list[Column]] = lambda s: [content_path(thumbs, s), poster_path(thumbs, s)]
            paths += [doomed.filter("sha1 is not null").select(x.alias("path")) for x in of(F.col("sha1"))]
        if crops:
            paths.append(c.faces.join(doomed.select(F.col("id").alias("_i")), F.col("photo_id") == F.col("_i"), "left_semi").filter("crop_path is not null").select(F.concat(F.lit(f"{crops.rstrip('/')}/"), "crop_path").alias("path")))
        listed = paths[0]
        for p in paths[1:]:
            listed = listed.unionByName(p)
        asked = [r["path"] for r in listed.collect()]  # files of the ids that were asked for
        rows = doomed.count()
        self._without(self.spark.createDataFrame([(i,) for i in ids], "id long"))
        return {"rows": rows, "files": export.delete_files(self.spark.createDataFrame([(p,) for p in asked], "path string")) if asked else 0}

    def sweep(self, derived: str, crops: str | None = None) -> int:
        """Derivatives of no photo, and unfinished ones, unlinked; how many."""
        found = files.scan(self.spark, derived, content=False).select("path")
        return export.delete_files(mutate.orphans(found, self.catalog.photos, crops))

    def backfill(self, column: str, compute: Callable[[DataFrame], DataFrame], recompute: bool = False, videos: bool = False) -> int:
        """A derived column of the photos where it is missing, or everywhere; how many were looked at.

        compute: a step from photos to (id, value): labels, vectors or hashes by whatever encoder it holds.
        """
        c = self.catalog
        todo = mutate.missing(c.photos, column, recompute, videos)
        n = todo.count()
        if n:
            self.store.commit({"photos": mutate.set_column(c.photos, column, compute(todo))})
        return n

    def backfill_regions(self, compute: Callable[[DataFrame], DataFrame], recompute: bool = False) -> int:
        """Region vectors of faces that lack one; compute gets the photos that have such a face, and returns (id, value) of faces."""
        c = self.catalog
        todo = mutate.missing(c.faces, "region_embedding", recompute)
        photos = mutate.with_faces(c.photos, todo)
        n = todo.count()
        if n:
            self.store.commit({"faces": mutate.set_column(c.faces, "region_embedding", compute(photos))})
        return n

    def save_search(self, name: str, query: str) -> None:
        self.store.commit({"saved_searches": mutate.save_search(self.catalog.searches, name, query)})

    def delete_search(self, search_id: int) -> None:
        self.store.commit({"saved_searches": mutate.delete_search(self.catalog.searches, search_id)})

    def searches(self) -> DataFrame:
        return mutate.list_searches(self.catalog.searches)

    def flag(self, name: str, value: bool, ids: Sequence[int]) -> None:
        self.store.commit({"photos": mutate.set_flag(self.catalog.photos, name, value, ids)})

    def export(self, ids: Sequence[int], dest: str) -> dict[str, int]:
        asked = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id long")
        return export.copy_files(mutate.export_plan(self.catalog.photos, asked, dest))


def by_pandas(f: Callable[[pd.DataFrame], pd.DataFrame], value: str) -> Callable[[DataFrame], DataFrame]:
    """A step for backfill from a function of batches of rows that returns id and value of the given type."""

    def run(batches: Any):
        for b in batches:
            yield f(b)

    return lambda df: df.mapInPandas(run, f"id long, value {value}")
