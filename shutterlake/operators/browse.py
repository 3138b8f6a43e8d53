"""Browsing: filtered lists, sorts, pages, one photo's detail, map points."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import LISTED
from .predicates import fold, select

#: Sort name -> key and direction; the id breaks ties in the same direction. Null is the least.
SORTS: dict[str, tuple[Any, bool]] = {
    "newest": (lambda: F.col("taken_at"), False),
    "oldest": (lambda: F.col("taken_at"), True),
    "filename": (lambda: fold(F.col("filename")), True),
    "filename_desc": (lambda: fold(F.col("filename")), False),
    "indexed": (lambda: F.col("indexed_at"), False),
}


def order(sort: str | None) -> list[Column]:
    key, up = SORTS.get(sort or "", SORTS["newest"])
    return [key().asc_nulls_first(), F.col("id").asc()] if up else [key().desc_nulls_last(), F.col("id").desc()]


def listed(photos: DataFrame) -> DataFrame:
    return photos.select(*[c for c in LISTED if c in photos.columns])


def search(photos: DataFrame, faces: DataFrame | None, filters: Mapping[str, Any], limit: int = 60, offset: int = 0, count: bool = True) -> tuple[DataFrame, int]:
    """(a page of rows with their position rank, all matches or -1).

    The page is the least `offset + limit` rows under the sort, found by a bounded heap in each task,
    so the whole match is never sorted; only the page's rows are numbered.
    """
    hits = select(photos, faces, filters)
    total = hits.count() if count else -1
    by = order(filters.get("sort"))
    page = listed(hits).orderBy(*by).limit(offset + limit)
    rank = F.row_number().over(Window.orderBy(*by))  # over at most offset + limit rows
    return page.withColumn("rank", rank.cast("long")).filter(F.col("rank") > offset), total


def detail(photos: DataFrame, faces: DataFrame, persons: DataFrame, photo_id: int) -> DataFrame:
    """One photo with its faces and their names, in the order of face id."""
    named = faces.filter(F.col("photo_id") == photo_id).join(persons.select(F.col("id").alias("pid"), "name"), F.col("person_id") == F.col("pid"), "left")
    of = named.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("id", "person_id", "name", "confidence"))).alias("faces"))
    return photos.filter(F.col("id") == photo_id).join(of, F.col("photo_id") == F.col("id"), "left").drop("photo_id")


def map_points(photos: DataFrame, faces: DataFrame | None, filters: Mapping[str, Any], limit: int = 50_000) -> DataFrame:
    """id, lat, lon, year of the matches that have both coordinates, the least ids if there are more."""
    hits = select(photos, faces, filters).filter("lat is not null and lon is not null")
    return hits.select("id", "lat", "lon", F.substring("taken_at", 1, 4).alias("year")).orderBy("id").limit(limit)


def ranked_page(photos: DataFrame, ranked: DataFrame, limit: int = 60, offset: int = 0) -> tuple[DataFrame, int]:
    """(list rows of a page of ranked ones, in rank order, all ranked).

    ranked: id, score, rank and maybe more, at most top_k rows, which are found once and held; so a
    page's join is with a side of bounded size.
    """
    top = ranked.collect()  # top_k rows at most
    held = photos.sparkSession.createDataFrame([r for r in top if offset < r["rank"] <= offset + limit], ranked.schema)
    return listed(photos).join(F.broadcast(held), "id").orderBy("rank"), len(top)
