"""Facets: counts of each value under the filters of all other keys.

`facets_fused` computes every facet in one pass over the photos: each active key's predicate becomes
a boolean, each facet counts rows that satisfy all but its own, and value facets of all dimensions
share one grouped count. `facet` computes one alone; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import KINDS, clauses, select, with_persons

#: Facet -> (column, the filter key it leaves out).
VALUES = {
    "scene": ("scene_type", "scene"),
    "country": ("place_country", "country"),
    "city": ("place_city", "city"),
    "place": ("folder_place", "place"),
    "camera": ("camera_model", "camera"),
}
PEOPLE_ORDER, KNOWN_ORDER = ("0", "1", "2-4", "5+"), ("0", "1", "2+")


def people_bucket() -> Column:
    """0, 1, 2-4 or 5+; no count at all falls to 5+, as a CASE's ELSE takes it."""
    c = F.col("face_count")
    return F.when(c == 0, "0").when(c == 1, "1").when(c.between(2, 4), "2-4").otherwise("5+")


def known_bucket() -> Column:
    c = F.col("named_face_count")
    return F.when(c == 0, "0").when(c == 1, "1").otherwise("2+")


def _value(dimension: str) -> tuple[Column, str]:
    if dimension in VALUES:
        column, key = VALUES[dimension]
        return F.col(column), key
    return {"year": (F.substring("taken_at", 1, 4), "year"), "people": (people_bucket(), "people"), "known": (known_bucket(), "known")}[dimension]


def without(filters: Mapping[str, Any], *keys: str) -> dict[str, Any]:
    return {k: v for k, v in filters.items() if k not in keys}


def facet(photos: DataFrame, faces: DataFrame | None, filters: Mapping[str, Any], dimension: str) -> DataFrame:
    """value, n of one dimension; null is dropped, the empty string kept."""
    v, key = _value(dimension)
    return select(photos, faces, without(filters, key)).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("value is not null")


def ordered(df: DataFrame, dimension: str) -> DataFrame:
    """A facet's rows in display order."""
    if dimension == "year":
        return df.orderBy(F.desc("value"))
    return df.orderBy("value") if dimension in ("people", "known") else df.orderBy(F.desc("n"), "value")


def kinds(photos: DataFrame, faces: DataFrame | None, filters: Mapping[str, Any]) -> DataFrame:
    """Overlapping picture types in one scan; types without a photo are left out."""
    hits = select(photos, faces, without(filters, "kind"))
    counts = hits.agg(*[F.count_if(p()).alias(k) for k, p in KINDS.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("value"), F.col(k).alias("n")) for k in KINDS])
    return counts.select(F.inline(pairs)).filter("n > 0")


def persons_facet(photos: DataFrame, faces: DataFrame, persons: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """person_id, name and in how many of the matches each is."""
    hits = select(photos, faces, without(filters, "person_id", "person_mode")).select(F.col("id").alias("p"))
    n = faces.filter("person_id is not null").join(hits, F.col("photo_id") == F.col("p"), "left_semi").groupBy("person_id").agg(F.count_distinct("photo_id").alias("n"))
    return n.join(persons.select(F.col("id").alias("pid"), "name"), F.col("person_id") == F.col("pid")).select("person_id", "name", "n")


def flags(photos: DataFrame, faces: DataFrame | None, filters: Mapping[str, Any]) -> DataFrame:
    """with_faces, favorites, hidden, total; total counts all photos whatever the filters."""
    ps = clauses(filters)
    base = with_persons(photos, faces, filters) if faces is not None else photos
    others = lambda key: reduce(lambda a, b: a & b, [p for k, p in ps.items() if k != key], F.lit(True))
    counts = base.agg(F.count_if((F.col("face_count") > 0) & others("has_faces")).alias("with_faces"), F.count_if(F.col("favorite") & others("favorite")).alias("favorites"), F.count_if(F.col("hidden") & others("hidden")).alias("hidden"))
    return counts.crossJoin(F.broadcast(photos.agg(F.count(F.lit(1)).alias("total"))))  # one row each


def date_bounds(photos: DataFrame, faces: DataFrame | None, filters: Mapping[str, Any]) -> DataFrame:
    day = F.substring("taken_at", 1, 10)
    return select(photos, faces, without(filters, "date_from", "date_to")).agg(F.min(day).alias("first"), F.max(day).alias("last"))


def sources(photos: DataFrame) -> DataFrame:
    """How many photos have their date from where; unknown counts as the file's time."""
    return photos.groupBy(F.coalesce("taken_source", F.lit("mtime")).alias("taken_source")).agg(F.count(F.lit(1)).alias("n"))


def facets_fused(photos: DataFrame, faces: DataFrame | None, filters: Mapping[str, Any]) -> DataFrame:
    """dimension, value, n of all value, bucket and picture-type facets in one pass over the photos."""
    ps = clauses(filters)
    base = with_persons(photos, faces, filters) if faces is not None else photos
    flagged = base.withColumns({f"ok_{k}": F.coalesce(p, F.lit(False)) for k, p in ps.items()})
    others = lambda key: reduce(lambda a, b: a & b, [F.col(f"ok_{k}") for k in ps if k != key], F.lit(True))
    cells = [F.struct(F.lit(d).alias("dimension"), v.alias("value"), others(key).alias("ok")) for d in (*VALUES, "year", "people", "known") for v, key in [_value(d)]]
    cells += [F.struct(F.lit("kind").alias("dimension"), F.lit(k).alias("value"), (others("kind") & F.coalesce(p(), F.lit(False))).alias("ok")) for k, p in KINDS.items()]
    return flagged.select(F.inline(F.array(*cells))).filter("ok and value is not null").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
