"""The filter language: a dict of keys to a scalar or a list; AND across keys, OR within a key.

None and "" within a value are dropped, and a key whose list is then empty says nothing. Text
matches fold A-Z only, as a case-insensitive match on ASCII does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Scene labels, in display order.
SCENES = ("people", "animals", "landscape", "plants", "food", "vehicle", "building", "document", "screenshot", "other")
SEARCHED = ("filename", "place_city", "place_country", "place_label", "folder_place", "camera_make", "camera_model")
_DAY = re.compile(r"^\d{4}-\d{2}-\d{2}$")

PEOPLE: dict[str, Callable[[], Column]] = {
    "0": lambda: F.col("face_count") == 0,
    "1": lambda: F.col("face_count") == 1,
    "2-4": lambda: F.col("face_count").between(2, 4),
    "5+": lambda: F.col("face_count") >= 5,
}
KNOWN: dict[str, Callable[[], Column]] = {
    "0": lambda: F.col("named_face_count") == 0,
    "1": lambda: F.col("named_face_count") == 1,
    "2+": lambda: F.col("named_face_count") >= 2,
}
KINDS: dict[str, Callable[[], Column]] = {"portrait": lambda: F.col("face_count") == 1, "group": lambda: F.col("face_count") >= 2} | {s: (lambda s=s: F.col("scene_type") == s) for s in SCENES if s != "people"}
_EQUAL = {"scene": "scene_type", "country": "place_country", "city": "place_city", "place": "folder_place", "camera": "camera_model"}
KEYS = ("person_id", *_EQUAL, "year", "date_from", "date_to", "has_faces", "favorite", "hidden", "people", "known", "kind", "q")


def fold(c: Column) -> Column:
    """A-Z as a-z."""
    return F.translate(c, _AZ, _AZ.lower())


def as_list(value: Any) -> list[Any]:
    items = list(value) if isinstance(value, (list, tuple, set)) else [value]
    return [v for v in items if v is not None and v != ""]


def escape_like(text: str) -> str:
    """text as a literal part of a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def union(existing: Any, derived: Any) -> list[Any]:
    """Both lists' items, each once, in order."""
    return list(dict.fromkeys([*as_list(existing), *as_list(derived)]))


def _any(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs)


def clauses(filters: Mapping[str, Any]) -> dict[str, Column]:
    """The predicate of each key that says something, but for person_id, which is a join."""
    out: dict[str, Column] = {}
    for key, column in _EQUAL.items():
        if vals := as_list(filters.get(key)):
            out[key] = F.col(column).isin(vals)
    if vals := as_list(filters.get("year")):
        out["year"] = F.substring("taken_at", 1, 4).isin([str(v) for v in vals])
    if v := filters.get("date_from"):
        out["date_from"] = F.substring("taken_at", 1, 10) >= v
    if v := filters.get("date_to"):
        out["date_to"] = F.substring("taken_at", 1, 10) <= v
    if filters.get("has_faces"):
        out["has_faces"] = F.col("face_count") > 0
    if filters.get("favorite"):
        out["favorite"] = F.col("favorite")
    if "hidden" in filters:
        out["hidden"] = F.col("hidden") if filters["hidden"] else ~F.col("hidden")
    for key, buckets in (("people", PEOPLE), ("known", KNOWN), ("kind", KINDS)):
        if tests := [buckets[t]() for t in map(str, as_list(filters.get(key))) if t in buckets]:
            out[key] = _any(tests)
    if q := filters.get("q"):
        needle = q.translate(str.maketrans(_AZ, _AZ.lower()))
        out["q"] = _any([F.coalesce(F.contains(fold(F.col(c)), F.lit(needle)), F.lit(False)) for c in SEARCHED])
    return out


def with_persons(photos: DataFrame, faces: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """The photos that show any, or with person_mode 'all' every one, of the persons asked for."""
    ids = as_list(filters.get("person_id"))
    if not ids:
        return photos
    hits = faces.filter(F.col("person_id").isin(ids)).select(F.col("photo_id").alias("id"), "person_id")
    if filters.get("person_mode") == "all" and len(set(ids)) > 1:
        hits = hits.groupBy("id").agg(F.count_distinct("person_id").alias("n")).filter(F.col("n") == len(set(ids)))
    return photos.join(hits.select("id"), "id", "left_semi")


def select(photos: DataFrame, faces: DataFrame | None, filters: Mapping[str, Any]) -> DataFrame:
    """The photos that a filter dict asks for."""
    for c in clauses(filters).values():
        photos = photos.filter(c)
    return with_persons(photos, faces, filters) if faces is not None else photos


def validate(filters: Mapping[str, Any], limit: int = 60, offset: int = 0, month: int | None = None, day: int | None = None) -> None:
    """Raise ValueError for what the public surface refuses."""
    for key in ("date_from", "date_to"):
        if (v := filters.get(key)) and not _DAY.match(str(v)):
            raise ValueError(f"{key} must be YYYY-MM-DD")
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset 0 or more")
    if month is not None and not 1 <= month <= 12 or day is not None and not 1 <= day <= 31:
        raise ValueError("no such day")
