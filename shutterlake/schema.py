"""Table schemas of a media catalog, and the engine's settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PHOTO_DDL = (
    "id long, path string, filename string, sha1 string, width int, height int, bytes long, taken_at string, taken_source string, "
    "camera_make string, camera_model string, lat double, lon double, place_city string, place_country string, place_label string, "
    "folder_place string, scene_type string, scene_scores string, face_count int, named_face_count int, favorite boolean, "
    "is_video boolean, hidden boolean, thumb_path string, embedding array<float>, phash string, indexed_at string"
)
FACE_DDL = "id long, photo_id long, person_id long, cluster_id int, bbox struct<x:int,y:int,w:int,h:int>, embedding array<float>, crop_path string, confidence double, region_embedding array<float>"
PERSON_DDL = "id long, name string, cover_face_id long, created_at string"
NEGATIVE_DDL = "face_id long, person_id long"
SAVED_SEARCH_DDL = "id long, name string, query string"

#: Columns that a new indexing of a file sets; the others are the user's, or derived.
INDEXED = (
    "path", "filename", "sha1", "width", "height", "bytes", "taken_at", "taken_source", "camera_make", "camera_model", "lat", "lon",
    "place_city", "place_country", "place_label", "folder_place", "scene_type", "scene_scores", "face_count", "thumb_path", "indexed_at",
)
#: Columns of a list row: never the scores, vectors or hashes.
LISTED = ("id", *(c for c in INDEXED if c != "scene_scores"), "favorite", "is_video", "hidden")


@dataclass(frozen=True)
class Settings:
    """Thresholds and limits, with the defaults of the catalog application."""

    page: int = 60
    map_points: int = 50_000
    per_year: int = 24
    semantic_top_k: int = 200
    face_match: float = 0.5
    recognition_k: int = 5
    review_confidence: float = 0.6
    scene_temperature: float = 50.0
    scene_other_bias: float = -0.02
    scene_face_bonus: float = 0.04
    cluster_eps: float = 0.5
    cluster_min: int = 2
    trip_gap_days: float = 2.0
    trip_gap_km: float = 200.0
    trip_min: int = 4
    trip_sample: int = 12
    burst_distance: int = 10
    burst_gap_s: float = 10.0
    burst_min: int = 2


def reconcile(df: DataFrame, ddl: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with the columns of the schema, in its order and types; missing ones null or their default.

    Additive evolution: a table written under an older schema reads under the newer one. Columns the
    schema doesn't know stay, at the end.
    """
    schema = T.StructType.fromDDL(ddl)
    have = set(df.columns)
    known = [(F.col(f.name) if f.name in have else F.lit((defaults or {}).get(f.name))).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*known, *[c for c in df.columns if c not in schema.names])
