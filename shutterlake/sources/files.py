"""Scans of media files and what is derived from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import camera, capture_time, exif_moment, filename_date, folder_meta, gps, is_image, is_video, place_label, probe
from ..operators.timeline import nearest_city

CITY_DDL = "name string, admin string, country string, country_code string, lat double, lon double"


def local_path(path: Column) -> Column:
    """A listing's path without its scheme."""
    return F.regexp_replace(path, r"\A\w+:(//)?", "")


def local(path: str) -> str:
    """The same of one path on the driver."""
    return re.sub(r"\A\w+:(//)?", "", path).rstrip("/")


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path, modified, length, sha1 of every file below root; hashing is part of the distributed scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    cols = [local_path(F.col("path")).alias("path"), F.col("modificationTime").alias("modified"), F.col("length")]
    return files.select(*cols, *([F.sha1("content").alias("sha1")] if content else []))


def routed(listing: DataFrame, derived_roots: list[str]) -> DataFrame:
    """listing without the catalog's own derivatives, each file marked photo, video or other."""
    own = F.lit(False)
    for r in derived_roots:
        own = own | F.startswith("path", F.lit(r.rstrip("/") + "/"))
    return listing.filter(~own).withColumn("kind", F.when(is_image(F.col("path")), "photo").when(is_video(F.col("path")), "video").otherwise("other"))


def described(files: DataFrame, exif: Column | None, last_year: int, container: Column | None = None) -> DataFrame:
    """files with what their name, folders, tags and container tell.

    exif: a map of tags as text; container: a video probe's JSON; null where a file has none. Added are
    filename, taken_at, taken_source, folder_place, and, of tags or container, lat, lon, camera_make,
    camera_model; width and height of a container where the files have none.
    """
    none = F.lit(None)
    name = F.element_at(F.split("path", "/"), -1)
    meta = folder_meta(F.col("path"))
    from_folder = F.when(meta["year"].isNotNull(), F.date_format(F.make_date(meta["year"], F.coalesce(meta["month"], F.lit(1)), F.lit(1)), "yyyy-MM-dd'T'HH:mm:ss"))
    mtime = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    tags = exif if exif is not None else none.cast("map<string,string>")
    probed = probe(container) if container is not None else None
    of_video = lambda f: probed[f] if probed is not None else none
    when = capture_time(exif_moment(tags), filename_date(name, last_year), from_folder, mtime, of_video("taken_at").cast("string"))
    out = {"filename": name, "taken_at": when["taken_at"], "taken_source": when["source"], "folder_place": meta["place"]}
    out |= {c: F.coalesce(gps(tags)[c], of_video(c).cast("double")) for c in ("lat", "lon")}
    out |= {f"camera_{c}": camera(tags)[c] for c in ("make", "model")}
    if probed is not None:
        out |= {c: F.coalesce(F.col(c), of_video(c)) if c in files.columns else of_video(c) for c in ("width", "height")}
    return files.withColumns(out)


def geocoded(files: DataFrame, cities: DataFrame) -> DataFrame:
    """files (lat, lon) with place_city, place_country and place_label of the nearest city."""
    near = nearest_city(files, cities)
    return near.select(*files.columns, F.col("city").alias("place_city"), F.col("country").alias("place_country"), F.when(F.col("city").isNotNull(), place_label(F.col("city"), F.col("country"))).alias("place_label"))


def country_names(cities: DataFrame) -> DataFrame:
    """country_code, country: the names that the city table has for its codes."""
    return cities.filter("country_code <> ''").groupBy("country_code").agg(F.max_by("country", "n").alias("country"))


def country_name(code: Column, names: DataFrame) -> Column:
    """A code's name, or the code itself; names is a table of some hundred rows."""
    known = F.create_map(*[F.lit(x) for r in names.limit(1000).collect() for x in (r["country_code"], r["country"])]) if not names.isEmpty() else None
    return F.coalesce(F.try_element_at(known, code), code) if known is not None else code


def derive(files: DataFrame, decode: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One Python stage that decodes each file once and derives all that needs its pixels.

    decode gets a batch of files and returns columns of `schema`: size, faces, vectors, hash. Models
    are loaded by decode itself, once in each worker. Tests pass a deterministic stub.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield decode(b)

    return files.mapInPandas(run, schema)


def cities(spark: SparkSession, path: str) -> DataFrame:
    """The city table, a CSV with a header, numbered in the order of its lines."""
    c = spark.read.csv(path, header=True, schema=CITY_DDL)
    return c.select(F.monotonically_increasing_id().alias("n"), "name", "country", "country_code", F.col("lat").alias("clat"), F.col("lon").alias("clon"))


def demo(spark: SparkSession, count: int = 24, seed: int = 7) -> DataFrame:
    """A small synthetic library: photos over years and places, by arithmetic on a seeded hash."""
    h = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    city = F.element_at(F.array(*[F.lit(x) for x in ("Rome", "Paris", "Berlin", "Madrid", "Oslo")]), (h % 5 + 1).cast("int"))
    day = F.date_add(F.lit("2010-01-01").cast("date"), (h % 5400).cast("int"))
    return spark.range(1, count + 1).select(
        "id", F.format_string("/demo/%s/photo_%04d.jpg", F.year(day), F.col("id")).alias("path"), F.format_string("photo_%04d.jpg", F.col("id")).alias("filename"),
        F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")).alias("sha1"), F.date_format(day, "yyyy-MM-dd'T'10:00:00").alias("taken_at"), city.alias("place_city"),
        (h % 3).cast("int").alias("face_count"), F.lit(False).alias("hidden"), F.lit(False).alias("favorite"), F.lit(False).alias("is_video"),
    )
