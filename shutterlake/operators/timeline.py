"""Trips, on-this-day, places: photos in the order of time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import EARTH_KM, haversine_km

#: Cities that are looked through for a point far from all of them.
MOST_CITIES = 50_000
#: Edge of the cubes by which points meet cities, in radii of the earth: 127 km.
CUBE = 0.02
#: Texts that are taken for a time; others have none.
STAMP = r"\A\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?([+-]\d{2}:\d{2}|Z)?\z"


def moment(taken_at: Column) -> Column:
    """Seconds of the wall clock in taken_at; its offset, if any, is dropped."""
    plain = F.regexp_extract(taken_at, r"\A(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?)", 1)
    return F.when(F.regexp_like(taken_at, F.lit(STAMP)), F.unix_micros(F.try_to_timestamp(plain)) / 1e6)


def trips(photos: DataFrame, by: list[str] | None = None, gap_days: float = 2.0, gap_km: float = 200.0, min_photos: int = 4, per_trip: int = 12) -> DataFrame:
    """One row a trip: its key columns, trip number, start, end, n, place, lat, lon, cover, sample.

    A trip ends where more than gap_days pass, or, if any time passes, more than gap_km lie between
    two known positions; the last known time and position are carried over trips. `by` names owner
    columns whose photos are told apart. The order of time is cut into days: rows are ordered within
    a day, and the state carried from day to day - last time, last position, trips so far - is a
    window over one row a day, so no window holds a library, nor a long trip: of a trip, each day
    gives its first photos, and the first of those are the trip's.
    """
    by = by or []
    p = photos.filter("taken_at is not null").withColumns({"t": moment(F.col("taken_at")), "day": F.substring("taken_at", 1, 10), "ll": F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon")), "at": F.struct("taken_at", "id")})
    within = Window.partitionBy(*by, "day").orderBy("taken_at", "id")
    before, upto = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)
    days = Window.partitionBy(*(by or [F.lit(0)])).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    ends = p.groupBy(*by, "day").agg(F.max_by("t", F.when(F.col("t").isNotNull(), F.col("at"))).alias("t"), F.max_by("ll", F.when(F.col("ll").isNotNull(), F.col("at"))).alias("ll"))
    carried = ends.select(*by, "day", F.last("t", ignorenulls=True).over(days).alias("t1"), F.last("ll", ignorenulls=True).over(days).alias("l1"))
    p = p.join(carried, [*by, "day"])
    p = p.withColumns({"t0": F.coalesce(F.last("t", ignorenulls=True).over(before), "t1"), "l0": F.coalesce(F.last("ll", ignorenulls=True).over(before), "l1")})
    gap = (F.col("t") - F.col("t0")) / 86400.0
    far = haversine_km(F.col("l0.lat"), F.col("l0.lon"), F.col("lat"), F.col("lon")) > gap_km
    breaks = F.coalesce(gap > gap_days, F.lit(False)) | (F.coalesce(gap > 0, F.lit(False)) & F.coalesce(far, F.lit(False)))
    p = p.withColumn("breaks", breaks.cast("long"))
    base = p.groupBy(*by, "day").agg(F.sum("breaks").alias("m")).select(*by, "day", F.coalesce(F.sum("m").over(days), F.lit(0)).alias("base"))
    p = p.withColumn("trip", F.sum("breaks").over(upto)).join(base, [*by, "day"]).withColumn("trip", F.col("trip") + F.col("base"))
    group = [*by, "trip"]
    p = p.withColumn("pos", F.row_number().over(Window.partitionBy(*by, "day", "trip").orderBy("taken_at", "id")))
    known = F.col("ll").isNotNull()
    sample = F.slice(F.array_sort(F.collect_list(F.when(F.col("pos") <= per_trip, F.col("at")))), 1, per_trip)
    main = p.groupBy(*group).agg(
        F.min("taken_at").alias("start"), F.max("taken_at").alias("end"), F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(known, F.col("lat"))), 6).alias("lat"), F.round(F.avg(F.when(known, F.col("lon"))), 6).alias("lon"),
        F.coalesce(F.min_by(F.when(known, F.col("id")), F.when(known, F.col("at"))), F.min_by("id", "at")).alias("cover"),
        F.transform(sample, lambda s: s["id"]).alias("sample"),
    ).filter(F.col("n") >= min_photos)
    names = [F.col("place_label"), F.col("folder_place"), F.concat_ws(", ", "place_city", "place_country")]
    kinds = F.array(*[F.struct(F.lit(i).alias("rank"), F.nullif(v, F.lit("")).alias("v")) for i, v in enumerate(names)])
    seen = p.select(*group, "at", F.inline(kinds)).filter("v is not null").groupBy(*group, "rank", "v").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("f"))
    place = seen.groupBy(*group).agg(F.min_by("v", F.struct("rank", (-F.col("c")).alias("c"), "f")).alias("place"))
    return main.join(place, group, "left") if by else main.join(place, "trip", "left")


def on_this_day(photos: DataFrame, month: int, day: int, per_year: int = 24) -> DataFrame:
    """year, count and the first photos of the day in each year."""
    hits = photos.filter((F.substring("taken_at", 6, 2) == f"{month:02d}") & (F.substring("taken_at", 9, 2) == f"{day:02d}"))
    hits = hits.select(F.substring("taken_at", 1, 4).alias("year"), "taken_at", "id")
    k = F.row_number().over(Window.partitionBy("year").orderBy("taken_at", "id"))
    first = hits.withColumn("k", k)
    return first.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= per_year, F.struct("k", "id")))), lambda s: s["id"]).alias("sample"))


def memories_total(found: DataFrame) -> DataFrame:
    """total: photos of the day over all years."""
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def _cube(lat: Column, lon: Column) -> list[Column]:
    """Which cube of edge CUBE, along three axes, a place on the ball of radius 1 lies in."""
    p, q = F.radians(lat), F.radians(lon)
    return [F.floor(x / CUBE) for x in (F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))]


def nearest_city(points: DataFrame, cities: DataFrame) -> DataFrame:
    """points with the name, country and distance of the nearest city; the first listed of equals.

    cities (n, name, country, clat, clon) is a table of at most MOST_CITIES rows, which is checked. Each
    is listed in its cube and the 26 around it, so a point's own cube lists all cities within an edge,
    and the nearest of them is the nearest of all if it is that near. Points meet their list by an
    equi-join; only those with no city so near look through all cities, an array of one broadcast row.
    """
    if cities.limit(MOST_CITIES + 1).count() > MOST_CITIES:
        raise ValueError(f"more than {MOST_CITIES} cities: points far from all of them look through each")
    entry = F.struct("n", "name", "country", "clat", "clon")
    listed = cities.agg(F.array_sort(F.collect_list(entry)).alias("__all"))
    near = cities.select(entry.alias("__city"), *[c.alias(x) for c, x in zip(_cube(F.col("clat"), F.col("clon")), "xyz", strict=True)])
    for x in "xyz":
        near = near.withColumn(x, F.explode(F.array(F.col(x) - 1, F.col(x), F.col(x) + 1)))
    near = near.groupBy(F.struct("x", "y", "z").alias("__cube")).agg(F.collect_list("__city").alias("__near"))
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    at = F.struct(*[c.alias(x) for c, x in zip(_cube(F.col("lat"), F.col("lon")), "xyz", strict=True)])
    d = lambda c: F.struct(haversine_km(F.col("lat"), F.col("lon"), c["clat"], c["clon"], clamp=True).alias("km"), c["n"].alias("n"), c["name"].alias("name"), c["country"].alias("country"))
    out = points.withColumn("__at", at).join(F.broadcast(near), F.col("__at") == F.col("__cube"), "left")  # 27 entries a city
    out = out.crossJoin(F.broadcast(listed)).withColumn("__best", F.when(known, F.array_min(F.transform("__near", d))))
    sure = F.col("__best.km") <= 2 * EARTH_KM * math.asin(CUBE / 2) * (1 - 1e-9)
    best = F.when(sure, F.col("__best")).when(known, F.array_min(F.transform("__all", d)))
    out = out.withColumn("__best", best)
    return out.select(*points.columns, F.col("__best.name").alias("city"), F.col("__best.country").alias("country"), F.col("__best.km").alias("km"))
