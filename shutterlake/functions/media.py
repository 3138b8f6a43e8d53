"""Scalars mined from names and metadata: file names, folders, EXIF, video containers, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in English and Italian.
MONTHS = {
    "jan": 1, "january": 1, "gen": 1, "gennaio": 1, "feb": 2, "february": 2, "febbraio": 2, "mar": 3, "march": 3, "marzo": 3,
    "apr": 4, "april": 4, "aprile": 4, "may": 5, "mag": 5, "maggio": 5, "jun": 6, "june": 6, "giu": 6, "giugno": 6,
    "jul": 7, "july": 7, "lug": 7, "luglio": 7, "aug": 8, "august": 8, "ago": 8, "agosto": 8,
    "sep": 9, "sept": 9, "september": 9, "set": 9, "settembre": 9, "oct": 10, "october": 10, "ott": 10, "ottobre": 10,
    "nov": 11, "november": 11, "novembre": 11, "dec": 12, "december": 12, "dic": 12, "dicembre": 12,
}
#: Suffixes of files that are indexed.
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic")
VIDEOS = (".mov", ".mp4", ".m4v", ".avi", ".3gp", ".mkv", ".webm", ".mts", ".wmv")
FIRST_YEAR = 1990
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
#: File name patterns in the order they are tried, with the places of year, month, day, hour, minute, second.
DATED = (
    (r"(?i)(?<!\d)(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})\d*_iOS", (1, 2, 3, 4, 5, 6)),
    (r"(?i)(?:IMG|VID)-(\d{4})(\d{2})(\d{2})-WA\d+", (1, 2, 3)),
    (r"(?i)(?:IMG|VID|PXL|MVIMG|Screenshot)[_-](\d{4})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})", (1, 2, 3, 4, 5, 6)),
    (r"(?i)WP_(\d{4})(\d{2})(\d{2})_(\d{2})_(\d{2})_(\d{2})", (1, 2, 3, 4, 5, 6)),
    (r"(?i)WP_(\d{4})(\d{2})(\d{2})_\d+", (1, 2, 3)),
    (r"(?<!\d)(\d{4})-(\d{2})-(\d{2})[ _](\d{2})\.(\d{2})\.(\d{2})", (1, 2, 3, 4, 5, 6)),
    (r"(?<!\d)(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})(?!\d)", (1, 2, 3, 4, 5, 6)),
    (rf"(?i)(?<!\d)(\d{{1,2}})[ ._-]({_MONTH})[ ._-](\d{{4}})", (3, -2, 1)),
    (r"(?<!\d)(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\d)", (3, 2, 1)),
)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGES)


def is_video(path: Column) -> Column:
    return suffix(path).isin(*VIDEOS)


def _months() -> Column:
    return F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])


def filename_date(name: Column, last_year: Column | int) -> Column:
    """The capture time a file name tells, as YYYY-MM-DDTHH:MM:SS; the first pattern that makes a real one."""
    tries = []
    for pattern, at in DATED:
        part = lambda k, p=pattern: F.regexp_extract(name, p, abs(k))
        numbers = [F.try_element_at(_months(), F.lower(part(k))) if k < 0 else part(k).try_cast("int") for k in at]
        numbers += [F.lit(0)] * (6 - len(numbers))
        stamp = F.try_make_timestamp_ntz(*numbers)
        ok = numbers[0].between(FIRST_YEAR, F.lit(last_year) if isinstance(last_year, int) else last_year)
        # a leap second or hour 24 isn't a time of day here
        ok = ok & (numbers[3] < 24) & (numbers[4] < 60) & (numbers[5] < 60)
        tries.append(F.when(F.regexp_like(name, F.lit(pattern)) & ok, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")))
    return F.coalesce(*tries)


def _tokens(name: Column) -> Column:
    return F.filter(F.split(F.trim(name), r"[\s_.\-]+"), lambda t: t != "")


def _digits(t: Column) -> Column:
    return F.when(F.regexp_like(t, F.lit(r"\A\d+\z")), t.try_cast("int"))


def folder(name: Column) -> Column:
    """struct(year, month, place) of one folder name; all null without a year from 1900 to 2099."""
    t = _tokens(name)
    at = F.array_position(F.transform(t, lambda x: F.regexp_like(x, F.lit(r"\A(?:19|20)\d{2}\z"))), F.lit(True)).cast("int")
    after = F.slice(t, at + 1, F.size(t))
    first, second = F.get(after, F.lit(0)), F.get(after, F.lit(1))
    month = F.coalesce(F.when(_digits(first).between(1, 12), _digits(first)), F.try_element_at(_months(), F.lower(first)))
    used = F.when(month.isNull(), 0).when(_digits(second).between(1, 31), 2).otherwise(1)
    rest = F.concat(F.slice(t, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(after, used + 1, F.size(t)))
    place = F.nullif(F.trim(F.array_join(rest, " ")), F.lit(""))
    return F.when(at > 0, F.struct(F.element_at(t, F.greatest(at, F.lit(1))).cast("int").alias("year"), month.alias("month"), place.alias("place")))


def month_folder(name: Column) -> Column:
    """The month of a folder that is nothing but a named month, maybe with day or month numbers."""
    t = _tokens(name)
    named = F.array_distinct(F.array_compact(F.transform(t, lambda x: F.try_element_at(_months(), F.lower(x)))))
    plain = F.forall(t, lambda x: F.try_element_at(_months(), F.lower(x)).isNotNull() | F.coalesce(_digits(x).between(1, 31), F.lit(False)))
    return F.when(plain & (F.size(named) == 1), F.get(named, F.lit(0)))


def folder_meta(path: Column) -> Column:
    """struct(year, month, place) from a path's folders; the nearest dated folder that has a field tells it."""
    parts = F.split(path, "/")
    parents = F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    found = F.transform(parents, lambda p: F.struct(folder(p).alias("f"), month_folder(p).alias("m")))
    dated = F.filter(found, lambda x: x["f"].isNotNull())
    nearest = lambda field: F.get(F.filter(F.transform(dated, lambda x: x["f"][field]), lambda v: v.isNotNull()), F.lit(0))
    loose = F.get(F.filter(F.transform(F.filter(found, lambda x: x["f"].isNull()), lambda x: x["m"]), lambda v: v.isNotNull()), F.lit(0))
    return F.struct(nearest("year").alias("year"), F.when(nearest("year").isNotNull(), F.coalesce(nearest("month"), loose)).alias("month"), nearest("place").alias("place"))


def exif_time(value: Column) -> Column:
    """YYYY:MM:DD HH:MM:SS, or with dashes, as YYYY-MM-DDTHH:MM:SS."""
    v = F.trim(value)
    t = F.coalesce(F.try_to_timestamp(v, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(v, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def merged_exif(base: Column, sub: Column) -> Column:
    """One map of a file's base tags and its capture block's; the base wins where both have a tag."""
    own = F.coalesce(base, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
    more = F.map_filter(F.coalesce(sub, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))), lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(own, more)


def capture_settings(exif: Column) -> Column:
    """struct(aperture, shutter, iso, focal, lens) for display, from a map of tags as text."""
    tag = lambda k: F.try_element_at(exif, F.lit(k))
    number = lambda k: F.coalesce(tag(k).try_cast("double"), ratio(F.regexp_extract(tag(k), r"^(-?[\d.]+)/", 1).try_cast("double"), F.regexp_extract(tag(k), r"/(-?[\d.]+)$", 1).try_cast("double")))
    lens = F.nullif(F.trim(F.coalesce(F.nullif(tag("LensModel"), F.lit("")), tag("LensMake"))), F.lit(""))
    return F.struct(aperture(number("FNumber")).alias("aperture"), shutter(number("ExposureTime")).alias("shutter"), iso(F.coalesce(tag("ISOSpeedRatings"), tag("PhotographicSensitivity"))).alias("iso"), focal(number("FocalLength")).alias("focal"), lens.alias("lens"))


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as decimal degrees, negative for S and W; null if any part is."""
    d = degrees + minutes / 60.0 + seconds / 3600.0
    return F.round(F.when(ref.isin("S", "W"), -d).otherwise(d), 6)


def number(text: Column) -> Column:
    """A number as text: decimal, or one over another."""
    return F.coalesce(text.try_cast("double"), ratio(F.regexp_extract(text, r"\A(-?[\d.]+)/", 1).try_cast("double"), F.regexp_extract(text, r"/(-?[\d.]+)\z", 1).try_cast("double")))


def gps(exif: Column) -> Column:
    """struct(lat, lon) from a map of tags as text; null without a reference, or off the globe."""

    def degrees(tag: str, most: float) -> Column:
        parts = F.split(F.trim(F.try_element_at(exif, F.lit(tag))), r"[,;\s]+")
        d = dms(*[number(F.get(parts, F.lit(i))) for i in range(3)], F.upper(F.trim(F.try_element_at(exif, F.lit(f"{tag}Ref")))))
        return F.when(F.map_contains_key(exif, F.lit(f"{tag}Ref")) & d.between(-most, most), d)

    return F.struct(degrees("GPSLatitude", 90.0).alias("lat"), degrees("GPSLongitude", 180.0).alias("lon"))


def camera(exif: Column) -> Column:
    """struct(make, model) without the padding that cameras write."""
    clean = lambda tag: F.nullif(F.trim(F.replace(F.try_element_at(exif, F.lit(tag)), F.lit("\0"), F.lit(" "))), F.lit(""))
    return F.struct(clean("Make").alias("make"), clean("Model").alias("model"))


def exif_moment(exif: Column) -> Column:
    """When a picture was taken: the first of three tags that holds a time."""
    return F.coalesce(*[exif_time(F.try_element_at(exif, F.lit(tag))) for tag in ("DateTimeOriginal", "DateTimeDigitized", "DateTime")])


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def _short(x: Column) -> Column:
    """One decimal at most, no trailing zeros."""
    return F.regexp_replace(F.format_string("%.1f", F.bround(x, 1)), r"\.0$", "")


def aperture(f: Column) -> Column:
    return F.when(f > 0, F.concat(F.lit("ƒ/"), _short(f)))


def shutter(t: Column) -> Column:
    return F.when(t >= 1, F.concat(_short(t), F.lit("s"))).when(t > 0, F.concat(F.lit("1/"), F.bround(F.try_divide(F.lit(1.0), t)).cast("long").cast("string"), F.lit("s")))


def focal(f: Column) -> Column:
    return F.when(f > 0, F.concat(_short(f), F.lit("mm")))


def iso(v: Column) -> Column:
    return F.when(v.try_cast("int") > 0, F.concat(F.lit("ISO "), v.try_cast("int").cast("string")))


def container_time(value: Column) -> Column:
    """A video container's time without zone and fraction; an offset with a minus isn't understood."""
    v = F.regexp_extract(F.regexp_extract(F.replace(F.trim(value), F.lit("Z"), F.lit("")), r"\A[^+]*", 0), r"\A[^.]*", 0)
    t = F.coalesce(F.try_to_timestamp(v, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(v, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def iso6709(value: Column) -> Column:
    """struct(lat, lon) of ±DD.D±DDD.D at the start; null out of range."""
    p = r"\A([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"
    lat, lon = (F.regexp_extract(F.trim(value), p, k).try_cast("double") for k in (1, 2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


PROBE_DDL = "format struct<tags:map<string,string>,duration:string>, streams array<struct<codec_type:string,width:int,height:int,tags:map<string,string>>>"


def probe(json: Column) -> Column:
    """struct(taken_at, lat, lon, width, height, duration) of a video probe's JSON.

    The format's tags come before the streams', keys in a fixed order; the size is that of the first
    video stream with a width.
    """
    j = F.from_json(json, PROBE_DDL)
    low = lambda m: F.transform_keys(F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: F.lower(k))
    video = F.filter(F.coalesce(j["streams"], F.from_json(F.lit("[]"), "array<struct<codec_type:string,width:int,height:int,tags:map<string,string>>>")), lambda s: s["codec_type"] == "video")
    fmt = low(j["format"]["tags"])
    tag = lambda k: F.coalesce(F.nullif(F.try_element_at(fmt, F.lit(k)), F.lit("")), F.nullif(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(video, lambda s: F.try_element_at(low(s["tags"]), F.lit(k))), lambda v: v.isNotNull())), -1), F.lit("")))
    when = F.coalesce(*[container_time(tag(k)) for k in ("creation_time", "com.apple.quicktime.creationdate", "date")])
    where = F.coalesce(*[iso6709(tag(k)) for k in ("com.apple.quicktime.location.iso6709", "location", "location-eng")])
    sized = F.get(F.filter(video, lambda s: s["width"] > 0), F.lit(0))
    return F.struct(when.alias("taken_at"), where["lat"].alias("lat"), where["lon"].alias("lon"), sized["width"].alias("width"), F.nullif(sized["height"], F.lit(0)).alias("height"), j["format"]["duration"].try_cast("double").alias("duration"))


def capture_time(exif: Column, from_name: Column, from_folder: Column, mtime: Column, container: Column | None = None) -> Column:
    """struct(taken_at, source): EXIF, or a video's container, before the file name before the folder before the file's time."""
    told = [(exif, "exif"), *([(container, "video")] if container is not None else []), (from_name, "filename"), (from_folder, "folder"), (mtime, "mtime")]
    source = F.coalesce(*[F.when(t.isNotNull(), F.lit(name)) for t, name in told])
    return F.struct(F.coalesce(*[t for t, _ in told]).alias("taken_at"), source.alias("source"))


def place_label(city: Column, country: Column) -> Column:
    return F.concat_ws(", ", city, country)


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def content_path(root: str, sha1: Column, size: int | None = None) -> Column:
    """Where a derivative of a file's content is kept."""
    return F.concat(F.lit(f"{root}/"), F.substring(sha1, 1, 2), F.lit("/"), sha1, F.lit(f"_{size}.jpg" if size else ".jpg"))


def poster_path(root: str, sha1: Column) -> Column:
    """Where a video's still is kept."""
    return F.concat(F.lit(f"{root}/"), F.substring(sha1, 1, 2), F.lit("/"), sha1, F.lit("_poster.jpg"))


def scores_json(scores: Column) -> Column:
    """A map of scores as the catalog keeps it."""
    return F.to_json(scores)


def phash_bits(h: Column) -> Column:
    """16 hex digits as a signed 64-bit number with the same bits."""
    return F.when(h != "", F.conv(h, 16, -10).cast("long"))


def phash_distance(a: Column, b: Column) -> Column:
    """Differing bits; 64 if either is missing."""
    return F.coalesce(F.bit_count(phash_bits(a).bitwiseXOR(phash_bits(b))), F.lit(64))


def dhash(pixels: Column, size: int = 8) -> Column:
    """Difference hash of size rows of size + 1 grey values: bit 1 where a pixel is brighter than its right neighbour."""
    bits = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.when(F.get(pixels, r * (size + 1) + c) > F.get(pixels, r * (size + 1) + c + 1), "1").otherwise("0")))), "")
    return F.lower(F.lpad(F.conv(bits, 2, 16), size * size // 4, "0"))


def region_box(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """A face's box grown by half its width each side, 0.3 of its height up and 1.5 down, inside the image."""
    even = lambda c: F.bround(c).cast("int")
    left, top = F.greatest(F.lit(0), even(x - 0.5 * w)), F.greatest(F.lit(0), even(y - 0.3 * h))
    right, bottom = F.least(img_w, even(x + w + 0.5 * w)), F.least(img_h, even(y + h + 1.5 * h))
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(F.lit(1), right - left).alias("w"), F.greatest(F.lit(1), bottom - top).alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (structs x, y, w, h) over their union; 0 for empty ones."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = w * h
    return F.coalesce(F.try_divide(both.cast("double"), (a["w"] * a["h"] + b["w"] * b["h"] - both).cast("double")), F.lit(0.0))
