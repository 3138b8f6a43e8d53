"""Scalars mined from names, folders, EXIF and containers, against literal expectations."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import media


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("20160522_203015123_iOS.jpg", "2016-05-22T20:30:15"),
        ("IMG-20180401-WA0007.jpg", "2018-04-01T00:00:00"),
        ("IMG_20190203_040506.jpg", "2019-02-03T04:05:06"),
        ("Screenshot_20200101-235959.png", "2020-01-01T23:59:59"),
        ("WP_20140809_10_11_12_Pro.jpg", "2014-08-09T10:11:12"),
        ("WP_20140809_007.jpg", "2014-08-09T00:00:00"),
        ("2015-06-07 08.09.10.jpg", "2015-06-07T08:09:10"),
        ("20170102_030405.mp4", "2017-01-02T03:04:05"),
        ("Gita 5 maggio 2012.jpg", "2012-05-05T00:00:00"),
        ("1.2.2013.jpg", "2013-02-01T00:00:00"),
        ("DSC_0042.jpg", None),
        ("IMG_1234.jpg", None),
        ("20161332_203015.jpg", None),
        ("IMG_18990101_000000.jpg", None),
        ("IMG_20990101_000000.jpg", None),
        ("IMG_20200101_250000.jpg", None),
        ("31.2.2013.jpg", None),
    ],
)
def test_filename_dates(spark, name, want):
    assert one(spark, media.filename_date(F.lit(name), 2027)) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("2012_05_Sardegna", (2012, 5, "Sardegna")),
        ("2012_05_12_Sardegna", (2012, 5, "Sardegna")),
        ("Sardegna_2012", (2012, None, "Sardegna")),
        ("2012 maggio Roma bella", (2012, 5, "Roma bella")),
        ("2012_13_Trip", (2012, None, "13 Trip")),
        ("2012", (2012, None, None)),
        ("vacanze", None),
        ("12345", None),
    ],
)
def test_folder_names(spark, name, want):
    got = one(spark, media.folder(F.lit(name)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/p/2012_Sardegna/2012_05/a.jpg", (2012, 5, "Sardegna")),
        ("/p/2026/01-gennaio/a.jpg", (2026, 1, None)),
        ("/p/2025/05/a.jpg", (2025, None, None)),
        ("/p/2025/Maggio in montagna/a.jpg", (2025, None, None)),
        ("/p/gennaio/a.jpg", (None, None, None)),
    ],
)
def test_folder_paths(spark, path, want):
    assert tuple(one(spark, media.folder_meta(F.lit(path)))) == want


def test_exif(spark):
    assert one(spark, media.exif_time(F.lit("2020:02:03 04:05:06"))) == "2020-02-03T04:05:06"
    assert one(spark, media.exif_time(F.lit("2020-02-03 04:05:06"))) == "2020-02-03T04:05:06"
    assert one(spark, media.exif_time(F.lit("yesterday"))) is None
    fmt = lambda f, v: one(spark, f(F.lit(v)))
    assert [fmt(media.aperture, x) for x in (2.8, 8.0, 0.0)] == ["ƒ/2.8", "ƒ/8", None]
    assert [fmt(media.shutter, x) for x in (0.004, 2.0, 1.3, 0.0)] == ["1/250s", "2s", "1.3s", None]
    assert [fmt(media.focal, x) for x in (50.0, 4.25)] == ["50mm", "4.2mm"]
    assert [fmt(media.iso, x) for x in ("200", "0", "x")] == ["ISO 200", None, None]
    d = media.dms(F.lit(41.0), F.lit(54.0), F.lit(0.0), F.lit("S"))
    assert one(spark, d) == -41.9
    assert one(spark, media.ratio(F.lit(1), F.lit(0))) is None


def test_video(spark):
    assert one(spark, media.container_time(F.lit("2020-01-02T03:04:05.000000Z"))) == "2020-01-02T03:04:05"
    assert one(spark, media.container_time(F.lit("2020-01-02T03:04:05+0200"))) == "2020-01-02T03:04:05"
    assert one(spark, media.container_time(F.lit("2020-01-02T03:04:05-05:00"))) is None
    assert tuple(one(spark, media.iso6709(F.lit("+41.9028+012.4964+050.0/")))) == (41.9028, 12.4964)
    assert one(spark, media.iso6709(F.lit("+99.0+012.0/"))) is None
    doc = {"format": {"tags": {"CREATION_TIME": "2021-05-06T07:08:09Z"}, "duration": "3.5"}, "streams": [{"codec_type": "audio"}, {"codec_type": "video", "tags": {"creation_time": "1999-01-01T00:00:00", "location": "+10.0+020.0/"}}, {"codec_type": "video", "width": 640, "height": 480}]}
    assert tuple(one(spark, media.probe(F.lit(json.dumps(doc))))) == ("2021-05-06T07:08:09", 10.0, 20.0, 640, 480, 3.5)
    assert one(spark, media.probe(F.lit("{}")))["taken_at"] is None


def test_hashes_and_boxes(spark):
    assert one(spark, media.phash_distance(F.lit("ffffffffffffffff"), F.lit("0000000000000000"))) == 64
    assert one(spark, media.phash_distance(F.lit("0f"), F.lit("0e"))) == 1
    assert one(spark, media.phash_distance(F.lit(None).cast("string"), F.lit("0e"))) == 64
    assert one(spark, media.dhash(F.array(*[F.lit(9 - i % 9) for i in range(72)]))) == "f" * 16
    box = media.region_box(*[F.lit(x) for x in (0, 0, 64, 64, 64, 64)])
    assert tuple(one(spark, box)) == (0, 0, 64, 64)
    b = lambda *x: F.struct(*[F.lit(v).alias(n) for v, n in zip(x, "xywh", strict=True)])
    assert one(spark, media.iou(b(0, 0, 10, 10), b(0, 0, 10, 10))) == 1.0
    assert one(spark, media.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0.0


def test_names_and_paths(spark):
    assert one(spark, media.xml_escape(F.lit("a<b>&c"))) == "a&lt;b&gt;&amp;c"
    assert one(spark, media.content_path("/t", F.lit("abcd"), 320)) == "/t/ab/abcd_320.jpg"
    assert one(spark, media.is_image(F.lit("/x/A.JPG"))) and one(spark, media.is_video(F.lit("a.MOV")))
    got = one(spark, media.capture_time(F.lit(None).cast("string"), F.lit("b"), F.lit("c"), F.lit("d")))
    assert tuple(got) == ("b", "filename")


def test_exif_maps(spark):
    base, sub = F.create_map(F.lit("A"), F.lit("1")), F.create_map(F.lit("A"), F.lit("2"), F.lit("FNumber"), F.lit("28/10"), F.lit("ExposureTime"), F.lit("1/250"), F.lit("LensMake"), F.lit(" x "))
    assert one(spark, media.merged_exif(base, sub))["A"] == "1"
    got = one(spark, media.capture_settings(media.merged_exif(base, sub)))
    assert tuple(got) == ("ƒ/2.8", "1/250s", None, None, "x")
    assert one(spark, media.merged_exif(F.lit(None).cast("map<string,string>"), base)) == {"A": "1"}
