"""The command line over a stored library."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake import cli, schema
from shutterlake.library import Library, by_pandas
from shutterlake.sources.store import Store


def test_commands(spark, tmp_path, capsys):
    lib = f"{tmp_path}/lib"
    assert cli.main(["demo", "--library", lib, "--count", "12"], spark) == 0
    for command in ("stats", "trips", "dedup"):
        assert cli.main([command, "--library", lib], spark) == 0
    assert cli.main(["search", "--library", lib, "--filters", "city=Rome"], spark) == 0
    assert "12 photos" in capsys.readouterr().out


def test_index_is_idempotent_and_prune_drops_what_is_gone(spark, tmp_path, capsys):
    src, lib = tmp_path / "2019_Roma", f"{tmp_path}/lib"
    src.mkdir()
    (src / "IMG_20190203_040506.jpg").write_bytes(b"x")
    (src / "again.jpg").write_bytes(b"x")
    (src / "clip.mov").write_bytes(b"y")
    for want in ("2 new files", "0 new files"):
        cli.main(["index", "--library", lib, "--path", str(tmp_path / "2019_Roma")], spark)
        assert want in capsys.readouterr().out
    rows = {r["filename"]: r for r in Store(spark, lib).read("photos").collect()}
    assert rows["clip.mov"]["is_video"] and rows["IMG_20190203_040506.jpg"]["taken_source"] == "filename"
    (src / "clip.mov").unlink()
    cli.main(["prune", "--library", lib, "--path", str(src)], spark)
    assert "1 removed, 1 kept" in capsys.readouterr().out


def test_prune_asks_about_its_own_root_and_takes_faces_along(spark, tmp_path, capsys):
    a, b, lib = tmp_path / "a", tmp_path / "b", f"{tmp_path}/lib"
    for d, names in ((a, "xyz"), (b, "uv")):
        d.mkdir()
        for n in names:
            (d / f"{n}.jpg").write_bytes(f"{d}{n}".encode())
    library = Library(spark, Store(spark, lib))
    assert library.index(str(a)) == 3 and library.index(str(b)) == 2
    ids = {r["filename"]: r["id"] for r in library.catalog.photos.collect()}
    faces = spark.createDataFrame([(10, ids["x.jpg"], 1), (11, ids["y.jpg"], 1), (12, ids["u.jpg"], 2)], "id long, photo_id long, person_id long")
    library.store.commit({"faces": schema.reconcile(faces, schema.FACE_DDL), "face_negatives": spark.createDataFrame([(10, 5), (12, 5)], schema.NEGATIVE_DDL)})
    (a / "x.jpg").unlink()
    (b / "u.jpg").unlink()
    assert library.prune(str(a)) == {"removed": 1, "kept": 4}
    assert {r["id"] for r in library.catalog.faces.collect()} == {11, 12} and [r["face_id"] for r in library.catalog.negatives.collect()] == [12]
    assert library.delete([ids["y.jpg"], 999]) == {"rows": 1, "files": 1} and not (a / "y.jpg").exists()
    assert library.catalog.photos.count() == 3 and library.catalog.faces.count() == 1


def test_backfills_and_albums(spark, tmp_path):
    library = Library(spark, Store(spark, f"{tmp_path}/lib"))
    (tmp_path / "in").mkdir()
    for n in "abc":
        (tmp_path / "in" / f"{n}.jpg").write_bytes(n.encode())
    decode = lambda df: df.withColumns({"exif": F.create_map(F.lit("DateTimeOriginal"), F.lit("2020:02:03 04:05:06"), F.lit("Make"), F.lit(" Cam \0"), F.lit("GPSLatitude"), F.lit("41/1, 54/1, 0/1"), F.lit("GPSLatitudeRef"), F.lit("N"), F.lit("GPSLongitude"), F.lit("200, 0, 0"), F.lit("GPSLongitudeRef"), F.lit("E")), "width": F.lit(4)})
    assert library.index(str(tmp_path / "in"), decode) == 3
    r = library.catalog.photos.first()
    assert (r["taken_at"], r["taken_source"], r["camera_make"], r["lat"], r["lon"], r["width"]) == ("2020-02-03T04:05:06", "exif", "Cam", 41.9, None, 4)
    hashes = by_pandas(lambda b: b.assign(value=b["filename"].str[:1] * 16)[["id", "value"]], "string")
    assert library.backfill("phash", hashes) == 3 and library.backfill("phash", hashes) == 0 and library.backfill("phash", hashes, recompute=True) == 3
    assert {r["phash"] for r in library.catalog.photos.collect()} == {"a" * 16, "b" * 16, "c" * 16}
    library.save_search(" Sea ", "q=sea")
    library.save_search("alps", "q=alps")
    library.save_search("Sea", "q=ocean")
    found = library.searches().collect()
    assert [(r["name"], r["query"]) for r in found] == [("alps", "q=alps"), ("Sea", "q=ocean")]
    library.delete_search(found[0]["id"])
    assert library.searches().count() == 1
    library.flag("favorite", True, [1])
    assert library.catalog.photos.filter("favorite").count() == 1
    assert library.export([1, 1, 99], f"{tmp_path}/out") == {"requested": 2, "copied": 1, "missing": 1}
