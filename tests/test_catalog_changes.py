"""Mutations, the versioned store, ingest and exports."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import mutate, people
from shutterlake.sources import export, files
from shutterlake.sources.store import Store
from shutterlake.streaming import ingest

P = "id long, path string, filename string, sha1 string, face_count int, favorite boolean, hidden boolean, is_video boolean, named_face_count int"
FACE = "id long, photo_id long, person_id long, cluster_id int, confidence double, crop_path string"


def photos(spark):
    return spark.createDataFrame([(1, "/a", "a", "s1", 2, True, False, False, 1), (2, "/b", "b", "s2", 0, False, True, False, 0)], P)


def faces(spark):
    return spark.createDataFrame([(1, 1, 5, None, 1.0, "c"), (2, 1, None, 3, 0.0, None), (3, 2, 6, None, 0.4, "c"), (4, 2, None, 3, 0.0, "c")], FACE)


def persons(spark):
    return spark.createDataFrame([(5, "Ann", None), (6, "Bob", None)], "id long, name string, cover_face_id long")


NEG = "face_id long, person_id long"


def test_upsert_keeps_what_users_set(spark):
    new = spark.createDataFrame([("/a", "a2", "s9"), ("/z", "z", "s3"), ("/c", "c", "s4")], "path string, filename string, sha1 string")
    got = {r["path"]: r for r in mutate.upsert_photos(photos(spark), new).collect()}
    assert (got["/a"]["id"], got["/a"]["filename"], got["/a"]["favorite"], got["/a"]["face_count"]) == (1, "a2", True, None)
    assert (got["/c"]["id"], got["/z"]["id"], got["/z"]["favorite"]) == (3, 4, False) and got["/b"]["hidden"]
    again = mutate.upsert_photos(mutate.upsert_photos(photos(spark), new), new)
    assert sorted((r["id"], r["path"]) for r in again.collect()) == [(1, "/a"), (2, "/b"), (3, "/c"), (4, "/z")]


def test_recount_never_drifts(spark):
    p, f = photos(spark), faces(spark)
    for f2 in (mutate.assign_cluster(f, 3, 5), mutate.unassign_face(f, spark.createDataFrame([], NEG), 1)[0], mutate.replace_faces(f, spark.createDataFrame([(9, 1, None, None, 0.0, None)], FACE))):
        got = {r["id"]: (r["face_count"], r["named_face_count"]) for r in mutate.recount(p, f2).collect()}
        rows = f2.collect()
        assert got == {i: (sum(r["photo_id"] == i for r in rows), sum(r["photo_id"] == i and r["person_id"] is not None for r in rows)) for i in (1, 2)}
        assert {r["id"]: r["named_face_count"] for r in people.named_face_count(p, f2).collect()} == {i: v[1] for i, v in got.items()}


def test_delete_cascades(spark):
    p, f, n = mutate.delete_photos(photos(spark), faces(spark), spark.createDataFrame([(1, 6), (3, 5)], NEG), spark.createDataFrame([(1,)], "id long"))
    assert [r["id"] for r in p.collect()] == [2] and sorted(r["id"] for r in f.collect()) == [3, 4] and [tuple(r) for r in n.collect()] == [(3, 5)]


def test_persons(spark):
    ps, fs = persons(spark), faces(spark)
    assert mutate.create_person(ps, " Ann ").count() == 2 and mutate.create_person(ps, "Cy").filter("name = 'Cy'").first()["id"] == 7
    with pytest.raises(ValueError):
        mutate.rename_person(ps, 5, "Bob")
    assert mutate.rename_person(ps, 5, "Anna").filter("id = 5").first()["name"] == "Anna"
    with pytest.raises(ValueError):
        mutate.merge_persons(ps, fs, {5: 5})
    with pytest.raises(ValueError):
        mutate.merge_persons(ps, fs, {9: 5})
    p2, f2 = mutate.merge_persons(ps, fs, {5: 6})
    assert [r["id"] for r in p2.collect()] == [6] and f2.filter("person_id = 6").count() == 2
    p3, f3 = mutate.delete_person(ps, fs, 5)
    assert p3.count() == 1 and f3.filter("person_id is null").count() == 3
    with pytest.raises(ValueError):
        mutate.set_cover(ps, fs, 5, 3)
    assert mutate.set_cover(ps, fs, 5, 1).filter("id = 5").first()["cover_face_id"] == 1


def test_faces_and_negatives(spark):
    none = spark.createDataFrame([(1, 6)], NEG)
    f, n = mutate.assign_face(faces(spark), none, 1, 6)
    assert f.filter("id = 1").first()["person_id"] == 6 and [tuple(r) for r in n.collect()] == [(1, 5)]
    f, n = mutate.unassign_face(faces(spark), none, 1)
    assert f.filter("id = 1").first()["person_id"] is None and sorted(tuple(r) for r in n.collect()) == [(1, 5), (1, 6)]
    f = mutate.assign_cluster(faces(spark), 3, 5)
    assert f.filter("person_id = 5").count() == 3 and f.filter("id = 2").first()["confidence"] == 0.0
    assert mutate.remove_negatives(none, none).count() == 0


def test_flags_and_saved_searches(spark):
    assert mutate.set_flag(photos(spark), "hidden", True, [1]).filter("hidden").count() == 2
    with pytest.raises(ValueError):
        mutate.set_flag(photos(spark), "path", True, [1])
    s = spark.createDataFrame([(1, "sea", "q=sea")], "id long, name string, query string")
    assert mutate.save_search(s, " sea ", "q=lake").first()["query"] == "q=lake"
    assert mutate.save_search(s, "hill", "x").count() == 2


def test_backfills_and_columns(spark):
    df = spark.createDataFrame([(1, "x", False), (2, None, False), (3, None, True)], "id long, phash string, is_video boolean")
    assert [r["id"] for r in mutate.missing(df, "phash", videos=False).collect()] == [2]
    assert mutate.missing(df, "phash", recompute=True).count() == 3
    got = mutate.set_column(df, "phash", spark.createDataFrame([(2, "y"), (1, None)], "id long, value string"))
    assert {r["id"]: r["phash"] for r in got.collect()} == {1: None, 2: "y", 3: None}


def test_content_dedup_and_orphans(spark):
    listing = spark.createDataFrame([("/a", "s1"), ("/n1", "s1"), ("/n3", "s7"), ("/n2", "s7")], "path string, sha1 string")
    assert [r["path"] for r in mutate.new_content(listing, photos(spark)).collect()] == ["/n2"]
    d = spark.createDataFrame([("/t/s1_320.jpg",), ("/t/s1.jpg.part",), ("/t/zz.jpg",)], "path string")
    assert sorted(r["path"] for r in mutate.orphans(d, photos(spark)).collect()) == ["/t/s1.jpg.part", "/t/zz.jpg"]


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "lib"))
    assert s.version() == 0
    assert s.commit({"photos": photos(spark), "faces": faces(spark)}) == 1
    assert s.commit({"photos": s.read("photos").filter("id = 1")}) == 2
    assert s.read("photos").count() == 1 and s.read("photos", 1).count() == 2 and s.read("faces").count() == 4
    assert s.fingerprint("photos") == (2, 1, 1)


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/s")
    one = spark.range(3)
    store.commit({"t": one})
    late = Store(spark, f"{tmp_path}/s")
    monkeypatch.setattr(late, "version", lambda: 0)  # it looked before the first commit
    with pytest.raises(RuntimeError):
        late.commit({"t": spark.range(9)})
    assert store.version() == 1 and store.read("t").count() == 3 and store.tables().keys() == {"t"}
    assert store.commit({"u": one}) == 2 and store.read("t", 1).count() == 3 and set(store.tables()) == {"t", "u"}


def test_stream_is_idempotent(spark, tmp_path):
    s = Store(spark, str(tmp_path / "lib"))
    s.commit({"photos": photos(spark)})
    rows = spark.createDataFrame([("/n", "n", "s8"), ("/a", "a", "s1"), ("/m", "m", "s8")], "path string, filename string, sha1 string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        q = ingest.ingest(spark, str(tmp_path / "in"), "path string, filename string, sha1 string", s, str(tmp_path / f"cp{k}"))
        q.awaitTermination()
        assert sorted(r["path"] for r in s.read("photos").collect()) == ["/a", "/b", "/m"]


def test_scan_and_describe(spark, tmp_path):
    d = tmp_path / "2019_Roma"
    d.mkdir()
    (d / "IMG_20190203_040506.JPG").write_bytes(b"x")
    (d / "clip.mov").write_bytes(b"y")
    (d / "notes.txt").write_bytes(b"z")
    got = files.described(files.routed(files.scan(spark, str(tmp_path)), [str(tmp_path / "thumbs")]), None, 2027)
    by = {r["filename"]: r for r in got.collect()}
    assert {k: r["kind"] for k, r in by.items()} == {"IMG_20190203_040506.JPG": "photo", "clip.mov": "video", "notes.txt": "other"}
    a = by["IMG_20190203_040506.JPG"]
    assert (a["taken_at"], a["taken_source"], a["folder_place"], a["sha1"]) == ("2019-02-03T04:05:06", "filename", "Roma", "11f6ad8ec52a2984abaafd7c3b516503785c2072")
    assert by["clip.mov"]["taken_at"] == "2019-01-01T00:00:00" and by["clip.mov"]["taken_source"] == "folder"


def test_exports(spark, tmp_path):
    src = tmp_path / "a.jpg"
    src.write_bytes(b"x")
    p = spark.createDataFrame([(1, str(src), "a.jpg"), (2, "/gone/a.jpg", "a.jpg")], "id long, path string, filename string")
    plan = mutate.export_plan(p, spark.createDataFrame([(1,), (2,), (3,)], "id long"), str(tmp_path / "out"))
    assert {r["id"]: r["target"] and os.path.basename(r["target"]) for r in plan.collect()} == {1: "a.jpg", 2: "a_2.jpg", 3: None}
    assert export.copy_files(plan) == {"requested": 3, "copied": 1, "missing": 2}
    docs = export.sidecars(spark.createDataFrame([(str(src), ["A<b", "C"])], "path string, names array<string>"))
    assert export.write_sidecars(docs) == 1
    assert "<rdf:li>People|A&lt;b</rdf:li>" in (tmp_path / "a.xmp").read_text()


def test_demo_is_seeded(spark):
    a, b = files.demo(spark, 20, 7).collect(), files.demo(spark, 20, 7).collect()
    assert a == b and a != files.demo(spark, 20, 8).collect() and len(a) == 20


def test_integrity(spark):
    got = {r["check"]: r["n"] for r in mutate.integrity(photos(spark), faces(spark), persons(spark).filter(F.col("id") == 5), spark.createDataFrame([(99, 5)], NEG)).collect()}
    assert got == {"face without photo": 0, "face of no person": 1, "negative of no face": 1}


def test_prepared_files_keep_human_labels_and_vectors(spark):
    p = photos(spark).withColumns({"embedding": F.array(F.lit(1.0).cast("float")), "phash": F.lit("0f")})
    box = "struct<x:int,y:int,w:int,h:int>"
    f = faces(spark).withColumn("bbox", F.struct((F.col("id") * 100).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h")))
    prepared = spark.createDataFrame([("/a", "a9", "s9", None), ("/n", "n", "s8", "ff")], "path string, filename string, sha1 string, phash string")
    found = spark.createDataFrame([("/a", (101, 0, 10, 10), 0.0), ("/a", (900, 0, 10, 10), 0.0), ("/n", (0, 0, 5, 5), 0.0)], f"path string, bbox {box}, confidence double")
    p2, f2 = mutate.commit_prepared(p, f, prepared, found)
    rows = {r["path"]: r for r in p2.collect()}
    assert (rows["/a"]["phash"], rows["/n"]["phash"], rows["/a"]["embedding"], rows["/n"]["id"]) == ("0f", "ff", [1.0], 3)
    assert (rows["/a"]["face_count"], rows["/a"]["named_face_count"], rows["/n"]["face_count"], rows["/b"]["face_count"]) == (2, 1, 1, 2)
    got = {(r["photo_id"], r["bbox"]["x"]): (r["person_id"], r["confidence"]) for r in f2.collect()}
    assert got[(1, 101)] == (5, 1.0) and got[(1, 900)] == (None, 0.0) and (2, 300) in got and len(got) == 5
    assert f2.select("id").distinct().count() == 5


def test_files_are_deleted(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"1")
    assert export.delete_files(spark.createDataFrame([(str(tmp_path / "x"),), ("/not/there",), (None,)], "path string")) == 1
