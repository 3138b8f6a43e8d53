"""The filter language, facets and browsing on small literal catalogs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shutterlake import schema
from shutterlake.engine import from_querystring, to_querystring
from shutterlake.operators import browse, facets, people
from shutterlake.operators.predicates import as_list, escape_like, select, union, validate

PHOTO = {"favorite": False, "is_video": False, "hidden": False, "named_face_count": 0}


def photos(spark, *rows):
    full = [{"id": i + 1, "path": f"/p{i}", "filename": f"f{i}.jpg"} | PHOTO | r for i, r in enumerate(rows)]
    names = [f.split()[0] for f in schema.PHOTO_DDL.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema.PHOTO_DDL)


def faces(spark, *rows):
    return spark.createDataFrame([(i + 1, p, who) for i, (p, who) in enumerate(rows)], "id long, photo_id long, person_id long")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def counted(df):
    return {r["value"]: r["n"] for r in df.collect()}


def test_people_buckets(spark):
    p = photos(spark, *({"face_count": n} for n in (0, 1, 1, 3, 7)))
    assert len(ids(select(p, None, {"people": ["1"]}))) == 2
    assert len(ids(select(p, None, {"people": ["2-4", "5+"]}))) == 2
    assert ids(select(p, None, {"people": "0"})) == [1]
    assert len(ids(select(p, None, {"people": ["what"]}))) == 5  # unknown tokens say nothing
    assert counted(facets.facet(p, None, {}, "people")) == {"0": 1, "1": 2, "2-4": 1, "5+": 1}


def test_no_face_count_is_in_the_facet_but_not_the_filter(spark):
    p = photos(spark, {"face_count": None})
    assert counted(facets.facet(p, None, {}, "people")) == {"5+": 1}
    assert ids(select(p, None, {"people": "5+"})) == []


def test_known_buckets(spark):
    p = photos(spark, *({"named_face_count": n} for n in (2, 1, 0, 0)))
    assert [len(ids(select(p, None, {"known": k}))) for k in ("0", "1", "2+")] == [2, 1, 1]


def test_kinds_overlap(spark):
    p = photos(spark, *({"face_count": n, "scene_type": s} for n, s in ((1, "people"), (1, "food"), (3, "people"), (0, "landscape"), (0, "food"))))
    assert counted(facets.kinds(p, None, {})) == {"portrait": 2, "group": 1, "food": 2, "landscape": 1}
    assert len(ids(select(p, None, {"kind": ["portrait", "landscape"]}))) == 3


def test_persons_any_and_all(spark):
    p, f = photos(spark, {}, {}, {}), faces(spark, (1, 1), (1, 2), (2, 1), (3, 2), (3, None))
    assert ids(select(p, f, {"person_id": [1, 2]})) == [1, 2, 3]
    assert ids(select(p, f, {"person_id": [1, 2], "person_mode": "all"})) == [1]
    assert ids(select(p, f, {"person_id": 1, "person_mode": "all"})) == [1, 2]


@pytest.mark.parametrize(("q", "n"), [("v2", 1), ("_V2", 1), ("100%", 1), ("report", 2), ("ÀB", 0), ("àb", 1)])
def test_text_is_literal_and_folds_ascii_only(spark, q, n):
    p = photos(spark, *({"filename": x} for x in ("report_v2.jpg", "reportXv3.jpg", "100%done.jpg", "àb.jpg")))
    assert len(ids(select(p, None, {"q": q}))) == n


def test_exact_camera_dates_and_hidden(spark):
    p = photos(spark, {"camera_model": "Canon EOS 5D", "taken_at": "2018-05-01T10:00:00"}, {"camera_model": "Canon EOS 5D Mark II", "taken_at": "2020-07-01T00:00:00", "hidden": True}, {"taken_at": None})
    assert ids(select(p, None, {"camera": "Canon EOS 5D"})) == [1]
    assert ids(select(p, None, {"date_from": "2018-05-01", "date_to": "2018-05-01"})) == [1]
    assert ids(select(p, None, {"year": 2020})) == [2]
    assert ids(select(p, None, {"hidden": True})) == [2]
    assert ids(select(p, None, {"hidden": None})) == [1, 3]
    assert facets.date_bounds(p, None, {"date_from": "2019-01-01"}).first()["first"] == "2018-05-01"


def test_lists_and_escapes():
    assert as_list([None, "", 0, "a"]) == [0, "a"] and as_list("a") == ["a"] and as_list(None) == []
    assert union(["a", "b"], ["b", "", "c"]) == ["a", "b", "c"]
    assert escape_like("a%b_c\\") == "a\\%b\\_c\\\\"


@pytest.mark.parametrize("bad", [{"date_from": "2020"}, {"date_to": "20200101"}])
def test_bad_dates(bad):
    with pytest.raises(ValueError):
        validate(bad)


def test_bad_pages():
    for limit, offset in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            validate({}, limit, offset)
    with pytest.raises(ValueError):
        validate({}, month=13)


def test_paging_neither_drops_nor_repeats(spark):
    p = photos(spark, *({"taken_at": f"2020-01-{1 + i % 3:02d}T00:00:00" if i % 4 else None, "filename": f"{'a' if i % 2 else 'A'}{i % 5}"} for i in range(23)))
    for sort in browse.SORTS:
        got = [r["id"] for o in range(0, 25, 5) for r in sorted(browse.search(p, None, {"sort": sort}, 5, o, count=False)[0].collect(), key=lambda r: r["rank"])]
        assert sorted(got) == list(range(1, 24))
    page, total = browse.search(p, None, {}, 5)
    assert total == 23 and page.count() == 5
    assert browse.search(p, None, {}, 5, count=False)[1] == -1


def test_fused_facets_equal_single_ones(spark):
    p = photos(spark, *({"scene_type": ["food", "people", None][i % 3], "place_country": ["Italy", "", None][i % 3 - 1], "face_count": i % 7, "taken_at": f"201{i % 4}-01-01"} for i in range(40)))
    f = {"scene": ["food"], "people": ["0", "5+"], "hidden": False}
    fused = {}
    for r in facets.facets_fused(p, None, f).collect():
        fused.setdefault(r["dimension"], {})[r["value"]] = r["n"]
    for d in ("scene", "country", "city", "place", "camera", "year", "people", "known"):
        assert counted(facets.facet(p, None, f, d)) == fused.get(d, {})
    assert counted(facets.kinds(p, None, f)) == fused["kind"]
    for s, n in fused["scene"].items():  # a facet's count is what its filter finds
        assert len(ids(select(p, None, f | {"scene": s}))) == n


def test_covers_heal(spark):
    f = spark.createDataFrame([(11, 1, 1, "c")], "id long, photo_id long, person_id long, crop_path string")
    p = spark.createDataFrame([(1, "Zoe", 10), (2, "ann", None)], "id long, name string, cover_face_id long")
    got = people.by_name(people.list_persons(p, f)).collect()
    assert [(r["name"], r["faces"], r["photos"], r["cover"]) for r in got] == [("ann", 0, 0, None), ("Zoe", 1, 1, 11)]


def test_querystrings():
    f = {"scene": ["food", "people"], "person_id": [1, 2], "hidden": True, "q": "sea"}
    assert from_querystring(to_querystring(f)) == f


def test_reconcile_adds_and_keeps(spark):
    old = spark.createDataFrame([(1, "/a", "x")], "id long, path string, extra string")
    new = schema.reconcile(old, schema.PHOTO_DDL, {"favorite": False})
    assert new.columns[-1] == "extra" and new.first()["favorite"] is False and new.select(F.col("embedding")).first()[0] is None
