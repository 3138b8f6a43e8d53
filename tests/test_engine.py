"""The engine's calls over the star views: defaults, hybrid questions, invariants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shutterlake.catalog import Catalog, StarCatalog
from shutterlake.engine import Engine
from shutterlake.operators import ranking


@pytest.fixture(scope="module")
def engine(spark, sf):
    c = StarCatalog(spark, sf)
    v = c.vectors
    return Engine(c, v.select("id", "embedding"), v.filter("label = 3"), encode=lambda text: [float(len(text) + i % 5) for i in range(64)])


def test_hidden_photos_stay_out_unless_asked_for(engine):
    page, total = engine.photos({})
    assert total == engine.catalog.photos.filter("not hidden").count() and page.filter("hidden").count() == 0
    assert engine.photos({"hidden": True})[1] == engine.catalog.photos.filter("hidden").count()
    assert engine.photos({}, offset=60)[1] == -1
    with pytest.raises(ValueError):
        engine.photos({"date_from": "soon"})


def test_questions(engine):
    a = engine.ask("Supplier#000000003")
    assert a.question.only_filters and not a.grounded and a.rows.count() > 0 and a.total >= a.rows.count()
    a = engine.ask("Supplier#000000003 at sea")
    assert a.question.rest == "sea" and a.grounded and {"face_id", "score", "rank", "filename"} <= set(a.rows.columns)
    a = engine.ask("boats at sea", {"scene": "food"})
    assert not a.grounded and a.rows.count() == min(60, a.total)
    with pytest.raises(LookupError):
        Engine(engine.catalog).ask("boats")
    with pytest.raises(NotImplementedError):
        Engine(engine.catalog, engine.vectors).ask("boats")


def test_a_question_joins_the_filters_given(engine):
    q, f = engine.asked("Supplier#000000003 with friends", {"person_id": [7], "people": "1", "scene": "food"})
    assert q.ids == [3] and f["person_id"] == [7, 3] and f["people"] == ["1", "2-4", "5+"] and f["scene"] == "food" and "person_mode" not in f
    _, f = engine.asked("Supplier#000000003 and Supplier#000000007", {"person_mode": "any"})
    assert f["person_id"] == [3, 7] and f["person_mode"] == "any"


def test_ranked_pages(engine):
    whole = engine.ask("boats", limit=500)
    ranks = [r["rank"] for r in whole.rows.collect()]
    assert ranks == list(range(1, whole.total + 1)) and 0 < whole.total <= 200
    page = engine.ask("boats", limit=7, offset=5).rows.collect()
    assert [r["rank"] for r in page] == list(range(6, 13)) and [r["id"] for r in page] == [r["id"] for r in whole.rows.collect()[5:12]]
    assert "filename" in whole.rows.columns and "embedding" not in whole.rows.columns
    assert engine.ask("boats", offset=1000).rows.count() == 0
    with pytest.raises(ValueError):
        engine.ask("boats", limit=0)
    some = engine.vectors.first()["id"]
    like = engine.similar_photos(some, limit=3)
    assert like.rows.filter(F.col("id") == some).count() == 0 and like.rows.count() <= 3


def test_a_facet_counts_what_its_filter_finds(engine):
    f = {"country": "ASIA"}
    rows = engine.facets(f)["values"].filter("dimension in ('scene', 'people', 'kind')").collect()
    assert len(rows) > 8
    for r in rows:
        if r["dimension"] != "people" or r["value"] != "5+":  # the facet's 5+ holds photos without a count
            assert engine.photos(f | {r["dimension"]: r["value"]})[1] == r["n"], r


def test_calls(engine):
    assert engine.trips().count() >= 0 and engine.persons().count() > 0
    assert engine.memories(6, 16).columns == ["year", "n", "sample"]
    with pytest.raises(ValueError):
        engine.memories(13, 1)
    assert {"flags", "dates", "persons", "values"} == set(engine.facets({}))


def test_stored_catalog_reads_older_tables(spark, tmp_path):
    spark.createDataFrame([(1, "/a", "a.jpg")], "id long, path string, filename string").write.parquet(f"{tmp_path}/photos.parquet")
    c = Catalog(spark, str(tmp_path))
    assert c.photos.filter(~F.col("hidden") & ~F.col("favorite")).count() == 1 and c.photos.first()["named_face_count"] == 0
    spark.createDataFrame([(5, 1, 7), (6, 1, None), (7, 1, 9)], "id long, photo_id long, person_id long").write.parquet(f"{tmp_path}/faces.parquet")
    assert Catalog(spark, str(tmp_path)).photos.first()["named_face_count"] == 2


def test_top_k_is_a_bounded_heap(engine):
    plan = ranking.top_k(engine.vectors, [1.0] * 64, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_filters_reach_the_scan(spark, sf):
    c = StarCatalog(spark, sf)
    plan = c.photos.filter("id > 5").select("filename")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)" in plan or "GreaterThan(o_orderkey,5)" in plan
    assert "o_totalprice" not in plan
