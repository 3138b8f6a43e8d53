"""Trips, bursts, memories, vectors and recognition on literal fixtures and against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from shutterlake.functions import planner
from shutterlake.operators import bursts, entity, ranking, timeline

TIMED = "id long, taken_at string, lat double, lon double, place_label string, folder_place string, place_city string, place_country string"


def timed(spark, rows):
    return spark.createDataFrame([(i + 1, *r, *[None] * (7 - len(r))) for i, r in enumerate(rows)], TIMED)


def test_time_gap_splits_trips(spark):
    rows = [(f"2019-06-0{d}T10:00:00", 41.9, 12.5, "Rome") for d in range(1, 5)] + [(f"2019-07-1{d}T10:00:00", 48.85, 2.35, "Paris") for d in range(4)]
    got = timeline.trips(timed(spark, rows), min_photos=3).orderBy(F.desc("end")).collect()
    assert [(r["place"], r["n"], r["start"][:10], r["end"][:10]) for r in got] == [("Paris", 4, "2019-07-10", "2019-07-13"), ("Rome", 4, "2019-06-01", "2019-06-04")]


def test_far_jump_splits_and_small_hops_do_not(spark):
    jump = [(f"2020-03-01T0{h}:00:00", 40.0, -74.0) for h in range(3)] + [(f"2020-03-01T1{h}:00:00", 51.5, -0.12) for h in range(3)]
    assert timeline.trips(timed(spark, jump), min_photos=3).count() == 2
    hops = [(f"2020-03-0{d}T00:00:00", 40 + d / 100, 10.0) for d in range(1, 7)]
    assert [r["n"] for r in timeline.trips(timed(spark, hops), min_photos=3).collect()] == [6]


def test_strays_places_and_undated(spark):
    rows = [(f"2021-08-0{d}T00:00:00", None, None, None, "Alps 2021") for d in range(1, 5)] + [("2021-10-01T00:00:00",), (None,)]
    (r,) = timeline.trips(timed(spark, rows), min_photos=3).collect()
    assert (r["place"], r["n"], r["lat"], r["cover"]) == ("Alps 2021", 4, None, 1)
    rows = [(f"2021-08-0{d}T00:00:00", None, None, "", None, "Oslo", "Norway") for d in range(1, 4)]
    assert timeline.trips(timed(spark, rows), min_photos=3).first()["place"] == "Oslo, Norway"


def test_trips_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows, t = [], 0
    for _ in range(300):
        t += rng.choice([0, 600, 40_000, 90_000, 300_000])
        stamp = str(np.datetime64("2020-01-25T00:00:00") + np.timedelta64(t, "s")) if rng.random() > 0.05 else f"2020-0{rng.randint(2, 9)}-xx"
        at = (rng.uniform(40, 44), rng.uniform(5, 12)) if rng.random() > 0.3 else (None, None)
        rows.append((stamp, *at))
    df = timed(spark, rows)
    trip, last_t, last_ll, want = 0, None, None, {}
    for i, (s, la, lo) in sorted(((i + 1, r) for i, r in enumerate(rows)), key=lambda x: (x[1][0], x[0])):
        now = None if "x" in s else float(np.datetime64(s).astype("datetime64[s]").astype(int))
        gap = (now - last_t) / 86400 if now is not None and last_t is not None else None
        far = False
        if la is not None and last_ll:
            p, q = math.radians(last_ll[0]), math.radians(la)
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lo - last_ll[1]) / 2) ** 2
            far = 2 * 6371 * math.asin(math.sqrt(h)) > 200
        trip += gap is not None and (gap > 2 or gap > 0 and far)
        want.setdefault(trip, []).append(i)
        last_t, last_ll = now if now is not None else last_t, (la, lo) if la is not None else last_ll
    got = sorted((r["n"], r["start"]) for r in timeline.trips(df, min_photos=1).collect())
    first = {i + 1: r[0] for i, r in enumerate(rows)}
    assert got == sorted((len(v), min(first[i] for i in v)) for v in want.values())


def test_on_this_day(spark):
    days = ["2021-06-16", "2020-06-16", "2020-06-16", "2020-06-15", "2020-12-16"]
    got = timeline.on_this_day(timed(spark, [(d + "T00:00:00",) for d in days] + [(None,)]), 6, 16, 1).orderBy(F.desc("year")).collect()
    assert [(r["year"], r["n"], len(r["sample"])) for r in got] == [("2021", 1, 1), ("2020", 2, 1)]


SHOT = "id long, taken_at string, phash string, favorite boolean, hidden boolean, width int, height int"


def shot(i, s, h, fav=False, hidden=False, w=100):
    return (i, s, h, fav, hidden, w, 100)


def test_bursts(spark):
    base = 0x0F0F0F0F0F0F0F0F
    rows = [shot(i, f"2020-01-01T00:00:0{i}", f"{base ^ i:016x}") for i in range(5)] + [shot(9, "2020-01-01T01:00:00", f"{base:016x}"), shot(10, "what", f"{base:016x}"), shot(11, "2020-01-01T00:00:01", f"{base:016x}", hidden=True)]
    got = bursts.bursts(spark.createDataFrame(rows, SHOT), 6, 10).collect()
    assert sorted((r["id"], r["burst"], r["size"]) for r in got) == [(i, 0, 5) for i in range(5)]
    pair = [shot(1, "2020-01-01T00:00:00", "00", w=400), shot(2, "2020-01-01T00:00:10", "01")]
    cover = lambda rows: {r["position"]: r["id"] for r in bursts.bursts(spark.createDataFrame(rows, SHOT), 10, 10).collect()}
    assert cover(pair) == {1: 1, 2: 2}  # a gap of exactly the limit still links
    assert cover([pair[0], shot(2, "2020-01-01T00:00:10", "01", fav=True)]) == {1: 2, 2: 1}
    assert cover([pair[0], shot(2, "2020-01-01T00:00:11", "01")]) == {}


def test_bursts_equal_a_global_union_find(spark):
    rng = random.Random(2)
    rows = [shot(i, str(np.datetime64("2020-01-01T00:00:00") + np.timedelta64(rng.randrange(900), "s")), f"{rng.choice([0, 1, 3, 255, 65535]):016x}") for i in range(200)]
    up = list(range(200))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in rows:
        for b in rows:
            near = abs((np.datetime64(a[1]) - np.datetime64(b[1])) / np.timedelta64(1, "s")) <= 10
            if a[0] < b[0] and near and bin(int(a[2], 16) ^ int(b[2], 16)).count("1") <= 3:
                up[max(root(a[0]), root(b[0]))] = min(root(a[0]), root(b[0]))
    want = {(i, root(i)) for i in range(200) if sum(root(j) == root(i) for j in range(200)) > 1}
    got = bursts.bursts(spark.createDataFrame(rows, SHOT), 3, 10).collect()
    assert {(r["id"], r["burst"]) for r in got} == want


def vecs(spark, rows):
    return spark.createDataFrame(rows, "id long, photo_id long, label long, embedding array<float>")


def test_ranking(spark):
    v = vecs(spark, [(1, 1, 0, [1.0, 0.0, 0.0]), (2, 2, 0, [0.0, 1.0, 0.0]), (3, 3, 0, None), (4, 4, 0, [2.0, 0.0, 0.0])])
    assert [r["id"] for r in ranking.top_k(v, [0.9, 0.1, 0.0]).orderBy("rank").collect()] == [1, 4, 2]  # ties by id
    assert [r["id"] for r in ranking.similar(v, 1, 1).collect()] == [4]
    assert ranking.similar(v, 3).count() == 0
    f = vecs(spark, [(1, 1, 0, [1.0, 0.0, 0.0]), (2, 1, 0, [0.9, 0.1, 0.0]), (3, 2, 0, [0.9, 0.1, 0.0]), (4, 3, 0, [0.2, 0.98, 0.0])])
    assert [r["id"] for r in ranking.similar_faces(f, 1).orderBy("rank").collect()] == [2, 3]


def test_zero_shot(spark):
    eye = np.eye(4, 5).tolist()
    labels = ["people", "food", "landscape", "animals"]
    z = lambda vec, faces, bias: spark.range(1).select(ranking.zero_shot(F.array(*[F.lit(float(x)) for x in vec]), F.lit(faces), labels, eye, 50.0, bias).alias("z")).first()["z"]
    got = z([0.1, 0.9, 0, 0, 0], 0, -0.02)
    assert got["label"] == "food" and abs(sum(got["scores"].values()) - 1) < 1e-4
    flat = [0.25, 0.25, 0.25, 0.25, math.sqrt(1 - 0.25)]
    assert z(flat, 0, 0.4)["label"] == "other"
    near = [0.43, 0, 0, 0, math.sqrt(1 - 0.43**2)]
    assert z(near, 0, 0.45)["label"] == "other" and z(near, 1, 0.45)["label"] == "people"
    assert z([1.0, 0.0], 0, 0.0) is None


def test_dbscan(spark):
    rng = np.random.default_rng(1)
    blobs = np.vstack([rng.normal(c, 0.05, (20, 16)) for c in np.eye(16)[:3]] + [rng.normal(0, 1, (5, 16))])
    unit = blobs / np.linalg.norm(blobs, axis=1, keepdims=True)
    got = {r["id"]: r["cluster"] for r in entity.dbscan(vecs(spark, [(i, i, 0, v.tolist()) for i, v in enumerate(blobs)]), 0.3, 3).collect()}
    near = 1 - unit @ unit.T <= 0.3
    core = near.sum(1) >= 3
    for i in range(65):
        for j in range(65):
            if core[i] and core[j] and near[i, j]:
                assert got[i] == got[j]
        if not core[i] and not (near[i] & core).any():
            assert got[i] is None
    assert len(set(got.values()) - {None}) == 3


def test_dbscan_over_blocks_equals_brute_force(spark, monkeypatch):
    """Cores, border points and noise, with many pairs of blocks, at each kind of min_samples."""
    monkeypatch.setattr(entity, "BLOCK", 20)
    rng = np.random.default_rng(3)
    v = np.vstack([rng.normal(c, s, (30, 6)) for c, s in zip(np.eye(6)[:4], (0.05, 0.2, 0.3, 0.5), strict=True)] + [rng.normal(0, 1, (20, 6))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = 1 - unit @ unit.T <= 0.05
    df = vecs(spark, [(i, i, 0, x.tolist()) for i, x in enumerate(unit.astype(np.float64))]).withColumn("embedding", F.col("embedding").cast("array<double>"))
    for least in (1, 2, 4):
        core, label = near.sum(1) >= least, np.arange(140)
        for _ in range(140):
            label = np.array([min(label[j] for j in range(140) if j == i or (core[i] and core[j] and near[i, j])) for i in range(140)])
        want = {i: int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(near[i] & core)), default=None) for i in range(140)}
        got = {r["id"]: r["cluster"] for r in entity.dbscan(df, 0.05, least).collect()}
        assert got == want
        assert least != 4 or {None} < {want[i] for i in range(140) if not core[i]}  # there are border points and noise


def test_forest():
    rng = np.random.default_rng(7)
    for n, share in ((1, 1.0), (9, 0.1), (40, 0.02), (40, 0.5)):
        close = rng.random((n, n + 3)) < share
        at, root = entity.forest(close)
        assert len(at) <= 2 * n + 3 and (root < n).all()
        own = np.arange(2 * n + 3)
        own[at] = root
        p, q = np.nonzero(close)
        assert (own[p] == own[n + q]).all()
        label = np.arange(2 * n + 3)
        for _ in range(2 * n + 3):
            for i, j in zip(p, q + n, strict=True):
                label[i] = label[j] = min(label[i], label[j])
        assert len(set(label)) == len(set(own))


def test_knn_vote(spark):
    pos = spark.createDataFrame([(1, 2, [1.0, 0.02, 0.0]), (2, 1, [1.0, 0.05, 0.0]), (3, 1, [1.0, 0.06, 0.0])], "id long, person_id long, embedding array<float>")
    probe = vecs(spark, [(9, 9, 0, [1.0, 0.0, 0.0])]).select("id", "embedding")
    assert entity.knn_vote(probe, pos, None, 3).first()["person_id"] == 1
    assert entity.knn_vote(probe, pos, None, 2).first()["person_id"] == 2  # one vote each: the nearer
    neg = spark.createDataFrame([(1, 2, [1.0, 0.0, 0.0])], "id long, person_id long, embedding array<float>")
    assert entity.knn_vote(probe, pos.filter("person_id = 2"), neg).count() == 0
    assert entity.knn_vote(probe, pos, neg, 2).first()["person_id"] == 1


def test_labels_are_carried_once(spark):
    box = "id long, photo_id long, person_id long, confidence double, bbox struct<x:int,y:int,w:int,h:int>"
    old = spark.createDataFrame([(1, 1, 7, 1.0, (0, 0, 10, 10)), (2, 1, 8, 1.0, (3, 0, 10, 10)), (3, 1, 9, 0.5, (200, 200, 10, 10))], box)
    new = spark.createDataFrame([(11, 1, None, 0.0, (1, 0, 10, 10)), (12, 1, None, 0.0, (200, 200, 10, 10))], box)
    assert [(r["new_id"], r["person_id"]) for r in entity.carry_labels(old, new).collect()] == [(11, 7)]


PERSONS = [{"id": 1, "name": "Stefano"}, {"id": 2, "name": "Anna"}, {"id": 3, "name": "Anna Maria"}]


def test_labels_are_carried_as_a_loop_carries_them(spark, sf):
    """iou_carry, whole: pairs by overlap, then the later new face, then the later old one, one to one."""
    from shutterlake import registry
    from shutterlake.catalog import StarCatalog

    c = StarCatalog(spark, sf)
    old, new = [r for r in c.faces.collect() if r["person_id"] is not None], registry._moved(c).collect()
    by: dict[int, list] = {}
    for r in new:
        by.setdefault(r["photo_id"], []).append(r)

    def overlap(a, b):
        w = max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
        h = max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
        return round(w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h), 6)

    pairs = [(overlap(o["bbox"], n["bbox"]), n["id"], o["id"], o["person_id"]) for o in old for n in by.get(o["photo_id"], ())]
    used, want = set(), set()
    for x, n, o, who in sorted(pairs, reverse=True):
        if x >= 0.3 and n not in used and -o - 1 not in used:
            used |= {n, -o - 1}
            want.add((n, who))
    got = {(r["new_id"], r["person_id"]) for r in registry.QUERIES["iou_carry"](spark, sf).collect()}
    assert got == want and len(want) > 1000


def test_questions(spark):
    read = planner.Reader(PERSONS).read
    q = read("a photo of Stefano eating food")
    assert (q.ids, q.mode, q.rest, q.only_filters) == ([1], None, "eating food", False)
    q = read("Anna Maria and stefano at the beach together")
    assert (q.ids, q.mode, q.company, q.rest) == ([3, 1], "all", ("2-4", "5+"), "beach")
    q = read("Stefano alone")
    assert q.company == ("1",) and q.only_filters and q.filters() == {"person_id": [1], "people": ["1"]}
    assert read("Stefano with other people").filters() == {"person_id": [1], "people": ["2-4", "5+"]}
    assert read("Annabel with a cup of coffee").rest == "Annabel with a cup of coffee"
    assert read("Anna near a sunset and the").rest == "near a sunset"
    assert read("anna, ANNA and Anna Maria!").ids == [2, 3]
    assert read(None) == planner.Question() == read("") and not read(None).only_filters
    assert planner.Reader([]).read("Anna").rest == "Anna"
    overlap = planner.Reader([{"id": 1, "name": "Anna Maria"}, {"id": 2, "name": "Maria Rossi"}, {"id": 3, "name": "Anna"}, {"id": 4, "name": None}, {"id": 5, "name": "anna"}])
    assert overlap.read("Anna Maria Rossi").ids == [3, 2]
    asked = spark.createDataFrame([("Stefano alone",), (None,)], "q string").select(planner.read_column(F.col("q"), PERSONS).alias("p")).collect()
    assert asked[0]["p"]["ids"] == [1] and asked[1]["p"]["rest"] == ""


def test_names_in_random_questions():
    """Whole words that are a name and nothing else: each person once, by first mention."""
    import random

    rng, names = random.Random(3), ["ada", "Bo", "cy", "dee"]
    reader = planner.Reader([{"id": i, "name": n} for i, n in enumerate(names)])
    for _ in range(300):
        words = rng.choices(["Ada", "BO", "cy", "dee", "adam", "boat", "sea", "by"], k=rng.randint(0, 8))
        low = [w.lower() for w in words]
        assert reader.read(" ".join(words)).ids == list(dict.fromkeys(names.index(n) for w in low for n in names if n.lower() == w))


def test_nearest_city(spark):
    c = spark.createDataFrame([(0, "Rome", "Italy", 41.9, 12.5), (1, "Roma", "Italy", 41.9, 12.5), (2, "Paris", "France", 48.85, 2.35)], "n int, name string, country string, clat double, clon double")
    p = spark.createDataFrame([(1, 42.0, 12.0), (2, None, 1.0), (3, 49.0, 2.0)], "id long, lat double, lon double")
    assert [r["city"] for r in timeline.nearest_city(p, c).orderBy("id").collect()] == ["Rome", None, "Paris"]


def test_nearest_city_looks_as_far_as_it_must(spark):
    """Cities in cubes against all of them: near points, far ones, poles, the date line, places of garbage."""
    rng = np.random.default_rng(5)
    places = [(float(a), float(o)) for a, o in zip(rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400), strict=True)] + [(90.0, 0.0), (0.0, 180.0), (0.0, -180.0)]
    c = spark.createDataFrame([(i, f"c{i}", "x", a, o) for i, (a, o) in enumerate(places)], "n int, name string, country string, clat double, clon double")
    some = [(a + float(x), o + float(y)) for (a, o), x, y in zip(places, rng.normal(0, 0.5, 403), rng.normal(0, 0.5, 403), strict=True)]
    some += [(float(a), float(o)) for a, o in zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300), strict=True)] + [(200.0, 700.0), (89.99, -179.9), (-90.0, 5.0)]
    got = {r["id"]: (r["city"], r["km"]) for r in timeline.nearest_city(spark.createDataFrame([(i, *x) for i, x in enumerate(some)], "id long, lat double, lon double"), c).collect()}
    for i, (a, o) in enumerate(some):
        p, q, k = np.radians(a), np.radians([x[0] for x in places]), np.radians([x[1] - o for x in places])
        km = 2 * 6371 * np.arcsin(np.minimum(1, np.sqrt(np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(k / 2) ** 2)))
        assert abs(got[i][1] - km.min()) < 1e-6 and km[int(got[i][0][1:])] < km.min() + 1e-6
    empty = spark.createDataFrame([(1, 2.0, 3.0)], "id long, lat double, lon double")
    assert timeline.nearest_city(empty, c.limit(0)).first()["city"] is None


def test_a_long_trip_gives_its_first_photos(spark):
    rows = [(f"2021-01-{1 + k // 3:02d}T{(k * 7) % 3 + 8:02d}:00:00", None if k < 5 else 41.0, None if k < 5 else 12.0) for k in range(60)]
    (r,) = timeline.trips(timed(spark, rows), per_trip=7).collect()
    order = sorted(range(60), key=lambda k: (rows[k][0], k))
    assert (r["n"], r["sample"], r["cover"]) == (60, [k + 1 for k in order[:7]], next(k + 1 for k in order if rows[k][1]))


def test_equal_shots_are_linked_once(spark):
    rows = [shot(i, f"2020-01-01T00:00:0{i % 10}", f"{[0, 0xFFFF][i % 2]:016x}") for i in range(40)]
    assert bursts.chained(spark.createDataFrame(rows, SHOT), 3, 10).count() == 38
    groups = {(r["burst"], r["size"]) for r in bursts.bursts(spark.createDataFrame(rows, SHOT), 3, 0).collect()}
    assert groups == {(i, 4) for i in range(10)}  # no gap: equal times only
