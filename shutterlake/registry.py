"""The engine's queries over the benchmark tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import VIEWS_SQL, StarCatalog
from .functions import media, planner
from .engine import Engine
from .functions.geo import haversine_km
from .functions.vectors import cosine_distance, literal
from .operators import browse, bursts, entity, facets, mutate, people, ranking, stats, timeline
from .operators.predicates import PEOPLE, escape_like, select
from .sources import files
from .sources.export import sidecars
from .streaming.ingest import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[StarCatalog], DataFrame], sql: str | None = None, extra: str = "") -> None:
    QUERIES[name] = lambda spark, d: run(StarCatalog(spark, d))
    if sql:
        SQL[name] = f"WITH RECURSIVE {VIEWS_SQL.strip()}{',' + extra if extra else ''} {sql}"


# ---- browsing --------------------------------------------------------------------------------
_BASE = {"scene": ["food", "people"], "country": ["ASIA", "EUROPE"], "hidden": False}
_BASE_SQL = "scene_type IN ('food', 'people') AND place_country IN ('ASIA', 'EUROPE') AND NOT hidden"
_NEWEST = "taken_at DESC NULLS LAST, id DESC"
_ROW = "id, filename, taken_at, place_city, scene_type, face_count, favorite, rank"


def _browse(name: str, filters: dict[str, Any], where: str, by: str = _NEWEST, limit: int = 60, offset: int = 0) -> None:
    _add(
        name,
        lambda c: browse.search(c.photos, c.faces, filters, limit, offset, count=False)[0].select(*_ROW.split(", ")),
        f"SELECT {_ROW} FROM (SELECT *, row_number() OVER (ORDER BY {by}) rank FROM photos p WHERE {where}) WHERE rank > {offset} AND rank <= {offset + limit}",
    )


_browse("browse_filtered", _BASE | {"favorite": True}, f"{_BASE_SQL} AND favorite")
_browse("browse_date_range", {"date_from": "1995-02-01", "date_to": "1995-03-31"}, "substr(taken_at, 1, 10) >= '1995-02-01' AND substr(taken_at, 1, 10) <= '1995-03-31'")
_browse("browse_year_camera", {"year": [1996, "1997"], "camera": "MACHINERY", "has_faces": True}, "substr(taken_at, 1, 4) IN ('1996', '1997') AND camera_model = 'MACHINERY' AND face_count > 0")
_browse("browse_person_any", {"person_id": [3, 7]}, "EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = p.id AND person_id IN (3, 7))")
_browse("browse_person_all", {"person_id": [3, 7], "person_mode": "all"}, "EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = p.id AND person_id = 3) AND EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = p.id AND person_id = 7)")
_browse("browse_text_q", {"q": "NaTion_1"}, " OR ".join(f"lower({c}) LIKE '%nation!_1%' ESCAPE '!'" for c in ("filename", "place_city", "place_country", "place_label", "folder_place", "camera_make", "camera_model")))
_browse("browse_buckets", {"people": ["0", "5+"], "known": ["1", "2+", "x"]}, "(face_count = 0 OR face_count >= 5) AND (named_face_count = 1 OR named_face_count >= 2)")
_browse("browse_kind", {"kind": ["portrait", "food"], "place": ["Trip 1"]}, "(face_count = 1 OR scene_type = 'food') AND folder_place = 'Trip 1'")
_browse("browse_hidden", {"hidden": True, "city": ["NATION_3", "NATION_4"]}, "hidden AND place_city IN ('NATION_3', 'NATION_4')")
_browse("browse_sort_newest", _BASE | {"sort": "newest"}, _BASE_SQL)
_browse("browse_sort_oldest", _BASE | {"sort": "oldest"}, _BASE_SQL, "taken_at ASC NULLS FIRST, id ASC")
_browse("browse_sort_filename", _BASE | {"sort": "filename"}, _BASE_SQL, "translate(filename, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ASC NULLS FIRST, id ASC")
_browse("browse_sort_filename_desc", _BASE | {"sort": "filename_desc"}, _BASE_SQL, "translate(filename, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') DESC NULLS LAST, id DESC")
_browse("browse_sort_indexed", _BASE | {"sort": "indexed"}, _BASE_SQL, "indexed_at DESC NULLS LAST, id DESC")
_browse("browse_page2", _BASE, _BASE_SQL, limit=60, offset=60)
_add("browse_total", lambda c: select(c.photos, c.faces, _BASE).agg(F.count(F.lit(1)).alias("total")), f"SELECT count(*) total FROM photos WHERE {_BASE_SQL}")
_add(
    "photo_detail",
    lambda c: browse.detail(c.photos, c.faces, c.persons, 7).select("id", "filename", F.inline_outer("faces").alias("face_id", "person_id", "name", "confidence")),
    "SELECT p.id, filename, f.id face_id, person_id, name, confidence FROM photos p LEFT JOIN faces f ON f.photo_id = p.id LEFT JOIN persons s ON s.id = person_id WHERE p.id = 7",
)
_add("map_points", lambda c: browse.map_points(c.photos, c.faces, {"scene": "food"}), "SELECT id, lat, lon, substr(taken_at, 1, 4) AS year FROM photos WHERE scene_type = 'food' AND lat IS NOT NULL ORDER BY id LIMIT 50000")
_add("like_escape", lambda c: c.photos.filter(F.col("place_label").like("%" + escape_like("N_3") + "%")).select("id"), r"SELECT id FROM photos WHERE place_label LIKE '%N\_3%' ESCAPE '\'")

# ---- facets ----------------------------------------------------------------------------------
_FACETED = {"scene": ["food", "people"], "country": ["ASIA"], "people": ["2-4", "5+"], "hidden": False}
_PARTS = {"scene": "scene_type IN ('food', 'people')", "country": "place_country = 'ASIA'", "people": "(face_count BETWEEN 2 AND 4 OR face_count >= 5)", "hidden": "NOT hidden"}


def _others(key: str) -> str:
    return " AND ".join(s for k, s in _PARTS.items() if k != key)


_COLUMNS = {
    "scene": "scene_type", "country": "place_country", "city": "place_city", "place": "folder_place", "camera": "camera_model", "year": "substr(taken_at, 1, 4)",
    "people": "CASE WHEN face_count = 0 THEN '0' WHEN face_count = 1 THEN '1' WHEN face_count BETWEEN 2 AND 4 THEN '2-4' ELSE '5+' END",
    "known": "CASE WHEN named_face_count = 0 THEN '0' WHEN named_face_count = 1 THEN '1' ELSE '2+' END",
}
for _d, _c in _COLUMNS.items():
    _add(f"facet_{_d}", lambda c, d=_d: facets.facet(c.photos, c.faces, _FACETED, d), f"SELECT {_c} AS value, count(*) n FROM photos WHERE {_others(_d)} GROUP BY 1 HAVING value IS NOT NULL")
_KINDS = {"portrait": "face_count = 1", "group": "face_count >= 2"} | {s: f"scene_type = '{s}'" for s in ("animals", "landscape", "plants", "food", "vehicle", "building", "document", "screenshot", "other")}
_KIND_SQL = " UNION ALL ".join(f"SELECT '{k}' AS value, count(*) n FROM photos WHERE {_others('kind')} AND {p} HAVING n > 0" for k, p in _KINDS.items())
_add("facet_kind", lambda c: facets.kinds(c.photos, c.faces, _FACETED), f"SELECT * FROM ({_KIND_SQL})")
_add(
    "facet_person",
    lambda c: facets.persons_facet(c.photos, c.faces, c.persons, _FACETED),
    f"SELECT person_id, name, count(DISTINCT photo_id) n FROM faces JOIN persons s ON s.id = person_id WHERE photo_id IN (SELECT id FROM photos WHERE {_others('')}) GROUP BY ALL",
)
_add(
    "facet_flags",
    lambda c: facets.flags(c.photos, c.faces, _FACETED),
    f"SELECT count(*) FILTER (WHERE face_count > 0 AND {_others('')}) with_faces, count(*) FILTER (WHERE favorite AND {_others('')}) favorites, count(*) FILTER (WHERE hidden AND {_others('hidden')}) hidden, count(*) total FROM photos",
)
_add("facet_date_bounds", lambda c: facets.date_bounds(c.photos, c.faces, _FACETED | {"date_from": "1999-01-01"}), f"SELECT min(substr(taken_at, 1, 10)) AS first, max(substr(taken_at, 1, 10)) AS last FROM photos WHERE {_others('')}")
_FUSED = " UNION ALL ".join([f"SELECT '{d}' dimension, {c} AS value, count(*) n FROM photos WHERE {_others(d)} GROUP BY 2 HAVING value IS NOT NULL" for d, c in _COLUMNS.items()] + [f"SELECT 'kind' dimension, value, n FROM ({_KIND_SQL})"])
_add("facets_fused", lambda c: facets.facets_fused(c.photos, c.faces, _FACETED), f"SELECT * FROM ({_FUSED})")
_add("taken_source_counts", lambda c: facets.sources(c.photos), "SELECT coalesce(taken_source, 'mtime') taken_source, count(*) n FROM photos GROUP BY 1")

# ---- people ----------------------------------------------------------------------------------
_add(
    "list_persons",
    lambda c: people.list_persons(c.persons, c.faces),
    """SELECT s.id, name, count(f.id) faces, count(DISTINCT photo_id) photos,
       coalesce((SELECT x.id FROM faces x WHERE x.id = s.cover_face_id AND x.person_id = s.id), min(f.id) FILTER (WHERE crop_path IS NOT NULL)) AS cover
       FROM persons s LEFT JOIN faces f ON f.person_id = s.id GROUP BY s.id, name, s.cover_face_id""",
)
_add(
    "list_clusters",
    lambda c: people.list_clusters(c.faces, 20).select("cluster_id", "size", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples")),
    """SELECT cluster_id, size, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (SELECT id FROM faces g WHERE g.cluster_id = t.cluster_id AND person_id IS NULL ORDER BY id LIMIT 6)) samples
       FROM (SELECT cluster_id, count(*) size FROM faces WHERE person_id IS NULL AND cluster_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) t""",
)
_add("review_queue", lambda c: people.review_queue(c.faces, c.persons), "SELECT f.id, photo_id, person_id, name, confidence FROM faces f JOIN persons s ON s.id = person_id WHERE crop_path IS NOT NULL AND confidence > 0 AND confidence < 0.6 ORDER BY confidence, f.id LIMIT 60")
_add("person_faces", lambda c: people.person_faces(c.faces, 5), "SELECT id, photo_id, confidence FROM faces WHERE person_id = 5 AND crop_path IS NOT NULL ORDER BY id LIMIT 200")
_add("named_face_count", lambda c: people.named_face_count(c.photos, c.faces), "SELECT id, named_face_count FROM photos")
_add(
    "xmp_names",
    lambda c: people.names_by_path(c.photos, c.faces, c.persons).select("path", F.array_join("names", "|").alias("names")),
    "SELECT path, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM photos p JOIN faces f ON f.photo_id = p.id JOIN persons s ON s.id = person_id GROUP BY p.id, path",
)
_add("xmp_documents", lambda c: sidecars(people.names_by_path(c.photos, c.faces, c.persons)).select("target", F.md5(F.col("document").cast("binary")).alias("digest")),
     """SELECT regexp_replace(path, '(\\.[^./]*)$', '') || '.xmp' target, md5('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:lr="http://ns.adobe.com/lightroom/1.0/"><dc:subject><rdf:Bag>'
       || string_agg('<rdf:li>' || name || '</rdf:li>', '' ORDER BY name) || '</rdf:Bag></dc:subject><lr:hierarchicalSubject><rdf:Bag>' || string_agg('<rdf:li>People|' || name || '</rdf:li>', '' ORDER BY name) || '</rdf:Bag></lr:hierarchicalSubject></rdf:Description></rdf:RDF></x:xmpmeta>') digest
       FROM (SELECT DISTINCT p.id, path, replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') name FROM photos p JOIN faces f ON f.photo_id = p.id JOIN persons s ON s.id = person_id) GROUP BY id, path""")  # fmt: skip

# ---- vectors ---------------------------------------------------------------------------------
_QUERY = [((i * 7) % 13 - 6) / 10 for i in range(64)]
_Q = "list_transform(range(64), lambda i: ((i * 7) % 13 - 6) / 10.0::DOUBLE)"
_COS = "round(list_dot_product(embedding::DOUBLE[], {q}) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product({q}, {q})), 6)"
_SCORE = _COS.format(q=_Q)
_TOP = "SELECT *, row_number() OVER (ORDER BY score DESC, {t}) rank FROM ({s}) QUALIFY rank <= {k}"
_add("vector_topk", lambda c: ranking.top_k(c.vectors, _QUERY), _TOP.format(s=f"SELECT id, {_SCORE} score FROM vectors", t="id", k=200))
_add(
    "vector_filtered_topk",
    lambda c: ranking.semantic_search(select(c.photos, c.faces, _BASE), c.vectors.select("id", "embedding"), _QUERY, 50),
    _TOP.format(s=f"SELECT id, {_SCORE} score FROM vectors WHERE id IN (SELECT id FROM photos WHERE {_BASE_SQL})", t="id", k=50),
)
_add("similar_photos", lambda c: ranking.similar(c.vectors, 11, 50), _TOP.format(s="SELECT v.id, " + _COS.format(q="q").replace("embedding", "v.embedding") + " score FROM vectors v, (SELECT embedding::DOUBLE[] q FROM vectors WHERE id = 11) WHERE v.id <> 11", t="id", k=50))
_BEST = "SELECT photo_id id, max(score) score, arg_min(id, (-score, id)) face_id FROM ({s}) GROUP BY photo_id"
_add(
    "grounded_topk",
    lambda c: ranking.grounded_search(c.vectors, _QUERY, [2, 5], select(c.photos, c.faces, {"hidden": False}), 40),
    _TOP.format(s=_BEST.format(s=f"SELECT id, photo_id, {_SCORE} score FROM vectors WHERE label IN (2, 5) AND photo_id IN (SELECT id FROM photos WHERE NOT hidden)"), t="face_id", k=40),
)
_add(
    "similar_faces",
    lambda c: ranking.similar_faces(c.vectors, 17, 40),
    _TOP.format(s=_BEST.format(s="SELECT v.id, v.photo_id, " + _COS.format(q="q").replace("embedding", "v.embedding") + " score FROM vectors v, (SELECT embedding::DOUBLE[] q, photo_id pp FROM vectors WHERE id = 17) WHERE v.photo_id <> pp"), t="face_id", k=40),
)
_LABELS = ("people", "food", "landscape")
_PROTOS = [[((i * (k + 3)) % 11 - 5) / 10 for i in range(64)] for k in range(3)]
_SIM = [f"list_dot_product(embedding::DOUBLE[], p{k}) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(p{k}, p{k}))" for k in range(3)]
_add(
    "zero_shot_labels",
    lambda c: c.vectors.select("id", ranking.zero_shot(F.col("embedding"), F.col("photo_id") % 3, _LABELS, _PROTOS).alias("z")).select("id", "z.label", F.element_at("z.scores", F.col("z.label")).alias("p"), F.element_at("z.scores", F.lit("other")).alias("other")),
    f"""SELECT id, (['people', 'food', 'landscape', 'other'])[list_position(l, list_max(l))] AS label, round(exp(list_max(l) - list_max(l)) / s, 6) p, round(exp(l[4] - list_max(l)) / s, 6) other
    FROM (SELECT id, l, list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) s FROM (SELECT id, [50 * ({_SIM[0]} + CASE WHEN photo_id % 3 >= 1 THEN 0.04 ELSE 0 END)::DOUBLE, 50 * {_SIM[1]}, 50 * {_SIM[2]}, -1.0::DOUBLE] l
    FROM vectors, (SELECT {", ".join(f"list_transform(range(64), lambda i: ((i * {k + 3}) % 11 - 5) / 10.0::DOUBLE) p{k}" for k in range(3))})))""",
)
_add("prototypes", lambda c: ranking.prototypes(c.vectors).select("label", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(F.element_at("embedding", 64), 6).alias("last")),
     """SELECT label, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS first, round(m[64] / sqrt(list_dot_product(m, m)), 6) AS last FROM (SELECT label, list(a ORDER BY i) m FROM (SELECT label, i, avg(embedding[i] / n) a FROM (SELECT label, embedding::DOUBLE[] embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) n FROM vectors), unnest(range(1, 65)) AS u(i) GROUP BY label, i) GROUP BY label)""")  # fmt: skip

# ---- entity resolution -----------------------------------------------------------------------
_U = " u AS (SELECT id, photo_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) v FROM vectors)"
_add(
    "dbscan_clusters",
    lambda c: entity.dbscan(c.vectors.select("id", "embedding"), 0.6, 2),
    "SELECT u.id, CASE WHEN m IS NOT NULL THEN least(u.id, m) END AS cluster FROM u LEFT JOIN (SELECT a, min(b) m FROM r GROUP BY a) ON a = u.id",
    _U + ", e AS (SELECT x.id a, y.id b FROM u x JOIN u y ON x.id <> y.id AND 1 - list_dot_product(x.v, y.v) <= 0.6), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)",
)
_KNN = """
 near AS (SELECT p.id probe, n.id pos, n.person, 1 - list_dot_product(p.v, n.v) d FROM u p JOIN (SELECT id, label person, v FROM u) n ON p.id <> n.id AND 1 - list_dot_product(p.v, n.v) <= 0.85 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d, n.id) <= 5),
 vote AS (SELECT probe, person, count(*) votes, avg(d) mean FROM near GROUP BY ALL)"""
_PICK = "SELECT probe, person person_id, greatest(0.0::DOUBLE, round(1 - mean, 6)) confidence FROM {v} WHERE votes > 0 QUALIFY row_number() OVER (PARTITION BY probe ORDER BY votes DESC, round(mean, 9), person) = 1"
_probes = lambda c: c.vectors.select("id", "embedding")
_known = lambda c: c.vectors.select("id", F.col("label").alias("person_id"), "embedding")
_vetoes = lambda c: c.vectors.select("id", ((F.col("label") + 1) % 10).alias("person_id"), "embedding")
_add("knn_vote", lambda c: entity.knn_vote(_probes(c), _known(c), None, 5, 0.85, others=True), _PICK.format(v="vote"), _U + "," + _KNN)
_add(
    "knn_vote_negatives",
    lambda c: entity.knn_vote(_probes(c), _known(c), _vetoes(c), 5, 0.85, others=True),
    _PICK.format(v="(SELECT vote.probe, vote.person, votes - coalesce(k, 0) votes, mean FROM vote LEFT JOIN neg ON neg.probe = vote.probe AND neg.person = vote.person)"),
    _U + "," + _KNN + """,
 neg AS (SELECT probe, person, count(*) k FROM (SELECT p.id probe, n.person, 1 - list_dot_product(p.v, n.v) d FROM u p JOIN (SELECT id, (label + 1) % 10 person, v FROM u) n ON p.id <> n.id AND 1 - list_dot_product(p.v, n.v) <= 0.85 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d, n.id) <= 5) GROUP BY ALL)""",
)
_IOU = "w * h / ((o.bw * o.bh + n.bw * n.bh) - w * h)::DOUBLE"
_MOVED = " moved AS (SELECT id + 1000000000 id, photo_id, bx + id % 5 bx, byy - id % 3 byy, bw, bh FROM faces)"
_PAIRS = f"""SELECT o.photo_id, o.id old_id, n.id new_id, greatest(0, least(o.bx + o.bw, n.bx + n.bw) - greatest(o.bx, n.bx)) w, greatest(0, least(o.byy + o.bh, n.byy + n.bh) - greatest(o.byy, n.byy)) h, round({_IOU}, 6) iou FROM faces o JOIN moved n ON o.photo_id = n.photo_id"""


def _moved(c: StarCatalog) -> DataFrame:
    """All faces as a new detection finds them: other ids, boxes a little off."""
    b, i = F.col("bbox"), F.col("id")
    return c.faces.select((i + 1_000_000_000).alias("id"), "photo_id", F.struct((b["x"] + i % 5).alias("x"), (b["y"] - i % 3).alias("y"), b["w"].alias("w"), b["h"].alias("h")).alias("bbox"))


_add("iou_pairs", lambda c: entity.iou_pairs(c.faces, _moved(c), 0.3), f"SELECT photo_id, old_id, new_id, iou FROM ({_PAIRS}) WHERE iou >= 0.3", _MOVED)
_add("iou_carry", lambda c: entity.carry_labels(c.faces.withColumn("confidence", F.lit(1.0)), _moved(c), 0.3))
_add(
    "region_box",
    lambda c: c.faces.select("id", media.region_box(F.col("bbox.x"), F.col("bbox.y"), F.col("bbox.w"), F.col("bbox.h"), F.lit(90), F.lit(100)).alias("r")).select("id", "r.*"),
    "SELECT id, l x, t y, greatest(1, r - l) w, greatest(1, b - t) h FROM (SELECT id, greatest(0, CAST(round_even(bx - 0.5 * bw, 0) AS INT)) l, greatest(0, CAST(round_even(byy - 0.3 * bh, 0) AS INT)) t, least(90, CAST(round_even(bx + 1.5 * bw, 0) AS INT)) r, least(100, CAST(round_even(byy + 2.5 * bh, 0) AS INT)) b FROM faces)",
)

# ---- time and space --------------------------------------------------------------------------
_HAV = "2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"


def _trips_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    join = " AND ".join(f"m.{k} = s.{k}" for k in ([by] if by else []) + ["trip"])
    return f""" base AS (SELECT *, epoch(CAST(taken_at AS TIMESTAMP)) t, lat IS NOT NULL AND lon IS NOT NULL g FROM timeline WHERE taken_at IS NOT NULL),
 prev AS (SELECT *, last_value(t IGNORE NULLS) OVER w t0, last_value(CASE WHEN g THEN lat END IGNORE NULLS) OVER w la0, last_value(CASE WHEN g THEN lon END IGNORE NULLS) OVER w lo0 FROM base WINDOW w AS ({part} ORDER BY taken_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 cut AS (SELECT *, CASE WHEN t - t0 > 2 * 86400 THEN 1 WHEN t - t0 > 0 AND g AND la0 IS NOT NULL AND {_HAV.format(a="la0", b="lat", c="lo0", d="lon")} > 200 THEN 1 ELSE 0 END b FROM prev),
 num AS (SELECT *, CAST(sum(b) OVER ({part} ORDER BY taken_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) trip FROM cut),
 pos AS (SELECT *, row_number() OVER (PARTITION BY {keys}trip ORDER BY taken_at, id) pos FROM num),
 seen AS (SELECT {keys}trip, k, v, count(*) c, min(pos) f FROM (SELECT {keys}trip, pos, 0 k, place_label v FROM pos UNION ALL SELECT {keys}trip, pos, -1 k, folder_place v FROM pos) WHERE v <> '' GROUP BY ALL),
 place AS (SELECT {keys}trip, arg_max(v, (k, c, -f)) place FROM seen GROUP BY ALL),
 main AS (SELECT {keys}trip, min(taken_at) AS "start", max(taken_at) AS "end", count(*) n, round(avg(lat) FILTER (WHERE g), 6) lat, round(avg(lon) FILTER (WHERE g), 6) lon, coalesce(arg_min(id, pos) FILTER (WHERE g), arg_min(id, pos)) AS cover, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos <= 12) sample FROM pos GROUP BY ALL HAVING count(*) >= 4)
 SELECT {"m." + by + ", " if by else ""}m.trip, "start", "end", n, lat, lon, cover, sample, place FROM main m LEFT JOIN place s ON {join}"""


def _trips(c: StarCatalog, by: list[str]) -> DataFrame:
    t = timeline.trips(c.timeline, by)
    return t.withColumn("sample", F.array_join(F.transform("sample", lambda x: x.cast("string")), ","))


_add("trips", lambda c: _trips(c, []))
SQL["trips"] = f"WITH {VIEWS_SQL.strip()},{_trips_sql('')}"
_add("trips_per_user", lambda c: _trips(c, ["user_id"]))
SQL["trips_per_user"] = f"WITH {VIEWS_SQL.strip()},{_trips_sql('user_id')}"
_add(
    "on_this_day",
    lambda c: timeline.on_this_day(c.photos, 6, 16, 5).withColumn("sample", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",")),
    "SELECT y AS year, count(*) n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 5) sample FROM (SELECT substr(taken_at, 1, 4) y, id, row_number() OVER (PARTITION BY substr(taken_at, 1, 4) ORDER BY taken_at, id) k FROM photos WHERE substr(taken_at, 6, 2) = '06' AND substr(taken_at, 9, 2) = '16') GROUP BY y",
)
_BURST = """ v AS (SELECT *, epoch(CAST(taken_at AS TIMESTAMP)) t, concat('0x', phash)::UBIGINT b FROM timeline WHERE NOT hidden),
 e AS (SELECT x.id a, y.id b FROM v x JOIN v y ON x.id <> y.id AND y.t BETWEEN x.t - 300 AND x.t + 300 AND bit_count(xor(x.b, y.b)) <= 10),
 r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 g AS (SELECT a id, least(a, min(b)) burst FROM r GROUP BY a),
 o AS (SELECT g.id, burst, row_number() OVER (PARTITION BY burst ORDER BY favorite DESC, width::BIGINT * height DESC, g.id) "position", count(*) OVER (PARTITION BY burst) size FROM g JOIN timeline t ON t.id = g.id)"""
_add("phash_pairs", lambda c: bursts.linked(c.timeline, 10, 300.0), "SELECT greatest(a, b) a, least(a, b) b FROM e WHERE a > b", _BURST)
_add("bursts", lambda c: bursts.bursts(c.timeline, 10, 300.0), "SELECT * FROM o", _BURST)
_add("burst_cover", lambda c: bursts.bursts(c.timeline, 10, 300.0).filter("position = 1").select("burst", F.col("id").alias("cover"), "size"), 'SELECT burst, id AS cover, size FROM o WHERE "position" = 1', _BURST)
_add("burst_summary", lambda c: bursts.redundant(bursts.bursts(c.timeline, 10, 300.0)), 'SELECT count(DISTINCT burst) AS "groups", count(*) FILTER (WHERE "position" > 1) redundant FROM o', _BURST)
_add("memories_total", lambda c: timeline.memories_total(timeline.on_this_day(c.photos, 6, 16)), "SELECT CAST(count(*) AS BIGINT) total FROM photos WHERE substr(taken_at, 6, 2) = '06' AND substr(taken_at, 9, 2) = '16'")
_CITIES = (("Rome", "Italy", 41.9, 12.5), ("Paris", "France", 48.85, 2.35), ("Oslo", "Norway", 59.9, 10.75), ("Cairo", "Egypt", 30.04, 31.24), ("Sydney", "Australia", -33.87, 151.2), ("Lima", "Peru", -12.05, -77.04))
_CITY_ROWS = ", ".join(f"({i}, '{n}', '{s}', {a}::DOUBLE, {o}::DOUBLE)" for i, (n, s, a, o) in enumerate(_CITIES))
_add(
    "nearest_city",
    lambda c: timeline.nearest_city(c.photos.select("id", "lat", "lon"), c.spark.createDataFrame([(i, *x) for i, x in enumerate(_CITIES)], "n int, name string, country string, clat double, clon double")).withColumn("km", F.round("km", 3)),
    f"SELECT p.id, p.lat, p.lon, x.city, x.country, x.km FROM photos p LEFT JOIN (SELECT p.id, arg_min(name, (k, n)) city, arg_min(t.country, (k, n)) country, round(min(k), 3) km FROM (SELECT p.id, n, name, c.country, 2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(pow(sin((radians(clat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))) k FROM photos p, (VALUES {_CITY_ROWS}) c(n, name, country, clat, clon) WHERE lat IS NOT NULL) t JOIN photos p ON p.id = t.id GROUP BY p.id) x ON x.id = p.id",
)
_add("haversine", lambda c: c.photos.filter("lat is not null").select("id", F.round(haversine_km(F.lit(41.9), F.lit(12.5), F.col("lat"), F.col("lon")), 4).alias("km")), f"SELECT id, round({_HAV.format(a='41.9::DOUBLE', b='lat', c='12.5::DOUBLE', d='lon')}, 4) km FROM photos WHERE lat IS NOT NULL")
_add("sessions", lambda c: sessions(c._t("events").select("user_id", "ts"), "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"),  # noqa: SLF001
     """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "start", count(*) n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END b FROM events)) GROUP BY user_id, s""")  # fmt: skip

# ---- scalars ---------------------------------------------------------------------------------
_NAMES = """CASE event_id % 6 WHEN 0 THEN 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg' WHEN 1 THEN 'VID-' || strftime(ts, '%Y%m%d') || '-WA0001.mp4' WHEN 2 THEN strftime(ts, '%Y-%m-%d %H.%M.%S') || '.png' WHEN 3 THEN 'DSC_' || event_id || '.jpg' WHEN 4 THEN 'WP_' || strftime(ts, '%Y%m%d_%H_%M_%S') || '_Pro.jpg' ELSE strftime(ts, '%d.%m.%Y') || ' sea.jpg' END"""


def _names(c: StarCatalog) -> DataFrame:
    e, f, i = c._t("events"), lambda p: F.date_format("ts", p), F.col("event_id")  # noqa: SLF001
    name = F.when(i % 6 == 0, F.concat(F.lit("IMG_"), f("yyyyMMdd_HHmmss"), F.lit(".jpg"))).when(i % 6 == 1, F.concat(F.lit("VID-"), f("yyyyMMdd"), F.lit("-WA0001.mp4"))).when(i % 6 == 2, F.concat(f("yyyy-MM-dd HH.mm.ss"), F.lit(".png")))
    name = name.when(i % 6 == 3, F.concat(F.lit("DSC_"), i.cast("string"), F.lit(".jpg"))).when(i % 6 == 4, F.concat(F.lit("WP_"), f("yyyyMMdd_HH_mm_ss"), F.lit("_Pro.jpg"))).otherwise(F.concat(f("dd.MM.yyyy"), F.lit(" sea.jpg")))
    return e.select("event_id", name.alias("name"))


_add(
    "filename_date",
    lambda c: _names(c).withColumn("taken_at", media.filename_date(F.col("name"), 2027)),
    f"SELECT event_id, {_NAMES} AS name, CASE WHEN event_id % 6 IN (0, 2, 4) THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN event_id % 6 IN (1, 5) THEN strftime(ts, '%Y-%m-%dT00:00:00') END taken_at FROM events",
)
_MONTH_NAMES = ("gennaio", "February", "mar", "aprile", "May", "giugno", "luglio", "ago", "sept", "Ottobre", "nov", "dicembre")
_add(
    "folder_meta",
    lambda c: c._t("events").select("event_id", media.folder_meta(F.concat(F.lit("/library/"), F.date_format("ts", "yyyy"), F.lit("_Sardegna/"), F.date_format("ts", "MM"), F.lit("-"), F.element_at(F.array(*[F.lit(x) for x in _MONTH_NAMES]), F.month("ts")), F.lit("/x.jpg"))).alias("m")).select("event_id", "m.year", "m.month", "m.place"),  # noqa: SLF001
    "SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, 'Sardegna' place FROM events",
)
_add(
    "exif_format",
    lambda c: c._t("part").select("p_partkey", media.aperture(F.col("p_size") / 10.0).alias("aperture"), media.shutter(F.col("p_size") / 25.0).alias("shutter"), media.focal(F.col("p_size") + 0.5).alias("focal"), media.iso((F.col("p_size") * 50).cast("string")).alias("iso")),  # noqa: SLF001
    """SELECT p_partkey, 'ƒ/' || regexp_replace(printf('%.1f', p_size / 10.0::DOUBLE), '\\.0$', '') aperture, CASE WHEN p_size >= 25 THEN regexp_replace(printf('%.1f', p_size / 25.0::DOUBLE), '\\.0$', '') || 's' ELSE '1/' || CAST(round_even(25.0::DOUBLE / p_size, 0) AS BIGINT) || 's' END shutter, printf('%.1f', p_size + 0.5::DOUBLE) || 'mm' focal, 'ISO ' || p_size * 50 iso FROM part""",
)
_add(
    "iso6709",
    lambda c: c.photos.select("id", F.format_string("%+08.4f%+09.4f/", F.col("lat"), F.col("lon")).alias("s")).filter("s not like '%null%'").select("id", media.iso6709(F.col("s")).alias("p")).select("id", F.round("p.lat", 4).alias("lat"), F.round("p.lon", 4).alias("lon")),
    "SELECT id, round(lat, 4) lat, round(lon, 4) lon FROM photos WHERE lat IS NOT NULL",
)
_add(
    "exif_gps",
    lambda c: c._t("events").select("event_id", media.dms(F.floor("value").cast("double"), (F.col("event_id") % 60).cast("double"), (F.col("user_id") % 60).cast("double"), F.when(F.col("event_id") % 2 == 0, "N").otherwise("S")).alias("lat")),  # noqa: SLF001
    "SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (floor(value) + (event_id % 60) / 60.0::DOUBLE + (user_id % 60) / 3600.0::DOUBLE), 6) lat FROM events",
)
_add("video_probe", lambda c: c._t("events").select("event_id", media.probe(F.concat(F.lit('{"format": {"tags": {"Creation_Time": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('.000000Z", "location": "+41.9000+012.5000/"}, "duration": "'), F.col("user_id").cast("string"), F.lit('"}, "streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 1920, "height": 1080}]}'))).alias("p")).select("event_id", "p.*"),  # noqa: SLF001
     "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') taken_at, 41.9::DOUBLE lat, 12.5::DOUBLE lon, 1920 width, 1080 height, user_id::DOUBLE duration FROM events")
_add("dhash", lambda c: c.vectors.select("id", media.dhash(F.transform(F.slice(F.concat("embedding", "embedding"), 1, 72), lambda x: F.floor(x * 1000))).alias("hash")),
     "SELECT id, list_aggregate(list_transform(range(16), lambda k: substr('0123456789abcdef', 1 + list_sum(list_transform(range(4), lambda j: CASE WHEN v[(4*k+j)//8*9 + (4*k+j)%8 + 1] > v[(4*k+j)//8*9 + (4*k+j)%8 + 2] THEN CAST(8 >> j AS INT) ELSE 0 END))::INT, 1)), 'string_agg', '') AS hash FROM (SELECT id, list_transform(list_concat(embedding, embedding)[1:72], lambda x: floor(x * 1000::FLOAT)) v FROM vectors)")
_add("bucket_filters", lambda c: c.photos.agg(*[F.count_if(p()).alias(f"b{i}") for i, p in enumerate(PEOPLE.values())]), "SELECT count(*) FILTER (WHERE face_count = 0) b0, count(*) FILTER (WHERE face_count = 1) b1, count(*) FILTER (WHERE face_count BETWEEN 2 AND 4) b2, count(*) FILTER (WHERE face_count >= 5) b3 FROM photos")

# ---- glances ---------------------------------------------------------------------------------
_add(
    "library_stats",
    lambda c: stats.library_stats(c.photos, c.faces, c.persons),
    """SELECT * FROM (SELECT 'scene' topic, scene_type AS value, count(*) n FROM photos GROUP BY 2 ORDER BY n DESC, 2 LIMIT 6) UNION ALL SELECT * FROM (SELECT 'country', place_country, count(*) n FROM photos GROUP BY 2 ORDER BY n DESC, 2 LIMIT 6)
    UNION ALL SELECT * FROM (SELECT 'person', name, count(DISTINCT photo_id) n FROM faces JOIN persons s ON s.id = person_id GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) UNION ALL SELECT 'dated by', coalesce(taken_source, 'mtime'), count(*) FROM photos GROUP BY 2
    UNION ALL SELECT 'first year', min(substr(taken_at, 1, 4)), NULL FROM photos UNION ALL SELECT 'last year', max(substr(taken_at, 1, 4)), NULL FROM photos UNION ALL SELECT 'photos', NULL, count(*) FROM photos UNION ALL SELECT 'videos', NULL, count(*) FILTER (WHERE is_video) FROM photos""",
)
_add("facet_top", lambda c: stats.top(facets.facet(c.photos, c.faces, {}, "city"), 14), "SELECT place_city AS value, count(*) n FROM photos GROUP BY 1 ORDER BY n DESC, value LIMIT 14")
_add("cache_signature", lambda c: stats.signature(c.faces), "SELECT count(*) n, max(id) AS top FROM faces")
_add(
    "enrollment",
    lambda c: people.enrolled(c.vectors.withColumnRenamed("label", "person_id"), c.persons).select("id", "person_id", "name"),
    "SELECT v.id, label person_id, name FROM vectors v JOIN persons s ON s.id = label",
)


_add(
    "vetoes",
    lambda c: people.vetoes(c.vectors.filter("id % 10 = 3").select(F.col("id").alias("face_id"), ((F.col("label") + 1) % 10).alias("person_id")), c.vectors).select("id", "person_id"),
    "SELECT id, (label + 1) % 10 person_id FROM vectors WHERE id % 10 = 3",
)


def _library(c: StarCatalog) -> DataFrame:
    faces = c.vectors.select("id", "photo_id", F.when(F.col("id") % 5 == 0, F.col("label")).alias("person_id"), F.lit(99).alias("cluster_id"), "embedding")
    return people.relabel_clusters(faces, entity.dbscan(faces.filter("person_id is null").select("id", "embedding"), 0.6, 2)).select("id", "person_id", "cluster_id")


_add(
    "cluster_library",
    _library,
    """SELECT v.id, CASE WHEN v.id % 5 = 0 THEN label END person_id, CAST(k AS INT) cluster_id FROM vectors v LEFT JOIN (SELECT id, dense_rank() OVER (ORDER BY c) - 1 k FROM (SELECT a id, least(a, min(b)) c FROM r GROUP BY a)) g ON g.id = v.id""",
    _U + ", e AS (SELECT x.id a, y.id b FROM u x JOIN u y ON x.id <> y.id AND x.id % 5 <> 0 AND y.id % 5 <> 0 AND 1 - list_dot_product(x.v, y.v) <= 0.6), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)",
)

# ---- planner ---------------------------------------------------------------------------------
_PEOPLE = [{"id": 1, "name": "the"}, {"id": 2, "name": "que"}, {"id": 3, "name": "des"}]
_add("plan_query", lambda c: c._t("conversations").select("conv_id", "turn", planner.read_column(F.col("text"), _PEOPLE).alias("p")).select("conv_id", "turn", F.col("p.mode").alias("person_mode"), F.size("p.ids").alias("named"), F.col("p.rest").alias("text")))  # noqa: SLF001

# ---- mutations -------------------------------------------------------------------------------
_PCOLS = ("id", "path", "filename", "sha1", "camera_model", "favorite", "hidden")


def _incoming(c: StarCatalog) -> DataFrame:
    p = c.photo_attributes().filter("id % 10 = 3")
    old = p.select("path", F.concat(F.lit("new-"), "filename").alias("filename"), F.lit("ff").alias("sha1"))
    return old.unionByName(p.select(F.concat(F.lit("/incoming"), "path").alias("path"), "filename", "sha1"))


_add(
    "upsert_merge",
    lambda c: mutate.upsert_photos(c.photo_attributes().select(*_PCOLS), _incoming(c)),
    """SELECT id, path, CASE WHEN id % 10 = 3 THEN 'new-' || filename ELSE filename END filename, CASE WHEN id % 10 = 3 THEN 'ff' ELSE sha1 END sha1, CASE WHEN id % 10 <> 3 THEN camera_model END camera_model, favorite, hidden FROM photos
       UNION ALL SELECT (SELECT max(id) FROM photos) + row_number() OVER (ORDER BY '/incoming' || path), '/incoming' || path, filename, sha1, NULL, false, false FROM photos WHERE id % 10 = 3""",
)
_add(
    "merge_persons",
    lambda c: mutate.merge_persons(c.persons, c.faces, {3: 7, 4: 7})[1].groupBy("person_id").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN person_id IN (3, 4) THEN 7 ELSE person_id END person_id, count(*) n FROM faces GROUP BY 1",
)
_add(
    "assign_cluster",
    lambda c: mutate.assign_cluster(c.faces, 12, 5).select("id", "person_id", "cluster_id", "confidence"),
    "SELECT id, CASE WHEN cluster_id = 12 AND person_id IS NULL THEN 5 ELSE person_id END person_id, CASE WHEN cluster_id = 12 AND person_id IS NULL THEN NULL ELSE cluster_id END cluster_id, confidence FROM faces",
)


def _assigned(c: StarCatalog) -> DataFrame:
    f, n = mutate.assign_face(c.faces, c.negatives, 7 * 64 + 1, 9)
    kinds = f.filter("photo_id = 7").select("id", "person_id", "confidence", F.lit("face").alias("kind"))
    return kinds.unionByName(n.select(F.col("face_id").alias("id"), "person_id", F.lit(None).cast("double").alias("confidence"), F.lit("negative").alias("kind")))


_add(
    "assign_face",
    _assigned,
    """SELECT id, CASE WHEN id = 449 THEN 9 ELSE person_id END person_id, CASE WHEN id = 449 THEN 1.0::DOUBLE ELSE confidence END confidence, 'face' kind FROM faces WHERE photo_id = 7
       UNION ALL SELECT face_id, person_id, NULL, 'negative' FROM (SELECT * FROM negatives UNION SELECT id, person_id FROM faces WHERE id = 449 AND person_id <> 9) WHERE NOT (face_id = 449 AND person_id = 9)""",
)


def _deleted(c: StarCatalog) -> DataFrame:
    p, f, n = mutate.delete_photos(c.photo_attributes(), c.faces, c.negatives, c.photo_attributes().filter("id % 4 = 0").select("id"))
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count(p, "photos").unionByName(count(f, "faces")).unionByName(count(n, "negatives"))


_add(
    "delete_cascade",
    _deleted,
    "SELECT 'photos' AS name, count(*) n FROM photos WHERE id % 4 <> 0 UNION ALL SELECT 'faces', count(*) FROM faces WHERE photo_id % 4 <> 0 UNION ALL SELECT 'negatives', count(*) FROM negatives WHERE face_id IN (SELECT id FROM faces WHERE photo_id % 4 <> 0)",
)
_add(
    "sha1_dedup",
    lambda c: mutate.new_content(c.photo_attributes().select("path", "sha1").withColumn("path", F.concat(F.lit("/b"), "path")), c.photo_attributes().filter("id % 5000 < 100").select("path", "sha1")),
    "SELECT '/b' || min(path) path, sha1 FROM photos WHERE sha1 NOT IN (SELECT sha1 FROM photos WHERE id % 5000 < 100) GROUP BY sha1",
)
_add(
    "orphan_sweep",
    lambda c: mutate.orphans(c.photo_attributes().select(F.concat(F.lit("/thumbs/"), F.col("sha1"), F.when(F.col("id") % 9 == 0, ".part").otherwise("_320.jpg")).alias("path")), c.photo_attributes().filter("id % 5000 < 4000").select("sha1")),
    "SELECT '/thumbs/' || sha1 || CASE WHEN id % 9 = 0 THEN '.part' ELSE '_320.jpg' END path FROM photos WHERE id % 9 = 0 OR sha1 NOT IN (SELECT sha1 FROM photos WHERE id % 5000 < 4000)",
)
_add("set_flags", lambda c: mutate.set_flag(c.photo_attributes(), "favorite", True, [1, 2, 3]).groupBy("favorite").agg(F.count(F.lit(1)).alias("n")), "SELECT favorite OR id IN (1, 2, 3) favorite, count(*) n FROM photos GROUP BY 1")
_add(
    "prune_missing",
    lambda c: mutate.pruned(c.photo_attributes(), c.photo_attributes().filter("id % 6 <> 1").select("path")).select("id"),
    "SELECT id FROM photos WHERE id % 6 <> 1",
)
_add(
    "export_plan",
    lambda c: mutate.export_plan(c.photo_attributes().withColumn("filename", F.concat(F.lit("p"), (F.col("id") % 50).cast("string"), F.lit(".jpg"))), c.photo_attributes().select(F.explode(F.array("id", -1 - F.col("id"))).alias("id")), "/out").select("id", "target"),
    "SELECT id, '/out/p' || (id % 50) || CASE WHEN row_number() OVER (PARTITION BY id % 50 ORDER BY id) = 1 THEN '' ELSE '_' || id END || '.jpg' target FROM photos UNION ALL SELECT -1 - id, NULL FROM photos",
)
_add(
    "integrity",
    lambda c: mutate.integrity(c.photo_attributes(), c.faces, c.persons, c.negatives),
    """SELECT 'face without photo' AS "check", count(*) n FROM faces WHERE photo_id NOT IN (SELECT id FROM photos) UNION ALL SELECT 'face of no person', count(*) FROM faces WHERE person_id IS NOT NULL AND person_id NOT IN (SELECT id FROM persons) UNION ALL SELECT 'negative of no face', count(*) FROM negatives WHERE face_id NOT IN (SELECT id FROM faces)""",
)


# ---- ranked pages and questions ------------------------------------------------------------------
def _answer(c: StarCatalog, text: str, filters: dict[str, Any], limit: int, offset: int) -> DataFrame:
    e = Engine(c, c.vectors.select("id", "embedding"), c.vectors, encode=lambda _: _QUERY)
    a = e.ask(text, filters, limit, offset)
    return a.rows.select("id", "filename", "score", "rank", F.lit(a.total).cast("long").alias("total"))


_PAGE = "SELECT t.id, filename, score, rank, total FROM (SELECT *, row_number() OVER (ORDER BY score DESC, {t}) rank, least(200, count(*) OVER ()) total FROM ({s})) t JOIN photos p ON p.id = t.id WHERE rank > {o} AND rank <= {o} + 30"
_add("semantic_page", lambda c: _answer(c, "boats at sea", _BASE, 30, 10), _PAGE.format(s=f"SELECT id, {_SCORE} score FROM vectors WHERE id IN (SELECT id FROM photos WHERE {_BASE_SQL})", t="id", o=10))
_add(
    "grounded_page",
    lambda c: _answer(c, "Supplier#000000002 at sea", {"person_id": list(range(1, 90)), "person_mode": "any"}, 30, 2),
    _PAGE.format(s=_BEST.format(s=f"SELECT id, photo_id, {_SCORE} score FROM vectors WHERE label = 2 AND photo_id IN (SELECT id FROM photos WHERE NOT hidden AND id IN (SELECT photo_id FROM faces WHERE person_id BETWEEN 1 AND 89))"), t="face_id", o=2),
)
_add(
    "ask_filters",
    lambda c: Engine(c).ask("Supplier#000000003", {"person_id": [7], "scene": "food"}).rows.select("id", "filename", "rank"),
    "SELECT id, filename, rank FROM (SELECT *, row_number() OVER (ORDER BY taken_at DESC NULLS LAST, id DESC) rank FROM photos WHERE NOT hidden AND scene_type = 'food' AND id IN (SELECT photo_id FROM faces WHERE person_id IN (3, 7))) WHERE rank <= 60",
)
_add("cosine_distance", lambda c: c.vectors.select("id", F.round(cosine_distance(F.col("embedding").cast("array<double>"), literal(_QUERY)), 6).alias("d")), f"SELECT id, round(1 - list_dot_product(embedding::DOUBLE[], {_Q}) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product({_Q}, {_Q})), 6) d FROM vectors")

# ---- files and their metadata ----------------------------------------------------------------------
_LISTED_SQL = "SELECT path || CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN '.MOV' WHEN 2 THEN '.HEIC' WHEN 3 THEN '.txt' ELSE '.webm' END path FROM photos"


def _listing(c: StarCatalog) -> DataFrame:
    i = F.col("id") % 5
    return c.photo_attributes().select("id", F.concat("path", F.when(i == 0, "").when(i == 1, ".MOV").when(i == 2, ".HEIC").when(i == 3, ".txt").otherwise(".webm")).alias("path"))


_add(
    "media_kinds",
    lambda c: files.routed(_listing(c).select("path"), ["/library/1995"]),
    f"SELECT path, CASE WHEN regexp_matches(lower(path), '\\.(jpg|heic)$') THEN 'photo' WHEN regexp_matches(lower(path), '\\.(mov|webm)$') THEN 'video' ELSE 'other' END kind FROM ({_LISTED_SQL}) WHERE path NOT LIKE '/library/1995/%'",
)
_add("content_hash", lambda c: c._t("documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("sha1")), "SELECT doc_id, sha1(text) AS sha1 FROM documents")  # noqa: SLF001
_FILES = """ f AS (SELECT event_id, '/in/2019_Sardegna/' || CASE event_id % 4 WHEN 0 THEN 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg' ELSE 'DSC_' || event_id || '.jpg' END path, ts, event_id % 3 = 0 tagged, event_id % 3 = 1 probed, user_id FROM events)"""


def _files(c: StarCatalog) -> DataFrame:
    i, ts = F.col("event_id"), F.col("ts")
    exif = F.create_map(F.lit("DateTime"), F.date_format(ts, "yyyy:MM:dd HH:mm:ss"), F.lit("DateTimeOriginal"), F.when(i % 2 == 0, F.date_format(ts, "yyyy-MM-dd 10:00:00")).otherwise("0000:00:00 00:00:00"), F.lit("Make"), F.lit(" Cam\0"), F.lit("Model"), F.lit("  "), F.lit("GPSLatitude"), F.format_string("%d/1, 30/1, 0/1", F.col("user_id").cast("long")), F.lit("GPSLatitudeRef"), F.lit("S"), F.lit("GPSLongitude"), F.lit("12, 0, 36"), F.lit("GPSLongitudeRef"), F.when(i % 5 == 0, F.lit("W")).otherwise("E"))
    container = F.format_string('{"format": {"tags": {"creation_time": "%s"}}, "streams": []}', F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.000000'Z'"))
    name = F.when(i % 4 == 0, F.concat(F.lit("IMG_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(".jpg"))).otherwise(F.concat(F.lit("DSC_"), i.cast("string"), F.lit(".jpg")))
    return c._t("events").select("event_id", F.concat(F.lit("/in/2019_Sardegna/"), name).alias("path"), F.col("ts").alias("modified"), F.when(i % 3 == 0, exif).alias("exif"), F.when(i % 3 == 1, container).alias("probe"))  # noqa: SLF001


_add(
    "described_files",
    lambda c: files.described(_files(c), F.col("exif"), 2027, F.col("probe")).select("event_id", "filename", "taken_at", "taken_source", "folder_place", "lat", "lon", "camera_make", "camera_model"),
    """SELECT event_id, split_part(path, '/', 4) filename, CASE WHEN tagged AND event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT10:00:00') WHEN tagged OR probed OR event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE '2019-01-01T00:00:00' END taken_at,
       CASE WHEN tagged THEN 'exif' WHEN probed THEN 'video' WHEN event_id % 4 = 0 THEN 'filename' ELSE 'folder' END taken_source, 'Sardegna' folder_place,
       CASE WHEN tagged AND user_id + 0.5 <= 90 THEN -(user_id + 0.5::DOUBLE) END lat, CASE WHEN tagged THEN CASE WHEN event_id % 5 = 0 THEN -12.01::DOUBLE ELSE 12.01::DOUBLE END END lon, CASE WHEN tagged THEN 'Cam' END camera_make, CAST(NULL AS VARCHAR) camera_model FROM f""",
    _FILES,
)
_add("exif_times", lambda c: c._t("events").select("event_id", media.exif_time(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", " yyyy:MM:dd HH:mm:ss ")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("0000:00:00 00:00:00"))).alias("t")),  # noqa: SLF001
     "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END t FROM events")
_add(
    "derivative_paths",
    lambda c: c.photo_attributes().select("id", media.content_path("/t", F.col("sha1"), 320).alias("thumb"), media.content_path("/t", F.col("sha1")).alias("whole"), media.poster_path("/t", F.col("sha1")).alias("poster")),
    "SELECT id, '/t/' || substr(sha1, 1, 2) || '/' || sha1 || '_320.jpg' thumb, '/t/' || substr(sha1, 1, 2) || '/' || sha1 || '.jpg' whole, '/t/' || substr(sha1, 1, 2) || '/' || sha1 || '_poster.jpg' poster FROM photos",
)
_add("scene_scores", lambda c: c.photo_attributes().select("id", media.scores_json(F.create_map(F.lit("people"), F.col("id") % 7, F.lit("other"), F.lit(1))).alias("scores")), """SELECT id, '{"people":' || id % 7 || ',"other":1}' scores FROM photos""")
_add("place_labels", lambda c: c.photo_attributes().select("id", media.place_label(F.col("place_city"), F.col("place_country")).alias("label")), "SELECT id, place_label AS label FROM photos")
_add("xml_texts", lambda c: c._t("conversations").select("conv_id", "turn", F.md5(media.xml_escape(F.col("text")).cast("binary")).alias("m")), "SELECT conv_id, turn, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) m FROM conversations")  # noqa: SLF001
_add(
    "geocoded_files",
    lambda c: files.geocoded(c.photos.select("id", "lat", "lon"), c.spark.createDataFrame([(i, *x) for i, x in enumerate(_CITIES)], "n int, name string, country string, clat double, clon double")).select("id", "place_city", "place_label"),
    f"SELECT p.id, x.city place_city, x.city || ', ' || x.country place_label FROM photos p LEFT JOIN (SELECT t.id, arg_min(name, (k, n)) city, arg_min(country, (k, n)) country FROM (SELECT p.id, n, name, c.country, 2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(pow(sin((radians(clat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))) k FROM photos p, (VALUES {_CITY_ROWS}) c(n, name, country, clat, clon) WHERE lat IS NOT NULL) t GROUP BY t.id) x ON x.id = p.id",
)

# ---- changes, row by row ---------------------------------------------------------------------------

def _searches(c: StarCatalog) -> DataFrame:
    return c.persons.select("id", "name", F.concat(F.lit("q="), F.col("id").cast("string")).alias("query"))


_SEARCH = "SELECT id, name, 'q=' || id AS query FROM persons"
_add(
    "replace_faces",
    lambda c: mutate.replace_faces(c.faces.select("id", "photo_id", "person_id"), c.photo_attributes().filter("scene_type = 'food'").select((F.col("id") + 1_000_000_000).alias("id"), F.col("id").alias("photo_id"), F.lit(1).cast("long").alias("person_id"))),
    "SELECT id, photo_id, person_id FROM faces WHERE photo_id NOT IN (SELECT id FROM photos WHERE scene_type = 'food') UNION ALL SELECT id + 1000000000, id, 1 FROM photos WHERE scene_type = 'food'",
)
_add(
    "set_embedding",
    lambda c: mutate.set_column(c.vectors.select("id", "embedding"), "embedding", c.vectors.filter("label = 3").select("id", F.reverse("embedding").alias("value"))).select("id", F.element_at("embedding", 1).alias("first")),
    "SELECT id, CASE WHEN label = 3 THEN embedding[64] ELSE embedding[1] END AS first FROM vectors",
)
_add(
    "set_region_embedding",
    lambda c: mutate.set_column(c.faces.select("id", F.lit(None).cast("array<float>").alias("region_embedding")), "region_embedding", c.faces.filter("person_id is not null").select("id", F.array(F.col("confidence").cast("float")).alias("value"))).select("id", F.round(F.get("region_embedding", F.lit(0)).cast("double"), 3).alias("x")),
    "SELECT id, CASE WHEN person_id IS NOT NULL THEN round(confidence::FLOAT::DOUBLE, 3) END x FROM faces",
)
_add(
    "backfill_phash",
    lambda c: (lambda p: mutate.set_column(p, "phash", mutate.missing(p, "phash", videos=False).select("id", F.substring(F.md5("path"), 1, 16).alias("value"))).select("id", "phash"))(c.photo_attributes().withColumn("phash", F.when(F.col("id") % 4 == 0, "00"))),
    "SELECT id, CASE WHEN id % 4 = 0 THEN '00' WHEN NOT is_video THEN substr(md5(path), 1, 16) END phash FROM photos",
)
_add(
    "retag_scenes",
    lambda c: mutate.set_column(c.photo_attributes(), "scene_type", mutate.missing(c.photo_attributes(), "scene_type", recompute=True).filter("favorite").select("id", F.lit("plants").alias("value"))).select("id", "scene_type"),
    "SELECT id, CASE WHEN favorite THEN 'plants' ELSE scene_type END scene_type FROM photos",
)
_add("photos_with_open_faces", lambda c: mutate.with_faces(c.photo_attributes(), mutate.missing(c.faces, "crop_path")).select("id"), "SELECT id FROM photos WHERE id IN (SELECT photo_id FROM faces WHERE crop_path IS NULL)")
_add("recount", lambda c: mutate.recount(c.photo_attributes(), c.faces).select("id", "face_count", "named_face_count"), "SELECT p.id, CAST(count(f.id) AS INT) face_count, CAST(count(person_id) AS INT) named_face_count FROM photos p LEFT JOIN faces f ON f.photo_id = p.id GROUP BY p.id")
_add("meta_bump", lambda c: mutate.bump_meta(c.persons.select(F.col("name").alias("key"), F.col("id").alias("value")), "Supplier#000000005"), "SELECT name AS \"key\", id + CASE WHEN name = 'Supplier#000000005' THEN 1 ELSE 0 END AS value FROM persons")
_add("meta_get", lambda c: mutate.get_meta(c.persons.select(F.col("name").alias("key"), F.col("id").alias("value")), "Supplier#000000005"), "SELECT id AS value FROM persons WHERE name = 'Supplier#000000005'")
_add("negatives_added", lambda c: mutate.add_negatives(c.negatives, c.faces.filter("person_id is not null").select(F.col("id").alias("face_id"), "person_id")), "SELECT * FROM negatives UNION SELECT id, person_id FROM faces WHERE person_id IS NOT NULL")
_add("negatives_removed", lambda c: mutate.remove_negatives(c.negatives, c.negatives.filter("person_id < 5")), "SELECT * FROM negatives WHERE person_id >= 5")
_add("person_created", lambda c: mutate.create_person(c.persons, " Ada "), "SELECT id, name, cover_face_id FROM persons UNION ALL SELECT max(id) + 1, 'Ada', NULL FROM persons")
_add("person_found", lambda c: mutate.create_person(c.persons, "Supplier#000000005"), "SELECT id, name, cover_face_id FROM persons")
_add("person_renamed", lambda c: mutate.rename_person(c.persons, 5, "Ada"), "SELECT id, CASE WHEN id = 5 THEN 'Ada' ELSE name END AS name, cover_face_id FROM persons")
_add("person_deleted", lambda c: mutate.delete_person(c.persons, c.faces, 5)[1].select("id", "person_id"), "SELECT id, CASE WHEN person_id <> 5 THEN person_id END person_id FROM faces")
_add("face_unassigned", lambda c: mutate.unassign_face(c.faces, c.negatives, 449)[0].select("id", "person_id"), "SELECT id, CASE WHEN id <> 449 THEN person_id END person_id FROM faces")
_add("search_saved", lambda c: mutate.save_search(_searches(c), " Supplier#000000005 ", "q=new"), f"SELECT id, name, CASE WHEN id = 5 THEN 'q=new' ELSE query END AS query FROM ({_SEARCH})")
_add("search_created", lambda c: mutate.save_search(_searches(c), "sea", "q=sea"), f"{_SEARCH} UNION ALL SELECT max(id) + 1, 'sea', 'q=sea' FROM persons")
_add("search_deleted", lambda c: mutate.list_searches(mutate.delete_search(_searches(c), 5)), f"SELECT * FROM ({_SEARCH}) WHERE id <> 5")
_add(
    "orphan_crops",
    lambda c: mutate.orphans(c.photo_attributes().select(F.concat(F.lit("/crops/"), F.col("id").cast("string"), F.when(F.col("id") % 9 == 0, "/1.jpg.part").otherwise("/1.jpg")).alias("path")), c.photo_attributes().filter("not hidden").select("id", "sha1"), "/crops"),
    "SELECT '/crops/' || id || CASE WHEN id % 9 = 0 THEN '/1.jpg.part' ELSE '/1.jpg' END path FROM photos WHERE hidden OR id % 9 = 0",
)
_add(
    "prune_below",
    lambda c: mutate.pruned(c.photo_attributes(), c.photo_attributes().filter("favorite").select("path"), "/library/1995").select("id"),
    "SELECT id FROM photos WHERE favorite OR path NOT LIKE '/library/1995/%'",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered, sorted page of photos with people in them."""
    c = StarCatalog(spark, sf_dir)
    return browse.search(c.photos, c.faces, {"has_faces": True, "hidden": False}, count=False)[0]
