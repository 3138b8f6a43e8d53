"""The engine: one object over a catalog, with the calls an application makes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from urllib.parse import parse_qs, urlencode

from .catalog import Catalog
from .functions import planner
from .operators import browse, bursts, facets, people, ranking, stats, timeline
from .operators.predicates import select, union, validate
from .schema import Settings


@dataclass
class Answer:
    """A page of rows, how many there are in all (-1 if not counted), what was asked, and whether regions ranked them."""

    rows: DataFrame
    total: int
    question: planner.Question = planner.Question()
    grounded: bool = False


@dataclass
class Engine:
    """Queries over a catalog. `encode` turns a text into a vector; without it texts can't be ranked.

    Browsing leaves hidden photos out unless asked for them, as the public surface does.
    """

    catalog: Catalog
    vectors: DataFrame | None = None
    regions: DataFrame | None = None
    encode: Callable[[str], Sequence[float]] | None = None
    settings: Settings = field(default_factory=Settings)

    def _f(self, filters: Mapping[str, Any]) -> dict[str, Any]:
        validate(filters)
        return {"hidden": False} | dict(filters)

    def photos(self, filters: Mapping[str, Any], limit: int = 60, offset: int = 0) -> tuple[DataFrame, int]:
        """A page; the total is counted for the first page only."""
        validate(filters, limit, offset)
        return browse.search(self.catalog.photos, self.catalog.faces, self._f(filters), limit, offset, count=offset == 0)

    def asked(self, text: str, filters: Mapping[str, Any] | None = None) -> tuple[planner.Question, dict[str, Any]]:
        """What a text asks for, and the filters that it and those given come to: both one's persons and buckets, the given mode first."""
        named = [r.asDict() for r in self.catalog.persons.select("id", "name").collect()]  # names of persons, a small table
        q, f = planner.Reader(named).read(text.strip()), dict(filters or {})
        for key, found in (("person_id", q.ids), ("people", list(q.company))):
            if found:
                f[key] = union(f.get(key), found)
        if q.mode and not f.get("person_mode"):
            f["person_mode"] = q.mode
        return q, self._f(f)

    def ask(self, text: str, filters: Mapping[str, Any] | None = None, limit: int = 60, offset: int = 0) -> Answer:
        """A page of photos for a natural-language query, and how many there are (at most top_k if they are ranked).

        What is left of the text besides persons and head counts is ranked: by regions of the named
        persons if they have any, else by whole images.
        """
        validate(filters or {}, limit, offset)
        q, f = self.asked(text, filters)
        if not q.rest:
            page, total = browse.search(self.catalog.photos, self.catalog.faces, f, limit, offset, count=offset == 0)
            return Answer(page, total, q, False)
        k, hits = self.settings.semantic_top_k, select(self.catalog.photos, self.catalog.faces, f)
        grounded = bool(q.ids) and self.regions is not None and not self.regions.filter(F.col("label").isin(q.ids)).isEmpty()
        if self.vectors is None and not grounded:
            raise LookupError("no vectors")
        if self.encode is None:
            raise NotImplementedError("no text encoder")
        vector = self.encode(q.rest)
        ranked = ranking.grounded_search(self.regions, vector, q.ids, hits, k) if grounded else ranking.semantic_search(hits, self.vectors, vector, k)
        return Answer(*browse.ranked_page(self.catalog.photos, ranked, limit, offset), q, grounded)

    def similar_photos(self, photo_id: int, limit: int = 60, offset: int = 0) -> Answer:
        """The photos whose image is most like a photo's."""
        validate({}, limit, offset)
        if self.vectors is None:
            raise LookupError("no vectors")
        return Answer(*browse.ranked_page(self.catalog.photos, ranking.similar(self.vectors, photo_id, self.settings.semantic_top_k), limit, offset))

    def similar_faces(self, face_id: int, limit: int = 60, offset: int = 0) -> Answer:
        """The other photos that have a face most like a face."""
        validate({}, limit, offset)
        return Answer(*browse.ranked_page(self.catalog.photos, ranking.similar_faces(self.catalog.faces, face_id, self.settings.semantic_top_k), limit, offset))

    def photo(self, photo_id: int) -> DataFrame:
        return browse.detail(self.catalog.photos, self.catalog.faces, self.catalog.persons, photo_id)

    def map(self, filters: Mapping[str, Any]) -> DataFrame:
        return browse.map_points(self.catalog.photos, self.catalog.faces, self._f(filters), self.settings.map_points)

    def clusters(self, limit: int = 50) -> DataFrame:
        return people.list_clusters(self.catalog.faces, limit)

    def review(self, limit: int = 60) -> DataFrame:
        return people.review_queue(self.catalog.faces, self.catalog.persons, self.settings.review_confidence, limit)

    def faces_of(self, person_id: int, limit: int = 200) -> DataFrame:
        return people.person_faces(self.catalog.faces, person_id, limit)

    def stats(self) -> DataFrame:
        return stats.library_stats(self.catalog.photos, self.catalog.faces, self.catalog.persons)

    def facets(self, filters: Mapping[str, Any]) -> dict[str, DataFrame]:
        c, f = self.catalog, self._f(filters)
        return {
            "values": facets.facets_fused(c.photos, c.faces, f),
            "persons": facets.persons_facet(c.photos, c.faces, c.persons, f),
            "flags": facets.flags(c.photos, c.faces, f),
            "dates": facets.date_bounds(c.photos, c.faces, f),
        }

    def trips(self) -> DataFrame:
        s = self.settings
        return timeline.trips(self.catalog.photos, [], s.trip_gap_days, s.trip_gap_km, s.trip_min, s.trip_sample).orderBy(F.desc("end"), F.desc("start"))

    def duplicates(self) -> DataFrame:
        s = self.settings
        return bursts.bursts(self.catalog.photos, s.burst_distance, s.burst_gap_s, s.burst_min)

    def memories(self, month: int, day: int) -> DataFrame:
        validate({}, month=month, day=day)
        return timeline.on_this_day(self.catalog.photos, month, day, self.settings.per_year).orderBy(F.desc("year"))

    def persons(self) -> DataFrame:
        return people.by_name(people.list_persons(self.catalog.persons, self.catalog.faces))


_LISTS = ("person_id", "scene", "country", "city", "place", "year", "camera", "people", "known", "kind")


def to_querystring(filters: Mapping[str, Any]) -> str:
    """Filters as a saved search keeps them; lists repeat their key."""
    return urlencode([(k, x) for k, v in sorted(filters.items()) for x in (v if isinstance(v, (list, tuple)) else [v]) if x not in (None, "")])


def from_querystring(query: str) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in parse_qs(query).items():
        vals: list[Any] = [int(x) for x in v] if k == "person_id" else v
        out[k] = vals if k in _LISTS else vals[0] in ("1", "true", "True") if k in ("has_faces", "favorite", "hidden") else vals[0]
    return out
