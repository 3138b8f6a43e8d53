"""Exact vector ranking: whole images, regions of persons, faces, and zero-shot labels.

Scores are computed inside the JVM row by row against a constant query vector; the top k come from
bounded heaps in each task. Nothing is collected and no index has to fit anywhere. Ties go to the
least id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot, doubles, let, literal, norm, normalize


def _unit(query: Sequence[float] | Column) -> Column:
    return normalize(query if isinstance(query, Column) else literal(query))


def score(embedding: Column, query: Sequence[float] | Column) -> Column:
    """Cosine of two vectors: dot / lengths, so neither is copied."""
    q, v = _unit(query), doubles(embedding)
    n = norm(v)
    return dot(v, q) / F.when(n <= 1e-8, 1.0).otherwise(n)


def ranked(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best rows by score (rounded, so that ties are ties), with their rank."""
    scored = scored.withColumn("score", F.round("score", digits))
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))  # over k rows


def top_k(vectors: DataFrame, query: Sequence[float] | Column, k: int = 200) -> DataFrame:
    """id, score, rank of the k vectors closest to the query."""
    return ranked(vectors.filter("embedding is not null").select("id", score(F.col("embedding"), query).alias("score")), k)


def semantic_search(matches: DataFrame, vectors: DataFrame, query: Sequence[float] | Column, k: int = 200) -> DataFrame:
    """top_k among the photos that filters left (id); vectors has photo id and embedding."""
    return top_k(vectors.join(matches.select("id"), "id", "left_semi"), query, k)


def vector_of(vectors: DataFrame, an_id: int) -> list[float] | None:
    r = vectors.filter((F.col("id") == an_id) & F.col("embedding").isNotNull()).select("embedding").limit(1).collect()
    return [float(x) for x in r[0][0]] if r else None


def similar(vectors: DataFrame, an_id: int, k: int = 200) -> DataFrame:
    """The vectors closest to a given one, itself left out; nothing if it has no vector."""
    q = vector_of(vectors, an_id)
    rest = vectors.filter(F.col("id") != an_id)
    return top_k(rest if q else rest.filter(F.lit(False)), q or [0.0], k)


def best_by_photo(scored: DataFrame, k: int) -> DataFrame:
    """Per photo its best region: photo id, score, face_id (the least of equals)."""
    s = scored.withColumn("score", F.round("score", 6))
    best = s.groupBy("photo_id").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("b"))
    out = best.select(F.col("photo_id").alias("id"), "b.score", (-F.col("b.m")).alias("face_id"))
    top = out.orderBy(F.desc("score"), "face_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "face_id")).cast("long"))  # over k rows


def grounded_search(regions: DataFrame, query: Sequence[float] | Column, persons: Sequence[int], matches: DataFrame | None = None, k: int = 200) -> DataFrame:
    """Photos by the best score of the regions of the given persons (label) in them."""
    r = regions.filter(F.col("label").isin(list(persons)) & F.col("embedding").isNotNull())
    if matches is not None:
        r = r.join(matches.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    return best_by_photo(r.select("id", "photo_id", score(F.col("embedding"), query).alias("score")), k)


def similar_faces(faces: DataFrame, face_id: int, k: int = 200) -> DataFrame:
    """Other photos by the best of their faces; the source's own photo is left out."""
    src = faces.filter(F.col("id") == face_id).select("photo_id", "embedding").limit(1).collect()
    q = [float(x) for x in src[0]["embedding"]] if src and src[0]["embedding"] else None
    rest = faces.filter((F.col("photo_id") != src[0]["photo_id"]) & F.col("embedding").isNotNull()) if q else faces.filter(F.lit(False))
    return best_by_photo(rest.select("id", "photo_id", score(F.col("embedding"), q or [0.0]).alias("score")), k)


def zero_shot(embedding: Column, face_count: Column, labels: Sequence[str], prototypes: Sequence[Sequence[float]], temperature: float = 50.0, other_bias: float = -0.02, face_bonus: float = 0.04) -> Column:
    """struct(label, scores): softmax over prototypes and a constant for 'other'; the first of equals.

    'people' gets a bonus if the photo has a face. A vector of another length than the prototypes
    gives null.
    """
    names = F.array(*[F.lit(x) for x in (*labels, "other")])

    def logits(unit: Column) -> Column:
        sims = [dot(unit, normalize(literal(p))) + (F.when(face_count >= 1, face_bonus).otherwise(0.0) if lab == "people" else F.lit(0.0)) for lab, p in zip(labels, prototypes, strict=True)]
        return F.array(*[s * temperature for s in sims], F.lit(other_bias * temperature))

    def decide(lg: Column) -> Column:
        exps = let(F.array_max(lg), lambda top: F.transform(lg, lambda x: F.exp(x - top)))
        scores = let(exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: F.round(x / total, 6))))
        return F.struct(F.element_at(names, F.array_position(lg, F.array_max(lg)).cast("int")).alias("label"), F.map_from_arrays(names, scores).alias("scores"))

    return F.when(F.size(embedding) == len(prototypes[0]), let(normalize(doubles(embedding)), lambda u: let(logits(u), decide)))


def prototypes(prompts: DataFrame) -> DataFrame:
    """label and the unit mean of its unit prompt vectors (label, embedding)."""
    unit = prompts.select("label", F.posexplode(normalize(doubles(F.col("embedding")))).alias("i", "x"))
    mean = unit.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    return mean.select("label", normalize(F.col("v")).alias("embedding"))
