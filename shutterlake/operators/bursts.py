"""Bursts: near-identical photos taken within seconds of each other.

Two photos link if their times are within the gap and their hashes differ in few bits; a burst is a
connected component. Pairs come from an equi-join on time slots of the gap's length, each photo
looking into its own slot and the next, so no range join or nested loop is planned. Bursts need no
pairs of equal photos: those of one slot and hash are one class, all linked, and classes are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.media import phash_bits
from ..plans.graph import components
from .timeline import moment


def linked(photos: DataFrame, max_distance: int = 10, gap_s: float = 10.0) -> DataFrame:
    """Pairs (a > b) of visible photos with hash and time that belong together."""
    p = photos.filter("not hidden and phash is not null and taken_at is not null").select("id", moment(F.col("taken_at")).alias("t"), phash_bits(F.col("phash")).alias("h")).filter("t is not null")
    p = p.withColumn("slot", F.floor(F.col("t") / gap_s) if gap_s else F.col("t"))
    x = p.select(F.col("id").alias("x"), F.col("t").alias("tx"), F.col("h").alias("hx"), F.explode(F.array(F.col("slot"), F.col("slot") + 1) if gap_s else F.array("slot")).alias("slot"), F.col("slot").alias("own"))
    pairs = x.join(p, "slot").filter((F.abs(F.col("tx") - F.col("t")) <= gap_s) & (F.bit_count(F.col("hx").bitwiseXOR(F.col("h"))) <= max_distance))
    # within a slot each pair is met twice, across slots once
    pairs = pairs.filter((F.col("own") != F.col("slot")) | (F.col("x") > F.col("id")))
    return pairs.select(F.greatest("x", "id").alias("a"), F.least("x", "id").alias("b")).filter("a <> b")


def chained(photos: DataFrame, max_distance: int = 10, gap_s: float = 10.0) -> DataFrame:
    """Links (a, b) with the components of `linked`, but one a photo and one a pair of classes.

    Photos of one slot and hash are linked with each other, as a slot is no longer than the gap, so a
    class is its least id, hash, first and last time. Classes of one slot are linked by their hashes
    alone; of a slot and the next, if also the former's last time and the latter's first are close.
    """
    p = photos.filter("not hidden and phash is not null and taken_at is not null").select("id", moment(F.col("taken_at")).alias("t"), phash_bits(F.col("phash")).alias("h")).filter("t is not null")
    p = p.withColumn("slot", F.floor(F.col("t") / gap_s) if gap_s else F.col("t"))
    classes = p.groupBy("slot", "h").agg(F.min("id").alias("head"), F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    members = p.join(classes.filter("n > 1").select("slot", "h", "head"), ["slot", "h"]).filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    x = classes.select(F.col("head").alias("a"), F.col("h").alias("hx"), F.col("last").alias("end"), F.explode(F.array(F.col("slot"), F.col("slot") + 1) if gap_s else F.array("slot")).alias("slot"), F.col("slot").alias("own"))
    near = F.bit_count(F.col("hx").bitwiseXOR(F.col("h"))) <= max_distance
    close = F.when(F.col("own") == F.col("slot"), F.col("a") > F.col("head")).otherwise(F.col("first") - F.col("end") <= gap_s)
    return members.unionByName(x.join(classes, "slot").filter(near & close).select("a", F.col("head").alias("b")))


def bursts(photos: DataFrame, max_distance: int = 10, gap_s: float = 10.0, min_group: int = 2) -> DataFrame:
    """id, burst (its least id), position (1 is the cover: favourite, most pixels, least id), size."""
    groups = components(chained(photos, max_distance, gap_s))
    p = photos.select("id", "favorite", (F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))).alias("pixels"))
    members = groups.join(p, F.col("node") == F.col("id"))
    w = Window.partitionBy("component")
    out = members.select("id", F.col("component").alias("burst"), F.row_number().over(w.orderBy(F.desc("favorite"), F.desc("pixels"), "id")).cast("long").alias("position"), F.count(F.lit(1)).over(w).alias("size"))
    return out.filter(F.col("size") >= min_group)


def redundant(found: DataFrame) -> DataFrame:
    """How many bursts there are, and how many photos beyond one of each."""
    return found.agg(F.count_distinct("burst").alias("groups"), F.count_if(F.col("position") > 1).alias("redundant"))
