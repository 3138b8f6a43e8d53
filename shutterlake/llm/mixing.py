"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: the sources, in order of code point (null last), weigh 5, 2, 1 and so on again, and share
150% of all words by weight; a source whose share is over twice its words gets that, and what is
over is shared again among the rest, until none is above.

Schedule: each source's documents, shuffled by a hash of their id, are one stream of words cut into
blocks of equal length. A source needs a known number of draws of a block to reach its target. The
van der Corput points (the bit-reversed slot number) are mapped through the cumulative numbers of
draws, so any stretch of slots holds the sources near their weights, and all slots hold exactly the
draws needed. How many earlier slots went to the same source - the slot's rank - follows from the
digits of the slot number in closed form, so slots need no shuffle. Rank r draws block r modulo the
source's blocks; the last draw is cut where the target is reached. Slots then join the blocks.

Edge cases: null text has size 0 and is never taken; a null source is a source, the last; repeated
rows are documents of their own, next to each other in the stream (equal ids of unequal size in the
order of size); a null id counts as a text 'null' in the shuffle; with no words at all every target
and every taken is 0; an empty table gives an empty result. Columns besides doc_id, text and source
are not read. Sources are held on the driver; more than ``MOST_SOURCES`` raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_batch, table

WEIGHTS, SHARE, MOST_TIMES = (5, 2, 1), 1.5, 2
#: The most words of a block, and the draws a mix of few words is parted into at least.
BLOCK_WORDS, LEAST_DRAWS = 2048, 1 << 16
MOST_SOURCES = 100_000
#: Parts of a source's stream whose offsets are summed apart.
PARTS_HEX = 3


@dataclass(frozen=True)
class Plan:
    """The mix of all sources, by their number: what each has, gets, and when its slots come."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    words: list[int]
    block: int
    blocks: list[int]
    draws: list[int]
    bits: int


def share_out(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> list[float]:
    """Targets of the sources: share of all, by weight, none above most times its size."""
    n, want = len(sizes), share * sum(sizes)
    weigh = [weights[i % len(weights)] for i in range(n)]
    order = sorted(range(n), key=lambda i: (most * sizes[i] / weigh[i], i))
    left_weight, got, out = sum(weigh), 0, [0.0] * n
    for k, i in enumerate(order):
        rate = (want - got) / left_weight
        if most * sizes[i] >= rate * weigh[i]:  # so have all that follow
            for j in order[k:]:
                out[j] = rate * weigh[j]
            break
        out[i] = float(most * sizes[i])
        got += most * sizes[i]
        left_weight -= weigh[i]
    return out


def plan_mix(totals: list[tuple[str | None, int]]) -> Plan:
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    targets = share_out(sizes)
    words = [min(MOST_TIMES * n, int(t + 0.5)) for n, t in zip(sizes, targets, strict=True)]
    block = max(1, min(BLOCK_WORDS, sum(words) // LEAST_DRAWS))
    blocks = [-(-n // block) for n in sizes]
    draws = [w // n * b + -(-(w % n) // block) if n else 0 for n, w, b in zip(sizes, words, blocks, strict=True)]
    return Plan([s for s, _ in totals], sizes, targets, words, block, blocks, draws, max(1, (max(1, sum(draws)) - 1).bit_length()))


def reversed_bits(t: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(t)
    for i in range(bits):
        out |= ((t >> i) & 1) << (bits - 1 - i)
    return out


def earlier(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    """How many slots before t have their reversed number in [lo, hi).

    The slots before t part into runs of 2**q, one for each digit 1 of t; the reversed numbers of
    such a run are a residue and all that follow it at steps of 2**(bits-q).
    """
    n = np.zeros_like(t)
    for q in range(bits):
        on = (t >> q) & 1
        residue = reversed_bits((t >> (q + 1)) << (q + 1), bits)  # the run's first slot
        step = np.int64(1) << np.int64(bits - q)
        upto = lambda x: np.maximum(0, (x - residue + step - 1) // step)  # noqa: B023, E731
        n += on * (upto(hi) - upto(lo))
    return n


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """slot, source_no, rank, block, epoch, words: one row for each draw."""
    ends = np.cumsum(np.array(plan.draws, np.int64))
    blocks, size, want = (np.array(x, np.int64) for x in (plan.blocks, plan.sizes, plan.words))
    bits, length = plan.bits, plan.block

    def draw(batch: pa.RecordBatch):
        t = batch.column(0).to_numpy().astype(np.int64)
        point = reversed_bits(t, bits)
        src = np.searchsorted(ends, point, "right")
        t, src = t[src < len(ends)], src[src < len(ends)]
        hi = ends[src]
        rank = earlier(t, np.concatenate([[0], ends])[src], hi, bits)
        epoch, block = rank // blocks[src], rank % blocks[src]
        left = want[src] - epoch * size[src] - block * length
        words = np.minimum(np.minimum(length, size[src] - block * length), left)
        yield {"slot": t, "source_no": src.astype(np.int32), "rank": rank, "block": block, "epoch": epoch, "words": words}

    return by_batch("slot long, source_no int, rank long, block long, epoch long, words long", draw)(spark.range(1 << bits))


def _number(plan: Plan, spark: SparkSession) -> DataFrame:
    rows = [(i, s, n, t) for i, (s, n, t) in enumerate(zip(plan.sources, plan.sizes, plan.targets, strict=True))]
    return spark.createDataFrame(rows, "source_no int, named string, source_size long, target double")


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, Plan]:
    """(one row for each document, the schedule, the plan).

    The documents' columns: doc_id, source, size, source_size, target, taken, first_slot (when its
    first words are drawn; null if none are).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = scratch.save(docs.select("doc_id", F.col("source").cast("string").alias("source"), words_of(F.col("text").cast("string")).alias("size")), "sized")
    totals = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()]
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan = plan_mix(totals)
    number = _number(plan, spark)  # at most MOST_SOURCES rows
    rows = sized.join(F.broadcast(number), sized["source"].eqNullSafe(number["named"])).drop("named")
    rows = rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")))
    rows = rows.withColumn("part", F.substring("order", 1, PARTS_HEX))
    parts = rows.groupBy("source_no", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source_no").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "part").orderBy("order", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(parts, (rows["source_no"] == parts["s"]) & (rows["part"] == parts["p"]))
    rows = rows.select("doc_id", "source", "size", "source_no", "source_size", "target", (F.col("at") + F.col("base")).alias("at"))
    b = plan.block
    pieces = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.greatest(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b)))))
    start = F.greatest(F.col("at") - F.col("block") * b, F.lit(0))
    end = F.least(F.col("at") + F.col("size") - F.col("block") * b, F.lit(b))
    pieces = pieces.select("*", start.alias("x"), end.alias("y"))
    drawn = slots(spark, plan)
    d = drawn.select(F.col("source_no").alias("s"), F.col("block").alias("k"), F.col("words").alias("w"), "slot")
    got = F.when(F.col("w").isNotNull(), F.greatest(F.lit(0), F.least("y", "w") - F.col("x")))  # least() passes over null
    joined = pieces.join(d, (pieces["source_no"] == d["s"]) & (pieces["block"] == d["k"]), "left").withColumn("got", F.coalesce(got, F.lit(0)))
    keys = ["doc_id", "source", "size", "source_size", "target", "source_no", "at"]
    some = joined.filter(F.col("size") > 0).groupBy(*keys).agg(F.sum("got").alias("taken"), F.min(F.when(F.col("got") > 0, F.col("slot"))).alias("first_slot"))
    none = rows.filter(F.col("size") == 0).select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return some.unionByName(none).drop("source_no", "at"), drawn, plan


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size FROM documents),
s AS (SELECT source, sum(size) n, row_number() OVER (ORDER BY source NULLS LAST) - 1 i FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST(i % 3 AS INT) + 1] wt FROM s),
o AS (SELECT *, sum(wt) OVER () - coalesce(sum(wt) OVER b, 0) lw, coalesce(sum(2 * n) OVER b, 0) got, 1.5::DOUBLE * sum(n) OVER () want,
             row_number() OVER (ORDER BY 2 * n / wt::DOUBLE, i) k FROM w
      WINDOW b AS (ORDER BY 2 * n / wt::DOUBLE, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, (want - got::DOUBLE) / lw::DOUBLE rate FROM o),
f AS (SELECT min(k) k FROM r WHERE 2 * n >= rate * wt),
fr AS (SELECT rate FROM r, f WHERE r.k = f.k),
t AS (SELECT source, CAST(n AS BIGINT) n, CASE WHEN r.k >= f.k THEN fr.rate * wt ELSE CAST(2 * n AS DOUBLE) END target FROM r, f, fr),
p AS (SELECT d.doc_id, d.size, t.n source_size, t.target, least(2 * t.n, CAST(floor(t.target + 0.5) AS BIGINT)) words,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (words // source_size) + greatest(0, least(start + size, words % source_size) - start) END AS BIGINT) taken
FROM p
"""
