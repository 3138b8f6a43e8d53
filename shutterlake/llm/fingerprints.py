"""Document fingerprints from closed syncmers.

Of every 20 bytes of the UTF-8 text, the 20-mer is chosen if the least of its 8-mers (in a fixed
scrambled order) stands at its start or its end. The choice looks at the 20 bytes alone, so a
passage brings the same anchors into every text that holds it, whatever stands around it. A
fingerprint is the 64 least of the distinct hashes of the chosen 20-mers, 32 bits each, in hex;
the likeness of two fingerprints is the share of the union's least that both hold.

Neighbours: documents are dealt into ranges of doc_id with bounds from an approximate quantile of
the ids; the rows that begin a range are sent once more, as what follows the range before it. So
every range finds its neighbours itself, in one shuffle of the text and a stream through each task.

Edge cases: null text is empty; a text of under 20 bytes, or without a syncmer, is its own anchor;
the empty text has the empty fingerprint, like 1 to another empty one and 0 to any other; rows of
one doc_id stand in the order of a hash of their text; a null doc_id comes first; the last
document's neighbour is the first (its own, if it is alone); columns besides doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from .common import table
from .ranks import doubled, pair, sliding_min

K, S, KEPT = 20, 8, 64
#: Rows of a range, and the most ranges, whose bounds are held as literals.
RANGE_ROWS, MOST_RANGES, FAN = 64, 65_536, 256


def syncmers(text: bytes) -> np.ndarray:
    """Hashes of the closed syncmers of the text, in order of place."""
    n = len(text)
    if n >= K:
        names = doubled(np.frombuffer(text, np.uint8), (S, 16))
        inner = names[S]
        least = sliding_min(inner, K - S + 1)
        at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[K - S :]))
        if len(at):
            long = names[16]
            return pair(long[at], long[at + K - 16])
    return np.array([xxhash.xxh3_64_intdigest(text)] if n else [], np.uint64)


def fingerprint(text: bytes, kept: int = KEPT) -> np.ndarray:
    """The least distinct hashes, 32 bits each, ascending."""
    h = np.unique((syncmers(text) >> np.uint64(32)).astype(">u4"))
    return h[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated share of common anchors, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    u = np.union1d(a, b)
    if max(len(a), len(b)) >= kept:
        u = u[:kept]
    return float(np.isin(u, a, assume_unique=True) @ np.isin(u, b, assume_unique=True).astype(int)) / len(u)


def edited(text: str, follower: str) -> str:
    """The last quarter of the text's code points replaced by the first as many of the follower's."""
    n = len(text)
    return text[: n - n // 4] + follower[: n // 4]


def _range_of(bounds: list[float], fan: int = FAN) -> Column:
    """How many bounds are at most doc_id (0 for null), by two short look-ups."""
    d = F.col("doc_id").cast("double")
    if not bounds:
        return F.lit(0)
    lists = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    values = lambda xs: F.split(F.lit(",".join(map(repr, xs))), ",").cast("array<double>")
    above = F.size(F.filter(values([x[0] for x in lists]), lambda x: x <= d))
    fine = F.split(F.element_at(F.split(F.lit(";".join(",".join(map(repr, x)) for x in lists)), ";"), F.greatest(above, F.lit(1))), ",").cast("array<double>")
    if len(lists) == 1:
        return F.when(d.isNull(), 0).otherwise(F.size(F.filter(values(bounds), lambda x: x <= d)))
    return F.when(d.isNull() | (above == 0), 0).otherwise((above - 1) * fan + F.size(F.filter(fine, lambda x: x <= d)))


def fingerprints(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """One row for each document: its fingerprint, that of its edited text, and their likeness."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType
    rows = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = int(min(MOST_RANGES, max(1, rows // RANGE_ROWS)))
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    at = _range_of(bounds)
    first = {r["r"]: r["d"] for r in docs.select("doc_id").groupBy(at.alias("r")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("s"), F.col("doc_id").alias("d"))).alias("m")).select("r", "m.d").collect()}  # one entry for each range
    order = sorted(first)
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), at.alias("r"))
    if order:
        # a range's first rows also follow the last row of the range before
        before = dict(zip(order, order[-1:] + order[:-1], strict=True))
        held = lambda f, to: F.element_at(F.split(F.lit(",".join(str(f(r)) for r in range(order[-1] + 1))), ",").cast(f"array<{to}>"), F.col("r") + 1)
        begins = F.when(F.col("doc_id").isNull(), F.lit(before[order[0]])).when((F.col("doc_id") == held(lambda r: first.get(r) or 0, kind.simpleString())) & (F.lit(True) if first[order[0]] is not None else F.col("r") > order[0]), held(lambda r: before.get(r, 0), "int"))
        own = F.struct(F.col("r").alias("r"), F.lit(0).alias("ahead"))
        both = F.when(begins.isNull(), F.array(own)).otherwise(F.array(own, F.struct(begins.alias("r"), F.lit(1).alias("ahead"))))
        dealt = dealt.select("doc_id", "text", "h", F.inline(both))
    else:
        dealt = dealt.withColumn("ahead", F.lit(0))
    dealt = dealt.repartition("r").sortWithinPartitions("r", "ahead", F.asc_nulls_first("doc_id"), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # range, doc_id, text, fingerprint
        for b in batches:
            out: list[tuple] = []
            for d, t, r, ahead in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "r", "ahead")), strict=True):
                t = t or ""
                if ahead and (last is None or last[0] != r):
                    continue  # not the first of those that follow
                f = fingerprint(t.encode(), kept)
                if last is not None and last[0] == r:
                    _, d0, t0, f0 = last
                    e = edited(t0, t).encode()
                    g = fingerprint(e, kept)
                    out.append((d0, len(t0), hashlib.sha256(e).hexdigest(), f0.tobytes().hex(), g.tobytes().hex(), likeness(f0, g, kept), likeness(f0, f, kept)))
                last = None if ahead else (r, d, t, f)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (ids, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)

    ids = to_arrow_type(kind)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return dealt.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
