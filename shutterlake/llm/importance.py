"""Quality by importance resampling of hashed n-gram models.

Two generative models are fitted on hashed n-grams: one on labelled target texts, one on all raw
texts. N-grams are single words (lower-cased) and pairs of neighbouring word shapes, where a shape
is the word's classes of character with runs collapsed ("Aa", "a.", "A!", "|"), and a pair of equal
words is a pair of its own. A text's log importance weight is the sum over its n-grams of
log(target probability / raw probability). Documents are resampled without replacement in
proportion to their weights by Gumbel top-k: each log weight gets Gumbel noise drawn from a hash of
the document, and the k greatest are kept.

k is the number of documents that the models take for target texts: those whose log weight is over
the limit that parts the labelled target texts from the other labelled ones best.

Toxic texts are judged on their own and never drawn: a few strong words in hundreds say it, which
the sum over all n-grams buries. A text's toxicity is the sum of its ``STRONGEST`` words' log
(share of toxic labelled texts that have the word / share of the others), words that no toxic
labelled text has saying nothing, and the limit parts labelled toxic texts from labelled target ones.

A text that the target model was fitted on is weighed without its own share in it.

Bounds: the models are fitted on at most ``MOST_LABELLED`` labelled documents, the least by a hash
of their id; the raw counts, the weights and the selection cover all documents. The models have
``WORD_BUCKETS`` + ``SHAPE_BUCKETS`` entries whatever the data. The k-th greatest score is found by
counts over ever finer ranges of the scores, so no score is gathered or sorted on the driver.

Edge cases: null texts and texts without words have a log weight of 0 and are rejected; repeated rows have equal scores and are kept or rejected together, as are all documents
that tie with the k-th; a null doc_id has no label; an empty table gives an empty result; without
labelled target texts nothing is known and every document with a word is kept. Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_batch, table, texts
from .ranks import scramble

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 17, 1 << 12
MOST_LABELLED = 20_000
SMOOTH = 8.0
#: The words that a text's toxicity is summed over, and how many texts their shares are drawn to one half by.
STRONGEST, DRAWN = 5, 2.0
_KEPT = 250_000
#: Classes of bytes for shapes: letters by case, digits, other scripts as small letters, the rest as they are.
_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def shape(word: bytes) -> bytes:
    """Classes of the word's bytes, runs collapsed."""
    c = word.translate(_CLASS)
    return bytes(b for i, b in enumerate(c) if not i or b != c[i - 1])


class _Codes(dict):
    """word -> 32 bits of its identity, then 32 of its shape's."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT:
            self.clear()
        c = self[word] = xxhash.xxh32_intdigest(word.lower()) << 32 | xxhash.xxh32_intdigest(shape(word))
        return c


_codes = _Codes()


def ngrams(text: bytes) -> np.ndarray:
    """The buckets of the text's n-grams: words first, then pairs of shapes."""
    w = text.split()
    c = np.fromiter(map(_codes.__getitem__, w), np.uint64, len(w))
    words = (c >> np.uint64(32)) % np.uint64(WORD_BUCKETS)
    s = c & np.uint64(0xFFFFFFFF)
    same = (c[1:] == c[:-1]).astype(np.uint64)
    pairs = scramble((s[:-1] << np.uint64(32)) + s[1:] + same * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SHAPE_BUCKETS)
    return np.concatenate([words, pairs + np.uint64(WORD_BUCKETS)]).astype(np.int64)


PARTS = (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, None))


class Model:
    """Counts of target and raw n-grams, and log(target probability / raw probability) of each bucket.

    Words and pairs are a model each. A bucket's share of target n-grams is drawn towards the overall
    share by SMOOTH n-grams, so rare n-grams say little.
    """

    def __init__(self, target: np.ndarray, raw: np.ndarray):
        self.target, self.raw, self.known = target, raw, bool(target.any())
        self.share = np.zeros(len(raw))
        for part in PARTS:
            self.share[part] = max(target[part].sum(), 1) / max(raw[part].sum(), 1)
        self.ratio = self._ratio(target, raw, self.share)

    @staticmethod
    def _ratio(target: np.ndarray, raw: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.log((target + SMOOTH * share) / (raw + SMOOTH) / share)

    def weight(self, grams: np.ndarray, fitted: bool) -> float:
        """Log importance weight of a text. One that the target model was fitted on is judged without its own counts."""
        if not self.known or not len(grams):
            return 0.0
        if not fitted:
            return float(self.ratio[grams].sum())
        at, n = np.unique(grams, return_counts=True)
        return float(self._ratio(np.maximum(self.target[at] - n, 0), self.raw[at], self.share[at]) @ n)


class Toxicity:
    """Which words tell toxic labelled texts from the others, by the number of texts that have them."""

    def __init__(self, toxic: np.ndarray, rest: np.ndarray, n_toxic: int, n_rest: int):
        self.counts, self.sizes, self.known = (toxic, rest), (n_toxic, n_rest), n_toxic > 0 and n_rest > 0

    def of(self, grams: np.ndarray, is_toxic: bool | None) -> float:
        """Toxicity of a text; one with a label (is_toxic) is judged without its own share."""
        at = np.unique(grams[grams < WORD_BUCKETS])
        if not self.known or not len(at):
            return 0.0
        own = (is_toxic is True, is_toxic is False)
        has = [np.maximum(c[at] - o, 0) for c, o in zip(self.counts, own, strict=True)]
        share = [(h + DRAWN) / (n - o + 2 * DRAWN) for h, n, o in zip(has, self.sizes, own, strict=True)]
        said = np.where(has[0] > 0, np.log(share[0] / share[1]), 0.0)
        return float(np.sort(said)[-STRONGEST:].sum())


def _among(ids: pa.Array, some: np.ndarray) -> np.ndarray:
    ids = ids.cast(pa.int64())
    return np.isin(ids.fill_null(0).to_numpy(), some) & ids.is_valid().to_numpy(zero_copy_only=False)


def _count(target_ids: np.ndarray, toxic_ids: np.ndarray, rest_ids: np.ndarray):
    """Counts of n-grams; and of toxic and other labelled texts by word, in the last bucket of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = WORD_BUCKETS + SHAPE_BUCKETS + 1
        raw, target, toxic, rest = (np.zeros(n, np.int64) for _ in range(4))
        for b in batches:
            mine = _among(b.column("doc_id"), target_ids)
            grams = [ngrams(t) for t in texts(b)]
            raw += np.bincount(np.concatenate(grams), minlength=n)
            if good := [g for g, m in zip(grams, mine.tolist(), strict=True) if m]:
                target += np.bincount(np.concatenate(good), minlength=n)
            for ids, has in ((toxic_ids, toxic), (rest_ids, rest)):
                for i in np.flatnonzero(_among(b.column("doc_id"), ids)).tolist():
                    has[np.unique(grams[i][grams[i] < WORD_BUCKETS])] += 1
                    has[-1] += 1
        at = np.flatnonzero(raw + toxic + rest)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32))} | {c: pa.array(x[at]) for c, x in (("raw", raw), ("target", target), ("toxic", toxic), ("rest", rest))})

    return run


def sortable(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles."""
    i = np.asarray(x, np.float64).view(np.int64)
    return i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def kth_greatest(df: DataFrame, name: str, k: int) -> int | None:
    """The k-th greatest value of a long column, by counts over 2**16 ranges, four times finer each time."""
    if k < 1:
        return None
    prefix, low = F.lit(True), -(1 << 63)
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(name, shift) if shift else F.col(name)
        counts = df.filter(prefix).groupBy(digit.alias("d")).count().orderBy(F.desc("d")).collect()  # at most 2**16 rows
        for r in counts:
            if r["count"] >= k:
                break
            k -= r["count"]
        prefix, low = digit == r["d"], r["d"] << shift
    return low


def limit_between(good: list[float], bad: list[float]) -> float:
    """The value that parts two lists with the best mean accuracy; the middle of the widest such gap."""
    if not good or not bad:
        return -math.inf
    marks = sorted([(x, 1) for x in good] + [(x, 0) for x in bad])
    best, out, over, under = -1.0, [], len(good), 0
    for i, (x, is_good) in enumerate(marks):
        over, under = over - is_good, under + 1 - is_good
        score = over / len(good) + under / len(bad)
        nxt = marks[i + 1][0] if i + 1 < len(marks) else x
        if score > best + 1e-12:
            best, out = score, []
        if score > best - 1e-12:
            out.append((nxt - x, (x + nxt) / 2))
    return max(out)[1]


def importance_resample(docs: DataFrame, labels: DataFrame, seed: int = 1, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text_key, n_ngrams, log_weight, score, kept for each row of docs (doc_id, text).

    labels: doc_id, target (true for texts of the target kind), and toxic (true for texts never to be kept) or no such column.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("target").cast("boolean").alias("target"), (F.col("toxic").cast("boolean") if "toxic" in labels.columns else F.lit(False)).alias("toxic"))
    known = known.dropna(subset=["id", "target"]).groupBy("id").agg(F.min("target").alias("target"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    n = known.count()
    if n > most_labelled:  # a share by hash, a little over what is asked for; then the least hashes
        known = known.filter(F.xxhash64("id") < F.lit(int((min(1.0, 1.05 * most_labelled / n + 1e-9) - 0.5) * (2.0**64 - 2048))))
    drawn = known.select("id", "target", "toxic", F.xxhash64("id").alias("h")).collect()  # about 1.05 * most_labelled rows
    drawn = sorted(drawn, key=lambda r: (r["h"], r["id"]))[:most_labelled]
    sample, toxic = {r["id"]: r["target"] for r in drawn}, {r["id"] for r in drawn if r["toxic"]}
    target_ids = np.array(sorted(i for i, t in sample.items() if t), np.int64)

    toxic_ids, rest_ids = np.array(sorted(toxic), np.int64), np.array(sorted(sample.keys() - toxic), np.int64)

    kinds = ("raw", "target", "toxic", "rest")
    counts = docs.mapInArrow(_count(target_ids, toxic_ids, rest_ids), "bucket int, raw long, target long, toxic long, rest long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in kinds])
    by_kind = np.zeros((4, WORD_BUCKETS + SHAPE_BUCKETS + 1))
    for r in counts.collect():  # at most as many rows as buckets, and one
        by_kind[:, r["bucket"]] = [r[c] for c in kinds]
    model = spark.sparkContext.broadcast(Model(by_kind[1, :-1], by_kind[0, :-1]))
    poison = spark.sparkContext.broadcast(Toxicity(by_kind[2, :WORD_BUCKETS], by_kind[3, :WORD_BUCKETS], int(by_kind[2, -1]), int(by_kind[3, -1])))

    def weigh(batch: pa.RecordBatch):
        m, sizes, sums, toxicity = model.value, [], [], []
        among = [_among(batch.column("doc_id"), ids).tolist() for ids in (target_ids, toxic_ids, rest_ids)]
        for t, fitted, is_toxic, is_rest in zip(texts(batch), *among, strict=True):
            g = ngrams(t)
            sizes.append(len(g))
            sums.append(m.weight(g, fitted))
            toxicity.append(poison.value.of(g, True if is_toxic else False if is_rest else None))
        u = ((batch.column("noise").to_numpy() >> 11) & ((1 << 53) - 1)).astype(np.float64)
        score = np.array(sums) - np.log(-np.log((u + 0.5) / 2.0**53))
        yield {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n_ngrams": pa.array(sizes, pa.int64()), "log_weight": pa.array(sums, pa.float64()), "score": pa.array(score), "place": pa.array(sortable(score)), "toxicity": pa.array(toxicity, pa.float64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.withColumns({"noise": F.xxhash64("doc_id", F.lit(seed)), "text_key": F.xxhash64("text")})
    scored = scratch.save(by_batch(f"doc_id {kind}, text_key long, n_ngrams long, log_weight double, score double, place long, toxicity double", weigh)(keyed), "scored")
    limit, most_toxic = -math.inf, math.inf
    if sample:
        ids = spark.createDataFrame([(i,) for i in sample], "id long")
        seen = scored.filter("n_ngrams > 0").join(F.broadcast(ids), scored["doc_id"].cast("long") == ids["id"], "left_semi").groupBy("doc_id").agg(F.min("log_weight").alias("w"), F.min("toxicity").alias("t")).collect()  # at most most_labelled rows
        by = {good: [r["w"] for r in seen if sample[r["doc_id"]] is good and r["doc_id"] not in toxic] for good in (True, False)}
        limit = limit_between(by[True], by[False])
        poisoned, pure = [r["t"] for r in seen if r["doc_id"] in toxic], [r["t"] for r in seen if sample[r["doc_id"]]]
        if poisoned and pure:
            most_toxic = limit_between(poisoned, pure)
    allowed = (F.col("n_ngrams") > 0) & (F.col("toxicity") <= F.lit(most_toxic))
    some = scored.filter(allowed)
    k = some.filter(F.col("log_weight") > limit).count()
    least = kth_greatest(some, "place", k)
    kept = allowed & (F.col("place") >= least) if least is not None else F.lit(False)
    return scored.withColumn("kept", kept).drop("place", "toxicity")


def target_labels(labels: DataFrame) -> DataFrame:
    """Texts of good quality that aren't toxic are the target; toxic ones are never kept."""
    toxic = F.coalesce("toxic", F.lit(0)) != 0
    return labels.select("doc_id", ((F.col("quality") == 1) & ~toxic).alias("target"), toxic.alias("toxic"))


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(table(spark, sf_dir, "documents"), target_labels(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_ngrams", "log_weight", "score", "kept")
