"""Benchmark decontamination by winnowing.

Both sides are cut into hashes of 5 consecutive words; in every run of 9 such hashes (13 words) the
least, the leftmost of equals, is a fingerprint. Any 13 words that a document and an item share
hold a common fingerprint, so the join of the fingerprints misses no shared span; each hit is then
extended word by word to the whole span both share. Items of under 13 words have no such run; they
are matched exactly, by the hash of all their words.

The benchmark's fingerprints go to every task, in blocks of items under ``block_bytes`` of text, so
what is broadcast is bounded however large the benchmark is; more blocks mean more passes.

Edge cases: null, empty and wordless texts have no words and no hits (an item of that kind matches
nothing); repeated item rows count as one item and an item without an id isn't counted; repeated
document rows repeat their result; an empty benchmark leaves every document clean; columns besides
the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, table, texts
from .ranks import anchors
from .words import identities, plain_words, runs

WINDOW, GRAM = 13, 5
#: Text of the items that one pass over the documents holds.
BLOCK_BYTES = 16 << 20


class Items:
    """Fingerprints of a block of items, sorted for look-up, and their words for extension."""

    def __init__(self, rows: list[tuple[object, bytes]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.run = window, gram, window - gram + 1
        self.ids: list[object] = []
        words, prints, places, self.start, short = [], [], [], [], {}
        at = 0
        for item, text in rows:
            w = identities(plain_words(text))
            if not len(w):
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.start.append(at)
            if len(w) < window:
                short.setdefault(len(w), []).append((int(runs(w, len(w))[0]), k))
            else:
                g = runs(w, gram)
                p, _, _ = anchors(g, self.run)
                prints.append(g[p])
                places.append(p + at)
            words.append(w)
            at += len(w)
        none = np.zeros(0, np.uint64)
        self.words = np.concatenate([*words, none])
        f, p = np.concatenate([*prints, none]), np.concatenate([*places, np.zeros(0, np.int64)])
        order = np.argsort(f, kind="stable")
        self.prints, self.places = f[order], p[order]
        self.start.append(at)
        self.short = {n: self._by_hash(x) for n, x in short.items()}

    @staticmethod
    def _by_hash(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[int]]]:
        by: dict[int, list[int]] = {}
        for h, k in pairs:
            by.setdefault(h, []).append(k)
        keys = sorted(by)
        return np.array(keys, np.uint64), [by[h] for h in keys]

    def matches(self, w: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of w (words) inside an occurrence of a window, and the items these come from."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for n, (keys, items) in self.short.items():
            if len(h := runs(w, n)):
                i = np.searchsorted(keys, h)
                i[i == len(keys)] = 0
                for p in np.flatnonzero(keys[i] == h).tolist():
                    spans.append((p, p + n))
                    found.update(items[i[p]])
        if len(w) >= self.window and len(self.prints):
            g = runs(w, self.gram)
            p, _, _ = anchors(g, self.run)
            left, right = np.searchsorted(self.prints, g[p]), np.searchsorted(self.prints, g[p], "right")
            done: dict[int, int] = {}  # diagonal -> where the last span on it ends
            for j in np.flatnonzero(right > left).tolist():
                for q in self.places[left[j] : right[j]].tolist():
                    self._extend(w, int(p[j]), q, done, spans, found)
        return spans, found

    def _extend(self, w: np.ndarray, p: int, q: int, done: dict, spans: list, found: set) -> None:
        if done.get(p - q, -1) > p:
            return
        k = int(np.searchsorted(self.start, q, "right")) - 1
        a, b = self.start[k], self.start[k + 1]
        back = min(p, q - a)
        same = w[p - back : p][::-1] == self.words[q - back : q][::-1]
        lo = p - (back if same.all() else int(np.argmin(same)))
        on = min(len(w) - p, b - q)
        same = w[p : p + on] == self.words[q : q + on]
        hi = p + (on if same.all() else int(np.argmin(same)))
        done[p - q] = max(hi, p + 1)
        if hi - lo >= self.window:
            spans.append((lo, hi))
            found.add(k)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items, parted so that a part's text is expected to be at most half of block_bytes."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s")).first()["s"]
    n = 1 if size <= block_bytes else -(-2 * size // block_bytes)
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return [benchmark if n == 1 else benchmark.filter(part == i) for i in range(n)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_key, n_words, spans (of words, disjoint) and items (distinct item_ids as text) of each row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    benchmark = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, mark binary, n_words long, spans array<struct<first:long,end:long>>, items array<string>"

    def against(block: DataFrame) -> DataFrame:
        rows = [(r["item_id"], (r["text"] or "").encode()) for r in block.collect()]  # bounded by block_bytes
        index = spark.sparkContext.broadcast(Items(rows, window, gram))

        def find(batch: pa.RecordBatch):
            items, n_words, spans, names, marks = index.value, [], [], [], []
            for text in texts(batch):
                w = identities(plain_words(text))
                s, found = items.matches(w)
                n_words.append(len(w))
                spans.append([{"first": a, "end": b} for a, b in merge(s)])
                names.append(sorted({items.ids[k] for k in found} - {None}))
                marks.append(hashlib.md5(text).digest() if parts > 1 else b"")
            yield {
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "mark": pa.array(marks, pa.binary()),
                "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                "items": pa.array(names, pa.list_(pa.string())),
            }

        return by_batch(schema, find)(docs)

    blocks = _blocks(benchmark, block_bytes)
    parts = len(blocks)
    found = [against(b) for b in blocks]
    if parts == 1:
        return found[0].drop("mark")
    # several passes: a row's spans meet by doc_id and text; equal rows have equal results
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionByName(x.filter(F.size("spans") > 0))
    hits = hits.groupBy("doc_id", "text_key", "mark", "n_words").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def join_spans(batch: pa.RecordBatch):
        out = {n: batch.column(n) for n in ("doc_id", "text_key", "mark", "n_words", "spans", "items")}
        merged = [[{"first": a, "end": b} for a, b in merge([(x["first"], x["end"]) for x in s])] for s in batch.column("spans").to_pylist()]
        yield out | {"spans": pa.array(merged, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))}

    hits = by_batch(schema, join_spans)(hits)
    rows = docs.select(F.col("doc_id").alias("d"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("m"))
    return rows.join(hits, rows["d"].eqNullSafe(hits["doc_id"]) & (rows["m"] == hits["mark"])).select("doc_id", "text_key", "n_words", "spans", "items")


def is_contaminated(n_hit: int, n_words: int) -> bool:
    """Some word is hit, and those hit are at least a twentieth of the words."""
    return n_hit > 0 and 20 * n_hit >= n_words


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated.

    With one block of items each row is judged where it stands, and no text is shuffled; with more,
    rows are joined back to their verdict by doc_id and text.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(items, block_bytes)
    if len(blocks) > 1:
        bad = decontaminate(docs, benchmark, window=window, gram=gram, block_bytes=block_bytes, keyed=True).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
        return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__key"]), "left_anti")
    index = docs.sparkSession.sparkContext.broadcast(Items([(r["item_id"], (r["text"] or "").encode()) for r in blocks[0].collect()], window, gram))  # bounded by block_bytes

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            verdicts = []
            for t in texts(b):
                w = identities(plain_words(t))
                spans, _ = index.value.matches(w)
                verdicts.append(not is_contaminated(sum(e - a for a, e in merge(spans)), len(w)))
            yield b.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, keyed: bool = False, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row; keyed: and text_key."""
    h = benchmark_hits(docs, benchmark, **how)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    h = h.select("doc_id", *(["text_key"] if keyed else []), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return h.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT item_id, unnest(CASE WHEN len(w) < 13 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' ')) END) g,
              least(len(w), 13) n FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p+n-1], ' ') g FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(p)),
m AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT x) n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) x FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
