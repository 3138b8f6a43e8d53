"""The corpus pipeline: quality, near copies, repeated passages, benchmark passages, and the mix.

Each stage takes the documents its predecessor left and returns the documents it leaves, with the
same columns; the last returns what the mix takes of each document. Verdicts are joined back to their
rows by doc_id (null equals null) and text, so rows that share a doc_id only are told apart.

Edge cases: null and empty texts have no word, so the quality stage rejects them unless no label is
known; rows of equal doc_id and text are one document, of which near_copies keeps one (the least by a
hash of its plain columns); columns beside those of documents, whatever their names, stay as they are,
but that n_chars, where there is one, follows a text that was cut; empty tables stay empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import decontaminate, importance, mixing, near_dups, passages
from shutterlake.llm.common import Scratch, by_batch, dealt, table, texts


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def _only(docs: DataFrame, those: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text are among those (doc_id, text_key)."""
    those = those.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(dealt(those), docs["doc_id"].eqNullSafe(those["__id"]) & (_key(docs) == those["__key"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    judged = importance.importance_resample(docs, importance.target_labels(table(spark, sf_dir, "labels")))
    return _only(docs, judged.filter("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of likeness 0.8 and more, stays; of rows of one doc_id and text, one."""
    # 38 bands of 5: two of likeness 0.8 share none with a chance under 3 in 10 million
    stay = near_dups.one_of_each(docs, percent=80, slots=190, rows=5)
    rows = _only(docs, stay).select(F.struct("*").alias("row"))
    # copies meet where they are first; which of them stays isn't told by their order
    id_, key = F.col("row")["doc_id"], F.xxhash64(F.col("row")["text"].cast("string"))
    plain = [F.col("row")[c] for c, kind in docs.dtypes if not kind.startswith(("map", "struct", "array"))]
    return rows.groupBy(id_.alias("id"), key.alias("key")).agg(F.min_by("row", F.xxhash64(*plain)).alias("row")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes and more, or of over 50 words, that stand elsewhere too go; of a character cut in two nothing stays."""
    found = passages.repeated_spans(docs, words=passages.PASSAGE).select("key", F.concat("spans", "passages").alias("spans"))
    cols, schema = docs.columns, docs.schema
    rows = docs.select(passages.text_key(docs["text"].cast("string")).alias("own"), F.struct("*").alias("row"))
    joined = rows.join(dealt(found), F.col("own") == F.col("key"), "left").select("row", "spans")

    def cut(batch: pa.RecordBatch):
        row, spans = pa.RecordBatch.from_struct_array(batch.column("row")), batch.column("spans").to_pylist()
        before = row.column("text").to_pylist()
        spans = [[{"first": a, "end": b} for a, b in decontaminate.merge([(x["first"], x["end"]) for x in s or ()])] for s in spans]
        after = [passages.kept_bytes(b, s).decode("utf-8", "ignore") if s else t for t, b, s in zip(before, texts(row), spans, strict=True)]
        n = [len(t) if s and t is not None else m for t, s, m in zip(after, spans, row.column("n_chars").to_pylist(), strict=True)] if "n_chars" in cols else None
        out = {c: row.column(c) for c in cols} | {"text": pa.array(after, row.column("text").type)}
        yield out | ({"n_chars": pa.array(n, row.column("n_chars").type)} if n is not None else {})

    return by_batch(schema, cut)(joined)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken, first_slot."""
    return mixing.mix(docs)[0]


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
]
#: The quality stage's hashed models aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    scratch = Scratch(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
