"""The corpus pipeline on the smallest tables: what each stage leaves, against the operators' own results."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shutterlake.llm import decontaminate, importance, near_dups


def stay_plainly(texts, percent):
    """Which of the texts stay if one of each group of likeness percent / 100 does, the first."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) == i for i in range(len(texts))]


def cut_plainly(texts, n=400, words=51):
    """The texts without windows of n bytes, or of so many words, that stand elsewhere too."""
    blobs = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in blobs]
    windows = []
    for b, at in zip(blobs, places, strict=True):
        windows.append([(b[i : i + n], i, i + n) for i in range(len(b) - n + 1)])
        windows[-1] += [(tuple(b[x:y] for x, y in at[i : i + words]), at[i][0], at[i + words - 1][1]) for i in range(len(at) - words + 1)]
    seen = Counter(w for x in windows for w, _, _ in x)
    out = []
    for t, b, x in zip(texts, blobs, windows, strict=True):
        gone = bytearray(len(b))
        for w, i, j in x:
            if seen[w] > 1:
                gone[i:j] = b"\1" * (j - i)
        out.append(bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") if t is not None else None)
    return out


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept[-1], sf).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert kept[-1].columns == columns
    rows = [sorted(d.collect(), key=lambda r: r["doc_id"]) for d in kept]
    ids = [[r["doc_id"] for r in x] for x in rows]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert ids[1] == sorted(r["doc_id"] for r in importance.importance_resample(docs, importance.target_labels(labels)).filter("kept").collect())
    texts = [[r["text"] for r in x] for x in rows]
    assert ids[2] == [i for i, stays in zip(ids[1], stay_plainly(texts[1], 80), strict=True) if stays]
    assert ids[3] == ids[2] and texts[3] == cut_plainly(texts[2]) and texts[3] != texts[2]
    assert all(r["n_chars"] == len(r["text"]) for r, t in zip(rows[3], texts[2], strict=True) if r["text"] != t)
    assert ids[4] == sorted(r["doc_id"] for r in decontaminate.decontaminate(kept[3], spark.read.parquet(f"{sf}/benchmark.parquet")).filter("not contaminated").collect())
    last = corpus_pipeline.STAGES[-1][1](spark, kept[4], sf).collect()
    assert sorted(r["doc_id"] for r in last) == ids[4] and all(r["taken"] <= 2 * r["size"] for r in last)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in whole) == sorted((r["doc_id"], r["taken"]) for r in last)


def test_stages_on_odd_rows(spark, sf):
    """Nulls, ties, repeated rows, long texts and columns whose names could clash."""
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [(1, long), (1, long), (None, "x y z one two three"), (None, "x y z one two three"), (1, "another text of id one"), (None, "and one more"), (2, None), (3, ""), (3, ""), (4, " \n "), (5, long + " end"), (6, "X y z one two three")]
    names = ("__spans", "__key", "__id", "key", "own", "row", "spans", "id", "group", "kept", "text_key", "h", "node", "size", "taken", "k", "source_no")
    docs = spark.createDataFrame([(i, t, "s" if i else None, len(t or "")) for i, t in texts], "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit(7) for c in names})
    of = lambda d: sorted(((r["doc_id"], (r["text"] or "")[-20:]) for r in d.collect()), key=repr)
    done = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES}
    assert all(done[name].columns == docs.columns and all(r["__spans"] == 7 for r in done[name].select("__spans").collect()) for name, _ in corpus_pipeline.STAGES[:-1])
    assert set(of(done["quality"])) <= set(of(docs))
    assert of(done["near_copies"]) == sorted([(1, long[-20:]), (1, "another text of id one"[-20:]), (None, "and one more"), (2, ""), (3, ""), (4, " \n "), (6, "X y z one two three")], key=repr)
    cut = {(r["doc_id"], r["text"]) for r in done["repeated_passages"].collect()}
    assert (5, " end") in cut and (1, "") in cut and (2, None) in cut and (4, " \n ") in cut and (1, "another text of id one") in cut
    assert done["benchmark_passages"].count() == len(texts) and done["mixture"].count() == len(texts)
    clean = corpus_pipeline.near_copies(spark, docs, sf)
    assert corpus_pipeline.near_copies(spark, docs.repartition(5), sf).count() == clean.count()


def test_near_copies_of_eighty_hundredths_go(spark, sf):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:181] + [f"x{i}" for i in range(19)])), (3, " ".join(words[:175] + [f"y{i}" for i in range(25)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")  # likenesses 177/215 and 171/221
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()} == {1, 3}
    assert 0.72 < near_dups.least_agreement(85, 192) < 0.7215 and 0.65 < near_dups.least_agreement(80, 190) < 0.66


def test_passages_of_over_fifty_words_go(spark, sf):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    long, short, few = words("p", 51), words("q", 50), " ".join("é" * 250 + str(i) for i in range(2))
    rows = [(1, f"{words('a', 70)} {long}\n{words('b', 9)} {short} c d"), (2, f"{long} {words('e', 99)} {short}"), (3, f"f {few} g"), (4, f"h {few} i"), (5, None), (6, f"{words('k', 20)} {words('l', 51)} {words('m', 51)} x {words('l', 51)}")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, sf).collect()}
    assert len(long) < 400 and got[1] == rows[0][1].replace(long, "") and got[2] == rows[1][1].replace(long, "")
    assert got[3] == "fg" and got[4] == "hi" and got[5] is None
    assert got[6] == rows[5][1].replace(words("l", 51), "")


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, sf, stage):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert stage(spark, none, sf).count() == 0
