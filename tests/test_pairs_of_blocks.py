"""All pairs of vectors: what is shuffled doesn't grow with the number of blocks, and results are those of brute force."""

from __future__ import annotations

import numpy as np
import pytest

from shutterlake.operators import entity

FACES = "id long, person_id long, embedding array<double>"


def shuffled(spark, run) -> int:
    """Records that run's stages write for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    run()
    return written() - before


def faces(n: int, copies: int = 0) -> list[tuple]:
    """Vectors around some centres, the last of them copies of the first."""
    rng = np.random.default_rng(11)
    v = np.vstack([rng.normal(c, 0.4, (n // 5, 5)) for c in np.eye(5)])
    v[len(v) - copies :] = v[0]
    return [(i * 7 % n, i % 6, x.tolist()) for i, x in enumerate(v)]


def votes(rows: list[tuple], vetoes: bool, k: int, threshold: float) -> dict:
    unit = {i: np.array(x) / np.linalg.norm(x) for i, _, x in rows}
    who, out = {i: p for i, p, _ in rows}, {}
    for i in unit:
        near = sorted((round(1 - float(unit[i] @ unit[j]), 12), j) for j in unit if j != i)[:k]
        near = [(d, who[j]) for d, j in near if d <= threshold]
        net = {p: (sum(q == p for _, q in near) - vetoes * sum((q + 1) % 6 == p for _, q in near), np.mean([d for d, q in near if q == p])) for _, p in near}
        best = min(((-n, round(m, 9), p, m) for p, (n, m) in net.items() if n > 0), default=None)
        if best:
            out[i] = (best[2], pytest.approx(max(0.0, 1 - best[3]), abs=2e-6))
    return out


@pytest.mark.parametrize("vetoes", [True, False])
def test_votes_over_blocks(spark, monkeypatch, vetoes):
    monkeypatch.setattr(entity, "BLOCK", 9)
    monkeypatch.setattr(entity, "STRIP", 4)
    rows = faces(120, 30)
    df = spark.createDataFrame([*rows, (500, 1, None), (501, 1, [float("nan"), 0.0, 0.0, 0.0, 0.0])], FACES)
    against = df.selectExpr("id", "(person_id + 1) % 6 as person_id", "embedding") if vetoes else None
    got = {r[0]: (r[1], r[2]) for r in entity.knn_vote(df.select("id", "embedding"), df, against, 3, 0.3, others=True).collect()}
    assert got == votes(rows, vetoes, 3, 0.3) and len(got) > 50


@pytest.mark.parametrize("vetoes", [True, False])
def test_votes_shuffle_vectors_once(spark, monkeypatch, vetoes):
    monkeypatch.setattr(entity, "BLOCK", 10)
    df = spark.createDataFrame(faces(300), FACES)
    run = lambda: entity.knn_vote(df.select("id", "embedding"), df, df.limit(0) if vetoes else None, 1, 0.01, others=True).collect()
    # probes and both sides are dealt, of equal vectors the least ids chosen, and each probe's best handed on by each of 4 partitions
    assert shuffled(spark, run) < 300 * 12


def test_of_equal_vectors_the_least_ids_are_met(spark):
    df = spark.createDataFrame([(i, i, [1.0, 0.5]) for i in range(50)] + [(99, 7, [1.0, 0.4])], FACES)
    got = {r["probe"]: [] for r in df.selectExpr("id as probe").collect()}
    for r in entity.nearest(df, df, 3, 0.5, others=True).orderBy("probe", "r").collect():
        got[r["probe"]].append((r["pos"], r["person_id"]))
    assert got == {i: [(j, j) for j in range(4) if j != i][:3] for i in [*range(50), 99]}


def test_unknown_persons_vote_too(spark):
    df = spark.createDataFrame([(1, None, [1.0, 0.0]), (2, 4, [1.0, 0.1])], FACES)
    assert {(r["probe"], r["person_id"]) for r in entity.nearest(df, df, 1, 0.5, others=True).collect()} == {(1, 4), (2, None)}


@pytest.mark.parametrize("least", [2, 3])
def test_clusters_shuffle_vectors_once(spark, monkeypatch, least):
    df = spark.createDataFrame(faces(300), FACES).select("id", "embedding")
    monkeypatch.setattr(entity, "BLOCK", 10)
    assert shuffled(spark, lambda: entity.dbscan(df, 1e-9, least).collect()) < 300 * 8


def test_distances_at_the_limit_are_decided_in_double_precision(spark):
    """Angles that single precision can't tell from the limit."""
    a = [np.arccos(0.5) + x for x in (-1e-9, 1e-9)]
    rows = [(0, 0, [1.0, 0.0])] + [(i + 1, 0, [float(np.cos(x)), float(np.sin(x)) * (1 - 2 * i)]) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, FACES)
    assert [tuple(r) for r in entity.close_pairs(df, 0.5).collect()] == [(1, 0)]
    assert {r["id"]: r["cluster"] for r in entity.dbscan(df.select("id", "embedding"), 0.5).collect()} == {0: 0, 1: 0, 2: None}
    assert {(r["probe"], r["pos"]) for r in entity.nearest(df, df, 2, 0.5, others=True).collect()} == {(0, 1), (1, 0)}
