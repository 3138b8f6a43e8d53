"""Who is who: density clusters of faces, nearest-neighbour recognition, labels carried over."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.media import iou
from ..plans.graph import checkpointed, components

#: Rows of a block when all pairs of a set of vectors are compared, and its bytes where vectors are long.
BLOCK = 4096
BLOCK_BYTES = 4 << 20
#: Blocks of a partition at most. A task crosses two partitions, one of which it holds.
BLOCKS = 32
#: Rows of a block whose products are made at once; what is made then stays near the processor.
STRIP = 512
#: Numbers that a step gathers at once where single pairs are looked at again.
GATHER = 1 << 21
#: A person_id of null within a block.
NOBODY = np.iinfo(np.int64).min


class Block:
    """Unit vectors (those of next to no length as they are) with their ids and what else their rows hold."""

    def __init__(self, rows: pa.Buffer):
        self.rows = pa.ipc.open_stream(rows).read_all()
        self.ids = self.rows["id"].to_numpy()
        self.v = _matrix(self.rows["embedding"].combine_chunks()).astype(np.float64)
        n = np.sqrt((self.v * self.v).sum(1, keepdims=True))
        self.v /= np.where(n <= 1e-8, 1.0, n)
        self.single = self.v.astype(np.float32)

    def __len__(self) -> int:
        return len(self.ids)

    def slack(self) -> float:
        """More than twice what a product of unit vectors in single precision is off."""
        return (self.v.shape[1] + 8) * 2.0**-22

    def column(self, name: str) -> np.ndarray:
        return self.rows[name].combine_chunks().fill_null(NOBODY if name == "person_id" else False).to_numpy(zero_copy_only=False)


def _matrix(v: pa.ListArray) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def packed(vectors: DataFrame) -> DataFrame:
    """k, rows: vectors (id, embedding and more) in blocks, a row each, written once to the shared folder.

    Vectors that hold a NaN or an infinity are near to nothing, so they are left out.
    """
    n, long = vectors.agg(F.count("embedding"), F.max(F.size("embedding"))).first()
    rows = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, long or 1))))
    blocks, few = max(1, -(-n // rows)), math.ceil(2 * math.sqrt(vectors.sparkSession.sparkContext.defaultParallelism))
    parts = max(-(-blocks // BLOCKS), min(blocks, few))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held = TaskContext.get().partitionId() << 32, []

        def block(t: pa.Table) -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, t.schema) as w:
                w.write_table(t.combine_chunks())
            return pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "rows": pa.array([out.getvalue().to_pybytes()], pa.binary())})

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b.filter(pa.array(np.isfinite(_matrix(b.column("embedding"))).all(1))))
            while sum(h.num_rows for h in held) >= rows:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, rows))
                k, held = k + 1, t.slice(rows).to_batches()
        if sum(h.num_rows for h in held):
            yield block(pa.Table.from_batches(held))

    return checkpointed(vectors.filter("embedding is not null").repartition(parts).mapInArrow(pack, "k long, rows binary"))


def crossed(left: DataFrame, right: DataFrame, step: Callable[[Iterator[tuple[int, int, Block, Block]]], Iterator[dict]], schema: str) -> DataFrame:
    """step over (i, j, left block, right block) of all pairs of packed blocks, or of those with i <= j where left is right.

    A task crosses two partitions as they lie in the shared folder, so no block is shuffled or written
    again however many it meets: disk is that of the vectors, and only the work is that of all pairs.
    A left block meets all right ones of its task before the next.
    """
    x = left.select(F.col("k").alias("i"), F.col("rows").alias("x"))
    y = right.select(F.col("k").alias("j"), F.col("rows").alias("y")).hint("shuffle_replicate_nl")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Block, Block]]:
        at, block = None, None
        for b in batches:
            for i, j, p, q in zip(b.column("i").to_pylist(), b.column("j").to_pylist(), b.column("x"), b.column("y"), strict=True):
                if i != at:
                    at, block = i, Block(p.as_buffer())
                yield i, j, block, Block(q.as_buffer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in step(pairs(batches)):
            t = pa.RecordBatch.from_pydict(out)
            for lo in range(0, t.num_rows, 1 << 15):
                yield t.slice(lo, 1 << 15)

    met = x.join(y, F.col("i") <= F.col("j")) if left is right else x.crossJoin(y)
    return met.mapInArrow(run, schema)


def _spots(mask: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of what is set, by whole rows, at most so many at once where a row hasn't more."""
    n = np.count_nonzero(mask)
    if n > most and len(mask) > 1:
        half = len(mask) // 2
        yield from _spots(mask[:half], most)
        for p, q in _spots(mask[half:], most):
            yield p + half, q
    elif n:
        yield np.divmod(np.flatnonzero(mask), mask.shape[1])


def _cosines(x: Block, y: Block, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x.v[p], y.v[q])


def within(x: Block, y: Block, eps: float, same: bool) -> np.ndarray:
    """Which of x and y are at cosine distance of eps or less; no vector is so to itself.

    Single precision decides all that isn't within its error of eps, double precision that.
    """
    close, slack = np.empty((len(x), len(y)), bool), x.slack()
    for lo in range(0, len(x), STRIP):
        s = x.single[lo : lo + STRIP] @ y.single.T
        part = np.greater_equal(s, np.float32(1 - eps + slack), out=close[lo : lo + STRIP])
        for p, q in _spots((s >= np.float32(1 - eps - slack)) ^ part, max(1, GATHER // x.v.shape[1])):
            part[p, q] = 1.0 - _cosines(x, y, p + lo, q) <= eps + 1e-12
    if same:
        np.fill_diagonal(close, False)
    return close


def close_pairs(vectors: DataFrame, eps: float) -> DataFrame:
    """Pairs (a > b) at cosine distance of eps or less, exactly and all of them."""
    def step(pairs: Iterator) -> Iterator[dict]:
        for i, j, x, y in pairs:
            for p, q in _spots(within(x, y, eps, i == j), 1 << 20):
                a, b = x.ids[p], y.ids[q]
                keep = a > b if i == j else np.ones(len(a), bool)
                yield {"a": np.maximum(a, b)[keep], "b": np.minimum(a, b)[keep]}

    blocks = packed(vectors.select("id", "embedding"))
    return crossed(blocks, blocks, step, "a long, b long")


def neighbours(vectors: DataFrame, eps: float) -> DataFrame:
    """id, n: how many others are at cosine distance of eps or less; those without any are left out."""
    return _neighbours(packed(vectors.select("id", "embedding")), eps)


def _neighbours(blocks: DataFrame, eps: float) -> DataFrame:
    def step(pairs: Iterator) -> Iterator[dict]:
        ids, n = {}, {}
        for i, j, x, y in pairs:
            close = within(x, y, eps, i == j)
            for k, block, axis in ((i, x, 1), (j, y, 0))[: 1 + (i != j)]:
                ids[k] = block.ids
                n[k] = n.get(k, 0) + np.count_nonzero(close, axis=axis)
        for k, c in n.items():
            yield {"a": ids[k][c > 0], "b": c[c > 0].astype(np.int64)}

    return crossed(blocks, blocks, step, "a long, b long").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n"))


def forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row or column, its tree's first row) of the trees that span the links of rows with columns; columns come after rows.

    Each row and column is looked at once, so a block of one dense cluster costs what its matrix does.
    """
    rows, cols = close.shape
    root, seen = np.full(rows + cols, -1), np.zeros(rows + cols, bool)
    linked = close.any(1)
    for r in np.flatnonzero(linked).tolist():
        if seen[r]:
            continue
        seen[r], new = True, np.array([r])
        root[r] = r
        while len(new):
            across = np.flatnonzero(close[new].any(0) & ~seen[rows:])
            seen[rows + across] = True
            root[rows + across] = r
            new = np.flatnonzero(close[:, across].any(1) & ~seen[:rows]) if len(across) else across
            seen[new] = True
            root[new] = r
    at = np.flatnonzero((root >= 0) & (root != np.arange(rows + cols)))
    return at, root[at]


class Trees:
    """Which vectors of a task's blocks are linked, by numbers in order of arrival: the least linked number of each."""

    def __init__(self):
        self.first, self.ids, self.least = {}, [], np.zeros(0, np.int64)

    def of(self, k: int, block: Block) -> np.ndarray:
        """The numbers of block k's vectors."""
        if k not in self.first:
            self.first[k] = len(self.least)
            self.ids.append(block.ids)
            self.least = np.concatenate([self.least, np.arange(len(self.least), len(self.least) + len(block))])
        return np.arange(self.first[k], self.first[k] + len(block))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            p, q = self.least[a], self.least[b]
            new = p != q
            if not new.any():
                return
            a, b = a[new], b[new]
            np.minimum.at(self.least, np.maximum(p, q)[new], np.minimum(p, q)[new])
            while (up := self.least[self.least] != self.least).any():
                self.least[up] = self.least[self.least[up]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, its tree's least id) where they differ."""
        ids = np.concatenate([np.zeros(0, np.int64), *self.ids])
        root = ids.copy()
        np.minimum.at(root, self.least, ids)
        root = root[self.least]
        return ids[ids != root], root[ids != root]


def dbscan(vectors: DataFrame, eps: float, min_samples: int = 2) -> DataFrame:
    """id, cluster (its least core id; null for noise).

    Cores have min_samples neighbours, themselves included; cores within eps share a cluster, and a
    border point joins the least of its cores' clusters. A first pass over the pairs of blocks counts
    neighbours; a second gives the trees that span each task's links of cores, at most a row for each of
    its vectors, and the links of points that aren't cores, of which each has fewer than min_samples. So
    a dense cluster never leaves as its pairs. At min_samples of 2 or less a link makes cores, and one pass does.
    """
    vectors = vectors.select("id", "embedding")
    if min_samples > 2:
        counted = checkpointed(neighbours(vectors, eps))
        cores = counted.filter(F.col("n") + 1 >= min_samples).select("id", F.lit(True).alias("core"))
        given = vectors.join(counted.select("id"), "id", "left_semi").join(cores, "id", "left").select("id", "embedding", F.coalesce("core", F.lit(False)).alias("core"))
    else:
        given = vectors.withColumn("core", F.lit(True))

    def step(pairs: Iterator) -> Iterator[dict]:
        trees = Trees()
        for i, j, x, y in pairs:
            own, far = trees.of(i, x), trees.of(j, y)
            inner, outer = x.column("core"), y.column("core")
            a, b = trees.least[own], trees.least[far]
            if inner.all() and outer.all() and (a == a[0]).all() and (b == a[0]).all():
                continue
            close = within(x, y, eps, i == j)
            # of a border point and its core, the point is first
            for p, q in _spots(close & ~inner[:, None] & outer[None, :], 1 << 20):
                yield {"a": x.ids[p], "b": y.ids[q]}
            if i != j:
                for p, q in _spots(close & inner[:, None] & ~outer[None, :], 1 << 20):
                    yield {"a": y.ids[q], "b": x.ids[p]}
            close &= inner[:, None] & outer[None, :]
            close &= a.astype(np.int32)[:, None] != b.astype(np.int32)[None, :]
            rows = np.flatnonzero(close.any(1))
            if len(rows):
                at, root = forest(close[rows])
                both = np.concatenate([own[rows], far])
                trees.link(both[at], both[root])
        a, b = trees.links()
        yield {"a": a, "b": b}

    blocks = packed(given)
    links = checkpointed(crossed(blocks, blocks, step, "a long, b long").filter("a <> b"))
    if min_samples > 2:
        links = links.join(cores.select(F.col("id").alias("a"), F.lit(True).alias("inner")), "a", "left")
    else:
        links = links.withColumn("inner", F.lit(True))
    comps = components(links.filter("inner").select("a", "b"))
    if min_samples > 2:
        own = cores.join(comps, F.col("id") == F.col("node"), "left").select(F.col("id").alias("core"), F.coalesce("component", "id").alias("cluster"))
    elif min_samples == 2:
        own = comps.select(F.col("node").alias("core"), F.col("component").alias("cluster"))
    else:
        own = vectors.join(comps, F.col("id") == F.col("node"), "left").select(F.col("id").alias("core"), F.coalesce("component", "id").alias("cluster"))
    border = links.filter("inner is null").join(own, F.col("b") == F.col("core")).groupBy("a").agg(F.min("cluster").alias("near"))
    out = vectors.select("id").join(own, F.col("id") == F.col("core"), "left").join(border, F.col("id") == F.col("a"), "left")
    return out.select("id", F.coalesce("cluster", "near").alias("cluster"))


class Best:
    """The k nearest that a block of probes has met so far: person_id, id and distance of each, nearest first."""

    def __init__(self, probes: Block, k: int, threshold: float, others: bool):
        self.probes, self.k, self.threshold, self.others = probes, k, threshold, others
        self.dist = np.full((len(probes), k), np.inf)
        self.pos, self.who = np.zeros((2, len(probes), k), np.int64)

    def meet(self, side: Block) -> None:
        """Single precision finds what may be among the nearest, double precision ranks that."""
        x, k, slack, who = self.probes, self.k, self.probes.slack(), side.column("person_id")
        for lo in range(0, len(x), STRIP):
            s = x.single[lo : lo + STRIP] @ side.single.T
            limit = (1 - np.minimum(self.threshold, self.dist[lo : lo + STRIP, -1:]) - slack).astype(np.float32)
            may = s >= limit
            if len(side) > k + 1 and np.count_nonzero(may) > 4 * (k + 1) * len(s):
                # one of them may be the probe itself, so k others are as near as the (k + 1)-th
                at = len(side) - k - 1
                may = s >= np.maximum(limit, np.partition(s, at, axis=1)[:, at : at + 1] - np.float32(slack))
            for p, q in _spots(may, max(1, GATHER // x.v.shape[1])):
                self._rank(p + lo, side, q, who)

    def _rank(self, p: np.ndarray, side: Block, q: np.ndarray, who: np.ndarray) -> None:
        d = np.round(1.0 - _cosines(self.probes, side, p, q), 12)
        keep = d <= np.minimum(self.threshold, self.dist[p, -1])
        if self.others:
            keep &= self.probes.ids[p] != side.ids[q]
        p, q, d = p[keep], q[keep], d[keep]
        rows = np.unique(p)
        row = np.concatenate([np.repeat(rows, self.k), p])
        d, pos, w = np.concatenate([self.dist[rows].ravel(), d]), np.concatenate([self.pos[rows].ravel(), side.ids[q]]), np.concatenate([self.who[rows].ravel(), who[q]])
        order = np.lexsort((pos, d, row))
        row = row[order]
        r = np.arange(len(row)) - np.searchsorted(row, row)
        row, r, order = row[r < self.k], r[r < self.k], order[r < self.k]
        self.dist[row, r], self.pos[row, r], self.who[row, r] = d[order], pos[order], w[order]

    def found(self) -> dict:
        x, y = np.nonzero(np.isfinite(self.dist))
        who = self.who[x, y]
        return {"probe": self.probes.ids[x], "pos": self.pos[x, y], "person_id": pa.array(who, mask=who == NOBODY), "dist": self.dist[x, y]}


def nearest(probes: DataFrame, side: DataFrame, k: int, threshold: float, others: bool = False) -> DataFrame:
    """probe, pos, person_id, dist, r: each probe's k nearest of side (id, person_id, embedding) within the threshold.

    others: both are of one table, and no probe is its own neighbour.

    Both are packed into blocks; a pair of blocks is one matrix product, and a task hands on each probe's
    k best of the partition it crosses. So neither side has to fit anywhere, and what is ranked is k rows a
    probe and partition. Equal distances go to the least id, so of equal vectors the k + 1 least ids are enough.
    """
    return _nearest(packed(probes.select("id", "embedding")), side, k, threshold, others)


def _nearest(probes: DataFrame, side: DataFrame, k: int, threshold: float, others: bool) -> DataFrame:
    """nearest, for packed probes."""
    equal = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("id")
    side = side.select("id", "person_id", "embedding").filter("embedding is not null").withColumn("r", F.row_number().over(equal)).filter(F.col("r") <= k + 1).drop("r")

    def step(pairs: Iterator) -> Iterator[dict]:
        at, best = None, None
        for i, _, x, y in pairs:
            if i != at:
                if best:
                    yield best.found()
                at, best = i, Best(x, k, threshold, others)
            best.meet(y)
        if best:
            yield best.found()

    near = crossed(probes, packed(side), step, "probe long, pos long, person_id long, dist double")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("dist", "pos"))).filter(F.col("r") <= k)


def knn_vote(probes: DataFrame, positives: DataFrame, negatives: DataFrame | None = None, k: int = 5, threshold: float = 0.5, others: bool = False) -> DataFrame:
    """probe, person_id, confidence: votes of the k nearest positives less those of the k nearest negatives.

    probes: id, embedding; positives and negatives: id, person_id, embedding. Only neighbours within
    the threshold vote; a person needs more votes than vetoes; most net votes, then the least mean
    distance, then the least person.
    """
    probes = packed(probes.select("id", "embedding"))
    votes = _nearest(probes, positives, k, threshold, others).groupBy("probe", "person_id").agg(F.count(F.lit(1)).alias("votes"), F.avg("dist").alias("mean"))
    if negatives is not None:
        veto = _nearest(probes, negatives, k, threshold, others).groupBy("probe", "person_id").agg(F.count(F.lit(1)).alias("vetoes"))
        votes = votes.join(veto, ["probe", "person_id"], "left").withColumn("votes", F.col("votes") - F.coalesce("vetoes", F.lit(0))).drop("vetoes")
    best = votes.filter("votes > 0").withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("votes"), F.round("mean", 9), "person_id"))).filter("r = 1")
    return best.select("probe", "person_id", F.greatest(F.lit(0.0), F.round(1 - F.col("mean"), 6)).alias("confidence"))


def iou_pairs(old: DataFrame, new: DataFrame, threshold: float = 0.5) -> DataFrame:
    """photo_id, old_id, new_id, iou of the boxes of one photo that overlap enough."""
    o = old.select("photo_id", F.col("id").alias("old_id"), F.col("bbox").alias("ob"))
    n = new.select("photo_id", F.col("id").alias("new_id"), F.col("bbox").alias("nb"))
    return o.join(n, "photo_id").select("photo_id", "old_id", "new_id", F.round(iou(F.col("ob"), F.col("nb")), 6).alias("iou")).filter(F.col("iou") >= threshold)


def carry_labels(old: DataFrame, new: DataFrame, threshold: float = 0.5) -> DataFrame:
    """new_id, person_id: labels a person gave (confidence 1 or more) carried to the new faces.

    Within a photo pairs are taken greedily, one to one, by most overlap, then the later new face,
    then the later old one. Pairs are dealt by photo and sorted into that order, so each task takes
    them in one pass that remembers the faces of the photo at hand only.
    """
    human = old.filter("person_id is not null and confidence >= 1.0")
    pairs = iou_pairs(human, new, threshold)

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        photo, used_old, used_new = None, set(), set()
        for b in batches:
            out_old, out_new = [], []
            for p, o, n in zip(*(b.column(c).to_pylist() for c in ("photo_id", "old_id", "new_id")), strict=True):
                if p != photo:
                    photo, used_old, used_new = p, set(), set()
                if o not in used_old and n not in used_new:
                    used_old.add(o)
                    used_new.add(n)
                    out_old.append(o)
                    out_new.append(n)
            yield pa.RecordBatch.from_pydict({"old_id": pa.array(out_old, pa.int64()), "new_id": pa.array(out_new, pa.int64())})

    ordered = pairs.repartition("photo_id").sortWithinPartitions("photo_id", F.desc("iou"), F.desc("new_id"), F.desc("old_id"))
    taken = ordered.mapInArrow(greedy, "old_id long, new_id long")
    return taken.join(human.select(F.col("id").alias("old_id"), "person_id"), "old_id").select("new_id", "person_id")
