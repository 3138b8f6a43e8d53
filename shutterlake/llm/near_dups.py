"""Near-duplicate documents: SuperMinHash, banding, verification and union-find grouping.

Texts become sets of 5-word shingles (64-bit hashes). Documents of equal sets are one class from
the start, so copies cost no pairs. Classes get SuperMinHash signatures of 192 slots in 32 bands of
6; classes that share a band are candidates: two of likeness 0.85 share none with a chance under
3 in 10 million. Candidates are linked in steps that emit no group's pairs:

1. star: of each band's group, every member is paired with the member that stands in the most and
   largest groups (the likely original);
2. more stars, for groups of over MANY blocks of members that the links so far leave in several components:
   every member outside the group's largest component is paired with a member of it, another in
   each round, as long as a round halves such groups' members; so a group of near copies costs
   rounds times members;
3. rest: where the links so far leave a group in several components, all pairs across components
   whose signatures agree enough (five standard errors under the limit: 0.72) and whose sizes
   allow the limit, each in the first band that the two share. Large groups are dealt out in
   blocks against blocks. First the members that have such a partner are found, then their texts
   join them, and each block verifies its pairs, the most alike first, passing over those that its
   links have connected meanwhile; only links leave it.

Every link is verified on the full sets of both texts, and the links' components are the result.

Edge cases: A-Z are lower-cased and words are runs of [^\\x20\\x09-\\x0D]; a text of fewer than 5
words is one shingle, all of it; null texts and texts without words are empty and linked with
nothing; repeated rows are linked if they have a word; rows without a doc_id take part, and get the
least id of their component, or null if it has none; rows of one doc_id and unlike texts are told
apart, though both bear it; an empty table gives an empty result; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_batch, dealt, table, texts
from .components import UnionFind, components
from .superminhash import bands, brief, signature
from .words import identities, runs, spaced_words

WORDS, SLOTS, ROWS = 5, 192, 6
#: Least likeness, in hundredths.
PERCENT = 85
#: Members of a block when a large group is dealt out.
BLOCK = 256
#: Blocks from which on a group gets more stars first: dealing it out writes each member so many times.
MANY = 8
#: Classes without a doc_id of their own have numbers from here on.
NAMELESS = 1 << 62


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """The distinct hashes of n consecutive words; of all words if they are fewer; ascending."""
    w = identities(spaced_words(text))
    if not len(w):
        return w
    if len(w) < n:
        return np.array([xxhash.xxh3_64_intdigest(w.tobytes(), seed=len(w))], np.uint64)
    return np.unique(runs(w, n))


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two shingle sets have at least the given Jaccard likeness."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_agreement(percent: int, slots: int) -> float:
    """The signatures' agreement under which a pair isn't verified: five standard errors under the limit."""
    p = percent / 100
    return p - 5 * (p * (1 - p) / slots) ** 0.5


def _describe(n: int, slots: int, rows: int):
    def f(batch: pa.RecordBatch):
        size, mark, sig, band = [], [], [], []
        for t in texts(batch):
            s = shingles(t, n)
            g = signature(s, slots)
            size.append(len(s))
            mark.append(xxhash.xxh3_128_digest(s.tobytes()))
            sig.append(brief(g).tobytes())
            band.append(bands(g, rows).view(np.int64) if len(s) else None)
        yield {
            "doc_id": batch.column("doc_id"),
            "n_shingles": pa.array(size, pa.int64()),
            "mark": pa.array(mark, pa.binary()),
            "text_key": batch.column("text_key"),
            "sig": pa.array(sig, pa.binary()),
            "bands": pa.array(band, pa.list_(pa.int64())),
        }

    return f


def _agreement(percent: int):
    """Pairs whose signatures agree enough to be worth verification."""

    def run(batch: pa.RecordBatch):
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
        keep = pa.array((a == b).mean(axis=1) >= least_agreement(percent, a.shape[1]))
        yield {c: batch.column(c).filter(keep) for c in ("a", "b")}

    return run


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node: int, text: bytes) -> np.ndarray:
            if node in known:
                known.move_to_end(node)
                return known[node]
            s = known[node] = shingles(text, n)
            if len(known) > 64:
                known.popitem(last=False)
            return s

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = texts(batch, "text_a"), texts(batch, "text_b")
            keep = pa.array([alike(of(i, x), of(j, y), percent) for i, j, x, y in zip(a, b, ta, tb, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(keep) for c in ("a", "b")})

    return run


class _Block:
    """The rows of one block pair (h, i, j): which pairs in it are open."""

    def __init__(self, rows: list[tuple], percent: int):
        self.rows, self.percent = rows, percent
        self.sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint16).reshape(len(rows), -1)
        self.bands = np.array([r[8] for r in rows], np.int64)
        self.band = int(np.flatnonzero(self.bands[0] == rows[0][0])[0])
        self.node, self.comp, self.size, self.block = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 6, 7))

    def open_with(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows after x, or of the other block, that may be linked to x from another component; and how far signatures agree."""
        same = self.rows[0][1] == self.rows[0][2]
        ok = np.arange(len(self.rows)) > x if same else self.block > self.block[x]
        ok &= (self.comp != self.comp[x]) & (100 * np.minimum(self.size, self.size[x]) >= self.percent * np.maximum(self.size, self.size[x]))
        at = np.flatnonzero(ok)
        at = at[np.argmax(self.bands[at] == self.bands[x], axis=1) == self.band] if len(at) else at
        agree = (self.sig[at] == self.sig[x]).mean(axis=1) if len(at) else np.zeros(0)
        good = agree >= least_agreement(self.percent, self.sig.shape[1])
        return at[good], agree[good]


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows of one (h, i, j), which follow one another, together."""
    group: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if group and r[:3] != group[0][:3]:
                yield group
                group = []
            group.append(r)
    if group:
        yield group


_ROW = ("h", "i", "j", "node", "comp", "sig", "n", "block", "bands")


def _open_members(percent: int):
    """The members of each block pair that have a partner to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, _ROW):
            g = _Block(rows, percent)
            used = np.zeros(len(rows), bool)
            for x in range(len(rows)):
                at, _ = g.open_with(x)
                used[at] = True
                used[x] |= len(at) > 0
            if used.any():
                keep = [r for r, u in zip(rows, used.tolist(), strict=True) if u]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*keep, strict=True), _KINDS, strict=True)], list(_ROW))

    return run


_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()))


def _links(n: int, percent: int):
    """Links between components of each block pair: no more than join what is alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, (*_ROW, "text")):
            g, sets, joined, found = _Block(rows, percent), {}, UnionFind(), []
            pairs = sorted((-a, x, y) for x in range(len(rows)) for y, a in zip(*(v.tolist() for v in g.open_with(x)), strict=True))
            for _, x, y in pairs:
                if joined.root(int(g.comp[x])) != joined.root(int(g.comp[y])):
                    for z in (x, y):
                        if z not in sets:
                            sets[z] = shingles((rows[z][9] or "").encode(), n)
                    if alike(sets[x], sets[y], percent):
                        joined.join(int(g.comp[x]), int(g.comp[y]))
                        found.append((int(g.node[x]), int(g.node[y])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([max(p) for p in found], pa.int64()), "b": pa.array([min(p) for p in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    out = groups(docs, words, percent, slots, rows)
    comp = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).cast(docs.schema["doc_id"].dataType)
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text_key of the documents that stay: of each group the least doc_id (null last, then the least text_key), and all without words.

    Rows of equal doc_id and text are one document and stand here once, those without a doc_id too.
    """
    found = groups(docs, **how)
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    first = found.filter("n_shingles > 0").groupBy("group").agg(F.min(order).alias("m")).select("m.doc_id", "m.text_key")
    return first.unionByName(found.filter("n_shingles = 0").select("doc_id", "text_key").distinct())


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, group, least for each row of docs (doc_id, text).

    group: a number of the component, null without words; least: its least doc_id, null if it has none.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = by_batch(f"doc_id {kind}, n_shingles long, mark binary, text_key long, sig binary, bands array<long>", _describe(words, slots, rows))(docs)
    described = scratch.save(described, "described")
    per_doc = scratch.save(described.select("doc_id", "text_key", "n_shingles", "mark"), "per-doc")
    named = described.filter("n_shingles > 0")
    classes = named.groupBy("mark").agg(F.min("doc_id").cast("long").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch.save(classes, "classes")
    # a class goes by its least doc_id; by a number of its own if it has none, or another class has the same
    twice = scratch.save(classes.filter("least is not null").groupBy(F.col("least").alias("l")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("l"), "twice")
    own, shared_ids = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("mark"), 2), not twice.isEmpty()
    node = F.coalesce("least", own)
    if shared_ids:
        classes, node = classes.join(dealt(twice), F.col("least") == F.col("l"), "left"), F.when(F.col("l").isNull(), node).otherwise(own)
    classes = classes.select("mark", "least", "rep", "n", "sig", "bands", node.alias("node"))
    nodes = scratch.save(classes.select("mark", "node", "least"), "nodes")
    scratch.drop("described")
    scratch.settle()

    # candidates: classes that share a band with another; groups are written before they are joined,
    # so that both sides are dealt for the join and a band that very many classes share can be split
    banded = classes.select(F.explode("bands").alias("h"), "node")
    shared = scratch.save(banded.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared")
    members = scratch.save(banded.join(shared, "h"), "members")
    weight = members.groupBy("node").agg(F.sum("c").alias("w"))
    ranked = members.join(weight, "node")
    heads = ranked.groupBy("h").agg(F.max(F.struct("w", (-F.col("node")).alias("minus"))).alias("top")).select("h", (-F.col("top.minus")).alias("head"))
    heads = scratch.save(heads, "heads")
    star = members.join(heads, "h").filter("node <> head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()

    likely = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "rep", "n", "sig", "bands")
    likely = scratch.save(likely, "likely")
    scratch.drop("classes")

    def promising(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) whose sizes and signatures allow the limit."""
        side = lambda s: likely.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("n").alias(f"n_{s}"))
        sizes_allow = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(sizes_allow).select("a", "b", "sig_a", "sig_b")
        return scratch.save(by_batch("a long, b long", _agreement(percent))(both), name)

    star = promising(star, "star")
    scratch.settle()

    # texts of the classes that any verification may need
    reps = likely.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    full = docs.join(dealt(reps), (docs["text_key"] == reps["rep_key"]) & docs["doc_id"].eqNullSafe(reps["rep_id"])).select("node", "text").dropDuplicates(["node"])
    full = scratch.save(full, "full")
    scratch.settle()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        t = lambda s: full.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
        return scratch.save(pairs.join(dealt(t("a")), "a").join(dealt(t("b")), "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, percent), "a long, b long"), name)

    links = verified(star, "links-1")
    comps = scratch.save(components(links, scratch, "cc1"), "comps-1")

    # groups that the links leave in several components, their head aside: it was paired with all
    def open_groups(name: str) -> DataFrame:
        of = comps.select("node", F.col("component").alias("comp"))
        rest = members.filter("c > 2").join(heads, "h").filter("node <> head").drop("head")
        rest = rest.join(of, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        split = rest.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("h")
        return scratch.save(rest.join(scratch.save(split, f"split-{name}"), "h"), f"open-{name}")

    rest, k, before, is_large = open_groups("1"), 1, None, F.col("c") > MANY * BLOCK
    while (large := rest.filter(is_large).count()) and (before is None or 2 * large <= before):
        k, before = k + 1, large
        sizes = rest.filter(is_large).groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct(F.xxhash64("node", F.lit(k)), "node")).alias("one"))
        chosen = sizes.groupBy("h").agg(F.max(F.struct("m", "comp", "one")).alias("top")).select("h", F.col("top.comp").alias("main"), F.col("top.one.node").alias("head"))
        chosen = scratch.save(chosen, f"heads-{k}")
        pairs = rest.join(chosen, "h").filter("comp <> main").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
        found = verified(promising(pairs, f"star-{k}"), f"links-1-{k}")
        if not found.isEmpty():
            links = links.unionByName(found)
            comps = scratch.save(components(links, scratch, f"cc1-{k}"), f"comps-1-{k}")
            rest = open_groups(str(k))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    rest = rest.withColumn("o", other).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
    rest = rest.join(likely.select("node", "sig", "n", "bands"), "node").select(*_ROW)
    in_blocks = lambda df: df.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    rest = scratch.save(in_blocks(rest).mapInArrow(_open_members(percent), "h long, i int, j int, node long, comp long, sig binary, n long, block int, bands array<long>"), "rest")
    if not rest.isEmpty():
        more = in_blocks(rest.join(dealt(full), "node").select(*_ROW, "text")).mapInArrow(_links(words, percent), "a long, b long")
        more = scratch.save(more, "links-2")
        if not more.isEmpty():
            comps = scratch.save(components(links.unionByName(more), scratch, "cc2"), "comps-2")

    scratch.drop("full", "rest", "star", "members", "likely", "shared", "heads", *[f"{x}-{i}" for x in ("split", "open", "heads", "star") for i in range(1, k + 1)])
    known = nodes.join(comps, "node", "left").select(F.col("mark").alias("m"), F.coalesce("component", "node").alias("c"), "least")
    if shared_ids:
        known = scratch.save(known, "known")
        known = known.drop("least").join(dealt(known.groupBy("c").agg(F.min("least").alias("least"))), "c")
    else:
        known = known.withColumn("least", F.when(F.col("c") < NAMELESS, F.col("c")))
    out = per_doc.join(known, per_doc["mark"] == known["m"], "left")
    out = out.select("doc_id", "text_key", "n_shingles", F.col("c").alias("group"), "least")
    return scratch.only(out, "result")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id x, b.doc_id y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) m FROM r GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = w.doc_id
"""
