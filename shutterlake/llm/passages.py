"""Repeated passages by distributed prefix doubling over sampled suffixes.

A byte goes if some 400-byte string that covers it also starts anywhere else. Ranks are names: the
name of 2h bytes is made from the rank pair (h bytes here, h bytes at offset h), see ranks.py, so
equal strings have equal ranks wherever they stand, and Spark's sorts and groups of rank pairs tell
which positions still have company. Positions whose rank is unique leave; lengths grow from 64 to
369, 393 and 400 bytes, the threshold.

Not every suffix takes part. In each 400-byte window the place whose 64-byte rank is least is the
window's anchor; equal windows have their anchor at the same place, and consecutive windows mostly
share one. So the first round sorts about one position in a hundred, with the range of windows that
have it as their anchor. In each round a unit (a range of windows at fixed offsets from an anchor)
has two ranks: that of the bytes all its windows share (the core) and that of all its bytes (the
hull).

* a core that stands once: none of the windows repeats; the unit is done;
* a hull that stands twice: all of them repeat; the unit is done, its bytes go;
* else the unit is cut into ranges of 32, then 8, then 1 windows, whose cores are longer.

Only one unit of each hull goes on to the next round, so groups of copies cost what one costs, and a
text of many copies is looked at once (`distinct_texts`). Names have 64 bits and every decision rests
on two of them. What is left of prefix doubling's own form: ranks are made by doubling pairs inside
each text, positions leave when their rank is unique, and Spark's groups rerank the rest; ranks are
names, not places in a sorted order. `doubled_spans` is the plain form, every position reranked by
Spark sorts at offsets 1, 2, 4 ... 400; tests hold the two equal.

Edge cases: null text is empty; texts under 400 bytes lose nothing; strings within one document
count, overlapping or not; of two equal texts of 400 bytes and more nothing stays; repeated rows
are such texts (so ties need no order: all that repeat go); an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_batch, dealt, table, texts
from .ranks import anchors, covered, doubled, doubled_names, pair, scramble, word_names, word_places
from .words import runs

LENGTH, FIRST = 400, 64
#: Windows of a unit in the rounds after the first.
STEPS = (32, 8, 1)
#: Words of a repeated passage counted in words, and of the run by which its windows choose their anchors.
PASSAGE, RUN = 51, 8
#: Windows of a very long text that are scanned at once.
CHUNK = 1 << 20
#: Bytes of short texts that are scanned together.
_JOINED = 1 << 18
_U = np.uint64
#: Tells ranks of words from ranks of bytes.
_WORDS = _U(0xA0761D6478BD642F)
_SPANS_DDL = "array<struct<first:long,end:long>>"


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text; null as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _rank(names: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranks of the byte ranges, 256 to 768 bytes long, from ranks of 256 bytes at three offsets."""
    left = pair(names[start], names[np.minimum(start + 256, end - 256)])
    return pair(left, pair(names[end - 256], (end - start).astype(np.uint64)))


Units = tuple[np.ndarray, ...]


def first_units(text: bytes, chunk: int = CHUNK) -> Units:
    """(core rank, hull rank, anchor, first window, last window) of each anchor of a text; an anchor stands once."""
    parts = []
    for c in range(0, len(text) - LENGTH + 1, chunk):
        data = np.frombuffer(text[c : c + chunk + LENGTH - 1], np.uint8)
        names = doubled(data, (FIRST,))[FIRST]
        p, lo, hi = anchors(names, LENGTH - FIRST + 1)
        parts.append((names[p], _hull(names, lo, hi), p + c, lo + c, hi + c))
    if not parts:
        return ()
    core, hull, p, lo, hi = (np.concatenate([x[i] for x in parts]) for i in range(5))
    # an anchor whose windows lie in several parts is one unit: its first part's, to its last part's end
    start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    end = np.concatenate([start[1:], [len(p)]]) - 1
    last = hi[end]
    for u, v in zip(start[end > start].tolist(), last[end > start].tolist(), strict=True):
        names = doubled(np.frombuffer(text[lo[u] : v + LENGTH], np.uint8), (FIRST,))[FIRST]
        hull[u] = _hull(names, np.array([0]), np.array([v - lo[u]]))[0]
    return core[start], hull[start], p[start], lo[start], last


def _hull(names: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return covered(names, FIRST, lo, hi + LENGTH, 2 * LENGTH - FIRST)


def joined_units(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, Units]:
    """(text, first_units) of texts that stand in one array; windows that run over a text's edge are cut off."""
    names = doubled(data, (FIRST,))[FIRST]
    p, lo, hi = anchors(names, LENGTH - FIRST + 1)
    row = np.searchsorted(start, p, "right") - 1
    lo, hi = np.maximum(lo, start[row]), np.minimum(hi, end[row] - LENGTH)
    some = lo <= hi
    p, lo, hi, row = p[some], lo[some], hi[some], row[some]
    at = start[row]
    return row, (names[p], _hull(names, lo, hi), p - at, lo - at, hi - at)


def word_units(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: int) -> tuple[np.ndarray, Units]:
    """The same of windows of words: (core rank, hull rank, anchor's place, first window's first byte, last window's end)."""
    first, last = word_places(data)
    names = doubled_names(word_names(data, first, last), (RUN, 4 * RUN))
    p, lo, hi = anchors(names[RUN], words - RUN + 1)
    row = np.searchsorted(start, first[p], "right") - 1
    of = np.searchsorted(first, start), np.searchsorted(first, end)
    lo, hi = np.maximum(lo, of[0][row]), np.minimum(hi, of[1][row] - words)
    some = lo <= hi
    p, lo, hi, row = p[some], lo[some], hi[some], row[some]
    at = start[row]
    return row, (names[RUN][p] ^ _WORDS, covered(names[4 * RUN], 4 * RUN, lo, hi + words, 2 * words - RUN), first[p] - at, first[lo] - at, last[hi + words - 1] - at)


def _scan(chunk: int, words: int | None):
    """Units of bytes (kind 0), and of runs of words (kind 1) if asked for; short texts together."""

    def scan(batch: pa.RecordBatch):
        rows, cols, group, size = [], [[] for _ in range(6)], [], 0
        blobs = texts(batch)

        def add(kind: int, row: np.ndarray, units: Units) -> None:
            rows.append(row)
            for c, x in zip(cols, (np.full(len(row), kind), *units), strict=True):
                c.append(x)

        def flush() -> None:
            if not group:
                return
            which, n = np.array(group), np.array([len(blobs[i]) for i in group])
            data = np.frombuffer(b" ".join([blobs[i] for i in group]), np.uint8)
            end = np.cumsum(n + 1) - 1
            start = end - n
            if len(group) == 1 and n[0] > chunk:
                if units := first_units(blobs[group[0]], chunk):
                    add(0, np.zeros(len(units[0]), np.int64) + group[0], units)
            elif n.max() >= LENGTH:
                row, units = joined_units(data, start, end)
                add(0, which[row], units)
            if words:
                row, units = word_units(data, start, end, words)
                add(1, which[row], units)
            group.clear()

        for i, t in enumerate(blobs):
            if size + len(t) > _JOINED or max(size, len(t)) > chunk:
                flush()
                size = 0
            group.append(i)
            size += len(t)
        flush()
        kinds = (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64)
        kind, core, hull, p, lo, hi = (np.concatenate([*c, np.zeros(0, k)]) for c, k in zip(cols, kinds, strict=True))
        key = batch.column("key").take(pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))
        yield {"key": key, "kind": kind.astype(np.int32), "core": core.view(np.int64), "hull": hull.view(np.int64), "p": p.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)}

    return scan


def _contexts(words: int):
    """Kind 0: the bytes around each listed anchor that later rounds can ask for. Kind 1: the listed windows of words."""

    def run(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, _TEXTS):
            yield from some_texts(batch.slice(i, _TEXTS))

    def some_texts(batch: pa.RecordBatch):
        keys, out, at_words = batch.column("key").to_pylist(), [], []
        for key, t, units in zip(keys, texts(batch), batch.column("units").to_pylist(), strict=True):
            some = [u for u in units if u["kind"]]
            for u in units:
                if not u["kind"]:
                    p = u["p"]
                    at = max(0, p - (p - u["lo"]) // STEPS[0] * STEPS[0] - STEPS[0] + 1)
                    end = min(len(t), p - (p - u["hi"]) // STEPS[0] * STEPS[0] + LENGTH)
                    out.append((0, key, p, u["lo"], u["hi"], u["w"], len(t), at, t[at:end], None))
            if some:
                data = np.frombuffer(t, np.uint8)
                first, end = word_places(data)
                lo, hi = (np.searchsorted(x, [u[c] for u in some]) for x, c in ((first, "lo"), (end, "hi")))
                many = hi - words + 2 - lo
                at = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at_words.append((key, np.repeat([u["w"] for u in some], many), first[at], end[at + words - 1], runs(word_names(data, first, end), words)[at]))
        kinds = (pa.int32(), pa.binary(), *[pa.int32()] * 6, pa.binary(), pa.int64())
        if out:
            yield {n: pa.array(c, k) for n, c, k in zip(_CONTEXT, zip(*out, strict=True), kinds, strict=True)}
        if at_words:
            n = [len(x[4]) for x in at_words]
            w, first, end, h = (np.concatenate([x[k] for x in at_words]) for k in (1, 2, 3, 4))
            given = {"kind": np.ones(sum(n), np.int32), "key": pa.array([x[0] for x in at_words], pa.binary()).take(pa.array(np.repeat(np.arange(len(n)), n))), "w": w.astype(np.int32), "lo": first.astype(np.int32), "hi": end.astype(np.int32), "h": h.view(np.int64)}
            yield {c: given[c] if c in given else pa.nulls(sum(n), k) for c, k in zip(_CONTEXT, kinds, strict=True)}

    return run


#: Texts whose windows of words are listed at once.
_TEXTS = 64
_CONTEXT = ("kind", "key", "p", "lo", "hi", "w", "n", "at", "bytes", "h")


#: Contexts whose ranks are made together.
_TOGETHER = 2048


def _units(step: int):
    """Units of step windows from wider units, with their ranks."""

    def cut(batch: pa.RecordBatch):
        for s in range(0, batch.num_rows, _TOGETHER):
            yield part(batch.slice(s, _TOGETHER))

    def part(batch: pa.RecordBatch) -> dict:
        p, lo, hi, n, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("p", "lo", "hi", "n", "at"))
        blobs = batch.column("bytes").to_pylist()
        length = np.array([len(b) for b in blobs], np.int64)
        # ranks that run over a context's end are never asked for
        names = doubled(np.frombuffer(b"".join(blobs), np.uint8), (256,))[256]
        base = np.cumsum(length) - length - at
        j0 = (p - hi) // step
        many = (p - lo) // step - j0 + 1
        row = np.repeat(np.arange(len(p)), many)
        j = j0[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        first, last = p[row] - j * step - step + 1, p[row] - j * step
        some = (last >= 0) & (first <= n[row] - LENGTH)
        row, j, first, last = row[some], j[some], first[some], last[some]
        salt, b = scramble(j.astype(np.uint64) + _U(step << 32)), base[row]
        core = pair(_rank(names, last + b, first + LENGTH + b), salt)
        whole = (first >= 0) & (last <= n[row] - LENGTH)
        hull = np.empty(len(row), np.uint64)
        hull[whole] = pair(_rank(names, first[whole] + b[whole], last[whole] + LENGTH + b[whole]), ~salt[whole])
        keys = batch.column("key")
        for i in np.flatnonzero(~whole).tolist():  # a unit over the text's edge has a hull of its own
            own = keys[int(row[i])].as_py() + int(p[row[i]]).to_bytes(8) + int(j[i]).to_bytes(8)
            hull[i] = int.from_bytes(hashlib.md5(own).digest()[:8])
        taken = pa.array(row, pa.int64())
        return {
            **{c: batch.column(c).take(taken) for c in ("key", "p", "w")},
            "core": core.view(np.int64),
            "hull": hull.view(np.int64),
            "lo": first.astype(np.int32),
            "hi": last.astype(np.int32),
        }

    return by_batch("key binary, p int, w int, core long, hull long, lo int, hi int", cut)


def _rerank(units: DataFrame, scratch: Scratch, name: str, more: tuple[str, ...] = (), asked: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, of those asked about, whose hull repeats: key, lo, hi and more; one unit of each hull that must be cut further).

    w: 2 for a unit that stands for several, whose bytes an earlier round has taken. What is grouped
    is written before it is joined, so that both sides of each join are dealt for it, and a core or
    hull that very many units share can be split.
    """
    hulls = units.groupBy("core", "hull").agg(F.sum("w").alias("c"), F.min(F.struct("key", "p", "lo", "hi", *more)).alias("u"))
    hulls = scratch.save(hulls, f"hulls-{name}")
    again = units.filter("w = 1").filter(asked if asked is not None else F.lit(True)).join(hulls.filter("c > 1").select("core", "hull"), ["core", "hull"]).select("key", "lo", "hi", *more)
    cores = hulls.groupBy("core").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 and least = 1").select("core")
    cores = scratch.save(cores, f"cores-{name}")
    on = hulls.join(cores, "core").select("u.*", F.least("c", F.lit(2)).cast("int").alias("w"))
    return again, on


def distinct_texts(docs: DataFrame) -> DataFrame:
    """key, text, copies: each text once. Copies meet where they are first, so a text of very many moves as a few rows."""
    keyed = docs.select(text_key(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    return keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def repeated_spans(docs: DataFrame, chunk: int = CHUNK, words: int | None = None) -> DataFrame:
    """key, spans, passages: for each text (by text_key) that loses any, disjoint byte ranges in order.

    spans: what windows of LENGTH bytes cover that stand anywhere else too. passages: the same of windows
    of so many words (runs of [^\\x20\\x09-\\x0D], as written), if words is given. A window of words
    has its least run of RUN words as its anchor, as a window of bytes has its least 64 bytes; both
    take part in the same rounds up to where texts are looked at again.
    """
    if words and words < 4 * RUN:
        raise ValueError(f"windows have at least {4 * RUN} words")
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("text").cast("string").alias("text")).withColumn("key", text_key(F.col("text")))
    least = min(LENGTH, 2 * words - 1) if words else LENGTH
    units = by_batch("key binary, kind int, core long, hull long, p int, lo int, hi int", _scan(chunk, words))(docs.filter(F.octet_length("text") >= least))
    units = scratch.save(units, "units")
    # each core's commonest hull is settled by the join that finds company: a passage that very many texts share needs no more
    counts = units.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"))
    company = counts.groupBy("core").agg(F.sum("n").alias("n"), F.max(F.struct("n", "hull")).alias("top"), F.count(F.lit(1)).alias("hulls")).filter("n > 1")
    company = company.select("core", F.when(F.col("top.n") > 1, F.col("top.hull")).alias("top"), (F.col("hulls") == 1).alias("same"))
    company = scratch.save(company, "company")
    units = scratch.save(units.join(dealt(company), "core").withColumn("w", F.lit(1)), "shared")
    scratch.drop("units", "company")
    scratch.settle()
    # a core that has one hull alone repeats as a whole wherever it stands: only others need ranks
    again, on = _rerank(units.filter("not same"), scratch, "0", ("kind",), F.coalesce(F.col("hull") != F.col("top"), F.lit(True)))
    found = [again.unionByName(units.filter("hull = top").select("key", "lo", "hi", "kind"))]

    asked = on.groupBy("key").agg(F.collect_list(F.struct("kind", "p", "lo", "hi", "w")).alias("units"))
    around = distinct_texts(docs.filter(F.octet_length("text") >= least)).join(dealt(asked), "key")
    around = scratch.save(by_batch("kind int, key binary, p int, lo int, hi int, w int, n int, at int, bytes binary, h long", _contexts(words or 0))(around), "around")
    scratch.settle()
    near = around.filter("kind = 0")
    for k, step in enumerate(STEPS, 1):
        if k == 1:
            wide = near
        else:
            wide = on.join(dealt(near.select("key", "p", "n", "at", "bytes")), ["key", "p"])
        units = scratch.save(_units(step)(wide.select("key", "p", "lo", "hi", "w", "n", "at", "bytes")), f"units-{k}")
        again, on = _rerank(units, scratch, str(k))
        found.append(again)
        scratch.settle()
    ends = lambda df: df.select("key", "kind", "lo", F.when(F.col("kind") == 0, F.col("hi") + LENGTH).otherwise(F.col("hi")).alias("hi"))
    windows = ends(found[0])
    for x in found[1:]:
        windows = windows.unionByName(ends(x.withColumn("kind", F.lit(0))))
    if words:
        at = around.filter("kind = 1")
        twice = scratch.save(at.groupBy("h").agg(F.sum("w").alias("c")).filter("c > 1").select("h"), "twice")
        windows = windows.unionByName(at.filter("w = 1").join(dealt(twice), "h").select("key", "kind", "lo", "hi"))
    grouped = windows.groupBy("key").agg(F.collect_list(F.struct("kind", "lo", "hi")).alias("w"))
    return scratch.only(by_batch(f"key binary, spans {_SPANS_DDL}, passages {_SPANS_DDL}", _join_windows)(grouped), "spans")


def _join_windows(batch: pa.RecordBatch):
    """What overlaps or meets is one range, for each kind."""
    lists, out = batch.column("w"), {"key": batch.column("key")}
    kind, lo, hi = (c.to_numpy().astype(np.int64) for c in lists.flatten().flatten())
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    for k, name in enumerate(("spans", "passages")):
        of = kind == k
        r, a, b = row[of], lo[of], hi[of]
        order = np.lexsort((a, r))
        r, a, b = r[order], a[order], b[order]
        far = np.int64(b.max() + 1) if len(b) else np.int64(1)  # rows after one another on one line
        reach = np.maximum.accumulate(b + r * far) if len(b) else b
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] + r[1:] * far > reach[:-1])])[: len(r)]
        at = np.flatnonzero(new)
        end = np.maximum.reduceat(b, at) if len(at) else b
        offsets = np.concatenate([[0], np.cumsum(np.bincount(r[at], minlength=batch.num_rows))]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(a[at], pa.int64()), pa.array(end, pa.int64())], ["first", "end"])
        out[name] = pa.ListArray.from_arrays(pa.array(offsets), values)
    yield out


def doubled_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, p: where strings of the given length stand that stand anywhere else too, by plain prefix doubling.

    The definition that repeated_spans prunes, without anchors: every byte position takes part, and
    Spark sorts the rank pairs (rank of h bytes at p, rank of h bytes at p + h) at offsets 1, 2, 4 and
    so on, the last one cut to the length; equal pairs have equal ranks in the order of the bytes.
    Positions whose pair is unique leave. For small tables: it moves a row a byte.
    """
    scratch = Scratch(docs.sparkSession)
    bytes_of = F.split(F.regexp_replace(F.hex(F.col("text").cast("binary")), "(..)", "$1 "), " ")
    pos = distinct_texts(docs).filter(F.octet_length("text") >= length).select("key", F.least("copies", F.lit(2)).alias("w"), F.posexplode(bytes_of).alias("p", "b")).filter("b <> ''")
    pos, h = scratch.save(pos.select("key", "w", "p", F.conv("b", 16, 10).cast("long").alias("r")), "pos-0"), 1
    while h < length:
        step = min(h, length - h)
        pairs = pos.join(pos.select("key", (F.col("p") - step).alias("p"), F.col("r").alias("s")), ["key", "p"])
        equal = pairs.groupBy("r", "s").agg(F.sum("w").alias("c")).filter("c > 1").drop("c")
        parts = scratch.save(equal.repartitionByRange("r", "s").sortWithinPartitions("r", "s").withColumn("part", F.spark_partition_id()), f"parts-{h}")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
        base = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        rank = F.row_number().over(Window.partitionBy("part").orderBy("r", "s")) + F.col("base")
        ranks = parts.join(F.broadcast(base), "part").select("r", "s", rank.cast("long").alias("rank"))
        h += step
        pos = scratch.save(pairs.join(ranks, ["r", "s"]).select("key", "w", "p", F.col("rank").alias("r")), f"pos-{h}")
    return pos.select("key", "p")


def kept_bytes(text: bytes, spans: list[dict]) -> bytes:
    """What stays of a text without the spans."""
    out, at = [], 0
    for s in spans or ():
        out.append(text[at : s["first"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


def cut_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans, kept (the bytes that stay) of each row."""
    spans = repeated_spans(docs).select(F.col("key").alias("k"), "spans")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    joined = docs.join(dealt(spans), text_key(docs["text"]) == spans["k"], "left").drop("k")

    def cut(batch: pa.RecordBatch):
        kept = [kept_bytes(t, s) for t, s in zip(texts(batch), batch.column("spans").to_pylist(), strict=True)]
        yield {c: batch.column(c) for c in ("doc_id", "text", "spans")} | {"kept": pa.array(kept, pa.binary())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(f"doc_id {kind}, text string, spans array<struct<first:long,end:long>>, kept binary", cut)(joined)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses; and, of passages of PASSAGE words and more that stand elsewhere too whatever their bytes, how many it has (n_passages) and their words (n_passage_words)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    spans = repeated_spans(docs, words=PASSAGE).withColumnRenamed("key", "k")
    joined = docs.join(dealt(spans), text_key(docs["text"]) == spans["k"], "left").drop("k")

    def digest(batch: pa.RecordBatch):
        rows = [(t, s or [], kept_bytes(t, s), q or []) for t, s, q in zip(texts(batch), *(batch.column(c).to_pylist() for c in ("spans", "passages")), strict=True)]
        yield {
            "doc_id": batch.column("doc_id"),
            "n_bytes": pa.array([len(t) for t, _, _, _ in rows], pa.int64()),
            "n_removed": pa.array([len(t) - len(k) for t, _, k, _ in rows], pa.int64()),
            "n_spans": pa.array([len(s) for _, s, _, _ in rows], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for _, _, k, _ in rows], pa.string()),
            "n_passages": pa.array([len(q) for _, _, _, q in rows], pa.int64()),
            "n_passage_words": pa.array([sum(len(t[x["first"] : x["end"]].split()) for x in q) for t, _, _, q in rows], pa.int64()),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long", digest)(joined)


OP4_SQL = r"""
WITH t AS (SELECT row_number() OVER () r, doc_id, encode(coalesce(text, '')) h FROM documents),
g AS (SELECT r, p, md5(h[p + 1:p + 400]) m FROM t, unnest(range(0, CAST(octet_length(h) - 399 AS BIGINT))) AS u(p)),
dup AS (SELECT m FROM g GROUP BY m HAVING count(*) > 1),
s AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) d FROM g WHERE m IN (SELECT m FROM dup)),
b AS (SELECT r, p, sum(CASE WHEN d IS NULL OR d > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) k FROM s),
x AS (SELECT r, k, min(p) a, max(p) + 400 e FROM b GROUP BY r, k),
o AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) f FROM x),
v AS (SELECT r, regexp_extract_all(coalesce(decode(h), ''), '[^\x20\x09-\x0D]+') w FROM t),
vw AS (SELECT r, p, md5(array_to_string(w[p:p + 50], ' ')) m FROM v, unnest(range(1, CAST(len(w) - 49 AS BIGINT))) AS u(p)),
vs AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) d FROM vw WHERE m IN (SELECT m FROM vw GROUP BY m HAVING count(*) > 1)),
vx AS (SELECT r, k, max(p) - min(p) + 51 c FROM (SELECT r, p, sum(CASE WHEN d IS NULL OR d > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) k FROM vs) GROUP BY r, k),
vq AS (SELECT r, count(*) np, sum(c) nw FROM vx GROUP BY r),
q AS (SELECT o.r, count(*) n, sum(e - a) c, max(e) z, string_agg(CASE WHEN a > f THEN hex(h[f + 1:a]) ELSE '' END, '' ORDER BY a) kept FROM o JOIN t USING (r) GROUP BY o.r)
SELECT doc_id, CAST(octet_length(h) AS BIGINT) n_bytes, CAST(coalesce(c, 0) AS BIGINT) n_removed, CAST(coalesce(n, 0) AS BIGINT) n_spans,
       sha256(CASE WHEN n IS NULL THEN h ELSE unhex(kept || CASE WHEN octet_length(h) > z THEN hex(h[z + 1:octet_length(h)]) ELSE '' END) END) kept_sha256,
       CAST(coalesce(np, 0) AS BIGINT) n_passages, CAST(coalesce(nw, 0) AS BIGINT) n_passage_words
FROM t LEFT JOIN q USING (r) LEFT JOIN vq USING (r)
"""
