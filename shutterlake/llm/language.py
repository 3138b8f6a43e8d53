"""Language of pages by Bayesian fusion of evidence.

Four pieces of evidence about a page's language are multiplied, each as a likelihood or a prior:

* its visible text, under byte trigram models of the languages;
* the language that its markup declares (<html lang=...>);
* its address suffix: the last label of the host and the first path part of two letters;
* its host, as a prior smoothed along a hierarchy: the host's own pages, drawn towards those of its
  registered domain, these towards its last label, these towards all pages.

The trigram models are fitted on labelled documents. How far declarations and suffixes can be
believed, and the hosts' priors, are then learnt from the pages themselves: each page's text gives
probabilities of the languages, and grouped sums of these count each declaration, suffix, domain
and host. A page's own share is taken out of its host's and domain's counts before they judge it.

Bounds: the models come from about ``MOST_LABELLED`` labelled documents at most, chosen by a hash of
their id; they have ``BUCKETS`` entries a language. Sums by declaration are broadcast: there are at
most 18,253 codes of two or three letters. Hosts, domains, last labels and suffixes grow with the
pages, so they are dealt by key at every size, from written tables, so that Spark can split hot keys.

Edge cases: null or empty html has no text and no declaration; a null url, or one without "://",
has an empty host, which has pages like any other; without any evidence the prior of all pages
decides; ties go to the language first in code point order; repeated rows count as pages of their
own; empty pages or no labelled documents give an empty result or a null language. Columns besides
the named ones are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_batch, dealt, table, texts
from .url_filter import url_host, url_path

BUCKETS = 1 << 15
MOST_LABELLED, MOST_LANGUAGES = 4_000, 64
#: Trigrams of one text overlap and repeat, so their evidence counts for less; in log units, at most MOST_TEXT.
TEMPER, MOST_TEXT = 0.15, 12.0
#: Pages that the level above counts for, and that a declaration or suffix must overcome.
DRAW, DOUBT = 4.0, 2.0
_TAG = re.compile(rb"(?is)<!--|<(script|style)\b|<[^>]*>")
_END = {b"script": re.compile(rb"(?is)</script\s*>"), b"style": re.compile(rb"(?is)</style\s*>")}
_HTML = re.compile(rb"(?is)<html\b[^>]*")
_LANG = re.compile(rb"(?is)\blang\s*=\s*[\"']?\s*([a-z]{2,3})")


def visible(html: bytes) -> bytes:
    """The text outside tags, comments, scripts and styles, lower-cased as ASCII; what isn't closed hides nothing but its tag.

    One scan: it stops at the last >, and an end that isn't found once isn't looked for again.
    """
    out, at, unclosed, last = [], 0, set(), html.rfind(b">") + 1
    while m := _TAG.search(html, at, last):
        out.append(html[at : m.start()])
        kind = m[1].lower() if m[1] else b"--" if m[0] == b"<!--" else b""
        end = -1
        if kind and kind not in unclosed:
            if kind == b"--":
                end = found + 3 if (found := html.find(b"-->", m.end())) >= 0 else -1
            elif x := _END[kind].search(html, m.end()):
                end = x.end()
            if end < 0:
                unclosed.add(kind)
        at = m.end() if not kind else end if end >= 0 else html.find(b">", m.end()) + 1
    return b" ".join([*out, html[at:]]).lower()


def declared(html: bytes) -> str | None:
    """The language that the first html tag declares."""
    tag = _HTML.search(html)
    m = _LANG.search(tag[0]) if tag else None
    return m[1].decode().lower() if m else None


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each three bytes; runs of white space are one space."""
    d = np.frombuffer(b" " + b" ".join(text.split()) + b" ", np.uint8).astype(np.uint32)
    return ((d[:-2] * 961 + d[1:-1] * 31 + d[2:]) * 2654435761 >> np.uint32(7)) % BUCKETS


def fit(docs: DataFrame, most_labelled: int = MOST_LABELLED) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bucket in each language) from labelled documents.

    Of more than most_labelled documents about that many take part: those whose id's hash is under
    the share. Trigrams are counted where the documents are, and sums of buckets meet on the driver.
    """
    rows = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    n = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if n > most_labelled:
        rows = rows.filter(F.xxhash64("doc_id", F.lit(7)) < F.lit(int((most_labelled / n - 0.5) * 2.0**64)))

    def count(batches):
        by: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), texts(b), strict=True):
                c = np.bincount(trigrams(t.lower()), minlength=BUCKETS)
                by[lang] = by[lang] + c if lang in by else c
        for lang, c in by.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(c[at])})

    sums = rows.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got: dict[str, np.ndarray] = {}
    for r in sums.limit(MOST_LANGUAGES * BUCKETS + 1).collect():
        got.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(got)
    counts = np.array([got[x] for x in langs]) if langs else np.zeros((0, BUCKETS))
    counts = counts + 0.5
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _added(arrays: Column, n: int) -> Column:
    """The sum of arrays of n numbers, place by place."""
    return F.array(*[F.sum(arrays[i]) for i in range(n)])


def identify(pages: DataFrame, docs: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """page_id, host, lang, probability, text_lang, declared for each row of pages (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession)
    langs, model = fit(docs, most_labelled)
    kind = pages.schema["page_id"].dataType.simpleString()
    if not langs:
        return pages.select("page_id", url_host(F.col("url")).alias("host"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    n = len(langs)

    def read(batch: pa.RecordBatch):
        logs, said, own = shared.value, [], []
        for h in texts(batch, "html"):
            t = visible(h)
            said.append(declared(h))
            x = TEMPER * logs[:, trigrams(t)].sum(axis=1) if t.strip() else np.zeros(n)
            own.append(np.maximum(x - x.max(), -MOST_TEXT))
        own = np.array(own)
        t = np.exp(own)
        t /= t.sum(axis=1, keepdims=True)
        as_list = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, n, dtype=np.int32)), pa.array(a.ravel()))
        yield {c: batch.column(c) for c in ("page_id", "host", "suffix")} | {"said": pa.array(said, pa.string()), "x": as_list(own), "t": as_list(t)}

    host, path = url_host(F.col("url").cast("string")), url_path(F.col("url").cast("string"))
    part = F.regexp_extract(path, r"\A/([a-z]{2})(/|\z)", 1)
    suffix = F.concat_ws("/", F.substring_index(host, ".", -1), part)
    rows = pages.select("page_id", host.alias("host"), suffix.alias("suffix"), F.col("html").cast("string").alias("html"))
    rows = by_batch(f"page_id {kind}, host string, suffix string, said string, x array<double>, t array<double>", read)(rows)
    rows = scratch.save(rows.withColumns({"domain": domain(F.col("host")), "top": F.substring_index("host", ".", -1), "said": F.coalesce("said", F.lit(""))}), "read")

    # each level's sums come from those below; a page then meets them all in one join, by host and suffix
    pairs = scratch.save(rows.groupBy("host", "suffix").agg(F.first("domain").alias("domain"), F.first("top").alias("top"), _added(F.col("t"), n).alias("n")), "pairs")
    said = rows.groupBy("said").agg(_added(F.col("t"), n).alias("said_n"))  # codes of two or three letters: at most 18,253 rows
    up = lambda df, by, keep=(), name="n": df.groupBy(by).agg(_added(F.col(name), n).alias(f"{by}_n"), *[F.first(c).alias(c) for c in keep])
    hosts = scratch.save(up(pairs, "host", ("domain", "top")), "hosts")
    domains = scratch.save(up(hosts, "domain", ("top",), "host_n"), "domains")
    tops = scratch.save(up(domains, "top", (), "domain_n"), "tops")
    suffixes = scratch.save(up(pairs, "suffix"), "suffixes")
    whole = tops.agg(*[F.coalesce(F.sum(F.col("top_n")[i]), F.lit(0.0)).alias(f"all{i}") for i in range(n)]).first()
    total = sum(whole) or 1.0
    base = [(w + 1) / (total + n) for w in whole]
    places = pairs.select("host", "suffix", "domain", "top").join(dealt(hosts.select("host", "host_n")), "host")
    places = places.join(dealt(domains.select("domain", "domain_n")), "domain").join(dealt(tops), "top").join(dealt(suffixes), "suffix")
    places = scratch.save(places.select("host", "suffix", "host_n", "domain_n", "top_n", "suffix_n"), "places")
    out = rows.drop("domain", "top").join(dealt(places), ["host", "suffix"]).join(F.broadcast(said), "said")

    scores = []
    tot = {by: sum((F.col(f"{by}_n")[i] for i in range(n)), F.lit(0.0)) for by in ("said", "suffix", "top", "domain", "host")}
    for i in range(n):
        own, prior = F.col("t")[i], F.lit(base[i])
        for by in ("top", "domain", "host"):
            prior = (F.greatest(F.col(f"{by}_n")[i] - own, F.lit(0.0)) + DRAW * prior) / (F.greatest(tot[by] - 1, F.lit(0.0)) + DRAW)
        score = F.col("x")[i] + F.ln(prior)
        for by in ("said", "suffix"):
            # of what is said together with this language, next to how common the language is
            seen = (F.greatest(F.col(f"{by}_n")[i] - own, F.lit(0.0)) + DOUBT * base[i]) / (F.greatest(tot[by] - 1, F.lit(0.0)) + DOUBT)
            score = score + F.when(F.col(by) == "", 0.0).otherwise(F.ln(seen / base[i]))
        scores.append(score)
    out = out.withColumn("s", F.array(*scores)).withColumn("most", F.array_max("s"))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.element_at(names, F.array_position("s", F.col("most")).cast("int"))
    text_best = F.when(F.array_min("x") < F.array_max("x"), F.element_at(names, F.array_position("x", F.array_max("x")).cast("int")))
    prob = 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    return out.select("page_id", "host", best.alias("lang"), prob.alias("probability"), text_best.alias("text_lang"), F.when(F.col("said") != "", F.col("said")).alias("declared"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
