"""URL filtering by Bloom filter cascades, with DataFrame functions only.

A listed key is a host, then the start of a path ("example.org/es/"). The keys a url could match
are each suffix of its host at a dot, with each start of its path whose length occurs in the list;
all of these over the corpus are the complete key universe. A cascade encodes the listed keys in
its first Bloom filter, the universe's false positives there in the second, the listed keys that
the second takes for such in the third, and so on until no key is misjudged. For every key of the
universe, the first level that doesn't hold it then tells exactly whether it is listed - by bit
look-ups in constants, with no join. Allowed and blocked keys have a cascade each; the longest
listed key of a url decides.

Bounds: a cascade's bits are about 1.44 * log2(universe / listed) for each listed key at level 1
and fewer above. They are collected and put into the plan; ``MOST_WORDS`` 64-bit words are the most
a level may have, and a list that needs more raises an error (part it by host, and unite verdicts).

Edge cases: a null url, or one without "://", has empty host and path, fits no rule and is allowed;
repeated rows repeat their verdict; an empty table gives an empty result; columns besides page_id
and url are not read. Of listed keys of one length, that later in code point order decides; a key
both allowed and blocked is blocked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

#: The query's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MOST_WORDS = 1 << 20


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys a url could match, for path starts of the given lengths."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda s: F.concat(h, s))))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its words, as text of signed 64-bit numbers, its bits and hashes."""

    words: str
    bits: int
    hashes: int
    salt: int

    def places(self, key: Column) -> list[Column]:
        a, b = (F.pmod(F.xxhash64(key, F.lit(2 * self.salt + i)), F.lit(self.bits)) for i in (0, 1))
        return [F.pmod(a + i * b + i * i, F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded into a constant
        out = F.lit(True)
        for p in self.places(key):
            word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
            out = out & (F.getbit(word, (p % 64).cast("int")) == 1)
        return out


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of n keys at about the given rate of false positives."""
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    bits = 64 * max(1, math.ceil(1.4427 * hashes * n / 64))
    if bits // 64 > MOST_WORDS:
        raise ValueError(f"{n} keys need more than {MOST_WORDS} words of a filter; part the list")
    empty = Level("", bits, hashes, salt)
    one = F.expr("shiftleft(1L, cast(p % 64 as int))")
    set_bits = keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("v"))
    words = [0] * (bits // 64)
    for r in set_bits.collect():  # at most MOST_WORDS rows
        words[r["w"]] = r["v"]
    return Level(",".join(map(str, words)), bits, hashes, salt)


def cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch, name: str) -> list[Level]:
    """Levels that tell each key of the universe, and each listed key, exactly.

    Both have a column key; the universe may repeat keys and hold listed ones.
    """
    ins = scratch.save(listed.select("key").distinct(), f"{name}-listed")
    n = ins.count()
    if not n:
        return []
    u = max(n + 1, universe.count())
    levels = [_level(ins, n, min(0.5, max(2.0**-20, n / (math.sqrt(2) * (u - n)))), 0)]
    outs = universe.select("key").filter(levels[0].holds(F.col("key"))).distinct().join(ins, "key", "left_anti")
    held = [ins, scratch.save(outs, f"{name}-1")]
    while m := held[-1].count():
        # the last of held are false positives of the last level: encode them, then see which keys of the side before pass
        levels.append(_level(held[-1], m, 0.5, len(levels)))
        held.append(scratch.save(held[-2].filter(levels[-1].holds(F.col("key"))), f"{name}-{len(levels)}"))
    return levels


def listed_by(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of each row.

    rules: action ("allow" or "block") and key. A url that no listed key fits is allowed.
    """
    scratch = Scratch(pages.sparkSession)
    rules = rules.select("action", F.col("key").cast("string").alias("key"))
    start = F.regexp_extract("key", r"\A[^/]*(.*)\z", 1)
    lengths = sorted(r["n"] for r in rules.select(F.length(start).alias("n")).distinct().collect())  # lengths of paths
    rows = pages.select("page_id", url_host(F.col("url").cast("string")).alias("host"), url_path(F.col("url").cast("string")).alias("path"))
    rows = rows.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths))
    universe = rows.select(F.explode("keys").alias("key"))
    by = {a: cascade(rules.filter(F.col("action") == a), universe, scratch, a) for a in ("allow", "block")}

    def longest(levels: list[Level]) -> Column:
        fit = F.filter("keys", lambda k: listed_by(levels, k))
        return F.array_max(F.transform(fit, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))

    rows = rows.withColumns({f"{a}_fit": longest(levels) for a, levels in by.items()})
    blocked = F.col("block_fit").isNotNull() & (F.col("allow_fit").isNull() | (F.col("block_fit") >= F.col("allow_fit")))
    rule = F.when(blocked, F.col("block_fit.rule")).otherwise(F.col("allow_fit.rule"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{a}', '{k}')" for a, k in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(action, key)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM (SELECT page_id, coalesce(r, '') r FROM u)),
rules(action, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, arg_max(h || s, length(h || s)) rule, arg_max(action, length(h || s)) verdict
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') verdict FROM p LEFT JOIN f USING (page_id)
"""
