"""Operators against plain Python on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import decontaminate, fingerprints, importance, language, licenses, mixing, near_dups, passages, superminhash, token_counts, url_filter
from shutterlake.llm.common import Scratch
from shutterlake.llm.components import components
from shutterlake.llm.ranks import anchors, doubled

DOCS = "doc_id long, text string"


def test_cascade_is_exact(spark):
    rng = random.Random(3)
    universe = [f"h{i}.org/" for i in range(3000)]
    listed = rng.sample(universe, 400)
    u, k = (spark.createDataFrame([(x,) for x in xs], "key string") for xs in (universe, listed))
    levels = url_filter.cascade(k, u, Scratch(spark), "t")
    assert len(levels) > 2
    assert {r["key"] for r in u.filter(url_filter.listed_by(levels, F.col("key"))).collect()} == set(listed)
    assert url_filter.cascade(k.limit(0), u, Scratch(spark), "t0") == []


def test_url_parts(spark):
    urls = ["http://A.b/c?d#e", "x://H", "https://u@h:80#f", "://q/w", "none", None, "http://h?x/y"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [tuple(r) for r in df.select(url_filter.url_host(F.col("u")), url_filter.url_path(F.col("u"))).collect()]
    assert got == [("a.b", "/c"), ("h", ""), ("u@h:80", ""), ("q", "/w"), ("", ""), ("", ""), ("h", "")]


def test_longest_rule_wins(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.org/", "http://x.example.org/en/12", "http://example.org/en/2", "http://notorg/x", "http://org", "http://org/"])], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "action string, key string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {0: ("org/", "allow"), 1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("org/", "allow")}


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    rows = [(1, "text.\nReleased under the MIT License.\nmore"), (2, mit), (3, "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at"), (4, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."), (5, "no licence"), (6, None)]
    got = {r["doc_id"]: (r["licenses"], r["n_matches"], r["n_known"], r["n_unclaimed"]) for r in licenses.recognise(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: ("MIT", 1, 1, 0), 2: ("MIT", 1, 2, 0), 3: ("Apache-2.0", 1, 3, 0), 4: ("", 0, 1, 1), 5: ("", 0, 0, 0), 6: ("", 0, 0, 0)}


def sentences_plainly():
    """Every known sentence, ways to refer to a licence written out."""
    out = {}
    for s, i in licenses.SENTENCES.items():
        ways = [f"{w} {says}".strip() for w in ("", *map(licenses.plain, licenses.WHAT)) for says in licenses.SAYS] if s.startswith("ref ") else [""]
        out |= {(s.replace("ref", w, 1) if w else s): i for w in ways}
    return out


def licences_plainly(text, known, rules=licenses.RULES):
    """Line by line and character by character."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").translate({13: " ", 1: " ", 2: " ", 3: " "})
    space, groups, lines, words = " \t\n\x0b\x0c", [[]], low.split("\n"), lambda t: " ".join(re.findall("[a-z0-9]+", t))
    for k, line in enumerate(lines):
        if (k < len(lines) - 1 or k == 0) and not words(line) and k:
            groups.append([])  # a blank line
        m = re.match(r"[^a-z0-9]*(?:[0-9]{1,2}|[a-z])[.)](?=([\t-\r ])|$)", line)
        if m and (m[1] or k < len(lines) - 1):
            groups.append([])
            line = line[m.end() :]
        start = 0
        for i, c in enumerate(line):
            if c in ".!?;:" and (i + 1 == len(line) or line[i + 1] in space):
                groups[-1].append(words(line[start:i]))
                groups.append([])
                start = i + 1
        groups[-1].append(words(line[start:]))
    ids = []
    for g in groups:
        g, i = [x for x in g if x], 0
        while i < len(g):
            j = next((j for j in range(len(g), i, -1) if " ".join(g[i:j]) in known), None)
            ids.append(known[" ".join(g[i:j])] if j else "")
            i = j or i + 1
    n_known, found, n = sum(map(bool, ids)), [], 0
    for name, seq in rules:
        i = 0
        while i + len(seq) <= len(ids):
            if tuple(ids[i : i + len(seq)]) == seq:
                ids[i : i + len(seq)] = [""]
                found.append(name)
                n += 1
            i += 1
    return " AND ".join(dict.fromkeys(found)), n, n_known, sum(map(bool, ids))


BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance
 * with the License. You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""
GPL = """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public License
# as published by the Free Software Foundation, either version 2.1 of
# the License, or (at your option) any later version.
"""


def test_wrapped_notices(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\r\n// License, v. 2.0. If a copy of the MPL was not distributed with this\r\n// file, You can obtain one at http://mozilla.org/MPL/2.0/."
    rows = [(1, BSD), (2, APACHE), (3, GPL), (4, mpl), (5, "some words\nlicensed under the\nMIT License\nmore words"), (6, "x\nAll rights  reserved\ny"), (7, "SPDX-License-Identifier: GPL-3.0-or-later"), (8, "/* SPDX-License-Identifier: MIT */"), (9, "This code is released under the New BSD License. It is available under\nCC BY-SA 4.0!"), (10, "a) all rights reserved"), (11, "not all rights reserved")]
    got = {r["doc_id"]: (r["licenses"], r["n_matches"], r["n_known"], r["n_unclaimed"]) for r in licenses.recognise(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: g[0] for i, g in got.items()} == {1: "BSD-2-Clause", 2: "Apache-2.0", 3: "LGPL-2.1-or-later", 4: "MPL-2.0", 5: "MIT", 6: "Proprietary", 7: "GPL-3.0-or-later", 8: "MIT", 9: "BSD-3-Clause AND CC-BY-SA-4.0", 10: "Proprietary", 11: ""}
    known = sentences_plainly()
    assert got == {i: licences_plainly(t, known) for i, t in rows}


def test_licences_equal_a_loop(spark, sf):
    rng, known = random.Random(4), sentences_plainly()
    some = rng.sample(sorted(known), 60) + [licenses.plain(licenses.TEXTS[i]) for i in ("MITgrant", "MITnotice", "Reserved", "BSDgrant", "BSDsource", "BSDbinary", "SPDX")]

    def piece():
        s = rng.choice(some) if rng.random() < 0.5 else rng.choice(["some words", "", "a", "7", "x y é", "MIT"])
        return "".join(rng.choice([" ", " ", " ", "\n", "  ", ", ", "\n# "]) if c == " " and rng.random() < 0.2 else c for c in s)

    rows = [(i, "".join(piece() + rng.choice([". ", ".\n", "\n\n", "\n", "; ", "\n1. ", "\n (b) ", " ", ".", "\r\n", "!? ", "\n * ", "\n-\n"]) for _ in range(rng.randint(0, 9)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "." * 5000 + " all rights reserved"), (904, "\n" * 5000 + "all rights reserved" + " " * 5000)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = {r["doc_id"]: (r["licenses"], r["n_matches"], r["n_known"], r["n_unclaimed"]) for r in licenses.recognise(docs).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == licences_plainly(r["text"], known), r["text"]
    assert sum(bool(g[0]) for g in got.values()) > 60

    import duckdb

    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    assert {r[0]: r[1:] for r in c.sql(licenses.OP2_SQL).fetchall()} == got


def test_cues_with_other_characters_between(spark):
    rows = list(enumerate(["All rights  reserved.", "All rights\treserved.", "All rights\u00a0reserved.", "All-rights-reserved", "<b>All rights</b> reserved"]))
    got = {r["doc_id"]: (r["licenses"], r["n_known"]) for r in licenses.recognise(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: ("Proprietary", 1) for i in range(4)} | {4: ("", 0)}
    free = [(1, "This program is free  software."), (2, "This program is free-software.")]
    assert all(r["n_known"] == 1 for r in licenses.recognise(spark.createDataFrame(free, DOCS)).collect())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts_equal_the_library(spark, library, sf):
    path, lib = library
    rng = random.Random(1)
    pieces = ["a", "B", "'s", "'LL", " ", "\n", "<|endoftext|>", "<|startoftext|>", "<|x|>", "1", "²", "Σ", "ς", "İ", "e\u0301", "中", "!", "\x1c", "\x85", "😀", "ſ", "\ua7cb", "\U00032808", "hello", "WORLD"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 15)))) for i in range(400)] + [(900, None), (901, "word" * 3000), (902, "x " * 3000)]
    got = {r["doc_id"]: r for r in token_counts.token_counts(spark.createDataFrame(rows, DOCS), path).collect()}
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048), t
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: len(lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()} == want


def test_kept_words_are_bounded(library):
    c = token_counts.Counter(token_counts.load_spec(library[0]), kept=3)
    assert c.count("a bb ccc dddd eeeee a bb") == len(library[1].encode("a bb ccc dddd eeeee a bb").ids) and len(c) <= 3


def syncmers_plainly(t: bytes) -> set[int]:
    names = {s: doubled(np.frombuffer(t, np.uint8), (8,))[8] for s in (0,)}[0]
    out = set()
    for p in range(len(t) - 19):
        inner = names[p : p + 13]
        if inner.min() in (inner[0], inner[12]):
            out.add(t[p : p + 20])
    return out


def test_syncmers_and_likeness():
    rng = random.Random(2)
    a = bytes(rng.choices(b"abcd ", k=400))
    b = a[:300] + bytes(rng.choices(b"abcd ", k=100))
    sa, sb = syncmers_plainly(a), syncmers_plainly(b)
    assert len(fingerprints.syncmers(a)) >= len(sa) and len(set(fingerprints.syncmers(a).tolist())) == len(sa)
    fa, fb = fingerprints.fingerprint(a, 10**6), fingerprints.fingerprint(b, 10**6)
    assert abs(fingerprints.likeness(fa, fb, 10**6) - len(sa & sb) / len(sa | sb)) < 1e-9
    moved = b"xyz" * 50 + a  # the same anchors wherever the passage stands
    assert set(fingerprints.syncmers(a).tolist()) <= set(fingerprints.syncmers(moved).tolist())
    none = fingerprints.fingerprint(b"")
    assert fingerprints.likeness(none, none) == 1.0 and fingerprints.likeness(none, fa) == 0.0
    assert len(fingerprints.fingerprint(b"ab")) == 1


@pytest.mark.parametrize("n", [1, 2, 700])
def test_fingerprints_follow_the_next_document(spark, n):
    rng = random.Random(n)
    rows = [(i * 3, "".join(rng.choices("abcdeé ", k=rng.randint(0, 90))) if rng.random() > 0.05 else None) for i in range(n)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    assert len(got) == n
    for k, (i, t) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % n][1] or ""
        e = (t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()
        f, g, h = (fingerprints.fingerprint(x) for x in (t.encode(), e, u.encode()))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(e).hexdigest(), f.tobytes().hex(), g.tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(f, g), fingerprints.likeness(f, h))


def test_ranges_by_two_lookups(spark):
    bounds = [float(x) for x in sorted(random.Random(1).sample(range(10_000), 900))]
    df = spark.range(0, 10_000, 7).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["r"] for r in df.select("doc_id", fingerprints._range_of(bounds, 32).alias("r")).collect()}
    assert got == {d: sum(b <= d for b in bounds) for d in got}


def test_targets_share_what_is_over():
    sizes = [10, 1000, 1000, 5]
    t = mixing.share_out(sizes)
    assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
    assert t[0] == 20 and t[3] == 10
    assert mixing.share_out([]) == [] and mixing.share_out([0, 0]) == [0.0, 0.0]


def test_schedule(spark):
    plan = mixing.plan_mix([("a", 5000), (None, 70), ("b", 12_000), ("c", 1), ("d", 0)])
    assert plan.sources == ["a", "b", "c", "d", None]
    rows = sorted(mixing.slots(spark, plan).collect(), key=lambda r: r["slot"])
    seen: dict[int, int] = {}
    for r in rows:
        assert r["rank"] == seen.get(r["source_no"], 0) and 0 < r["words"] <= plan.block
        seen[r["source_no"]] = r["rank"] + 1
    assert [seen.get(i, 0) for i in range(5)] == plan.draws
    for i, want in enumerate(plan.words):
        assert sum(r["words"] for r in rows if r["source_no"] == i) == want
    for cut in (len(rows) // 7, len(rows) // 2):  # any stretch is near the weights
        for i, d in enumerate(plan.draws):
            assert abs(sum(r["source_no"] == i for r in rows[:cut]) - d * cut / len(rows)) < 8


def test_mix_takes_what_is_due(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", None])) for i in range(200)]
    docs, _, plan = mixing.mix(spark.createDataFrame(rows, DOCS + ", source string"))
    got = docs.collect()
    assert len(got) == 200 and got and all(r["taken"] <= 2 * r["size"] for r in got)
    for s, want in zip(plan.sources, plan.words, strict=True):
        assert sum(r["taken"] for r in got if r["source"] == s) == want
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(rows[::-1], DOCS + ", source string").repartition(7))[0].collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def superminhash_plainly(values, m):
    """Slot by slot, value by value, with the kernel's draws."""
    from shutterlake.llm.ranks import scramble

    out = [(1 << 64) - 1] * m
    for v in values:
        state = scramble(np.array([v], np.uint64) ^ np.uint64(0xA0761D6478BD642F))
        perm = list(range(m))
        for j in range(m):
            state = scramble(state + np.uint64(0x9E3779B97F4A7C15))
            s = int(state[0])
            k = j + ((s & 0xFFFFFFFF) * (m - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            out[perm[j]] = min(out[perm[j]], j << 32 | s >> 32)
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 40, 500])
def test_superminhash_stops_early_and_right(n):
    values = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    assert superminhash.signature(values, 32).tolist() == superminhash_plainly(values.tolist(), 32)


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (850, 75, 75))
    x, y = (superminhash.signature(np.concatenate([both, z]), 192) for z in (a, b))
    assert abs((x == y).mean() - 0.85) < 0.12


def near_copies(rng, n):
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(n):
            t = base[:]
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(120)] = rng.choice(words)
            out.append(" ".join(t))
    return out


def drifting_copies(rng, n):
    """Each text is the last one with a word changed: near neighbours are alike, far ones share a long beginning only."""
    words, out = [f"w{i}" for i in range(300)], []
    t = [rng.choice(words) for _ in range(120)]
    for _ in range(n):
        t = t[:]
        t[rng.randrange(70, 120)] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("copies, n", [(near_copies, 60), (drifting_copies, 180)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, copies, n):
    monkeypatch.setattr(near_dups, "BLOCK", 16)  # groups get more stars, then are dealt out in blocks
    monkeypatch.setattr(near_dups, "MANY", 1)
    rng = random.Random(5)
    rows = list(enumerate(copies(rng, n))) + [(500, None), (501, " "), (502, "A b"), (503, "a B"), (504, "a b c")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(6)).collect()}

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert got == {(rows[i][0], len(sets[i]), rows[root(i)][0], root(i) == i) for i in range(len(rows))}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1100)]
    pairs = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7), Scratch(spark), "t").collect()}
    assert got == {x: root(x) for x in up}


def test_anchors_equal_a_loop():
    rng = np.random.default_rng(4)
    for n, w, top in ((200, 7, 1 << 60), (200, 7, 4), (50, 50, 9), (50, 1, 9), (3, 9, 9)):
        x = rng.integers(0, top, n).astype(np.uint64)
        want: list[list[int]] = []
        for s in range(n - w + 1):
            p = s + int(np.argmin(x[s : s + w]))
            if want and want[-1][0] == p:
                want[-1][2] = s
            else:
                want.append([p, s, s])
        assert [list(map(int, r)) for r in zip(*anchors(x, w), strict=True)] == want


def removed_plainly(texts: list[bytes], n: int = 400) -> list[list[bool]]:
    where: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            where[t[i : i + n]] = where.get(t[i : i + n], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if where[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


def test_repeated_passages_equal_all_windows(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 900)  # long texts are scanned in parts
    rng = random.Random(8)
    text = lambda k: "".join(rng.choices("abcdé ", k=k))
    shared = [text(k) for k in (396, 399, 400, 401, 450, 700, 1500)]
    rows = [text(rng.randint(0, 600)) + rng.choice(shared) + text(rng.randint(0, 300)) + rng.choice(["", rng.choice(shared)[: rng.randint(300, 700)]]) for _ in range(60)]
    rows += ["ab" * 450, "a" * 401, "a" * 400, "", None, text(2500), rows[3], rows[3], text(900) + text(10) * 90]
    flip = list(shared[6])
    flip[700] = "Z"
    rows += [shared[6], "".join(flip), shared[5][:-1] + "Q", "P" + shared[5][1:]]
    docs = spark.createDataFrame(list(enumerate(rows)), DOCS).repartition(5)
    got = {r["doc_id"]: r for r in passages.cut_passages(docs).collect()}
    blobs = [(t or "").encode() for t in rows]
    for i, gone in enumerate(removed_plainly(blobs)):
        kept = bytes(b for b, g in zip(blobs[i], gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        assert (got[i]["kept"], len(got[i]["spans"] or [])) == (kept, spans), i


@pytest.mark.parametrize("length", [1, 7, 400])
def test_plain_doubling_equals_all_windows(spark, length):
    rng = random.Random(length)
    text = lambda k: "".join(rng.choices("abé", k=k))
    shared = text(420)
    rows = [text(30) + shared, shared + text(50), "ab" * 260, text(9), "", None, text(500), text(500)[:3], "a" * 401]
    rows.append(rows[6])
    got = {(bytes(r["key"]), r["p"]) for r in passages.doubled_spans(spark.createDataFrame(list(enumerate(rows)), DOCS), length).collect()}
    blobs = [(t or "").encode() for t in rows]
    seen: dict[bytes, int] = {}
    for b in blobs:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    assert got == {(hashlib.md5(b).digest(), i) for b in blobs for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1}
    if length == 400:  # the pruned form finds the same
        spans = {(bytes(r["key"]), j) for r in passages.repeated_spans(spark.createDataFrame(list(enumerate(rows)), DOCS)).collect() for s in r["spans"] for j in range(s["first"], s["end"])}
        assert spans == {(k, p + j) for k, p in got for j in range(length)}


def test_passages_of_words_equal_all_windows(spark):
    rng = random.Random(3)
    some = lambda k: " ".join(rng.choice(["a", "bb", "é", "Dd,"]) + str(rng.randint(0, 40)) for _ in range(k))
    shared = [some(k) for k in (50, 51, 52, 80)]
    rows = [some(rng.randint(0, 30)) + "\n " + rng.choice(shared) + "\t" + some(rng.randint(0, 20)) for _ in range(40)] + ["x " * 60, "x " * 50, None, "", some(200)]
    rows += [rows[-1], rows[0].replace(" ", "  ")]
    got = {bytes(r["key"]): [(s["first"], s["end"]) for s in r["passages"]] for r in passages.repeated_spans(spark.createDataFrame(list(enumerate(rows)), DOCS).repartition(3), words=51).collect()}
    blobs = [(t or "").encode() for t in rows]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in blobs]
    seen: dict[tuple, int] = {}
    for b, at in zip(blobs, places, strict=True):
        for i in range(len(at) - 50):
            w = tuple(b[x:y] for x, y in at[i : i + 51])
            seen[w] = seen.get(w, 0) + 1
    for b, at in zip(blobs, places, strict=True):
        want = decontaminate.merge([(at[i][0], at[i + 50][1]) for i in range(len(at) - 50) if seen[tuple(b[x:y] for x, y in at[i : i + 51])] > 1])
        assert got.get(hashlib.md5(b).digest(), []) == want


def test_first_units_do_not_depend_on_parts():
    t = bytes(random.Random(1).choices(b"abcd ", k=6000))
    whole = [x.tolist() for x in passages.first_units(t)]
    assert len(set(whole[2])) == len(whole[2])
    for chunk in (100, 337, 900, 1000):
        assert [x.tolist() for x in passages.first_units(t, chunk)] == whole


def test_joined_texts_have_the_units_of_each():
    from shutterlake.llm.ranks import doubled_names, word_names, word_places

    rng = random.Random(2)
    blobs = ["".join(rng.choices("ab é\n", k=rng.choice([0, 5, 399, 400, 401, 700, 2000]))).encode() for _ in range(30)]
    data = np.frombuffer(b" ".join(blobs), np.uint8)
    end = np.cumsum([len(b) + 1 for b in blobs]) - 1
    start = end - [len(b) for b in blobs]
    row, units = passages.joined_units(data, start, end)
    wrow, words = passages.word_units(data, start, end, 51)
    for i, b in enumerate(blobs):
        want = passages.first_units(b) or ([],) * 5
        assert [x[row == i].tolist() for x in units] == [list(x) for x in want]
        own = passages.word_units(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), 51)[1]
        assert [x[wrow == i].tolist() for x in words] == [x.tolist() for x in own]
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        assert [tuple(x) for x in zip(*(v.tolist() for v in word_places(np.frombuffer(b, np.uint8))), strict=True)] == at
    first, last = word_places(data)
    whole = word_names(data, first, last)
    assert whole.tolist() == word_names(data, first, last, 100).tolist() and len(set(whole.tolist())) == len({data[a:b].tobytes() for a, b in zip(first, last, strict=True)})
    assert len(doubled_names(whole[:3], (8,))[8]) == 0


def test_bytes_at_the_edges_of_parts_stay(spark):
    rng = random.Random(9)
    text = lambda k: "".join(rng.choices("abcd ", k=k))
    shared = text(700)
    rows = [text(9000), text(2000) + shared + text(3000), text(1111) + shared]
    docs = spark.createDataFrame(list(enumerate(rows)), DOCS)
    got = {r["key"]: [(s["first"], s["end"]) for s in r["spans"]] for r in passages.repeated_spans(docs, chunk=900).collect()}
    for t, gone in zip(rows, removed_plainly([t.encode() for t in rows]), strict=True):
        spans = got.get(hashlib.md5(t.encode()).digest(), [])
        assert [any(a <= j < e for a, e in spans) for j in range(len(t))] == gone


def hits_plainly(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(13, len(x))
        for win in {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else ():
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) == win:
                    hit.update(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_equals_all_windows(spark, block_bytes):
    rng = random.Random(6)
    some = lambda k, v=30: " ".join(rng.choice([f"w{i}", f"W{i},", f"é{i}"]) for i in rng.choices(range(v), k=k))
    items = [(i, some(rng.choice([1, 2, 5, 12, 13, 14, 40]), 400)) for i in range(25)] + [(30, None), (31, " . "), (32, "w1 w1 w1 " * 9)]
    docs = []
    for i in range(60):
        t = some(rng.randint(0, 60), 400)
        for _ in range(rng.randint(0, 2)):
            x = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(x) - 5))
            t += " " + " ".join(x[a : a + rng.randint(5, 30)]) + " " + some(rng.randint(0, 9), 400)
        docs.append((i, t))
    docs += [(90, None), (91, "w1 " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), bench, block_bytes=block_bytes).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        n, h, ids = hits_plainly(t, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()), i
        assert r["contaminated"] == (h > 0 and 20 * h >= n)
    wide = spark.createDataFrame([(i, t, i) for i, t in docs], DOCS + ", text_key long")
    left = decontaminate.clean(wide, bench, block_bytes=block_bytes)
    assert left.columns == wide.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in docs if not got[i]["contaminated"]}


def test_kth_greatest(spark):
    rng = random.Random(2)
    xs = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(300)] + [5] * 20
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    for k in (1, 7, 150, 320):
        assert importance.kth_greatest(df, "x", k) == sorted(xs, reverse=True)[k - 1]
    d = np.array([-np.inf, -2.5, -0.0, 0.0, 1e-9, 3.0])
    assert (np.diff(importance.sortable(d)) > 0).all() and importance.kth_greatest(df, "x", 0) is None


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, rest = labels.filter("doc_id % 2 = 0"), {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.filter("doc_id % 2 = 1").collect()}
    got = {r["doc_id"]: r["kept"] for r in importance.importance_resample(docs, importance.target_labels(fit)).collect()}
    clean = [got[i] for i, (q, t) in rest.items() if q == 1 and t == 0]
    junk = [got[i] for i, (q, _) in rest.items() if q == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.1


def test_toxic_held_out_labels_go(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, rest = labels.filter("doc_id % 2 = 0"), {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.filter("doc_id % 2 = 1").collect()}
    got = {r["doc_id"]: r["kept"] for r in importance.importance_resample(docs, importance.target_labels(fit)).collect()}
    kept = {kind: np.mean([got[i] for i, qt in rest.items() if qt == kind]) for kind in ((1, 0), (1, 1), (0, 0), (0, 1))}
    assert kept[1, 1] < 0.15 and kept[0, 1] < 0.1 and kept[1, 0] > 0.95 and kept[0, 0] < 0.1


def test_resampling_is_deterministic(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    run = lambda d: sorted((r["doc_id"], round(r["score"], 9), r["kept"]) for r in importance.importance_resample(d, importance.target_labels(labels)).collect())
    assert run(docs) == run(docs.repartition(7))


def test_limit_between():
    assert importance.limit_between([3.0, 4.0], [1.0, 2.0]) == 2.5
    assert importance.limit_between([], [1.0]) == -np.inf


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    fit, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 and length(text) > 60")
    pages = rest.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), F.pmod("doc_id", F.lit(5)).cast("string"), F.lit(".example.com/")).alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), F.col("lang").alias("truth"))
    got = language.identify(pages, fit).join(pages.select("page_id", "truth"), "page_id")
    assert got.filter("lang = truth").count() > 0.95 * got.count()


def test_language_evidence_without_text(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are here", "en"), ("le chat et le chien sont ici", "fr")] * 20)], "doc_id long, text string, lang string")
    fr, en = "<html lang='fr'><p>le chien et le chat sont", "<html lang=en><p>the dog and the cat are"
    rows = [(i, "http://a.fr/x", fr) for i in range(20)] + [(100 + i, "http://b.com/x", en) for i in range(20)] + [(200, "http://a.fr/y", "<html lang=fr><script>the the</script>"), (201, "http://b.com/y", "")]
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert (got[200]["lang"], got[200]["text_lang"], got[200]["declared"]) == ("fr", None, "fr") and got[201]["lang"] == "en"
    assert language.visible(b"<style>x</style>A<!-- b --><b>C</b>").split() == [b"a", b"c"]


def test_resampling_equals_plain_counts(spark):
    """Weights, toxicity, limits, k and the selection of a small table, counted by dictionaries."""
    import math

    rng = random.Random(7)
    good, bad, vile = [f"good{i}" for i in range(30)], [f"Junk{i}!" for i in range(30)], ["awful", "vile"]
    rows = []
    for i in range(80):
        words = rng.choices(good if i % 2 else bad, k=rng.randint(5, 40)) + (rng.choices(vile, k=2) if i % 10 == 3 else [])
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, " "), (None, "good1 good2"), (7, rows[7][1])]
    labels = [(i, i % 2 == 1 and i % 10 != 3, i % 10 == 3) for i in range(0, 60)]
    docs, lab = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, target boolean, toxic boolean")
    got = importance.importance_resample(docs, lab).select("doc_id", "log_weight", "score", "kept").collect()
    B = importance.WORD_BUCKETS
    grams = [(i, importance.ngrams((t or "").encode()).tolist()) for i, t in rows]
    say = {i: (t, x) for i, t, x in labels}
    raw, target, has = {}, {}, ({}, {})
    sizes = [0, 0]
    for i, g in grams:
        for b in g:
            raw[b] = raw.get(b, 0) + 1
            if i in say and say[i][0]:
                target[b] = target.get(b, 0) + 1
        if i in say:
            kind = 0 if say[i][1] else 1
            sizes[kind] += 1
            for b in {b for b in g if b < B}:
                has[kind][b] = has[kind].get(b, 0) + 1
    part = lambda c, words: sum(n for b, n in c.items() if (b < B) == words)
    share = {w: max(part(target, w), 1) / max(part(raw, w), 1) for w in (True, False)}

    def weight(i, g):
        own = {b: g.count(b) for b in set(g)} if i in say and say[i][0] else {}
        s = 0.0
        for b in g:
            p = share[b < B]
            s += math.log((max(target.get(b, 0) - own.get(b, 0), 0) + importance.SMOOTH * p) / (raw[b] + importance.SMOOTH) / p)
        return s

    def toxicity(i, g):
        said = []
        for b in {b for b in g if b < B}:
            mine = [i in say and say[i][1], i in say and not say[i][1]]
            n = [max(has[k].get(b, 0) - mine[k], 0) for k in (0, 1)]
            p = [(n[k] + importance.DRAWN) / (sizes[k] - mine[k] + 2 * importance.DRAWN) for k in (0, 1)]
            said.append(math.log(p[0] / p[1]) if n[0] else 0.0)
        return sum(sorted(said)[-importance.STRONGEST :])

    w, x = [weight(i, g) for i, g in grams], [toxicity(i, g) for i, g in grams]
    by_id = lambda v: {i: min(y for (j, g), y in zip(grams, v, strict=True) if j == i and g) for i, g in grams if i in say and g}
    ws, xs = by_id(w), by_id(x)
    limit = importance.limit_between([ws[i] for i in ws if say[i][0] and not say[i][1]], [ws[i] for i in ws if not say[i][0] and not say[i][1]])
    most = importance.limit_between([xs[i] for i in xs if say[i][1]], [xs[i] for i in xs if say[i][0]])
    noise = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(1)).alias("h")).collect()}
    score = [a - math.log(-math.log((((noise[i] >> 11) & ((1 << 53) - 1)) + 0.5) / 2.0**53)) for (i, _), a in zip(grams, w, strict=True)]
    may = [bool(g) and t <= most for (_, g), t in zip(grams, x, strict=True)]
    k = sum(m and a > limit for m, a in zip(may, w, strict=True))
    least = sorted((s for s, m in zip(score, may, strict=True) if m), reverse=True)[k - 1]
    want = sorted(((i, round(a, 6), round(s, 6), m and s >= least) for (i, _), a, s, m in zip(grams, w, score, may, strict=True)), key=repr)
    assert sorted(((r["doc_id"], round(r["log_weight"], 6), round(r["score"], 6), r["kept"]) for r in got), key=repr) == want
    assert 0 < sum(r["kept"] for r in got) < len(got) and not any(r["kept"] for r in got if r["doc_id"] in say and say[r["doc_id"]][1])


def test_language_equals_plain_fusion(spark):
    """Every likelihood and prior of a small table, by loops."""
    import math

    rng = random.Random(9)
    voc = {"de": "der die das und ist nicht".split(), "en": "the and is not of to".split(), "fr": "le la les et est pas".split()}
    some = lambda lang, k: " ".join(rng.choices(voc[lang], k=k))
    docs = [(i, some(lang, 30), lang) for i, lang in enumerate(sorted(voc) * 8)]
    hosts = ["a.b.de", "x.b.de", "www.c.com", "c.com", "f.fr", ""]
    pages = []
    for i in range(60):
        host, lang = rng.choice(hosts), rng.choice(sorted(voc))
        path = rng.choice(["/", "/fr/x", "/de", "/long/x", ""])
        url = rng.choice([f"http://{host}{path}", f"http://{host}{path}", None, "nothing"])
        html = rng.choice([f"<html lang='{rng.choice(['de', 'EN', 'xx', lang])}'><p>{some(lang, rng.randint(1, 9))}", f"<p>{some(lang, 5)}", "", None])
        pages.append((i, url, html))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    p = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in language.identify(p, d).collect()}
    langs, n = sorted(voc), len(voc)
    logs = []
    for lang in langs:
        c = [0.5] * language.BUCKETS
        for _, t, x in docs:
            if x == lang:
                for b in language.trigrams(t.encode()).tolist():
                    c[b] += 1
        logs.append([math.log(v / sum(c)) for v in c])
    rows = []
    for i, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        part = re.match(r"/([a-z]{2})(?:/|$)", path)
        said = re.search(r"<html lang='(\w+)'", html or "")
        text = language.visible((html or "").encode())
        x = [language.TEMPER * sum(lg[b] for b in language.trigrams(text).tolist()) if text.strip() else 0.0 for lg in logs]
        x = [max(v - max(x), -language.MOST_TEXT) for v in x]
        t = [math.exp(v) / sum(map(math.exp, x)) for v in x]
        labels = host.split(".")
        rows.append((i, x, t, {"said": said[1].lower() if said else "", "suffix": f"{labels[-1]}/{part[1] if part else ''}", "top": labels[-1], "domain": ".".join(labels[-2:]), "host": host}))
    whole = [sum(t[k] for _, _, t, _ in rows) for k in range(n)]
    base = [(w + 1) / (sum(whole) + n) for w in whole]
    for i, x, t, of in rows:
        group = {by: [sum(u[k] for _, _, u, o in rows if o[by] == of[by]) for k in range(n)] for by in of}
        s = []
        for k in range(n):
            prior = base[k]
            for by in ("top", "domain", "host"):
                prior = (max(group[by][k] - t[k], 0) + language.DRAW * prior) / (max(sum(group[by]) - 1, 0) + language.DRAW)
            v = x[k] + math.log(prior)
            for by in ("said", "suffix"):
                if of[by]:
                    v += math.log((max(group[by][k] - t[k], 0) + language.DOUBT * base[k]) / (max(sum(group[by]) - 1, 0) + language.DOUBT) / base[k])
            s.append(v)
        total = sum(math.exp(v - max(s)) for v in s)
        assert got[i]["host"] == of["host"] and abs(got[i]["probability"] - 1 / total) < 1e-6, i
        if sorted(s)[-1] - sorted(s)[-2] > 1e-9:
            assert got[i]["lang"] == langs[s.index(max(s))], i
